"""Quality and performance rules. A rule is a condition on columns of one statement, so most findings need no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sqlstrata.functions import patterns as P, text as T
from sqlstrata.operators import items as I, refs as R, statements as S


@dataclass(frozen=True)
class Rule:
    """A finding where `when` holds. Users add their own with the same four values and a condition."""
    rule_id: str
    type: str
    severity: str | None
    category: str
    message: object  # text, or a Column over the feature frame
    when: Column
    each: Column | None = None  # an array: one finding per element, which ends the message


def features(stmts: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Everything the rules look at, from the statement's own text."""
    keep = [c for c in ("declared",) if c in stmts.columns]
    f = T.hold(stmts.select("doc_id", "path", "stmt_idx", "sql", "clean", "masked", *keep), outer_q=I._main_query(F.col("masked")), outer_clean=T.outer_text(F.col("clean")),
               tables_used=R.names_used(F.col("masked")))
    m, o = F.col("masked"), F.col("outer_q")
    f = T.hold(
        f, kind=S.statement_kind(F.col("clean")), where_q=T.clause(o, "where"), having_q=T.clause(o, "having"), group_q=T.clause(o, "group"), select_q=T.select_list(o),
        literal_where=T.clause(F.col("outer_clean"), "where"), joins=T.rx_count(m, r"(?i)\bJOIN\b"), subqueries=T.rx_count(m, r"(?i)\(\s*SELECT\b"),
        conditions=T.rx_count(m, r"(?i)\bWHERE\b") + T.rx_count(m, r"(?i)\bHAVING\b"), aliases=I.alias_pairs(o), tables=F.array_distinct("tables_used"),
        from_items=F.size(T.split_top_level(T.rx(o, r"(?i)\bFROM\s+((?:(?!\b(?:WHERE|GROUP|ORDER|HAVING|LIMIT|JOIN|UNION|SET|ON|QUALIFY)\b)[^()])*+)", 1))))
    return T.hold(f, group_items=T.split_top_level(F.col("group_q")), select_items=T.split_top_level(F.col("select_q")), where_qualifiers=_qualifiers(F.col("where_q")))


_AGG = r"(?i)\b(?:COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT|STRING_AGG|LISTAGG|ARRAY_AGG|STDDEV\w*|VAR\w*)\s*\("


def _qualifiers(text: Column) -> Column:
    return F.array_distinct(F.transform(T.rx_all(text, r"(?<![\w.])([A-Za-z_]\w*)\.[A-Za-z_]\w*", 1), F.lower))


def _wrapped(names: str) -> str:
    """A listed function whose only column argument is a plain column."""
    return rf"(?i)(?<![\w.])({'|'.join(names.split())})\s*\(\s*(?:\w+\s+FROM\s+)?([A-Za-z_]\w*(?:\.\w+)?)\b[^()]*\)"


def statement_rules() -> list[Rule]:
    m, o, w, kind = F.col("masked"), F.col("outer_q"), F.col("where_q"), F.col("kind")
    selects = kind.isin("select", "cte")
    n_tables = F.size("tables")
    cross_at, join_at = F.expr("instr(upper(outer_q), 'CROSS JOIN')"), F.length(o) - F.instr(F.reverse(F.upper(o)), "NIOJ") - 2
    literal_where = F.col("literal_where")
    filtered = F.exists("tables", lambda t: F.lower(F.col("where_q")).contains(t))
    or_parts = F.split(w, r"(?i)\s+OR\s+")
    spans = F.exists(F.transform(or_parts, lambda p, i: F.struct(_qualifiers(p).alias("l"), _qualifiers(F.get(or_parts, i + 1)).alias("r"))),
                     lambda p: (F.size(p["l"]) > 0) & (F.size(p["r"]) > 0) & ~F.arrays_overlap(p["l"], p["r"]))
    table_qualifiers = F.filter("where_qualifiers", lambda q: F.exists(F.col("aliases"), lambda a: a["alias"] == q))
    branches = F.filter(F.transform(F.split(o, r"(?i)\b(?:UNION\s+ALL|UNION|INTERSECT|EXCEPT)\b"), T.select_list), lambda s: s != "")
    branch_sizes = F.array_distinct(F.transform(branches, lambda s: F.size(T.split_top_level(s))))
    unused = F.array_except(F.transform(R.cte_structs(m), lambda c: c["name"]),
                             F.transform(T.rx_all(m, r"(?i)(?:\b(?:FROM|JOIN|USING)|,)\s+(\w+)\b(?!\s*(?:\([^()]*\)\s*)?AS\s*\()", 1), F.lower))
    sub_select = F.exists("select_items", lambda i: i.rlike(r"(?i)^\(subq\)"))
    agg_items = F.col("select_q").rlike(r"(?i)\bCOUNT\s*\(\s*(?:\*|DISTINCT\b)")
    distinct_count = F.col("select_q").rlike(r"(?i)\bCOUNT\s*\(\s*DISTINCT\b") & ~F.col("select_q").rlike(r"(?i)\bCOUNT\s*\(\s*\*")
    perf, quality, practice = "performance", "quality", "best-practice"
    rules = [
        Rule("H1", "warning", "medium", perf, "the select list is a star: columns are not named", m.rlike(r"(?i)\bselect\s+(?:distinct\s+)?(?:[\w.]+\.)?\*")),
        Rule("H2", "info", "low", perf, "reads tables and returns all rows, without a limit", selects & ~o.rlike(r"(?i)\b(?:LIMIT|TOP|FETCH)\b") & (n_tables > 0)),
        Rule("H3", "error", "high", perf, F.concat(F.upper(kind), F.lit(" changes every row: it has no condition")), kind.isin("update", "delete") & ~o.rlike(r"(?i)\bWHERE\b")),
        Rule("H4", "warning", "medium", perf, F.format_string("%d joins in one query", F.col("joins")), F.col("joins") > 5),
        Rule("H5", "warning", "medium", perf, F.format_string("%d subqueries in one query", F.col("subqueries")), F.col("subqueries") > 3),
        Rule("H6", "error", "high", perf, "tables are listed without a condition between them",
             selects & (F.greatest(n_tables, F.col("from_items")) > 1) & (F.col("joins") == 0) & (F.col("conditions") == 0)
             & ~o.rlike(r"(?i)\b(?:UNION|INTERSECT|EXCEPT|WITH)\b") & (F.col("subqueries") == 0) & (F.col("from_items") > 1)),
        Rule("H7", "warning", "medium", quality, "never read: ", F.size(unused) > 0, F.array_sort(unused)),
        Rule("H12", "warning", "medium", perf, F.concat(F.lit("only "), F.get(table_qualifiers, F.lit(0)), F.lit(" is filtered: filter it ahead of the join")),
             selects & (F.col("joins") > 0) & (F.size(table_qualifiers) == 1)),
        Rule("H13", "info", "medium", perf, "the HAVING condition needs no groups: WHERE would do", (F.col("having_q") != "") & ~F.col("having_q").rlike(_AGG)),
        Rule("H14", "warning", "high", perf, "a cross join multiplies rows ahead of the other joins", (cross_at > 0) & (cross_at + 6 < join_at)),
        Rule("H15", "info", "low", perf, "several joins, and a filter that may decide their order", selects & (F.col("joins") > 1) & (w != "") & filtered),
        Rule("H17", "info", "medium", perf, "an IN list comes from a query: a semi-join says the same", m.rlike(r"(?i)(?<!\bNOT)\s+IN\s*\(\s*SELECT\b")),
        Rule("H18", "info", "medium", perf, "an EXISTS test has its own condition: a semi-join says the same", m.rlike(rf"(?i)\bEXISTS\s*\(\s*SELECT\b{T.BALANCED}\bWHERE\b") | m.rlike(r"(?i)\bEXISTS\s*\(\s*SELECT\b[^()]*\bWHERE\b")),
        Rule("H19", "info", "medium", perf, "a query in the select list may run once per row", sub_select),
        Rule("H20", "warning", "high", quality, "NOT IN over a query is never true once the query returns a null", m.rlike(r"(?i)\bNOT\s+IN\s*\(\s*SELECT\b")),
        Rule("H23a", "warning", "medium", perf, "adding zero turns a column into an expression of another type", w.rlike(r"(?i)[A-Za-z_]\w*\s*[+-]\s*0(?![\w.])")),
        Rule("H23b", "info", "low", perf, "multiplying or dividing by one changes nothing but hides the column", w.rlike(r"(?i)[A-Za-z_]\w*\s*[*/]\s*1(?![\w.])")),
        Rule("H23c", "warning", "medium", perf, "appending an empty text hides the column from an index", literal_where.rlike(r"(?i)[A-Za-z_]\w*\s*\|\|\s*''(?!')")),
        Rule("H24", "warning", "high", perf, "the pattern begins with a wildcard, so no prefix can be looked up", literal_where.rlike(r"(?i)\bLIKE\s+N?'%")),
        Rule("H25", "info", "medium", perf, "alternatives of one condition use different columns", spans),
        Rule("H26", "warning", "medium", perf, F.format_string("groups by %d columns", F.size("group_items")), F.size("group_items") > 5),
        Rule("H27", "info", "low", perf, "aggregates whole tables: there is no condition", selects & (w == "") & ((F.col("group_q") != "") | agg_items)),
        Rule("H28", "info", "medium", perf, "counts distinct values exactly", selects & distinct_count),
        Rule("H29", "warning", "medium", quality, "branches of the set operation differ in width", F.size(branch_sizes) > 1),
        Rule("H35a", "info", "low", practice, F.concat(F.upper(T.rx(F.col("clean"), r"(?i)^\s*\w+\s+(?:OR\s+REPLACE\s+)?(\w+)", 1)), F.lit(" is defined here: its body is not analysed")),
             F.col("clean").rlike(r"(?i)^\s*(?:CREATE|ALTER|DROP)\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE|TRIGGER)\b")),
        Rule("H35b", "warning", "medium", practice, "kind of statement unknown: only parts were extracted", S.operation(F.col("clean")).isNull()),
    ]
    for letter, (label, (names, kind_, severity)) in zip("abcdef", P.NON_SARGABLE.items()):
        pattern = _wrapped(names)
        rules.append(Rule(f"H22{letter}", kind_, severity, perf, F.concat(F.lit("condition on "), F.upper(T.rx(w, pattern, 1)), F.lit("() of a column, not on the column")), w.rlike(pattern)))
    listed = "|".join(n for names, _, _ in P.NON_SARGABLE.values() for n in names.split()) + "|" + "|".join(P.SARGABLE_AGGREGATES + ["EXISTS", "IN", "ANY", "ALL", "SOME", "AND", "OR", "NOT", "VALUES"])
    other = rf"(?i)(?<![\w.])(?!(?:{listed})\s*\()([A-Za-z_]\w*)\s*\(\s*[A-Za-z_]\w*(?:\.\w+)?\s*\)"
    rules.append(Rule("H22g", "info", "low", perf, F.concat(F.lit("condition on "), F.upper(T.rx(w, other, 1)), F.lit("() of a column, perhaps not on the column")),
                      F.regexp_replace(w, r"\(subq\)", "").rlike(other)))
    return rules


def _struct(rule_id: str, kind: str, severity, category: str, message: Column) -> Column:
    severity = severity if isinstance(severity, Column) else F.lit(severity).cast("string")
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("type"), severity.alias("severity"), F.lit(category).alias("category"), message.alias("message"))


def _as_structs(rule: Rule) -> Column:
    """Array of the rule's findings: none where it doesn't hold, one, or one per element of `each`."""
    start = rule.message if isinstance(rule.message, Column) else F.lit(rule.message)
    of = lambda message: _struct(rule.rule_id, rule.type, rule.severity, rule.category, message)
    found = F.array(of(start)) if rule.each is None else F.transform(rule.each, lambda x: of(F.concat(start, x)))
    return F.when(rule.when, found)


def apply_rules(frame: DataFrame, rules: list[Rule], more: list[Column] | None = None) -> DataFrame:
    """Long table of findings: one pass over the frame, then an explode of the rules that hold. `more` are arrays of findings."""
    hits = F.flatten(F.filter(F.array(*[_as_structs(r) for r in rules], *(more or [])), lambda h: h.isNotNull()))
    rows = frame.select("doc_id", "path", "stmt_idx", F.explode(hits).alias("h"))
    return rows.select("doc_id", "path", "stmt_idx", "h.rule_id", "h.type", "h.severity", "h.category", "h.message")


def _finding(rows: DataFrame, rule_id: str, type_, severity, category: str, message: Column) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select("doc_id", "path", "stmt_idx", F.lit(rule_id).alias("rule_id"), lit(type_).alias("type"), lit(severity).alias("severity"),
                       F.lit(category).alias("category"), message.alias("message"))


def repeated(values: Column) -> Column:
    """(value, n) of the values that stand in an array more than once: runs of the sorted array, counted inside the row."""
    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda v, i: F.when((i == 0) | (F.get(s, i - 1) != v), F.struct(v.alias("value"), i.alias("at")))), lambda x: x.isNotNull())
        ends = F.get(F.transform(F.array(first), lambda f: F.transform(f, lambda x, i: F.struct(x["value"].alias("value"), (F.coalesce(F.get(f, i + 1)["at"], F.size(s)) - x["at"]).alias("n")))), F.lit(0))
        return F.filter(ends, lambda x: x["n"] > 1)
    def of(v: Column) -> Column:
        return F.when(F.size(v) > 1, F.get(F.transform(F.array(F.array_sort(v)), runs), F.lit(0))).otherwise(F.array().cast("array<struct<value:string,n:int>>"))
    return F.get(F.transform(F.array(values), of), F.lit(0))


def with_groups(stmts: DataFrame) -> DataFrame:
    """The frame with `_shapes` (H8), `_copies` (H9), `_reads` (H11) and `_locals` (H16): what a statement repeats, counted in its own row.

    A subquery's shape is its table, WHERE presence and first aggregate; copies are equal normalised texts of over 15 characters.
    """
    found = F.transform(F.filter(R.with_delete_sources(R.ref_matches(F.col("masked"))), lambda m: m.rlike(r"(?i)^(?:FROM|JOIN)\b")), R.match_name)
    rows = T.hold(stmts, _subs=F.transform(I.subquery_texts(F.col("masked")), T.normalise_query), _read=F.filter(found, R.is_table_name), _own=R.local_names(F.col("masked")))
    shape = lambda n: F.concat_ws("|", T.rx(n, r"from\s+(\w+)", 1), n.contains("where").cast("string"), T.rx(n, r"(avg|count|sum|max|min)\s*\(", 1))
    return T.hold(rows, _shapes=repeated(F.filter(F.transform("_subs", shape), lambda s: ~s.startswith("|"))), _copies=repeated(F.filter("_subs", lambda n: F.length(n) > 15)),
                  _reads=repeated(F.filter("_read", lambda t: ~F.array_contains("_own", t))), _locals=repeated(F.filter("_read", lambda t: F.array_contains("_own", t)))).drop("_subs", "_read", "_own")


def _group_structs() -> list[Column]:
    return [F.transform("_shapes", lambda x: _struct("H8", "info", "low", "quality", F.format_string("%d subqueries of one shape", x["n"]))),
            F.when(F.size("_shapes") == 0, F.transform("_copies", lambda x: _struct("H9", "info", "low", "quality", F.format_string("the same subquery stands %d times", x["n"])))),
            F.transform("_reads", lambda x: _struct("H11", "warning", "medium", "performance", F.format_string("%s is read in %d places", x["value"], x["n"]))),
            F.transform("_locals", lambda x: _struct("H16", "warning", F.when(x["n"] > 2, "high").otherwise("medium"), "performance", F.format_string("local result %s is used %d times", x["value"], x["n"])))]


def grouped_findings(stmts: DataFrame) -> DataFrame:
    """H8, H9, H11, H16: rules that count within a statement."""
    return apply_rules(with_groups(stmts.select("doc_id", "path", "stmt_idx", "masked")), [], _group_structs())


def duplicate_subqueries(stmts: DataFrame) -> DataFrame:
    """H9: identical normalised subqueries longer than 15 characters."""
    rows = with_groups(stmts.select("doc_id", "path", "stmt_idx", "masked")).select("doc_id", "path", "stmt_idx", F.explode("_copies").alias("c"))
    return rows.select("doc_id", "path", "stmt_idx", F.col("c.value").alias("normalized"), F.col("c.n").cast("long").alias("n"))


def dead_columns(stmts: DataFrame) -> DataFrame:
    """H10: columns a CTE selects that neither its own clauses nor the later text of the statement use."""
    rows = T.hold(stmts.select("doc_id", "path", "stmt_idx", "masked"), _c=R.cte_structs(F.col("masked")))
    rows = rows.select("doc_id", "path", "stmt_idx", "masked", F.posexplode("_c").alias("_i", "c"))
    body = T.outer_text(F.col("c.body"))
    after = F.substring(F.col("masked"), F.expr("instr(masked, c.body)") + F.length("c.body"), F.length("masked"))
    rows = rows.select("doc_id", "path", "stmt_idx", F.col("c.name").alias("cte_name"), after.alias("_after"),
                       F.regexp_replace(body, r"(?i)^[\s\S]*?\bFROM\b", "").alias("_own"), F.explode(T.split_top_level(T.select_list(body))).alias("_item"))
    name = F.coalesce(T.rx_or_null(F.col("_item"), I._ALIAS_TAIL, 1), T.rx_or_null(F.col("_item"), r"^(?:\w+\.)?(\w+)$", 1))
    rows = rows.withColumn("column_name", F.lower(name)).filter("column_name is not null")
    used = F.transform(T.rx_all(F.concat(F.col("_own"), F.lit(" "), F.col("_after")), r"\b([A-Za-z_]\w*)\b", 1), F.lower)
    star = F.col("_after").rlike(r"(?i)\bselect\s+(?:distinct\s+)?(?:\w+\.)?\*")
    return rows.filter(~F.array_contains(used, F.col("column_name")) & ~star).select("doc_id", "path", "stmt_idx", "cte_name", "column_name")


def index_candidates(stmts: DataFrame) -> DataFrame:
    """H21: columns by purpose (filter, join, sort, group) per statement, from the row's own clauses."""
    stmts = T.hold(stmts.select("doc_id", "path", "stmt_idx", "clean", "masked"), _outer=I._main_query(F.col("masked")))
    o = F.col("_outer")
    texts = {"filter": T.clause(o, "where"), "join": F.array_join(T.join_conditions(o), " , "), "sort": T.clause(o, "order"), "group": T.clause(o, "group")}
    cols = F.array(*[F.struct(F.lit(k).alias("purpose"), F.array_distinct(F.transform(T.column_refs(v), F.lower)).alias("columns")) for k, v in texts.items()])
    rows = stmts.filter(S.statement_kind(F.col("clean")).isin("select", "cte")).select("doc_id", "path", "stmt_idx", F.explode(F.filter(cols, lambda c: F.size(c["columns"]) > 0)).alias("c"))
    return rows.select("doc_id", "path", "stmt_idx", "c.purpose", "c.columns")


def unknown_table_functions(stmts: DataFrame, registry: DataFrame, dialect: str = "mysql") -> DataFrame:
    """H30: sources in call form that the registry does not know."""
    return _finding(I.functions_used(stmts, registry, dialect).filter(F.col("is_source") & ~F.col("is_known")).dropDuplicates(["doc_id", "stmt_idx", "name"]),
                    "H30", "info", "low", "best-practice", F.concat(F.lit("not a known table function: "), F.col("name")))


# Dialect whose markers were met -> (markers, dialects where they are fine, type, severity, name shown).
FOREIGN_SYNTAX = [
    ("Snowflake", "snowflake_path_operator snowflake_named_args flatten", "Snowflake", "warning", "medium", "Snowflake-specific"),
    ("PostgreSQL", "postgres_interval postgres_dollar_quotes postgres_array_access postgres_json_operators", "PostgreSQL Snowflake", "warning", "medium", "PostgreSQL-specific"),
    ("MySQL", "mysql_backticks mysql_group_by_rollup mysql_dual", "MySQL MariaDB", "info", "low", "MySQL-specific"),
    ("Oracle", "oracle_connect_by oracle_rownum oracle_outer_join_operator oracle_nvl_decode", "Oracle", "warning", "medium", "Oracle-specific"),
    ("Teradata", "teradata_volatile_table teradata_primary_index teradata_hash_functions teradata_multiset_or_set_table", "Teradata", "warning", "medium", "Teradata-specific"),
]
MERGE_DIALECTS = "TransactSQL Oracle Snowflake BigQuery Teradata".split()  # fixed values


def with_dialect(frame: DataFrame) -> DataFrame:
    """The frame with a column per syntax marker and the dialect that they speak for."""
    marks = S.dialect_markers(frame, tuple(frame.columns))
    return S.detected_dialect(marks, tuple(marks.columns))


def dialect_rules(dialect: str = "MySQL") -> list[Rule]:
    """H31, H32, H36 over `with_dialect`."""
    any_of = lambda names: F.greatest(*[F.col(n).cast("int") for n in names.split()]) == 1 if len(names.split()) > 1 else F.col(names)
    rules = [Rule("H31", t, s, "best-practice", f"{shown} syntax detected", any_of(names)) for _, names, fine, t, s, shown in FOREIGN_SYNTAX if dialect not in fine.split()]
    unnest_free = dialect in ("BigQuery", "PostgreSQL", "Trino", "Athena")
    if dialect != "BigQuery":
        bq = F.col("bigquery_struct") | F.col("bigquery_array_type") | (F.lit(not unnest_free) & F.col("bigquery_unnest"))
        rules.append(Rule("H31", "warning", "medium", "best-practice", "BigQuery-specific syntax detected", bq))
    if dialect != "TransactSQL":
        ts = F.col("tsql_apply") | F.col("tsql_top") | (F.lit(dialect != "Oracle") & F.col("pivot"))
        rules.append(Rule("H31", "warning", "medium", "best-practice", "SQL Server (T-SQL) syntax detected", ts))
    ok = dialect in MERGE_DIALECTS
    rules.append(Rule("H32", "info" if ok else "warning", "low" if ok else "medium", "best-practice", "MERGE statement" if ok else "MERGE statement detected", F.col("merge_into")))
    declared = F.coalesce(S.declared_dialect(F.col("sql")), F.lit(dialect))
    rules.append(Rule("H36", "info", None, "best-practice", F.concat(F.lit("Detected dialect: "), F.col("dialect"), F.lit(", declared: "), declared), F.col("dialect").isNotNull() & (F.col("dialect") != declared)))
    return rules


def dialect_findings(stmts: DataFrame, dialect: str = "MySQL") -> DataFrame:
    """H31, H32, H36: syntax of another dialect, MERGE portability, declared against detected dialect."""
    return apply_rules(with_dialect(stmts.select("doc_id", "path", "stmt_idx", "sql")), dialect_rules(dialect))


def limit_findings(violations: DataFrame) -> DataFrame:
    """H34: texts over the size or statement limit. They are reported, and still analysed whole."""
    return violations.filter(F.col("error").isin("size_limit", "query_count_limit")).select(
        "doc_id", F.lit("H34").alias("rule_id"), F.lit("warning").alias("type"), F.lit("medium").alias("severity"),
        F.concat(F.lit("Input over limit: "), F.col("actual").cast("string"), F.lit(" "), F.col("unit")).alias("message"))


def findings(stmts: DataFrame, extra_rules: list[Rule] | None = None, dialect: str = "MySQL") -> DataFrame:
    """All findings of the text, counting and dialect rules, with the user's own rules on top: one pass over each text, nothing is shuffled."""
    frame = with_dialect(with_groups(features(stmts)))
    return apply_rules(frame, statement_rules() + dialect_rules(dialect) + list(extra_rules or []), _group_structs())
