"""Table references and CTEs of statements. Row-local extraction; one `explode` per statement, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlstrata.functions import patterns as P, text as T

_NAME = T.TABLE_NAME
_ALIAS = rf"(?:\s+(?:AS\s+)?(?!(?:{'|'.join(P.NOT_AN_ALIAS)})\b)(\w+))?"
# One pass over the text finds every keyword; the keyword decides the reference type.
_ONE_REF = r"(INSERT\s+INTO|DELETE\s+FROM|UPDATE|FROM|JOIN)"
_ONE_REF_EXTENDED = r"(INSERT\s+INTO|INSERT\s+OVERWRITE\s+TABLE|DELETE\s+FROM|MERGE\s+INTO|UPDATE|FROM|JOIN|USING|INTO)"


def without_function_from(clean: Column) -> Column:
    """Arguments of EXTRACT, SUBSTRING, TRIM and POSITION removed: their FROM names no table."""
    gone = F.regexp_replace(clean, r"(?i)\b(extract|substring|trim|position)(\s*\()[^()]*(?:\([^()]*\)[^()]*)*\)", "$1$2)")
    return F.when(clean.contains("("), gone).otherwise(clean)


def is_table_name(name: Column) -> Column:
    """Not reserved, longer than one character, not a number."""
    return ~F.lower(name).isin(P.REFERENCE_RESERVED) & (F.length(name) >= 2) & ~name.rlike(r"^\d+$")


def _ref_type(context: Column) -> Column:
    return (F.when(context == "FROM", "select").when(context == "JOIN", "join").when(context.startswith("INSERT"), "insert")
            .when(context == "UPDATE", "update").when(context == "DELETE FROM", "delete")
            .when(context == "MERGE INTO", "merge").when(context == "USING", "select").when(context == "INTO", "insert"))


_PARSE = rf"(?is)^{_ONE_REF_EXTENDED}\s+{_NAME}(?:\s.*)?$"


_ELEMENT = rf"(?:\({T.BALANCED}\)|{_NAME.replace('((?:(?:', '(?:(?:(?:', 1).replace('((?<=', '(?:(?<=', 1)}){_ALIAS.replace('(\\w+)', '\\w+')}"
_LIST = rf"(?i)\b(?:FROM|USING)\s+{_ELEMENT}(?:\s*,\s*(?:LATERAL\s+)?{_ELEMENT}(?![\w$(]|\s*\())+"


def _listed(text: Column) -> Column:
    """Tables behind the first one of a comma list, as the texts `FROM table [alias]`."""
    tails = F.transform(T.rx_all(text, _LIST, 0), lambda l: F.slice(T.split_top_level(l), 2, F.length(l)))
    return F.transform(F.filter(F.flatten(tails), lambda e: ~e.rlike(r"(?i)^(?:LATERAL\b|\()")), lambda e: F.concat(F.lit("FROM "), e))


def ref_matches(clean: Column, extended: bool = False) -> Column:
    """Array of the texts `KEYWORD [schema.]table [alias]` of a statement, in order of appearance, then those behind a comma as `FROM table [alias]`.

    USING names sources where the statement is a DELETE (with `extended`, in any).
    """
    one = rf"(?i)\b{_ONE_REF_EXTENDED if extended else _ONE_REF}\s+{_NAME}{_ALIAS}"

    def found(text: Column) -> Column:
        plain = T.rx_all(text, one, 0)
        if not extended:
            plain = F.when(text.rlike(r"(?i)^\s*DELETE\b"), T.rx_all(text, one.replace("|JOIN)", "|JOIN|USING)"), 0)).otherwise(plain)
        return F.when(text.contains(","), F.concat(plain, _listed(text))).otherwise(plain)
    return F.get(F.transform(F.array(without_function_from(clean)), found), F.lit(0))


def with_delete_sources(matches: Column) -> Column:
    """DELETE FROM names its table twice, as target and as FROM source, because both forms match it."""
    deletes = F.filter(matches, lambda m: m.rlike(r"(?i)^DELETE\b"))
    return F.concat(matches, F.transform(deletes, lambda m: F.regexp_replace(m, r"(?i)^DELETE\s+", "")))


def match_key(match: Column) -> Column:
    """`schema.table` of a match, lower case, without quotes."""
    return F.lower(F.regexp_replace(F.regexp_replace(match, _PARSE, "$2$3"), T.QUOTES, ""))


def match_name(match: Column) -> Column:
    return F.lower(F.regexp_replace(match, _PARSE, "$3"))


def keys_of(matches: Column, keyword: str) -> Column:
    """Table keys of the matches that start with the keyword pattern, reserved words left out."""
    kept = F.filter(matches, lambda m: m.rlike(rf"(?i)^(?:{keyword})\b"))
    return F.filter(F.transform(kept, match_key), lambda k: is_table_name(T.key_name(k)))


READ, WRITE = "FROM|JOIN|USING", "INSERT|UPDATE|DELETE|MERGE|INTO"


def names_used(clean: Column, extended: bool = True) -> Column:
    """Lower-case table names of a statement, one per reference."""
    return F.filter(F.transform(with_delete_sources(ref_matches(clean, extended)), match_name), is_table_name)


def _identity(match: Column) -> Column:
    """What two references must share to count as one: table and type."""
    word = F.lower(F.regexp_replace(match, _PARSE, "$1 "))
    kind = F.regexp_replace(F.regexp_replace(word, r"^(?:insert\s|into).*", "insert "), r"^using.*", "from ")
    return F.concat(kind, match_key(match))


def _explode_matches(stmts: DataFrame, extended: bool, dedupe: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = T.hold(stmts.select("doc_id", "path", "stmt_idx", "start_line", "sql", "masked", *keep), _found=ref_matches(F.col("masked"), extended))
    rows = T.hold(rows, _found=with_delete_sources(F.col("_found")))
    if dedupe:
        # Sorted by identity and place, the first of each run is the one to keep: no shuffle, no comparison of all pairs. A single one needs no identity.
        placed = lambda key: F.transform("_found", lambda m, i: F.struct(key(m).alias("k"), i.alias("i"), m.alias("m")))
        rows = T.hold(rows, _found=F.when(F.size("_found") < 2, placed(lambda m: F.lit(""))).otherwise(F.array_sort(placed(_identity))))
        firsts = F.filter("_found", lambda s, i: (i == 0) | (F.get("_found", i - 1)["k"] != s["k"]))
        rows = rows.select("doc_id", "path", "stmt_idx", "start_line", "sql", *keep, F.explode(firsts).alias("_s")).withColumn("_m", F.col("_s.m")).drop("_s")
    else:
        rows = rows.select("doc_id", "path", "stmt_idx", "start_line", "sql", *keep, F.explode("_found").alias("_m"))
    m = F.col("_m")
    # The four parts by one match, between marks that only the qualifier, which comes last, may hold.
    parts = F.split(F.regexp_replace(m, rf"(?i)^{_ONE_REF_EXTENDED}\s+{_NAME}{_ALIAS}[\s\S]*$", '$1"$3"$4"$2'), '"', 4)
    rows = T.hold(rows, _p=parts)
    part = lambda i: F.get("_p", F.lit(i))
    rows = rows.select("doc_id", "path", "stmt_idx", "start_line", "sql", *keep, "_m", F.upper(F.regexp_replace(part(0), r"\s+", " ")).alias("context"),
                       F.when(part(3) != "", T.qualifier(part(3))).alias("schema_name"), part(1).alias("table_name"), F.nullif(part(2), F.lit("")).alias("alias"))
    return rows.filter(is_table_name(F.col("table_name")))


def _finish(rows: DataFrame) -> DataFrame:
    position = F.expr("coalesce(nullif(instr(lower(sql), lower(_m)), 0), instr(lower(sql), lower(substring(_m, 6))))")  # behind a comma the text lacks its FROM
    kind = _ref_type(F.col("context"))
    return rows.select(
        "doc_id", "path", "stmt_idx", "schema_name", "table_name", T.qualified_key(F.col("table_name"), F.col("schema_name")).alias("table_key"),
        "alias", kind.alias("ref_type"), "context", F.when(kind.isin("select", "join"), "read").otherwise("write").alias("access_mode"),
        (F.col("start_line") + F.when(F.col("sql").contains("\n"), T.line_at(F.col("sql"), position) - 1).otherwise(0)).alias("line"))


def table_refs(stmts: DataFrame, extended: bool = False, dedupe: bool = True) -> DataFrame:
    """`(doc_id, path, stmt_idx, schema_name, table_name, table_key, alias, ref_type, context, access_mode, line)`.

    `extended` adds INTO, INSERT OVERWRITE, MERGE INTO and USING. `dedupe` keeps one row per (schema, table, type) of a statement.
    """
    return _finish(_explode_matches(stmts, extended, dedupe))


# --- CTEs ------------------------------------------------------------------------------------------------------

_CTE = rf"(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)(\w+)(?:\s*\([^()]*\))?\s+AS\s*\(({T.BALANCED})\)"

_CTE_ANCHORED = _CTE.replace("(?i)(?:\\bWITH", "(?i)^(?:WITH")


def cte_structs(masked: Column) -> Column:
    """Array of (name, body) of a statement's CTEs."""
    head = r"(?i)^(?:WITH\s+(?:RECURSIVE\s+)?|,\s*)(\w+)[\s\S]*$"
    found = F.when(masked.rlike(r"(?i)\bWITH\b"), T.rx_all(masked, _CTE, 0)).otherwise(F.array().cast("array<string>"))
    both = F.transform(found, lambda c: F.struct(F.lower(T.rx(c, head, 1)).alias("name"), T.rx(c, _CTE_ANCHORED, 2).alias("body")))
    return F.filter(both, lambda c: ~c["name"].isin(P.CTE_RESERVED))


def subquery_aliases(masked: Column) -> Column:
    """Names given to parenthesised queries in FROM or JOIN."""
    found = F.when(masked.contains("("), T.rx_all(masked, rf"(?i)\b(?:FROM|JOIN)\s*\({T.BALANCED}\)\s+(?:AS\s+)?(\w+)", 1)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(found, F.lower), lambda a: ~a.isin(P.CTE_RESERVED))


def ctes(stmts: DataFrame) -> DataFrame:
    """`(doc_id, path, stmt_idx, position, cte_name, is_recursive, body, line)`."""
    rows = T.hold(stmts.select("doc_id", "path", "stmt_idx", "start_line", "masked"), _c=cte_structs(F.col("masked")))
    rows = rows.select("doc_id", "path", "stmt_idx", "start_line", "masked", F.posexplode("_c").alias("position", "c"))
    at = F.expr("instr(lower(masked), concat(c.name, ' '))")
    return rows.select("doc_id", "path", "stmt_idx", "position", F.col("c.name").alias("cte_name"),
                       F.col("masked").rlike(r"(?i)\bWITH\s+RECURSIVE\b").alias("is_recursive"), F.col("c.body").alias("body"),
                       (F.col("start_line") + T.line_at(F.col("masked"), at) - 1).alias("line"))


def local_names(masked: Column) -> Column:
    """Names that exist only inside a statement: CTEs and subquery aliases."""
    return F.array_distinct(F.concat(F.transform(cte_structs(masked), lambda c: c["name"]), subquery_aliases(masked)))


def drop_local_refs(refs: DataFrame, stmts: DataFrame) -> DataFrame:
    """References without those that use a CTE or subquery alias of the same statement."""
    local = stmts.select("doc_id", "stmt_idx", F.explode(local_names(F.col("masked"))).alias("_local")).distinct()
    cond = ((refs.doc_id == local.doc_id) & (refs.stmt_idx == local.stmt_idx) & refs.schema_name.isNull()
            & (F.lower(refs.table_name) == local["_local"]))
    return refs.join(local, cond, "left_anti")


def base_table_refs(stmts: DataFrame, extended: bool = False, dedupe: bool = True) -> DataFrame:
    """`table_refs` without CTE and alias uses, decided inside each row: the join-free form of `drop_local_refs`."""
    rows = _explode_matches(T.hold(stmts, _local=local_names(F.col("masked"))), extended, dedupe, ("_local",))
    return _finish(rows.filter(F.col("schema_name").isNotNull() | ~F.array_contains("_local", F.lower("table_name"))))
