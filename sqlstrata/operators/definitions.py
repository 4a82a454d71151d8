"""Definitions (tables, views), their columns, and other objects that DDL and bulk statements name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlstrata.functions import patterns as P, text as T

_CREATE = rf"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:TEMP|TEMPORARY|MATERIALIZED)\s+)?(TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?{T.TABLE_NAME}"
_INTO = rf"(?i)^\s*(?:WITH\b[\s\S]*?)?SELECT\b(?:(?!\bFROM\b)[\s\S])*?\b(INTO)\s+(?:TEMP(?:ORARY)?\s+)?(?:TABLE\s+)?{T.TABLE_NAME}"
_QUALIFIED = r"""["`\[]?\w[\w$]*["`\]]?(?:\.["`\[]?\w[\w$]*["`\]]?)*"""


def _definition_structs(masked: Column) -> Column:
    """Array of (def_type, schema_name, name, _match): what CREATE names, and the target of SELECT INTO."""
    def named(pattern: str) -> Column:
        return F.transform(T.rx_all(masked, pattern, 0), lambda m: F.struct(
            F.when(F.lower(T.rx(m, pattern, 1)) == "view", "view").otherwise("table").alias("def_type"),
            T.qualifier(T.rx(m, pattern, 2)).alias("schema_name"), T.rx(m, pattern, 3).alias("name"), m.alias("_match")))
    return F.filter(F.concat(named(_CREATE), named(_INTO)), lambda d: ~F.lower(d["name"]).isin(P.SCHEMA_RESERVED))


def definitions(stmts: DataFrame) -> DataFrame:
    """`(doc_id, path, stmt_idx, def_type, schema_name, name, table_key, line, is_ctas, columns)`, one row per definition."""
    rows = T.hold(stmts.select("doc_id", "path", "stmt_idx", "start_line", "sql", "masked"), _d=_definition_structs(F.col("masked")))
    rows = rows.select("doc_id", "path", "stmt_idx", "start_line", "sql", "masked", F.explode("_d").alias("d"))
    is_ctas = ((F.col("d.def_type") == "table") & (F.col("masked").rlike(r"(?i)(?<!\bALWAYS\s)\bAS\s+(?:SELECT|WITH|\()") | F.col("masked").rlike(_INTO)))
    body = F.when((F.col("d.def_type") == "table") & ~is_ctas,
                  T.rx(F.col("masked"), rf"{_CREATE}\s*\(({T.BALANCED})\)", 4)).otherwise(F.lit(""))
    at = F.expr("instr(lower(sql), lower(d._match))")
    rows = rows.select(
        "doc_id", "path", "stmt_idx", "d.def_type", "d.schema_name", "d.name",
        T.qualified_key(F.col("d.name"), F.col("d.schema_name")).alias("table_key"),
        (F.col("start_line") + T.line_at(F.col("sql"), at) - 1).alias("line"), is_ctas.alias("is_ctas"),
        body.alias("_body"))
    rows = T.hold(rows, _parts=T.split_top_level(F.col("_body")))
    rows = T.hold(rows, _keys=_table_keys(F.col("_parts")))
    return T.hold(rows, columns=_columns(F.col("_parts"), F.col("_keys"))).drop("_parts", "_keys", "_body")


# The parts of a table body are read by position: a name, a type with its parenthesis, and the words of the rest.
_TOKEN = rf"\({T.BALANCED}\)|[^\s(),]+"
_NO_COLUMN = ["PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT"]


def _plain(token: Column) -> Column:
    return F.regexp_replace(token, T.QUOTES, "")


def _listed(token: Column) -> Column:
    """Names inside a parenthesis."""
    return F.split(F.regexp_replace(token, r"""[\s()"'`\[\]]""", ""), ",")


def _reference(tokens: Column) -> Column:
    """(own, ref_table, ref_columns) around the word REFERENCES; null without it. `own` is what stands before it."""
    at = F.array_position(F.transform(tokens, F.upper), F.lit("REFERENCES")).cast("int")
    return F.when(at > 0, F.struct(F.get(tokens, at - 2).alias("own"), _plain(F.get(tokens, at)).alias("ref_table"), _listed(F.get(tokens, at + 1)).alias("ref_columns")))


def _table_keys(parts: Column) -> Column:
    """(key, value) of the columns that FOREIGN KEY parts declare, in order."""
    tokens = F.filter(F.transform(parts, lambda p: T.rx_all(p, _TOKEN)), lambda t: F.upper(F.get(t, F.lit(0))).isin("FOREIGN", "CONSTRAINT"))
    found = F.filter(F.transform(tokens, _reference), lambda r: r.isNotNull())
    return F.flatten(F.transform(found, lambda r: F.transform(_listed(r["own"]), lambda c, i: F.struct(F.lower(c).alias("key"), F.struct(
        r["ref_table"].alias("ref_table"), F.coalesce(F.get(r["ref_columns"], i), F.get(r["ref_columns"], F.lit(0))).alias("ref_column")).alias("value")))))


def _columns(parts: Column, table_keys: Column) -> Column:
    def column(t: Column) -> Column:
        sized = F.coalesce(F.get(t, F.lit(2)), F.lit("")).startswith("(")
        rest = F.upper(F.concat(F.lit(" "), F.array_join(F.slice(t, F.when(sized, 4).otherwise(3), F.size(t)), " "), F.lit(" ")))
        has = lambda words: rest.contains(f" {words} ")
        own = _reference(t)
        inline = F.when(own.isNotNull(), F.struct(own["ref_table"].alias("ref_table"), F.get(own["ref_columns"], F.lit(0)).alias("ref_column")))
        declared = F.get(F.filter(table_keys, lambda k: k["key"] == F.lower(_plain(F.get(t, F.lit(0))))), F.lit(0))["value"]
        kind = F.upper(F.concat(F.get(t, F.lit(1)), F.when(sized, F.regexp_replace(F.get(t, F.lit(2)), r"\s+", "")).otherwise("")))
        return F.struct(_plain(F.get(t, F.lit(0))).alias("name"), kind.alias("data_type"), (~has("NOT NULL") & ~has("PRIMARY KEY")).alias("nullable"), has("PRIMARY KEY").alias("primary_key"),
                        has("GENERATED ALWAYS").alias("is_computed"), F.coalesce(inline, declared).alias("foreign_key"))
    tokens = F.transform(parts, lambda p: T.rx_all(p, _TOKEN))
    return F.transform(F.filter(tokens, lambda t: (F.size(t) > 1) & ~F.upper(F.get(t, F.lit(0))).isin(_NO_COLUMN)), column)


def def_columns(defs: DataFrame) -> DataFrame:
    """One row per column of a definition."""
    rows = defs.select("doc_id", "path", "stmt_idx", "def_type", "table_key", F.posexplode("columns").alias("position", "c"))
    return rows.select("doc_id", "path", "stmt_idx", "def_type", "table_key", "position", F.col("c.name").alias("column_name"), "c.data_type", "c.nullable",
                       "c.primary_key", F.col("c.foreign_key.ref_table").alias("ref_table"), F.col("c.foreign_key.ref_column").alias("ref_column"))


def ddl_references(stmts: DataFrame) -> DataFrame:
    """Tables that DDL names after REFERENCES."""
    found = T.rx_all(F.col("masked"), rf"(?i)REFERENCES\s+((?:\w+\.)?\w+)", 1)
    return stmts.select("doc_id", "stmt_idx", F.explode(found).alias("ref_table")).select(
        "doc_id", "stmt_idx", F.lower("ref_table").alias("ref_table"))


# --- DML forms -------------------------------------------------------------------------------------------------

def merges(stmts: DataFrame) -> DataFrame:
    """Parts of MERGE: target, source, ON text, WHEN actions, columns set and inserted."""
    m = F.col("masked")
    found = stmts.filter(m.rlike(r"(?i)^\s*MERGE\b"))
    matched = F.transform(T.rx_all(m, r"(?i)WHEN\s+MATCHED\s+(?:AND\s+(?:(?!\bTHEN\b)[\s\S])+)?THEN\s+(\w+)", 1), lambda a: F.concat(F.lit("MATCHED "), F.upper(a)))
    missing = F.transform(T.rx_all(m, r"(?i)WHEN\s+NOT\s+MATCHED\s+(?:BY\s+\w+\s+)?(?:AND\s+(?:(?!\bTHEN\b)[\s\S])+)?THEN\s+(\w+)", 1),
                          lambda a: F.concat(F.lit("NOT MATCHED "), F.upper(a)))
    assigned = T.split_top_level(T.rx(m, r"(?i)UPDATE\s+SET\s+((?:(?!\bWHEN\b|\bINSERT\b)[\s\S])+)", 1))
    return found.select(
        "doc_id", "stmt_idx", F.lower(T.rx(m, rf"(?i)MERGE\s+INTO\s+({_QUALIFIED})", 1)).alias("target"),
        F.lower(T.rx(m, rf"(?i)\bUSING\s+({_QUALIFIED})", 1)).alias("source"),
        F.trim(F.regexp_replace(T.rx(m, r"(?i)\bON\s+((?:(?!\bWHEN\b)[\s\S])+)", 1), r"\s+", " ")).alias("on_condition"),
        F.concat(matched, missing).alias("actions"),
        F.transform(assigned, lambda a: T.rx(a, r"(?:\w+\.)?(\w+)\s*=", 1)).alias("set_columns"),
        T.split_top_level(T.rx(m, r"(?i)\bINSERT\s*\(([^)]+)\)", 1)).alias("insert_columns"))


def upserts(stmts: DataFrame) -> DataFrame:
    """INSERT with a conflict clause and REPLACE, with the form and the target."""
    m = F.col("masked")
    form = (F.when(m.rlike(r"(?i)\bON\s+CONFLICT\b"), "ON CONFLICT").when(m.rlike(r"(?i)\bON\s+DUPLICATE\s+KEY\b"), "ON DUPLICATE KEY")
            .when(m.rlike(r"(?i)^\s*INSERT\s+OR\s+\w+"), F.upper(F.concat(F.lit("INSERT OR "), T.rx(m, r"(?i)^\s*INSERT\s+OR\s+(\w+)", 1))))
            .when(m.rlike(r"(?i)^\s*REPLACE\s+(?:INTO\s+)?\w"), "REPLACE"))
    action = F.when(m.rlike(r"(?i)\bDO\s+NOTHING\b"), "NOTHING").otherwise("UPDATE")
    return stmts.filter(m.rlike(r"(?i)^\s*(?:INSERT|REPLACE)\b")).select(
        "doc_id", "stmt_idx", form.alias("form"), action.alias("action"),
        F.lower(T.rx(m, rf"(?i)\b(?:INTO|REPLACE)\s+({_QUALIFIED})", 1)).alias("target")).filter("form is not null")


def delete_forms(stmts: DataFrame) -> DataFrame:
    """DELETE: target, USING or JOIN sources, OUTPUT target."""
    m = F.col("masked")
    return stmts.filter(m.rlike(r"(?i)^\s*DELETE\b")).select(
        "doc_id", "stmt_idx", F.lower(T.rx(m, rf"(?i)^\s*DELETE\s+FROM\s+({_QUALIFIED})", 1)).alias("target"),
        F.transform(F.concat(T.rx_all(m, rf"(?i)\bUSING\s+({_QUALIFIED})", 1), T.rx_all(T.outer_text(m), rf"(?i)\bJOIN\s+({_QUALIFIED})", 1)), F.lower).alias("sources"),
        F.lower(T.rx_or_null(m, rf"(?i)\bOUTPUT\b[\s\S]*?\bINTO\s+({_QUALIFIED})", 1)).alias("output_into"),
        T.outer_text(m).rlike(r"(?i)\bWHERE\b").alias("has_where"))


def update_forms(stmts: DataFrame) -> DataFrame:
    """UPDATE: the target with an alias resolved to its table, the FROM and JOIN sources, the columns set."""
    m, outer = F.col("masked"), T.outer_text(F.col("masked"))
    target = F.lower(T.rx(m, rf"(?i)^\s*UPDATE\s+({_QUALIFIED})", 1))
    pairs = rf"(?i)\b(?:FROM|JOIN)\s+({_QUALIFIED})\s+(?:AS\s+)?(?!(?:{'|'.join(P.NOT_AN_ALIAS)})\b)(\w+)"
    names, aliases = T.rx_all(outer, pairs, 1), F.transform(T.rx_all(outer, pairs, 2), F.lower)
    resolved = F.lower(F.get(names, (F.array_position(aliases, target) - 1).cast("int")))
    set_list = T.split_top_level(T.rx(outer, r"(?i)\bSET\s+((?:(?!\b(?:FROM|WHERE|OUTPUT|RETURNING)\b)[\s\S])+)", 1))
    return stmts.filter(m.rlike(r"(?i)^\s*UPDATE\b")).select(
        "doc_id", "stmt_idx", F.coalesce(F.when(F.array_position(aliases, target) > 0, resolved), target).alias("target"),
        F.transform(T.rx_all(outer, rf"(?i)\b(?:FROM|JOIN)\s+({_QUALIFIED})", 1), F.lower).alias("sources"),
        F.transform(set_list, lambda a: T.rx(a, r"(?:\w+\.)?(\w+)\s*=", 1)).alias("set_columns"),
        outer.rlike(r"(?i)\bWHERE\b").alias("has_where"))


def insert_branches(stmts: DataFrame) -> DataFrame:
    """Branches of INSERT ALL / FIRST: position, condition (ELSE, or null when unconditional) and target."""
    m = F.col("masked")
    branch = rf"(?i)(?:\bWHEN\s+((?:(?!\bTHEN\b)[\s\S])+?)\s+THEN\s+|\b(ELSE)\s+)?INTO\s+({_QUALIFIED})"
    found = stmts.filter(m.rlike(r"(?i)^\s*INSERT\s+(?:ALL|FIRST)\b")).select(
        "doc_id", "stmt_idx", F.posexplode(T.rx_all(m, branch, 0)).alias("branch", "b"))
    return found.select("doc_id", "stmt_idx", "branch",
                        F.coalesce(T.rx_or_null(F.col("b"), branch, 1), F.upper(T.rx_or_null(F.col("b"), branch, 2))).alias("condition"),
                        F.lower(T.rx(F.col("b"), branch, 3)).alias("target"))


_LOCATION = r"('[^']*'|\"[^\"]*\"|@\S+|\w+://\S+|STDIN\b|STDOUT\b|PROGRAM\b\s*'[^']*')"


def bulk_edges(stmts: DataFrame) -> DataFrame:
    """Bulk load and unload: `(operation, endpoint, table_name, direction)`; direction is seen from the table."""
    c = F.col("clean")
    forms = [
        ("COPY INTO", rf"(?i)^\s*COPY\s+INTO\s+(?!@|')({_QUALIFIED})(?:\s*\([^)]*\))?\s+FROM\s+{_LOCATION}", 2, 1, "import"),
        ("COPY INTO", rf"(?i)^\s*COPY\s+INTO\s+{_LOCATION}\s+FROM\s+({_QUALIFIED})", 1, 2, "export"),
        ("COPY FROM", rf"(?i)^\s*COPY\s+({_QUALIFIED})(?:\s*\([^)]*\))?\s+FROM\s+{_LOCATION}", 2, 1, "import"),
        ("COPY TO", rf"(?i)^\s*COPY\s+({_QUALIFIED})(?:\s*\([^)]*\))?\s+TO\s+{_LOCATION}", 2, 1, "export"),
        ("UNLOAD", rf"(?i)^\s*UNLOAD\s*\(\s*'[\s\S]*?\bFROM\s+({_QUALIFIED})[\s\S]*?'\s*\)\s*TO\s+{_LOCATION}", 2, 1, "export"),
        ("EXPORT DATA", rf"(?i)^\s*EXPORT\s+DATA\s+OPTIONS\s*\([\s\S]*?uri\s*=\s*{_LOCATION}[\s\S]*?\)\s*AS\s+SELECT\b[\s\S]*?\bFROM\s+({_QUALIFIED})", 1, 2, "export"),
        ("LOAD DATA", rf"(?i)^\s*LOAD\s+DATA\s+(?:LOCAL\s+)?(?:INPATH|INFILE)\s+{_LOCATION}[\s\S]*?\bINTO\s+TABLE\s+({_QUALIFIED})", 1, 2, "import"),
        ("INSERT OVERWRITE", rf"(?i)^\s*INSERT\s+OVERWRITE\s+(?:LOCAL\s+)?(?:DIRECTORY\s+{_LOCATION}|TABLE\s+({_QUALIFIED}))", 1, 2, "overwrite"),
    ]
    op, endpoint, table, direction = F.lit(None), F.lit(None), F.lit(None), F.lit(None)
    for name, pattern, at_endpoint, at_table, way in reversed(forms):
        hit = c.rlike(pattern)
        op, direction = F.when(hit, F.lit(name)).otherwise(op), F.when(hit, F.lit(way)).otherwise(direction)
        endpoint = F.when(hit, F.regexp_replace(T.rx(c, pattern, at_endpoint), r"^['\"]|['\"]$", "")).otherwise(endpoint)
        table = F.when(hit, F.lower(T.rx(c, pattern, at_table))).otherwise(table)
    possible = c.rlike(r"(?i)^\s*(?:COPY|UNLOAD|EXPORT|LOAD|INSERT\s+OVERWRITE)\b")
    return stmts.filter(possible).select("doc_id", "stmt_idx", op.alias("operation"), F.nullif(endpoint, F.lit("")).alias("endpoint"),
                                         F.nullif(table, F.lit("")).alias("table_name"), direction.alias("direction")).filter("operation is not null")


def warehouse_objects(stmts: DataFrame) -> DataFrame:
    """Warehouse DDL: `(kind, name, source, location)` of external tables, stages, streams, tasks, pipes; dist / sort keys."""
    c = F.col("clean")
    head = r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(EXTERNAL\s+TABLE|STAGE|STREAM|TASK|PIPE|(?:TEMP(?:ORARY)?\s+)?TABLE)\s+(?:IF\s+NOT\s+EXISTS\s+)?"
    kind = F.upper(F.regexp_replace(T.rx(c, head, 1), r"\s+", " "))
    source = T.rx_or_null(c, rf"(?i)\bON\s+(?:TABLE|VIEW|EXTERNAL\s+TABLE|STAGE)\s+({_QUALIFIED})", 1)
    location = T.rx_or_null(c, r"(?i)\b(?:LOCATION|URL)\s*=?\s*'([^']*)'", 1)
    keys = T.rx_or_null(c, r"(?i)\b(?:DISTKEY|SORTKEY)\s*\(([^)]*)\)", 1)
    return stmts.filter(c.rlike(head)).select(
        "doc_id", "stmt_idx", kind.alias("kind"), F.lower(T.rx(c, rf"{head}({_QUALIFIED})", 2)).alias("name"),
        F.lower(source).alias("source"), location.alias("location"), keys.alias("key_columns")
    ).filter("kind not like '%TABLE' or kind = 'EXTERNAL TABLE' or key_columns is not null")


def grouping_set_columns(stmts: DataFrame) -> DataFrame:
    """Union of the columns that GROUPING SETS lists, in order of first appearance."""
    m = F.col("masked")
    body = T.rx(m, rf"(?i)\bGROUPING\s+SETS\s*\(({T.BALANCED})\)", 1)
    sets = T.split_top_level(body)
    cols = F.flatten(F.transform(sets, lambda s: T.split_top_level(F.regexp_replace(s, r"^\(|\)$", ""))))
    return stmts.filter(m.rlike(r"(?i)\bGROUPING\s+SETS\s*\(")).select("doc_id", "stmt_idx", F.array_distinct(cols).alias("columns"))
