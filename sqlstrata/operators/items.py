"""What a statement selects, filters and calls: select items, predicates, functions, windows, aggregates, CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlstrata.functions import patterns as P, registry as R, text as T
from sqlstrata.operators import refs as refs_

_ALIAS_TAIL = r"(?i)\s+AS\s+[\"`]?(\w+)[\"`]?\s*$"


def item_kind(expr: Column) -> Column:
    """Transformation kind of a select expression (without its alias)."""
    call = rf"^\w+(?:\.\w+)?\s*\({T.BALANCED}\)$"
    outside = F.regexp_replace(expr, rf"\({T.BALANCED}\)", "()")
    return (F.when(expr.rlike(r"(?i)^(?:'[^']*'|[-+]?\d+(?:\.\d+)?|NULL|TRUE|FALSE)$"), "literal")
            .when(expr.rlike(r"(?i)^\(subq\)$"), "subquery")
            .when(outside.rlike(r"(?i)\bOVER\s*(?:\(|\w)"), "window")
            .when(outside.rlike(r"(?i)^CASE\b"), "case")
            .when(expr.rlike(rf"(?i)^(?:TRY_)?CAST\s*\({T.BALANCED}\)$") | outside.rlike(r"^[\w.]+\s*::\s*\w+"), "cast")
            .when(outside.contains("||"), "concat")
            .when(outside.rlike(r"(?i)[=<>!]|\b(?:AND|OR|NOT|LIKE|IN|BETWEEN|IS)\b"), "complex")
            .when(outside.rlike(r"\S\s*[-+*/%]\s*\S"), "arithmetic")
            .when(expr.rlike(rf"(?i)^(?:{'|'.join(R.AGGREGATE_PATTERN_NAMES)})\s*\({T.BALANCED}\)$"), "aggregate")
            .when(expr.rlike(call), "scalar")
            .when(expr.rlike(r"^[\w\"`]+(?:\.[\w\"`]+)*$") | expr.rlike(r"^(?:\w+\.)?\*$"), "direct")
            .otherwise("complex"))


# Transformation kind -> column edge kind.
EDGE_KIND = {"direct": "direct", "alias": "rename", "aggregate": "aggregate", "arithmetic": "expression", "concat": "expression",
             "scalar": "expression", "case": "case", "cast": "cast", "window": "expression", "subquery": "expression",
             "literal": "unknown", "complex": "unknown"}
# Column edge kind -> lineage edge type; the rest is "transform".
EDGE_TYPE = {"direct": "direct", "rename": "direct", "aggregate": "aggregate", "join": "join", "filter": "filter"}


def map_values(col: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


def edge_kind(kind: Column) -> Column:
    return map_values(kind, EDGE_KIND, "unknown")


def edge_type(kind: Column) -> Column:
    return map_values(kind, EDGE_TYPE, "transform")


def _main_query(masked: Column) -> Column:
    """The statement as its outermost SELECT sees it: leading CTEs removed, inner queries as `(subq)`."""
    return T.outer_text(F.regexp_replace(masked, rf"(?i)^\s*WITH\s+(?:RECURSIVE\s+)?(?:\w+(?:\s*\([^()]*\))?\s+AS\s*\({T.BALANCED}\)\s*,?\s*)+", ""))


def select_items(stmts: DataFrame) -> DataFrame:
    """`(position, expr, alias, output_name, kind, source_alias, source_column, source_table)`; tables via the alias map of the row.

    `kind` is "alias" for a plain column under another name.
    """
    base = T.hold(stmts.select("doc_id", "path", "stmt_idx", "masked"), _outer=_main_query(F.col("masked")))
    base = T.hold(base, _items=T.split_top_level(T.select_list(F.col("_outer"))), _tables=alias_pairs(F.col("_outer")))
    rows = base.select("doc_id", "path", "stmt_idx", "_tables", F.posexplode("_items").alias("position", "_item"))
    alias = T.rx_or_null(F.col("_item"), _ALIAS_TAIL, 1)
    expr = F.trim(F.regexp_replace("_item", _ALIAS_TAIL, ""))
    rows = rows.select("doc_id", "path", "stmt_idx", "position", "_tables", expr.alias("expr"), alias.alias("alias"))
    column = T.rx_or_null(F.col("expr"), r"(\w+|\*)$", 1)
    rows = T.hold(rows, _kind=item_kind(F.col("expr")), source_alias=F.lower(T.rx_or_null(F.col("expr"), r"^(\w+)\.(?:\w+|\*)$", 1)), _column=column)
    plain = F.col("_kind") == "direct"
    renamed = plain & F.col("alias").isNotNull() & (F.lower("alias") != F.lower("_column"))
    table = F.when(plain, resolve_alias(F.col("_tables"), F.col("source_alias")))
    return rows.select(
        "doc_id", "path", "stmt_idx", "position", "expr", "alias",
        F.coalesce("alias", F.when(plain, F.col("_column")), F.col("expr")).alias("output_name"),
        F.when(renamed, "alias").otherwise(F.col("_kind")).alias("kind"), "source_alias",
        F.when(plain, F.col("_column")).alias("source_column"), table.alias("source_table"), "_tables")


def alias_pairs(outer: Column) -> Column:
    """Array of (alias, table_key) of the FROM and JOIN tables in an outer text."""
    found = F.filter(refs_.ref_matches(outer), lambda m: m.rlike(r"(?i)^(?:FROM|JOIN)\b"))
    whole = rf"(?i)^{refs_._ONE_REF_EXTENDED}\s+{refs_._NAME}{refs_._ALIAS}"
    pairs = F.transform(found, lambda m: F.struct(
        F.lower(F.coalesce(T.rx_or_null(m, whole, 4), T.rx(m, whole, 3))).alias("alias"), refs_.match_key(m).alias("table_key")))
    return F.filter(pairs, lambda p: refs_.is_table_name(T.key_name(p["table_key"])))


def resolve_alias(pairs: Column, alias: Column) -> Column:
    """Table of an alias; without an alias, the only table there is."""
    named = F.get(F.filter(pairs, lambda p: p["alias"] == alias), F.lit(0))["table_key"]
    return F.when(alias.isNotNull(), named).otherwise(F.when(F.size(pairs) == 1, F.get(pairs, F.lit(0))["table_key"]))


def item_inputs(items: DataFrame) -> DataFrame:
    """One row per (select item, input column), with the input's table."""
    rows = items.select("doc_id", "path", "stmt_idx", "position", "output_name", "kind", "expr", "_tables",
                        F.explode(F.array_distinct(T.column_refs(F.col("expr")))).alias("_ref"))
    alias = F.when(F.col("_ref").contains("."), F.lower(F.substring_index("_ref", ".", 1)))
    return rows.select("doc_id", "path", "stmt_idx", "position", "output_name", "kind", "expr",
                       F.substring_index("_ref", ".", -1).alias("input_column"), resolve_alias(F.col("_tables"), alias).alias("input_table"))


def column_uses(stmts: DataFrame) -> DataFrame:
    """`(column_ref, used_in)`: columns by clause (select, where, join, group, having, order, set, insert, partition, function)."""
    stmts = T.hold(stmts.select("doc_id", "path", "stmt_idx", "masked"), _outer=_main_query(F.col("masked")))
    outer, masked = F.col("_outer"), F.col("masked")
    texts = {
        "select": T.select_list(outer), "where": T.clause(outer, "where"), "group": T.clause(outer, "group"),
        "having": T.clause(outer, "having"), "order": T.clause(outer, "order"),
        "join": F.array_join(T.join_conditions(outer), " , "),
        "set": F.array_join(F.transform(T.split_top_level(T.rx(outer, r"(?i)^\s*UPDATE\b[\s\S]*?\bSET\s+((?:(?!\b(?:FROM|WHERE)\b)[\s\S])+)", 1)),
                                        lambda a: F.substring_index(a, "=", 1)), " , "),
        "insert": T.rx(masked, r"(?i)^\s*INSERT\s+INTO\s+[\w.]+\s*\(([^)]*)\)", 1),
        "partition": F.array_join(T.rx_all(masked, rf"(?i)\bPARTITION\s+BY\s+((?:\({T.BALANCED}\)|(?!\b(?:ORDER|ROWS|RANGE)\b)[^()])+)", 1), " , "),
        "function": F.array_join(T.rx_all(outer, r"(?i)\b[A-Za-z_]\w*\(([^()]*)\)", 1), " , "),
    }
    uses = F.array(*[F.struct(F.lit(k).alias("used_in"), F.array_distinct(F.transform(T.column_refs(v), F.lower)).alias("cols")) for k, v in texts.items()])
    rows = stmts.select("doc_id", "path", "stmt_idx", F.explode(uses).alias("u"))
    return rows.select("doc_id", "path", "stmt_idx", "u.used_in", F.explode("u.cols").alias("column_ref"))


def predicates(stmts: DataFrame) -> DataFrame:
    """Leaves of the WHERE condition between AND / OR, in order.

    A nested group of conditions counts as one leaf; BETWEEN keeps its AND.
    """
    where = F.regexp_replace(T.clause(_main_query(F.col("masked")), "where"), r"(?i)(\bBETWEEN\s+\S+)\s+AND\s+", "$1 \u0001 ")
    leaves = F.filter(F.transform(F.split(where, r"(?i)\s+(?:AND|OR)\s+"), lambda p: F.trim(F.replace(p, F.lit("\u0001"), F.lit("AND")))), lambda p: p != "")
    return stmts.select("doc_id", "path", "stmt_idx", F.posexplode(leaves).alias("position", "predicate"))


def windows(stmts: DataFrame) -> DataFrame:
    """`(function, partition_cols, order_cols, frame)` of each window function."""
    call = rf"(?i)\b(\w+)\s*\({T.BALANCED}\)\s*OVER\s*\(({T.BALANCED})\)"
    rows = stmts.select("doc_id", "stmt_idx", F.posexplode(T.rx_all(F.col("masked"), call, 0)).alias("position", "_w"))
    spec = T.rx(F.col("_w"), call, 2)
    part = T.rx(spec, r"(?i)\bPARTITION\s+BY\s+((?:(?!\b(?:ORDER\s+BY|ROWS|RANGE|GROUPS)\b)[\s\S])+)", 1)
    order = T.rx(spec, r"(?i)\bORDER\s+BY\s+((?:(?!\b(?:ROWS|RANGE|GROUPS)\b)[\s\S])+)", 1)
    return rows.select("doc_id", "stmt_idx", "position", F.upper(T.rx(F.col("_w"), call, 1)).alias("function"),
                       T.split_top_level(part).alias("partition_cols"), T.split_top_level(order).alias("order_cols"),
                       F.trim(T.rx_or_null(spec, r"(?i)\b((?:ROWS|RANGE|GROUPS)\b[\s\S]*)$", 1)).alias("frame"))


def aggregates(stmts: DataFrame) -> DataFrame:
    """`(function, is_distinct, argument, alias)` of each aggregate that is not a window function."""
    call = rf"(?i)\b({'|'.join(R.AGGREGATE_PATTERN_NAMES)})\s*\((\s*DISTINCT\b)?\s*({T.BALANCED})\)(?!\s*(?:OVER|WITHIN)\b)(?:\s+AS\s+(\w+))?"
    rows = stmts.select("doc_id", "stmt_idx", F.posexplode(T.rx_all(F.col("masked"), call, 0)).alias("position", "_a"))
    a = F.col("_a")
    return rows.select("doc_id", "stmt_idx", "position", F.upper(T.rx(a, call, 1)).alias("function"), (T.rx(a, call, 2) != "").alias("is_distinct"),
                       F.trim(T.rx(a, call, 3)).alias("argument"), T.rx_or_null(a, call, 4).alias("alias"))


def cases(stmts: DataFrame) -> DataFrame:
    """WHEN / THEN pairs, ELSE and alias of each CASE without an inner CASE."""
    whole = r"(?i)\bCASE\b((?:(?!\b(?:CASE|END)\b)[\s\S])*)\bEND\b(?:\s+AS\s+(\w+))?"
    rows = stmts.select("doc_id", "stmt_idx", F.posexplode(T.rx_all(F.col("clean"), whole, 0)).alias("position", "_c"))
    body = T.rx(F.col("_c"), whole, 1)
    pair = r"(?i)\bWHEN\s+((?:(?!\bTHEN\b)[\s\S])+?)\s+THEN\s+((?:(?!\b(?:WHEN|ELSE|END)\b)[\s\S])+)"
    return rows.select("doc_id", "stmt_idx", "position",
                       F.transform(T.rx_all(body, pair, 1), lambda p: F.trim(p)).alias("whens"), F.transform(T.rx_all(body, pair, 2), lambda p: F.trim(p)).alias("thens"),
                       F.trim(T.rx_or_null(body, r"(?i)\bELSE\s+([\s\S]+?)\s*$", 1)).alias("else_value"), T.rx_or_null(F.col("_c"), whole, 2).alias("alias"))


# Words that precede a parenthesis without being a function.
NOT_A_FUNCTION = ("insert update and or not in is null like between exists case when then else end as select from where join on using having by values "
                  "into over partition group order union all any some set table if with limit distinct within filter interval key check "
                  "primary foreign unique references default index sets recursive lateral pivot qualify copy unload decimal numeric varchar char int").split()


def function_calls(stmts: DataFrame) -> DataFrame:
    """Every call: `(name, is_window, is_source)`; `is_source` when it stands after FROM or JOIN."""
    body = F.regexp_replace(F.col("masked"), r"(?i)^\s*(?:CREATE|INSERT|ALTER)\b(?:(?!\b(?:SELECT|AS)\b)[\s\S])*", "")
    # A call hides the calls among its arguments, so scan names alone and look at each one's surroundings.
    name = r"(?i)((?:\b(?:FROM|JOIN)\s+(?:LATERAL\s+|TABLE\s*\(\s*)?)?)\b([A-Za-z_][\w.]*)\s*(?=\()"
    rows = T.hold(stmts.select("doc_id", "path", "stmt_idx", "masked"), _b=body).select(
        "doc_id", "path", "stmt_idx", F.transform(T.rx_all(F.col("_b"), rf"(?i)\b(\w+)\s*\({T.BALANCED}\)\s*OVER\b", 1), F.upper).alias("_over"),
        F.explode(T.rx_all(F.col("_b"), name, 0)).alias("_m"))
    fn = F.upper(T.rx(F.col("_m"), r"(?i)([A-Za-z_][\w.]*)\s*$", 1))
    return rows.select("doc_id", "path", "stmt_idx", fn.alias("name"), F.array_contains("_over", fn).alias("is_window"),
                       F.col("_m").rlike(r"(?i)^(?:FROM|JOIN)\b").alias("is_source")).filter(~F.lower("name").isin(NOT_A_FUNCTION))


def functions_used(stmts: DataFrame, registry: DataFrame, dialect: str = "mysql") -> DataFrame:
    """Calls with a category from the registry (common names and those of the dialect); unknown names are scalar.

    The registry is a fixed table of a few hundred rows, so it is broadcast.
    """
    known = (registry.filter(F.col("dialect").isin("common", dialect, "custom"))
             .groupBy("name").agg(F.min_by("category", "rank").alias("category")))
    calls = function_calls(stmts)
    joined = calls.join(F.broadcast(known), "name", "left")
    category = (F.when(F.col("is_window"), "window").when(F.col("is_source") & (F.coalesce("category", F.lit("tvf")) == "tvf"), "tvf")
                .otherwise(F.coalesce("category", F.lit("scalar"))))
    return joined.select("doc_id", "path", "stmt_idx", "name", category.alias("category"), "is_source", F.col("category").isNotNull().alias("is_known"))


def subquery_texts(masked: Column) -> Column:
    """Array of the outermost subqueries. Texts nested beyond what a pattern reads are folded from the inside out."""
    from sqlstrata.operators import scopes as SC

    return F.when(SC.nesting(masked) > 24, SC.outermost_queries(masked)).otherwise(T.subqueries(masked))


def subquery_rows(stmts: DataFrame) -> DataFrame:
    """Outermost subqueries with their clause and normalised text."""
    rows = T.hold(stmts.select("doc_id", "path", "stmt_idx", "masked"), _q=subquery_texts(F.col("masked")))
    rows = rows.select("doc_id", "path", "stmt_idx", "masked", F.posexplode("_q").alias("position", "subquery"))
    # The clause that holds a subquery opens with the last such word before it that is in no closed parenthesis.
    before = F.regexp_replace(F.expr("substring(masked, 1, instr(masked, subquery) - 1)"), rf"\({T.BALANCED}\)", "")
    word = F.lower(T.rx(before, r"(?is)^.*\b(SELECT|FROM|WHERE|HAVING|JOIN|ON|SET|ORDER|GROUP)\b", 1))
    place = F.when(word == "select", "select").when(word == "having", "having").otherwise("where")
    return rows.select("doc_id", "path", "stmt_idx", "position", "subquery", place.alias("location"), T.normalise_query(F.col("subquery")).alias("normalized"))


SCALAR_FAMILIES = P.SCALAR_FAMILIES
