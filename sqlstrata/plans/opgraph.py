"""Operators of a statement's outermost query as one chain in their fixed order, and the forms a text uses.

All operators of a statement come from its own row. Graphs with edges, of every scope, are in `opdag`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlstrata.functions import text as T
from sqlstrata.operators import items as I, refs as R

_SET_OP = r"(?i)\b(?:UNION\s+ALL|UNION|INTERSECT|EXCEPT|MINUS)\b"


def _parts(stmts: DataFrame) -> DataFrame:
    base = T.hold(stmts.select("doc_id", "path", "stmt_idx", "masked"), o=I._main_query(F.col("masked")))
    m, o = F.col("masked"), F.col("o")
    read = F.transform(F.filter(R.ref_matches(o), lambda r: r.rlike(r"(?i)^(?:FROM|JOIN)\b")), R.match_name)
    joins = T.rx_all(o, r"(?i)\b((?:NATURAL\s+)?(?:(?:INNER|CROSS|(?:LEFT|RIGHT|FULL)(?:\s+OUTER)?)\s+)?JOIN)\b", 1)
    return T.hold(base, ctes=R.cte_structs(m), tables=F.filter(read, R.is_table_name), joins=F.transform(joins, lambda j: F.upper(F.regexp_replace(j, r"\s+", " "))),
                  w=T.clause(o, "where"), g=T.clause(o, "group"), h=T.clause(o, "having"), ob=T.clause(o, "order"), s=T.select_list(o), subs=T.rx_all(o, r"(?i)\(subq\)", 0),
                  sets=T.rx_all(o, _SET_OP, 0), lim=T.rx(o, r"(?i)\bLIMIT\s+(\d+)|\bTOP\s*\(?\s*(\d+)", 0))


def op_nodes(stmts: DataFrame) -> DataFrame:
    """`(doc_id, path, stmt_idx, node_id, kind, label, parent_id, depth, chain)`; `chain` is the place in the operator chain, null for leaves.

    Tables, CTEs and subqueries are leaves; CTEs hold their own tables as children at depth 1.
    """
    p = _parts(stmts)
    def op(kind: str, label: Column, present: Column) -> Column:
        return F.when(present, F.struct(F.lit(kind).alias("kind"), label.alias("label"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(True).alias("in_chain")))
    def leaf(kind: str, label: Column, parent: Column = None, depth: int = 0) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), (F.lit(None).cast("string") if parent is None else parent).alias("parent"), F.lit(depth).alias("depth"), F.lit(False).alias("in_chain"))
    s = F.col("s")
    flat = F.regexp_replace(s, rf"\bOVER\s*\({T.BALANCED}\)", "OVER")
    has_agg = F.regexp_replace(s, rf"(?i)\b\w+\s*\({T.BALANCED}\)\s*OVER\b", "").rlike(r"(?i)\b(?:COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT|STRING_AGG|LISTAGG|ARRAY_AGG)\s*\(")
    chain = F.concat(
        F.transform("joins", lambda j: F.struct(F.lit("join").alias("kind"), j.alias("label"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(True).alias("in_chain"))),
        F.filter(F.array(
            op("filter", F.lit("WHERE"), F.col("w") != ""), op("aggregate", F.lit("GROUP BY"), F.col("g") != ""), op("filter", F.lit("HAVING"), F.col("h") != ""),
            op("aggregate", F.lit("AGGREGATE"), has_agg & (F.col("g") == "")), op("case", F.lit("CASE"), flat.rlike(r"(?i)\bCASE\b")), op("window", F.lit("WINDOW"), s.rlike(r"(?i)\bOVER\b")),
            op("select", F.lit("SELECT"), s != ""), op("sort", F.lit("ORDER BY"), F.col("ob") != ""), op("limit", F.lit("LIMIT"), F.col("lim") != ""),
            op("union", F.upper(F.regexp_replace(F.get("sets", F.lit(0)), r"\s+", " ")), F.size("sets") > 0), op("result", F.lit("RESULT"), s != "")), lambda n: n.isNotNull()))
    leaves = F.concat(F.transform("ctes", lambda c: leaf("cte", c["name"])), F.transform("tables", lambda t: leaf("table", t)), F.transform("subs", lambda q: leaf("subquery", F.lit("(subquery)"))),
                      F.flatten(F.transform("ctes", lambda c: F.transform(T.rx_all(c["body"], r"(?i)\b(?:FROM|JOIN)\s+(?:\w+\.)?(\w+)\b", 1), lambda t: leaf("table", F.lower(t), c["name"], 1)))))
    p = T.hold(T.hold(p, _chain=chain), _leaves=leaves)
    rows = p.select("doc_id", "path", "stmt_idx", F.size("_chain").alias("_len"), F.posexplode(F.concat("_chain", "_leaves")).alias("pos", "n"))
    return rows.select("doc_id", "path", "stmt_idx", "pos", "n.kind", "n.label", F.col("n.parent").alias("parent_label"), "n.depth",
                       F.when(F.col("n.in_chain"), F.col("pos")).alias("chain"), F.concat(F.col("n.kind"), F.lit("_"), F.col("pos").cast("string")).alias("node_id"), F.col("_len").alias("chain_length"))


def shape(nodes: DataFrame) -> DataFrame:
    """Per statement: nodes, tables, critical path (nodes on the longest way), query depth (edges back from the result), complex flag.

    The chain's positions give the longest way directly: a leaf adds one node before the operator it enters.
    """
    g = nodes.filter("depth = 0").groupBy("doc_id", "stmt_idx").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "result").alias("_result"), F.max("chain_length").alias("_len"))
    path = F.col("_len") + (F.col("tables") > 0).cast("int")
    depth = F.when(F.col("_result") > 0, path - 1).otherwise(0)
    return g.select("doc_id", "stmt_idx", "nodes", "tables", F.greatest(path, F.lit(1)).alias("critical_path"), depth.alias("query_depth"),
                    ((F.col("nodes") >= 8) | (F.col("tables") >= 5) | (depth >= 3)).alias("is_complex"))


def cte_depth(nodes: DataFrame) -> DataFrame:
    """Largest nesting depth of the nodes inside CTEs."""
    return nodes.groupBy("doc_id", "stmt_idx").agg(F.max("depth").alias("max_cte_depth"))


# Operator kind -> class of the histogram.
CLUSTERS = {"table": "tables", "join": "joins", "filter": "filters", "aggregate": "aggregates", "sort": "sorts", "cte": "ctes", "subquery": "subqueries",
            "window": "windows", "union": "unions", "case": "cases"}


def histogram(nodes: DataFrame) -> DataFrame:
    """Operators by class over the corpus."""
    return nodes.groupBy(I.map_values(F.col("kind"), CLUSTERS, "other").alias("cluster")).agg(F.count("*").alias("n"))


def node_levels(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Complexity level of join, aggregate and subquery operators, and whether they are bottlenecks."""
    s = stats.select("doc_id", "stmt_idx", "joins", "aggregations", "subqueries")
    j, a, q = F.col("joins"), F.col("aggregations"), F.col("subqueries")
    level = (F.when(F.col("kind") == "join", F.when(j > 5, "high").when(j > 2, "medium").otherwise("low"))
             .when(F.col("kind") == "aggregate", F.when(a > 4, "high").when(a > 2, "medium").otherwise("low")).when(F.col("kind") == "subquery", F.when(q > 2, "high").otherwise("low")))
    heavy = ((F.col("kind") == "join") & (j > 3)) | ((F.col("kind") == "aggregate") & (a > 3))
    return nodes.filter(F.col("kind").isin("join", "aggregate", "subquery")).join(s, ["doc_id", "stmt_idx"]).select("doc_id", "stmt_idx", "node_id", "kind", level.alias("complexity_level"), heavy.alias("is_bottleneck"))


def op_profile(stmts: DataFrame) -> DataFrame:
    """Counts per statement of every relational form the text uses: the vocabulary of V1 to V22, row-local."""
    m = F.col("masked")
    forms = {name: T.rx_count(m, pattern) for name, pattern in FORMS.items()}
    return stmts.select("doc_id", "path", "stmt_idx", *[c.alias(n) for n, c in forms.items()])


# Relational forms and how the text shows them.
FORMS = {
    "projection": r"(?i)\bSELECT\b", "distinct": r"(?i)\bSELECT\s+DISTINCT\b", "star": r"(?i)\bSELECT\s+(?:DISTINCT\s+)?(?:\w+\.)?\*", "alias": r"(?i)\bAS\s+\w+",
    "where": r"(?i)\bWHERE\b", "join": r"(?i)\bJOIN\b", "inner_join": r"(?i)\bINNER\s+JOIN\b", "left_join": r"(?i)\bLEFT\s+(?:OUTER\s+)?JOIN\b", "right_join": r"(?i)\bRIGHT\s+(?:OUTER\s+)?JOIN\b",
    "full_join": r"(?i)\bFULL\s+(?:OUTER\s+)?JOIN\b", "cross_join": r"(?i)\bCROSS\s+JOIN\b", "comma_join": r"(?i)\bFROM\s+[\w.]+(?:\s+\w+)?\s*,\s*[A-Za-z_][\w.]*\b(?!\s*\()",
    "non_equi_join": r"(?i)\bON\s+[\w.]+\s*(?:<>|!=|[<>]=?)\s*[\w.]+", "in_subquery": r"(?i)\bIN\s*\(\s*SELECT\b", "not_in_subquery": r"(?i)\bNOT\s+IN\s*\(\s*SELECT\b",
    "exists": r"(?i)\bEXISTS\s*\(\s*SELECT\b", "not_exists": r"(?i)\bNOT\s+EXISTS\s*\(\s*SELECT\b", "apply": r"(?i)\b(?:CROSS|OUTER)\s+APPLY\b", "lateral": r"(?i)\bLATERAL\b",
    "group_by": r"(?i)\bGROUP\s+BY\b", "aggregate": r"(?i)\b(?:COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT)\s*\(", "distinct_aggregate": r"(?i)\b(?:COUNT|SUM|AVG)\s*\(\s*DISTINCT\b", "having": r"(?i)\bHAVING\b",
    "grouping_sets": r"(?i)\bGROUPING\s+SETS\b", "rollup": r"(?i)\bROLLUP\b", "cube": r"(?i)\bCUBE\b", "window": r"(?i)\bOVER\s*\(", "partition_by": r"(?i)\bPARTITION\s+BY\b", "frame": r"(?i)\b(?:ROWS|RANGE)\s+BETWEEN\b",
    "qualify": r"(?i)\bQUALIFY\b", "case": r"(?i)\bCASE\b", "order_by": r"(?i)\bORDER\s+BY\b", "limit": r"(?i)\bLIMIT\s+\d", "top": r"(?i)\bTOP\s*\(?\s*\d", "union": r"(?i)\bUNION\b", "union_all": r"(?i)\bUNION\s+ALL\b",
    "intersect": r"(?i)\bINTERSECT\b", "except": r"(?i)\b(?:EXCEPT|MINUS)\b", "with": r"(?i)\bWITH\s+(?:RECURSIVE\s+)?\w+\s*(?:\([^)]*\)\s*)?AS\s*\(", "recursive": r"(?i)\bWITH\s+RECURSIVE\b",
    "derived_table": r"(?i)\b(?:FROM|JOIN)\s*\(\s*SELECT\b", "scalar_subquery": r"(?i)(?:[=<>]\s*|\bSELECT\s+|,\s*)\(\s*SELECT\b", "table_function": r"(?i)\b(?:FROM|JOIN)\s+(?:LATERAL\s+)?\w+\s*\(",
    "pivot": r"(?i)\bPIVOT\s*\(", "connect_by": r"(?i)\bCONNECT\s+BY\b", "sample": r"(?i)\bSAMPLE\s+\d", "insert": r"(?i)^\s*INSERT\b", "update": r"(?i)^\s*UPDATE\b", "delete": r"(?i)^\s*DELETE\b", "merge": r"(?i)^\s*MERGE\b",
    "replace": r"(?i)^\s*REPLACE\b", "create": r"(?i)^\s*CREATE\b", "alter": r"(?i)^\s*ALTER\b", "drop": r"(?i)^\s*DROP\b", "truncate": r"(?i)^\s*TRUNCATE\b",
}


def profile_totals(profile: DataFrame, forms: list[str]) -> DataFrame:
    """Occurrences and statements per form over the corpus. The forms fold into two sums each before anything is shuffled."""
    sums = profile.agg(*[F.sum(f).alias(f"n_{f}") for f in forms], *[F.count_if(F.col(f) > 0).alias(f"s_{f}") for f in forms])
    pairs = F.array(*[F.struct(F.lit(f).alias("form"), F.coalesce(F.col(f"n_{f}"), F.lit(0)).cast("long").alias("occurrences"), F.col(f"s_{f}").alias("statements")) for f in forms])
    return sums.select(F.explode(pairs).alias("p")).select("p.form", "p.occurrences", "p.statements")
