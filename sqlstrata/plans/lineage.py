"""Lineage: nodes and edges of tables, views, CTEs, columns and outside tables, built from a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlstrata.functions import text as T
from sqlstrata.operators import catalog as C, definitions as D, items as I, refs as R, scopes as SC
from sqlstrata.session import cut

NODE = ["id", "type", "name", "parent_id", "file_path", "line"]


def definition_nodes(defs: DataFrame) -> DataFrame:
    """One node per (type, key): first location, number of definitions and of files."""
    first = F.min(F.struct("path", "line", "schema_name", "name"))
    files = defs.groupBy("def_type", "table_key", "path").agg(F.count("*").alias("n"), first.alias("d"))
    return files.groupBy("def_type", "table_key").agg(F.min("d").alias("d"), F.sum("n").alias("definitions"), F.count("*").alias("files")).select(
        F.concat_ws(":", "def_type", "table_key").alias("id"), F.col("def_type").alias("type"), T.display_name(F.col("d.name"), F.col("d.schema_name")).alias("name"),
        F.lit(None).cast("string").alias("parent_id"), F.col("d.path").alias("file_path"), F.col("d.line").alias("line"), "definitions", "files")


def node_files(defs: DataFrame) -> DataFrame:
    """Definition files of each node as a long table: a hub's list of files never sits in one row."""
    return defs.select(F.concat_ws(":", "def_type", "table_key").alias("id"), "path").distinct()


def cte_nodes(ctes: DataFrame) -> DataFrame:
    """One node per CTE name; the first by path, statement and position wins."""
    first = F.min(F.struct("path", "doc_id", "stmt_idx", "position", "line"))
    return ctes.groupBy("cte_name").agg(first.alias("f")).select(
        F.concat(F.lit("cte:"), "cte_name").alias("id"), F.lit("cte").alias("type"), F.col("cte_name").alias("name"), F.lit(None).cast("string").alias("parent_id"),
        F.col("f.path").alias("file_path"), F.col("f.line").alias("line"))


def column_nodes(columns: DataFrame) -> DataFrame:
    """One node per (table, column) with its type and foreign key; the parent is the table's node."""
    first = F.min(F.struct("path", "doc_id", "stmt_idx", "position", "column_name", "data_type", "nullable", "primary_key", "def_type"))
    fk = F.min(F.when(F.col("ref_table").isNotNull(), F.struct("path", "doc_id", "stmt_idx", "ref_table", "ref_column")))
    return columns.groupBy("table_key", F.lower("column_name").alias("_c")).agg(first.alias("f"), fk.alias("k")).select(
        F.concat(F.lit("column:"), "table_key", F.lit("."), "_c").alias("id"), F.lit("column").alias("type"), F.col("f.column_name").alias("name"),
        F.concat_ws(":", "f.def_type", "table_key").alias("parent_id"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line"),
        "f.data_type", "f.nullable", "f.primary_key", F.lower("k.ref_table").alias("ref_table"), F.lower("k.ref_column").alias("ref_column"))


def contains_edges(column_nodes_df: DataFrame) -> DataFrame:
    return column_nodes_df.select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relationship"))


def statement_io(stmts: DataFrame, extended: bool = False) -> DataFrame:
    """`(inputs, outputs)` per statement, from its own row: what it reads and what it writes, local names and itself left out."""
    base = T.hold(stmts.select("doc_id", "path", "stmt_idx", "clean", "masked"), _m=R.with_delete_sources(R.ref_matches(F.col("masked"), extended)),
                  _l=R.local_names(F.col("masked")), _d=D._definition_structs(F.col("masked")),
                  _ctas=F.col("masked").rlike(r"(?i)(?<!\bALWAYS\s)\bAS\s+(?:SELECT|WITH|\()") | F.col("masked").rlike(D._INTO))
    made = F.transform(F.filter("_d", lambda d: (d["def_type"] == "view") | F.col("_ctas")), lambda d: T.qualified_key(d["name"], d["schema_name"]))
    out = T.hold(base, _in=F.array_except(R.keys_of(F.col("_m"), R.READ), "_l"),
                 outputs=F.array_distinct(F.concat(F.array_except(R.keys_of(F.col("_m"), R.WRITE), "_l"), made)))
    return out.select("doc_id", "path", "stmt_idx", "masked", F.array_except("_in", "outputs").alias("inputs"), "outputs")


def key_edges(stmts: DataFrame, extended: bool = False) -> DataFrame:
    """`(src_key, dst_key)` with the number of statements behind it and the first one. Rows are paired inside each statement only."""
    io = statement_io(stmts, extended)
    rows = io.select("doc_id", "path", "stmt_idx", F.explode("inputs").alias("src_key"), "outputs").select("doc_id", "path", "stmt_idx", "src_key", F.explode("outputs").alias("dst_key"))
    return rows.groupBy("src_key", "dst_key").agg(F.count("*").alias("statements"), F.min(F.struct("path", "doc_id", "stmt_idx")).alias("first"))


def resolve_nodes(keys: DataFrame, defs: DataFrame) -> DataFrame:
    """`(key, id)`: node of each key (column `key`): table, then view, then a definition of that name, else an outside table."""
    found = C.key_resolution(keys.select(F.col("key").alias("ref_key")), defs)
    kinds = defs.select(F.col("table_key").alias("def_key"), F.when(F.col("def_type") == "table", 0).otherwise(1).alias("_o"), "def_type").distinct()
    best = found.join(kinds, "def_key").groupBy("ref_key").agg(F.min(F.struct("tier", "_o", "def_key", "def_type")).alias("b"))
    return keys.join(best, F.col("key") == F.col("ref_key"), "left").select(
        "key", F.when(F.col("b").isNotNull(), F.concat_ws(":", "b.def_type", "b.def_key")).otherwise(F.concat(F.lit("external:"), "key")).alias("id"))


def table_edges(stmts: DataFrame, defs: DataFrame, extended: bool = False) -> DataFrame:
    """`(src, dst, statements, file_path, stmt_idx)` between node ids; an edge of a node to itself is dropped."""
    edges = cut(key_edges(stmts, extended), "key_edges")
    keys = edges.select(F.col("src_key").alias("key")).union(edges.select("dst_key")).distinct()
    ids = resolve_nodes(keys, defs)
    s, d = ids.select(F.col("key").alias("src_key"), F.col("id").alias("src")), ids.select(F.col("key").alias("dst_key"), F.col("id").alias("dst"))
    rows = edges.join(s, "src_key").join(d, "dst_key").filter("src <> dst")
    return rows.groupBy("src", "dst").agg(F.sum("statements").alias("statements"), F.min("first").alias("f")).select(
        "src", "dst", "statements", F.col("f.path").alias("file_path"), F.col("f.stmt_idx").alias("stmt_idx"))


def external_nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ends.filter(F.col("id").startswith("external:")).select(
        "id", F.lit("external").alias("type"), F.regexp_replace("id", "^external:", "").alias("name"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line"))


def lineage_graph(stmts: DataFrame, with_columns: bool = True, extended: bool = False, defs: DataFrame | None = None, column_flow: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus. Edges carry `relationship`: "flow" or "contains", and with `column_flow` the type of a column edge.

    `column_flow` adds the column edges, and a node for each of their ends that no definition lists. `defs` saves a pass when it is stored already.
    """
    defs = defs if defs is not None else cut(D.definitions(stmts), "defs")
    flow = cut(table_edges(stmts, defs, extended).select("src", "dst", F.lit("flow").alias("relationship"), "file_path"), "flow")
    nodes = definition_nodes(defs).select(*NODE).unionByName(cte_nodes(R.ctes(stmts)).select(*NODE)).unionByName(external_nodes(flow).select(*NODE))
    nodes = cut(nodes, "nodes")
    if not with_columns:
        return nodes, flow
    cols = cut(column_nodes(D.def_columns(defs)), "columns")
    nodes, edges = nodes.unionByName(cols.select(*NODE)), flow.unionByName(contains_edges(cols).withColumn("file_path", F.lit(None).cast("string")))
    if not column_flow:
        return nodes, edges
    found = cut(column_edges(stmts, defs), "column_edges")
    src, dst = column_id(F.col("src_id"), F.col("src_column")), column_id(F.col("dst_id"), F.col("dst_column"))
    ends = found.select(src.alias("id"), F.col("src_column").alias("name"), F.col("src_id").alias("parent_id")).union(found.select(dst, "dst_column", "dst_id"))
    more = ends.groupBy("id").agg(F.min("name").alias("name"), F.min("parent_id").alias("parent_id")).join(cols.select("id"), "id", "left_anti")
    more = more.select("id", F.lit("column").alias("type"), "name", "parent_id", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line"))
    data = found.select(src.alias("src"), dst.alias("dst"), I.edge_type(F.col("kind")).alias("relationship"), F.lit(None).cast("string").alias("file_path")).filter("src <> dst")
    return nodes.unionByName(more), edges.unionByName(data)


# --- columns ---------------------------------------------------------------------------------------------------

def column_edges(stmts: DataFrame, defs: DataFrame) -> DataFrame:
    """`(src_id, src_column, dst_id, dst_column, kind, expression)`: base column -> column that a statement writes. Distinct over the corpus.

    Covers INSERT (a column list names targets by position), CREATE .. AS, SELECT INTO, UPDATE SET and MERGE, through CTEs, derived tables, scalar
    subqueries and every branch of a set operation. `*` of a base table gives no edge, since its columns are not known here.
    """
    writes = stmts.filter(F.col("masked").rlike(r"(?i)INTO|OVERWRITE|MERGE|UPDATE|CREATE"))  # words without which no text has a target
    rows = SC.base_inputs(writes).filter("target is not null and `table` is not null and `column` <> '*'")
    by_place = F.when(~F.col("expr").rlike(r"^(?:\w+\.)?\*$"), F.get("listed", F.col("position")))
    rows = rows.select(F.col("table").alias("src_key"), F.col("column").alias("src_column"), F.col("target").alias("dst_key"), F.lower(F.coalesce(by_place, F.col("name"))).alias("dst_column"),
                       I.edge_kind(F.col("kind")).alias("kind"), F.col("expr").alias("expression"))
    # The first kind and expression of an edge; added up per edge before node ids are looked up.
    rows = cut(rows.groupBy("src_key", "src_column", "dst_key", "dst_column").agg(F.min(F.struct("kind", "expression")).alias("k")), "column_keys")
    keys = rows.select(F.col("src_key").alias("key")).union(rows.select("dst_key")).distinct()
    ids = cut(resolve_nodes(keys, defs), "column_ids")
    s, d = ids.select(F.col("key").alias("src_key"), F.col("id").alias("src_id")), ids.select(F.col("key").alias("dst_key"), F.col("id").alias("dst_id"))
    return rows.join(s, "src_key").join(d, "dst_key").filter("src_id <> dst_id or src_column <> dst_column").groupBy("src_id", "src_column", "dst_id", "dst_column").agg(
        F.min("k").alias("k")).select("src_id", "src_column", "dst_id", "dst_column", "k.kind", "k.expression")


def column_id(node_id: Column, column: Column) -> Column:
    return F.concat(F.lit("column:"), F.regexp_replace(node_id, "^(?:table|view|external|cte):", ""), F.lit("."), F.lower(column))


def column_graph(edges: DataFrame) -> DataFrame:
    """Column edges as `(src, dst)` over column node ids, for the graph loops."""
    return edges.select(column_id(F.col("src_id"), F.col("src_column")).alias("src"), column_id(F.col("dst_id"), F.col("dst_column")).alias("dst")).filter("src <> dst").distinct()


def trace_column(edges: DataFrame, tables: DataFrame, node_id: str, column: str, direction: str = "up") -> DataFrame:
    """Direct column edges into (or out of) a column, by the other table; the table-level closure when there are none.

    `edges` are column edges, `tables` the table edges `(src, dst)`.
    """
    from sqlstrata.plans import graph as G
    here, there = ("dst", "src") if direction == "up" else ("src", "dst")
    hits = edges.filter((F.col(f"{here}_id") == node_id) & (F.col(f"{here}_column") == column.lower()))
    direct = hits.groupBy(F.col(f"{there}_id").alias("node")).agg(F.count("*").alias("n")).select("node", F.lit("column").alias("level"), F.col("n").cast("long").alias("n"))
    if not hits.isEmpty():
        return direct
    seeds = tables.sparkSession.range(1).select(F.lit(node_id).alias("seed"))
    return G.closure(tables, seeds, direction).select("node", F.lit("table").alias("level"), F.col("depth").cast("long").alias("n"))


def output_sources(stmts: DataFrame) -> DataFrame:
    """`(position, output_name, sources)`: base columns (and `table.*`) behind each output column of a statement, sorted; `?` where a column has no known table."""
    rows = SC.base_inputs(stmts).select("doc_id", "stmt_idx", "position", F.col("name").alias("output_name"), F.concat_ws(".", F.coalesce("table", F.lit("?")), "column").alias("_s"))
    return rows.groupBy("doc_id", "stmt_idx", "position", "output_name").agg(F.array_sort(F.collect_set("_s")).alias("sources"))


def cte_dependencies(stmts: DataFrame) -> DataFrame:
    """`(src_cte, dst_cte)` inside a statement: the destination's body reads the source. No join: names and bodies share a row."""
    rows = T.hold(stmts.select("doc_id", "stmt_idx", "masked"), _c=R.cte_structs(F.col("masked"))).filter("size(_c) > 1")
    rows = rows.select("doc_id", "stmt_idx", F.transform("_c", lambda c: c["name"]).alias("_n"), F.explode("_c").alias("c"))
    read = F.array_distinct(F.transform(T.rx_all(F.col("c.body"), r"(?i)\b(?:FROM|JOIN)\s+(\w+)\b", 1), F.lower))
    return rows.select("doc_id", "stmt_idx", F.col("c.name").alias("dst_cte"), F.explode(F.array_intersect(read, "_n")).alias("src_cte")).filter("src_cte <> dst_cte")


def resolve_node_ids(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """`(request, id)`: each `(graph_id, label, type)` to a node: its id, `type:label`, a related type, else its name or last name part.

    Equal candidates are settled by id. Every tier is an equi-join.
    """
    n = nodes.filter(F.col("type") != "column").select("id", F.lower("name").alias("_name"))
    w = wanted.select("request", "graph_id", F.lower("label").alias("_label"), F.col("type").alias("_type"))
    alternatives = (F.when(F.col("_type") == "view", F.array(F.lit("view"), F.lit("table"))).when(F.col("_type") == "table", F.array(F.lit("table"), F.lit("view")))
                    .when(F.col("_type") == "external", F.array(F.lit("external"), F.lit("table"), F.lit("view"))).otherwise(F.array("_type")))
    guesses = w.select("request", F.lit(0).alias("tier"), F.col("graph_id").alias("guess")).unionByName(
        w.select("request", "_label", F.posexplode(alternatives).alias("_p", "_t")).select("request", (F.col("_p") + 1).alias("tier"), F.concat_ws(":", "_t", "_label").alias("guess")))
    by_id = guesses.join(nodes.select("id"), F.col("guess") == F.col("id")).select("request", "tier", "id")
    bare = F.regexp_replace("_label", r"""^["'`]+|["'`]+$""", "")
    names = n.select("id", F.explode(F.array_distinct(F.array("_name", F.substring_index("_name", ".", -1)))).alias("_k"))
    by_name = w.select("request", bare.alias("_k")).join(names, "_k").select("request", F.lit(9).alias("tier"), "id")
    best = by_id.unionByName(by_name).groupBy("request").agg(F.min(F.struct("tier", "id")).alias("b"))
    return wanted.select("request").join(best, "request", "left").select("request", "b.id", "b.tier")


MAX_QUERIES = 100  # a name search takes the user's few words, never a table


def similar_names(nodes: DataFrame, queries: list[str], limit: int = 3) -> DataFrame:
    """Names like each word: one contains the other (0), or edit distance up to max(3, 40 % of the word); the best `limit`."""
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} words at a time")
    rows = nodes.filter(F.col("type") != "column").select("name", F.lower("name").alias("_n")).distinct()
    rows = rows.select("name", "_n", F.explode(F.array(*[F.lit(q.lower()) for q in queries])).alias("query"))
    bound = F.greatest(F.lit(3), F.ceil(F.length("query") * 0.4).cast("int"))
    inside = F.col("_n").contains(F.col("query")) | F.col("query").contains(F.col("_n"))
    near = F.abs(F.length("_n") - F.length("query")) <= bound
    rows = rows.withColumn("distance", F.when(inside, 0).when(near, F.levenshtein("query", "_n"))).filter(F.col("distance") <= bound)
    from pyspark.sql import Window
    order = Window.partitionBy("query").orderBy("distance", "_n", "name")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "rank", "name", "distance")


def column_endpoints(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """`(name, id)`: a table name as table, view, CTE or outside table, in this order, else by display name."""
    order = {"table": 1, "view": 2, "cte": 3, "external": 4}
    rank = F.lit(9)
    for t, i in order.items():
        rank = F.when(F.col("type") == t, i).otherwise(rank)
    n = nodes.filter(F.col("type").isin(list(order)))
    by_key = n.select(F.regexp_replace("id", "^[a-z]+:", "").alias("_k"), rank.alias("tier"), "id")
    by_name = n.select(F.lower("name").alias("_k"), F.lit(8).alias("tier"), "id")
    best = names.select(F.lower("name").alias("_k")).distinct().join(by_key.unionByName(by_name), "_k").groupBy("_k").agg(F.min(F.struct("tier", "id")).alias("b"))
    return names.select("name").distinct().join(best, F.lower("name") == F.col("_k"), "left").select("name", "b.id")
