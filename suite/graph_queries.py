"""Catalog joins (J), lineage (L), graph (G), impact (I), comparison (C), streaming (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlstrata import fixtures as X
from sqlstrata.operators import catalog as C, compare as K, definitions as D, items as I, refs as R, statements as S, stats as A
from sqlstrata.plans import graph as G, impact as M, lineage as L, opgraph as O
from sqlstrata.session import cut, scratch_path
from sqlstrata.streaming import index as W
from suite.base import CTES, base_refs, defs, join_text, query, stmts, stored_stmts


def catalog(spark, d):
    return base_refs(spark, d), defs(spark, d)


def def_targets(de):
    return de.select(F.col("table_key").alias("target_key")).distinct()


# --- catalog -----------------------------------------------------------------------------------------------------

@query("J1_resolve_references", "SELECT r.doc_id, r.stmt_idx, r.table_key, r.ref_type, s.def_key, s.tier FROM brefs r LEFT JOIN resolution s ON s.ref_key = r.table_key")
def _(spark, d):
    return C.resolve_refs(*catalog(spark, d)).select("doc_id", "stmt_idx", "table_key", "ref_type", "def_key", "tier")


CTES["first_defs"] = "SELECT table_key, arg_min(def_type, (path, line, doc_id)) AS def_type, min(path) AS path, count(*) AS n_definitions FROM defs GROUP BY table_key"


@query("J2_first_definition", """SELECT ref_key, arg_min(def_key, (tier, path, def_key)) AS def_key, arg_min(path, (tier, path, def_key)) AS path, min(tier) AS tier FROM resolution JOIN first_defs ON def_key = table_key GROUP BY ref_key""")
def _(spark, d):
    refs, de = catalog(spark, d)
    return C.find_definitions(C.ref_keys(refs), de).select("ref_key", "def_key", "path", "tier")


CTES["target_refs"] = """SELECT def_key AS target_key, ref_key FROM def_keys JOIN ref_keys ON def_key = ref_key UNION ALL
    SELECT def_key, ref_key FROM def_keys JOIN ref_keys ON def_name = ref_name AND NOT (has_schema AND instr(ref_key, '.') > 0) WHERE def_key NOT IN (SELECT ref_key FROM ref_keys)"""


@query("J3_find_references", "SELECT t.target_key, r.table_key, r.doc_id, r.stmt_idx, r.ref_type FROM target_refs t JOIN brefs r ON r.table_key = t.ref_key")
def _(spark, d):
    refs, de = catalog(spark, d)
    return C.find_references(def_targets(de), refs).select("target_key", "table_key", "doc_id", "stmt_idx", "ref_type")


@query("J4_external_references", "SELECT doc_id, stmt_idx, table_key, ref_type FROM brefs r WHERE NOT EXISTS (SELECT 1 FROM defs x WHERE x.path = r.path AND x.table_key = r.table_key)")
def _(spark, d):
    return C.external_references(*catalog(spark, d)).select("doc_id", "stmt_idx", "table_key", "ref_type")


@query("J5_dependent_files", "SELECT DISTINCT t.target_key, r.path FROM target_refs t JOIN brefs r ON r.table_key = t.ref_key")
def _(spark, d):
    refs, de = catalog(spark, d)
    return C.dependent_files(def_targets(de), refs)


@query("J6_table_lists", "SELECT table_key, bool_or(d) AS is_defined, bool_or(NOT d) AS is_referenced FROM (SELECT table_key, true AS d FROM defs UNION ALL SELECT table_key, false FROM brefs) GROUP BY 1")
def _(spark, d):
    return C.table_lists(*catalog(spark, d))


@query("J7_missing_definitions", "SELECT table_key, count(*) AS references, count(DISTINCT path) AS files FROM brefs WHERE table_key NOT IN (SELECT ref_key FROM resolution) AND table_key NOT IN (SELECT cte_name FROM ctes) GROUP BY 1")
def _(spark, d):
    return C.missing(*catalog(spark, d), R.ctes(stmts(spark, d)))


@query("J8_orphaned_definitions", "SELECT table_key, count(*) AS n_definitions FROM defs WHERE table_key NOT IN (SELECT ref_key FROM ref_keys) AND table_key NOT IN (SELECT ref_name FROM ref_keys) GROUP BY 1")
def _(spark, d):
    return C.orphaned(*catalog(spark, d)).select("table_key", "n_definitions")


CTES["own_keys"] = "SELECT DISTINCT ref_key, path FROM resolution JOIN defs ON table_key = def_key"
CTES["cross_file"] = """SELECT r.path AS src, x.path AS dst, r.table_key, r.ref_type FROM brefs r JOIN resolution s ON s.ref_key = r.table_key JOIN defs x ON x.table_key = s.def_key
    WHERE NOT EXISTS (SELECT 1 FROM own_keys o WHERE o.ref_key = r.table_key AND o.path = r.path)"""
CTES["ref_rank"] = "SELECT * FROM (VALUES ('insert', 1), ('update', 2), ('delete', 3), ('join', 4), ('select', 5)) v(ref_type, rank)"


@query("J9_file_graph", "SELECT src, dst, count(*) AS count, count(DISTINCT table_key) AS tables, arg_min(ref_type, rank) AS reference_type FROM cross_file JOIN ref_rank USING (ref_type) GROUP BY 1, 2")
def _(spark, d):
    return C.file_graph(*catalog(spark, d))


@query("J9_file_edge_samples", """WITH e AS (SELECT DISTINCT src, dst, table_key FROM cross_file), p AS (SELECT DISTINCT path, table_key, line, context FROM brefs)
  SELECT src, dst, least(count(*), 12) AS samples FROM e JOIN p ON p.path = e.src AND p.table_key = e.table_key GROUP BY 1, 2""")
def _(spark, d):
    return C.file_edge_samples(*catalog(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("samples"))


@query("J10_table_graph", """SELECT src, dst, count(*) AS count, arg_min(ref_type, rank) AS reference_type FROM (SELECT v.table_key AS src, coalesce(x.table_key, r.table_key) AS dst, r.ref_type FROM defs v JOIN brefs r ON r.doc_id = v.doc_id AND r.stmt_idx = v.stmt_idx
  LEFT JOIN resolution s ON s.ref_key = r.table_key LEFT JOIN defs x ON x.table_key = s.def_key WHERE v.def_type = 'view' AND NOT EXISTS (SELECT 1 FROM defs h WHERE h.path = r.path AND h.table_key = r.table_key)) JOIN ref_rank USING (ref_type) WHERE src <> dst GROUP BY 1, 2""")
def _(spark, d):
    return C.table_graph(*catalog(spark, d))


@query("J11_external_nodes", """SELECT ref_key AS table_key, (SELECT count(*) FROM brefs WHERE brefs.table_key = ref_key) AS references FROM ref_keys WHERE ref_key NOT IN (SELECT def_key FROM def_keys) AND NOT (instr(ref_key, '.') = 0 AND ref_name IN (SELECT def_name FROM def_keys))""")
def _(spark, d):
    return C.external_nodes(*catalog(spark, d))


@query("J12_primary_reference_type", "SELECT table_key, arg_min(ref_type, rank) AS reference_type FROM brefs JOIN ref_rank USING (ref_type) GROUP BY 1")
def _(spark, d):
    return base_refs(spark, d).groupBy("table_key").agg(C.primary_type().alias("reference_type"))


@query("J13_aliases", """SELECT doc_id, 0 AS stmt_idx, alias, prefix || CASE num WHEN 'a' THEN CAST(a AS VARCHAR) WHEN 'b' THEN CAST(b AS VARCHAR) WHEN 'c' THEN CAST(c AS VARCHAR) ELSE '' END AS table_key FROM qlog q JOIN (VALUES (1, 'x', 't', 'a'), (1, 'y', 'raw.t', 'c'),
  (10, 'a', 't', 'a'), (10, 'b', 't', 'b'), (10, 'c', 't', 'c'), (30, 'a', 't', 'a'), (30, 'b', 't', 'a'), (30, 'c', 't', 'b'), (30, 'd', 't', 'c'), (30, 'e', 'raw.sales', ''), (30, 'f', 'raw.dim', ''), (30, 'g', 'raw.geo', ''),
  (34, 'x', 't', 'a'), (34, 'y', 't', 'c'), (40, 'm', 'raw.dim', ''), (41, 's', 'raw.sales', ''), (43, 'x1', 'base', ''), (43, 'x2', 'base', ''), (43, 'x3', 'base', '')) v(k, alias, prefix, num) ON q.kind = v.k""")
def _(spark, d):
    pairs = stmts(spark, d).select("doc_id", "stmt_idx", F.explode(I.alias_pairs(I._main_query(F.col("masked")))).alias("p")).select("doc_id", "stmt_idx", "p.alias", "p.table_key")
    return pairs.filter(F.col("alias") != F.substring_index("table_key", ".", -1))


@query("J14_column_endpoints", """WITH n AS (SELECT DISTINCT src_key AS name FROM key_edges), c AS (SELECT n.name, CASE type WHEN 'table' THEN 1 WHEN 'view' THEN 2 WHEN 'cte' THEN 3 ELSE 4 END AS tier, id FROM n JOIN nodes ON regexp_replace(id, '^[a-z]+:', '') = n.name WHERE type <> 'column'
  UNION ALL SELECT n.name, 8, id FROM n JOIN nodes ON lower(nodes.name) = n.name WHERE type <> 'column') SELECT n.name, (SELECT arg_min(id, (tier, id)) FROM c WHERE c.name = n.name) AS id FROM n""")
def _(spark, d):
    s = stored_stmts(spark, d)
    nodes, _ = L.lineage_graph(s)
    return L.column_endpoints(L.key_edges(s).select(F.col("src_key").alias("name")).distinct(), nodes)


@query("J15_node_lookup", """WITH w AS (SELECT DISTINCT 'view:' || table_key AS graph_id, table_key AS label FROM brefs), c AS (SELECT graph_id, 0 AS tier, id FROM w JOIN nodes ON id = graph_id UNION ALL SELECT graph_id, 1, id FROM w JOIN nodes ON id = 'view:' || label UNION ALL SELECT graph_id, 2, id FROM w JOIN nodes ON id = 'table:' || label
  UNION ALL SELECT graph_id, 9, id FROM w JOIN nodes n ON type <> 'column' AND (lower(n.name) = label OR split_part(lower(n.name), '.', -1) = label)) SELECT w.graph_id AS request, b.id, b.tier FROM w LEFT JOIN (SELECT graph_id, arg_min(id, (tier, id)) AS id, min(tier) AS tier FROM c GROUP BY 1) b USING (graph_id)""")
def _(spark, d):
    s = stored_stmts(spark, d)
    nodes, _ = L.lineage_graph(s)
    asked = R.base_table_refs(s).select(F.concat(F.lit("view:"), "table_key").alias("graph_id"), F.col("table_key").alias("label"), F.lit("view").alias("type")).distinct().withColumn("request", F.col("graph_id"))
    out = L.resolve_node_ids(nodes, asked)
    return out.select("request", "id", F.when(F.col("tier") == 1, 0).otherwise(F.col("tier")).alias("tier"))


@query("J16_similar_names", """WITH q AS (SELECT unnest(['salse', 'kpi', 't12']) AS query), n AS (SELECT DISTINCT name FROM nodes WHERE type <> 'column'), c AS (SELECT query, name, CASE WHEN contains(lower(name), query) OR contains(query, lower(name)) THEN 0 ELSE levenshtein(query, lower(name)) END AS distance,
  greatest(3, ceil(len(query) * 0.4)) AS bound FROM q, n) SELECT query, rank, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, lower(name), name) AS rank FROM c WHERE distance <= bound) WHERE rank <= 3""")
def _(spark, d):
    nodes, _ = L.lineage_graph(stored_stmts(spark, d))
    return L.similar_names(nodes, ["salse", "kpi", "t12"])


@query("J17_nearest_statement", "SELECT doc_id, table_key, line, CASE WHEN doc_id IN (SELECT doc_id FROM brefs WHERE ref_type IN ('select', 'join')) THEN 0 END AS stmt_idx FROM defs WHERE def_type = 'view' OR is_ctas")
def _(spark, d):
    refs, de = catalog(spark, d)
    return C.nearest_statement(de, refs)


CTES["fk_to"] = """SELECT DISTINCT k.def_key AS target_key, c.table_key, lower(column_name) AS column_name, lower(ref_table) AS ref_table, lower(ref_column) AS ref_column FROM cols c JOIN def_keys k ON CASE WHEN instr(ref_table, '.') > 0 THEN substr(ref_table, instr(ref_table, '.') + 1) ELSE ref_table END = def_name
    AND (NOT (instr(ref_table, '.') > 0 AND has_schema) OR lower(ref_table) = def_key) WHERE ref_table IS NOT NULL"""


@query("J18_foreign_key_targets", "SELECT * FROM fk_to")
def _(spark, d):
    de = defs(spark, d)
    return C.foreign_keys_to(D.def_columns(de), def_targets(de))


@query("A19_workspace_totals", "SELECT (SELECT count(DISTINCT path) FROM qlog) AS files, (SELECT count(*) FROM defs WHERE def_type = 'table') AS tables, (SELECT count(*) FROM defs WHERE def_type = 'view') AS views, (SELECT count(*) FROM brefs) AS references, 0 AS parse_errors")
def _(spark, d):
    from suite.base import corpus
    return C.workspace_stats(corpus(spark, d), *catalog(spark, d))


@query("A20_type_counts", "SELECT type, count(*) AS n FROM nodes WHERE type IN ('table', 'view', 'cte') GROUP BY 1")
def _(spark, d):
    nodes, _ = L.lineage_graph(stored_stmts(spark, d))
    return nodes.filter(F.col("type").isin("table", "view", "cte")).groupBy("type").agg(F.count("*").alias("n"))


# --- lineage -----------------------------------------------------------------------------------------------------

@query("L1_definition_nodes", "SELECT id, type, name, file_path, definitions, files FROM def_nodes")
def _(spark, d):
    return L.definition_nodes(defs(spark, d)).select("id", "type", "name", "file_path", "definitions", "files")


@query("L1_definition_files", "SELECT DISTINCT def_type || ':' || table_key AS id, path FROM defs")
def _(spark, d):
    return L.node_files(defs(spark, d))


@query("L2_cte_nodes", "SELECT 'cte:' || cte_name AS id, cte_name AS name, min(path) AS file_path FROM ctes GROUP BY cte_name")
def _(spark, d):
    return L.cte_nodes(R.ctes(stmts(spark, d))).select("id", "name", "file_path")


@query("L3_column_nodes", "SELECT id, name, parent_id, data_type, ref_table, ref_column FROM col_nodes")
def _(spark, d):
    return L.column_nodes(D.def_columns(defs(spark, d))).select("id", "name", "parent_id", "data_type", "ref_table", "ref_column")


@query("L3_contains_edges", "SELECT parent_id AS src, id AS dst FROM col_nodes")
def _(spark, d):
    return L.contains_edges(L.column_nodes(D.def_columns(defs(spark, d)))).select("src", "dst")


@query("L4_external_nodes", "SELECT id, name FROM ext_nodes")
def _(spark, d):
    s = stored_stmts(spark, d)
    return L.external_nodes(cut(L.table_edges(s, D.definitions(s)))).select("id", "name")


@query("L5_statement_edges", "SELECT src, dst, statements, file_path FROM flow")
def _(spark, d):
    s = stored_stmts(spark, d)
    return L.table_edges(s, D.definitions(s)).select("src", "dst", "statements", "file_path")


def column_edges(spark, d):
    s = stored_stmts(spark, d)
    return L.column_edges(s, cut(D.definitions(s), "defs"))


# Input column -> output column of the kinds that write; the number of the source and target table comes from the text.
CTES["col_keys"] = """SELECT doc_id, src_key, src_column, dst_key, dst_column FROM (
    SELECT doc_id, 't' || a AS src_key, 'id' AS src_column, 't' || b AS dst_key, 'id' AS dst_column FROM qlog WHERE kind = 1 UNION ALL SELECT doc_id, 't' || a, 'v', 't' || b, 'total' FROM qlog WHERE kind = 1
    UNION ALL SELECT doc_id, 't' || a, 'id', 'v' || b, 'id' FROM qlog WHERE kind = 5 UNION ALL SELECT doc_id, 't' || a, 'k', 'v' || b, 'n' FROM qlog WHERE kind = 5
    UNION ALL SELECT doc_id, 't' || c, 'v', 't' || a, 'v' FROM qlog WHERE kind = 34 UNION ALL SELECT doc_id, 't' || a, 'id', 't' || b, 'id' FROM qlog WHERE kind = 37 UNION ALL SELECT doc_id, 'v' || c, 'id', 'raw.sales', 'id' FROM qlog WHERE kind = 40 UNION ALL SELECT doc_id, 'v' || c, 'v', 'raw.sales', 'amt' FROM qlog WHERE kind = 40
    UNION ALL SELECT doc_id, 't' || a, col, 't' || b, col FROM qlog, (VALUES ('id'), ('v')) v(col) WHERE kind = 36 UNION ALL SELECT doc_id, 't' || a, 'id', 'tmp' || b, 'id' FROM qlog WHERE kind = 39
    UNION ALL SELECT doc_id, 'raw.sales', col, 'mart.kpi', col FROM qlog, (VALUES ('amt'), ('region')) v(col) WHERE kind = 41) x"""
CTES["col_node_of"] = CTES["node_of"].replace("all_keys", "(SELECT key, CASE WHEN instr(key, '.') > 0 THEN substr(key, instr(key, '.') + 1) ELSE key END AS kname FROM (SELECT src_key AS key FROM col_keys UNION SELECT dst_key FROM col_keys))")
CTES["col_edges"] = "SELECT DISTINCT s.id AS src_id, src_column, d.id AS dst_id, dst_column FROM col_keys JOIN col_node_of s ON s.key = src_key JOIN col_node_of d ON d.key = dst_key WHERE s.id <> d.id OR src_column <> dst_column"


@query("L6_column_edges", "SELECT src_id, src_column, dst_id, dst_column FROM col_edges")
def _(spark, d):
    return column_edges(spark, d).select("src_id", "src_column", "dst_id", "dst_column")


@query("L10_operator_graph", "SELECT doc_id, stmt_idx, chain FROM chains")
def _(spark, d):
    n = O.op_nodes(stmts(spark, d)).filter("chain is not null")
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]), ">")
    return n.groupBy("doc_id", "stmt_idx").agg(chain.alias("chain"))


@query("L11_visual_graph", "SELECT id, type AS node_type, name AS label FROM nodes WHERE type <> 'column'")
def _(spark, d):
    nodes, _ = L.lineage_graph(stored_stmts(spark, d), with_columns=False)
    return nodes.select("id", F.col("type").alias("node_type"), F.col("name").alias("label"))


# --- graph -------------------------------------------------------------------------------------------------------

def first_source(edges):
    return edges.agg(F.min("src").alias("seed"))


CTES["node_kind"] = "SELECT n AS id, CASE n % 5 WHEN 0 THEN 'view' WHEN 4 THEN 'external' ELSE 'table' END AS type FROM (SELECT src AS n FROM dag UNION SELECT dst FROM dag)"
CTES["down"] = """SELECT node, min(depth) AS depth FROM (WITH RECURSIVE r(node, depth) AS (SELECT min(src), 0 FROM dag UNION SELECT dst, depth + 1 FROM r JOIN dag ON src = node WHERE depth < 20) SELECT * FROM r) WHERE depth > 0 GROUP BY node"""


def kinds_of(edges):
    ids = G.node_ids(edges)
    return ids.select(F.col("node").alias("id"), F.when(F.col("node") % 5 == 0, "view").when(F.col("node") % 5 == 4, "external").otherwise("table").alias("type"))


@query("G1_upstream", """SELECT node, min(depth) AS depth FROM (WITH RECURSIVE r(node, depth) AS (SELECT max(dst), 0 FROM dag UNION SELECT src, depth + 1 FROM r JOIN dag ON dst = node WHERE depth < 20) SELECT * FROM r) WHERE depth > 0 GROUP BY node""")
def _(spark, d):
    e = cut(X.layered_graph(spark, d))
    return G.closure(e, e.agg(F.max("dst").alias("seed")), "up").select("node", "depth")


@query("G2_downstream", "SELECT node, depth FROM down")
def _(spark, d):
    e = cut(X.layered_graph(spark, d))
    return G.closure(e, first_source(e), "down").select("node", "depth")


@query("G3_traversal_options", """SELECT node, min(depth) AS depth FROM (WITH RECURSIVE r(node, depth) AS (SELECT min(src), 0 FROM dag UNION SELECT dst, depth + 1 FROM r JOIN dag ON src = node WHERE depth < 5 AND dst % 5 <> 4) SELECT * FROM r) WHERE depth > 0 GROUP BY node""")
def _(spark, d):
    e = cut(X.layered_graph(spark, d))
    return G.closure(e, first_source(e), "down", G.clamp_depth(None), kinds_of(e), exclude_external=True).select("node", "depth")


@query("G4_both_directions", """SELECT node, min(depth) AS depth FROM (WITH RECURSIVE s AS (SELECT min(dst) AS n FROM dag WHERE dst IN (SELECT src FROM dag)), u(node, depth) AS (SELECT n, 0 FROM s UNION SELECT src, depth + 1 FROM u JOIN dag ON dst = node WHERE depth < 3),
  w(node, depth) AS (SELECT n, 0 FROM s UNION SELECT dst, depth + 1 FROM w JOIN dag ON src = node WHERE depth < 3) SELECT * FROM u UNION ALL SELECT * FROM w) WHERE depth > 0 GROUP BY node""")
def _(spark, d):
    e = cut(X.layered_graph(spark, d))
    mid = e.select(F.col("dst").alias("n")).join(e.select(F.col("src").alias("n")).distinct(), "n", "left_semi").agg(F.min("n").alias("seed"))
    return G.both_ways(e, mid, 3).select("node", "depth")


@query("G5_file_scoped_closure", """WITH RECURSIVE s AS (SELECT DISTINCT def_type || ':' || table_key AS seed FROM defs WHERE path = 'q/1.sql'), r(seed, node, depth) AS (SELECT seed, seed, 0 FROM s UNION SELECT seed, dst, depth + 1 FROM r JOIN flow ON src = node WHERE depth < (SELECT count(DISTINCT src) FROM flow))
  SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node""")
def _(spark, d):
    s = stored_stmts(spark, d)
    de = cut(D.definitions(s))
    e = cut(L.table_edges(s, de))
    seeds = de.filter("path = 'q/1.sql'").select(F.concat_ws(":", "def_type", "table_key").alias("seed")).distinct()
    return G.closure(e, seeds, "down").groupBy("node").agg(F.min("depth").alias("depth"))


@query("G6_simple_paths", """SELECT path, depth FROM (WITH RECURSIVE ends AS (SELECT min(src) AS s FROM dag), tgt AS (SELECT arg_max(node, (depth, -node)) AS t FROM down WHERE depth <= 3), r(node, path, depth) AS (SELECT s, CAST(s AS VARCHAR), 1 FROM ends UNION ALL SELECT dst, path || '|' || dst, depth + 1 FROM r JOIN dag ON src = node WHERE node <> (SELECT t FROM tgt))
  SELECT path, depth FROM r WHERE node = (SELECT t FROM tgt))""")
def _(spark, d):
    e = cut(X.layered_graph(spark, d))
    source = e.agg(F.min("src")).first()[0]
    near = G.closure(e, first_source(e), "down").filter("depth <= 3")
    target = near.agg(F.max_by("node", F.struct("depth", -F.col("node")))).first()[0]
    return join_text(G.simple_paths(e, source, target), "path")


@query("G7_shortest_path", """SELECT position, node FROM (WITH RECURSIVE tgt AS (SELECT max(node) AS t FROM down WHERE depth = (SELECT max(depth) FROM down)), b(node, k) AS (SELECT t, (SELECT depth FROM down WHERE node = t) FROM tgt UNION ALL
  SELECT (SELECT min(src) FROM dag LEFT JOIN down ON down.node = src WHERE dst = b.node AND coalesce(down.depth, CASE WHEN src = (SELECT min(src) FROM dag) THEN 0 END) = b.k - 1), k - 1 FROM b WHERE k > 0) SELECT k AS position, node FROM b)""")
def _(spark, d):
    e = cut(X.layered_graph(spark, d))
    source = e.agg(F.min("src")).first()[0]
    near = cut(G.closure(e, first_source(e), "down"))
    target = near.agg(F.max_by("node", F.struct("depth", "node"))).first()[0]
    return G.shortest_path(e, source, target)


@query("G8_root_sources", "SELECT DISTINCT id AS node FROM node_kind WHERE type <> 'external' AND id NOT IN (SELECT dst FROM dag)")
def _(spark, d):
    e = cut(X.layered_graph(spark, d))
    return G.roots(e, kinds_of(e))


@query("G9_terminal_nodes", "SELECT DISTINCT id AS node FROM node_kind WHERE type <> 'external' AND id NOT IN (SELECT src FROM dag)")
def _(spark, d):
    e = cut(X.layered_graph(spark, d))
    return G.terminals(e, kinds_of(e))


CTES["reach"] = """SELECT DISTINCT a, b FROM (WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM cyclic UNION SELECT a, dst FROM r JOIN cyclic ON src = b) SELECT * FROM r)"""


@query("G10_cycles", """SELECT cycle, length FROM (WITH RECURSIVE p(start, node, path, length) AS (SELECT src, src, CAST(src AS VARCHAR), 1 FROM cyclic WHERE src IN (SELECT a FROM reach WHERE a = b) UNION
  SELECT start, dst, path || '|' || dst, length + 1 FROM p JOIN cyclic ON src = node WHERE dst > start AND NOT contains('|' || path || '|', '|' || dst || '|') AND dst IN (SELECT a FROM reach WHERE a = b))
  SELECT DISTINCT path AS cycle, length FROM p JOIN cyclic c ON c.src = p.node AND c.dst = p.start)""")
def _(spark, d):
    return join_text(G.cycles(cut(X.wandering_graph(spark, d))), "cycle")


@query("G11_cycle_groups", """WITH pairs AS (SELECT x.a AS node, min(x.b) AS g FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT g AS group_id, node, count(*) OVER (PARTITION BY g) AS members FROM pairs""")
def _(spark, d):
    return G.cycle_groups(cut(X.wandering_graph(spark, d)))


@query("G12_components", """WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM cyclic UNION SELECT dst, src FROM cyclic UNION SELECT src, src FROM cyclic UNION SELECT dst, dst FROM cyclic), r(node, c) AS (SELECT a, a FROM u UNION SELECT b, c FROM r JOIN u ON a = node WHERE b > c)
  SELECT node, min(c) AS component FROM (SELECT node, min(c) AS c FROM r GROUP BY node) GROUP BY node""")
def _(spark, d):
    return G.components(cut(X.wandering_graph(spark, d)))


@query("G13_neighbourhood", """WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM cyclic UNION SELECT dst, src FROM cyclic), r(node, depth) AS (SELECT max(src), 0 FROM cyclic UNION SELECT b, depth + 1 FROM r JOIN u ON a = node WHERE depth < 2), n AS (SELECT DISTINCT node FROM r)
  SELECT src, dst FROM cyclic WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""")
def _(spark, d):
    e = cut(X.wandering_graph(spark, d))
    return G.neighbourhood(e, e.agg(F.max("src").alias("seed")), 2)[1]


@query("G14_induced_subgraph", "SELECT src, dst FROM cyclic WHERE src IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND dst IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, d):
    rich = spark.read.parquet(f"{d}/customer.parquet").filter("c_acctbal > 0").select(F.col("c_custkey").alias("node"))
    return G.induced(X.wandering_graph(spark, d), rich)


@query("G15_levels", """SELECT node, max(level) AS level FROM (WITH RECURSIVE r(node, level) AS (SELECT DISTINCT src, 0 FROM dag WHERE src NOT IN (SELECT dst FROM dag) UNION SELECT dst, level + 1 FROM r JOIN dag ON src = node) SELECT * FROM r) GROUP BY node""")
def _(spark, d):
    return G.levels(cut(X.layered_graph(spark, d)))


@query("G16_connection_counts", """WITH RECURSIVE k AS (SELECT id, type FROM nodes WHERE type IN ('table', 'view', 'cte')), f AS (SELECT src, dst FROM flow WHERE dst NOT LIKE 'external:%'), g AS (SELECT src, dst FROM flow WHERE src NOT LIKE 'external:%'),
  w(seed, node, depth) AS (SELECT id, id, 0 FROM k UNION SELECT seed, dst, depth + 1 FROM w JOIN f ON src = node WHERE depth < 5), u(seed, node, depth) AS (SELECT id, id, 0 FROM k UNION SELECT seed, src, depth + 1 FROM u JOIN g ON dst = node WHERE depth < 5),
  x AS (SELECT id, (SELECT count(DISTINCT node) FROM u WHERE seed = id AND node <> id) AS upstream, (SELECT count(DISTINCT node) FROM w WHERE seed = id AND node <> id) AS downstream FROM k)
  SELECT *, upstream + downstream AS total, CASE WHEN upstream + downstream = 0 THEN 'none' WHEN upstream + downstream < 3 THEN 'low' WHEN upstream + downstream < 10 THEN 'medium' ELSE 'high' END AS strength FROM x""")
def _(spark, d):
    nodes, edges = L.lineage_graph(stored_stmts(spark, d), with_columns=False)
    return G.connection_counts(edges, nodes)


@query("G17_column_trace", "SELECT src_id AS node, 'column' AS level, count(*) AS n FROM col_edges WHERE dst_id = 'external:mart.kpi' AND dst_column = 'amt' GROUP BY 1")
def _(spark, d):
    s = stored_stmts(spark, d)
    de = cut(D.definitions(s), "defs")
    return L.trace_column(cut(L.column_edges(s, de), "columns"), cut(L.table_edges(s, de)), "external:mart.kpi", "amt")


@query("G18_column_path_details", "SELECT src_id, src_column, dst_id, dst_column FROM col_edges WHERE src_column = 'id' AND dst_column = 'id'")
def _(spark, d):
    return column_edges(spark, d).filter("src_column = 'id' and dst_column = 'id'").select("src_id", "src_column", "dst_id", "dst_column")


@query("G19_column_node_lineage", """WITH RECURSIVE g AS (SELECT DISTINCT 'column:' || regexp_replace(src_id, '^[a-z]+:', '') || '.' || src_column AS src, 'column:' || regexp_replace(dst_id, '^[a-z]+:', '') || '.' || dst_column AS dst FROM col_edges), e AS (SELECT src, dst FROM g WHERE src <> dst UNION SELECT parent_id, id FROM col_nodes),
  r(node, depth) AS (SELECT 'column:raw.sales.amt', 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < (SELECT count(DISTINCT src) FROM e)), u(node, depth) AS (SELECT 'column:raw.sales.amt', 0 UNION SELECT src, depth + 1 FROM u JOIN e ON dst = node WHERE depth < 6) SELECT node, min(depth) AS depth FROM (SELECT * FROM r UNION ALL SELECT * FROM u) WHERE depth > 0 GROUP BY node""")
def _(spark, d):
    s = stored_stmts(spark, d)
    de = cut(D.definitions(s), "defs")
    e = L.column_graph(L.column_edges(s, de)).union(L.contains_edges(L.column_nodes(D.def_columns(de))).select("src", "dst"))
    seed = spark.range(1).select(F.lit("column:raw.sales.amt").alias("seed"))
    return G.both_ways(cut(e), seed).select("node", "depth")


@query("G20_flow_groups", """WITH RECURSIVE r(node) AS (SELECT 'external:raw.sales' UNION SELECT src FROM r JOIN flow ON dst = node) SELECT CASE WHEN n.type = 'external' THEN 'external' ELSE n.type END AS group_type, lower(name) AS name, count(DISTINCT n.id) AS nodes FROM r JOIN nodes n ON n.id = r.node WHERE node <> 'external:raw.sales' GROUP BY 1, 2""")
def _(spark, d):
    nodes, edges = L.lineage_graph(stored_stmts(spark, d), with_columns=False)
    seed = spark.range(1).select(F.lit("external:raw.sales").alias("seed"))
    near = G.closure(edges, seed, "up").filter("node <> 'external:raw.sales'")
    return near.join(nodes, near.node == nodes.id).groupBy(F.col("type").alias("group_type"), F.lower("name").alias("name")).agg(F.count("*").alias("nodes"))


# --- impact ------------------------------------------------------------------------------------------------------

def changes_of(de):
    """A change to every defined table and view: dropped, renamed, extended or modified by the length of its name."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("drop", "rename", "addColumn", "modify")]), (F.length("name") % 4 + 1).cast("int"))
    rows = de.select(F.col("def_type").alias("target_type"), F.col("table_key").alias("name")).distinct()
    return rows.select("*", F.concat_ws(":", "target_type", "name").alias("change_id"), F.lit(None).cast("string").alias("column_name"), kinds.alias("change_type"))


def impact_of(spark, d, files=False):
    s = stored_stmts(spark, d)
    de = cut(D.definitions(s), "defs")
    nodes, edges = L.lineage_graph(s, defs=de)
    targets = cut(M.target_ids(changes_of(de), nodes), "targets")
    fk = C.foreign_keys_to(D.def_columns(de), de.select(F.col("table_key").alias("target_key")))
    rows = cut(M.impact(nodes, edges, targets, fk, node_files=L.node_files(de) if files else None), "impact")
    return rows, targets, nodes, edges, de


CTES["changes"] = "SELECT DISTINCT def_type || ':' || table_key AS change_id, def_type || ':' || table_key AS seed, table_key AS name, def_type, list_extract(['drop', 'rename', 'addColumn', 'modify'], len(table_key) % 4 + 1) AS change_type FROM defs"
CTES["walk"] = """SELECT seed, node, min(depth) AS depth FROM (WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM edges WHERE dst NOT LIKE 'external:%'), r(seed, node, depth) AS (SELECT seed, seed, 0 FROM changes UNION SELECT seed, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 12) SELECT * FROM r) WHERE depth > 0 AND node <> seed GROUP BY seed, node"""
CTES["reached"] = "SELECT seed, count(*) AS reached FROM walk GROUP BY seed"
CTES["fk_hits"] = "SELECT DISTINCT c.seed, 'column:' || f.table_key || '.' || f.column_name AS node, 'table:' || f.table_key AS parent FROM changes c JOIN fk_to f ON f.target_key = c.name"
CTES["direct_edges"] = "SELECT DISTINCT src, dst FROM edges"
CTES["hits"] = """SELECT w.seed, w.node, n.type, n.name, n.parent_id, CASE WHEN e.src IS NULL THEN 'transitive' ELSE 'direct' END AS impact_type FROM walk w JOIN nodes n ON n.id = w.node LEFT JOIN direct_edges e ON e.src = w.seed AND e.dst = w.node
    WHERE NOT (n.type = 'column' AND starts_with(w.node, 'column:' || regexp_replace(w.seed, '^(table|view):', '') || '.')) AND NOT EXISTS (SELECT 1 FROM fk_hits f WHERE f.seed = w.seed AND f.parent = w.node)
    AND (e.src IS NOT NULL OR n.type <> 'column' OR EXISTS (SELECT 1 FROM fk_hits f WHERE f.seed = w.seed AND f.node = w.node))"""
CTES["impacts"] = """SELECT seed AS change_id, node, type, name, parent_id, impact_type FROM hits UNION ALL SELECT f.seed, f.node, 'column', n.name, n.parent_id, 'transitive' FROM fk_hits f JOIN nodes n ON n.id = f.node WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.seed = f.seed AND h.node = f.node)"""
CTES["totals"] = """SELECT c.change_id, c.change_type, c.name, c.def_type, count(i.node) AS total, count(*) FILTER (WHERE impact_type = 'direct') AS direct, count(*) FILTER (WHERE impact_type = 'transitive') AS transitive, count(DISTINCT CASE WHEN i.type = 'table' THEN i.name END) AS tables_affected,
    count(DISTINCT CASE WHEN i.type = 'view' THEN i.name END) AS views_affected FROM changes c LEFT JOIN impacts i USING (change_id) GROUP BY ALL"""
_SEVERITY = "CASE WHEN total >= 20 THEN 'critical' WHEN total >= 10 THEN 'high' WHEN total >= 3 THEN 'medium' ELSE 'low' END"


@query("I1_table_impact", "SELECT change_id, node, type, impact_type FROM impacts")
def _(spark, d):
    return impact_of(spark, d)[0].select("change_id", "node", "type", "impact_type")


@query("I2_column_data_flow", "SELECT change_id, node FROM impacts WHERE type = 'column'")
def _(spark, d):
    return impact_of(spark, d)[0].filter("type = 'column'").select("change_id", "node")


@query("I3_foreign_key_impact", "SELECT seed AS change_id, node FROM fk_hits")
def _(spark, d):
    return impact_of(spark, d)[0].filter(F.col("reason").contains("→")).select("change_id", "node")


@query("I4_same_file_filter", """WITH nf AS (SELECT DISTINCT def_type || ':' || table_key AS id, path FROM defs), tf AS (SELECT c.change_id, path FROM changes c JOIN nf ON nf.id = c.seed UNION SELECT c.change_id, file_path FROM changes c JOIN flow ON src = c.seed),
  ef AS (SELECT dst AS id, file_path AS path FROM flow) SELECT change_id, node FROM impacts i WHERE NOT (impact_type = 'transitive' AND type IN ('table', 'view')) OR EXISTS (SELECT 1 FROM tf JOIN nf ON nf.path = tf.path WHERE tf.change_id = i.change_id AND nf.id = i.node)
  OR EXISTS (SELECT 1 FROM tf JOIN ef ON ef.path = tf.path WHERE tf.change_id = i.change_id AND ef.id = i.node) OR EXISTS (SELECT 1 FROM fk_hits f WHERE f.seed = i.change_id AND f.parent = i.node)""")
def _(spark, d):
    return impact_of(spark, d, files=True)[0].select("change_id", "node")


@query("I5_column_impact", """WITH t AS (SELECT DISTINCT table_key FROM cols) SELECT 'column:' || table_key || '.w' AS change_id, 'column:' || table_key || '.w' AS node_id, true AS found FROM t
  UNION ALL SELECT 'column:' || table_key || '.absent', 'table:' || table_key, true FROM t UNION ALL SELECT 'column:nowhere.x', NULL, false""")
def _(spark, d):
    s = stored_stmts(spark, d)
    nodes, edges = L.lineage_graph(s)
    tables = nodes.filter("type = 'column'").select(F.regexp_replace("parent_id", "^table:", "").alias("name")).distinct()
    asked = tables.select("name", F.explode(F.array(F.lit("w"), F.lit("absent"))).alias("column_name")).union(spark.range(1).select(F.lit("nowhere"), F.lit("x")))
    asked = asked.select(F.concat(F.lit("column:"), "name", F.lit("."), "column_name").alias("change_id"), F.lit("column").alias("target_type"), "name", "column_name", F.lit("modify").alias("change_type"))
    targets = cut(M.target_ids(asked, nodes), "targets")
    return M.impact_summary(M.impact(nodes, edges, targets), targets).select("change_id", "node_id", "found")


@query("I6_severity", f"SELECT change_id, total AS total_affected, {_SEVERITY} AS severity FROM totals")
def _(spark, d):
    rows, targets, *_ = impact_of(spark, d)
    return M.impact_summary(rows, targets).select("change_id", "total_affected", "severity")


@query("I7_node_severity", """SELECT change_id, node, CASE WHEN type IN ('view', 'cte') THEN CASE WHEN coalesce(reached, 0) / 10.0 > 0.5 THEN 'high' ELSE 'medium' END WHEN coalesce(reached, 0) / 10.0 > 1 THEN 'high' WHEN coalesce(reached, 0) / 10.0 > 0.3 THEN 'medium' ELSE 'low' END AS severity
  FROM impacts LEFT JOIN reached ON seed = change_id""")
def _(spark, d):
    return impact_of(spark, d)[0].select("change_id", "node", "severity")


@query("I8_summary", "SELECT change_id, total AS total_affected, direct, transitive, tables_affected, views_affected, total AS queries_affected FROM totals")
def _(spark, d):
    rows, targets, *_ = impact_of(spark, d)
    return M.impact_summary(rows, targets).select("change_id", "total_affected", "direct", "transitive", "tables_affected", "views_affected", "queries_affected")


@query("I9_suggestions", f"SELECT change_id, CASE change_type WHEN 'modify' THEN 0 ELSE 2 END + CASE WHEN {_SEVERITY} IN ('critical', 'high') THEN 2 ELSE 0 END AS suggestions FROM totals")
def _(spark, d):
    rows, targets, *_ = impact_of(spark, d)
    summary = cut(M.impact_summary(rows, targets), "summary")
    n = M.suggestions(summary).groupBy("change_id").agg(F.count("*").alias("n"))
    return summary.select("change_id").join(n, "change_id", "left").select("change_id", F.coalesce("n", F.lit(0)).alias("suggestions"))


@query("I10_locations", "SELECT DISTINCT i.node, coalesce(n.file_path, p.file_path) AS file_path FROM impacts i LEFT JOIN def_nodes n ON n.id = i.node LEFT JOIN def_nodes p ON p.id = i.parent_id")
def _(spark, d):
    rows, _, nodes, edges, de = impact_of(spark, d)
    return M.locations(rows, nodes, L.node_files(de), edges).select("node", "file_path").distinct()


@query("I11_reasons", "SELECT change_id, node, CASE WHEN f.node IS NULL THEN 'Depends on table ''' || regexp_replace(change_id, '^[a-z]+:', '') || '''' ELSE 'foreign key' END AS reason FROM impacts i LEFT JOIN fk_hits f ON f.seed = i.change_id AND f.node = i.node".replace("SELECT change_id, node,", "SELECT change_id, i.node,"))
def _(spark, d):
    return impact_of(spark, d)[0].select("change_id", "node", F.when(F.col("reason").contains("→"), "foreign key").otherwise(F.col("reason")).alias("reason"))


@query("I12_by_parent_table", "SELECT change_id, CASE type WHEN 'column' THEN regexp_replace(regexp_replace(node, '^column:', ''), '\\.[^.]*$', '') WHEN 'table' THEN name WHEN 'view' THEN name ELSE 'Other' END AS parent_table, count(*) AS items FROM impacts GROUP BY 1, 2")
def _(spark, d):
    return M.by_parent(impact_of(spark, d)[0]).select("change_id", "parent_table", "items")


@query("I13_not_found", """SELECT 'table:' || table_key AS change_id, 0 AS total_affected, 2 AS suggestions FROM (SELECT DISTINCT table_key FROM brefs) WHERE table_key NOT IN (SELECT table_key FROM defs)""")
def _(spark, d):
    refs, de = catalog(spark, d)
    nodes, edges = L.lineage_graph(stored_stmts(spark, d))
    asked = refs.select(F.col("table_key").alias("name")).distinct().select(F.concat(F.lit("table:"), "name").alias("change_id"), F.lit("table").alias("target_type"), "name", F.lit(None).cast("string").alias("column_name"), F.lit("drop").alias("change_type"))
    targets = cut(M.target_ids(asked, nodes), "targets").filter("node_id is null")
    summary = cut(M.impact_summary(M.impact(nodes, edges, targets), targets), "summary")
    return summary.join(M.suggestions(summary).groupBy("change_id").agg(F.count("*").alias("suggestions")), "change_id").select("change_id", "total_affected", "suggestions")


@query("I14_change_kinds", f"SELECT change_type, {_SEVERITY} AS severity, count(*) AS changes, CAST(sum(total) AS BIGINT) AS affected FROM totals GROUP BY 1, 2")
def _(spark, d):
    rows, targets, *_ = impact_of(spark, d)
    return M.impact_summary(rows, targets).groupBy("change_type", "severity").agg(F.count("*").alias("changes"), F.sum("total_affected").alias("affected"))


# --- comparison --------------------------------------------------------------------------------------------------

def edited(log):
    """A second version of the log: one kind gains a filter, one is replaced, one is dropped, one text is new per file."""
    kind = F.col("doc_id") % X.KINDS
    sql = F.when(kind == 0, F.concat("sql", F.lit(" WHERE id = 1"))).when(kind == 10, F.regexp_replace("sql", "CROSS JOIN", "LEFT JOIN")).otherwise(F.col("sql"))
    return log.filter(kind != 3).withColumn("sql", sql)


@query("C1_node_diff", """SELECT doc_id, 'filter:where' AS node_key, 'added' AS change FROM qlog WHERE kind = 0 UNION ALL SELECT doc_id, 'join:cross join', 'removed' FROM qlog WHERE kind = 10 UNION ALL SELECT doc_id, 'join:left join', 'added' FROM qlog WHERE kind = 10""")
def _(spark, d):
    log = X.query_log(spark, d)
    side = lambda q: O.op_nodes(S.statements(q)).withColumn("signature", F.concat_ws("|", "kind", "label"))
    return K.diff_nodes(side(log), side(edited(log)), ["doc_id"]).select("doc_id", "node_key", "change")


@query("C2_stats_delta", "SELECT doc_id, stmt_idx, 0 AS joins_delta, 0 AS subqueries_delta, CASE kind WHEN 0 THEN 1 ELSE 0 END AS complexity_score_delta FROM stmts WHERE kind <> 3")
def _(spark, d):
    log = X.query_log(spark, d)
    side = lambda q: A.statement_stats(S.statements(q))
    return K.diff_stats(side(log), side(edited(log)), ["doc_id", "stmt_idx"])


@query("C4_corpus_diff", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN kind = 3 THEN 'deleted' WHEN kind IN (0, 10) THEN 'changed' WHEN kind = 5 THEN 'new' ELSE 'same' END AS state FROM qlog")
def _(spark, d):
    log = X.query_log(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), "sql")
    hashed = lambda q: q.select("path", F.sha2("sql", 256).alias("content_hash"))
    return K.diff_corpus(hashed(log.filter(F.col("doc_id") % X.KINDS != 5)), hashed(edited(log)))


@query("C5_index_merge", "SELECT CAST(doc_id AS VARCHAR) AS path, table_key, ref_type FROM brefs WHERE doc_id NOT IN (SELECT doc_id FROM qlog WHERE kind = 3)")
def _(spark, d):
    log = X.query_log(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), "sql")
    index = lambda q: R.base_table_refs(S.statements(q)).select("path", "table_key", "ref_type")
    kind = F.col("doc_id") % X.KINDS
    changed = log.filter(kind.isin(0, 3, 10)).select("path")
    return K.merge_index(index(log), changed, index(edited(log).filter(kind.isin(0, 10))))


@query("C6_result_dedupe", "SELECT id, type FROM nodes WHERE type <> 'column'")
def _(spark, d):
    nodes, edges = L.lineage_graph(stored_stmts(spark, d), with_columns=False)
    return K.dedupe_results(nodes.unionByName(nodes), edges)[0].select("id", "type")


# --- streaming ---------------------------------------------------------------------------------------------------

def feed(spark, d, root):
    """Three batches of changes: everything created, a part rewritten (some without a difference), a part deleted."""
    log = X.query_log(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), "sql")
    kind = F.col("doc_id") % X.KINDS
    def batch(rows, what, second):
        return rows.select("path", F.lit(what).alias("change_type"), F.timestamp_seconds(F.lit(second)).alias("mtime"), "sql")
    parts = [batch(log, "create", 1), batch(edited(log).filter(kind.isin(0, 10, 12)), "change", 2), batch(log.filter(kind == 3), "delete", 3)]
    for p in parts:
        p.write.mode("append").parquet(root)  # files of one change are older than those of the next
    return spark.read.schema(W.CHANGES).parquet(root)


def maintained(spark, d):
    root = scratch_path(spark, "stream")
    changes = feed(spark, d, f"{root}/feed")
    run = W.maintain_index(W.read_changes(spark, f"{root}/feed", 8), f"{root}/index")
    run.awaitTermination()
    return changes, f"{root}/index"


@query("T1_change_feed", "SELECT 'create' AS change_type, count(*) AS n FROM qlog UNION ALL SELECT 'change', count(*) FROM qlog WHERE kind IN (0, 10, 12) UNION ALL SELECT 'delete', count(*) FROM qlog WHERE kind = 3")
def _(spark, d):
    return feed(spark, d, scratch_path(spark, "feed")).groupBy("change_type").agg(F.count("*").alias("n"))


@query("T2_coalesced_changes", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN kind = 3 THEN 'delete' WHEN kind IN (0, 10, 12) THEN 'change' ELSE 'create' END AS change_type FROM qlog")
def _(spark, d):
    return W.latest(feed(spark, d, scratch_path(spark, "feed"))).select("path", "change_type")


@query("T3_unchanged_skipped", "SELECT CAST(doc_id AS VARCHAR) AS path FROM qlog WHERE kind IN (0, 10)")
def _(spark, d):
    log = X.query_log(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), "sql")
    rewritten = edited(log).filter((F.col("doc_id") % X.KINDS).isin(0, 10, 12))
    hashed = lambda q: q.select("path", F.sha2("sql", 256).alias("content_hash"))
    return hashed(rewritten).join(hashed(log), ["path", "content_hash"], "left_anti").select("path")


@query("T4_incremental_index", "SELECT CAST(doc_id AS VARCHAR) AS path, table_key, ref_type, count(*) AS n FROM brefs WHERE doc_id NOT IN (SELECT doc_id FROM qlog WHERE kind = 3) GROUP BY 1, 2, 3")
def _(spark, d):
    return W.load_index(spark, maintained(spark, d)[1])["refs"]


@query("T5_deletion", "SELECT CAST(doc_id AS VARCHAR) AS path FROM qlog WHERE kind <> 3")
def _(spark, d):
    return W.load_index(spark, maintained(spark, d)[1])["files"].select("path")


@query("T6_pending_changes", "SELECT 0 AS pending")
def _(spark, d):
    changes, root = maintained(spark, d)
    return W.pending_changes(changes, root)


def in_order(spark, d, order):
    """The parts of the feed by their second, each pushed and applied by itself; the folder of the index, and the feed."""
    root = scratch_path(spark, "late")
    parts = feed(spark, d, f"{root}/all")
    for second in order:
        parts.filter(F.col("mtime") == F.timestamp_seconds(F.lit(second))).write.mode("append").parquet(f"{root}/feed")
        W.maintain_index(W.read_changes(spark, f"{root}/feed"), f"{root}/index").awaitTermination()
    return parts, f"{root}/index"


@query("T4_late_changes", "SELECT CAST(doc_id AS VARCHAR) AS path, table_key, ref_type, count(*) AS n FROM brefs WHERE doc_id NOT IN (SELECT doc_id FROM qlog WHERE kind = 3) GROUP BY 1, 2, 3")
def _(spark, d):
    return W.load_index(spark, in_order(spark, d, (3, 2, 1))[1])["refs"]


@query("T6_pending_before_run", "SELECT count(*) AS pending FROM qlog WHERE kind = 3")
def _(spark, d):
    return W.pending_changes(*in_order(spark, d, (1, 2)))


@query("T7_stream_equals_batch", "SELECT 0 AS differences")
def _(spark, d):
    changes, root = maintained(spark, d)
    now = W.latest(changes).filter("change_type <> 'delete'").select("path", "sql")
    return W.differences(W.index_of(now), W.load_index(spark, root))


def flagship(spark, d):
    """If a table changes, what is affected? Severity and counts of every defined table and view."""
    rows, targets, *_ = impact_of(spark, d)
    return M.impact_summary(rows, targets).select("change_id", "change_type", "total_affected", "direct", "transitive", "tables_affected", "views_affected", "severity")
