"""Queries over statements with nested scopes: column lineage, the operator graph, and what hangs on both."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlstrata import fixtures as X
from sqlstrata.operators import definitions as D, items as I, statements as S
from sqlstrata.plans import graph as G, impact as M, lineage as L, opdag as O, opgraph
from sqlstrata.session import cut
from suite.base import CTES, join_text, query


def scoped(spark, d):
    return cut(S.statements(X.scope_log(spark, d)), "scope_stmts")


def scoped_columns(spark, d):
    s = scoped(spark, d)
    return cut(L.column_edges(s, cut(D.definitions(s), "defs")), "columns")


CTES["slog"] = X.SLOG_SQL
# What each shape of text writes, read off the text: input column, output column, kind of edge.
CTES["scols"] = """SELECT doc_id, 'base' || a AS src_key, v.c AS src_column, 'w' || b AS dst_key, v.o AS dst_column, v.k AS kind FROM slog s JOIN (VALUES (1, 'c1', 'x', 'direct'), (1, 'c2', 'y', 'expression'), (2, 'id', 'id', 'direct'),
        (2, 'v', 'total', 'aggregate'), (4, 'v', 'v', 'direct'), (4, 'v', 'n', 'expression'), (4, 'z', 'n', 'expression'), (5, 'v', 'v', 'aggregate'), (5, 'id', 'id', 'direct'), (7, 'id', 'id', 'direct')) v(kind, c, o, k) ON s.kind = v.kind
    UNION ALL SELECT doc_id, 'base' || a, 'id', 'u' || a, 'k1', 'rename' FROM slog WHERE kind = 3 UNION ALL SELECT doc_id, 'side' || b, 'pid', 'u' || a, 'k1', 'rename' FROM slog WHERE kind = 3
    UNION ALL SELECT doc_id, 'deep' || b, 'q', 'u' || a, 'k1', 'rename' FROM slog WHERE kind = 3 UNION ALL SELECT doc_id, 'base' || a, 'id', 'sv' || a, 'id', 'direct' FROM slog WHERE kind = 6
    UNION ALL SELECT doc_id, 'base' || a, 'v', 'sv' || a, 'vv', 'rename' FROM slog WHERE kind = 6 UNION ALL SELECT doc_id, 'side' || b, 'z', 'w' || b, 'm', 'aggregate' FROM slog WHERE kind = 7
    UNION ALL SELECT doc_id, 'base' || a, 'id', 'rc' || a, 'id', 'direct' FROM slog WHERE kind = 8 UNION ALL SELECT doc_id, 'w' || b, 'x', 'final' || b, 'fx', 'rename' FROM slog WHERE kind = 10"""
CTES["sdefs"] = "SELECT doc_id, path, CASE kind WHEN 0 THEN 'table:base' WHEN 3 THEN 'table:u' WHEN 6 THEN 'view:sv' ELSE 'table:rc' END || a AS id FROM slog WHERE kind IN (0, 3, 6, 8)"
CTES["snode"] = "SELECT key, coalesce(min(id), 'external:' || key) AS id FROM (SELECT src_key AS key FROM scols UNION SELECT dst_key FROM scols) LEFT JOIN sdefs ON regexp_replace(id, '^[a-z]+:', '') = key GROUP BY key"
CTES["sedges"] = """SELECT s.id AS src_id, src_column, d.id AS dst_id, dst_column, min(kind) AS kind, 'column:' || src_key || '.' || src_column AS src, 'column:' || dst_key || '.' || dst_column AS dst
    FROM scols JOIN snode s ON s.key = src_key JOIN snode d ON d.key = dst_key GROUP BY ALL"""


@query("L6_scoped_column_edges", "SELECT src_id, src_column, dst_id, dst_column, kind FROM sedges")
def _(spark, d):
    return scoped_columns(spark, d).select("src_id", "src_column", "dst_id", "dst_column", "kind")


# Output columns of every statement with a select list or assignments, by place.
@query("L7_output_sources", """SELECT doc_id, position, output_name, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM (
    SELECT doc_id, v.p AS position, v.o AS output_name, v.t || CASE v.t WHEN 'base' THEN a ELSE b END || '.' || v.c AS source FROM slog s JOIN (VALUES (1, 0, 'c1', 'base', 'c1'), (1, 1, 's.c2 + 1', 'base', 'c2'), (2, 0, 'id', 'base', 'id'), (2, 1, 'total', 'base', 'v'),
      (3, 0, 'k1', 'base', 'id'), (3, 0, 'k1', 'side', 'pid'), (3, 0, 'k1', 'deep', 'q'), (4, 0, 'v', 'base', 'v'), (4, 1, 'n', 'base', 'v'), (4, 1, 'n', 'base', 'z'), (5, 0, 'v', 'base', 'v'), (5, 1, 'id', 'base', 'id'), (5, 2, 'v', 'base', 'v'),
      (6, 0, 'id', 'base', 'id'), (6, 0, 'vv', 'base', 'v'), (7, 0, '(subquery)', 'side', 'z'), (7, 1, 'id', 'base', 'id'), (8, 0, 'id', 'base', 'id'), (9, 0, 'id', 'base', 'id'), (10, 0, 'fx', 'w', 'x'), (11, 0, 'id', 'base', 'id')) v(kind, p, o, t, c) ON s.kind = v.kind)
  GROUP BY ALL""")
def _(spark, d):
    return join_text(L.output_sources(scoped(spark, d)), "sources").select("doc_id", "position", "output_name", "sources")


@query("L9_cte_dependencies", "SELECT doc_id, 'p' || i AS src_cte, 'p' || (i + 1) AS dst_cte FROM (SELECT doc_id, unnest(range(k)) AS i FROM slog WHERE kind = 2)")
def _(spark, d):
    return L.cte_dependencies(scoped(spark, d)).select("doc_id", "src_cte", "dst_cte")


@query("G17_scoped_column_trace", "SELECT src_id AS node, 'column' AS level, count(*) AS n FROM sedges WHERE dst_id = 'external:w5' AND dst_column = 'v' GROUP BY 1")
def _(spark, d):
    s = scoped(spark, d)
    de = cut(D.definitions(s), "defs")
    return L.trace_column(cut(L.column_edges(s, de), "columns"), cut(L.table_edges(s, de)), "external:w5", "v")


@query("G18_scoped_path_details", "SELECT src_id, src_column, dst_id, dst_column, kind FROM sedges WHERE dst_id LIKE 'external:%'")
def _(spark, d):
    return scoped_columns(spark, d).filter("dst_id like 'external:%'").select("src_id", "src_column", "dst_id", "dst_column", "kind")


@query("G19_scoped_column_lineage", """WITH RECURSIVE r(node, depth) AS (SELECT 'column:final5.fx', 0 UNION SELECT src, depth + 1 FROM r JOIN sedges ON dst = node WHERE depth < 6) SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node""")
def _(spark, d):
    edges = cut(L.column_graph(scoped_columns(spark, d)))
    return G.both_ways(edges, spark.range(1).select(F.lit("column:final5.fx").alias("seed"))).select("node", "depth")


def column_changes(de):
    """A change to each column of each defined table."""
    cols = D.def_columns(de).select(F.col("table_key").alias("name"), F.lower("column_name").alias("column_name")).distinct()
    return cols.select(F.concat_ws(".", "name", "column_name").alias("change_id"), F.lit("column").alias("target_type"), "name", "column_name", F.lit("rename").alias("change_type"))


def column_impact(spark, d):
    s = scoped(spark, d)
    de = cut(D.definitions(s), "defs")
    nodes, edges = L.lineage_graph(s, defs=de, column_flow=True)
    nodes, edges = cut(nodes, "nodes"), cut(edges, "edges")
    targets = cut(M.target_ids(column_changes(de), nodes), "targets")
    return cut(M.impact(nodes, edges, targets), "impact"), targets, nodes, edges, de


CTES["swalk"] = """SELECT seed, node, min(depth) AS depth FROM (WITH RECURSIVE r(seed, node, depth) AS (SELECT 'column:' || substr(id, 7) || '.' || c, 'column:' || substr(id, 7) || '.' || c, 0 FROM (SELECT DISTINCT id FROM sdefs WHERE id LIKE 'table:base%'), (VALUES ('id'), ('v'), ('z'), ('pid')) v(c)
    UNION SELECT seed, dst, depth + 1 FROM r JOIN sedges ON src = node WHERE depth < 6) SELECT * FROM r) GROUP BY seed, node"""


@query("I2_column_flow_impact", "SELECT substr(seed, 8) AS change_id, node, CASE depth WHEN 1 THEN 'direct' ELSE 'transitive' END AS impact_type FROM swalk WHERE depth > 0")
def _(spark, d):
    return column_impact(spark, d)[0].select("change_id", "node", "impact_type")


@query("I5_column_change_summary", """SELECT substr(seed, 8) AS change_id, seed AS node_id, count(*) FILTER (WHERE depth > 0) AS total_affected, count(*) FILTER (WHERE depth = 1) AS direct,
    CASE WHEN count(*) FILTER (WHERE depth > 0) >= 20 THEN 'critical' WHEN count(*) FILTER (WHERE depth > 0) >= 10 THEN 'high' WHEN count(*) FILTER (WHERE depth > 0) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM swalk GROUP BY seed""")
def _(spark, d):
    rows, targets, *_ = column_impact(spark, d)
    return M.impact_summary(rows, targets).select("change_id", "node_id", "total_affected", "direct", "severity")


@query("I8_files_affected", """WITH hit AS (SELECT seed, regexp_replace(substr(node, 8), '\\.[^.]*$', '') AS key FROM swalk WHERE depth > 0), first AS (SELECT id, min(path) AS path FROM sdefs GROUP BY id)
  SELECT substr(seed, 8) AS change_id, count(DISTINCT coalesce(path, 'Unknown')) FILTER (WHERE key IS NOT NULL) AS files_affected FROM (SELECT DISTINCT seed FROM swalk) LEFT JOIN hit USING (seed) LEFT JOIN first ON regexp_replace(id, '^[a-z]+:', '') = key GROUP BY seed""")
def _(spark, d):
    rows, targets, nodes, edges, de = column_impact(spark, d)
    located = M.locations(rows, nodes, L.node_files(de), edges)
    return M.impact_summary(rows, targets, located).select("change_id", "files_affected")


# --- operator graphs ---------------------------------------------------------------------------------------------

# Nodes, tables, fan-out, longest way, edges back from the result and CTE nesting of each shape's outermost graph.
CTES["sshape"] = """SELECT doc_id, a, b, k, s.kind, CASE s.kind WHEN 2 THEN k + 4 WHEN 9 THEN k + 3 ELSE v.nodes END AS nodes, CASE WHEN s.kind = 1 THEN CAST(k = 0 AS INTEGER) ELSE v.tables END AS tables, CASE s.kind WHEN 9 THEN k + 1 ELSE v.fan END AS max_fan_out,
    CASE s.kind WHEN 2 THEN k + 4 WHEN 9 THEN k + 3 ELSE v.way END AS critical_path, CASE s.kind WHEN 2 THEN k + 3 WHEN 9 THEN k + 2 ELSE v.depth END AS query_depth, CASE WHEN s.kind = 9 THEN 1 + k % 2 WHEN s.kind IN (2, 8) THEN 1 ELSE 0 END AS cte_depth
    FROM slog s JOIN (VALUES (0, 0, 0, 0, 0, 0), (1, 3, 0, 1, 3, 2), (2, 0, 0, 1, 0, 0), (3, 11, 2, 1, 5, 2), (4, 3, 2, 1, 2, 0), (5, 2, 1, 0, 1, 0), (6, 3, 0, 1, 3, 2), (7, 4, 1, 1, 3, 2), (8, 3, 0, 1, 3, 2), (9, 0, 0, 0, 0, 0), (10, 4, 1, 1, 4, 3), (11, 8, 1, 1, 7, 6))
      v(kind, nodes, tables, fan, way, depth) ON s.kind = v.kind"""


@query("A9_max_fan_out", "SELECT doc_id, max_fan_out FROM sshape")
def _(spark, d):
    return O.shapes(scoped(spark, d)).select("doc_id", "max_fan_out")


@query("A10_longest_way", "SELECT doc_id, critical_path FROM sshape")
def _(spark, d):
    return O.shapes(scoped(spark, d)).select("doc_id", "critical_path")


@query("A11_cte_nesting", "SELECT doc_id, cte_depth FROM sshape")
def _(spark, d):
    return O.shapes(scoped(spark, d)).select("doc_id", "cte_depth")


@query("A12_query_depth", "SELECT doc_id, query_depth FROM sshape")
def _(spark, d):
    return O.shapes(scoped(spark, d)).select("doc_id", "query_depth")


@query("A13_complex_flag", "SELECT doc_id, nodes, tables, nodes >= 8 OR tables >= 5 OR query_depth >= 3 AS is_complex FROM sshape")
def _(spark, d):
    return O.shapes(scoped(spark, d)).select("doc_id", "nodes", "tables", "is_complex")


@query("A14_levels_and_bottlenecks", """SELECT doc_id, 'join' AS kind, CASE WHEN k > 2 THEN 'medium' ELSE 'low' END AS complexity_level, k > 3 AS is_bottleneck, k AS nodes FROM slog WHERE kind = 9 AND k > 0
  UNION ALL SELECT doc_id, 'cte', NULL, true, 1 FROM slog WHERE kind = 9 AND k >= 2 UNION ALL SELECT doc_id, v.n, 'low', false, 1 FROM slog s JOIN (VALUES (2, 'aggregate'), (3, 'subquery'), (5, 'subquery'), (6, 'subquery'), (7, 'subquery'), (11, 'join'), (11, 'subquery')) v(kind, n) ON s.kind = v.kind
  UNION ALL SELECT doc_id, 'subquery', 'low', false, 1 FROM slog WHERE kind = 1 AND k > 0""")
def _(spark, d):
    rows = O.levels(scoped(spark, d)).filter("complexity_level is not null or is_bottleneck")
    return rows.groupBy("doc_id", "kind", "complexity_level", "is_bottleneck").agg(F.count("*").alias("nodes"))


@query("A18_all_operator_classes", """SELECT cluster, sum(n) AS n FROM (SELECT 'tables' AS cluster, tables AS n FROM sshape UNION ALL SELECT 'joins', CASE kind WHEN 9 THEN k WHEN 11 THEN 1 ELSE 0 END FROM slog UNION ALL SELECT 'filters', 1 FROM slog WHERE kind IN (4, 10, 11)
  UNION ALL SELECT 'aggregates', 1 FROM slog WHERE kind = 2 UNION ALL SELECT 'sorts', 1 FROM slog WHERE kind = 11 UNION ALL SELECT 'unions', 2 FROM slog WHERE kind = 3 UNION ALL SELECT 'ctes', CASE kind WHEN 2 THEN k + 1 ELSE 1 END FROM slog WHERE kind IN (2, 8, 9)
  UNION ALL SELECT 'subqueries', 1 FROM slog WHERE kind IN (3, 5, 6, 7, 11) OR (kind = 1 AND k > 0) UNION ALL SELECT 'other', CASE kind WHEN 3 THEN 6 WHEN 11 THEN 3 ELSE 2 END FROM slog WHERE kind IN (1, 2, 3, 6, 7, 8, 9, 10, 11)) GROUP BY cluster""")
def _(spark, d):
    rows = O.node_rows(scoped(spark, d)).filter("scope = top")
    return rows.groupBy(I.map_values(F.col("kind"), opgraph.CLUSTERS, "other").alias("cluster")).agg(F.count("*").alias("n"))


@query("H33_high_fan_out", "SELECT doc_id, 'cc' AS label, k + 1 AS fan_out, CASE WHEN k >= 4 THEN 'high' ELSE 'medium' END AS severity FROM slog WHERE kind = 9 AND k >= 2")
def _(spark, d):
    return O.fan_outs(scoped(spark, d)).select("doc_id", "label", "fan_out", "severity")


@query("L10_operator_edges", """SELECT doc_id, src_label, dst_label, count(*) AS edges FROM (
    SELECT doc_id, replace(replace(replace(v.s, '~k', CASE WHEN k = 0 THEN 'base~a' ELSE 's' END), '~a', a), '~b', b) AS src_label, v.d AS dst_label FROM slog s JOIN (VALUES (1, '~k', 'SELECT'), (1, 'SELECT', 'RESULT'), (2, 'GROUP BY', 'SELECT'), (2, 'SELECT', 'RESULT'),
      (3, 'base~a', 'SELECT'), (3, 'side~b', 'SELECT'), (3, 'd', 'SELECT'), (3, 'SELECT', 'RESULT'), (3, 'SELECT', 'RESULT'), (3, 'SELECT', 'RESULT'), (3, 'RESULT', 'UNION ALL'), (3, 'UNION', 'UNION ALL'), (3, 'RESULT', 'UNION'), (3, 'RESULT', 'UNION'),
      (4, 'w~b', 'WHERE'), (4, 'base~a', 'WHERE'), (6, 'd', 'SELECT'), (6, 'SELECT', 'RESULT'), (7, 'base~a', 'SELECT'), (7, '(subquery)', 'SELECT'), (7, 'SELECT', 'RESULT'), (8, 'r', 'SELECT'), (8, 'SELECT', 'RESULT'), (9, 'SELECT', 'RESULT'),
      (10, 'w~b', 'WHERE'), (10, 'WHERE', 'SELECT'), (10, 'SELECT', 'RESULT'), (11, 's', 'JOIN'), (11, 'side~b', 'JOIN'), (11, 'JOIN', 'WHERE'), (11, 'WHERE', 'SELECT'), (11, 'SELECT', 'ORDER BY'), (11, 'ORDER BY', 'LIMIT'), (11, 'LIMIT', 'RESULT')) v(kind, s, d) ON s.kind = v.kind
    UNION ALL SELECT doc_id, 'p' || i, CASE WHEN i = k THEN 'GROUP BY' ELSE 'p' || (i + 1) END FROM (SELECT doc_id, k, unnest(range(k + 1)) AS i FROM slog WHERE kind = 2)
    UNION ALL SELECT doc_id, 'cc', CASE WHEN k = 0 THEN 'SELECT' ELSE 'JOIN' END FROM (SELECT doc_id, k, unnest(range(k + 1)) FROM slog WHERE kind = 9)
    UNION ALL SELECT doc_id, 'JOIN', CASE WHEN i = k THEN 'SELECT' ELSE 'JOIN' END FROM (SELECT doc_id, k, unnest(range(1, k + 1)) AS i FROM slog WHERE kind = 9)) GROUP BY ALL""")
def _(spark, d):
    return O.edge_rows(scoped(spark, d)).filter("scope = top").groupBy("doc_id", "src_label", "dst_label").agg(F.count("*").alias("edges"))


@query("L8_column_paths", """SELECT doc_id, position, output_name, source, source || ':source|' || steps AS steps FROM (SELECT doc_id, v.p AS position, v.o AS output_name, replace(replace(replace(replace(v.s, '~k', CASE WHEN k = 0 THEN 'base~a' ELSE 's' END), '~a', a), '~b', b), '~p', 'p' || k) AS source,
    CASE WHEN s.kind = 9 THEN repeat('JOIN:joined|', k) ELSE '' END || v.w AS steps FROM slog s JOIN (VALUES (1, 0, 'c1', '~k', 'SELECT:passthrough|RESULT:passthrough'), (1, 1, 's.c2 + 1', '~k', 'SELECT:calculated|RESULT:passthrough'),
      (2, 0, 'id', '~p', 'GROUP BY:passthrough|SELECT:passthrough|RESULT:passthrough'), (2, 1, 'total', '~p', 'GROUP BY:aggregated|SELECT:aggregated|RESULT:passthrough'), (3, 0, 'k1', 'base~a', 'SELECT:renamed|RESULT:passthrough'), (3, 0, 'pid', 'side~b', 'SELECT:passthrough|RESULT:passthrough'),
      (3, 0, 'z', 'd', 'SELECT:passthrough|RESULT:passthrough'), (7, 1, 'id', 'base~a', 'SELECT:passthrough|RESULT:passthrough'), (8, 0, 'id', 'r', 'SELECT:passthrough|RESULT:passthrough'), (9, 0, 'id', 'cc', 'SELECT:passthrough|RESULT:passthrough'),
      (10, 0, 'fx', 'w~b', 'WHERE:passthrough|SELECT:renamed|RESULT:passthrough'), (11, 0, 'id', 's', 'JOIN:joined|WHERE:passthrough|SELECT:passthrough|ORDER BY:passthrough|LIMIT:passthrough|RESULT:passthrough')) v(kind, p, o, s, w) ON s.kind = v.kind)""")
def _(spark, d):
    return join_text(O.column_ways(scoped(spark, d)), "steps").select("doc_id", "position", "output_name", "source", "steps")


@query("G21_filter_sources", """SELECT doc_id, v.scope, 'WHERE' AS filter, replace(replace(v.t, '~a', a), '~b', b) AS table_name FROM slog s JOIN (VALUES (4, 0, 'w~b'), (4, 0, 'base~a'), (10, 0, 'w~b'), (11, 0, 'base~a'), (11, 1, 'side~b')) v(kind, scope, t) ON s.kind = v.kind""")
def _(spark, d):
    return O.filter_tables(scoped(spark, d)).select("doc_id", "scope", "filter", "table_name")
