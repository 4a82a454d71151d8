"""Scopes at any nesting, column lineage through them, and operator graphs."""

import pytest
from pyspark.sql import functions as F

from sqlstrata.operators import definitions as D, scopes as SC, statements as S
from sqlstrata.plans import lineage as L, opdag as O


def nested(n):
    return "SELECT s.a FROM " + "(SELECT a FROM " * n + "base1 s" + ") s" * n


# Text, and {(output column or listed target, table.column)}.
CASES = [*[("INSERT INTO tgt (x) " + nested(n), {("x", "base1.a")}) for n in (0, 1, 5, 40)],
    ("INSERT INTO tgt WITH aa AS (SELECT id, v FROM t1), bb AS (SELECT id, SUM(v) AS s FROM aa GROUP BY id) SELECT id, s FROM bb", {("id", "t1.id"), ("s", "t1.v")}),
    ("CREATE VIEW vv AS SELECT a FROM t1 UNION SELECT b FROM t2 EXCEPT SELECT c FROM (SELECT d AS c FROM t3) q", {("a", "t1.a"), ("a", "t2.b"), ("a", "t3.d")}),
    ("UPDATE tgt SET a = s.x, b = tgt.b + s.y FROM src s WHERE tgt.id = s.id", {("a", "src.x"), ("b", "tgt.b"), ("b", "src.y")}),
    ("MERGE INTO tgt t USING (SELECT id, MAX(v) AS m FROM src GROUP BY id) s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.m WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.m + 1)", {("v", "src.v"), ("id", "src.id")}),
    ("CREATE TABLE cc AS (SELECT * FROM (SELECT a, b AS bb FROM t1) d)", {("a", "t1.a"), ("bb", "t1.b")}),
    ("INSERT INTO tgt (m) SELECT COALESCE((SELECT MAX(z) FROM t2), e.q) FROM t1 e", {("m", "t2.z"), ("m", "t1.q")}),
    ("CREATE TABLE rr AS WITH RECURSIVE r AS (SELECT id, pid FROM t1 UNION ALL SELECT c.id, r.pid FROM t1 c JOIN r ON c.pid = r.id) SELECT pid FROM r", {("pid", "t1.pid")}),
    ("CREATE TABLE rr AS WITH RECURSIVE r(x, y) AS (SELECT id, pid FROM t1 UNION ALL SELECT y, x FROM r) SELECT x FROM r", {("x", "t1.id"), ("x", "t1.pid")}),
    ('INSERT INTO tgt SELECT p.x, q.y FROM "my db"."my table" p, `t-2` q', {("x", "my db.my table.x"), ("y", "t-2.y")}),
    ("INSERT INTO tgt SELECT a.x FROM t1 a JOIN t2 b ON f(a.i, b.i) = 1, t3 c WHERE c.z IN (SELECT w FROM t4)", {("x", "t1.x")}),
    ("INSERT OVERWRITE TABLE tgt SELECT id k FROM t1", {("k", "t1.id")}),
    ("SELECT EXTRACT(YEAR FROM d) AS y FROM t1", {("y", "t1.d")}),
    ("SELECT 1 AS one, 'a' AS two", set()),
    ("SELECT x FROM ((SELECT x FROM t1)) a", {("x", "t1.x")}),
    ("SELECT )( FROM", set()), ("", set()), ("(((", set()),
]


@pytest.fixture(scope="module")
def found(spark):
    """Base inputs of all texts, in one run."""
    texts = spark.createDataFrame([(i, f"f{i}.sql", t) for i, (t, _) in enumerate(CASES)], "doc_id int, path string, sql string")
    got = {}
    for r in SC.base_inputs(S.statements(texts)).collect():
        got.setdefault(r.doc_id, set()).add((r.listed[r.position] if r.listed and r.position < len(r.listed) else r.name, f"{r.table}.{r.column}"))
    return got


@pytest.mark.parametrize("i", range(len(CASES)), ids=[t[:60] for t, _ in CASES])
def test_inputs(found, i):
    assert found.get(i, set()) == CASES[i][1]


def test_kinds_follow_the_way(corpus):
    rows = SC.base_inputs(S.statements(corpus("INSERT INTO tgt SELECT q.m, q.n FROM (SELECT MAX(a) AS m, b AS n FROM t1) q"))).collect()
    assert {(r.name, r.kind) for r in rows} == {("m", "aggregate"), ("n", "alias")}


def test_edges_of_one_row_do_not_mix(spark, corpus):
    s = S.statements(corpus("INSERT INTO x1 SELECT a FROM (SELECT a FROM t1) q", "INSERT INTO x2 SELECT a FROM (SELECT a FROM t2) q"))
    got = {(r.src_id, r.dst_id) for r in L.column_edges(s, D.definitions(s)).collect()}
    assert got == {("external:t1", "external:x1"), ("external:t2", "external:x2")}


def test_column_flow_in_the_graph(corpus):
    s = S.statements(corpus("CREATE TABLE t1 (a INT)", "INSERT INTO x1 (b) SELECT a FROM t1"))
    nodes, edges = L.lineage_graph(s, column_flow=True)
    assert ("column:t1.a", "column:x1.b", "direct") in {(r.src, r.dst, r.relationship) for r in edges.collect()}
    ids = [r.id for r in nodes.collect()]
    assert len(ids) == len(set(ids)) and {"column:t1.a", "column:x1.b"} <= set(ids)


def shape(corpus, text):
    return O.shapes(S.statements(corpus(text))).first()


def test_fan_out_and_depth(corpus):
    text = "WITH hub AS (SELECT id FROM t1) SELECT a.id FROM hub a" + "".join(f" JOIN hub x{i} ON x{i}.id = a.id" for i in range(4))
    got = shape(corpus, text)
    assert (got.max_fan_out, got.critical_path, got.query_depth, got.nodes, got.cte_depth) == (5, 7, 6, 7, 1)
    found = O.fan_outs(S.statements(corpus(text))).first()
    assert (found.label, found.fan_out, found.severity) == ("hub", 5, "high")


def test_nested_ctes_count(corpus):
    assert shape(corpus, "WITH a1 AS (WITH a2 AS (WITH a3 AS (SELECT 1 AS x FROM t1) SELECT x FROM a3) SELECT x FROM a2) SELECT x FROM a1").cte_depth == 3


def test_longest_way_against_brute_force(spark):
    """Random graphs whose edges run upwards, against a walk over all ways."""
    import random
    rng, rows = random.Random(7), []
    for g in range(30):
        n = rng.randint(1, 9)
        rows.append((g, list(range(n)), [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.35]))
    df = spark.createDataFrame(rows, "g int, nodes array<int>, edges array<struct<src:int,dst:int>>")
    for r in df.select("g", O.longest_ways(F.col("nodes"), F.col("edges")).alias("w")).collect():
        _, nodes, edges = rows[r.g]
        way = {}
        for i in nodes:
            way[i] = 1 + max((way[a] for a, b in edges if b == i), default=0)
        assert r.w == [way[i] for i in nodes]


def test_graphs_need_no_shuffle(corpus):
    plan = O.graphs(S.statements(corpus("SELECT a FROM t1")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_filter_tables_stop_at_their_scope(corpus):
    rows = O.filter_tables(S.statements(corpus("SELECT a FROM (SELECT a FROM t1 WHERE a > 1) q JOIN t2 ON t2.a = q.a WHERE t2.b = 1"))).collect()
    assert {(r.scope, r.table_name) for r in rows} == {(0, "t1"), (1, "t2")}


def test_column_enters_at_its_own_join(corpus):
    rows = {r.output_name: r.steps for r in O.column_ways(S.statements(corpus("SELECT x.a, z.b AS c FROM t1 x JOIN t2 y ON x.i = y.i LEFT JOIN t3 z ON z.i = x.i"))).collect()}
    assert rows["a"] == ["t1:source", "JOIN:joined", "LEFT JOIN:joined", "SELECT:passthrough", "RESULT:passthrough"]
    assert rows["c"] == ["t3:source", "LEFT JOIN:joined", "SELECT:renamed", "RESULT:passthrough"]


def test_column_edges_look_through_writing_statements_only(corpus, monkeypatch):
    taken, real = [], SC.base_inputs
    monkeypatch.setattr(SC, "base_inputs", lambda s: taken.append(s.count()) or real(s))
    s = S.statements(corpus("SELECT a FROM t1 WHERE b = 'into'", "insert into t2 select a from t1", "Select b Into t3 From t1"))
    rows = L.column_edges(s, D.definitions(s)).select("src_column", "dst_id").collect()
    assert taken == [2] and sorted(map(tuple, rows)) == [("a", "external:t2"), ("b", "table:t3")]
