"""A small workspace from files to lineage, dependencies, impact and the maintained index."""

import os

from pyspark.sql import functions as F

from sqlstrata.operators import catalog as C, compare as K, definitions as D, refs as R, statements as S
from sqlstrata.plans import impact as M, lineage as L
from sqlstrata.sources import corpus as Q, snapshot as N
from sqlstrata.streaming import index as W

FILES = {
    "clients.sql": "CREATE TABLE clients (id INT PRIMARY KEY, title VARCHAR(50));",
    "sales.sql": "CREATE TABLE sales (id INT, client_id INT REFERENCES clients(id), amount DECIMAL(10,2));",
    "report.sql": "CREATE VIEW report AS SELECT c.title, SUM(s.amount) AS spent FROM clients c JOIN sales s ON s.client_id = c.id GROUP BY c.title;",
    "load.sql": "INSERT INTO archive SELECT title, spent FROM report;\nSELECT * FROM missing_one;",
    "node_modules/skip.sql": "CREATE TABLE never (id INT);",
}


def workspace(tmp_path):
    for name, text in FILES.items():
        p = tmp_path / "ws" / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "ws")


def parts(spark, tmp_path):
    files = Q.read_corpus(spark, workspace(tmp_path))
    s = S.statements(files.withColumn("path", F.col("file_name")).withColumn("doc_id", F.col("file_name")))
    return files, s, R.base_table_refs(s), D.definitions(s)


def test_scan_skips_folders_and_caps_size(spark, tmp_path):
    root = workspace(tmp_path)
    assert sorted(r.file_name for r in Q.read_corpus(spark, root).collect()) == ["clients.sql", "load.sql", "report.sql", "sales.sql"]
    assert Q.read_corpus(spark, root, max_bytes=10).filter("parse_error is not null and sql is not null and content_hash is not null").count() == 4


def test_catalog(spark, tmp_path):
    _, s, refs, defs = parts(spark, tmp_path)
    assert sorted(r.table_key for r in C.missing(refs, defs).collect()) == ["archive", "missing_one"]
    assert [r.table_key for r in C.orphaned(refs, defs).collect()] == []
    assert sorted((r.src, r.dst, r.reference_type) for r in C.file_graph(refs, defs).collect()) == [("load.sql", "report.sql", "select"), ("report.sql", "clients.sql", "select"), ("report.sql", "sales.sql", "join")]
    assert sorted((r.src, r.dst) for r in C.table_graph(refs, defs).collect()) == [("report", "clients"), ("report", "sales")]


def test_qualified_names_resolve_to_unqualified_definitions_only(spark, corpus):
    s = S.statements(corpus("CREATE TABLE t1 (a INT)", "CREATE TABLE x.t2 (a INT)", "SELECT 1 FROM y.t1 JOIN y.t2 ON 1=1 JOIN t2 ON 1=1"))
    got = {(r.table_key, r.def_key) for r in C.resolve_refs(R.base_table_refs(s), D.definitions(s)).collect()}
    assert got == {("y.t1", "t1"), ("y.t2", None), ("t2", "x.t2")}


def test_impact(spark, tmp_path):
    _, s, _, defs = parts(spark, tmp_path)
    nodes, edges = L.lineage_graph(s)
    flow = {(r.src, r.dst) for r in edges.filter("relationship = 'flow'").collect()}
    assert flow == {("table:clients", "view:report"), ("table:sales", "view:report"), ("view:report", "external:archive")}
    asked = spark.createDataFrame([("a", "table", "clients", None, "drop"), ("b", "table", "nowhere", None, "rename"), ("c", "column", "clients", "absent", "modify")],
                                  "change_id string, target_type string, name string, column_name string, change_type string")
    targets = M.target_ids(asked, nodes)
    fk = C.foreign_keys_to(D.def_columns(defs), defs.select(F.col("table_key").alias("target_key")))
    rows = M.impact(nodes, edges, targets, fk, node_files=L.node_files(defs))
    got = {(r.change_id, r.node, r.impact_type) for r in rows.collect()}
    assert got == {(c, n, t) for c in ("a", "c") for n, t in (("view:report", "direct"), ("column:sales.client_id", "transitive"))}
    summary = {r.change_id: (r.found, r.total_affected, r.severity) for r in M.impact_summary(rows, targets).collect()}
    assert summary == {"a": (True, 2, "low"), "b": (False, 0, "low"), "c": (True, 2, "low")}
    advice = [r.suggestion for r in M.suggestions(M.impact_summary(rows, targets)).filter("change_id = 'b'").orderBy("position").collect()]
    assert advice[0] == "table 'nowhere' is in no lineage edge or definition"


def test_severity_bands(spark):
    df = spark.createDataFrame([(n,) for n in (0, 2, 3, 9, 10, 19, 20)], "n int").select(M.severity(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["low", "low", "medium", "medium", "high", "high", "critical"]


def test_column_edges(spark, tmp_path):
    _, s, _, defs = parts(spark, tmp_path)
    got = {(r.src_id, r.src_column, r.dst_id, r.dst_column, r.kind) for r in L.column_edges(s, defs).collect()}
    assert got == {("table:clients", "title", "view:report", "title", "direct"), ("table:sales", "amount", "view:report", "spent", "aggregate"),
                   ("view:report", "title", "external:archive", "title", "direct"), ("view:report", "spent", "external:archive", "spent", "direct")}


def test_similar_names(spark):
    nodes = spark.createDataFrame([("table:orders", "table", "orders"), ("table:ordrs", "table", "ordrs"), ("table:zzz", "table", "zzz_far_away")], "id string, type string, name string")
    assert [r.name for r in L.similar_names(nodes, ["order"]).orderBy("rank").collect()] == ["orders", "ordrs"]


def test_cte_dependencies(corpus):
    s = S.statements(corpus("WITH aa AS (SELECT 1 FROM t1), bb AS (SELECT 1 FROM aa) SELECT 1 FROM bb"))
    assert [(r.src_cte, r.dst_cte) for r in L.cte_dependencies(s).collect()] == [("aa", "bb")]


def test_snapshot_round_trip(spark, tmp_path):
    files, _, refs, _ = parts(spark, tmp_path)
    root = str(tmp_path / "snap")
    assert N.load_snapshot(spark, root, ["files"]) is None
    N.write_snapshot({"files": files.drop("sql"), "refs": refs}, root, "id1", now=1000.0)
    back = N.load_snapshot(spark, root, ["files", "refs"])
    assert back["refs"].count() == refs.count() and N.is_current(back["files"], files).first()[0]
    state = N.cache_state(N.read_meta(spark, root), F.lit("id1"), F.lit(N.INDEX_VERSION), F.lit(1000.0 + 3600), F.lit(24), F.lit(True))
    assert state.first().cache_state == "valid"
    assert N.cache_state(N.read_meta(spark, root), F.lit("id2"), F.lit(N.INDEX_VERSION), F.lit(0.0), F.lit(24), F.lit(True)).first().cache_state == "identity-mismatch"


def test_stream_equals_batch(spark, tmp_path):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "index")
    def push(rows):
        spark.createDataFrame(rows, "path string, change_type string, second long, sql string").select("path", "change_type", F.timestamp_seconds("second").alias("mtime"), "sql").coalesce(1).write.mode("append").parquet(feed)
    def run():
        W.maintain_index(W.read_changes(spark, feed), root).awaitTermination()
    push([("a", "create", 1, "SELECT 1 FROM t1"), ("b", "create", 1, "CREATE TABLE t1 (a INT)"), ("c", "create", 1, "SELECT 1 FROM t9")])
    run()
    first = {r.path: (r.table_key) for r in W.load_index(spark, root)["refs"].collect()}
    assert first == {"a": "t1", "c": "t9"}
    push([("a", "change", 2, "SELECT 1 FROM t2"), ("b", "change", 2, "CREATE TABLE t1 (a INT)"), ("c", "delete", 2, None), ("d", "create", 2, "SELECT 1 FROM t3"), ("d", "delete", 3, None)])
    all_changes = spark.read.schema(W.CHANGES).parquet(feed)
    assert W.pending_changes(all_changes, root).first()[0] == 2  # a rewritten, c deleted; b is equal, d came and went
    run()
    now = W.latest(all_changes).filter("change_type <> 'delete'").select("path", "sql")
    batch, stream = W.index_of(now), W.load_index(spark, root)
    for t in W.TABLES:
        cols = batch[t].columns
        assert sorted(map(tuple, batch[t].collect())) == sorted(map(tuple, stream[t].select(*cols).collect())), t
    assert W.pending_changes(all_changes, root).first()[0] == 0


def test_index_takes_changes_in_any_order(spark, tmp_path, monkeypatch):
    """Every order of batches ends in the index of the newest changes, over compactions too; old versions go."""
    monkeypatch.setattr(W, "COMPACT", 2)
    rows = [("a", "create", 1, "SELECT 1 FROM t1"), ("a", "change", 4, "SELECT 1 FROM t1"), ("a", "change", 3, "SELECT 1 FROM t2"), ("b", "create", 1, "CREATE TABLE t1 (a INT)"), ("b", "delete", 2, None),
            ("c", "delete", 2, None), ("c", "create", 2, "SELECT 1 FROM t3"), ("d", "create", None, "SELECT 1 FROM t4"), ("d", "change", 5, "SELECT 1 FROM t5"), ("e", "create", 1, "SELECT 1 FROM t6")]
    for k, order in enumerate((rows, rows[::-1], rows[5:] + rows[:5])):
        root = str(tmp_path / str(k))
        run = W.apply_batch(root)
        for i in range(0, len(order), 2):
            batch = spark.createDataFrame(order[i:i + 2], "path string, change_type string, second long, sql string").select("path", "change_type", F.timestamp_seconds("second").alias("mtime"), "sql")
            run(batch, i // 2)
            run(batch, i // 2)  # again, as after a failure
        got = W.load_index(spark, root)
        assert sorted((r.path, r.table_key) for r in got["refs"].collect()) == [("a", "t1"), ("d", "t5"), ("e", "t6")]
        assert sorted(r.path for r in got["files"].collect()) == ["a", "d", "e"] and got["defs"].count() == 0
        kept = sorted(p.name for p in (tmp_path / str(k)).iterdir() if p.name.startswith("0"))
        assert sorted(p.name for p in (tmp_path / str(k) / "log").iterdir() if not p.name.startswith(".")) == kept
        assert "000000000000.delta" not in kept and sum(n.endswith("base") for n in kept) == 2


def test_compare(spark):
    left = spark.createDataFrame([("join", "JOIN", 0, "x"), ("filter", "Where", 1, "a")], "kind string, label string, pos int, signature string").withColumn("q", F.lit(1))
    right = spark.createDataFrame([("filter", "where ", 0, "b"), ("sort", "ORDER BY", 1, "x")], "kind string, label string, pos int, signature string").withColumn("q", F.lit(1))
    assert {(r.node_key, r.change) for r in K.diff_nodes(left, right, ["q"]).collect()} == {("join:join", "removed"), ("filter:where", "changed"), ("sort:order by", "added")}


def test_differences_of_two_indexes(spark, corpus):
    files = corpus("SELECT 1 FROM t1 JOIN t2", "CREATE TABLE t3 (a INT)").select("path", "sql")
    one = W.index_of(files)
    other = one | {"refs": one["refs"].union(one["refs"].filter("table_key = 't1'")), "defs": one["defs"].limit(0).select("line", "table_key", "def_type", "path")}
    assert W.differences(one, one).collect() == [(0,)] and W.differences(one, one).dtypes == [("differences", "bigint")]
    assert W.differences(one, other).collect() == W.differences(other, one).collect() == [(2,)]  # a row that is there twice, one that lacks
    plan = W.differences(one, other)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [path") <= 2 * len(W.TABLES)  # each table of each side once: no second extraction for the way back
