"""References, definitions, items and rules on short statements."""

import pytest
from pyspark.sql import functions as F

from sqlstrata.operators import definitions as D, items as I, refs as R, rules as H, statements as S, stats as A


def refs(corpus, text, **kw):
    return sorted((r.table_key, r.ref_type) for r in R.base_table_refs(S.statements(corpus(text)), **kw).collect())


@pytest.mark.parametrize("text, want", [
    ("SELECT * FROM a1 x JOIN s.b1 AS y ON x.i = y.i", [("a1", "select"), ("s.b1", "join")]), ("INSERT INTO tgt SELECT i FROM src", [("src", "select"), ("tgt", "insert")]),
    ("DELETE FROM tt WHERE i IN (SELECT i FROM uu)", [("tt", "delete"), ("tt", "select"), ("uu", "select")]), ("UPDATE tt SET a = 1", [("tt", "update")]),
    ("SELECT 1 FROM taa, tbb x, raw.tcc AS y, (SELECT i FROM tdd) q WHERE k IN (1, 2)", [("raw.tcc", "select"), ("taa", "select"), ("tbb", "select"), ("tdd", "select")]),
    ('SELECT 1 FROM "my db"."my table" q JOIN [dbo].[a b] z ON 1=1', [("dbo.a b", "join"), ("my db.my table", "select")]), ("SELECT 1 FROM tzz, UNNEST(arr) u", [("tzz", "select")]),
    ("SELECT EXTRACT(YEAR FROM d) FROM tt", [("tt", "select")]), ("WITH c1 AS (SELECT i FROM base1) SELECT * FROM c1", [("base1", "select")]), ("SELECT * FROM (SELECT i FROM tt) AS q1 JOIN q1 ON 1=1", [("tt", "select")]),
    ("SELECT 1 FROM dual", []), ("SELECT * FROM tt -- FROM uu", [("tt", "select")]), ("SELECT * FROM tt; SELECT * FROM tt", [("tt", "select"), ("tt", "select")]), ("SELECT i FROM tt UNION SELECT i FROM TT", [("tt", "select")]),
])
def test_references(corpus, text, want):
    assert refs(corpus, text) == want


def test_more_reference_forms(corpus):
    assert refs(corpus, "MERGE INTO tgt USING src ON 1=1", extended=True) == [("src", "select"), ("tgt", "merge")]


def test_row_and_join_form_of_local_names_agree(corpus):
    s = S.statements(corpus("WITH c1 AS (SELECT i FROM base1), c2 AS (SELECT i FROM c1) SELECT * FROM c2 JOIN other1 ON 1=1", "SELECT * FROM c1"))
    pick = lambda df: sorted((r.doc_id, r.table_key) for r in df.collect())
    assert pick(R.base_table_refs(s)) == pick(R.drop_local_refs(R.table_refs(s), s)) == [(0, "base1"), (0, "other1"), (1, "c1")]


def test_columns(corpus):
    text = ("CREATE TABLE s.t1 (id INT PRIMARY KEY, v DECIMAL(10, 2) NOT NULL, p INT REFERENCES u1(id), a INT, b INT, "
            "FOREIGN KEY (a, b) REFERENCES x.w1 (c, d), CHECK (v > 0))")
    rows = D.def_columns(D.definitions(S.statements(corpus(text)))).orderBy("position").collect()
    got = [(r.column_name, r.data_type, r.nullable, r.primary_key, r.ref_table, r.ref_column) for r in rows]
    assert got == [("id", "INT", False, True, None, None), ("v", "DECIMAL(10,2)", False, False, None, None), ("p", "INT", True, False, "u1", "id"), ("a", "INT", True, False, "x.w1", "c"), ("b", "INT", True, False, "x.w1", "d")]


@pytest.mark.parametrize("item, kind", [
    ("a", "direct"), ("t.a", "direct"), ("a AS b", "alias"), ("a AS a", "direct"), ("SUM(a)", "aggregate"), ("a + 1", "arithmetic"), ("a || b", "concat"), ("UPPER(a)", "scalar"), ("CASE WHEN a THEN 1 END", "case"), ("CAST(a AS INT)", "cast"),
    ("SUM(a) OVER (PARTITION BY b)", "window"), ("(SELECT MAX(x) FROM u1)", "subquery"), ("7", "literal"), ("'x'", "literal"), ("a > b", "complex"), ("*", "direct"),
])
def test_item_kinds(corpus, item, kind):
    assert I.select_items(S.statements(corpus(f"SELECT {item} FROM t1"))).first().kind == kind


# One positive and one negative statement per rule.
RULES = {
    "H1": ("SELECT * FROM t1", "SELECT COUNT(*) FROM t1"), "H2": ("SELECT a FROM t1", "SELECT a FROM t1 LIMIT 5"), "H3": ("DELETE FROM t1", "DELETE FROM t1 WHERE a = 1"),
    "H4": ("SELECT 1 FROM t1" + " JOIN t2 ON 1=1" * 6, "SELECT 1 FROM t1 JOIN t2 ON 1=1"), "H6": ("SELECT a FROM t1, t2", "SELECT a FROM t1, t2 WHERE t1.a = t2.a"), "H7": ("WITH c AS (SELECT 1 FROM t1) SELECT 1 FROM t2", "WITH c AS (SELECT 1 FROM t1) SELECT 1 FROM c"),
    "H13": ("SELECT a FROM t1 GROUP BY a HAVING a > 1", "SELECT a FROM t1 GROUP BY a HAVING SUM(b) > 1"), "H14": ("SELECT 1 FROM t1 CROSS JOIN t2 JOIN t3 ON 1=1", "SELECT 1 FROM t1 JOIN t3 ON 1=1 CROSS JOIN t2"),
    "H17": ("SELECT 1 FROM t1 WHERE a IN (SELECT a FROM t2)", "SELECT 1 FROM t1 WHERE a NOT IN (SELECT a FROM t2)"), "H18": ("SELECT 1 FROM t1 WHERE EXISTS (SELECT 1 FROM t2 WHERE t2.a = t1.a)", "SELECT 1 FROM t1 WHERE EXISTS (SELECT 1 FROM t2)"),
    "H19": ("SELECT (SELECT MAX(a) FROM t2) FROM t1", "SELECT a FROM t1"), "H20": ("SELECT 1 FROM t1 WHERE a NOT IN (SELECT a FROM t2)", "SELECT 1 FROM t1 WHERE a IN (SELECT a FROM t2)"),
    "H22a": ("SELECT 1 FROM t1 WHERE YEAR(d) = 1", "SELECT YEAR(d) FROM t1"), "H22g": ("SELECT 1 FROM t1 WHERE ABS(x) = 1", "SELECT 1 FROM t1 WHERE x = ABS(1)"), "H23a": ("SELECT 1 FROM t1 WHERE a + 0 = 1", "SELECT 1 FROM t1 WHERE a + 1 = 1"),
    "H23b": ("SELECT 1 FROM t1 WHERE a * 1 = 1", "SELECT 1 FROM t1 WHERE a * 10 = 1"), "H23c": ("SELECT 1 FROM t1 WHERE a || '' = 'x'", "SELECT 1 FROM t1 WHERE a || 'y' = 'x'"), "H24": ("SELECT 1 FROM t1 WHERE a LIKE '%x'", "SELECT 1 FROM t1 WHERE a LIKE 'x%'"),
    "H25": ("SELECT 1 FROM t1 JOIN t2 ON 1=1 WHERE t1.a = 1 OR t2.b = 2", "SELECT 1 FROM t1 JOIN t2 ON 1=1 WHERE t1.a = 1 OR t1.b = 2"), "H26": ("SELECT 1 FROM t1 GROUP BY a, b, c, d, e, f", "SELECT 1 FROM t1 GROUP BY a, b"),
    "H27": ("SELECT COUNT(*) FROM t1", "SELECT COUNT(*) FROM t1 WHERE a = 1"), "H28": ("SELECT COUNT(DISTINCT a) FROM t1", "SELECT COUNT(a) FROM t1"), "H29": ("SELECT a FROM t1 UNION SELECT a, b FROM t2", "SELECT a FROM t1 UNION SELECT b FROM t2"),
    "H35a": ("CREATE FUNCTION f() RETURNS INT", "CREATE TABLE t1 (a INT)"),
}


def test_rules(corpus):
    texts = [t for pair in RULES.values() for t in pair]
    found = {(r.doc_id, r.rule_id) for r in H.apply_rules(H.features(S.statements(corpus(*texts))), H.statement_rules()).collect()}
    wrong = [rule for i, rule in enumerate(RULES) if (2 * i, rule) not in found or (2 * i + 1, rule) in found]
    assert wrong == []


def test_score_bounds_and_bands(corpus):
    bad = "SELECT * FROM t1 CROSS JOIN t2 JOIN t3 ON 1=1 WHERE YEAR(d) = 1 AND CAST(a AS INT) = 1 AND b LIKE '%x' AND TRIM(c) = 'a' AND x IN (SELECT x FROM t4) AND y + 0 = 1 AND z || '' = 'q'"
    s = S.statements(corpus(bad, "SELECT a FROM t1 WHERE b = 1 LIMIT 1"))
    scores = [r.performance_score for r in A.performance_scores(s, H.findings(s)).orderBy("doc_id").collect()]
    assert scores[1] == 100 and 0 <= scores[0] < 40


def test_user_rule(corpus):
    rule = H.Rule("X1", "info", "low", "custom", "short", F.length("masked") < 10)
    assert [r.rule_id for r in H.apply_rules(H.features(S.statements(corpus("SELECT 1"))), [rule]).collect()] == ["X1"]


@pytest.mark.parametrize("build", [
    lambda s: R.base_table_refs(s), lambda s: D.definitions(s), lambda s: I.select_items(s), lambda s: A.statement_stats(s), lambda s: H.apply_rules(H.features(s), H.statement_rules()), lambda s: S.detected_dialect(S.dialect_markers(s)),
], ids=["refs", "defs", "items", "stats", "rules", "dialects"])
def test_extraction_needs_no_shuffle_and_no_python(corpus, build):
    plan = build(S.statements(corpus("SELECT 1 FROM t1")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_fingerprint_ignores_case_blanks_comments_and_aliases(corpus):
    from sqlstrata.functions import text as T
    df = corpus("SELECT a FROM t1 x WHERE 1=1", "select  a\nfrom t1 AS y where 1=1 -- note", "SELECT b FROM t1 x WHERE 1=1").select("doc_id", T.fingerprint(F.col("sql")).alias("f"))
    f = {r.doc_id: r.f for r in df.collect()}
    assert f[0] == f[1] != f[2]


def test_filter_sources(corpus):
    from sqlstrata.plans import opdag as O
    rows = O.filter_tables(S.statements(corpus("SELECT a FROM t1 JOIN t2 ON 1=1 JOIN t3 ON 1=1 WHERE a = 1 GROUP BY a HAVING SUM(b) > 1")))
    assert {(r["filter"], r.table_name) for r in rows.collect()} == {(f, t) for f in ("WHERE", "HAVING") for t in ("t1", "t2", "t3")}


def test_findings_are_one_pass(corpus):
    from sqlstrata.operators import rules as H
    s = S.statements(corpus("WITH hub AS (SELECT id FROM t1) SELECT a.id FROM hub a JOIN hub b ON b.id = a.id JOIN t2 ON 1=1 JOIN t2 z ON 1=1 WHERE a.v IN (SELECT v FROM t3 WHERE k = 1) OR a.w IN (SELECT v FROM t3 WHERE k = 1)"))
    rows = H.findings(s)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = {(r.rule_id, r.message) for r in rows.collect()}
    assert {("H16", "local result hub is used 2 times"), ("H11", "t2 is read in 2 places"), ("H11", "t3 is read in 2 places"), ("H8", "2 subqueries of one shape")} <= found
    assert not any(r == "H9" for r, _ in found)


def test_repeated_values_against_a_counter(spark):
    from collections import Counter

    from sqlstrata.operators import rules as H
    data = [[], ["a"], ["b", "a", "b"], list("mississippi")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v array<string>").select("i", H.repeated(F.col("v")).alias("r"))
    assert all({(x["value"], x["n"]) for x in r.r} == {(k, n) for k, n in Counter(data[r.i]).items() if n > 1} for r in df.collect())


def test_plain_texts_skip_patterns(corpus):
    """A text is scanned for separators, comments and literals only where their marks are there, and a match is taken apart by one pattern."""
    stmts = S.statements(corpus("select 1"))
    plan = R.table_refs(stmts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan.lower()
    assert plan.count("regexp_extract(_m") == 0
    odd = corpus("  ", ";;", "a;;", "-- only\n;", "select 1 -- a;b\n; select 2 ;  ", "DELIMITER //\nselect 1 //", "\x0b select * from tt\x0c;", "select '#' from `q r`.\"s t\" u where x = ';'", "insert\ninto aa.bb select * from cc, dd ee")
    got = [(r["doc_id"], r["stmt_idx"], r["sql"], r["clean"], r["masked"]) for r in S.statements(odd).orderBy("doc_id", "stmt_idx").collect()]
    assert got == [(2, 0, "a", "a", "a"), (4, 0, "select 1 -- a;b", "select 1", "select 1"), (4, 1, "select 2", "select 2", "select 2"), (5, 0, "select 1", "select 1", "select 1"),
                   (6, 0, "select * from tt", "select * from tt", "select * from tt"),
                   (7, 0, "select '#' from `q r`.\"s t\" u where x = ';'",) + ("select '#' from `q r`.\"s t\" u where x = ';'", "select '' from `q r`.\"s t\" u where x = ''"),
                   (8, 0, *["insert\ninto aa.bb select * from cc, dd ee"] * 3)]
    refs = [(r["doc_id"], r["schema_name"], r["table_name"], r["alias"], r["context"], r["line"]) for r in R.table_refs(S.statements(odd)).orderBy("doc_id", "table_name").collect()]
    assert refs == [(6, None, "tt", None, "FROM", 1), (7, "q r", "s t", "u", "FROM", 1), (8, "aa", "bb", None, "INSERT INTO", 1), (8, None, "cc", None, "FROM", 2), (8, None, "dd", "ee", "FROM", 2)]
