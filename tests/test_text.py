"""Golden texts for splitting, comments, templates and classification."""

import pytest
from pyspark.sql import functions as F

from sqlstrata import fixtures as X
from sqlstrata.functions import text as T
from sqlstrata.operators import statements as S


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


SPLITS = [
    ("a; b", ["a", "b"]),
    ("a;;\n ; b ; -- c;\n;'x;y';", ["a", "b", "'x;y'"]),
    ("SELECT ';'; SELECT \"a;b\"; SELECT `c;d`", ["SELECT ';'", 'SELECT "a;b"', "SELECT `c;d`"]),
    ("SELECT 'it''s; ok'; x", ["SELECT 'it''s; ok'", "x"]),
    ("SELECT $t$ a;b $t$; x", ["SELECT $t$ a;b $t$", "x"]),
    ("/* a; b */ SELECT 1; # c; d\nSELECT 2", ["/* a; b */ SELECT 1", "# c; d\nSELECT 2"]),
    ("f(a;b); c", ["f(a;b)", "c"]),
    ("DELIMITER //\nCREATE PROCEDURE p() BEGIN SELECT 1; END//\nDELIMITER ;\nSELECT 2;", ["CREATE PROCEDURE p() BEGIN SELECT 1; END", "SELECT 2"]),
    ("CREATE FUNCTION f() AS BEGIN BEGIN a; END; SELECT CASE WHEN 1 THEN 2 END; END; SELECT 2", ["CREATE FUNCTION f() AS BEGIN BEGIN a; END; SELECT CASE WHEN 1 THEN 2 END; END", "SELECT 2"]),
    ("BEGIN TRANSACTION; UPDATE t SET a = 1; COMMIT", ["BEGIN TRANSACTION", "UPDATE t SET a = 1", "COMMIT"]),
    ("f" + "(" * 40 + "a;b" + ")" * 40 + "; c", ["f" + "(" * 40 + "a;b" + ")" * 40, "c"]),
    ("CREATE PROCEDURE p() " + "BEGIN x; " * 10 + "END; " * 9 + "END; SELECT 2", ["CREATE PROCEDURE p() " + "BEGIN x; " * 10 + "END; " * 9 + "END", "SELECT 2"]),
    ("CREATE PROCEDURE p() BEGIN IF a THEN b; END IF; LOOP c; END LOOP; CASE x WHEN 1 THEN y; END CASE; END; z", ["CREATE PROCEDURE p() BEGIN IF a THEN b; END IF; LOOP c; END LOOP; CASE x WHEN 1 THEN y; END CASE; END", "z"]),
    ("BEGIN TRY a; END TRY BEGIN CATCH b; END CATCH; c", ["BEGIN TRY a; END TRY BEGIN CATCH b; END CATCH", "c"]),
    ("BEGIN; a; COMMIT; f(';'; b)", ["BEGIN", "a", "COMMIT", "f(';'; b)"]),
    ("DELIMITER $$\nSELECT 1; SELECT 2$$\nSELECT (3; 4)$$\nDELIMITER ;\nSELECT 5; SELECT 6", ["SELECT 1; SELECT 2", "SELECT (3; 4)", "SELECT 5", "SELECT 6"]),
    ("CREATE TRIGGER t BEGIN SELECT 'END; it''s' ; -- END\n a; END; c", ["CREATE TRIGGER t BEGIN SELECT 'END; it''s' ; -- END\n a; END", "c"]),
    (") ; a", [")", "a"]), ("(a; b", ["(a; b"]), ("", []), ("-- only a comment", []),
]


@pytest.fixture(scope="module")
def split(spark):
    """Statements and their number of all texts, in one run each."""
    texts = spark.createDataFrame([(i, f"f{i}.sql", t) for i, (t, _) in enumerate(SPLITS)], "doc_id int, path string, sql string")
    found = {}
    for r in S.statements(texts).orderBy("doc_id", "stmt_idx").collect():
        found.setdefault(r.doc_id, []).append(r["sql"])
    return found, {r.doc_id: r.n for r in texts.select("doc_id", S.statement_count(F.col("sql")).alias("n")).collect()}


@pytest.mark.parametrize("i", range(len(SPLITS)), ids=[t[:50] for t, _ in SPLITS])
def test_split(split, i):
    assert split[0].get(i, []) == SPLITS[i][1] and split[1][i] == len(SPLITS[i][1])


def test_lines(corpus):
    rows = S.statements(corpus("a;\n\n b\n c;\nd")).orderBy("stmt_idx").select("start_line", "end_line").collect()
    assert [tuple(r) for r in rows] == [(1, 1), (3, 4), (5, 5)]


def test_long_text_neither_overflows_nor_slows(corpus):
    n = 20000
    text = ("SELECT '" + "a''b" * 5 + "' ;\n") * n
    got = S.statements(corpus(text)).agg(F.count("*"), F.max("start_line"), F.max("stmt_idx")).first()
    assert tuple(got) == (n, n, n - 1)


def test_prefix_sums_match_brute_force(spark):
    data = [[i % 3 for i in range(n)] for n in (0, 1, 2, 3, 10, 101)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "id int, v array<int>")
    held, sums = T.with_prefix_sums(df, "v")
    for r in held.select("v", sums.alias("s")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]


@pytest.mark.parametrize("text, want", [
    ("a -- b\nc", "a  \nc"), ("a /* x /* y */ z */ b", "a   b"), ("'--' \"/*\" `#`", "'--' \"/*\" `#`"), ("a # b\n#tmp", "a  \n#tmp"), ("'it -- x' -- y", "'it -- x'  "),
])
def test_comments(corpus, text, want):
    assert values(corpus(text).select(T.strip_comments(F.col("sql")).alias("x")), "x") == [want]


@pytest.mark.parametrize("text, want", [
    ("FROM {{ ref('stg') }}", "FROM stg"), ("{{ source('raw', 'c') }}", "raw.c"), ("{{ config(x=1) }}a", "a"), ("{{ this }}", "__dbt_this"), ("{{ var('d', '1') }}", "__dbt_var_d__"),
    ("{{ x + 1 }}", "__dbt_expr"), ("{# note #}a", "a"), ("{% if a %}X{% elif b %}Y{% else %}Z{% endif %}", "X"), ("{% macro m() %}body{% endmacro %}Q", "Q"), ("{% set a = 1 %}b", "b"),
])
def test_templates(corpus, text, want):
    assert values(corpus(text).select(T.normalise_template(F.col("sql")).alias("x")), "x") == [want]


@pytest.mark.parametrize("text, kind, op", [
    ("SELECT 1", "select", "SELECT"), ("WITH a AS (SELECT 1) SELECT * FROM a", "cte", "SELECT"), ("CREATE OR REPLACE VIEW v AS SELECT 1", "create_view", "CREATE_VIEW"),
    ("CREATE TABLE t AS SELECT 1", "create_table", "CREATE_TABLE_AS"), ("CREATE TEMP TABLE t (a INT)", "create_table", "CREATE_TABLE"), ("TRUNCATE t", "unknown", "TRUNCATE"), ("MERGE INTO t USING s ON 1=1", "merge", "MERGE"), ("VACUUM", "unknown", None),
])
def test_classification(corpus, text, kind, op):
    r = S.statements(corpus(text)).select(S.statement_kind(F.col("clean")), S.operation(F.col("clean"))).first()
    assert tuple(r) == (kind, op)


@pytest.mark.parametrize("text, dialect, confidence", [
    ("SELECT a FROM t QUALIFY ROW_NUMBER() OVER (ORDER BY b) = 1", None, "low"), ("SELECT * FROM db.s.t WHERE x ILIKE 'a'", "Snowflake", "high"), ("SELECT id FROM t CONNECT BY PRIOR id = pid", "Oracle", "high"),
    ("SELECT a FROM t MINUS SELECT a FROM u", None, "low"), ("SELECT a FROM t SAMPLE 10", None, "low"), ("SELECT 1", None, "none"), ("SELECT x FROM `my-t`", "MySQL", "high"), ("SELECT a FROM t LATERAL VIEW explode(x) y", "Hive", "high"),
])
def test_dialects(corpus, text, dialect, confidence):
    r = S.detected_dialect(S.dialect_markers(S.statements(corpus(text)))).first()
    assert (r.dialect, r.confidence) == (dialect, confidence)


@pytest.mark.parametrize("text, want", [("-- dialect: Snowflake\nSELECT 1", "Snowflake"), ("/* dialect: sql server */ SELECT 1", "TransactSQL"), ("-- dialect: postgres or mysql\nSELECT 1", "PostgreSQL"), ("SELECT 1 -- dialect: Oracle", None)])
def test_declared_dialect(corpus, text, want):
    assert values(corpus(text).select(S.declared_dialect(F.col("sql")).alias("x")), "x") == [want]


@pytest.mark.parametrize("text, dialect, want", [("USE WAREHOUSE w", "Snowflake", "USE WAREHOUSE"), ("USE WAREHOUSE w", "MySQL", "USE"), ("SET a = 1", "MySQL", "SET"), ("GO", "TransactSQL", "GO"), ("GO", "MySQL", None), ("SHOW TABLES IN x", "MySQL", "SHOW TABLES"), ("SELECT 1", "MySQL", None)])
def test_session_commands(corpus, text, dialect, want):
    assert values(corpus(text).select(S.session_command(F.col("sql"), F.lit(dialect)).alias("x")), "x") == [want]


@pytest.mark.parametrize("text, want", [
    ("{% if a %}x{% else %}{% if b %}y{% endif %}z{% endif %}w", "xw"),
    ("{% if a %}{% if b %}1{% else %}2{% endif %}3{% elif c %}4{% if d %}5{% else %}6{% endif %}{% else %}7{% endif %}8", "138"),
    ("{%- macro m(x) -%}{% if x %}1{% endif %}{%- endmacro -%}2", "2"),
    ("{% for t in ts %}a{% endfor %}{% set z = 1 %}b{ c", "ab{ c"),
    ("{% else %}a{% endif %}b", "ab"), ("no tags", "no tags"), ("{% if a %}" * 30 + "x" + "{% else %}y{% endif %}" * 30, "x"),
])
def test_template_blocks_at_any_nesting(corpus, text, want):
    assert corpus(text).select(T.prune_template_blocks(F.col("sql"))).first()[0] == want


def test_lines_behind_a_delimiter(corpus):
    rows = S.statements(corpus("DELIMITER //\nSELECT\n1//\nDELIMITER ;\nSELECT 2;")).orderBy("stmt_idx").select("start_line", "end_line").collect()
    assert [tuple(r) for r in rows] == [(2, 3), (5, 5)]


def test_subquery_of_forty_levels(corpus):
    from sqlstrata.operators import items as I
    deep = "SELECT a FROM " + "(SELECT a FROM " * 39 + "t1" + ")" * 39
    rows = I.subquery_rows(S.statements(corpus(f"SELECT ({deep}) AS x FROM t2 WHERE b IN (SELECT c FROM t3)"))).orderBy("position").collect()
    assert [(r.subquery.replace(" ", ""), r.location) for r in rows] == [(deep.replace(" ", ""), "select"), ("SELECTcFROMt3", "where")]


def test_one_row_group_with_many_splits_is_dealt_to_all_tasks(spark, tmp_path):
    spark.range(4000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 97).alias("o_custkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    limits = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        source = spark.read.parquet(str(tmp_path / "orders.parquet"))
        assert source.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        rows = X.query_log(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in rows) == 4000 and max(r["count"] for r in rows) < 1000


def test_session_command_strips_a_text_once_for_all_patterns(spark, corpus):
    log = corpus("-- note\nUSE WAREHOUSE w", "SELECT 1", "/* a */ SET x = 1")
    rows = log.select("doc_id", S.session_command(F.col("sql"), F.lit("Snowflake")).alias("command"))
    assert {r.doc_id: r.command for r in rows.collect()} == {0: "USE WAREHOUSE", 1: None, 2: "SET"}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


MARKED = {
    "snowflake_path_operator": "select v : a from t", "snowflake_named_args": "f(a => 1)", "flatten": "flatten (x)", "three_part_names": "from a.b.c", "qualify": "qualify x", "ilike": "a iLike b",
    "create_or_replace_table": "create or\nreplace table t", "merge_into": "merge\n into t", "bigquery_struct": "struct(1)", "bigquery_unnest": "unnest (a)", "bigquery_array_type": "array<int>",
    "postgres_interval": "interval '1 day'", "postgres_type_cast": "a:: int", "postgres_at_time_zone": "at  time zone x", "postgres_dollar_quotes": "$a$ b $a$", "postgres_array_access": "a[1]",
    "postgres_json_operators": "a ->> b", "mysql_backticks": "from `a`", "mysql_group_by_rollup": "group by a with rollup", "mysql_dual": "from dual", "tsql_apply": "cross apply f", "tsql_top": "top (3)",
    "pivot": "pivot (x)", "oracle_connect_by": "connect by x", "oracle_rownum": "rownum < 2", "oracle_nvl_decode": "nvl2(a)", "oracle_minus": "minus x", "oracle_sequence": "s. nextval",
    "oracle_outer_join_operator": "a = b (+)", "oracle_sysdate": "sysdate", "flashback": "as of scn 1", "model_clause": "model rules", "hive_lateral_view": "lateral view e", "hive_distribute_by": "distribute by a",
    "hive_cluster_by": "cluster by a", "hive_sort_by": "sort by a", "hive_serde": "row format x", "trino_rows_from": "rows from (f)", "trino_map_functions": "map_agg(a)", "external_table": "create external table t",
    "tbl_properties": "tblproperties (a)", "distkey": "distkey a", "sortkey": "sortkey a", "diststyle": "diststyle even", "redshift_copy": "copy t from x", "redshift_unload": "unload (x)",
    "sqlite_autoincrement": "autoincrement", "sqlite_glob": "a glob b", "sqlite_pragma": "pragma x", "teradata_volatile_table": "create volatile x", "teradata_multiset_or_set_table": "create set table t",
    "teradata_primary_index": "primary index (a)", "teradata_hash_functions": "hashamp(a)", "teradata_collect_stats": "collect statistics on t", "teradata_macro": "replace macro m", "teradata_join_index": "create join index i",
    "teradata_locking": "locking row for x", "teradata_sample": "sample .5", "teradata_sel_shorthand": "; sel a", "teradata_range_n": "case_n (a)", "teradata_normalize": "select normalize a", "teradata_rename_table": "rename view v",
}


def test_markers_are_tried_only_where_their_sign_stands(spark, corpus):
    from sqlstrata.functions import patterns as P
    assert set(MARKED) == {n for n, _ in P.DIALECT_MARKERS}
    rows = S.dialect_markers(corpus(*MARKED.values()).withColumn("stmt_idx", F.lit(0))).collect()
    names = list(MARKED)
    assert [names[r.doc_id] for r in rows if not r[names[r.doc_id]]] == []  # a sign never hides a match
    tried = [n for n, p in P.DIALECT_MARKERS if P.marker_sign(n, p)]
    assert len(tried) > 50 and all(P.marker_sign(n, p) in MARKED[n].upper() for n, p in P.DIALECT_MARKERS)
