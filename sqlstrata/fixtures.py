"""Inputs derived from the driver's tables: a query log with SQL text, and two edge tables.

Each input grows with its source table. The same text is written for Spark and for DuckDB from one template list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlstrata.session import spread

# One statement (or script) per kind; ~a, ~b and ~c become numbers taken from the order's keys.
TEMPLATES = [
    "SELECT * FROM raw.t~a",
    "INSERT INTO t~b SELECT x.id, SUM(x.v) AS total FROM t~a x JOIN raw.t~c y ON x.id = y.id WHERE x.d > 10 GROUP BY x.id",
    "WITH src AS (SELECT id, extra FROM t~a), spare AS (SELECT id FROM t~c) SELECT src.id FROM src ORDER BY src.id LIMIT 10",
    "UPDATE t~b SET v = 1",
    "DELETE FROM t~b WHERE id IN (SELECT id FROM t~a)",
    "CREATE VIEW v~b AS SELECT id, COUNT(DISTINCT k) AS n FROM t~a GROUP BY id",
    "CREATE TABLE t~c (id INT PRIMARY KEY, v DECIMAL(10,2) NOT NULL, p_id INT REFERENCES t~a(id), w INT, "
    "CONSTRAINT fk FOREIGN KEY (w) REFERENCES raw.t~b (w))",
    "MERGE INTO t~b USING t~a ON t~b.id = t~a.id WHEN MATCHED THEN UPDATE SET v = 1 "
    "WHEN NOT MATCHED THEN INSERT (id) VALUES (1)",
    "SELECT id FROM t~a UNION ALL SELECT id FROM t~c; -- note; no split\nSELECT ';' AS sep FROM t~b",
    "{{ config(materialized='table') }} SELECT id, ROW_NUMBER() OVER (PARTITION BY k ORDER BY d) AS rn "
    "FROM {{ ref('t~a') }} CROSS JOIN {{ source('raw', 't~c') }} WHERE UPPER(name) LIKE '%x'",
    "SELECT a.id, b.v, c.v FROM t~a a CROSS JOIN t~b b JOIN t~c c ON b.id = c.id WHERE a.id = 1 OR b.v = 2",
    "SELECT UPPER(name) AS un, v + 1 AS v1, CAST(v AS INT) AS vi, CASE WHEN v > 1 THEN 'a' ELSE 'b' END AS cs, "
    "7 AS seven, f || g AS fg FROM t~a WHERE YEAR(d) = 2020 AND LOWER(name) = 'x' AND v * 1 > 2 AND w + 0 = 3 AND n || '' = 'q'",
    "SELECT region, product, SUM(amt) AS s FROM raw.sales GROUP BY GROUPING SETS ((region, product), (region), (year))",
    "SELECT id, ROW_NUMBER() OVER (PARTITION BY k ORDER BY d DESC ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS rn "
    "FROM t~a QUALIFY rn = 1",
    "SELECT id FROM t~a WHERE NOT EXISTS (SELECT 1 FROM t~b WHERE t~b.id = t~a.id) AND id NOT IN (SELECT id FROM t~c)",
    "SELECT (SELECT MAX(v) FROM t~b) AS mx, id FROM t~a WHERE v > (SELECT AVG(v) FROM t~c WHERE v > 0) "
    "AND w > (SELECT AVG(v) FROM t~c WHERE v > 0)",
    "COPY t~b FROM 's3://bucket/f~a.csv'",
    "COPY INTO t~b FROM @stage/p~a",
    "UNLOAD ('SELECT * FROM t~a') TO 's3://bucket/out~b'",
    "CREATE EXTERNAL TABLE ext~b (id INT) LOCATION 's3://bucket/x~a'",
    "CREATE STREAM st~b ON TABLE t~a",
    "INSERT ALL WHEN v > 1 THEN INTO t~b (id) VALUES (id) ELSE INTO t~c (id) VALUES (id) SELECT id, v FROM t~a",
    "INSERT INTO t~b (id, v) VALUES (1, 2) ON CONFLICT (id) DO UPDATE SET v = 3",
    "USE WAREHOUSE wh~a; SET x = 1; SELECT id FROM t~b",
    "DROP TABLE IF EXISTS t~a; TRUNCATE TABLE t~b; ALTER TABLE t~c ADD COLUMN z INT",
    "SELECT id FROM t~a, t~b",
    "SELECT c1, c2, c3, c4, c5, c6, COUNT(*) AS n FROM t~a GROUP BY c1, c2, c3, c4, c5, c6 HAVING c1 > 1",
    "SELECT EXTRACT(YEAR FROM d) AS y FROM t~a WHERE name LIKE '%x'",
    "-- dialect: Snowflake\nSELECT f.value:name AS nm FROM t~a JOIN LATERAL FLATTEN(input => t~a.j) f ON f.seq = 1",
    "WITH RECURSIVE r AS (SELECT id, pid FROM t~a UNION ALL SELECT t.id, t.pid FROM t~a t JOIN r ON t.pid = r.id) "
    "SELECT id FROM r",
    "SELECT a.id FROM t~a a JOIN t~a b ON a.id = b.pid LEFT JOIN t~b c ON c.id = a.id RIGHT JOIN t~c d ON d.id = a.id "
    "INNER JOIN raw.sales e ON e.id = a.id FULL OUTER JOIN raw.dim f ON f.id = a.id JOIN raw.geo g ON g.id = a.id",
    "SELECT id FROM t~a UNION SELECT id, v FROM t~b",
    "CREATE OR REPLACE FUNCTION f~a() RETURNS INT AS BEGIN UPDATE t~b SET v = 1 WHERE id = 2; RETURN 1; END",
    "SELECT g.id FROM TABLE(gen_rows(10)) g JOIN UNNEST(arr) u ON u.id = g.id",
    "UPDATE x SET v = y.v FROM t~a x JOIN t~c y ON x.id = y.id WHERE x.id > 3",
    "DELETE FROM t~b USING t~a WHERE t~b.id = t~a.id",
    "CREATE TABLE t~b AS SELECT id, v FROM t~a WHERE v IS NOT NULL",
    "INSERT OVERWRITE TABLE t~b SELECT id FROM t~a",
    "/* block ; comment */ SELECT id /* inner -- x */ FROM t~a # trailing\nWHERE id = 1",
    "SELECT id INTO tmp~b FROM t~a",
    "INSERT INTO raw.sales SELECT u.id, COALESCE(u.v, 0) AS amt FROM (SELECT id, v FROM v~c) AS u JOIN raw.dim m ON m.id = u.id",
    "INSERT INTO mart.kpi SELECT SUM(s.amt) AS amt, s.region AS region FROM raw.sales s GROUP BY s.region",
    "SELECT t~a.id FROM t~a JOIN t~b ON t~a.id = t~b.id JOIN raw.dim ON dim.id = t~a.id WHERE t~a.v > 5",
    "WITH base AS (SELECT id FROM t~a) SELECT x1.id FROM base x1 JOIN base x2 ON x1.id = x2.id JOIN base x3 ON x3.id = x1.id",
    "SELECT id FROM `t~a` WHERE id IN (SELECT id FROM `t~b`) OR pid IN (SELECT id FROM `t~b`)",
    "SELECT id FROM t~a WHERE v IN (SELECT v FROM t~b) AND w IN (SELECT w FROM t~c) AND x IN (SELECT x FROM raw.dim) "
    "AND y IN (SELECT y FROM raw.geo)",
    "SELECT id FROM t~a WHERE TRIM(name) = 'a' AND CAST(v AS INT) = 1 AND COALESCE(w, 0) = 2 AND REPLACE(n, 'a', 'b') = 'c' AND ABS(z) = 3",
    "{% if target %}SELECT id FROM t~a{% else %}SELECT id FROM t~b{% endif %}",
    "DELETE FROM t~b",
    "SELECT NVL(v, 0) AS v0 FROM t~a WHERE ROWNUM < 5 CONNECT BY PRIOR id = pid",
]

KINDS = len(TEMPLATES)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`qlog(doc_id, path, sql)`: one text per order, in as many files as customers / 30."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey")
    text = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("o_orderkey") % KINDS + 1).cast("int"))
    a, b, c = "o_custkey", "o_orderkey div 10", "(o_orderkey + o_custkey) div 8"
    for mark, number in (("~a", a), ("~b", b), ("~c", c)):
        text = F.replace(text, F.lit(mark), F.expr(f"cast({number} as string)"))
    return orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.expr("concat('q/', cast(o_custkey div 30 as string), '.sql')").alias("path"),
        text.alias("sql"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QLOG_SQL = (
    "SELECT o_orderkey AS doc_id, o_orderkey % {n} AS kind, o_custkey AS a, o_orderkey // 10 AS b, "
    "(o_orderkey + o_custkey) // 8 AS c, 'q/' || CAST(o_custkey // 30 AS VARCHAR) || '.sql' AS path, "
    "replace(replace(replace(list_extract([{t}], CAST(o_orderkey % {n} + 1 AS INTEGER)), "
    "'~a', CAST(o_custkey AS VARCHAR)), '~b', CAST(o_orderkey // 10 AS VARCHAR)), "
    "'~c', CAST((o_orderkey + o_custkey) // 8 AS VARCHAR)) AS sql FROM orders"
).format(n=KINDS, t=", ".join(_quoted(t) for t in TEMPLATES))


SCOPE_KINDS = 12


def scope_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`slog(doc_id, path, sql)`: one text per customer whose shape is drawn from its key: nesting, chains of CTEs and uses of one CTE differ from row to row.

    Customers of one group share a table `base<group>`; nations number the tables that many groups write.
    """
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), "c_custkey")
    a, b, k = F.expr("cast(c_custkey div 12 as string)"), F.expr("cast(c_nationkey as string)"), F.expr("cast(c_custkey div 12 % 6 as int)")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def each(first: int, last: Column, one, between: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(first), last), lambda i: one(i)), between)
    base = text("base", a)
    chain = each(0, k, lambda i: text("p", i.cast("string"), " AS (SELECT id, v FROM ", F.when(i == 0, base).otherwise(text("p", (i - 1).cast("string"))), ")"), ", ")
    uses = F.when(k == 0, "").otherwise(each(1, F.greatest(k, F.lit(1)), lambda i: text(" JOIN cc x", i.cast("string"), " ON x", i.cast("string"), ".id = x0.id"), ""))
    texts = [
        text("CREATE TABLE ", base, " (id INT, v INT, z INT, pid INT)"),
        text("INSERT INTO w", b, " (x, y) SELECT s.c1, s.c2 + 1 FROM ", F.expr("repeat('(SELECT c1, c2 FROM ', cast(c_custkey div 12 % 6 as int) * 8)"), base, " s", F.expr("repeat(') s', cast(c_custkey div 12 % 6 as int) * 8)")),
        text("INSERT INTO w", b, " WITH ", chain, " SELECT id, SUM(v) AS total FROM p", k.cast("string"), " GROUP BY id"),
        text("CREATE TABLE u", a, " AS SELECT id AS k1 FROM ", base, " UNION ALL SELECT pid FROM side", b, " UNION SELECT z FROM (SELECT q AS z FROM deep", b, ") d"),
        text("UPDATE w", b, " SET v = s.v, n = s.v + s.z FROM ", base, " s WHERE s.id = 1"),
        text("MERGE INTO w", b, " t USING (SELECT id, MAX(v) AS mv FROM ", base, " GROUP BY id) s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.mv WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.mv)"),
        text("CREATE VIEW sv", a, " AS SELECT * FROM (SELECT id, v AS vv FROM ", base, ") d"),
        text("INSERT INTO w", b, " (m, id) SELECT (SELECT MAX(z) FROM side", b, "), e.id FROM ", base, " e"),
        text("CREATE TABLE rc", a, " AS WITH RECURSIVE r AS (SELECT id, pid FROM ", base, " UNION ALL SELECT c.id, c.pid FROM ", base, " c JOIN r ON c.pid = r.id) SELECT id FROM r"),
        text("WITH cc AS (", F.when(k % 2 == 1, text("WITH dd AS (SELECT id FROM ", base, ") SELECT id FROM dd")).otherwise(text("SELECT id FROM ", base)), ") SELECT x0.id FROM cc x0", uses),
        text("INSERT INTO final", b, " SELECT x AS fx FROM w", b, " WHERE x > 1"),
        text("SELECT s.id FROM (SELECT id, z FROM ", base, " WHERE z > 1) s JOIN side", b, " t ON t.id = s.id WHERE s.z < 9 ORDER BY s.id LIMIT 5"),
    ]
    sql = F.element_at(F.array(*texts), (F.col("c_custkey") % SCOPE_KINDS + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("doc_id"), F.expr("concat('s/', cast(c_custkey div 60 as string), '.sql')").alias("path"), sql.alias("sql"))


SLOG_SQL = ("SELECT c_custkey AS doc_id, c_custkey % 12 AS kind, CAST(c_custkey // 12 AS VARCHAR) AS a, CAST(c_nationkey AS VARCHAR) AS b, (c_custkey // 12) % 6 AS k, "
            "'s/' || CAST(c_custkey // 60 AS VARCHAR) || '.sql' AS path FROM customer")


def layered_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`dag(src, dst)`: an acyclic edge per line item from (layer, part) to (layer + 1 or 2, supplier).

    Ids are layer * 100000000 + index. Parts above the supplier range are pure sources, so width grows with the data.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    layer = F.col("l_orderkey") % 9
    return li.select(
        (layer * 100000000 + F.col("l_partkey")).alias("src"),
        ((layer + 1 + F.col("l_linenumber") % 2) * 100000000 + F.col("l_suppkey")).alias("dst"),
    ).distinct()


DAG_SQL = ("SELECT DISTINCT (l_orderkey % 9) * 100000000 + l_partkey AS src, "
           "(l_orderkey % 9 + 1 + l_linenumber % 2) * 100000000 + l_suppkey AS dst FROM lineitem")


def wandering_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`cyclic(src, dst)`: each customer and supplier points up to 12 keys away; cycles, self-loops, many components."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("src"), (F.col("c_custkey") + F.col("c_nationkey") - 12).alias("dst"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + F.col("s_nationkey") - 12).alias("dst"))
    return c.union(s).distinct()


CYCLIC_SQL = ("SELECT DISTINCT * FROM (SELECT c_custkey AS src, c_custkey + c_nationkey - 12 AS dst FROM customer "
              "UNION ALL SELECT s_suppkey, s_suppkey + s_nationkey - 12 FROM supplier)")
