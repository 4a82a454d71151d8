"""Sources (S), statements and extraction (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlstrata import fixtures as X
from sqlstrata.functions import patterns as P, registry as FR, text as T
from sqlstrata.operators import catalog as C, definitions as D, items as I, refs as R, statements as S
from sqlstrata.plans import graph as G, lineage as L
from sqlstrata.sources import corpus as Q, snapshot as N
from sqlstrata.session import scratch_path
from suite.base import base_refs, corpus, defs, join_text, query, quoted, stmts, stored_stmts


@query("S1_corpus_scan")
def _(spark, d):
    # The log written as text files in the shared folder and scanned back: one file per text, some in a skipped folder.
    root = scratch_path(spark, "corpus")
    log = X.query_log(spark, d).select(F.col("sql").alias("value"), F.when(F.col("doc_id") % 7 == 0, "node_modules").otherwise("sql").alias("folder"))
    log.select(F.regexp_replace("value", "\n", " ").alias("value"), "folder").write.partitionBy("folder").text(root)
    files = Q.scan_files(spark, root, ("txt",))
    return Q.analyse_files(files.filter(~F.col("path").contains("node_modules"))).agg(
        F.count_if(F.col("parse_error").isNotNull()).alias("unread"), F.sum(F.size(F.split(F.trim("sql"), "\n"))).alias("texts"))


@query("S2_query_log", "SELECT doc_id, path, len(sql) AS n_chars FROM qlog")
def _(spark, d):
    return corpus(spark, d).select("doc_id", "path", F.length("sql").alias("n_chars"))


@query("S3_file_analysis", """SELECT doc_id, path, CAST(strlen(sql) AS BIGINT) AS size, sha256(sql) AS content_hash,
  CASE WHEN strlen(sql) > 150 THEN 'text too large' END AS parse_error FROM qlog""")
def _(spark, d):
    return Q.from_query_log(X.query_log(spark, d), "sql", "doc_id", "path", max_bytes=150).select("doc_id", "path", "size", "content_hash", "parse_error")


@query("S4_snapshot_state", """WITH m AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 3 + CAST(o_orderkey % 5 > 0 AS INTEGER) END AS version, 'id' || (o_orderkey % 4) AS identity,
  o_orderkey % 11 = 0 AS oversized, CAST(o_orderkey % 50 AS DOUBLE) * 3600 AS age, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 24 END AS ttl, o_orderkey % 3 > 0 AS cur FROM orders)
  SELECT doc_id, CASE WHEN ttl = 0 THEN 'disabled' WHEN version IS NULL THEN 'missing' WHEN version <> 4 THEN 'version-mismatch' WHEN identity <> 'id1' THEN 'identity-mismatch'
   WHEN oversized THEN 'oversized' WHEN age > ttl * 3600 THEN 'stale' WHEN NOT cur THEN 'stale' ELSE 'valid' END AS cache_state FROM m""")
def _(spark, d):
    k = F.col("o_orderkey")
    meta = spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("doc_id"), F.when(k % 13 != 0, 3 + (k % 5 > 0).cast("int")).alias("version"), F.concat(F.lit("id"), (k % 4).cast("string")).alias("identity"),
        (k % 11 == 0).alias("oversized"), (-(k % 50) * 3600).cast("double").alias("last_updated"), F.when(k % 17 == 0, 0).otherwise(24).alias("ttl"), (k % 3 > 0).alias("cur"))
    return N.cache_state(meta, F.lit("id1"), F.lit(4), F.lit(0), F.col("ttl"), F.col("cur")).select("doc_id", "cache_state")


@query("S4_snapshot_currency", """SELECT count(*) FILTER (WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h) = 0 AS is_current FROM (SELECT doc_id, sha256(sql) AS h FROM qlog) a
  FULL JOIN (SELECT doc_id, sha256(CASE WHEN kind = 3 THEN sql || ' ' ELSE sql END) AS h FROM qlog) b USING (doc_id)""")
def _(spark, d):
    log = X.query_log(spark, d).withColumn("path", F.col("doc_id").cast("string"))
    old = log.select("path", F.sha2("sql", 256).alias("content_hash"))
    new = log.select("path", F.sha2(F.when(F.col("doc_id") % X.KINDS == 3, F.concat("sql", F.lit(" "))).otherwise(F.col("sql")), 256).alias("content_hash"))
    return N.is_current(old, new)


@query("S5_index_freshness", """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5000 > 3600 THEN 'old' WHEN o_orderkey % 5000 > 600 THEN 'stale' WHEN o_custkey % 2 > 0 THEN 'stale' ELSE 'fresh' END AS level FROM orders""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("doc_id"), N.freshness(F.col("o_orderkey") % 5000, F.col("o_custkey") % 2).alias("level"))


@query("S6_graph_sink", "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def _(spark, d):
    root = scratch_path(spark, "graph")
    nodes, edges = L.lineage_graph(stored_stmts(spark, d))
    N.write_graph(nodes, edges, root, "run1", "all")
    return spark.read.parquet(f"{root}/stats").select("type", "n")


@query("S7_issues", """WITH o AS (SELECT table_key, count(*) AS n FROM defs d WHERE table_key NOT IN (SELECT ref_key FROM ref_keys) AND table_key NOT IN (SELECT ref_name FROM ref_keys) GROUP BY 1),
  m AS (SELECT table_key, count(*) AS n, count(DISTINCT path) AS f FROM brefs WHERE table_key NOT IN (SELECT ref_key FROM resolution) GROUP BY 1)
  SELECT 'orphaned' AS issue, table_key AS name, n AS occurrences, 0 AS files FROM o UNION ALL SELECT 'missing', table_key, n, f FROM m
  UNION ALL SELECT 'parse_error', path, count(*), 1 FROM qlog WHERE strlen(sql) > 350 GROUP BY path""")
def _(spark, d):
    files = Q.from_query_log(X.query_log(spark, d), "sql", "doc_id", "path", max_bytes=350)
    return C.issues(base_refs(spark, d), defs(spark, d), files)


# --- statements --------------------------------------------------------------------------------------------------

@query("P1_statement_split", "SELECT doc_id, stmt_idx, sql FROM stmts")
def _(spark, d):
    return S.statements(X.query_log(spark, d)).select("doc_id", "stmt_idx", "sql")


@query("P2_statement_count", "SELECT doc_id, count(*) AS statements FROM stmts GROUP BY doc_id")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", S.statement_count(F.col("sql")).alias("statements"))


@query("P3_comment_strip", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(sql, '/\*(?:[^*]|\*[^/])*\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '#[^\n]*', ' ', 'g') AS stripped FROM qlog
  WHERE kind NOT IN (47) UNION ALL SELECT doc_id, sql FROM qlog WHERE kind = 47""")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", T.strip_comments(F.col("sql")).alias("stripped"))


@query("P4_literal_mask", "SELECT doc_id, regexp_replace(sql, '''[^'']*''', '''''', 'g') AS masked FROM qlog")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", T.mask_literals(F.col("sql")).alias("masked"))


@query("P5_first_keyword", r"SELECT doc_id, stmt_idx, upper(regexp_extract(clean, '^\s*(\w+)', 1)) AS keyword FROM stmts")
def _(spark, d):
    return stmts(spark, d).select("doc_id", "stmt_idx", T.leading_keyword(F.col("clean")).alias("keyword"))


@query("P6_input_validation", """WITH n AS (SELECT doc_id, count(*) AS k FROM stmts GROUP BY 1) SELECT q.doc_id, CASE WHEN strlen(sql) > 200 THEN 'size_limit' WHEN k > 2 THEN 'query_count_limit' END AS error,
  CASE WHEN strlen(sql) > 200 THEN strlen(sql) WHEN k > 2 THEN k END AS actual, CASE WHEN strlen(sql) > 200 THEN 200 WHEN k > 2 THEN 2 END AS limit_value,
  CASE WHEN strlen(sql) > 200 THEN 'bytes' WHEN k > 2 THEN 'statements' END AS unit FROM qlog q JOIN n USING (doc_id)""")
def _(spark, d):
    return Q.validate(X.query_log(spark, d), S.statement_count(F.col("sql")), 200, 2)


@query("P7_statement_kind", r"""SELECT doc_id, stmt_idx, CASE WHEN clean ILIKE 'create table%' OR clean ILIKE 'create external table%' THEN 'create_table' WHEN clean ILIKE 'create view%' THEN 'create_view'
   WHEN clean ILIKE 'with %' THEN 'cte' WHEN regexp_matches(clean, '(?i)^(select|insert|update|delete|merge)\b') THEN lower(regexp_extract(clean, '^(\w+)', 1)) ELSE 'unknown' END AS stmt_type,
  CASE WHEN clean ILIKE 'create table % as select%' THEN 'CREATE_TABLE_AS' WHEN clean ILIKE 'create view%' THEN 'CREATE_VIEW' WHEN clean ILIKE 'create table%' OR clean ILIKE 'create external table%' THEN 'CREATE_TABLE'
   WHEN clean ILIKE 'create%' THEN 'CREATE_OBJECT' WHEN clean ILIKE 'with %' THEN 'SELECT' WHEN regexp_matches(clean, '(?i)^(select|insert|update|delete|merge|replace|alter|drop|truncate)\b') THEN upper(regexp_extract(clean, '^(\w+)', 1)) END AS operation
  FROM stmts""")
def _(spark, d):
    c = F.col("clean")
    return stmts(spark, d).select("doc_id", "stmt_idx", S.statement_kind(c).alias("stmt_type"), S.operation(c).alias("operation"))


@query("P7_ddl_facts", r"""SELECT doc_id, stmt_idx, upper(regexp_extract(clean, '^(\w+)', 1)) AS action, CASE WHEN clean ILIKE 'truncate%' THEN 'TABLE' ELSE upper(regexp_extract(clean,
  '(?i)^\w+\s+(?:or\s+replace\s+)?(external table|table|view|function|stream)', 1)) END AS keyword, regexp_extract(clean, '(?i)^\w+\s+(?:or\s+replace\s+)?(?:external table|table|view|function|stream)\s+(?:if\s+exists\s+)?([^\s(;]+)', 1) AS object_name
  FROM stmts WHERE regexp_matches(clean, '(?i)^(create|alter|drop|truncate)\b')""")
def _(spark, d):
    return stmts(spark, d).select("doc_id", "stmt_idx", S.ddl_info(F.col("sql")).alias("i")).filter("i is not null").select("doc_id", "stmt_idx", "i.*")


@query("P8_session_command", """SELECT doc_id, stmt_idx, CASE WHEN clean ILIKE 'use warehouse %' THEN 'USE WAREHOUSE' ELSE 'SET' END AS command FROM stmts WHERE clean ILIKE 'use warehouse %' OR clean ILIKE 'set x =%'""")
def _(spark, d):
    return T.hold(stmts(spark, d).select("doc_id", "stmt_idx", "sql"), command=S.session_command(F.col("sql"), F.lit("Snowflake"))).drop("sql").filter("command is not null")


@query("P9_merged_runs", """SELECT doc_id, unit, n_statements, what, 1 AS start_line FROM qlog JOIN (VALUES (5, 'ddl', 1, 'CREATE VIEW'), (6, 'ddl', 1, 'CREATE TABLE'), (19, 'ddl', 1, 'CREATE EXTERNAL TABLE'), (20, 'ddl', 1, 'CREATE STREAM'),
  (23, 'session', 2, 'SET, USE WAREHOUSE'), (24, 'ddl', 3, 'ALTER TABLE, DROP TABLE, TRUNCATE TABLE'), (32, 'ddl', 1, 'CREATE FUNCTION'), (36, 'ddl', 1, 'CREATE TABLE')) v(kind, unit, n_statements, what) USING (kind)""")
def _(spark, d):
    return S.merged_runs(stmts(spark, d), "Snowflake").select("doc_id", "unit", "n_statements", "what", "start_line")


@query("P10_line_ranges", "SELECT doc_id, stmt_idx, start_line, end_line FROM stmts")
def _(spark, d):
    return stmts(spark, d).select("doc_id", "stmt_idx", "start_line", "end_line")


@query("P11_line_of_match", """SELECT doc_id, CASE WHEN instr(sql, 'FROM') = 0 THEN 1 ELSE 1 + len(left(sql, instr(sql, 'FROM') - 1)) - len(replace(left(sql, instr(sql, 'FROM') - 1), chr(10), '')) END AS line FROM qlog""")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", T.line_at(F.col("sql"), F.instr("sql", "FROM")).alias("line"))


@query("P12_template_normalise", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(sql, '\{\{\s*config\([^)]*\)\s*\}\}', '', 'g'), '\{\{\s*ref\(''([^'']+)''\)\s*\}\}', '\1', 'g'),
  '\{\{\s*source\(''([^'']+)'', ''([^'']+)''\)\s*\}\}', '\1.\2', 'g') AS plain FROM qlog WHERE kind <> 47 UNION ALL SELECT doc_id, 'SELECT id FROM t' || a FROM qlog WHERE kind = 47""")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", T.normalise_template(F.col("sql")).alias("plain"))


@query("P13_template_branches", "SELECT doc_id, CASE WHEN kind = 47 THEN 'SELECT id FROM t' || a ELSE sql END AS pruned FROM qlog")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", T.prune_template_blocks(F.col("sql")).alias("pruned"))


@query("P14_template_flag", "SELECT doc_id, kind IN (9, 47) AS has_template FROM qlog")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", T.has_template(F.col("sql")).alias("has_template"))


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


_SIMPLE_MARKERS = [(n, p) for n, p in P.DIALECT_MARKERS if "(?!" not in p and n not in P.UNMASKED_MARKERS]
_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql, '/\*(?:[^*]|\*[^/])*\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '#[^\n]*', ' ', 'g'), '''[^'']*''', '''''', 'g')"""


@query("P15_dialect_markers", "SELECT * FROM (SELECT doc_id, stmt_idx, unnest([" + ", ".join(f"CASE WHEN regexp_matches(t, '{_duck(p)}') THEN '{n}' END" for n, p in _SIMPLE_MARKERS)
       + "]) AS marker FROM (SELECT doc_id, stmt_idx, kind, " + _STRIPPED + " AS t FROM stmts)) WHERE marker IS NOT NULL UNION ALL SELECT doc_id, 0, 'snowflake_path_operator' FROM qlog WHERE kind = 28")
def _(spark, d):
    marks = S.dialect_markers(stmts(spark, d))
    hits = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n, _ in P.DIALECT_MARKERS]), lambda m: m.isNotNull())
    return marks.select("doc_id", "stmt_idx", F.explode(hits).alias("marker"))


# Points per kind of template, read off the marker table.
_SCORES = {7: "Snowflake 1, TransactSQL 1, Oracle 1", 13: "Snowflake 2, BigQuery 1, Teradata 1", 16: "Redshift 2", 18: "Redshift 3", 19: "Athena 2", 28: "Snowflake 3", 44: "MySQL 1", 49: "Oracle 6"}
_SCORE_ROWS = ", ".join(f"({k}, '{p.split()[0]}', {p.split()[1]})" for k, v in _SCORES.items() for p in v.split(", "))


@query("P16_dialect_scores", f"SELECT doc_id, 0 AS stmt_idx, dialect, score FROM qlog JOIN (VALUES {_SCORE_ROWS}) v(kind, dialect, score) USING (kind)")
def _(spark, d):
    return S.dialect_scores(S.dialect_markers(stmts(spark, d))).select("doc_id", "stmt_idx", "dialect", "score")


@query("P16_detected_dialect", """SELECT doc_id, stmt_idx, CASE kind WHEN 16 THEN 'Redshift' WHEN 18 THEN 'Redshift' WHEN 19 THEN 'Athena' WHEN 28 THEN 'Snowflake' WHEN 44 THEN 'MySQL' WHEN 49 THEN 'Oracle' END AS dialect,
  CASE WHEN kind IN (16, 18, 19, 28, 44, 49) THEN 'high' WHEN kind IN (7, 13) THEN 'low' ELSE 'none' END AS confidence FROM stmts""")
def _(spark, d):
    return S.detected_dialect(S.dialect_markers(stmts(spark, d))).select("doc_id", "stmt_idx", "dialect", "confidence")


@query("P17_dialect_directive", "SELECT doc_id, 'Snowflake' AS declared FROM qlog WHERE kind = 28")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", S.declared_dialect(F.col("sql")).alias("declared")).filter("declared is not null")


@query("P18_identifiers", """SELECT DISTINCT lower(trim(c_name)) AS name, lower(trim(c_mktsegment)) || '.' || lower(trim(c_name)) AS qualified, c_mktsegment || '.' || c_name AS display,
  split_part(lower(c_mktsegment || '.' || c_name), '.', 1) AS key_schema, split_part(lower(c_mktsegment || '.' || c_name), '.', 2) AS key_name FROM customer""")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("_k", F.lower(F.concat_ws(".", "c_mktsegment", "c_name")))
    return c.select(T.normalise_identifier(F.col("c_name")).alias("name"), T.qualified_key(F.col("c_name"), F.col("c_mktsegment")).alias("qualified"),
                    T.display_name(F.col("c_name"), F.col("c_mktsegment")).alias("display"), T.key_schema(F.col("_k")).alias("key_schema"), T.key_name(F.col("_k")).alias("key_name")).distinct()


@query("P19_table_references", "SELECT doc_id, stmt_idx, schema_name, table_name, table_key, nullif(alias0, '~') AS alias, ref_type, context, line FROM refs")
def _(spark, d):
    return R.table_refs(stmts(spark, d)).select("doc_id", "stmt_idx", "schema_name", "table_name", "table_key", "alias", "ref_type", "context", "line")


@query("P20_function_from", r"SELECT doc_id, regexp_replace(sql, '(?i)\b(extract|substring|trim|position)(\s*\()[^()]*\)', '\1\2)', 'g') AS blanked FROM qlog")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", R.without_function_from(F.col("sql")).alias("blanked"))


@query("P21_more_reference_forms", "SELECT doc_id, stmt_idx, table_key, ref_type FROM refx GROUP BY ALL")
def _(spark, d):
    return R.table_refs(stmts(spark, d), extended=True).select("doc_id", "stmt_idx", "table_key", "ref_type").distinct()


@query("P22_table_names", f"SELECT DISTINCT lower(n_name) AS name, lower(n_name) NOT IN ({quoted(sorted(set(P.REFERENCE_RESERVED)))}) AND len(n_name) >= 2 AS ok FROM (SELECT n_name FROM nation UNION ALL SELECT unnest(regexp_extract_all(sql, '[A-Za-z_]+')) FROM qlog)")
def _(spark, d):
    words = X.query_log(spark, d).select(F.explode(T.rx_all(F.col("sql"), "[A-Za-z_]+")).alias("w")).union(spark.read.parquet(f"{d}/nation.parquet").select("n_name"))
    return words.select(F.lower("w").alias("name"), R.is_table_name(F.col("w")).alias("ok")).distinct()


@query("P23_reference_dedupe", "SELECT table_key, ref_type, count(*) AS references FROM refs GROUP BY 1, 2")
def _(spark, d):
    return R.table_refs(stmts(spark, d)).groupBy("table_key", "ref_type").agg(F.count("*").alias("references"))


@query("P24_ctes", "SELECT doc_id, stmt_idx, position, cte_name, is_recursive, line FROM ctes")
def _(spark, d):
    return R.ctes(stmts(spark, d)).select("doc_id", "stmt_idx", "position", "cte_name", "is_recursive", "line")


@query("P25_local_references_dropped", "SELECT doc_id, stmt_idx, table_key, ref_type FROM brefs")
def _(spark, d):
    return base_refs(spark, d).select("doc_id", "stmt_idx", "table_key", "ref_type")


@query("P26_definitions", "SELECT doc_id, stmt_idx, def_type, name, table_key, line FROM defs")
def _(spark, d):
    return defs(spark, d).select("doc_id", "stmt_idx", "def_type", "name", "table_key", "line")


@query("P27_definition_columns", "SELECT doc_id, table_key, position, column_name, data_type, nullable, primary_key, CASE position WHEN 2 THEN ref_table END AS inline_key FROM cols")
def _(spark, d):
    return D.def_columns(defs(spark, d)).select("doc_id", "table_key", "position", "column_name", "data_type", "nullable", "primary_key", F.when(F.col("position") == 2, F.col("ref_table")).alias("inline_key"))


@query("P28_foreign_keys", "SELECT doc_id, table_key, column_name, ref_table, ref_column FROM cols WHERE ref_table IS NOT NULL")
def _(spark, d):
    return D.def_columns(defs(spark, d)).filter("ref_table is not null").select("doc_id", "table_key", "column_name", "ref_table", "ref_column")


@query("P29_ctas_flag", "SELECT doc_id, table_key, is_ctas FROM defs")
def _(spark, d):
    return defs(spark, d).select("doc_id", "table_key", "is_ctas")


# Select items per kind of template: position, output name, kind, source table (a, b, c: with the number of the text).
_ITEMS = [
    (0, 0, "*", "direct", "raw.t", "a"), (1, 0, "id", "direct", "t", "a"), (1, 1, "total", "aggregate", "", ""), (2, 0, "id", "direct", "src", ""), (5, 0, "id", "direct", "t", "a"), (5, 1, "n", "aggregate", "", ""),
    (8, 0, "id", "direct", "", ""), (9, 0, "id", "direct", "", ""), (9, 1, "rn", "window", "", ""), (10, 0, "id", "direct", "t", "a"), (10, 1, "v", "direct", "t", "b"), (10, 2, "v", "direct", "t", "c"),
    (11, 0, "un", "scalar", "", ""), (11, 1, "v1", "arithmetic", "", ""), (11, 2, "vi", "cast", "", ""), (11, 3, "cs", "case", "", ""), (11, 4, "seven", "literal", "", ""), (11, 5, "fg", "concat", "", ""),
    (12, 0, "region", "direct", "raw.sales", ""), (12, 1, "product", "direct", "raw.sales", ""), (12, 2, "s", "aggregate", "", ""), (13, 0, "id", "direct", "t", "a"), (13, 1, "rn", "window", "", ""),
    (14, 0, "id", "direct", "t", "a"), (15, 0, "mx", "subquery", "", ""), (15, 1, "id", "direct", "t", "a"), (21, 0, "id", "direct", "t", "a"), (21, 1, "v", "direct", "t", "a"), (25, 0, "id", "direct", "", ""),
    *[(26, i, f"c{i + 1}", "direct", "t", "a") for i in range(6)], (26, 6, "n", "aggregate", "", ""), (27, 0, "y", "scalar", "", ""), (28, 0, "nm", "complex", "", ""), (29, 0, "id", "direct", "", ""), (30, 0, "id", "direct", "t", "a"),
    (31, 0, "id", "direct", "", ""), (33, 0, "id", "direct", "", ""), (36, 0, "id", "direct", "t", "a"), (36, 1, "v", "direct", "t", "a"), (37, 0, "id", "direct", "t", "a"), (38, 0, "id", "direct", "t", "a"), (39, 0, "id", "direct", "t", "a"),
    (40, 0, "id", "direct", "", ""), (40, 1, "amt", "scalar", "", ""), (41, 0, "amt", "aggregate", "", ""), (41, 1, "region", "direct", "raw.sales", ""), (42, 0, "id", "direct", "t", "a"), (43, 0, "id", "direct", "base", ""),
    (44, 0, "id", "direct", "t", "a"), (45, 0, "id", "direct", "t", "a"), (46, 0, "id", "direct", "t", "a"), (47, 0, "id", "direct", "t", "a"), (49, 0, "v0", "scalar", "", ""),
]
_ITEM_SQL = ("SELECT q.doc_id, 0 AS stmt_idx, position, output_name, item_kind AS kind, CASE WHEN prefix <> '' THEN prefix || CASE num WHEN 'a' THEN CAST(a AS VARCHAR) WHEN 'b' THEN CAST(b AS VARCHAR) WHEN 'c' THEN CAST(c AS VARCHAR) ELSE '' END END AS source_table "
             "FROM qlog q JOIN (VALUES " + ", ".join(str(i) for i in _ITEMS) + ") v(kind, position, output_name, item_kind, prefix, num) ON q.kind = v.kind "
             "UNION ALL SELECT doc_id, 1, 0, 'sep', 'literal', NULL FROM qlog WHERE kind = 8 UNION ALL SELECT doc_id, 2, 0, 'id', 'direct', 't' || b FROM qlog WHERE kind = 23")


@query("P30_select_items", _ITEM_SQL)
def _(spark, d):
    return I.select_items(stmts(spark, d)).select("doc_id", "stmt_idx", "position", "output_name", "kind", "source_table")


@query("P31_column_uses")
def _(spark, d):
    return I.column_uses(stmts(spark, d)).groupBy("used_in", "column_ref").agg(F.count("*").alias("statements"))


@query("P32_transformation_kinds", f"SELECT kind, count(*) AS items FROM ({_ITEM_SQL}) GROUP BY kind")
def _(spark, d):
    return I.select_items(stmts(spark, d)).groupBy("kind").agg(F.count("*").alias("items"))


@query("P33_edge_kinds", f"""SELECT CASE kind WHEN 'direct' THEN 'direct' WHEN 'alias' THEN 'rename' WHEN 'aggregate' THEN 'aggregate' WHEN 'case' THEN 'case' WHEN 'cast' THEN 'cast' WHEN 'literal' THEN 'unknown' WHEN 'complex' THEN 'unknown' ELSE 'expression' END AS edge_kind,
  CASE WHEN kind IN ('direct', 'alias') THEN 'direct' WHEN kind = 'aggregate' THEN 'aggregate' ELSE 'transform' END AS edge_type, count(*) AS items FROM ({_ITEM_SQL}) GROUP BY 1, 2""")
def _(spark, d):
    k = I.edge_kind(F.col("kind"))
    return I.select_items(stmts(spark, d)).groupBy(k.alias("edge_kind"), I.edge_type(k).alias("edge_type")).agg(F.count("*").alias("items"))


@query("P34_predicates", """SELECT q.doc_id, 0 AS stmt_idx, position, replace(replace(replace(predicate, '~a', CAST(a AS VARCHAR)), '~b', CAST(b AS VARCHAR)), '~c', CAST(c AS VARCHAR)) AS predicate FROM qlog q JOIN (VALUES (1, 0, 'x.d > 10'), (4, 0, 'id IN (subq)'),
  (9, 0, 'UPPER(name) LIKE '''''), (10, 0, 'a.id = 1'), (10, 1, 'b.v = 2'), (11, 0, 'YEAR(d) = 2020'), (11, 1, 'LOWER(name) = '''''), (11, 2, 'v * 1 > 2'), (11, 3, 'w + 0 = 3'), (11, 4, 'n || '''' = '''''), (14, 0, 'NOT EXISTS (subq)'), (14, 1, 'id NOT IN (subq)'),
  (15, 0, 'v > (subq)'), (15, 1, 'w > (subq)'), (27, 0, 'name LIKE '''''), (32, 0, 'id = 2'), (34, 0, 'x.id > 3'), (35, 0, 't~b.id = t~a.id'), (36, 0, 'v IS NOT NULL'), (38, 0, 'id = 1'), (42, 0, 't~a.v > 5'), (44, 0, 'id IN (subq)'), (44, 1, 'pid IN (subq)'),
  (45, 0, 'v IN (subq)'), (45, 1, 'w IN (subq)'), (45, 2, 'x IN (subq)'), (45, 3, 'y IN (subq)'), (46, 0, 'TRIM(name) = '''''), (46, 1, 'CAST(v AS INT) = 1'), (46, 2, 'COALESCE(w, 0) = 2'), (46, 3, 'REPLACE(n, '''', '''') = '''''), (46, 4, 'ABS(z) = 3'),
  (49, 0, 'ROWNUM < 5')) v(kind, position, predicate) ON q.kind = v.kind""")
def _(spark, d):
    return I.predicates(stmts(spark, d)).select("doc_id", "stmt_idx", "position", "predicate")


@query("P35_windows", """SELECT doc_id, 'ROW_NUMBER' AS function, 'k' AS partition_cols, CASE kind WHEN 9 THEN 'd' ELSE 'd DESC' END AS order_cols, CASE kind WHEN 13 THEN 'ROWS BETWEEN 1 PRECEDING AND CURRENT ROW' END AS frame FROM qlog WHERE kind IN (9, 13)""")
def _(spark, d):
    return join_text(I.windows(stmts(spark, d)), "partition_cols", "order_cols").select("doc_id", "function", "partition_cols", "order_cols", "frame")


@query("P36_aggregates", """SELECT doc_id, position, function, is_distinct, argument, alias FROM qlog JOIN (VALUES (1, 0, 'SUM', false, 'x.v', 'total'), (5, 0, 'COUNT', true, 'k', 'n'), (12, 0, 'SUM', false, 'amt', 's'), (15, 0, 'MAX', false, 'v', NULL),
  (15, 1, 'AVG', false, 'v', NULL), (15, 2, 'AVG', false, 'v', NULL), (26, 0, 'COUNT', false, '*', 'n'), (41, 0, 'SUM', false, 's.amt', 'amt')) v(kind, position, function, is_distinct, argument, alias) USING (kind)""")
def _(spark, d):
    return I.aggregates(stmts(spark, d)).select("doc_id", "position", "function", "is_distinct", "argument", "alias")


@query("P37_cases", "SELECT doc_id, 'v > 1' AS whens, '''a''' AS thens, '''b''' AS else_value, 'cs' AS alias FROM qlog WHERE kind = 11")
def _(spark, d):
    return join_text(I.cases(stmts(spark, d)), "whens", "thens").select("doc_id", "whens", "thens", "else_value", "alias")


_CALLS = """SELECT doc_id, name, category FROM qlog JOIN (VALUES (1, 'SUM', 'aggregate'), (5, 'COUNT', 'aggregate'), (9, 'ROW_NUMBER', 'window'), (9, 'UPPER', 'scalar'), (11, 'UPPER', 'scalar'), (11, 'CAST', 'scalar'), (11, 'YEAR', 'scalar'), (11, 'LOWER', 'scalar'),
  (12, 'SUM', 'aggregate'), (13, 'ROW_NUMBER', 'window'), (15, 'MAX', 'aggregate'), (15, 'AVG', 'aggregate'), (15, 'AVG', 'aggregate'), (26, 'COUNT', 'aggregate'), (27, 'EXTRACT', 'scalar'), (28, 'FLATTEN', 'tvf'), (33, 'GEN_ROWS', 'tvf'), (33, 'UNNEST', 'tvf'),
  (40, 'COALESCE', 'scalar'), (41, 'SUM', 'aggregate'), (46, 'TRIM', 'scalar'), (46, 'CAST', 'scalar'), (46, 'COALESCE', 'scalar'), (46, 'REPLACE', 'scalar'), (46, 'ABS', 'scalar'), (49, 'NVL', 'scalar')) v(kind, name, category) USING (kind)"""


@query("P38_function_usage", f"SELECT name, category, count(*) AS calls, count(DISTINCT doc_id) AS texts FROM ({_CALLS}) GROUP BY 1, 2")
def _(spark, d):
    used = I.functions_used(stmts(spark, d), FR.function_registry(spark))
    per_text = used.groupBy("name", "category", "doc_id").agg(F.count("*").alias("n"))
    return per_text.groupBy("name", "category").agg(F.sum("n").alias("calls"), F.count("*").alias("texts"))


@query("P39_table_functions", f"SELECT doc_id, name FROM ({_CALLS}) WHERE category = 'tvf'")
def _(spark, d):
    return I.functions_used(stmts(spark, d), FR.function_registry(spark)).filter("category = 'tvf'").select("doc_id", "name")


@query("P40_merge_parts", """SELECT doc_id, 't' || b AS target, 't' || a AS source, 't' || b || '.id = t' || a || '.id' AS on_condition, 'MATCHED UPDATE|NOT MATCHED INSERT' AS actions, 'v' AS set_columns, 'id' AS insert_columns FROM qlog WHERE kind = 7""")
def _(spark, d):
    return join_text(D.merges(stmts(spark, d)), "actions", "set_columns", "insert_columns").drop("stmt_idx")


@query("P41_upserts", "SELECT doc_id, 'ON CONFLICT' AS form, 'UPDATE' AS action, 't' || b AS target FROM qlog WHERE kind = 22")
def _(spark, d):
    return D.upserts(stmts(spark, d)).drop("stmt_idx")


@query("P42_delete_forms", "SELECT doc_id, 't' || b AS target, CASE kind WHEN 35 THEN 't' || a ELSE '' END AS sources, kind <> 48 AS has_where FROM qlog WHERE kind IN (4, 35, 48)")
def _(spark, d):
    return join_text(D.delete_forms(stmts(spark, d)), "sources").select("doc_id", "target", "sources", "has_where")


@query("P43_update_forms", """SELECT doc_id, CASE kind WHEN 3 THEN 't' || b ELSE 't' || a END AS target, CASE kind WHEN 34 THEN 't' || a || '|t' || c ELSE '' END AS sources, 'v' AS set_columns, kind = 34 AS has_where FROM qlog WHERE kind IN (3, 34)""")
def _(spark, d):
    return join_text(D.update_forms(stmts(spark, d)), "sources", "set_columns").drop("stmt_idx")


@query("P44_insert_branches", "SELECT doc_id, 0 AS branch, 'v > 1' AS condition, 't' || b AS target FROM qlog WHERE kind = 21 UNION ALL SELECT doc_id, 1, 'ELSE', 't' || c FROM qlog WHERE kind = 21")
def _(spark, d):
    return D.insert_branches(stmts(spark, d)).drop("stmt_idx")


@query("P45_bulk_endpoints", """SELECT doc_id, CASE kind WHEN 16 THEN 'COPY FROM' WHEN 17 THEN 'COPY INTO' WHEN 18 THEN 'UNLOAD' ELSE 'INSERT OVERWRITE' END AS operation, CASE kind WHEN 16 THEN 's3://bucket/f' || a || '.csv' WHEN 17 THEN '@stage/p' || a WHEN 18 THEN 's3://bucket/out' || b END AS endpoint,
  CASE kind WHEN 18 THEN 't' || a ELSE 't' || b END AS table_name, CASE kind WHEN 18 THEN 'export' WHEN 37 THEN 'overwrite' ELSE 'import' END AS direction FROM qlog WHERE kind IN (16, 17, 18, 37)""")
def _(spark, d):
    return D.bulk_edges(stmts(spark, d)).drop("stmt_idx")


@query("P46_warehouse_objects", """SELECT doc_id, CASE kind WHEN 19 THEN 'EXTERNAL TABLE' ELSE 'STREAM' END AS kind, CASE kind WHEN 19 THEN 'ext' ELSE 'st' END || b AS name, CASE kind WHEN 20 THEN 't' || a END AS source, CASE kind WHEN 19 THEN 's3://bucket/x' || a END AS location FROM qlog WHERE kind IN (19, 20)""")
def _(spark, d):
    return D.warehouse_objects(stmts(spark, d)).select("doc_id", "kind", "name", "source", "location")


@query("P47_ddl_references", "SELECT doc_id, 't' || a AS ref_table FROM qlog WHERE kind = 6 UNION ALL SELECT doc_id, 'raw.t' || b FROM qlog WHERE kind = 6")
def _(spark, d):
    return D.ddl_references(stmts(spark, d)).drop("stmt_idx")


@query("P48_grouping_sets", "SELECT doc_id, 'region|product|year' AS columns FROM qlog WHERE kind = 12")
def _(spark, d):
    return join_text(D.grouping_set_columns(stmts(spark, d)), "columns").drop("stmt_idx")


@query("P49_filter_by_type", "SELECT src, dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE type IN ('table', 'view')) AND dst IN (SELECT id FROM nodes WHERE type IN ('table', 'view'))")
def _(spark, d):
    nodes, edges = L.lineage_graph(stored_stmts(spark, d))
    return G.edges_among(edges, G.filter_by_type(nodes, ["table", "view"])).select("src", "dst")


@query("P50_filter_by_search", "SELECT id, 'substring' AS mode FROM nodes WHERE name LIKE '%12%' UNION ALL SELECT id, 'regex' FROM nodes WHERE regexp_matches(name, '^v[0-9]+$')")
def _(spark, d):
    nodes, _ = L.lineage_graph(stored_stmts(spark, d))
    return G.filter_by_search(nodes, "12").select("id", F.lit("substring").alias("mode")).union(G.filter_by_search(nodes, "^V[0-9]+$", regex=True).select("id", F.lit("regex")))


@query("P51_combined_filter", "SELECT id FROM nodes WHERE type IN ('table', 'view') AND name LIKE '%1%' AND type <> 'external'")
def _(spark, d):
    nodes, _ = L.lineage_graph(stored_stmts(spark, d))
    return G.filter_by_search(G.filter_by_type(nodes, ["table", "view"]), "1").filter("type <> 'external'").select("id")


@query("P52_ranked_search", "SELECT id, type, name FROM nodes WHERE lower(name) LIKE '%t12%' ORDER BY CASE WHEN lower(name) = 't12' THEN 0 ELSE 1 END, lower(name), name, id LIMIT 15")
def _(spark, d):
    nodes, _ = L.lineage_graph(stored_stmts(spark, d))
    return G.search_names(nodes, "T12")


@query("P53_fingerprint")
def _(spark, d):
    return X.query_log(spark, d).groupBy(T.fingerprint(F.col("sql")).alias("fingerprint")).agg(F.count("*").alias("texts"))


@query("P54_subqueries", """SELECT doc_id, position, replace(replace(replace(subquery, '~a', CAST(a AS VARCHAR)), '~b', CAST(b AS VARCHAR)), '~c', CAST(c AS VARCHAR)) AS subquery, location FROM qlog JOIN (VALUES (2, 0, 'SELECT id, extra FROM t~a', 'where'), (2, 1, 'SELECT id FROM t~c', 'where'),
  (4, 0, 'SELECT id FROM t~a', 'where'), (14, 0, 'SELECT 1 FROM t~b WHERE t~b.id = t~a.id', 'where'), (14, 1, 'SELECT id FROM t~c', 'where'), (15, 0, 'SELECT MAX(v) FROM t~b', 'select'), (15, 1, 'SELECT AVG(v) FROM t~c WHERE v > 0', 'where'), (15, 2, 'SELECT AVG(v) FROM t~c WHERE v > 0', 'where'),
  (29, 0, 'SELECT id, pid FROM t~a UNION ALL SELECT t.id, t.pid FROM t~a t JOIN r ON t.pid = r.id', 'where'), (40, 0, 'SELECT id, v FROM v~c', 'where'), (43, 0, 'SELECT id FROM t~a', 'where'), (44, 0, 'SELECT id FROM `t~b`', 'where'), (44, 1, 'SELECT id FROM `t~b`', 'where'),
  (45, 0, 'SELECT v FROM t~b', 'where'), (45, 1, 'SELECT w FROM t~c', 'where'), (45, 2, 'SELECT x FROM raw.dim', 'where'), (45, 3, 'SELECT y FROM raw.geo', 'where')) v(kind, position, subquery, location) USING (kind)""")
def _(spark, d):
    return I.subquery_rows(stmts(spark, d)).select("doc_id", "position", "subquery", "location")


