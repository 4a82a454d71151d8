"""Statistics (A), rules (H), relational vocabulary (V), function vocabulary (F), user surface (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlstrata import fixtures as X
from sqlstrata.functions import registry as FR
from sqlstrata.operators import items as I, rules as H, stats as A, statements as S
from sqlstrata.plans import opgraph as O
from sqlstrata.sources import corpus as Q
from suite.base import CTES, query, stmts, stored_stmts

# --- DuckDB side: counters by regular expressions, shapes by kind of template --------------------------------------

_COUNT = lambda p: f"len(regexp_extract_all(masked, '(?i){p}', 0))"
CTES["uses"] = r"""SELECT doc_id, path, stmt_idx, lower(n) AS table_name FROM (
    SELECT doc_id, path, stmt_idx, unnest(regexp_extract_all(txt, '(?i)\b(?:FROM|JOIN|USING|UPDATE|INTO)\s+(?:\w+\.)?["''`]?(\w+)', 1)) AS n FROM reftext
    UNION ALL SELECT doc_id, path, stmt_idx, unnest(regexp_extract_all(txt, '(?i)\bOVERWRITE\s+TABLE\s+(?:\w+\.)?["''`]?(\w+)', 1)) FROM reftext
    UNION ALL SELECT doc_id, path, stmt_idx, unnest(regexp_extract_all(txt, '(?i)\bFROM\s+\w+\s*,\s*(\w+)', 1)) FROM reftext
    UNION ALL SELECT doc_id, path, stmt_idx, unnest(regexp_extract_all(txt, '(?i)\bDELETE\s+FROM\s+(?:\w+\.)?["''`]?(\w+)', 1)) FROM reftext)
    WHERE lower(n) NOT IN (SELECT w FROM reserved) AND len(n) >= 2"""
from sqlstrata.functions import patterns as P  # noqa: E402
from suite.base import quoted  # noqa: E402
CTES["reserved"] = f"SELECT unnest([{quoted(sorted(set(P.REFERENCE_RESERVED)))}]) AS w"
CTES["counts"] = f"""SELECT s.doc_id, s.path, s.stmt_idx, kind, coalesce(u, 0) AS table_uses, coalesce(t, 0) AS tables, {_COUNT(r'\bJOIN\b')} AS joins, {_COUNT(r'\(\s*SELECT\b')} AS subqueries,
    CASE kind WHEN 2 THEN 2 WHEN 29 THEN 1 WHEN 43 THEN 1 ELSE 0 END AS ctes, {_COUNT(r'\b(?:COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT)\b')} AS aggregations, {_COUNT(r'\bOVER\s*\(')} AS window_functions,
    {_COUNT(r'\bUNION\b')} AS unions, {_COUNT(r'\bWHERE\b')} + {_COUNT(r'\bHAVING\b')} AS conditions
    FROM stmts s LEFT JOIN (SELECT doc_id, stmt_idx, count(*) AS u, count(DISTINCT table_name) AS t FROM uses GROUP BY 1, 2) USING (doc_id, stmt_idx)"""
_SCORE = "(table_uses + 3 * joins + 5 * subqueries + 4 * ctes + 2 * aggregations + 4 * window_functions + 3 * unions + 0.5 * conditions)"
_LEVEL = lambda x: f"CASE WHEN {x} < 5 THEN 'Simple' WHEN {x} < 15 THEN 'Moderate' WHEN {x} < 30 THEN 'Complex' ELSE 'Very Complex' END"
CTES["scored"] = f"SELECT *, CAST(floor({_SCORE} + 0.5) AS INTEGER) AS complexity_score, {_LEVEL(_SCORE)} AS complexity FROM counts"

# Which rule fires on which kind of template (statement 0 unless given), with type, severity and category.
_FIRES = {
    "H1": ([0], "warning", "medium", "performance"), "H3": ([3, 48], "error", "high", "performance"), "H4": ([30], "warning", "medium", "performance"), "H5": ([45], "warning", "medium", "performance"),
    "H6": ([25], "error", "high", "performance"), "H7": ([2], "warning", "medium", "quality"), "H8": ([15, 45], "info", "low", "quality"), "H9": ([44], "info", "low", "quality"),
    "H12": ([42], "warning", "medium", "performance"), "H13": ([26], "info", "medium", "performance"), "H14": ([10], "warning", "high", "performance"), "H15": ([42], "info", "low", "performance"),
    "H17": ([4, 44, 45], "info", "medium", "performance"), "H18": ([14], "info", "medium", "performance"), "H19": ([15], "info", "medium", "performance"),
    "H20": ([14], "warning", "high", "quality"), "H22a": ([11], "warning", "high", "performance"), "H22b": ([9, 11], "warning", "medium", "performance"), "H22c": ([46], "warning", "medium", "performance"),
    "H22d": ([46], "warning", "high", "performance"), "H22e": ([46], "info", "medium", "performance"), "H22f": ([46], "warning", "medium", "performance"), "H22g": ([46], "info", "low", "performance"),
    "H23a": ([11], "warning", "medium", "performance"), "H23b": ([11], "info", "low", "performance"), "H23c": ([11], "warning", "medium", "performance"), "H24": ([9, 27], "warning", "high", "performance"),
    "H25": ([10], "info", "medium", "performance"), "H26": ([26], "warning", "medium", "performance"), "H27": ([12, 26], "info", "low", "performance"), "H28": ([], "info", "medium", "performance"),
    "H29": ([31], "warning", "medium", "quality"), "H32": ([7], "warning", "medium", "best-practice"), "H35a": ([32], "info", "low", "best-practice"), "H35b": ([16, 17, 18], "warning", "medium", "best-practice"),
}
_H2 = [0, 8, 9, 10, 11, 12, 13, 14, 15, 25, 26, 27, 28, 29, 30, 31, 33, 38, 39, 42, 43, 44, 45, 46, 47, 49]
_FIXED = ", ".join(f"('{r}', {k}, '{t}', '{s}', '{c}')" for r, (ks, t, s, c) in _FIRES.items() for k in ks)
CTES["reads"] = r"""SELECT doc_id, path, stmt_idx, t, t IN (SELECT l.n FROM local_names l WHERE l.doc_id = x.doc_id AND l.stmt_idx = x.stmt_idx) AS local_name, count(*) AS n FROM (
    SELECT doc_id, path, stmt_idx, lower(unnest(regexp_extract_all(txt, '(?i)\b(?:FROM|JOIN)\s+(?:\w+\.)?["''`]?(\w+)', 1))) AS t FROM reftext) x WHERE t NOT IN (SELECT w FROM reserved) AND len(t) >= 2 GROUP BY ALL"""
CTES["findings"] = f"""SELECT doc_id, path, 0 AS stmt_idx, rule_id, type, severity, category FROM qlog q JOIN (VALUES {_FIXED}) v(rule_id, k, type, severity, category) ON q.kind = v.k
    UNION ALL SELECT doc_id, path, 0, 'H2', 'info', 'low', 'performance' FROM qlog WHERE kind IN ({', '.join(map(str, _H2))})
    UNION ALL SELECT doc_id, path, 1, 'H2', 'info', 'low', 'performance' FROM qlog WHERE kind = 8 UNION ALL SELECT doc_id, path, 2, 'H2', 'info', 'low', 'performance' FROM qlog WHERE kind = 23
    UNION ALL SELECT doc_id, path, i, 'H35b', 'warning', 'medium', 'best-practice' FROM qlog, (VALUES (0), (1)) v(i) WHERE kind = 23
    UNION ALL SELECT doc_id, path, 0, 'H31', 'warning', 'medium', 'best-practice' FROM qlog WHERE kind IN (28, 33, 49)
    UNION ALL SELECT doc_id, path, 0, 'H8', 'info', 'low', 'quality' FROM qlog WHERE (kind = 45 AND b = c) OR (kind = 2 AND a = c)
    UNION ALL SELECT doc_id, path, stmt_idx, CASE WHEN local_name THEN 'H16' ELSE 'H11' END, 'warning', CASE WHEN local_name AND n > 2 THEN 'high' ELSE 'medium' END, 'performance' FROM reads WHERE n > 1
    UNION ALL SELECT doc_id, path, 0, 'H36', 'info', NULL, 'best-practice' FROM qlog WHERE kind IN (16, 18, 19, 49)"""


def findings(spark, d):
    return H.findings(stored_stmts(spark, d))


@query("A1_feature_counts", "SELECT doc_id, stmt_idx, table_uses, tables, joins, subqueries, ctes, aggregations, window_functions, unions, conditions FROM counts")
def _(spark, d):
    return A.feature_counts(stmts(spark, d)).drop("path", "tables_used")


@query("A2_complexity", "SELECT doc_id, stmt_idx, complexity_score, complexity FROM scored")
def _(spark, d):
    return A.statement_stats(stmts(spark, d)).select("doc_id", "stmt_idx", "complexity_score", "complexity")


@query("A3_simple_complexity", f"SELECT doc_id, stmt_idx, tables + 3 * joins AS simple_score, {_LEVEL('(tables + 3 * joins)')} AS simple_complexity FROM counts")
def _(spark, d):
    return A.statement_stats(stmts(spark, d)).select("doc_id", "stmt_idx", "simple_score", "simple_complexity")


@query("A4_complexity_breakdown", "SELECT doc_id, stmt_idx, joins * 3 AS joins_weight, subqueries * 2 AS subqueries_weight, ctes * 2 AS ctes_weight, aggregations AS aggregations_weight, window_functions * 2 AS windows_weight FROM counts")
def _(spark, d):
    return A.breakdown(A.feature_counts(stmts(spark, d)))


@query("A5_performance_score", """SELECT s.doc_id, s.stmt_idx, greatest(0, 100 - coalesce(off, 0)) AS performance_score, coalesce(n, 0) AS performance_issues FROM stmts s LEFT JOIN (SELECT doc_id, stmt_idx, count(*) AS n,
  sum(CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END) AS off FROM findings WHERE category = 'performance' GROUP BY 1, 2) USING (doc_id, stmt_idx)""")
def _(spark, d):
    return A.performance_scores(stmts(spark, d), findings(spark, d))


@query("A6_table_usage", "SELECT doc_id, stmt_idx, table_name, count(*) AS uses FROM uses GROUP BY 1, 2, 3")
def _(spark, d):
    return A.table_usage(stmts(spark, d)).drop("path")


@query("A7_batch_totals", f"""WITH t AS (SELECT path, count(DISTINCT table_name) AS tables FROM uses GROUP BY 1), s AS (SELECT path, count(*) AS statements, sum(joins) AS joins, sum(subqueries) AS subqueries, sum(ctes) AS ctes, sum(aggregations) AS aggregations,
  sum(window_functions) AS window_functions, sum(unions) AS unions, sum(conditions) AS conditions, sum(complexity_score) AS complexity_score, avg(complexity_score) AS m FROM scored GROUP BY 1)
  SELECT s.* EXCLUDE (m), {_LEVEL('m')} AS complexity, coalesce(tables, 0) AS tables FROM s LEFT JOIN t USING (path)""")
def _(spark, d):
    return A.batch_totals(A.statement_stats(stmts(spark, d)))


@query("A8_parse_outcome", "SELECT path, count(*) FILTER (WHERE strlen(sql) <= 150) AS success, count(*) FILTER (WHERE strlen(sql) > 150) AS errors FROM qlog GROUP BY 1")
def _(spark, d):
    return A.parse_outcomes(Q.from_query_log(X.query_log(spark, d), "sql", "doc_id", "path", max_bytes=150))




@query("A10_critical_path", "SELECT doc_id, stmt_idx, ops + CAST(has_table AS INTEGER) AS critical_path FROM chains")
def _(spark, d):
    return O.shape(O.op_nodes(stmts(spark, d))).select("doc_id", "stmt_idx", "critical_path")


@query("A11_cte_depth", "SELECT doc_id, 1 AS max_cte_depth FROM qlog WHERE kind IN (2, 29, 43)")
def _(spark, d):
    return O.cte_depth(O.op_nodes(stmts(spark, d))).filter("max_cte_depth > 0").select("doc_id", "max_cte_depth")


# The join of a recursive CTE's body is no operator of the statement itself.
@query("A14_node_levels", "SELECT doc_id, count(*) AS nodes, count(*) FILTER (WHERE joins > 3) AS bottlenecks FROM (SELECT doc_id, joins, unnest(range(joins)) FROM counts WHERE kind <> 29) GROUP BY doc_id")
def _(spark, d):
    s = stored_stmts(spark, d)
    levels = O.node_levels(O.op_nodes(s), A.feature_counts(s)).filter("kind = 'join'")
    return levels.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if("is_bottleneck").alias("bottlenecks"))


@query("A15_top_findings", """SELECT doc_id, stmt_idx, rank, w AS weight FROM (SELECT doc_id, stmt_idx, row_number() OVER (PARTITION BY doc_id, stmt_idx ORDER BY w DESC) AS rank, w FROM (SELECT *, CASE severity WHEN 'high' THEN 30 WHEN 'medium' THEN 20 ELSE 10 END
  + CASE type WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS w FROM findings)) WHERE rank <= 3""")
def _(spark, d):
    return A.top_findings(findings(spark, d)).select("doc_id", "stmt_idx", "rank", "weight")


CTES["badges"] = """SELECT s.doc_id, s.stmt_idx, coalesce(total, 0) AS total, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings FROM stmts s LEFT JOIN (SELECT doc_id, stmt_idx, count(*) AS total, count(*) FILTER (WHERE type = 'error' OR severity = 'high') AS e,
  count(*) FILTER (WHERE type = 'warning' OR severity = 'medium') AS w FROM findings GROUP BY 1, 2) USING (doc_id, stmt_idx)"""


@query("A16_badges", """SELECT *, CASE WHEN total = 0 THEN 'ok' WHEN errors > 0 THEN 'error' ELSE 'warning' END AS status, CASE WHEN total = 0 THEN 'OK' WHEN errors > 0 THEN errors || '!' ELSE CAST(total AS VARCHAR) END AS label FROM badges""")
def _(spark, d):
    return A.badges(stmts(spark, d), findings(spark, d))


@query("A17_diagnostic_levels", """SELECT rule_id, CASE WHEN severity = 'high' OR type = 'error' THEN 'Error' WHEN severity = 'medium' OR type = 'warning' THEN 'Warning' ELSE 'Information' END AS level, count(*) AS findings FROM findings GROUP BY 1, 2""")
def _(spark, d):
    return findings(spark, d).groupBy("rule_id", A.diagnostic_level(F.col("severity"), F.col("type")).alias("level")).agg(F.count("*").alias("findings"))


@query("A18_operator_histogram", """SELECT 'joins' AS cluster, sum(joins) AS n FROM counts WHERE kind NOT IN (29) UNION ALL SELECT 'ctes', sum(ctes) FROM counts UNION ALL SELECT 'windows', count(*) FROM qlog WHERE kind IN (9, 13)
  UNION ALL SELECT 'cases', count(*) FROM qlog WHERE kind = 11 UNION ALL SELECT 'unions', count(*) FROM qlog WHERE kind IN (8, 31) UNION ALL SELECT 'sorts', count(*) FROM qlog WHERE kind = 2""")
def _(spark, d):
    return O.histogram(O.op_nodes(stmts(spark, d))).filter(F.col("cluster").isin("joins", "ctes", "windows", "cases", "unions", "sorts"))


# --- rules -------------------------------------------------------------------------------------------------------

_TITLES = {
    "H1": "select_star", "H2": "no_limit", "H3": "write_without_where", "H4": "many_joins", "H5": "many_subqueries", "H6": "cartesian_product", "H7": "unused_cte", "H8": "similar_subqueries", "H11": "repeated_scan",
    "H12": "filter_after_join", "H13": "having_without_aggregate", "H14": "early_cross_join", "H15": "filtered_tables", "H16": "repeated_access", "H17": "in_subquery", "H18": "exists_subquery", "H19": "scalar_subquery", "H20": "not_in_subquery",
    "H22": "non_sargable", "H23": "noop_arithmetic", "H24": "leading_wildcard", "H25": "or_across_tables", "H26": "wide_group_by", "H27": "aggregate_without_where", "H28": "count_distinct", "H29": "set_operation_width",
    "H31": "foreign_dialect", "H32": "merge_portability", "H35": "partial_extraction", "H36": "dialect_mismatch",
}
_GROUPED, _DIALECT = {"H8", "H11", "H16"}, {"H31", "H32", "H36"}


def _register_rule(rule: str, title: str) -> None:
    @query(f"{rule}_{title}", f"SELECT doc_id, stmt_idx, rule_id, type, severity, category FROM findings WHERE rule_id = '{rule}' OR (rule_id LIKE '{rule}_' AND regexp_matches(rule_id, '[a-g]$'))")
    def _(spark, d):
        # Only the family of the rule is run, so a single rule costs one pass and no more.
        if rule in _GROUPED:
            found = H.grouped_findings(stmts(spark, d))
        elif rule in _DIALECT:
            found = H.dialect_findings(stmts(spark, d))
        else:
            s = stmts(spark, d)
            found = H.apply_rules(H.features(s), [r for r in H.statement_rules() if r.rule_id.rstrip("abcdefg") == rule])
        return found.filter(F.regexp_replace("rule_id", "[a-g]$", "") == rule).select("doc_id", "stmt_idx", "rule_id", "type", "severity", "category")


for _r, _t in _TITLES.items():
    _register_rule(_r, _t)


@query("H9_duplicate_subqueries", "SELECT doc_id, 0 AS stmt_idx, 2 AS n FROM qlog WHERE kind IN (15, 44)")
def _(spark, d):
    return H.duplicate_subqueries(stmts(spark, d)).select("doc_id", "stmt_idx", "n")


@query("H10_dead_columns", "SELECT doc_id, 0 AS stmt_idx, 'src' AS cte_name, 'extra' AS column_name FROM qlog WHERE kind = 2")
def _(spark, d):
    return H.dead_columns(stmts(spark, d)).select("doc_id", "stmt_idx", "cte_name", "column_name")


@query("H21_index_candidates", """SELECT doc_id, 0 AS stmt_idx, purpose, columns FROM qlog JOIN (VALUES (2, 'sort', 'src.id'), (9, 'filter', 'name'), (10, 'filter', 'a.id|b.v'), (10, 'join', 'b.id|c.id'), (11, 'filter', 'd|name|v|w|n'), (12, 'group', 'region|product|year'), (14, 'filter', 'id'),
  (15, 'filter', 'v|w'), (26, 'group', 'c1|c2|c3|c4|c5|c6'), (27, 'filter', 'name'), (28, 'join', 'f.seq'), (30, 'join', 'a.id|b.pid|c.id|d.id|e.id|f.id|g.id'), (33, 'join', 'u.id|g.id'), (38, 'filter', 'id'), (43, 'join', 'x1.id|x2.id|x3.id'), (44, 'filter', 'id|pid'),
  (45, 'filter', 'v|w|x|y'), (46, 'filter', 'name|v|w|n|z'), (49, 'filter', 'rownum')) v(kind, purpose, columns) USING (kind) UNION ALL SELECT doc_id, 0, 'filter', 't' || a || '.v' FROM qlog WHERE kind = 42
  UNION ALL SELECT doc_id, 0, 'join', CASE WHEN a = b THEN 't' || a || '.id|dim.id' ELSE 't' || a || '.id|t' || b || '.id|dim.id' END FROM qlog WHERE kind = 42""")
def _(spark, d):
    return H.index_candidates(stmts(spark, d)).select("doc_id", "stmt_idx", "purpose", F.array_join("columns", "|").alias("columns"))


@query("H30_unknown_table_function", "SELECT doc_id, name FROM qlog JOIN (VALUES (28, 'FLATTEN'), (33, 'GEN_ROWS'), (33, 'UNNEST')) v(kind, name) USING (kind)")
def _(spark, d):
    found = H.unknown_table_functions(stmts(spark, d), FR.function_registry(spark))
    return found.select("doc_id", F.substring_index("message", ": ", -1).alias("name"))


@query("H34_over_limit", """WITH n AS (SELECT doc_id, count(*) AS k FROM stmts GROUP BY 1) SELECT q.doc_id, 'H34' AS rule_id, 'Input over limit: ' || CASE WHEN strlen(sql) > 200 THEN strlen(sql) || ' bytes' ELSE k || ' statements' END AS message
  FROM qlog q JOIN n USING (doc_id) WHERE strlen(sql) > 200 OR k > 2""")
def _(spark, d):
    return H.limit_findings(Q.validate(X.query_log(spark, d), S.statement_count(F.col("sql")), 200, 2)).select("doc_id", "rule_id", "message")


# --- relational vocabulary -----------------------------------------------------------------------------------------

_VOCABULARY = {
    "V1_projection": ["projection", "distinct", "star", "alias"], "V2_where": ["where"], "V3_joins": ["join", "inner_join", "left_join", "right_join", "full_join", "cross_join"], "V4_comma_join": ["comma_join"], "V5_theta_join": ["non_equi_join"],
    "V6_semi_anti": ["in_subquery", "not_in_subquery", "exists", "not_exists"], "V7_apply_lateral": ["apply", "lateral"], "V8_aggregates": ["group_by", "aggregate", "distinct_aggregate"], "V9_having": ["having"],
    "V10_grouping_sets": ["grouping_sets", "rollup", "cube"], "V11_windows": ["window", "partition_by", "frame"], "V12_qualify": ["qualify"], "V13_case": ["case"], "V14_order_by": ["order_by"], "V15_limit": ["limit", "top"],
    "V16_set_operations": ["union", "union_all", "intersect", "except"], "V17_ctes": ["with", "recursive"], "V18_subqueries": ["derived_table", "scalar_subquery"], "V19_table_functions": ["table_function"],
    "V20_rare_forms": ["pivot", "connect_by", "sample"], "V21_dml": ["insert", "update", "delete", "merge", "replace"], "V22_ddl": ["create", "alter", "drop", "truncate"],
}


def _vocabulary_sql(forms: list[str]) -> str:
    parts = []
    for f in forms:
        pattern = O.FORMS[f].replace(r"\b(?!\s*\()", r"(?:\s|$)").replace("'", "''")
        n = f"len(regexp_extract_all(masked, '{pattern}', 0))"
        parts.append(f"SELECT '{f}' AS form, coalesce(sum({n}), 0) AS occurrences, count(*) FILTER (WHERE {n} > 0) AS statements FROM stmts")
    return " UNION ALL ".join(parts)


def _register_form(key: str, forms: list[str]) -> None:
    @query(key, _vocabulary_sql(forms))
    def _(spark, d):
        return O.profile_totals(O.op_profile(stmts(spark, d)), forms)


for _k, _f in _VOCABULARY.items():
    _register_form(_k, _f)


# --- function vocabulary -------------------------------------------------------------------------------------------

_FAMILIES = {f"F{i}": n for i, n in enumerate(["common_aggregates", "ranking", "analytic", "percentiles", "collections", "json_maps", "booleans", "bitwise", "dispersion", "regression", "approximate", "misc_aggregates", "xml_ml",
                                               "window_extras", "table_functions"], 1)}


def _register_family(family: str, title: str) -> None:
    names = sorted({r[3] for r in FR.registry_rows() if r[0] == family} - {n.upper() for n in I.NOT_A_FUNCTION})
    @query(f"{family}_{title}", rf"""SELECT name, count(*) AS calls FROM (SELECT upper(unnest(regexp_extract_all(masked, '(?i)\b([A-Za-z_][\w.]*)\s*\(', 1))) AS name FROM stmts) WHERE name IN ({quoted(names)}) GROUP BY 1""")
    def _(spark, d):
        known = FR.function_registry(spark).filter(F.col("family") == family).select("name").distinct()
        return I.function_calls(stmts(spark, d)).join(F.broadcast(known), "name", "left_semi").groupBy("name").agg(F.count("*").alias("calls"))


for _k, _f in _FAMILIES.items():
    _register_family(_k, _f)


@query("F16_scalar_families", """SELECT family, count(*) AS calls FROM (SELECT doc_id, upper(unnest(regexp_extract_all(masked, '(?i)\\b([A-Za-z_]\\w*)\\s*\\(', 1))) AS name FROM stmts) JOIN (VALUES """
       + ", ".join(f"('{f}', '{n}')" for f, names in P.SCALAR_FAMILIES.items() for n in names.split()) + ") v(family, fn) ON name = fn GROUP BY 1")
def _(spark, d):
    family = I.map_values(F.col("name"), {n: f for f, names in P.SCALAR_FAMILIES.items() for n in names.split()}, "other")
    return I.function_calls(stmts(spark, d)).groupBy(family.alias("family")).agg(F.count("*").alias("calls")).filter("family <> 'other'")


@query("F17_non_sargable_classes", """SELECT class, count(*) AS calls FROM (SELECT upper(unnest(regexp_extract_all(masked, '(?i)\\b([A-Za-z_]\\w*)\\s*\\(', 1))) AS name FROM stmts) JOIN (VALUES """
       + ", ".join(f"('{c}', '{n}')" for c, (names, _, _) in P.NON_SARGABLE.items() for n in names.split()) + ") v(class, fn) ON name = fn GROUP BY 1")
def _(spark, d):
    cls = I.map_values(F.col("name"), {n: c for c, (names, _, _) in P.NON_SARGABLE.items() for n in names.split()}, "other")
    return I.function_calls(stmts(spark, d)).groupBy(cls.alias("class")).agg(F.count("*").alias("calls")).filter("class <> 'other'")


# --- user surface --------------------------------------------------------------------------------------------------

@query("U1_custom_functions", "SELECT doc_id, name, category FROM qlog JOIN (VALUES (33, 'GEN_ROWS', 'tvf'), (49, 'NVL', 'aggregate')) v(kind, name, category) USING (kind)")
def _(spark, d):
    reg = FR.function_registry(spark, {"aggregate": ["nvl"], "tvf": ["gen_rows"]})
    return I.functions_used(stmts(spark, d), reg).filter(F.col("name").isin("NVL", "GEN_ROWS")).select("doc_id", "name", "category")


@query("U2_custom_rules", "SELECT doc_id, stmt_idx, 'X1' AS rule_id, 'reads a raw table' AS message FROM stmts WHERE regexp_matches(masked, '(?i)\\braw\\.\\w+')")
def _(spark, d):
    rule = H.Rule("X1", "info", "low", "custom", "reads a raw table", F.col("masked").rlike(r"(?i)\braw\.\w+"))
    return H.apply_rules(H.features(stmts(spark, d)), [rule]).select("doc_id", "stmt_idx", "rule_id", "message")


@query("U3_flagged_texts", r"SELECT doc_id, regexp_matches(sql, '(?i)\bDELIMITER\s+\S|\([^)]*;|\bBEGIN\b') AS needs_depth FROM qlog")
def _(spark, d):
    return X.query_log(spark, d).select("doc_id", F.col("sql").rlike(S.NEEDS_DEPTH).alias("needs_depth"))


