"""Statement statistics: feature counts, complexity, totals per file, findings scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sqlstrata.functions import text as T
from sqlstrata.operators import refs as R

AGGREGATES = r"(?i)\b(?:COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT)\b"


def level(score: Column) -> Column:
    return F.when(score < 5, "Simple").when(score < 15, "Moderate").when(score < 30, "Complex").otherwise("Very Complex")


def feature_counts(stmts: DataFrame) -> DataFrame:
    """Counters per statement, all from its own text: table uses, joins, subqueries, CTEs, aggregates, windows, unions, conditions."""
    m = F.col("masked")
    named = T.hold(stmts.select("doc_id", "path", "stmt_idx", "clean", "masked"), tables_used=R.names_used(F.col("masked")))
    return named.select(
        "doc_id", "path", "stmt_idx", "tables_used", F.size("tables_used").alias("table_uses"), F.size(F.array_distinct("tables_used")).alias("tables"),
        T.rx_count(m, r"(?i)\bJOIN\b").alias("joins"), T.rx_count(m, r"(?i)\(\s*SELECT\b").alias("subqueries"),
        F.size(R.cte_structs(m)).alias("ctes"), T.rx_count(m, AGGREGATES).alias("aggregations"),
        T.rx_count(m, r"(?i)\bOVER\s*\(").alias("window_functions"), T.rx_count(m, r"(?i)\bUNION\b").alias("unions"),
        (T.rx_count(m, r"(?i)\bWHERE\b") + T.rx_count(m, r"(?i)\bHAVING\b")).alias("conditions"))


def with_scores(counts: DataFrame) -> DataFrame:
    """Full and simple complexity scores, rounded half up, with the band of the unrounded score."""
    full = (F.col("table_uses") + 3 * F.col("joins") + 5 * F.col("subqueries") + 4 * F.col("ctes") + 2 * F.col("aggregations")
            + 4 * F.col("window_functions") + 3 * F.col("unions") + 0.5 * F.col("conditions"))
    simple = F.col("tables") + 3 * F.col("joins")
    return counts.select("*", F.floor(full + 0.5).cast("int").alias("complexity_score"), level(full).alias("complexity"),
                         simple.alias("simple_score"), level(simple).alias("simple_complexity"))


def statement_stats(stmts: DataFrame) -> DataFrame:
    return with_scores(feature_counts(stmts))


def breakdown(counts: DataFrame) -> DataFrame:
    """Weighted shares of the complexity."""
    return counts.select("doc_id", "stmt_idx", (F.col("joins") * 3).alias("joins_weight"), (F.col("subqueries") * 2).alias("subqueries_weight"),
                         (F.col("ctes") * 2).alias("ctes_weight"), F.col("aggregations").alias("aggregations_weight"),
                         (F.col("window_functions") * 2).alias("windows_weight"))


def table_usage(stmts: DataFrame) -> DataFrame:
    """Uses per (statement, lower-case table). Rows of one statement meet in the map-side aggregate already."""
    return stmts.select("doc_id", "path", "stmt_idx", F.explode(R.names_used(F.col("masked"))).alias("table_name")).groupBy("doc_id", "path", "stmt_idx", "table_name").agg(F.count("*").alias("uses"))


def batch_totals(stats: DataFrame, by: str = "path") -> DataFrame:
    """Totals per file: distinct tables, sums of the counters, level of the average score.

    Distinct tables come from a second aggregate over (file, table), so no set of tables is ever held by one task.
    """
    sums = stats.groupBy(by).agg(
        F.count("*").alias("statements"), *[F.sum(c).alias(c) for c in ("joins", "subqueries", "ctes", "aggregations", "window_functions", "unions", "conditions")],
        F.sum("complexity_score").alias("complexity_score"), level(F.avg("complexity_score")).alias("complexity"))
    tables = (stats.select(by, F.explode(F.array_distinct("tables_used")).alias("_t")).groupBy(by, "_t").agg(F.lit(1).alias("_one"))
              .groupBy(by).agg(F.count("*").alias("tables")))
    return sums.join(tables, by, "left").withColumn("tables", F.coalesce("tables", F.lit(0).cast("long")))


def performance_scores(stmts: DataFrame, findings: DataFrame) -> DataFrame:
    """0..100 per statement: 15, 8 and 3 points off per high, medium and low performance finding; 100 when there is none."""
    perf = findings.filter(F.col("category") == "performance").groupBy("doc_id", "stmt_idx").agg(
        F.sum(F.when(F.col("severity") == "high", 15).when(F.col("severity") == "medium", 8).otherwise(3)).alias("_off"), F.count("*").alias("_n"))
    return stmts.select("doc_id", "stmt_idx").join(perf, ["doc_id", "stmt_idx"], "left").select(
        "doc_id", "stmt_idx", F.greatest(F.lit(0), 100 - F.coalesce("_off", F.lit(0))).cast("int").alias("performance_score"),
        F.coalesce("_n", F.lit(0)).cast("int").alias("performance_issues"))


def weight(findings: DataFrame) -> Column:
    severity = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    kind = F.when(F.col("type") == "error", 3).when(F.col("type") == "warning", 2).otherwise(1)
    return severity * 10 + kind


def top_findings(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k weightiest findings of each statement; a statement's findings are as few as the rules."""
    order = Window.partitionBy("doc_id", "stmt_idx").orderBy(F.desc("weight"), "rule_id", "message")
    return (findings.withColumn("weight", weight(findings)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("doc_id", "stmt_idx", "rank", "rule_id", "weight"))


def badges(stmts: DataFrame, findings: DataFrame) -> DataFrame:
    """ok / error / warning per statement with its label and counts."""
    counts = findings.groupBy("doc_id", "stmt_idx").agg(
        F.count("*").alias("total"), F.count_if((F.col("type") == "error") | (F.col("severity") == "high")).alias("errors"),
        F.count_if((F.col("type") == "warning") | (F.col("severity") == "medium")).alias("warnings"))
    all_ = stmts.select("doc_id", "stmt_idx").join(counts, ["doc_id", "stmt_idx"], "left").fillna(0, ["total", "errors", "warnings"])
    return all_.select(
        "doc_id", "stmt_idx", F.when(F.col("total") == 0, "ok").when(F.col("errors") > 0, "error").otherwise("warning").alias("status"),
        F.when(F.col("total") == 0, "OK").when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit("!"))).otherwise(F.col("total").cast("string")).alias("label"),
        "total", "warnings", "errors")


def diagnostic_level(severity: Column, kind: Column) -> Column:
    return (F.when((severity == "high") | (kind == "error"), "Error").when((severity == "medium") | (kind == "warning"), "Warning")
            .otherwise("Information"))


def parse_outcomes(corpus: DataFrame) -> DataFrame:
    """Per file: how many texts were read and how many failed."""
    return corpus.groupBy("path").agg(F.count_if(F.col("parse_error").isNull()).alias("success"), F.count_if(F.col("parse_error").isNotNull()).alias("errors"))


MAX_ERROR_SQL = 500  # fixed value: an error row shows this much of its text


def error_rows(corpus: DataFrame) -> DataFrame:
    """Failed texts with the line and column their message names. The shown text is cut; the analysed text is not."""
    e = F.col("parse_error")
    return corpus.filter(e.isNotNull()).select("doc_id", "path", e.alias("message"), T.rx_or_null(e, r"line (\d+)", 1).cast("int").alias("line"),
                                               T.rx_or_null(e, r"column (\d+)", 1).cast("int").alias("column"), F.substring("sql", 1, MAX_ERROR_SQL).alias("sql"))
