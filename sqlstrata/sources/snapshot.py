"""Stored index: versioned parquet with a metadata row, its validity, and the graph sink."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

INDEX_VERSION = 4  # layout version of the stored tables
CACHE_HOURS = 24  # fixed value: default age limit


def write_snapshot(tables: dict[str, DataFrame], root: str, identity: str, version: int = INDEX_VERSION, now: float | None = None) -> str:
    """Write every table under a new version folder, then append one row to the pointer table.

    Readers follow the newest pointer row, so they never see half a version.
    """
    spark = next(iter(tables.values())).sparkSession
    stamp = f"v{int((now or time.time()) * 1000)}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{stamp}/{name}")
    files = spark.read.parquet(f"{root}/{stamp}/files")
    meta = files.agg(F.count("*").alias("file_count")).select(
        F.lit(stamp).alias("stamp"), F.lit(version).alias("version"), F.lit(identity).alias("identity"), "file_count",
        F.lit(float(now or time.time())).alias("last_updated"), F.lit(False).alias("oversized"))
    meta.write.mode("append").parquet(f"{root}/snapshot_meta")
    return stamp


META = "stamp string, version int, identity string, file_count long, last_updated double, oversized boolean"


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """The newest pointer row, if any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot_meta")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no snapshot has been written yet
        return spark.createDataFrame([], META)
    return spark.read.schema(META).parquet(f"{root}/snapshot_meta").orderBy(F.desc("stamp")).limit(1)


def load_snapshot(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame] | None:
    stamp = [r.stamp for r in read_meta(spark, root).select("stamp").collect()]
    return {n: spark.read.parquet(f"{root}/{stamp[0]}/{n}") for n in names} if stamp else None


def cache_state(meta: DataFrame, identity: Column, version: Column, now: Column, ttl_hours: Column, is_current: Column) -> DataFrame:
    """One of the seven states of a stored index, decided in this order."""
    age = now - F.col("last_updated")
    return meta.select("*", (
        F.when(ttl_hours == 0, "disabled").when(F.col("version").isNull(), "missing").when(F.col("version") != version, "version-mismatch")
        .when(F.col("identity") != identity, "identity-mismatch").when(F.col("oversized"), "oversized")
        .when(age > ttl_hours * 3600, "stale").when(~is_current, "stale").otherwise("valid")).alias("cache_state"))


def is_current(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: do both hold the same paths with the same hashes?"""
    o, n = old.select("path", F.col("content_hash").alias("_o")), new.select("path", F.col("content_hash").alias("_n"))
    return o.join(n, "path", "full_outer").agg(F.count_if(F.col("_o").isNull() | F.col("_n").isNull() | (F.col("_o") != F.col("_n"))).alias("differences")).select((F.col("differences") == 0).alias("is_current"))


def freshness(age_seconds: Column, changes: Column) -> Column:
    """fresh / stale / old by age; pending changes make a fresh index stale."""
    return (F.when(age_seconds > 3600, "old").when(age_seconds > 600, "stale").when(changes > 0, "stale").otherwise("fresh"))


def write_graph(nodes: DataFrame, edges: DataFrame, root: str, run: str, filters: str = "", fmt: str = "parquet") -> None:
    """Node, edge and statistics tables of a run, partitioned by run. The same run written again replaces itself."""
    stats = nodes.groupBy("type").agg(F.count("*").alias("n")).withColumn("filters", F.lit(filters))
    for name, df in {"nodes": nodes, "edges": edges, "stats": stats}.items():
        df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").format(fmt).save(f"{root}/{name}")
