"""Session helpers: local sessions for tests, and where loops cut their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int = 8, app: str = "sqlstrata", memory: str = "16g") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: dict[str, str] = {}  # one temporary folder per local application that names none


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    if sc.applicationId not in _fallback:
        _fallback[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _fallback[sc.applicationId]


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a step of a loop to the shared folder and read it back.

    The plan starts anew, a lost executor loses nothing, and the next join knows the real size of the step.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, label: str = "step") -> tuple[DataFrame, int]:
    """`cut`, with the number of rows observed while they were written: no second job counts them."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return out, seen.get["rows"]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run's tables."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a source's rows out evenly by `keys`: over all cores, and over eight tasks for each split of a source with more splits than cores.

    The number of splits does not tell how many tasks get rows: a Parquet file is read by row group, so that a large file of one group is one task with all rows and others with none.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if splits < cores else 8 * splits, *keys)
