"""An index kept up to date by a change feed: `changes(path, change_type, mtime, sql)`, append-only."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sqlstrata.operators import definitions as D, refs as R, statements as S

CHANGES = "path string, change_type string, mtime timestamp, sql string"
FILES = "path string, content_hash string"


def read_changes(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CHANGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _order(kind: Column, mtime: Column, content_hash: Column) -> Column:
    """What decides between two changes of a path, whatever batch brings them: time (none is the oldest), then a delete, then the greater hash."""
    return F.struct(F.coalesce(mtime, F.timestamp_seconds(F.lit(0))).alias("t"), kind.alias("d"), F.coalesce(content_hash, F.lit("")).alias("h"))


def latest(changes: DataFrame) -> DataFrame:
    """Last change of each path, by time; a delete wins over a write of the same instant."""
    last = F.max_by(F.struct("change_type", "mtime", "sql"), _order(F.col("change_type") == "delete", F.col("mtime"), F.sha2("sql", 256)))
    return changes.groupBy("path").agg(last.alias("c")).select("path", "c.change_type", "c.mtime", "c.sql")


def index_of(files: DataFrame) -> dict[str, DataFrame]:
    """Index tables of `(path, sql)` rows."""
    corpus = files.select(F.col("path").alias("doc_id"), "path", "sql")
    stmts = S.statements(corpus)
    refs = R.base_table_refs(stmts).groupBy("path", "table_key", "ref_type").agg(F.count("*").alias("n"))
    defs = D.definitions(stmts).select("path", "def_type", "table_key", "line")
    return {"files": files.select("path", F.sha2("sql", 256).alias("content_hash")), "refs": refs, "defs": defs}


TABLES = ("files", "refs", "defs")
COMPACT = 16  # so many deltas are merged into a new base

# A batch writes one delta: `files` has a row for each path it changes, with its last change, a tombstone if that deletes it, and the batch that wrote
# its `refs` and `defs`. A base is a delta of everything. Empty marker files below `log`, one for each finished version, tell which versions count.


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _log(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Finished versions as (batch, "base" or "delta"), oldest first; a batch's delta before the base made of it. At most about 2 * COMPACT entries."""
    fs, path = _fs(spark, f"{root}/log")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    found = [(int(n.split(".")[0]), n.split(".")[1]) for n in names if n.endswith((".base", ".delta"))]
    return sorted(found, key=lambda v: (v[0], v[1] == "base"))


def _live(log: list[tuple[int, str]]) -> list[str]:
    """Folders of the newest base and the deltas after it."""
    last = max((i for i, (_, kind) in enumerate(log) if kind == "base"), default=0)
    return [f"{batch:012d}.{kind}" for batch, kind in log[last:]]


def _finish(spark: SparkSession, root: str, version: str) -> None:
    fs, path = _fs(spark, f"{root}/log/{version}")
    fs.create(path, True).close()


def _read(spark: SparkSession, root: str, table: str, versions: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{v}/{table}" for v in versions])


def _newest(files: DataFrame) -> DataFrame:
    """The last row of each path over several versions."""
    last = F.max_by(F.struct("mtime", "deleted", "content_hash", "rows_in"), _order(F.col("deleted"), F.col("mtime"), F.col("content_hash")))
    return files.groupBy("path").agg(last.alias("f")).select("path", "f.*")


def _current(spark: SparkSession, root: str, versions: list[str], files: DataFrame | None = None) -> dict[str, DataFrame]:
    """The merged tables, tombstones and bookkeeping included. Rows of `refs` and `defs` count if the newest row of their path names their batch. `files`: the merged one, if it is there already."""
    files = _newest(_read(spark, root, "files", versions)) if files is None else files
    shown = files.where("NOT deleted").select("path", "rows_in")
    return {"files": files} | {t: _read(spark, root, t, versions).join(shown, ["path", "rows_in"], "left_semi") for t in TABLES[1:]}


def load_index(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The index tables as of the last finished version; None before the first."""
    log = _log(spark, root)
    if not log:
        return None
    now = _current(spark, root, _live(log))
    return {"files": now["files"].where("NOT deleted").select("path", "content_hash")} | {t: now[t].drop("rows_in") for t in TABLES[1:]}


def differences(one: dict[str, DataFrame], other: dict[str, DataFrame]) -> DataFrame:
    """`differences`: rows that only one of two indexes holds, repeated ones counted. Each table of each is computed and shuffled once."""
    def apart(t: str) -> DataFrame:
        side = lambda index, n: index[t].select(*one[t].columns, F.lit(n).alias("_n"))
        return side(one, 1).unionByName(side(other, -1)).groupBy(*one[t].columns).agg(F.abs(F.sum("_n")).alias("_n")).select("_n")
    first, *rest = [apart(t) for t in TABLES]
    return reduce(DataFrame.union, rest, first).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("differences"))


def compact(spark: SparkSession, root: str) -> None:
    """Merge the live versions into a base, then remove what lies before the last base but one: a reader of the last one keeps its files."""
    log = _log(spark, root)
    version = f"{log[-1][0]:012d}.base"
    _newest(_read(spark, root, "files", _live(log))).write.mode("overwrite").parquet(f"{root}/{version}/files")
    now = _current(spark, root, _live(log), _read(spark, root, "files", [version]))  # the newest rows are found once for all tables
    for t in TABLES[1:]:
        now[t].write.mode("overwrite").parquet(f"{root}/{version}/{t}")
    _finish(spark, root, version)
    bases = [i for i, (_, kind) in enumerate(log) if kind == "base"]
    for batch, kind in log[:bases[-1]] if bases else []:
        for folder in (f"log/{batch:012d}.{kind}", f"{batch:012d}.{kind}"):  # the marker first: no version counts without its files
            fs, path = _fs(spark, f"{root}/{folder}")
            fs.delete(path, True)


def apply_batch(root: str):
    """A `foreachBatch` function: coalesce, drop what is older than the index knows, write the rest as a delta.

    A change that comes late loses against a newer one of an earlier batch, deletes included. A change without a difference only moves the time
    of its path. Work per batch goes with the batch: of the index it reads the changed paths' `files` rows. A batch that is run again after a failure
    finds its number in the log and does nothing, or writes its delta again.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = _log(spark, root)
        if log and log[-1][0] >= batch_id:
            return
        version, deleted = f"{batch_id:012d}.delta", F.col("change_type") == "delete"
        change = latest(batch).select("path", "mtime", deleted.alias("deleted"), F.when(~deleted, F.sha2("sql", 256)).alias("content_hash"), F.when(~deleted, F.col("sql")).alias("sql"))
        rows_in = F.lit(batch_id).cast("long")
        if log:
            before = _newest(_read(spark, root, "files", _live(log)).join(change.select("path"), "path", "left_semi"))
            before = before.select("path", _order(F.col("deleted"), F.col("mtime"), F.col("content_hash")).alias("_o"), F.col("content_hash").alias("_h"), F.col("rows_in").alias("_r"))
            change = change.join(before, "path", "left")
            change = change.where(F.col("_o").isNull() | (_order(F.col("deleted"), F.col("mtime"), F.col("content_hash")) > F.col("_o")))
            rows_in = F.when(F.col("_h") == F.col("content_hash"), F.col("_r")).otherwise(rows_in)
        change.select("path", "mtime", "deleted", "content_hash", rows_in.alias("rows_in"), "sql").write.mode("overwrite").parquet(f"{root}/changes/{batch_id}")
        change = spark.read.parquet(f"{root}/changes/{batch_id}")
        change.drop("sql").write.mode("overwrite").parquet(f"{root}/{version}/files")
        fresh = index_of(change.where(~F.col("deleted") & (F.col("rows_in") == batch_id)).select("path", "sql"))
        for t in TABLES[1:]:
            fresh[t].withColumn("rows_in", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{root}/{version}/{t}")
        _finish(spark, root, version)
        fs, staged = _fs(spark, f"{root}/changes/{batch_id}")
        fs.delete(staged, True)
        if len(_live(log)) >= COMPACT:
            compact(spark, root)
    return run


def maintain_index(changes: DataFrame, root: str, continuous: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Keep the index under `root` current. `continuous` waits for more changes; otherwise the query ends after those present."""
    writer = changes.writeStream.foreachBatch(apply_batch(root)).option("checkpointLocation", os.path.join(root, "_progress"))
    return (writer.trigger(processingTime=interval) if continuous else writer.trigger(availableNow=True)).start()


def pending_changes(feed: DataFrame, root: str) -> DataFrame:
    """Paths whose newest change is not in the index yet and makes a difference to it."""
    spark = feed.sparkSession
    deleted = F.col("change_type") == "delete"
    now = latest(feed).select("path", "mtime", deleted.alias("deleted"), F.when(~deleted, F.sha2("sql", 256)).alias("content_hash"))
    log = _log(spark, root)
    if not log:
        return now.agg(F.count("*").alias("pending"))
    known = _newest(_read(spark, root, "files", _live(log)))
    known = known.select("path", _order(F.col("deleted"), F.col("mtime"), F.col("content_hash")).alias("_o"), F.when(~F.col("deleted"), F.col("content_hash")).alias("_h"))
    newer = F.col("_o").isNull() | (_order(F.col("deleted"), F.col("mtime"), F.col("content_hash")) > F.col("_o"))
    return now.join(known, "path", "left").agg(F.count_if(newer & ~F.col("content_hash").eqNullSafe(F.col("_h"))).alias("pending"))
