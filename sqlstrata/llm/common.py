"""Shared pieces of the operators: stored steps, texts as bytes, rolling hashes, and bit sets of fixed size."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

CHUNK_BYTES = 1 << 20  # what is hashed at once; longer texts are worked through in pieces or alone


def by_value(name: str) -> None:
    """Functions of a module travel to the executors by value, so nothing has to be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts are long, so Arrow batches of the session are made no larger than BATCH_ROWS rows."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it back: it is made once, and a lost executor loses nothing."""
    from sqlstrata.session import scratch_path  # here, so that what travels to executors does not name the package

    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_FILE = 500_000


def _kept(df: DataFrame, rows: int | None) -> tuple[DataFrame, tuple[int, int]]:
    """`stored` for the pairs of a loop in files of a useful size, with their number and a sum over them that tells whether they changed."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"))
    out = stored(df if rows is None else df.coalesce(rows // ROWS_PER_FILE + 1), "pairs")
    return out, (seen.get["n"], seen.get["h"])


def components(links: DataFrame) -> DataFrame:
    """`links(a, b)` to `(node, component)` of all linked nodes: connected components, named by their smallest node.

    Large-star and small-star rounds: each joins neighbours to the smallest one, so stars and chains alike take few rounds. A hot node's
    neighbours are first aggregated to one minimum, and joins on it can be split.
    """
    pairs, state = _kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), None)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, _ = _kept(large, 2 * state[0])
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("u", "v"))
        before = state
        pairs, state = _kept(small.where("u <> v").distinct(), 2 * state[0])
        if state == before:
            break
    named = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return named.union(named.select(F.col("component").alias("node"), "component").distinct())


# ---- texts as bytes ----

def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]] if len(offs) else raw[:0], offs - (offs[0] if len(offs) else 0)


def row_blocks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `limit` bytes together; a longer row is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---- hashes ----

_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(fold_case: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z if case is folded."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    if fold_case:
        v[65:91] = v[97:123]
    return v


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["q"][:n]


class Rolling:
    """Hashes of any substring of a byte array by differences of one running sum."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        p, self.q = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * p[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.q[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each position on."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.q[:n])


# ---- bit sets: a superset of some keys in a fixed number of bits ----

SET_BITS = 1 << 25  # 4 MB, whatever the data; more keys only let more others through


def bit_sets(keys: DataFrame, conditions: list[Column], bits: int = SET_BITS) -> bytes:
    """The keys of the first column of `keys` for which each condition holds, as one bit set after the other. At most bits / 64 rows reach the driver."""
    c = keys.columns[0]
    s = keys.where(F.col(c).isNotNull()).select(F.col(c).cast("long").bitwiseAND(F.lit(bits - 1)).alias("s"), *[x.alias(f"c{i}") for i, x in enumerate(conditions)])
    bit = F.expr("shiftleft(1L, CAST(s & 63 AS INT))")
    words = s.groupBy(F.shiftright("s", 6).alias("w")).agg(*[F.bit_or(F.when(F.col(f"c{i}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(len(conditions))])
    got, out = words.toArrow(), np.zeros((len(conditions), bits // 64), np.int64)
    if got.num_rows:
        for i in range(len(conditions)):
            out[i, got.column("w").to_numpy()] = got.column(f"b{i}").to_numpy()
    return out.tobytes()


def bit_set(keys: DataFrame, bits: int = SET_BITS) -> bytes:
    """The keys of the one column of `keys`, as a bit set for `in_bits`."""
    return bit_sets(keys, [F.lit(True)], bits)


def in_bits(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each key may be in the set."""
    s = keys.astype(np.int64) & np.int64(len(bits) * 64 - 1)
    return ((bits[s >> 6] >> (s & 63)) & 1).astype(bool)


def shared_array(spark: SparkSession, raw: bytes):
    """Broadcast bytes of fixed size; `np.frombuffer(b.value, np.int64)` in the task."""
    return spark.sparkContext.broadcast(raw)
