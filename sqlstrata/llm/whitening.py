"""Whitening of embeddings by shifted CholeskyQR (operator 11).

Entries become whole numbers, x = floor(64 * c) + 1000000, and the fit list holds each different vector once. Its centred rows A are orthogonalised
without ever being gathered: a pass over the rows adds up the Gram matrix of A R1^-1 ... Rk^-1, each row going through triangular solves, and the
Cholesky factor of that matrix is the next R. The first one is shifted, so that it exists for any condition number; the passes end when the Gram matrix
is the identity to rounding. R = Rk ... R1 then has the singular values and right vectors of A: its SVD gives components and eigenvalues without
the squared condition number that an eigenvector of the covariance would suffer from. Driver and tasks hold matrices of dimension x dimension, rows stay where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlstrata.llm import common as C

C.by_value(__name__)

STEP, BASE = 64, 1_000_000
COMPONENTS = 16
PASSES = 8
ROWS = 4096  # rows that are solved at once
_HALF = 31
_LARGEST = float(1 << 62)


def coded(vectors: DataFrame) -> DataFrame:
    """`(vec_id, x array<bigint>)` of the rows whose vector has only finite entries (and codes that are longs)."""
    c = F.col("embedding").cast("array<double>")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * STEP) < _LARGEST)) & (F.size(c) > 0)
    rows = vectors.select("vec_id", F.when(usable, c).alias("c")).where("c IS NOT NULL")
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * STEP) + BASE).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length to rows."""
    offsets = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values, np.int64)[offsets[0]:offsets[-1]].reshape(len(column), -1)


def _sums(batches):
    """Per length of vectors their number and the sums of upper and lower halves of their entries, which a long can hold."""
    schema = pa.schema([("size", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
    sums: dict[int, list] = {}
    for batch in batches:
        sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes).tolist():
            x = _matrix(batch.column(0).filter(pa.array(sizes == d)))
            n, high, low = sums.setdefault(d, [0, 0, 0])
            sums[d] = [n + len(x), high + (x >> _HALF).sum(0), low + (x & ((1 << _HALF) - 1)).sum(0)]
    for d, (n, high, low) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], schema=schema)


class Centred:
    """n times a row less the sums, in whole numbers; over n that is the centred row, rounded once."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.low = np.array([s & ((1 << 64) - 1) for s in sums], np.uint64)
        self.mean = np.array([s / n for s in sums])

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S modulo 2**64, which is the number itself wherever a long can hold it."""
        return (x.astype(np.uint64) * np.uint64(self.n & ((1 << 64) - 1)) - self.low).view(np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        near = x - self.mean
        return np.where(np.abs(near) * self.n < 2.0**62, self.exact(x) / self.n, near)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n * x - S per row; None where a long cannot hold it."""
        about = ((self.n * (x - self.mean)) ** 2).sum(1)
        y = self.exact(x)
        found: list[int | None] = (y * y).sum(1).tolist()
        for i in np.flatnonzero(~(about < 2.0**61)).tolist():
            whole = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums))
            found[i] = whole if whole < 1 << 63 else None
        return found


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows times the inverse of an upper triangular matrix, by substitution."""
    out = rows.copy()
    for j in range(len(r)):
        out[:, j] = (out[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _gram(centre: Centred, factors: list[np.ndarray], after: np.ndarray | None = None):
    """Rows to the Gram matrix of the centred ones after all solves and a projection, one row of it per output row."""
    def run(batches):
        schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                q = centre.rows(x[at:at + ROWS])
                for r in factors:
                    q = solved(q, r)
                q = q if after is None else q @ after
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)
    return run


def gram(fit: DataFrame, centre: Centred, factors: list[np.ndarray], after: np.ndarray | None = None) -> np.ndarray:
    """Tasks add up their rows, Spark adds up the tasks by matrix entry; the driver gets one matrix."""
    parts = fit.mapInArrow(_gram(centre, factors, after), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    got = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    size = int(np.sqrt(got.num_rows) + 0.5)
    out = np.zeros((size, size))
    out[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
    return (out + out.T) / 2


def _cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of g, shifted as far as it needs: at once by `shift`, then tenfold if it still is not definite."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, np.finfo(float).eps * max(np.trace(g), np.finfo(float).tiny))


class Whitening:
    """Number and sums of the fit list, components as columns, their eigenvalues, the trace, and the passes it took."""

    def __init__(self, centre: Centred, vectors: np.ndarray, values: np.ndarray, trace: float, passes: int):
        self.centre, self.vectors, self.values, self.trace, self.passes = centre, vectors, values, trace, passes
        self.projection = vectors / np.sqrt(values)
        self.identity_error = 0.0


def fit(x: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the different vectors of `x(x)`, and these vectors. None without a vector, or where no direction varies."""
    distinct = C.stored(x.select("x").groupBy("x").agg(F.lit(1).alias("_")).select("x"), "fit")
    sums = distinct.mapInArrow(_sums, "size int, at int, n bigint, high bigint, low bigint").groupBy("size", "at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    if not sums:
        return None, distinct
    n, d = max((r["n"], r["size"]) for r in sums)
    own = sorted((r["at"], (r["high"] << _HALF) + r["low"]) for r in sums if r["size"] == d)
    centre = Centred(n, [s for _, s in own])
    distinct = distinct.where(F.size("x") == d)
    unit, factors = np.finfo(float).eps / 2, []
    g = gram(distinct, centre, factors)
    trace = float(np.trace(g))
    if not trace > 0:
        return None, distinct
    r, shift = np.eye(d), 11 * (n * d + d * (d + 1)) * unit * trace
    while len(factors) < PASSES and np.abs(g - np.eye(d)).max() > 4 * d * unit:
        factors.append(_cholesky(g, shift))
        r, shift = factors[-1] @ r, 0.0
        g = gram(distinct, centre, factors)
    # what the last Gram matrix differs from the identity by (rounding, or directions that do not vary) is one more factor
    spread, turn = np.linalg.eigh(g)
    r = (np.sqrt(np.maximum(spread, 0))[:, None] * turn.T) @ r
    _, sigma, vt = np.linalg.svd(r)
    k = min(components, int((sigma > sigma[0] * d * 4 * unit).sum()))
    vectors = vt[:k].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    model = Whitening(centre, vectors, sigma[:k] ** 2 / n, trace / n, len(factors) + 1)
    model.identity_error = float(np.abs(gram(distinct, centre, [], model.projection) / n - np.eye(k)).max())
    return model, distinct


def _projected(model: Whitening):
    def run(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
        k = len(model.values)
        for batch in batches:
            x = _matrix(batch.column(1))
            for at in range(0, len(x), ROWS):
                part = x[at:at + ROWS]
                z, many = model.centre.rows(part) @ model.projection, len(part)
                row = pa.array(np.repeat(np.arange(many), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, many).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, model.centre.n)),
                    pa.array(model.centre.deviation(part), pa.int64()).take(row), pa.array(z.ravel()), pa.array(np.tile(model.values / model.trace, many)), pa.array(np.full(many * k, model.identity_error))], schema=schema)
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """`vectors(vec_id, embedding, ...)` to `(vec_id, component, n, deviation, whitened, explained, identity_error)`, one row per kept row and component.

    Rows go whose vector is null or empty, holds a null or an entry that is not finite (or whose code is no long), and rows whose vector has another
    length than most different ones (of equally many, the longer). Equal vectors are fitted once, but every row is returned, repeated ids and
    null ids too. A deviation that no long can hold is null. Components in whose direction nothing varies have no rows; without a varying
    direction (no rows, one vector) the result is empty. Each component's largest entry is positive; other columns are ignored.
    """
    x = coded(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    model, _ = fit(x, components)
    types = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return x.sparkSession.createDataFrame([], types)
    return x.where(F.size("x") == len(model.centre.sums)).mapInArrow(_projected(model), types)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened."""
    return whiten(C.table(spark, sf_dir, "embeddings"))
