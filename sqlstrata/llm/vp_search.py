"""Nearest neighbours with vantage-point trees per shard (operator 6).

Vectors are dealt into shards of bounded size. Each shard is a tree: a node's vantage point splits its vectors at the median distance into near and
far ones. A search leaves out a side that the triangle inequality rules out for the k-th best distance so far, times a factor: with factor
one nothing nearer is ever left out, a smaller factor prunes more. Queries go to every shard in blocks, and the k best of each shard are merged.
All queries of a block walk a tree together, so each step is one array operation: a matrix product tells, with a bound on its error, which rows of
a leaf may be near enough, and only their distances are computed component by component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sqlstrata.llm import common as C

C.by_value(__name__)

K = 10
FACTOR = 1.0  # 1: exact; below: prunes as if the k-th best were so much nearer
EVERY = 100  # queries are the rows whose vec_id this divides
SHARD_ROWS, BLOCK_ROWS, LEAF = 20_000, 4_000, 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed one component after the other in double precision."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for j in range(a.shape[-1]):
        d = a[..., j] - b[..., j]
        total += d * d
    return np.sqrt(total)


class Tree:
    """Vantage-point tree over the rows of a matrix, as arrays: nodes hold a vantage row, a radius and two children, leaves a range of rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.ids, self.order = points, ids, np.arange(len(points))
        self.sizes = np.einsum("ij,ij->i", points, points)
        self.nodes: list[tuple] = []
        if len(points):
            self._build(leaf)

    def _build(self, leaf: int) -> None:
        self.nodes.append(())
        todo = [(0, 0, len(self.points))]
        while todo:
            node, lo, hi = todo.pop()
            if hi - lo <= leaf:
                self.nodes[node] = (None, lo, hi)
                continue
            part = self.order[lo:hi]
            pick = lo + (hi - lo) // 2
            self.order[lo], self.order[pick] = self.order[pick], self.order[lo]
            vantage = self.order[lo]
            d = distances(self.points[part[1:]], self.points[vantage])
            by = np.argsort(d, kind="stable")
            self.order[lo + 1:hi] = part[1:][by]
            d = d[by]
            mid = len(d) // 2
            near, far = len(self.nodes), len(self.nodes) + 1
            self.nodes += [(), ()]
            self.nodes[node] = (vantage, d[mid - 1], d[mid], d[-1], near, far)
            todo += [(near, lo + 1, lo + 1 + mid), (far, lo + 1 + mid, hi)]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest of each query, nearest first and ties by id; inf and -1 where there are fewer. A row of the query's own id is left out."""
        best = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), np.iinfo(np.int64).max)
        dims = queries.shape[-1]
        slack = 16 * (dims + 8) * np.finfo(float).eps  # more than a matrix product or a sum of squares can be off, as a share of the two squared lengths
        q_size = np.einsum("ij,ij->i", queries, queries)

        def squares(q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Squared distances by one matrix product, and how far they may be off."""
            both = q_size[q][:, None] + self.sizes[rows]
            return both - 2 * (queries[q] @ self.points[rows].T), slack * both

        def offer(q: np.ndarray, rows: np.ndarray, near: np.ndarray, off: np.ndarray):
            """Exact distances of the pairs that may belong to a list; all others are surely farther than its last. A NaN may belong."""
            last = best[q, -1] ** 2
            may = ~(near - off > (last * (1 + slack))[:, None]) & (self.ids[rows] != own[q][:, None])
            better = may.any(axis=1)
            q, may = q[better], may[better]
            if not len(q):
                return
            at, col = np.nonzero(may)
            d = np.full(may.shape, np.inf)
            for a in range(0, len(at), 1 << 15):
                d[at[a:a + (1 << 15)], col[a:a + (1 << 15)]] = distances(queries[q[at[a:a + (1 << 15)]]], self.points[rows[col[a:a + (1 << 15)]]])
            if d.shape[1] > k:  # of a leaf only what its own k nearest reach, ties included
                cut = np.partition(d, k - 1, axis=1)[:, k - 1]
                keep = ((d <= cut[:, None]) & ~np.isinf(d)).any(axis=0)
                d, rows = d[:, keep], rows[keep]
            ids = np.broadcast_to(self.ids[rows], d.shape)
            all_d, all_i = np.concatenate([best[q], d], axis=1), np.concatenate([who[q], np.where(np.isinf(d), np.iinfo(np.int64).max, ids)], axis=1)
            o = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best[q], who[q] = np.take_along_axis(all_d, o, 1), np.take_along_axis(all_i, o, 1)

        def sides(node: tuple, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Least distances that the triangle inequality leaves a query to the near and the far vectors, from its squared distance to the vantage point."""
            near_most, far_least, far_most = node[1:4]
            low, high = np.sqrt(np.fmax(0.0, (d - off)[:, 0])), np.sqrt(np.fmax(0.0, (d + off)[:, 0]))
            return np.fmax(0.0, low - near_most * (1 + slack)), np.fmax(np.fmax(0.0, far_least * (1 - slack) - high), low - far_most * (1 + slack))

        # first each query's own leaf, so that its list starts with near rows
        home = np.full(len(queries), -1)
        own_way = [(0, np.arange(len(queries)))] if self.nodes else []
        while own_way:
            node, q = own_way.pop()
            what = self.nodes[node]
            if what[0] is None:
                home[q] = node
                rows = self.order[what[1]:what[2]]
                offer(q, rows, *squares(q, rows))
                continue
            to_near, to_far = sides(what, *squares(q, np.array([what[0]])))
            own_way += [(child, q[side]) for child, side in ((what[4], to_near <= to_far), (what[5], to_near > to_far)) if side.any()]
        # then all queries walk the tree together, each without its own leaf: (node, queries, least distance that the triangle inequality leaves them)
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))] if self.nodes else []
        while todo:
            node, q, least = todo.pop()
            open_ = (least * (1 - 1e-12) <= best[q, -1] * factor) & (home[q] != node)
            q = q[open_]
            if not len(q):
                continue
            what = self.nodes[node]
            rows = self.order[what[1]:what[2]] if what[0] is None else np.array([what[0]])
            d, off = squares(q, rows)
            offer(q, rows, d, off)
            if what[0] is not None:
                to_near, to_far = sides(what, d, off)
                todo += [(what[5], q, to_far), (what[4], q, to_near)]
        return best, np.where(np.isinf(best), -1, who)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _search(k: int, factor: float):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(queries):
            points = points.sort_values("vec_id", kind="stable")
            for size, part in points.groupby(points["vector"].map(len)):
                asked = queries[queries["vector"].map(len) == size]
                if not len(asked):
                    continue
                tree = Tree(_matrix(part["vector"]), part["vec_id"].to_numpy())
                for a in range(0, len(asked), BLOCK_ROWS):
                    block = asked.iloc[a:a + BLOCK_ROWS]
                    d, who = tree.search(_matrix(block["vector"]), block["vec_id"].to_numpy(), k, factor)
                    keep = who >= 0
                    out.append(pd.DataFrame({"query_id": np.repeat(block["vec_id"].to_numpy(), k).reshape(who.shape)[keep], "vec_id": who[keep], "score": d[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return run


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector) of the rows with an id and a vector of finite components that are not all zero."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = K, factor: float = FACTOR, every: int = EVERY, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`vectors(vec_id bigint, embedding array<float>, ...)` to `(query_id, rank, vec_id, score)`: the k nearest of each row whose id `every` divides.

    `score` is the Euclidean distance in double precision; ties go to the smaller vec_id; fewer than k others give fewer rows. Vectors that are
    null, zero, empty, or hold null or non-finite components take no part; only vectors of one length are compared. Of repeated rows of one
    vec_id the smallest vector is taken. Other columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors, id_column, vector_column).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = C.stored(rows, "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    # every shard sees every query, in blocks that one task can hold
    blocks = max(1, -(-asked.count() // (BLOCK_ROWS * 8)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(_search(k, factor), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each query among all embeddings."""
    return nearest(C.table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
