"""Quality classifier by co-training (operator 10).

Two views of a document that can each tell good from bad: what it says (its distinct words and punctuation, hashed) and its metadata (source,
language, length and layout figures). A logistic model per view starts from labelled documents. In each round both score all unlabelled
documents, calibrated on labelled documents kept out of training, and those of which a view is confident become pseudo-labels for the other
view's next model. None is taken twice, and none of which the views are confident in opposite ways. Last, each view's score is calibrated
again, and a combination of the two judges every document.

Bounds, all parameters: at most `max_labelled` labelled documents are fitted on, and of the confident ones the `exchange` most confident per view,
class and round, since the driver fits the models; it spreads out a block of rows at a time, and models have 2**18 and 2**12 weights. Scoring, and the search for the most confident documents, cover all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlstrata.llm import common as C

C.by_value(__name__)

TEXT_BITS, META_BITS = 18, 12
MAX_LABELLED, EXCHANGE, ROUNDS = 20_000, 500, 2
CONFIDENT = 0.9  # calibrated chance of a class from which on a document is a pseudo-label of it
HELD_OUT = 4  # one labelled document in so many calibrates
_CLASS = np.full(256, 1, np.uint8)  # 0 space, 1 letters and other bytes of words, 2 marks
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[c for c in range(33, 128) if not chr(c).isalnum()]] = 2
_KINDS = {"caps": range(65, 91), "marks": np.flatnonzero(_CLASS == 2), "digits": range(48, 58), "spaces": [32], "lines": [10]}
_KIND_OF = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}
_EDGES = {
    "chars": [2.0**k for k in range(3, 24)], "line": [2.0**k for k in range(2, 16)], "word": [2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15],
    "share": [0.0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7, 0.9],
}


def views(data: np.ndarray, offsets: np.ndarray, source: list, lang: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers of the two views of each row: its distinct words and marks, hashed, A-Z lower-cased; and source, language, length and layout."""
    rows, kind = len(offsets) - 1, _CLASS[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(edge)
    end = np.r_[start[1:], len(data)].astype(np.int64)
    real = kind[start] > 0
    start, end = start[real], end[real]
    doc = np.searchsorted(offsets, start, "right") - 1
    with np.errstate(over="ignore"):
        word = (C.Rolling(data, C.byte_values(True)).spans(start, end) >> np.uint64(64 - TEXT_BITS)).astype(np.int64)
    both = np.unique(doc << TEXT_BITS | word)
    ids = np.split((both & ((1 << TEXT_BITS) - 1)).astype(np.int32), np.searchsorted(both >> TEXT_BITS, np.arange(1, rows)))
    n, tokens, distinct = np.maximum(np.diff(offsets), 1), np.bincount(doc, minlength=rows), np.bincount(both >> TEXT_BITS, minlength=rows)
    per = {k: np.diff(np.r_[0, np.cumsum(of[data])][offsets]) for k, of in _KIND_OF.items()}
    letters = np.bincount(doc, (end - start) * (kind[start] == 1), rows)
    figures = [("chars", n), ("line", n / (per["lines"] + 1)), ("word", letters / np.maximum(1, np.bincount(doc, kind[start] == 1, rows)))]
    shares = [*((k, per[k] / n) for k in ("caps", "marks", "digits", "spaces")), ("distinct", distinct / np.maximum(tokens, 1))]
    steps = [(k, np.searchsorted(_EDGES[k], v)) for k, v in figures] + [(k, np.searchsorted(_EDGES["share"], v)) for k, v in shares]
    steps += [("caps+marks", steps[3][1] * 32 + steps[4][1]), ("distinct+chars", steps[7][1] * 32 + steps[0][1])]
    number = lambda s: zlib.crc32(s.encode("utf-8", "replace")) & ((1 << META_BITS) - 1)
    meta = np.stack([[number(f"source={x}") for x in source], [number(f"lang={x}") for x in lang],
                     *[np.array([number(f"{k}:{i}") for i in range(1024)])[v] for k, v in steps]], axis=1).astype(np.int32) if rows else np.zeros((0, 12), np.int32)
    return ids, meta


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))


def _views_of(texts: pa.Array, source: list, lang: list) -> tuple[pa.Array, pa.Array]:
    data, offs = C.bytes_of(texts)
    words, meta = [], []
    for i, j in C.row_blocks(offs):
        w, m = views(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], source[i:j], lang[i:j])
        words += w
        meta += list(m)
    return _lists(words), _lists(meta)


def _features(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int32())), ("meta", pa.list_(pa.int32())), ("same", pa.int64())])
    for batch in batches:
        words, meta = _views_of(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())
        offs, ids = np.asarray(words.offsets), np.asarray(words.values)
        same = [zlib.crc32(ids[a:b].tobytes()) << 20 ^ (b - a) for a, b in zip(offs.tolist(), offs[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), words, meta, pa.array(same, pa.int64())], schema=schema)


BLOCK = 1 << 19  # features that are worked on at once


class Rows:
    """Sparse 0/1 rows, for fitting and scoring. The ids stay in the Arrow buffer; a block of rows at a time is spread out."""

    def __init__(self, lists: pa.Array):
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        offs = np.asarray(lists.offsets, np.int64)
        self.ids = np.asarray(lists.values)[offs[0]:offs[-1]] if len(offs) else np.zeros(0, np.int32)
        self.offs = offs - offs[0] if len(offs) else np.zeros(1, np.int64)
        self.n = len(lists)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Slices of rows, with the ids of their features and the row within the slice of each."""
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.offs, self.offs[i] + BLOCK, "right")) - 1)
            yield slice(i, j), self.ids[self.offs[i]:self.offs[j]].astype(np.int64), np.repeat(np.arange(j - i), np.diff(self.offs[i:j + 1]))
            i = j

    def score(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(self.n)
        for s, ids, row in self.blocks():
            out[s] = np.bincount(row, w[ids], s.stop - s.start)
        return out + w[-1]


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, size: int, steps: int = 150, least: int = 4, l2: float = 3.0) -> np.ndarray:
    """Logistic weights, the last is the intercept. Each feature is scaled by its log ratio of document shares in the two classes
    (one in fewer than `least` documents by 0), which lets telling words count at once; then accelerated gradient steps with a ridge."""
    seen = [np.zeros(size), np.zeros(size)]
    for s, ids, row in rows.blocks():
        for c in (0, 1):
            seen[c] += np.bincount(ids, (weight[s] * (y[s] == c))[row], size)
    total = [max(1e-9, (weight * (y == c)).sum()) for c in (0, 1)]
    ratio = np.log((seen[1] + 1) / (total[1] + 2)) - np.log((seen[0] + 1) / (total[0] + 2))
    ratio[seen[0] + seen[1] < least] = 0
    top = 1e-9
    for s, ids, row in rows.blocks():
        top = max(top, np.bincount(row, ratio[ids] ** 2, s.stop - s.start).max())
    rate = 1 / (0.25 * (top + 1) * total[0] + 0.25 * (top + 1) * total[1] + l2)
    v = np.r_[np.zeros(size), np.log(total[1] / total[0])]
    ahead, t = v.copy(), 1.0
    for _ in range(steps):
        scaled, g = ahead[:-1] * ratio, np.zeros(size + 1)
        for s, ids, row in rows.blocks():
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, scaled[ids], s.stop - s.start) + ahead[-1], -30, 30)))
            err = (p - y[s]) * weight[s]
            g[:-1] += np.bincount(ids, err[row], size)
            g[-1] += err.sum()
        g[:-1] = g[:-1] * ratio + l2 * ahead[:-1]
        new, t2 = ahead - rate * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - v)
        v, t = new, t2
    return np.r_[v[:-1] * ratio, v[-1]]


def calibrate(scores: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of standardised score columns and an intercept, by Newton steps with a small ridge; the label shares stay as they are."""
    x = np.c_[scores, np.ones(len(scores))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Weights of both views, their scales and calibrations, and those of the combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.text, self.meta = text.astype(np.float32), meta.astype(np.float32)
        self.each = [np.array([1.0, 0.0]), np.array([1.0, 0.0])]
        self.both = np.array([1.0, 1.0, 0.0])
        self.exchanged: list[list[tuple[int, int, int]]] = []  # per round (doc_id, view that learns from it, label)

    def raw(self, words: pa.Array, meta: pa.Array) -> np.ndarray:
        return np.c_[Rows(words).score(self.text), Rows(meta).score(self.meta)]

    def logits(self, raw: np.ndarray) -> list[np.ndarray]:
        return [raw[:, i] * self.each[i][0] + self.each[i][1] for i in (0, 1)]

    def calibrated(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances that a document is good: by text, by metadata, by both."""
        logits = [np.clip(x, -30, 30) for x in self.logits(raw)]
        both = np.clip(self.both[0] * logits[0] + self.both[1] * logits[1] + self.both[2], -30, 30)
        return tuple(1 / (1 + np.exp(-x)) for x in (*logits, both))


def fitted(table: pa.Table) -> Model:
    """A model of all labelled and pseudo-labelled rows. A labelled row in HELD_OUT calibrates, if both classes are on both sides."""
    y = table.column("label").to_numpy().astype(float)
    view = table.column("view").to_numpy(zero_copy_only=False).astype(float)  # nan: labelled
    labelled = np.isnan(view)
    held = labelled & np.array([zlib.crc32(str(d).encode()) % HELD_OUT == 0 for d in table.column("doc_id").to_pylist()])
    if len(set(y[held])) < 2 or len(set(y[labelled & ~held])) < 2:
        held, test = np.zeros(len(y), bool), labelled
    else:
        test = held
    weights = []
    for v, (name, bits) in enumerate((("words", TEXT_BITS), ("meta", META_BITS))):
        use = labelled & ~held | (view == v)
        weights.append(fit(Rows(table.column(name).filter(pa.array(use))), y[use], np.where(labelled[use], 1.0, 0.5), 1 << bits))
    model = Model(*weights)
    raw = model.raw(table.column("words").filter(pa.array(test)), table.column("meta").filter(pa.array(test)))
    model.each = [calibrate(raw[:, [i]], y[test]) for i in (0, 1)]
    model.both = calibrate(np.clip(np.c_[model.logits(raw)].T, -30, 30), y[test])
    return model


def _scored(model: Model):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("text", pa.float64()), ("meta", pa.float64())])
        for batch in batches:
            text, meta = model.logits(model.raw(batch.column(1), batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(text), pa.array(meta)], schema=schema)
    return run


def _judged(model: Model):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.float64()) for c in ("p_text", "p_meta", "score")], ("keep", pa.bool_())])
        for batch in batches:
            a, b, both = model.calibrated(model.raw(batch.column(1), batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= 0.5)], schema=schema)
    return run


def features(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")])
    return rows.mapInArrow(_features, "doc_id bigint, words array<int>, meta array<int>, same bigint")


def train(found: DataFrame, labels: DataFrame, rounds: int = ROUNDS, exchange: int = EXCHANGE, max_labelled: int = MAX_LABELLED, confident: float = CONFIDENT) -> Model | None:
    """Co-trained model from `features()` and `labels(doc_id, quality, toxic)`; good is quality 1 and not toxic. None without labels of both kinds."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    good = C.stored(good, "labels")
    sample = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = found.where("doc_id IS NOT NULL").join(sample, "doc_id").dropDuplicates(["doc_id"])
    known = C.stored(known.select("doc_id", "words", "meta", F.col("good").alias("label"), F.lit(None).cast("int").alias("view")), "known")
    if known.select("label").distinct().count() < 2:
        return None
    rows = known.toArrow()  # and the pseudo-labelled rows of each round, with the view that learns from them
    model = fitted(rows)
    exchanged: list[list[tuple[int, int, int]]] = []
    taken: set[int] = set()
    least = float(np.log(confident / (1 - confident)))
    open_ = found.where("doc_id IS NOT NULL").join(good.select(F.col("doc_id").alias("_l")), F.col("doc_id") == F.col("_l"), "left_anti")
    for _ in range(rounds):
        scores = open_.select("doc_id", "words", "meta", "same").mapInArrow(_scored(model), "doc_id bigint, same bigint, text double, meta double")
        # copies say the same thing once: one row per set of words, that of the smallest doc_id
        scores = C.stored(scores.groupBy("same").agg(F.min(F.struct("doc_id", "text", "meta")).alias("x")).select("same", "x.*"), "scores")
        sure = scores.where(~(((F.col("text") >= least) & (F.col("meta") <= -least)) | ((F.col("text") <= -least) & (F.col("meta") >= least))))
        if taken:  # at most 4 * exchange a round
            sure = sure.join(F.broadcast(found.sparkSession.createDataFrame([(i,) for i in sorted(taken)], "_t bigint")), F.col("same") == F.col("_t"), "left_anti")
        picked: dict[int, list[tuple[int, int]]] = {}
        for view, c in enumerate(("text", "meta")):
            for label, order, some in ((1, F.desc(c), F.col(c) >= least), (0, F.asc(c), F.col(c) <= -least)):
                for r in sure.where(some).orderBy(order, "doc_id").limit(exchange).collect():
                    picked.setdefault(r["doc_id"], []).append((1 - view, label))  # to the other view
                    taken.add(r["same"])
        if not picked:
            break
        exchanged.append([(d, v, label) for d, of in picked.items() for v, label in of])
        spark = found.sparkSession
        ids = spark.createDataFrame([(i,) for i in picked], "doc_id bigint")  # at most 4 * exchange rows
        got = found.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "words", "meta")
        want = spark.createDataFrame([(d, label, v) for d, of in picked.items() for v, label in of], "doc_id bigint, label int, view int")
        rows = pa.concat_tables([rows, got.join(F.broadcast(want), "doc_id").select(*rows.column_names).toArrow().cast(rows.schema)])
        model = fitted(rows)
    model.exchanged = exchanged
    del rows
    pa.default_memory_pool().release_unused()
    return model


def judge(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """`docs(doc_id, text, lang, source, ...)` and `labels(doc_id, quality, toxic)` to `(doc_id, p_text, p_meta, score, keep)`, one row per input row.

    `score` is the calibrated chance that a document is of quality and not toxic, `keep` says it is at least one half. Null texts are judged as
    empty ones, null sources and languages as values of their own; rows with a null doc_id are judged but not trained on. Several labels of a
    document count as the worst; a null quality is no label, a null toxic flag not toxic. Without labels of both kinds all is kept with
    score 1. Repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    found = C.stored(features(docs), "features")
    model = train(found, labels, **bounds)
    if model is None:
        return found.select("doc_id", *[F.lit(1.0).alias(c) for c in ("p_text", "p_meta", "score")], F.lit(True).alias("keep"))
    return found.select("doc_id", "words", "meta", "same").mapInArrow(_judged(model), "doc_id bigint, p_text double, p_meta double, score double, keep boolean")


def _kept(model: Model, at: dict[str, int]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                text = lambda c: [None if x is None else str(x) for x in batch.column(at[c]).to_pylist()]
                batch = batch.filter(pa.array(model.calibrated(model.raw(*_views_of(batch.column(at["text"]), text("source"), text("lang"))))[2] >= 0.5))
            yield batch
    return run


def kept(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns: texts are judged where they are, none is moved."""
    model = train(C.stored(features(docs), "features"), labels, **bounds)
    if model is None:
        return docs
    return docs.mapInArrow(_kept(model, {c: docs.columns.index(c) for c in ("text", "source", "lang")}), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged."""
    return judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
