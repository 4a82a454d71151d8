"""Exact repeated-passage removal with a run-length index (operator 9).

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Every such string (window) names one of its k-grams, the
one of smallest hash; equal windows name equal k-grams. Windows in a row that share their k-gram occurrence form a segment, so equal windows
lie in segments of one anchor, whatever documents they are in, and each anchor can be judged apart from all others.

Segments that occur twice as a whole are repeated as they are: copies are collapsed to one text before indexing. Where an anchor has
several different segments, these meet in a shard. The shard's Burrows-Wheeler transform is cut into runs, the suffix positions at the run
ends are kept as samples, and matches are extended only there: within a run the match length of the next text position is one less, so
one pass over the text streams the matching statistics of all segments from the samples. Windows whose statistic reaches `length` are marked.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sqlstrata.llm import common as C

C.by_value(__name__)

LENGTH, K = 200, 32
PIECE = 4 << 20  # longer texts are worked through in pieces that overlap by one window
SHARD_BYTES = 2 << 20
MANY = 6000  # segments of one anchor; beyond, its windows are counted as rows
_POS = np.uint64((1 << 23) - 1)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Segments of the rows of a byte array: row, start, windows, anchor, hash, and the hash of every row's begin .. end slice via `roll`."""
    rows = np.diff(offsets)
    count = np.maximum(rows - length + 1, 0)
    if not count.sum():
        return None
    roll = C.Rolling(data, C.byte_values(False))
    grams = roll.windows(k)
    low = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    row = np.repeat(np.arange(len(rows)), count)
    start = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    at = (low[start] & _POS).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    windows = np.diff(np.r_[new, len(at)])
    first = start[new]
    return row[new], first, windows, grams[at[new]].view(np.int64), roll.spans(first, first + windows - 1 + length).view(np.int64)


def _parts(column: pa.Array, length: int):
    """(data, offsets, first row, position of the first byte in its text) of a column, in parts of bounded size."""
    data, offsets = C.bytes_of(column)
    for i, j in C.row_blocks(offsets):
        a, b = offsets[i], offsets[j]
        if j - i == 1 and b - a > PIECE:
            for s in range(0, int(b - a), PIECE):
                part = data[a + s:min(b, a + s + PIECE + length - 1)]
                yield part, np.array([0, len(part)]), i, s
        else:
            yield data[a:b], offsets[i:j + 1] - a, i, 0


def _counted(length: int, k: int):
    """(anchor, seg, c): segments with their number of occurrences within the batch."""
    def run(batches):
        schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("c", pa.int64())])
        for batch in batches:
            with np.errstate(over="ignore"):
                found = [s for data, offs, _, _ in _parts(batch.column(0), length) if (s := segments(data, offs, length, k)) is not None]
            if found:
                seg = np.concatenate([s[4] for s in found])
                one, at, n = np.unique(seg, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[3] for s in found])[at]), pa.array(one), pa.array(n)], schema=schema)
    return run


def _text_key(data: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(data.tobytes()) - (1 << 63)


def _places(length: int, k: int, repeated, compared):
    """(key, start, windows, anchor, seg, text): where segments that may repeat stand in each distinct text of a batch, once with their text if they are to be compared."""
    def run(batches):
        bits, bits2 = np.frombuffer(repeated.value, np.int64), np.frombuffer(compared.value, np.int64)
        schema = pa.schema([*[(c, pa.int64()) for c in ("key", "start", "windows", "anchor", "seg")], ("text", pa.binary())])
        for batch in batches:
            whole, ends = C.bytes_of(batch.column(0))
            seen, texts = {}, set()
            for data, offs, base, shift in _parts(batch.column(0), length):
                with np.errstate(over="ignore"):
                    s = segments(data, offs, length, k)
                if s is None:
                    continue
                row, first, windows, anchor, seg = s
                keep = C.in_bits(seg, bits)
                fresh = np.zeros(len(offs) - 1, bool)
                keys = np.zeros(len(offs) - 1, np.int64)
                for r in np.unique(row[keep]):
                    d = whole[ends[base + r]:ends[base + r + 1]]
                    keys[r] = _text_key(d)
                    fresh[r] = seen.setdefault((int(keys[r]), len(d)), base + r) == base + r
                keep &= fresh[row]
                row, first, windows, anchor, seg = (x[keep] for x in s)
                show = C.in_bits(seg, bits2)
                text = [None] * len(seg)
                for i in np.flatnonzero(show):
                    if seg[i] not in texts:
                        texts.add(seg[i])
                        text[i] = data[first[i]:first[i] + windows[i] - 1 + length].tobytes()
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in (keys[row], first - offs[row] + shift, windows, anchor, seg)], pa.array(text, pa.binary())], schema=schema)
    return run


# ---- the index of a shard ----

def suffix_array(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of symbols 0..255 by prefix doubling, and the words of 8 symbols from each position on. Only unsettled suffixes are sorted again."""
    n = len(sym)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = sym
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j:n + j]
    sa = np.argsort(words, kind="stable")
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    where, keys, h = np.arange(n), words[sa], 8
    while len(where):
        new = np.r_[True, keys[1:] != keys[:-1]]
        rank[sa[where]] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))]
        where = where[~(new & np.r_[new[1:], True])]
        u = sa[where]
        keys = (rank[u].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(u + h, n)] + 1).astype(np.uint64)
        o = np.argsort(keys, kind="stable")
        sa[where], keys, h = u[o], keys[o], h * 2
    return sa, words


def extend(a: np.ndarray, b: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, pair by pair."""
    n, out = len(words), np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = a[open_] + out[open_], b[open_] + out[open_]
        ok = (x < n) & (y < n)
        open_, x, y = open_[ok], x[ok], y[ok]
        diff = words[x] ^ words[y]
        same = diff == 0
        part = diff[~same]
        zero = np.zeros(len(part), np.int64)
        for s in range(8, 64, 8):
            zero += (part >> np.uint64(64 - s)) == 0
        out[open_[~same]] += zero
        out[open_[same]] += 8
        open_ = open_[same]
    return out


def matching_statistics(sym: np.ndarray) -> np.ndarray:
    """For each position the longest match that starts at any other position, from the samples at the run ends of the transform."""
    n = len(sym)
    sa, words = suffix_array(sym)
    before = np.where(sa > 0, sym[sa - 1].astype(np.int64), 256)
    heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])  # runs begin here; the sample before ends the last run
    value = np.zeros(n, np.int64)
    value[sa[heads[1:]]] = extend(sa[heads[1:]], sa[heads[1:] - 1], words)
    source = np.zeros(n, np.int64)
    source[sa[heads]] = sa[heads]
    source = np.maximum.accumulate(source)
    ahead = np.maximum(value[source] - (np.arange(n) - source), 0)[sa]  # with the suffix before it in the order
    best = np.maximum(ahead, np.r_[ahead[1:], 0])
    out = np.empty(n, np.int64)
    out[sa] = best
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Runs (text, first window, last window) of the windows that start elsewhere too."""
    sizes = np.array([len(t) for t in texts])
    sym = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)  # no byte of UTF-8 is 255: it ends a text, as symbol 0
    stat = matching_statistics(sym)
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.arange(len(sym)) - begin[of]
    hit = (stat >= length) & (inside + length <= sizes[of])
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [(int(of[a]), int(inside[a]), int(inside[b - 1])) for a, b in zip(edge[::2], edge[1::2])]


def _indexed(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("seg")
        found = repeated_windows(list(frame["text"]), length)
        seg = frame["seg"].to_numpy()
        return pd.DataFrame({"seg": [seg[t] for t, _, _ in found], "lo": [lo for _, lo, _ in found], "hi": [hi for _, _, hi in found]}).astype("int64")
    return run


def _window_rows(length: int):
    """(window hash, seg, position) of each window: for anchors with more segments than one task should hold."""
    def run(batches):
        schema = pa.schema([("w", pa.int64()), ("seg", pa.int64()), ("at", pa.int64())])
        for batch in batches:
            data, offs = C.bytes_of(batch.column(1))
            with np.errstate(over="ignore"):
                for i, j in C.row_blocks(offs):
                    part, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                    h = C.Rolling(part, C.byte_values(False)).windows(length)
                    for r in range(j - i):
                        w = h[o[r]:o[r + 1] - length + 1].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.full(len(w), batch.column(0)[i + r].as_py(), np.int64)), pa.array(np.arange(len(w)))], schema=schema)
    return run


def repeated_segments(texts: DataFrame, length: int = LENGTH, k: int = K) -> tuple[DataFrame, DataFrame]:
    """`texts(text string)` to `places(key, start, windows, seg)` of each distinct text and `marks(seg, lo, hi)`, the windows of a segment that repeat."""
    spark = texts.sparkSession
    segs = texts.mapInArrow(_counted(length, k), "anchor bigint, seg bigint, c bigint")
    by = Window.partitionBy("anchor")
    shared = segs.repartition("anchor").groupBy("anchor", "seg").agg(F.sum("c").alias("c")).select(
        "anchor", "seg", "c", F.count(F.lit(1)).over(by).alias("kinds"), F.sum("c").over(by).alias("total")).where("total > 1").drop("total")
    shared = C.stored(shared, "shared")
    repeated = C.shared_array(spark, C.bit_set(shared.select("seg")))
    compared = C.shared_array(spark, C.bit_set(shared.where("kinds > 1").select("seg")))
    places = C.stored(texts.mapInArrow(_places(length, k, repeated, compared), "key bigint, start bigint, windows bigint, anchor bigint, seg bigint, text binary"), "places")

    shown = places.where("text IS NOT NULL").select("anchor", "seg", "text")
    crowded = shared.where(F.col("kinds") > MANY).select("anchor").distinct()
    crowded = C.stored(crowded, "crowded")
    size = shown.agg(F.sum(F.length("text")).alias("b")).first()["b"] or 0
    shards = max(spark.sparkContext.defaultParallelism, int(size // SHARD_BYTES) + 1)
    marks = shown.join(crowded, "anchor", "left_anti").groupBy(F.pmod("anchor", F.lit(shards)).alias("shard")).applyInPandas(_indexed(length), "seg bigint, lo bigint, hi bigint")
    if not crowded.isEmpty():
        rows = shown.join(crowded, "anchor").dropDuplicates(["seg"]).select("seg", "text").mapInArrow(_window_rows(length), "w bigint, seg bigint, at bigint")
        rows = C.stored(rows, "windows")
        twice = rows.groupBy("w").count().where("count > 1").select("w")
        marks = marks.union(rows.join(twice, "w").select("seg", F.col("at").alias("lo"), F.col("at").alias("hi")))
    whole = shared.where("c > 1").select("seg", F.lit(0).cast("long").alias("lo"), F.lit(1 << 60).alias("hi"))
    return places.drop("text", "anchor"), whole.union(marks)


def _cut(unmarked, length: int):
    """Rows that no mark can touch, whole."""
    def run(batches):
        bits = np.frombuffer(unmarked.value, np.int64)
        for batch in batches:
            data, offs = C.bytes_of(batch.column(1))
            rows = [(doc, offs[r + 1] - offs[r], [], d.tobytes()) for r, doc in enumerate(batch.column(0).to_pylist()) if not _marked(d := data[offs[r]:offs[r + 1]], bits, length)]
            yield _passage_rows(rows)
    return run


_PASSAGES = "doc_id bigint, n_bytes bigint, spans array<struct<a:bigint,b:bigint>>, kept binary"


def _passage_rows(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


def _marked(d: np.ndarray, bits: np.ndarray, length: int) -> bool:
    return len(d) >= length and bool(C.in_bits(np.array([_text_key(d)]), bits)[0])


def _to_join(unmarked, length: int):
    def run(batches):
        bits = np.frombuffer(unmarked.value, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("text", pa.binary())])
        for batch in batches:
            data, offs = C.bytes_of(batch.column(1))
            rows = [(doc, _text_key(d), d.tobytes()) for r, doc in enumerate(batch.column(0).to_pylist()) if _marked(d := data[offs[r]:offs[r + 1]], bits, length)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], schema=schema)
    return run


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(batches):
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = text or b""
            runs = merged([(x["a"], x["b"]) for x in spans or ()])
            ends = [0, *[b for _, b in runs]]
            kept = b"".join(text[at:a] for at, a in zip(ends, [*[a for a, _ in runs], len(text)]))
            rows.append((doc, len(text), [{"a": a, "b": b} for a, b in runs], kept))
        yield _passage_rows(rows)


def passages(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """`docs(doc_id bigint, text string, ...)` to `(doc_id, n_bytes, spans, kept)`, one row per input row.

    All bytes covered by a `length`-byte string that also starts anywhere else in the input, the same text included, are removed; matches
    never cross texts. `spans` are the removed bytes as (a, b), from a up to but without b, in order and apart; `kept` is the UTF-8 text without
    them, as bytes, since a span may begin or end within a character. A null or short text loses nothing (null: 0 bytes). Repeated rows are copies of each other and lose all their
    windows. A null doc_id is carried along. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    places, marks = repeated_segments(rows.select("text"), length, k)
    hits = places.join(marks, "seg").select("key", (F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.least("hi", F.col("windows") - 1) + length).alias("b"))
    spans = C.stored(hits.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    touched = C.shared_array(spark, C.bit_set(spans.select("key")))
    clean = rows.mapInArrow(_cut(touched, length), _PASSAGES)
    joined = rows.mapInArrow(_to_join(touched, length), "doc_id bigint, key bigint, text binary").join(spans, "key", "left")
    return clean.union(joined.select("doc_id", "text", "spans").mapInArrow(_without, _PASSAGES))


def repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Digests of `passages`: `(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`, one row per input row."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return passages(docs, length, k).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeats(C.table(spark, sf_dir, "documents"))
