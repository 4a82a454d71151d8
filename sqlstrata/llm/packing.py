"""Harmonic packing of tokenized documents into sequences (operator 1).

A piece of n tokens belongs to class j = capacity // n, the bins of class j hold exactly j pieces, and every task fills its own bins while its
documents stream by: a full bin is a sequence at once and no task waits for another. Documents are cut so that pieces fit their class with next
to nothing over: whole sequences first, then one piece of exactly capacity // j tokens and one short rest. What is left in a task's last bins,
some hundred pieces whatever the input, is packed again over groups of tasks: by class, and the last few by first fit.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlstrata.llm import common as C

C.by_value(__name__)

CAPACITY = 2048
END = 1  # id after each document
SHORT = 128  # a rest of at most so many tokens is not cut again
LEAST = 32  # shortest piece that a cut leaves, so that classes stay few
CACHED = 600_000  # words whose ids a Python worker remembers, and those of one batch
TASKS = 512  # tasks whose leftovers are packed together
_MARKS = ".,;:!?#$%&*|"
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_BLANK = b"\t\n\x0b\x0c\r "
_KIND = bytes(0 if c in _BLANK else 1 if chr(c).isalnum() and c < 128 else 2 if c in _MARKS.encode() and c != ord("|") else 3 for c in range(256))  # of a byte: white space, a letter or digit, a mark that no special token holds, anything else
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_WITH_IDS = _PIECE + ", ids array<int>"
ROOM = 1 << 20  # ids in one batch of pieces, and characters that are cut to words at once


class WordTokenizer:
    """Ids of whole texts by a tokenizer that works word by word: each word between white space is encoded once and remembered while it is in use."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        # A word of such letters is one piece for the model, which sees its bytes as characters: no step before the model is needed.
        letters = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of, self.plain = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}, re.compile(f"[{letters}]+").fullmatch
        self.model = Tokenizer(self.tokenizer.model)
        sample = [*letters, letters, "the" + letters[::-1]]
        if [e.ids for e in self._model_only(sample)] != [e.ids for e in self.tokenizer.encode_batch_fast(sample, add_special_tokens=False)]:
            self.plain = lambda word: None  # a tokenizer of another kind

    def _model_only(self, words: list[str]) -> list:
        return self.model.encode_batch_fast([w if w.isascii() else w.translate(self.bytes_of) for w in words], add_special_tokens=False)

    def plain_text(self, text: str) -> str:
        """A text in the tokenizer's letters, with white space of ASCII only."""
        # The tokenizer lower-cases character by character: so does lower() but for these two letters. Special tokens are matched as written.
        if "<|" not in text and "\u0130" not in text and "\u03a3" not in text:
            text = text.lower()
        return _SPACE.sub(" ", text) if not text.isascii() and _WIDE.search(text) else text

    @staticmethod
    def words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The texts' different words, the number of each word of theirs, and how many words each text has. Marks behind ASCII letters and digits are a word of their own."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends, chars = np.cumsum([len(r) + 1 for r in raw]), b" ".join([*raw, b""])
        kind = np.frombuffer(chars.translate(_KIND), np.uint8)
        inside = kind != 0
        first = inside.copy()  # where a word begins
        first[1:] &= ~inside[:-1] | (kind[1:] == 2) & (kind[:-1] == 1)
        at = np.flatnonzero(first)
        held = chars.translate(None, _BLANK)
        start = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, len(held)).astype(np.int32)
        column = pa.StringArray.from_buffers(len(at), pa.py_buffer(start), pa.py_buffer(held)).dictionary_encode()
        counts = np.diff(np.searchsorted(at, ends), prepend=0)
        return column.dictionary.to_pylist(), column.indices.to_numpy(), counts

    def _learn(self, new: list[str]) -> None:
        """Ids of new words. Letters with marks behind them are two tokens' worth of text, whose ids follow each other."""
        plain, other = [], []
        for w in new:
            (plain if self.plain(w) else other).append(w)
        self._keep(plain, self._model_only(plain))
        apart = {w: b for w in other if (b := w.rstrip(_MARKS)) and len(b) < len(w) and b.isalpha()}
        if apart:
            parts = {*apart.values(), *(w[len(b):] for w, b in apart.items())} - self.known.keys()
            other = [*parts, *(w for w in other if w not in apart and w not in parts)]
        self._keep(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        for w, b in apart.items():
            self.known[w] = self.known[b] + self.known[w[len(b):]]

    def _keep(self, words: list[str], encoded: list) -> None:
        for w, e in zip(words, encoded):
            self.known[w] = array("I", e.ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Unsigned 32-bit ids of each text, in the byte order of all common machines: little-endian."""
        different, which, counts = self.words([self.plain_text(t) for t in texts])
        if len(self.known) > CACHED // 2:  # words that have not been met since the last time go
            self.known, self.older = {}, self.known
        held = list(map(self.known.get, different))
        missing = [i for i, h in enumerate(held) if h is None]
        if missing:
            new = [different[i] for i in missing]
            before = list(map(self.older.get, new))
            self.known.update((w, h) for w, h in zip(new, before) if h is not None)
            self._learn([w for w, h in zip(new, before) if h is None])
            for i in missing:
                held[i] = self.known[different[i]]
        lengths = np.fromiter(map(len, held), np.int32, len(held)) // 4
        # the ids of a word are where they stand among those of all different words, from its first one on
        shift, of_word = (np.cumsum(lengths, dtype=np.int32) - lengths)[which], lengths[which]
        ends = np.cumsum(of_word, dtype=np.int32)
        ids = np.frombuffer(b"".join(held), "<u4")[np.repeat(shift - ends + of_word, of_word) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, which runs many tasks: what it has learned in one serves the next."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_sqlstrata_words", {})  # this module travels by value: its own globals are new in each task
    key = (path, CACHED, os.path.getmtime(path), os.path.getsize(path))
    if key not in held:
        held.clear()
        held[key] = WordTokenizer(path)
    return held[key]


def cuts(capacity: int = CAPACITY, short: int = SHORT, least: int = LEAST, price: int = 8) -> list[int]:
    """For each rest 0 .. capacity - 1 the tokens of its first piece: all of it, or an exact share of the capacity.

    The choice loses fewest tokens of room in the pieces' classes, where one more cut counts as `price` tokens.
    """
    loss, first = [0] * capacity, list(range(capacity))
    for r in range(1, capacity):
        loss[r] = capacity // (capacity // r) - r
        for share in (capacity // j for j in range(2, capacity // short + 1)) if r > short else ():
            if r - share >= least and loss[r - share] + price < loss[r]:
                loss[r], first[r] = loss[r - share] + price, share
    return first


def _pieces(total: int, first: list[int], capacity: int):
    start = 0
    while total - start >= capacity:
        yield start, capacity
        start += capacity
    while start < total:
        n = first[total - start]
        yield start, n
        start += n


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of pieces; last come the bytes of their ids, which go into one array without a copy per id."""
    ends = np.cumsum([0] + [len(r[-1]) // 4 for r in rows]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(r[-1] for r in rows), "<i4")))
    return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(schema) - 1)], ids], schema=schema)


def _fill(path: str, capacity: int):
    def run(batches):
        schema = pa.schema([(c.split()[0], pa.int64()) for c in _PIECE.split(", ")] + [("task", pa.int64()), ("ids", pa.list_(pa.int32()))])
        words, first, task = worker_tokenizer(path), cuts(capacity), TaskContext.get().partitionId()
        bins: dict[int, list] = {}
        closed, end = 0, np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, texts, size, rows, room = batch.column(0).to_pylist(), batch.column(1), 0, [], 0
            at = 0
            while at < len(ids):
                to, size = at, 0
                part = []
                while to < len(ids) and (not part or size < ROOM):
                    t = texts[to].as_py() or ""
                    part.append(t)
                    size += len(t)
                    to += 1
                for doc, raw in zip(ids[at:to], words.ids(part)):
                    raw += end
                    total = len(raw) // 4
                    for start, n in _pieces(total, first, capacity):
                        kind = capacity // n
                        open_ = bins.setdefault(kind, [])
                        piece = raw[4 * start:4 * (start + n)]
                        open_.append((doc, start, n, zlib.crc32(piece), total, piece))
                        if len(open_) == kind:
                            offset, sequence = 0, (task << 32) + closed
                            for p in open_:
                                rows.append((*p[:5], sequence, offset, task, p[5]))
                                offset += p[2]
                            room += offset
                            closed += 1
                            bins[kind] = []
                            if room >= ROOM:
                                yield _rows(rows, schema)
                                rows, room = [], 0
                at = to
            yield _rows(rows, schema)
        yield _rows([(*p[:5], None, None, task, p[5]) for open_ in bins.values() for p in open_], schema)
    return run


def fill_leftovers(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each piece: classes by count, and what remains of them by first fit from the longest on."""
    where: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    kinds: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        kinds.setdefault(capacity // n, []).append(i)
    bins, rest = 0, []
    for kind, members in kinds.items():
        full = len(members) // kind * kind
        for a in range(0, full, kind):
            offset = 0
            for i in members[a:a + kind]:
                where[i] = (bins, offset)
                offset += lengths[i]
            bins += 1
        rest += members[full:]
    used: list[int] = []
    for i in sorted(rest, key=lambda i: -lengths[i]):
        b = next((b for b, u in enumerate(used) if u + lengths[i] <= capacity), len(used))
        if b == len(used):
            used.append(0)
        where[i] = (bins + b, used[b])
        used[b] += lengths[i]
    return where


def _again(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        where = fill_leftovers(frame["length"].tolist(), capacity)
        base = (1 << 62) + (int(frame["task"].iloc[0]) // TASKS << 32)
        frame["sequence_id"] = [base + b for b, _ in where]
        frame["offset"] = [o for _, o in where]
        return frame[[c.split()[0] for c in _WITH_IDS.split(", ")]]
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """`docs(doc_id bigint, text string, ...)` to one row per piece: `(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)`.

    `ids` are the piece's token ids: those of a sequence, by `offset`, are what a model trains on. `ids_crc32` is their digest.

    A document is its ids and then END; `start` counts its ids before the piece, `offset` the ids of the sequence before it. A null or empty
    text is the one id END. Each row is a document of its own, also where ids repeat or are null. Any text length is cut to pieces of at most
    `capacity`. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    filled = C.stored(rows.mapInArrow(_fill(tokenizer_path, capacity), _PIECE + ", task bigint, ids array<int>"), "packed")
    left = filled.where("sequence_id IS NULL").groupBy(F.floor(F.col("task") / TASKS).alias("group")).applyInPandas(_again(capacity), _WITH_IDS)
    return filled.where("sequence_id IS NOT NULL").drop("task").union(left)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed; of the ids only the digest."""
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
