"""Benchmark decontamination by pigeonhole edit matching (operator 3).

With a budget of k edits, an item cut into k + 1 pieces has one piece that any occurrence within the budget holds unchanged. All pieces of a
block of items are looked up at once in each text; a hit says where the item would lie, and Myers' bit-parallel distance decides there.
Every place of an item is reported. Short items have no budget and are found as whole words.
Items come in blocks of bounded size, each block one pass over the documents, written before the next block is read: the driver and the tasks
hold one block at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlstrata.llm import common as C

C.by_value(__name__)

CHARS_PER_EDIT = 16  # one edit for so many characters of an item
SHORT_CHARS = 20  # shorter items are found as whole words, without an edit
TELLING_CHARS = 20  # shorter items do not make a document go
BLOCK_CHARS = 4 << 20
_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    """Lower-case words, one space between them. Words are cut before they are lowered, which may change their length."""
    return " ".join(_WORD.findall(text)).lower()


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """`edits` + 1 pieces of nearly equal length, with their place."""
    n, k = len(item), edits + 1
    return [(n * i // k, item[n * i // k:n * (i + 1) // k]) for i in range(k)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def ends(peq: dict[str, int], m: int, text: str, most: int, anchored: bool = False) -> list[tuple[int, int]]:
    """(distance, end) of every place of a text where an item's occurrence within `most` edits ends; the item's bits are in `peq`.

    With `anchored`, occurrences begin where the text begins.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, found = full, 0, m, []
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= most:
            found.append((score, j + 1))
        ph, mh = (ph << 1) & full | anchored, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return found


def places(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """One (distance, end) for each run of neighbouring ends: the nearest, the first of equal ones."""
    out, before = [], None
    for distance, end in found:
        if before != end - 1:
            out.append((distance, end))
        elif distance < out[-1][0]:
            out[-1] = (distance, end)
        before = end
    return out


class Items:
    """A block of items with all their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items, of = [], {}
        for item_id, text in items:
            edits = len(text) // chars_per_edit if len(text) >= SHORT_CHARS else 0
            n = len(self.items)
            self.items.append((item_id, text, edits, masks(text), masks(text[::-1])))
            for at, piece in pieces(text, edits):
                of.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in of.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, begin, end) in the normal text: all places of each item."""
        begin: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for item, at in where:
                begin.setdefault(item, set()).add(end + 1 - n - at)
        out = []
        for item, starts in begin.items():
            item_id, want, edits, peq, back = self.items[item]
            m = len(want)
            if m < SHORT_CHARS:
                for a in sorted(starts):
                    if (a == 0 or text[a - 1] == " ") and text[a + m:a + m + 1] in ("", " "):
                        out.append((item_id, 0, a, a + m))
                continue
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - edits), s + m + edits
                if spans and a <= spans[-1][1] + 1:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            for a, b in spans:
                for distance, end in places(ends(peq, m, text[a:b], edits)):
                    end += a
                    length = next(n for d, n in ends(back, m, text[max(a, end - m - edits):end][::-1], distance, True) if d == distance)
                    out.append((item_id, distance, end - length, end))
        return out


def _search(items: list[tuple[int, str]], chars_per_edit: int):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
        block = Items(items, chars_per_edit)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                norm = normal(text)
                found = block.find(norm)
                if found:
                    words = list(_WORD.finditer(text))
                    starts = [0, *(m.end() for m in re.finditer(" ", norm))]  # of the words, in the normal text
                    for item, distance, a, b in found:
                        i, j = bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1)) - 1
                        i = min(i + (norm[a] == " "), j)
                        rows.append((doc, item, distance, words[i].start(), words[j].end()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], schema=schema)
    return run


def _blocks(items: DataFrame, least: int, most: int):
    """Items in blocks of at most `most` characters; one block at a time is in the driver."""
    block, size = [], 0
    for row in items.toLocalIterator():
        text = normal(row["text"])
        if not text or len(text) < least:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, least_chars: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs(doc_id, text)` and `benchmark(item_id, text)` to `(doc_id, item_id, distance, begin, end)`, all places of each item in each document.

    Texts are compared as lower-case words, one space apart, with one edit allowed for each `chars_per_edit` characters of the item, and none
    for items under SHORT_CHARS, which stand as whole words. Of places that end at neighbouring characters the nearest one counts; begin and
    end are characters of the document, at words. Null and empty texts match nothing; items that are null, without words or shorter than
    `least_chars` take no part. Repeated documents or items give repeated rows. A null id is carried along. Other columns are ignored;
    empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, distance bigint, begin bigint, end bigint"
    out = part = None
    for block in _blocks(items, least_chars, block_chars):
        if part is not None:
            part = C.stored(part, "leaks")
            out = part if out is None else out.union(part)
        part = rows.mapInArrow(_search(block, chars_per_edit), schema)
    if part is None:
        return spark.createDataFrame([], schema)
    return part if out is None else out.union(part)


def clean(docs: DataFrame, benchmark: DataFrame, least_chars: int = TELLING_CHARS) -> DataFrame:
    """The documents without those that hold an item of `least_chars` or more. Shorter ones may be common words and say nothing. Rows without a doc_id stay."""
    dirty = C.stored(contaminated(docs, benchmark, least_chars=least_chars).select("doc_id").where("doc_id IS NOT NULL").distinct(), "dirty").withColumnRenamed("doc_id", "_dirty")
    return docs.join(dirty, docs["doc_id"] == dirty["_dirty"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in all documents."""
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
