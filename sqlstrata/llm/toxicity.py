"""Toxicity by a weighted lexicon (operator 12).

Texts are folded: compatibility forms and case, letters that look alike to one letter, digits and marks inside words to the letters they stand for. The
lexicon's patterns are folded alike, so a pattern meets every disguise of itself; letters with accents are letters of their own. One Aho-Corasick automaton holds stems (any ending), whole words
and exception phrases; it reads a folded text once, the longest pattern that starts at a word counts, and words within an exception phrase do not.
The weights of a text's matches, over its length, give its score.

The lexicon is a short fixed list plus what labelled documents teach: a stem or word's weight is the lower bound of its log odds of
documents marked toxic, counted over the labelled documents outside the held-out third. A word that clean documents use has an entry of its own
with its own, small weight, and overrides the stem it begins with. One labelled document in `CALIBRATES` is left out of these counts, and the
score's logistic curve is fitted on them. Language, source and id are no inputs.

Bound, a parameter: about `max_labelled` labelled documents of different texts are learned from, drawn by a hash of their ids, so that their ids can be
broadcast and no text is moved. Fewer than that are all taken. Scoring covers all documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlstrata.llm import common as C
from sqlstrata.llm.quality import calibrate

C.by_value(__name__)

# Stems of abuse in English with the weight each has until labels tell another
STEMS = {
    "idiot": 4, "moron": 4, "stupid": 3, "imbecile": 4, "loser": 3, "pathetic": 3, "disgusting": 3, "worthless": 3, "scum": 4, "trash": 2, "clown": 2, "dumb": 2, "retard": 4,
    "bastard": 4, "asshole": 5, "bitch": 5, "fuck": 5, "shit": 4, "cunt": 5, "whore": 5, "slut": 5, "vermin": 3, "subhuman": 4, "kill yourself": 6, "hate you": 3, "shut up": 2,
}
# Phrases in which a stem abuses nobody
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "trash talk", "clown fish", "clownfish", "class clown", "idiot proof", "idiot light", "sore loser", "dumbbell", "dumbwaiter", "dumbfound",
              "dumb waiter", "dumb luck", "fire retardant", "flame retardant", "retardant", "retardation", "pathetic fallacy", "shitake", "scumble", "slutsky", "stupid simple"]
# Letters of other scripts that look like a Latin one, and what stands for letters inside words
ALIKE = {
    "a": "аαɑạ", "b": "вЬьƅ", "c": "сϲⅽ", "d": "ԁɗ", "e": "еєҽε", "f": "ƒ", "g": "ɡց", "h": "һհн", "i": "іıιɩ!|1ӏ", "j": "јϳ", "k": "кκ", "l": "ⅼ", "m": "мⅿ", "n": "ոռ", "o": "оοօσ0",
    "p": "рρ", "q": "ԛ", "r": "гꭇ", "s": "ѕꜱ$5", "t": "тτ7+", "u": "υսʋ", "v": "ѵν", "w": "ԝѡω", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
SKELETON = ("l", "i")  # written alike (l, I, 1, |): read as one letter

_GLYPHS = str.maketrans({g: to for to, of in ALIKE.items() for g in of if g not in STANDS_FOR} | {c: None for c in map(chr, [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])})
_STANDS_FOR = str.maketrans(STANDS_FOR)
_DISGUISED = re.compile(r"[^\W_]*[0-9@$!|+][^\W_0-9@$!|+]*(?:[0-9@$!|+]+[^\W_]+)*[0-9@$]*")
_MARKS = re.compile(r"[0-9@$!|+]")
_GAPS = re.compile(r"[\W\d_]+")
SHORTEST, LONGEST = 3, 8  # characters of a stem
LONGEST_WORD = 64  # a longer run of letters teaches its stems only

HELD_OUT, HELD_OUT_AT = 3, 1  # crc32 of the id as text: this remainder is never learned from
CALIBRATES = 5
MAX_LABELLED = 200_000  # ids of 3 MB
LEAST_SHARE = 0.002  # of the toxic documents learned from; bounds the lexicon by the words of 500 documents
LEAST = 3
BOUND = 1.5  # standard errors below the log odds
LEAST_WEIGHT = 1.0
MAX_ENTRIES = 50_000
TOXIC = 0.7
SMOOTH = 10  # words added to a text's length
SPILL = 300_000


def _letters(match: re.Match) -> str:
    word = match.group()
    return word.translate(_STANDS_FOR) if any(c.isalpha() for c in word) else word


def fold(text: str) -> str:
    """A text as its folded words, each with a space in front, and one space at the end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_GLYPHS)
    else:
        text = text.lower()
    if _MARKS.search(text):
        text = _DISGUISED.sub(_letters, text)
    return f" {_GAPS.sub(' ', text).strip()} ".replace(*SKELETON).replace("  ", " ")


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT == HELD_OUT_AT


def _is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == HELD_OUT_AT, F.lit(False))


class Lexicon:
    """Folded patterns to weights, exception phrases, and the curve from weighted density to score. A pattern that ends in a space is a whole word."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float] = (2.0, -4.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """(place, pattern) of the longest pattern at each word, without words inside an exception phrase."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for pattern in self.weights:
                self._automaton.add_word(pattern, (len(pattern), pattern))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None))
            self._automaton.make_automaton()
        best: dict[int, tuple[int, str]] = {}
        spared: list[tuple[int, int]] = []
        if len(self._automaton):
            for end, (length, pattern) in self._automaton.iter(folded):
                start = end - length + 1
                if pattern is None:
                    spared.append((start, end))
                elif length > best.get(start, (0, ""))[0]:
                    best[start] = (length, pattern)
        for start, end in spared:
            at = start
            while 0 <= at < end:  # word by word
                best.pop(at, None)
                at = folded.find(" ", at + 1)
        return [(at, pattern) for at, (_, pattern) in sorted(best.items())]

    def density(self, text: str | None) -> float:
        """Sum of the weights of a text's matches over its words (and some more), on a log scale."""
        folded = fold(text or "")
        weight = sum(self.weights[p] for _, p in self.matches(folded))
        return float(np.log1p(100 * weight / (folded.count(" ") - 1 + SMOOTH)))

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.density(text) + b, -30, 30))))


def fixed_patterns() -> tuple[dict[str, float], list[str]]:
    """The fixed stems and exceptions, folded. A stem matches any ending; so does an exception's last word."""
    return {fold(s).rstrip(): float(w) for s, w in STEMS.items()}, [fold(e).rstrip() for e in EXCEPTIONS]


def patterns_of(folded: str) -> set[str]:
    """The stems and whole words of a folded text, as patterns."""
    found = set()
    for w in set(folded.split()):
        if len(w) <= LONGEST_WORD:
            found.add(f" {w} ")
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            found.add(f" {w[:k]}")
    return found


def _counted(batches):
    schema = pa.schema([("pattern", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    counts: dict[str, list[int]] = {}

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array([v[i] for v in counts.values()], pa.int64()) for i in (1, 0)]], schema=schema)
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for p in patterns_of(fold(text)):
                counts.setdefault(p, [0, 0])[toxic] += 1
            if len(counts) > SPILL:
                yield batch_of()
                counts.clear()
    if counts:
        yield batch_of()


def pruned(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Patterns to weights without those that say nothing new: a stem that nearly always goes on the same way, and a pattern weighted like the longest kept one it begins with.

    `found` has each pattern's weight and number of toxic documents."""
    longer: dict[str, int] = {}
    for p, (_, toxic) in found.items():
        stem = p[:-1]
        if p.endswith(" ") and len(stem) - 1 > LONGEST:
            stem = stem[:LONGEST + 1]
        longer[stem] = max(longer.get(stem, 0), toxic)
    kept: dict[str, float] = {}
    for p in sorted(found, key=lambda p: (len(p.rstrip()), p)):
        weight, toxic = found[p]
        if not p.endswith(" ") and longer.get(p, 0) >= 0.98 * toxic:
            continue
        before = next((kept[p[:k]] for k in range(min(len(p.rstrip()), LONGEST + 1), SHORTEST, -1) if p[:k] in kept), None)
        if before is None or abs(before - weight) > 0.5:
            kept[p] = weight
    return kept


def _densities(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.density(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["density", "toxic"])
    return run


def learned(docs: DataFrame, labels: DataFrame, exceptions: list[str] | None = None, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """The lexicon that about `max_labelled` labelled documents outside the held-out third teach. Without labels of both kinds it is the fixed one.

    Several labels of a document count as toxic if one does, a null flag is no label. Of equal texts with equal labels one document counts, so groups of copies teach no more than one."""
    fixed, spared = fixed_patterns()
    spared = spared + [fold(e).rstrip() for e in exceptions or []]
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~_is_held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    hashes = texts.select("doc_id", F.xxhash64("text").alias("a"), F.crc32(F.col("text").cast("binary")).alias("b"))
    ones = C.stored(hashes.join(marked, "doc_id").groupBy("a", "b", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"), "learned-from")
    drawn = min(1.0, max_labelled / max(1, ones.count()))
    ones = ones.where(F.pmod(F.xxhash64("doc_id", F.lit("drawn")), F.lit(1 << 30)) < int(drawn * (1 << 30)))
    rows = texts.join(F.broadcast(ones), "doc_id").select("text", "toxic", "doc_id")  # about max_labelled pairs
    calibrating = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATES)) == 0
    n = {(r["toxic"], r["calibrates"]): r["count"] for r in ones.groupBy("toxic", calibrating.alias("calibrates")).count().collect()}
    apart = all(n.get((t, c)) for t in (0, 1) for c in (True, False))  # else all rows do both
    total = [n.get((t, False), 0) + (0 if apart else n.get((t, True), 0)) for t in (0, 1)]
    if not all(total):
        return Lexicon(fixed, spared)
    teaching = rows.where(~calibrating) if apart else rows
    counts = teaching.select("text", "toxic").mapInArrow(_counted, "pattern string, toxic bigint, clean bigint").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic, clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(toxic / (total[1] + 1)) - F.log(clean / (total[0] + 1))
    counts = counts.withColumn("weight", odds - BOUND * F.sqrt(1 / toxic + 1 / clean))
    # what few documents hold is never looked at again
    counts = C.stored(counts.where((F.col("toxic") >= LEAST) | (F.col("clean") >= LEAST)), "patterns")
    least = max(LEAST, LEAST_SHARE * total[1])
    strong = counts.where((F.col("toxic") >= least) & (F.col("weight") >= LEAST_WEIGHT)).orderBy(F.desc("weight"), "pattern").limit(MAX_ENTRIES).collect()
    weights = pruned({r["pattern"]: (r["weight"], r["toxic"]) for r in strong})
    for p, w in fixed.items():
        weights.setdefault(p, w)
    # whole words that clean documents hold, under a stem of the lexicon: their own weight, however small
    stems = docs.sparkSession.createDataFrame([(p, len(p)) for p in weights if not p.endswith(" ")], "stem string, length int")
    lengths = sorted({len(p) for p in weights if not p.endswith(" ")})
    words = counts.where(F.col("pattern").endswith(" ") & (F.col("clean") >= LEAST)).withColumn("stem", F.explode(F.array(*[F.substring("pattern", 1, k) for k in lengths])))
    clean_words = words.join(F.broadcast(stems), "stem").groupBy("pattern").agg(F.max("weight").alias("weight"), F.max("clean").alias("clean")).where(F.col("weight") < LEAST_WEIGHT)  # at most MAX_ENTRIES stems
    for r in clean_words.orderBy(F.desc("clean"), "pattern").limit(MAX_ENTRIES).collect():
        weights[r["pattern"]] = max(0.0, r["weight"])
    lexicon = Lexicon(weights, spared)
    got = (rows.where(calibrating) if apart else rows).select("text", "toxic").mapInArrow(_densities(lexicon), "density double, toxic int").toArrow()
    curve = calibrate(got.column("density").to_numpy()[:, None], got.column("toxic").to_numpy().astype(float))
    if curve[0] > 0:
        lexicon.curve = (float(curve[0]), float(curve[1]))
    return lexicon


def _scored(lexicon: Lexicon, threshold: float):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("matches", pa.list_(pa.string()))])
        for batch in batches:
            score, found = [], []
            for text in _texts(batch.column(1)):
                folded = fold(text)
                at = lexicon.matches(folded)
                weight = sum(lexicon.weights[p] for _, p in at)
                density = np.log1p(100 * weight / (folded.count(" ") - 1 + SMOOTH))
                score.append(float(1 / (1 + np.exp(-np.clip(lexicon.curve[0] * density + lexicon.curve[1], -30, 30)))))
                found.append(sorted({p.strip() for _, p in at}))
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(d) for d in ids.to_pylist()], pa.bool_()), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()),
                                              pa.array(found, pa.list_(pa.string()))], schema=schema)
    return run


def _texts(column: pa.Array) -> Iterator[str]:
    """One text at a time, so that a batch of long ones is not held twice."""
    for text in column:
        yield text.as_py() or ""


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC, exceptions: list[str] | None = None) -> DataFrame:
    """`docs(doc_id, text, ...)` and `labels(doc_id, toxic, ...)` to `(doc_id, held_out, score, predicted, matches)`, one row per input row.

    `matches` lists the folded patterns that count. A null text is scored as an empty one, which has the score of a text without a match; a
    null id is not held out and teaches nothing. Repeated rows give repeated results, other columns (of either table) are ignored, an empty
    table gives no rows.
    """
    lexicon = learned(docs, labels, exceptions)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(lexicon, threshold), "doc_id bigint, held_out boolean, score double, predicted int, matches array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored."""
    return toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
