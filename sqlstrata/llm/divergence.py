"""Audit of how far sources of a language differ in their words (operator 13).

Tasks fold whole documents into stripes in memory: for each term of a language its document frequency and its counts by source. A task whose
stripes outgrow SPILL entries emits them and starts anew. Stripes meet by (language, term) in one shuffle and are added up; terms of at least
`least` documents stay. A merged stripe emits divergences directly: a term's share in a source against the language's, and for pairs of
sources the sums over all terms. Shares are whole numbers of billionths plus one, and all arithmetic is exact.

The sum of a pair (a, b) runs over all kept terms, but most terms lie in few sources. So it is put together from what both lack
(V times one value), from histograms of each source's counts against the other's share of an absent term, and from one correction for each term
that both hold. Only the last walks stripes, and tasks add it up by pair before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sqlstrata.llm import common as C

C.by_value(__name__)

SCALE = 1_000_000_000
LEAST = 3
TOP_TERMS = 200
SPILL = 200_000  # entries of a task's stripes, about 60 MB
PAIRS_AT_ONCE = 1 << 20
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in runs of about CHUNK_BYTES: letters A-Z, lower-cased, and all bytes beyond ASCII."""
    data, at = text.translate(_TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + C.CHUNK_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Stripes:
    """Document frequency by (language, term) and counts by (language, source, term) of the documents folded so far."""

    def __init__(self):
        self.documents: dict[bytes, Counter] = {}
        self.counts: dict[tuple[bytes, bytes], Counter] = {}
        self.entries = 0

    def add(self, lang: bytes, source: bytes, text: bytes):
        counts, seen = self.counts.setdefault((lang, source), Counter()), set()
        before = len(counts)
        for words in words_of(text):
            counts.update(words)
            seen.update(words)
        self.documents.setdefault(lang, Counter()).update(seen)
        self.entries += len(counts) - before

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row per term of a language: its documents and its counts by source."""
        for lang, documents in self.documents.items():
            if not documents:
                continue
            own = [(s, c) for (l, s), c in self.counts.items() if l == lang and c]
            place = {t: i for i, t in enumerate(documents)}
            row = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for _, c in own])
            order = np.argsort(row, kind="stable")
            source = np.repeat(np.arange(len(own)), [len(c) for _, c in own])[order]
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in own])[order]
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(place)))].astype(np.int32)
            sources = _strings([s for s, _ in own]).take(pa.array(source))
            counts = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([sources, pa.array(n)], fields=list(schema.field("counts").type.value_type)))
            docs = pa.array(np.fromiter(documents.values(), np.int64, len(documents)))
            yield pa.RecordBatch.from_arrays([_strings([lang]).take(pa.array(np.zeros(len(place), np.int64))), _strings(list(documents)), docs, counts], schema=schema)


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)


def _folded(batches):
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("counts", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])
    stripes = Stripes()
    for batch in batches:
        for text, lang, source in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in range(3))):
            stripes.add(lang, source, text)
            if stripes.entries > SPILL:
                yield from stripes.batches(schema)
                stripes = Stripes()
    yield from stripes.batches(schema)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def stripes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`docs(text, lang, source, ...)` to `(lang, term, docs, n, counts array<struct<source, n>>)`: the terms in at least `least` documents of their
    language. Null texts, languages and sources are empty strings; a repeated row is one more document."""
    parts = _plain(docs).mapInArrow(_folded, "lang string, term string, docs bigint, counts array<struct<source:string,n:bigint>>")
    # one shuffle by (lang, term); both sums below keep to it. A term's document frequency is the entry without a source.
    entry = F.struct(F.lit(None).cast("string").alias("source"), F.col("docs").alias("n"))
    entries = parts.repartition("lang", "term").select("lang", "term", F.inline(F.concat("counts", F.array(entry))))
    sums = entries.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    of_source = F.when(F.col("source").isNotNull(), F.struct("source", "n"))
    merged = sums.groupBy("lang", "term").agg(F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("docs"), F.sum(F.when(F.col("source").isNotNull(), F.col("n"))).alias("n"),
                                              F.collect_list(of_source).alias("counts"))
    return merged.where(F.col("docs") >= least)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total) by long division in two steps, exact for totals up to 9 * 10**13; 1 if there are no terms."""
    a, d = (count + 1) * 100_000, F.greatest(total, F.lit(1))
    quotient = lambda x, y: F.call_function("div", x, y)
    return F.when(total > 0, 1 + quotient(a, d) * 10_000 + quotient((a % d) * 10_000, d)).otherwise(F.lit(1).cast("long"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    a, d = (count + 1) * 100_000, np.maximum(total, 1)
    return 1 + a // d * 10_000 + a % d * 10_000 // d


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrections(totals: dict[str, dict[str, int]]):
    """Stripes to `(lang, source, item, value)`: for pairs that both hold a term, its divergence less what histograms count for it, added up in the task."""
    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        names = {lang: sorted(of) for lang, of in totals.items()}
        number = {lang: {s: i for i, s in enumerate(of)} for lang, of in names.items()}
        size = {lang: np.array([totals[lang][s] for s in of], np.int64) for lang, of in names.items()}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, code: np.ndarray, value: np.ndarray):
            if lang in sums:
                code, value = np.r_[sums[lang][0], code], np.r_[sums[lang][1], value]
            order = np.argsort(code, kind="stable")
            code, value = code[order], value[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            sums[lang] = code[first], np.add.reduceat(value, first)

        def pairs(lang: str, counts: pa.ListArray):
            d = size[lang]
            offsets = np.asarray(counts.offsets, np.int64)
            entries = counts.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets, length = offsets - offsets[0], np.diff(offsets)
            coded = entries.field("source").dictionary_encode()
            local = np.array([number[lang][s] for s in coded.dictionary.to_pylist()], np.int64)
            source = local[coded.indices.to_numpy(zero_copy_only=False)] if len(local) else np.zeros(0, np.int64)
            p, p0 = _share(np.asarray(entries.field("n"), np.int64), d[source]), _share(np.zeros(len(source), np.int64), d[source])
            # of each entry, its partners in the same stripe, a bounded number of pairs at a time
            per = np.repeat(length, length)
            start, reach = np.repeat(offsets[:-1], length), np.r_[0, np.cumsum(per)]
            i = 0
            while i < len(per):
                j = max(i + 1, int(np.searchsorted(reach, reach[i] + PAIRS_AT_ONCE, "right")) - 1)
                a = np.repeat(np.arange(i, j), per[i:j])
                b = np.arange(reach[j] - reach[i]) - np.repeat(reach[i:j] - reach[i], per[i:j]) + np.repeat(start[i:j], per[i:j])
                a, b = a[a != b], b[a != b]
                value = _apart(p[a], p[b]) - _apart(p[a], p0[b]) - _apart(p0[a], p[b]) + _apart(p0[a], p0[b])
                if len(a):
                    add(lang, source[a] * len(d) + source[b], value)
                i = j

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                pairs(lang, batch.column(1).filter(pa.array(of == k)))
        for lang, (code, value) in sums.items():
            n, of = len(names[lang]), pa.array(names[lang], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), of.take(pa.array(code // n)), of.take(pa.array(code % n)), pa.array(value)], schema=schema)
    return run


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP_TERMS) -> DataFrame:
    """`docs(text, lang, source, ...)` to `(lang, source, part, item, value, rank)`.

    Part `pair` has for each source of a language every other one with the sum over all kept terms, part `term` the `top` terms of which the
    source holds more than its language. Ranks fall with the value, ties by the item's bytes. Null and empty languages and sources are the
    same group; a source without terms has pairs, and a language without kept terms pairs of value 0. Repeated rows count as documents of
    their own, other columns are ignored, an empty table gives no rows.

    What tasks get sent is one number per source of a language. The result has a row for each two of them, so a result that can be written
    bounds that table: 10**10 rows come from 10**5 sources, some MB.
    """
    kept = C.stored(stripes(docs, least), "stripes")
    entries = kept.select("lang", "term", F.col("n").alias("all"), F.inline("counts"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("of_lang"))
    held = entries.groupBy("lang", "source").agg(F.sum("n").alias("of_source"))
    groups = occurring.join(held, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["terms", "of_lang", "of_source"])
    groups = C.stored(groups.withColumn("total", F.col("of_source") + F.col("terms")).withColumn("p0", share(F.lit(0).cast("long"), F.col("total"))), "groups")
    totals: dict[str, dict[str, int]] = {}
    for r in groups.select("lang", "source", "total").collect():
        totals.setdefault(r["lang"], {})[r["source"]] = r["total"]

    own = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"))).withColumn("q", share(F.col("all"), F.col("of_lang") + F.col("terms")))
    terms = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", place).where(F.col("rank") <= top)

    a, b = groups.select("lang", "source", "terms", F.col("p0").alias("a0")), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    both_lack = a.join(b, "lang").where("source <> item").select("lang", "source", "item", (F.col("terms") * apart(F.col("a0"), F.col("b0"))).alias("value"))
    # each source's counts as a histogram, against the other's share of an absent term, on either side of the pair
    bars = own.groupBy("lang", "source", "p", F.col("p0").alias("a0")).agg(F.count(F.lit(1)).alias("many")).join(b, "lang").where("source <> item")
    p, a0, b0, many = (F.col(c) for c in ("p", "a0", "b0", "many"))
    one_lacks = bars.groupBy("lang", "source", "item").agg(F.sum(many * (apart(p, b0) - apart(a0, b0))).alias("x"), F.sum(many * (apart(b0, p) - apart(b0, a0))).alias("y"))
    one_lacks = one_lacks.select("lang", F.inline(F.array(F.struct("source", "item", F.col("x").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("y").alias("value")))))
    both_hold = kept.select("lang", "counts").mapInArrow(_corrections(totals), "lang string, source string, item string, value bigint")
    pairs = both_lack.unionByName(one_lacks).unionByName(both_hold).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    return pairs.unionByName(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of the documents audited."""
    return audit(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT k, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 3),
whole AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, sum(n) AS total FROM held GROUP BY ALL),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(held.n, 0) AS n,
                 CAST(1 + (1000000000 * CAST(coalesce(held.n, 0) + 1 AS HUGEINT)) // (coalesce(size.total, 0) + whole.v) AS HUGEINT) AS p,
                 CAST(1 + (1000000000 * CAST(kept.n + 1 AS HUGEINT)) // (whole.total + whole.v) AS HUGEINT) AS q
          FROM g JOIN kept ON g.lang = kept.lang JOIN whole ON g.lang = whole.lang LEFT JOIN held ON g.lang = held.lang AND g.source = held.source AND kept.term = held.term
               LEFT JOIN size ON g.lang = size.lang AND g.source = size.source),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(apart.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON a.lang = apart.lang AND a.source = apart.source AND b.source = apart.item),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms
QUALIFY rank <= 200
"""
