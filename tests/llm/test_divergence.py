"""Divergence audit against a plain dictionary version, and the stripes that it rests on."""

import re
from collections import Counter, defaultdict

import pytest

from helpers import awkward, make_docs, prose
from sqlstrata.llm import divergence


def brute(rows, least=3, top=200):
    """Every source of every language against every other one and its language, term by term."""
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(words)
        documents[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, -value, rank))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def mixed():
    langs, sources = ["en", "de", None, ""], ["a", "b", None, "c", "É", "z"]
    texts = [(i, prose(i % 17, 30 + i % 40, 12), langs[i % 4], sources[i * i % 6]) for i in range(150)]
    return texts + [(900, None, "xx", "only"), (901, "...", "xx", "other"), (902, "Été ÉTÉ été été", "fr", "a"), (903, "été", "fr", "b"), (904, "été x", "fr", "a"), (905, "été", "fr", "b")]


def test_against_brute_force(spark):
    rows = mixed() + [(None, t, "en", "a") for _, t in awkward()]
    got = rows_of(divergence.audit(make_docs(spark, rows)))
    assert len(got) == len(set(got)) and set(got) == brute([r[1:] for r in rows])


def test_spills_and_top(spark, monkeypatch):
    """Stripes emitted after every document, and pairs a few at a time, give the same rows; `top` cuts terms only."""
    monkeypatch.setattr(divergence, "SPILL", 3)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 5)
    monkeypatch.setattr(divergence.C, "CHUNK_BYTES", 16)
    rows = mixed()
    assert set(rows_of(divergence.audit(make_docs(spark, rows), top=4))) == brute([r[1:] for r in rows], top=4)


def test_empty_and_termless(spark):
    assert rows_of(divergence.audit(make_docs(spark, [(1, "a", "en", "s")]).limit(0))) == []
    got = rows_of(divergence.audit(make_docs(spark, [(1, None, "en", "s"), (2, "word", "en", "t")])))
    assert sorted(got) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]  # no term in three documents


@pytest.mark.parametrize("count, total", [(0, 1), (10**9, 3 * 10**9), (9 * 10**12, 9 * 10**13), (0, 9 * 10**13), (6, 7), (0, 0)])
def test_share_is_exact(spark, count, total):
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence.share(F.lit(count).cast("long"), F.lit(total).cast("long"))).first()[0]
    assert got == (1 + 10**9 * (count + 1) // total if total else 1)


def test_plan_has_one_shuffle_for_stripes(spark):
    """Merging the tasks' stripes costs one exchange, although counts are added up by source and by term."""
    plan = divergence.stripes(make_docs(spark, mixed()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
