"""Folding, matching, what labels teach, and accuracy on the held-out third of the given documents."""

import zlib

import pytest

from helpers import awkward, make_docs, prose
from sqlstrata.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def fixed():
    return T.Lexicon(*T.fixed_patterns())


@pytest.mark.parametrize("text", ["you idiot", "You 1D10T!!", "you іdіоt", "you ｉｄｉｏｔ", "you id​iot", "YOU IDIOTS", "you |d!ot"])
def test_disguises_meet_the_stem(text):
    assert [p for _, p in fixed().matches(T.fold(text))] == [" idiot"]


@pytest.mark.parametrize("text", ["the trash can is full", "an IDIOT-PROOF lock", "idiot\nproof", "clownfish and clown fish", "the class clown left", "videoidiot", "call 555-1234 at 10 o'clock", "", " \n ", "42"])
def test_nothing_counts(text):
    assert fixed().matches(T.fold(text)) == []


def test_exception_spares_its_own_words_only():
    assert [p for _, p in fixed().matches(T.fold("that idiot put trash in the trash can"))] == [" idiot", " trash"]


def test_longest_pattern_counts():
    lexicon = T.Lexicon({" ab": 3.0, " abcd ": 0.5, " abc": 1.0}, [])
    assert [p for _, p in lexicon.matches(" abcd abcde abx ")] == [" abcd ", " abc", " ab"]


def test_matches_against_brute_force():
    """The automaton's choice against trying every pattern at every word."""
    weights = {f" {w[:k]}": 1.0 for w in prose(5, 60, 9).split() for k in (2, 3, 5)} | {f" {w} ": 2.0 for w in prose(6, 30, 9).split()}
    text = T.fold(prose(5, 400, 9))
    lexicon, want, at = T.Lexicon(weights, []), [], 0
    while at < len(text) - 1:
        fit = [p for p in weights if text.startswith(p, at)]
        if fit:
            want.append((at, max(fit, key=len)))
        at = text.find(" ", at + 1)
        if at < 0:
            break
    assert lexicon.matches(text) == want


def test_score_falls_with_length_and_grows_with_matches():
    lexicon = fixed()
    short, long, more = "you moron " + prose(1, 20), "you moron " + prose(1, 900), "you moron idiot scum " + prose(1, 20)
    assert lexicon.score(more) > lexicon.score(short) > lexicon.score(long) > lexicon.score("") == lexicon.score(None)


def corpus(n=900):
    """Toxic documents of an invented language use the stem `krau`; some clean ones the harmless word `kraubelig`."""
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(i, 40, 30).split(), int(i % 5 == 0)
        for at in (5, 11, 30) if toxic else ():
            words[at] = "Krau" + ["bel", "ster", "nig", "mox"][(i + at) % 4]
        if i % 20 == 1:
            words[20] = "kraubelig"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def tables(spark, rows, labels):
    return make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_stems_and_spares_clean_words(spark):
    rows, labels = corpus()
    docs, marks = tables(spark, rows, labels)
    lexicon = T.learned(docs, marks)
    assert [p for _, p in lexicon.matches(" kraubei kraumox ")] and lexicon.weights[" kraubeiig "] < 1
    got = {r["doc_id"]: r for r in T.toxicity(docs, marks).collect()}
    wrong = [i for i, _, toxic in labels if got[i]["held_out"] and got[i]["predicted"] != toxic]
    assert not wrong and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(400)
    turned = [(i, q, 1 - t if T.held_out(i) else t) for i, q, t in labels]
    a, b = (T.learned(*tables(spark, rows, x)) for x in (labels, turned))
    assert a.weights == b.weights and a.curve == b.curve


def test_awkward_rows(spark):
    docs, marks = tables(spark, awkward(), [(1, 1, 1), (2, None, 0), (2, 1, 1), (20, 0, None), (None, 1, 1), (77, 1, 0)])
    got = T.toxicity(docs, marks).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in awkward())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 40)}) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert T.toxicity(docs.limit(0), marks).count() == 0 and T.toxicity(docs, marks.limit(0)).count() == len(awkward())


def test_held_out_accuracy(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = T.query(spark, SF).join(marks.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    toxic = x[x.toxic == 1].score.to_numpy()
    clean = x[x.toxic == 0].score.to_numpy()
    auc = ((toxic[:, None] > clean).sum() + 0.5 * (toxic[:, None] == clean).sum()) / (len(toxic) * len(clean))
    assert auc >= 0.9 and (x[x.predicted == 1].toxic == 1).mean() >= 0.9 and docs.count() == T.query(spark, SF).count()
