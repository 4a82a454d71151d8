import random

import numpy as np
import pytest
from helpers import awkward, make_docs, prose

from sqlstrata.llm import quality as Q


def corpus():
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 60).split()
        kind = i % 6
        if kind == 0:
            words = [w + "###" if j % 2 else w.upper() + "!!" for j, w in enumerate(words)]
        elif kind == 1:
            for at in r.sample(range(60), 3):
                words[at] = r.choice(["horrible", "nasty", "vile"])
        rows.append((i, " ".join(words), "en", f"src{i % 9}"))
        if i % 2 == 0 or kind == 1 and i % 4 == 1:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


def test_held_out_accuracy_and_rounds(spark):
    rows, labels = corpus()
    docs = make_docs(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in Q.judge(docs, lab, exchange=40).collect()}
    known = {d for d, _, _ in labels}
    unseen = [i for i in range(600) if i not in known]
    right = sum(got[i]["keep"] == (i % 6 > 1) for i in unseen) / len(unseen)
    assert right > 0.93 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = Q.kept(docs, lab, exchange=40)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["keep"])


def test_awkward_rows_and_tables(spark):
    rows = awkward()
    lab = spark.createDataFrame([(1, 1, 0), (1, 0, None), (10, 1, None), (11, None, 1), (None, 1, 0), (20, 0, 0), (21, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.judge(make_docs(spark, rows), lab).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    assert Q.judge(make_docs(spark, []), lab).count() == 0
    none = Q.judge(make_docs(spark, rows), lab.limit(0)).collect()
    assert len(none) == len(rows) and all(r["keep"] for r in none)
    assert Q.kept(make_docs(spark, rows), lab.limit(0)).count() == len(rows)


def test_views_of_copies_are_equal():
    import pyarrow as pa

    texts = pa.array(["A bc, a", None, "", "a BC , a", "é é"])
    words, meta = Q._views_of(texts, ["s"] * 5, [None] * 5)
    w = words.to_pylist()
    assert w[0] == w[3] and w[1] == w[2] == [] and len(w[4]) == 1 and len(meta) == 5 and all(len(m) == len(meta[0].as_py()) for m in meta.to_pylist())


def test_fit_finds_the_telling_feature():
    import pyarrow as pa

    r = np.random.RandomState(0)
    lists = [[int(x) for x in r.choice(50, 8, replace=False)] + ([60] if i % 4 == 0 else []) for i in range(400)]
    y = np.array([i % 4 != 0 for i in range(400)], float)
    w = Q.fit(Q.Rows(pa.array(lists, pa.list_(pa.int32()))), y, np.ones(400), 64)
    p = Q.Rows(pa.array(lists, pa.list_(pa.int32()))).score(w) > 0
    assert (p == y).mean() > 0.99


@pytest.mark.parametrize("size", [600, 3000])
def test_exchange_with_the_defaults(spark, size):
    """No document is a pseudo-label of both classes or of two rounds, and confident ones are nearly all right."""
    r = random.Random(4)
    rows = []
    for i in range(size):
        words = prose(i, 30).split()
        if i % 3 == 0:
            words = [w + "###" if j % 2 else w.upper() + "!!" for j, w in enumerate(words)]
        elif r.random() < 0.3:
            words = [w + "###" if r.random() < 0.2 else w for w in words]
        rows.append((i, " ".join(words), "en", f"src{r.randrange(9)}"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(size) if i % 5 == 0], "doc_id long, quality int, toxic int")
    rounds = Q.train(Q.features(make_docs(spark, rows)), labels).exchanged
    docs = [{d for d, _, _ in x} for x in rounds]
    assert rounds and docs[0] and sum(map(len, docs)) == len(set().union(*docs))
    of = {}
    for d, _, label in (p for x in rounds for p in x):
        of.setdefault(d, set()).add(label)
    assert all(len(x) == 1 for x in of.values())
    assert sum(x == {int(d % 3 != 0)} for d, x in of.items()) > 0.95 * len(of)
