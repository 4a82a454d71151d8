import random

import corpus_pipeline as P
from helpers import make_docs, prose

from sqlstrata.llm import decontaminate, jaccard_join, secret_scan


def tables(spark, folder):
    r = random.Random(3)
    rows, labels = [], []
    items = [(i, prose(700 + i, 30)) for i in range(4)]
    for i in range(240):
        t = prose(i, 60)
        if i % 5 == 0:
            t = " ".join(w + "###" if j % 2 else w.upper() + "!!" for j, w in enumerate(t.split()))
        rows.append((i, t, "en", f"src{i % 7}", len(t)))
        if i % 2 == 0 or i % 10 == 5:
            labels.append((i, int(i % 5 != 0), 0))
    base = rows[1][1].split()
    rows += [(300 + k, " ".join([*base[:k], "new", *base[k + 1:]]), "en", "src1", 9) for k in range(3)]
    rows += [(310 + k, prose(800 + k, 30) + " " + items[k][1], "en", "src1", 9) for k in range(4)]
    secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows += [(320, prose(850, 40) + f' token = "{secret}" ', "en", "src1", 9), (330, None, "en", None, None), (331, "", None, "src1", 0)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars int"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return rows, items, secret


def test_stages_take_effect(spark, tmp_path):
    rows, items, secret = tables(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    names = docs.columns
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(P.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = docs
    ids = lambda name: {r["doc_id"] for r in seen[name].collect()}
    good = {d for d, *_ in rows if d >= 300 or d % 5}
    first = ids("quality_classifier")
    assert len(first ^ good) <= 0.08 * len(good)
    second = ids("ngram_jaccard_join")
    assert first - second == {300, 301, 302} & first if 1 in first else True
    third = ids("benchmark_decontamination")
    assert second - third == {310, 311, 312, 313} & second
    fourth = seen["secret_scan"].collect()
    assert {r["doc_id"] for r in fourth} == third and all(secret not in (r["text"] or "") for r in fourth)
    assert {r["doc_id"] for r in seen["packing"].collect()} == third
    assert P.run(spark, str(tmp_path)).count() == seen["packing"].count()
    assert decontaminate and jaccard_join and secret_scan


def test_near_copies_between_the_thresholds(spark):
    """Two inner words of 100 replaced: 86 of 106 five-word shingles are shared (over 0.8), but 89 of 105 four-word ones (under 0.85)."""
    words = [f"w{i}" for i in range(100)]
    swap = lambda *at: " ".join(f"new{i}" if i in at else w for i, w in enumerate(words))
    docs = make_docs(spark, [(1, " ".join(words)), (2, swap(30, 60)), (3, swap(10, 30, 50, 70))])
    assert sorted(r["doc_id"] for r in P.deduplicate(spark, docs, "").collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()) == [1, 2, 3]
