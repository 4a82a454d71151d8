import re

import numpy as np
import pytest
from helpers import awkward, make_docs, prose

from sqlstrata.llm import jaccard_join as J

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    ids = [d for d, _ in rows if d is not None]
    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d if d is not None else -1, len(shingles(t)), find(d) if d is not None else -1) for d, t in rows)


def got(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_against_brute_force(spark):
    rows = awkward()
    assert got(J.jaccard_components(make_docs(spark, rows))) == brute(rows)


def test_large_group_of_near_copies(spark):
    words = prose(8, 150).split()
    r = np.random.RandomState(5)
    rows = []
    for i in range(120):
        w = list(words)
        for at in r.choice(len(w), r.randint(0, 8), replace=False):
            w[at] = f"x{r.randint(5)}" if r.rand() < 0.7 else f"own{i}"
        rows.append((i * 3, " ".join(w)))
    assert got(J.jaccard_components(make_docs(spark, rows))) == brute(rows)


def test_empty_table_and_one_of_each(spark):
    assert J.jaccard_components(make_docs(spark, [])).count() == 0
    rows = awkward()
    kept = J.one_of_each(make_docs(spark, rows))
    comp = {d: c for d, _, c in brute(rows) if d >= 0}
    assert kept.columns == make_docs(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for c in comp.values()})
    assert kept.where("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 20, 333])
def test_lead_length(n):
    p = J.lead_length(n)
    assert p == 0 or n - p + 1 == -(-85 * n // 100)


def test_heads_in_parts():
    """A list that is passed on in parts has the same heads as in one go."""
    import pyarrow as pa

    rows = np.array(sorted((g, b, p, n, d) for d, (g, b, p, n) in enumerate([(1, 3, 0, 20), *[(7, 3 + i % 3, i % 4, 20 + i % 2) for i in range(60)], (9, 1, 0, 10), (9, 1, 1, 10)])))
    cols = {"gram": rows[:, 0], "block": rows[:, 1], "n": rows[:, 3], "doc_id": rows[:, 4], "pos": rows[:, 2]}

    def run(step, flush):
        J.FLUSH, before = flush, J.FLUSH
        batches = [pa.RecordBatch.from_pydict({k: pa.array(v[a:a + step], pa.int64()) for k, v in cols.items()}) for a in range(0, len(rows), step)]
        out = pa.Table.from_batches(list(J._head_rows(batches, 85, 100))).to_pydict()
        J.FLUSH = before
        return sorted(zip(*out.values()))
    assert run(1000, 10**6) == run(7, 10**6) == run(7, 10)


def test_one_word_more_or_less_in_short_texts(spark):
    """Texts of 4 to 12 words with one word added in front, behind or inside, or removed: a set that lies in one of one gram more links."""
    rows = []
    for n in range(4, 13):
        w = prose(500 + n, n).split()
        for text in (w, ["first", *w], [*w, "last"], w[1:], [*w[:n // 2], "inner", *w[n // 2:]]):
            rows.append((len(rows) + 1, " ".join(text)))
    assert got(J.jaccard_components(make_docs(spark, rows))) == brute(rows)
    assert J.lead_length(6) == 1 and J.lead_length(5) == 0 and J.lead_length(4, 80) == 1
