import hashlib
import random
from collections import Counter

from helpers import awkward, make_docs, prose

from sqlstrata.llm import repeat_index as R


def covered(texts, length):
    c = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i:i + length]] > 1:
                m[i:i + length] = b"\1" * length
        out.append(bytes(m))
    return out


def test_index_against_brute_force():
    r = random.Random(3)
    for _ in range(150):
        base = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 60))) for _ in range(3)]
        texts = list({b"".join(r.choice(base) for _ in range(r.randint(1, 3)))[:r.randint(3, 80)] for _ in range(5)})
        length = r.randint(2, 20)
        mine = [bytearray(len(t)) for t in texts]
        for t, lo, hi in R.repeated_windows(texts, length):
            mine[t][lo:hi + length] = b"\1" * (hi + length - lo)
        assert [bytes(m) for m in mine] == covered(texts, length)


def want(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), t, m in zip(rows, texts, covered(texts, length)):
        kept = bytes(b for b, x in zip(t, m) if not x)
        out.append((-1 if d is None else d, len(t), sum(m), len([x for x in m.split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_against_brute_force(spark):
    rows = awkward()
    assert got(R.repeats(make_docs(spark, rows))) == want(rows)


def test_many_variants_of_one_passage(spark):
    """More segments of one anchor than a shard takes: windows are counted as rows."""
    passage = prose(7, 80)
    r = random.Random(2)
    rows = []
    for i in range(40):
        p = passage[:]
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(p))
            p = p[:at] + r.choice("xyz") + p[at + 1:]
        rows.append((i, prose(100 + i, 5) + p))
    before = R.MANY
    try:
        R.MANY = 3
        many = got(R.repeats(make_docs(spark, rows)))
    finally:
        R.MANY = before
    assert many == want(rows) == got(R.repeats(make_docs(spark, rows)))


def test_empty_table(spark):
    assert R.repeats(make_docs(spark, [])).count() == 0


def test_pieces_of_a_long_text(spark):
    before = R.PIECE
    try:
        R.PIECE = 1000
        rows = [(1, prose(1, 900)), (2, prose(2, 20) + prose(1, 900)[2500:4500])]
        assert got(R.repeats(make_docs(spark, rows))) == want(rows)
    finally:
        R.PIECE = before


def test_passages_have_spans_and_kept_text(spark):
    rows = [r for r in awkward() if r[0] is not None]
    texts = [(t or "").encode() for _, t in rows]
    want_ = sorted((d, [i for i, x in enumerate(m) if x], bytes(b for b, x in zip(t, m) if not x)) for (d, _), t, m in zip(rows, texts, covered(texts, 200)))
    mine = sorted((r["doc_id"], [i for x in r["spans"] for i in range(x["a"], x["b"])], bytes(r["kept"])) for r in R.passages(make_docs(spark, rows)).collect())
    assert mine == want_ and any(s for _, s, _ in mine)
