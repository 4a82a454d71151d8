import random

from helpers import awkward, make_docs, prose

from sqlstrata.llm import decontaminate as D


def all_ends(item, text):
    """Least edit distance of item to any part of text that ends at each character, by the plain table."""
    row, out = list(range(len(item) + 1)), []
    for j, c in enumerate(text):
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        out.append((row[-1], j + 1))
    return out


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def places(item, text):
    """Distances of all places of a normal item in a normal text: the least of each run of neighbouring ends."""
    if len(item) < D.SHORT_CHARS:
        return [0] * sum(f" {text} "[i:].startswith(f" {item} ") for i in range(len(text) + 2))
    most, runs, before = len(item) // D.CHARS_PER_EDIT, [], None
    for d, end in all_ends(item, text):
        if d <= most:
            if before != end - 1:
                runs.append(d)
            runs[-1] = min(runs[-1], d)
            before = end
    return runs


def test_bit_parallel_distance():
    r = random.Random(4)
    for _ in range(200):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(1, 150)))
        most = r.randint(0, len(item))
        assert D.ends(D.masks(item), len(item), text, most) == [x for x in all_ends(item, text) if x[0] <= most]
        assert D.ends(D.masks(item), len(item), text[:20], len(item) + 20, True) == [(plain_distance(item, text[:j]), j) for j in range(1, len(text[:20]) + 1)]


def test_all_places_of_an_item():
    r = random.Random(8)
    for _ in range(150):
        items = [(i, D.normal("".join(r.choice("ab c") for _ in range(r.choice([3, 9, 19, 20, 33, 50, 70]))))) for i in range(4)]
        items = [(i, t) for i, t in items if t]
        text = ""
        for _ in range(8):
            t = list(r.choice(items)[1]) if items else []
            for _ in range(r.randint(0, 3)):
                if t:
                    t[r.randrange(len(t))] = r.choice(["", "x", "ab"])
            text += "".join(t) + r.choice(["", " ", " x y "])
        text = D.normal(text)
        got = D.Items(items, D.CHARS_PER_EDIT).find(text) if items else []
        for i, t in items:
            assert [d for item, d, *_ in got if item == i] == places(t, text)
        assert all(plain_distance(dict(items)[i], text[a:b]) == d for i, d, a, b in got)


def test_against_brute_force(spark):
    r = random.Random(9)
    items = [(i, prose(50 + i, 25)) for i in range(6)] + [(6, None), (7, "one TWO"), (8, ""), (9, "!?"), (10, "ab")]
    rows = awkward()
    for i in range(24):
        t = list(items[i % 6][1])
        for _ in range(i // 2):
            at = r.randrange(len(t))
            t[at:at + 1] = r.choice([[], ["x"], [t[at], "y"]])
        twice = " - " + items[i % 6][1] if i % 5 == 0 else ""
        rows.append((200 + i, prose(300 + i, 30) + " " + "".join(t).upper() + "!? " + prose(400 + i, 10) + twice))
    rows = [(d, t) for d, t in rows if not t or len(t) < 5000]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = []
    for d, t in rows:
        for i, item in items:
            if item and D.normal(item) and t:
                want += [(d, i, x) for x in places(D.normal(item), D.normal(t))]
    for size in (D.BLOCK_CHARS, 200):
        got = [(x["doc_id"], x["item_id"], x["distance"]) for x in D.contaminated(make_docs(spark, rows), bench, block_chars=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x > 2 for *_, x in want) and len(set(want)) < len(want) and any(i == 7 for _, i, _ in want)
    left = {r["doc_id"] for r in D.clean(make_docs(spark, rows), bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, i, _ in want if d is not None and len(D.normal(dict(items)[i])) >= D.TELLING_CHARS}


def test_spans_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "The quick-brown fox jumps over!")], "item_id long, text string")
    doc = "Before. THE QUICK (brown) fox, jumps over it"
    row = D.contaminated(make_docs(spark, [(1, doc)]), bench).first()
    assert doc[row["begin"]:row["end"]] == "THE QUICK (brown) fox, jumps over" and row["distance"] == 0
    assert D.contaminated(make_docs(spark, []), bench).count() == 0
    assert D.contaminated(make_docs(spark, [(1, doc)]), bench.limit(0)).count() == 0


def test_offsets_where_lower_case_is_longer(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "short item here ok")], "item_id long, text string")
    texts = ["İİİİ İİ Alpha beta gamma delta epsilon. İİ", "x short ITEM here ok y short item here, ok", "x short item here okay"]
    got = D.contaminated(make_docs(spark, list(enumerate(texts))), bench).collect()
    assert sorted((r["doc_id"], texts[r["doc_id"]][r["begin"]:r["end"]]) for r in got) == [(0, "Alpha beta gamma delta epsilon"), (1, "short ITEM here ok"), (1, "short item here, ok")]
