import math
import re

import duckdb

from helpers import awkward, make_docs

from sqlstrata.llm import license_scan as L

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["Released under the MIT License.", "mit license MIT-License, mit\nlicense", "Apache License and general public license, GENERAL PUBLIC LICENSE", "licensed under CC BY-NC 4.0.", "cc by nc", "ÉMIT license", "mit licensé", "license mit",
         "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "permission warranty license " * 400,
         "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution of source forms is met by modification"]


def base(text):
    w = re.findall(L.WORD, (text or "").translate(FOLD))
    at = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_against_brute_force(spark):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = [tuple(r) for r in L.scan(make_docs(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    assert sorted(got, key=str) == sorted([(d, *base(t)) for d, t in rows], key=str)


def test_templates(spark):
    filler = [(i, f"plain words number {i} and nothing else of the kind") for i in range(200, 240)]
    rows = {r["doc_id"]: r for r in L.scan(make_docs(spark, [(i, t) for i, t in enumerate(TEXTS)] + filler)).collect()}
    assert rows[0]["labels"] == "mit" and rows[0]["score"] == 1.0
    assert rows[3]["labels"] == "cc-by-nc" and rows[3]["base_labels"] == "" and rows[3]["n_base"] == 0
    assert rows[8]["labels"] == "gpl" and rows[10]["labels"] == "bsd"
    assert rows[7]["labels"] == rows[9]["labels"] == rows[11]["labels"] == "" and rows[7]["score"] == 0.0
    assert all(r["labels"] == "" for i, r in rows.items() if i >= 200)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows.values())


def test_empty_table_and_plan(spark):
    df = L.scan(make_docs(spark, []))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_several_notices_in_one_text(spark):
    """Every notice that stands in a text counts, also a common one beside notices of rarer words."""
    footers = [(i, f"text number {i} licensed under CC BY-SA 4.0") for i in range(200, 260)]
    bundle = " ".join(f"part {i} {notice}." for i, (_, notice, _) in enumerate(L.TEMPLATES))
    rows = {r["doc_id"]: r for r in L.scan(make_docs(spark, [(1, TEXTS[10] + " Licensed under CC BY-SA 4.0"), (2, bundle), (3, bundle.upper() * 40), *footers])).collect()}
    assert rows[1]["labels"] == "bsd,cc-by-sa" and rows[1]["score"] == 1.0
    assert rows[2]["labels"] == rows[3]["labels"] == ",".join(sorted({label for label, _, _ in L.TEMPLATES}))
    assert all(rows[i]["labels"] == "cc-by-sa" for i, _ in footers)


def by_hand(texts, templates, rarest, share):
    """Labels and score of each text, template by template and offset by offset."""
    words = [re.findall(L.WORD, (t or "").translate(FOLD)) for t in texts]
    df = lambda w: sum(w in d for d in words)
    out = []
    for d in words:
        labels, score = set(filter(None, base(" ".join(d))[4].split(","))), 0.0
        for label, notice, keys in templates:
            n = notice.split()
            looked = sorted(set(n), key=lambda w: (df(w), w))[:rarest]
            v = [math.log((len(texts) + 1) / (df(w) + 1)) + 1e-6 if w in looked else 0.0 for w in n]
            met = max((sum(v[p] for p in range(len(n)) if 0 <= o + p < len(d) and d[o + p] == n[p]) for o in range(-len(n), len(d))), default=0) / sum(v)
            if all(f" {k} " in f" {' '.join(d)} " for k in keys) and met >= share - 1e-9:
                labels, score = labels | {label}, max(score, met)
        out.append((",".join(sorted(labels)), score))
    return out


def cases():
    whole = [notice for _, notice, _ in L.TEMPLATES]
    halves = [" ".join(n.split()[:len(n.split()) // 2]) for n in whole]
    broken = [" ".join(w if i % 5 else "other" for i, w in enumerate(n.split())) for n in whole]
    return [t for _, t in awkward() if not t or len(t) < 3000] + TEXTS + whole + halves + broken + [a + " and " + b for a, b in zip(whole, whole[1:])] + ["mozilla public license", "free and unencumbered software", "gnu lesser general public license history"]


def test_labels_and_score_by_hand_and_in_sql(spark):
    texts = cases()
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in L.scan(make_docs(spark, rows)).collect()}
    want = by_hand(texts, L.TEMPLATES, L.RAREST, L.SHARE)
    assert [got[i]["labels"] for i, _ in rows] == [x for x, _ in want]
    assert all(abs(got[i]["score"] - s) < 1e-6 for i, (_, s) in enumerate(want))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({L.SQL})").fetchall()) == sorted(tuple(r[c] for c in cols) for r in got.values())


def test_key_phrases_alone_are_no_notice(spark):
    for_key = [(i, f"we talk about the {keys[0]} and nothing else here") for i, (_, n, keys) in enumerate(L.TEMPLATES) if len(n.split()) > 12 and len(keys[0].split()) * 2 < len(n.split())]
    filler = [(i, "we talk about plain things of the kind and nothing else here") for i in range(100, 130)]
    rows = {r["doc_id"]: r for r in L.scan(make_docs(spark, for_key + filler)).collect()}
    assert len(for_key) > 8 and all(r["labels"] == r["base_labels"] and r["score"] == 0 for r in rows.values())


def test_many_templates_and_other_phrases(spark):
    many = [(f"l{i}", f"terms of the custom{i} grant word{i} may be used by anyone{i} for purpose{i}", [f"custom{i} grant"]) for i in range(300)]
    docs = make_docs(spark, [(i, f"see here the {many[i * 29][1]} and more") for i in range(10)] + [(99, "see the bsd terms here")])
    rows = {r["doc_id"]: r for r in L.scan(docs, phrases=[("bsd terms", "bsd")], templates=many).collect()}
    assert [rows[i]["labels"] for i in range(10)] == [f"l{i * 29}" for i in range(10)] and rows[99]["n_base"] == 1
