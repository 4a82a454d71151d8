import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, make_docs
from tokenizers import Tokenizer

from sqlstrata.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a\x1cb c", "x\x1f \x1dy", "foo<|endoftext|>bar <|startoftext|>", "it's we'll İstanbul ΣΑΣ é ́x", "a b c　d​e", "日本 語。", "𝔘𝔫 ½ ²", "don't'd's 's", "a\u0085b c᠎d", "Word. WORD, word!! word's. word's, a1. ,. ..", "<|STARTOFTEXT|> <|endoftext|>.", "ΟΔΟΣ. İSTANBUL.", "한글. 가, é."]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(plain):
    mine = P.WordTokenizer(PATH).ids(ODD)
    assert mine == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(ODD, add_special_tokens=False)]


def check(rows, plain, pieces):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048
    for d, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        mine = by_doc[(d, len(ids))]
        expected, copies = np.array(ids, "<u4"), sum(1 for d2, t2 in rows if d2 == d and t2 == t)
        assert sum(p["length"] for p in mine) == len(ids) * copies
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(expected[p["start"]:p["start"] + p["length"]].tobytes())
    return by_seq


def test_every_id_lies_in_one_piece(spark, plain):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(ODD)]
    check(rows, plain, P.pack(make_docs(spark, rows), PATH).collect())
    assert P.pack(make_docs(spark, []), PATH).count() == 0


def test_little_padding(spark, plain):
    rows = [(i, "word and more " * (i % 900)) for i in range(300)]
    seq = check(rows, plain, P.pack(make_docs(spark, rows).repartition(4), PATH).collect())
    used = sum(p["length"] for s in seq.values() for p in s)
    assert used / (2048 * len(seq)) > 0.97


def test_cuts_and_leftovers():
    first = P.cuts()
    for r in range(1, 2048):
        x, n = r, 0
        while x:
            x, n = x - first[x], n + 1
        assert x == 0 and n <= 4
    where = P.fill_leftovers([700, 700, 700, 5, 5, 1025, 1000])
    load = {}
    for n, (b, o) in sorted(zip([700, 700, 700, 5, 5, 1025, 1000], where), key=lambda x: x[1]):
        assert load.get(b, 0) == o
        load[b] = o + n
    assert max(load.values()) <= 2048


def test_sequences_hold_the_token_ids(spark, plain):
    rows = [(d, t) for d, t in awkward() if d is not None] + [(100 + i, t) for i, t in enumerate(ODD)]
    texts = {d: [*plain.encode(t or "", add_special_tokens=False).ids, P.END] for d, t in rows}
    pieces = P.pack(make_docs(spark, rows), PATH).collect()
    assert all(list(p["ids"]) == texts[p["doc_id"]][p["start"]:p["start"] + p["length"]] for p in pieces)
    assert sum(len(p["ids"]) for p in pieces) == sum(len(texts[d]) for d, _ in rows)


def test_words_stay_known_and_are_encoded_as_by_the_whole_tokenizer(monkeypatch):
    words = P.WordTokenizer(PATH)
    texts = [" ".join(f"straße{chr(97 + i % 26)}{chr(97 + i // 26)} häßlich, éléphant!! naïveté ÿ ñandú æsop #{i} it's ªb µm ŉa ét a{i}b" for i in range(j, j + 40)) for j in range(0, 200, 40)]
    monkeypatch.setattr(P, "CACHED", 100)  # what is in use stays when the rest goes
    for _ in range(2):
        for t in texts:
            assert words.ids([t])[0] == np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            assert "naïveté" in words.known and len(words.known) <= 400
    alone = []
    monkeypatch.setattr(words, "_model_only", lambda new: alone.extend(new) or [])
    words.ids(texts[-1:])
    assert not alone
    assert P.worker_tokenizer(PATH) is P.worker_tokenizer(PATH)  # the next task of a worker starts with its words
