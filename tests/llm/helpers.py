"""Small tables with the awkward rows every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars int, n long, key string, rep long, seg string"


def make_docs(spark, rows):
    """(doc_id, text[, lang, source]) with further columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), 7, "k", 9, "s") for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) + str(r.randrange(words)) for _ in range(n))


def awkward(seed: int = 1):
    """Nulls, empty and very long texts, exact and near copies, repeated rows, a shared passage and a null id."""
    base, passage = prose(seed, 120), prose(99, 60)
    words = base.split()
    near = [" ".join([*words[:i * 9], f"new{i}", *words[i * 9 + 1:]]) for i in range(1, 6)]
    return [(1, base), (2, base), (3, None), (4, ""), (5, "one two"), (6, "one  TWO"), *[(10 + i, t) for i, t in enumerate(near)], (20, prose(2, 6000) + passage), (21, prose(3, 80) + "\n" + passage),
            (22, passage + prose(4, 30)), (30, "ab " * 900), (31, "é" * 500), (32, prose(5, 50)), (32, prose(5, 50)), (None, base), (None, None), (40, " \t\n")]
