"""License scan with a positional rare-token index (operator 8), in DataFrame operations only.

How many documents hold each word of the templates is counted over the whole corpus. Of each template the rarest words (highest inverse
document frequency) are indexed with their positions, whether a document holds them or not. A document's words are looked up in that index, each
posting is shifted by where the word stands, and the weight that meets at one offset is set against the weight of all the template's indexed
words: key phrases alone are not enough. Templates whose mandatory key phrases do not all stand in the document are out.

The index is one value of words with their postings, so the plan does not grow with the templates, and all lookups are row by row: the only
shuffle is the count of template words.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlstrata.llm import common as C

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels: places where the words stand one after the other.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# (label, notice, key phrases that must all stand in the document). Public licence notices.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["unless required by applicable law or agreed to in writing"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["eclipse public license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("bsl", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ["all rights reserved", "strictly prohibited"]),
]
RAREST = 8  # words of each template that are indexed
SHARE = 0.6  # part of the weight of a template's indexed words that must meet at one offset


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def vocabulary(templates) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()})


def document_frequency(words: DataFrame, vocab: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents that hold each template word, over the whole corpus: a row for each of a fixed number of words reaches the driver."""
    held = words.select(F.explode(F.filter(F.array_distinct("words"), lambda w: w.isin(vocab))).alias("w")).groupBy("w").count()
    counts = held.union(words.select(F.lit("").alias("w")).groupBy("w").count()).collect()
    found = {r["w"]: r["count"] for r in counts}
    return found.pop("", 0), found


def phrase_places(words: Column, phrase: str) -> Column:
    """Positions at which the words of a phrase stand one after the other."""
    parts = phrase.split()
    first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.filter(first, lambda i: _and([F.get(words, i + k) == p for k, p in enumerate(parts) if k]))


def _and(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def positional_index(templates, total: int, df: dict[str, int], rarest: int) -> tuple[dict[str, list[dict]], list[dict]]:
    """Postings (template, position, weight) of the rarest words of each template, ties to the smaller word; and label, key phrases and full weight of each template."""
    index: dict[str, list[dict]] = {}
    facts = []
    for t, (label, notice, keys) in enumerate(templates):
        words = notice.split()
        looked = sorted(set(words), key=lambda w: (df.get(w, 0), w))[:rarest]
        full = 0.0
        for i, w in enumerate(words):
            if w in looked:
                index.setdefault(w, []).append({"t": t, "p": i, "v": _idf(total, df.get(w, 0))})
                full += index[w][-1]["v"]
        facts.append({"label": label, "keys": [f" {k} " for k in keys], "full": full})
    return index, facts


def _meeting(postings: Column) -> Column:
    """Largest weight of one template's shifted postings, sorted by offset, that share an offset."""
    start = F.struct(F.lit(None).cast("int").alias("o"), F.lit(0.0).alias("run"), F.lit(0.0).alias("best"))

    def step(s, x):
        run = F.when(s["o"] == x["o"], s["run"]).otherwise(0.0) + x["v"]
        return F.struct(x["o"].cast("int").alias("o"), run.alias("run"), F.greatest(s["best"], run).alias("best"))
    return F.aggregate(postings, start, step)["best"]


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, rarest: int = RAREST, share: float = SHARE) -> DataFrame:
    """`docs(doc_id bigint, text string, ...)` to `(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`, one row per input row.

    Words are runs of non-ASCII characters, digits and letters, A-Z lower-cased. `n_base` counts all places of the base phrases, `first_word`
    and `last_word` are their smallest and largest start (null without any). `labels` adds those of verified templates; `score` is the
    largest part of a verified template's indexed weight that stands at one offset (0 without; rounded to nine digits). A null or empty text has no words and no
    labels (empty strings). Null ids and repeated rows are carried along; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"))
    vocab = vocabulary(templates)
    total, df = document_frequency(rows, vocab)
    index, facts = positional_index(templates, total, df, rarest)
    postings = F.from_json(F.lit(json.dumps(index)), "map<string,array<struct<t:int,p:int,v:double>>>")
    template = F.from_json(F.lit(json.dumps(facts)), "array<struct<label:string,keys:array<string>,full:double>>")

    # base places
    base = F.flatten(F.array(*[_labelled(phrase_places(F.col("words"), p), label) for p, label in phrases]))
    # postings of the document's words, shifted by where they stand
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(list(index)))
    shifted = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(postings, h["w"]), lambda e: F.struct(e["t"].alias("t"), (h["i"] - e["p"]).alias("o"), e["v"].alias("v")))))
    anchored = F.exists("words", lambda w: w.isin(_anchors([keys[0] for _, _, keys in templates])))
    rows = rows.withColumn("shifted", F.when(anchored, F.array_sort(shifted)))
    rows = rows.withColumn("joined", F.when(F.size("shifted") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    rows = rows.withColumn("near", F.when(F.col("joined").isNotNull(), F.filter(F.array_distinct(F.transform("shifted", lambda x: x["t"])), lambda t: F.forall(F.get(template, t)["keys"], lambda k: F.col("joined").contains(k)))))
    met = F.transform("near", lambda t: F.struct(F.get(template, t)["label"].alias("label"), F.round(_meeting(F.filter("shifted", lambda x: x["t"] == t)) / F.get(template, t)["full"], 9).alias("share")))
    rows = rows.withColumn("found", F.coalesce(F.filter(met, lambda x: x["share"] >= share), F.array().cast("array<struct<label:string,share:double>>")))
    rows = rows.withColumn("base", F.when(F.exists("words", lambda w: w.isin(_anchors([p for p, _ in phrases]))), base).otherwise(F.array().cast("array<struct<i:int,label:string>>")))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["i"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda x: x["i"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels("base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels("base"), labels("found")))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"))


def _anchors(phrases: list[str]) -> list[str]:
    """The longest word of each phrase, the last of equal ones: without any of them, no phrase stands in a text."""
    return sorted({max(reversed(p.split()), key=len) for p in phrases})


def _idf(total: int, df: int) -> float:
    return math.log((total + 1) / (df + 1)) + 1e-6


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return scan(C.table(spark, sf_dir, "documents"))


def _sql(phrases=PHRASES, templates=TEMPLATES, rarest: int = RAREST, share: float = SHARE) -> str:
    """The same by joins of words and postings."""
    quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    notices = ", ".join(f"({t}, '{label}', {quoted(notice.split())}, {quoted(f' {k} ' for k in keys)})" for t, (label, notice, keys) in enumerate(templates))
    places = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM docs WHERE list_contains(words, '{phrase.split()[0]}')) WHERE "
        + " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split())) for phrase, label in phrases)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS words FROM documents),
template(t, label, notice, keys) AS (VALUES {notices}),
posting AS (SELECT t, unnest(notice) AS w, unnest(range(len(notice))) AS p FROM template),
token AS (SELECT * FROM (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs) WHERE w IN (SELECT w FROM posting)),
held AS (SELECT w, count(DISTINCT r) AS df FROM token GROUP BY w),
ranked AS (SELECT t, w, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), w) AS k FROM (SELECT DISTINCT t, w FROM posting) LEFT JOIN held USING (w)),
looked AS (SELECT t, w, p, ln(((SELECT count(*) FROM docs) + 1) / (df + 1)) + 1e-6 AS v FROM posting JOIN ranked USING (t, w) WHERE k <= {rarest}),
full_weight AS (SELECT t, sum(v) AS full_v FROM looked GROUP BY t),
met AS (SELECT r, t, max(v) AS v FROM (SELECT r, t, i - p AS o, sum(v) AS v FROM token JOIN looked USING (w) GROUP BY ALL) GROUP BY r, t),
found AS (SELECT r, label, round(v / full_v, 9) AS share FROM met JOIN full_weight USING (t) JOIN template USING (t) JOIN docs USING (r)
          WHERE (SELECT count(*) FROM unnest(keys) AS u(k) WHERE NOT contains(' ' || array_to_string(words, ' ') || ' ', k)) = 0 AND round(v / full_v, 9) >= {share}),
base AS ({places}),
based AS (SELECT r, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
best AS (SELECT r, max(share) AS score FROM found GROUP BY r),
labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM found UNION ALL SELECT r, label FROM base) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN based USING (r) LEFT JOIN labelled USING (r) LEFT JOIN best USING (r)"""


SQL = _sql()
