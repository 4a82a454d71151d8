"""Secret scan with a random forest against false findings (operator 5).

Patterns propose candidates: values of assignments, long mixed tokens, key blocks. Each is described by its length, the transitions between
kinds of characters, how much of it dictionary words cover, its path and its neighbouring words. A random forest trained from labelled findings
then decides. The dictionary is the corpus itself: words that occur often in all documents, counted for those parts that candidates hold.
Without labelled findings of one's own, clear cases of the corpus are labelled by rule (`clear_cases`) and teach the forest about the rest.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlstrata.llm import common as C
from sqlstrata.llm.quality import _CLASS
from sqlstrata.session import scratch_path

C.by_value(__name__)

MAX_LABELLED = 20_000  # labelled findings that the forest is fitted on
TREES, DEPTH = 40, 6
OFTEN = 20  # occurrences that make a word a dictionary word
PART = range(4, 13)  # lengths of dictionary words looked for in a candidate
_ASSIGNED = re.compile(r"""[=:]\s{0,3}(["']?)([A-Za-z0-9+/_\-=.~!@#$%^&*]{8,}+)""")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20,}+={0,2}(?![A-Za-z0-9+/_\-])")
_BEGIN, _END = (re.compile(f"-----{w} [A-Z ]{{0,40}}PRIVATE KEY-----") for w in ("BEGIN", "END"))
_NAME = re.compile(r"([A-Za-z_][\w.\-]{0,60})[\"']?\s*\Z")
_WORDS = re.compile(r"\w+")
SECRET_NAMES = ("key", "token", "secret", "password", "passwd", "pwd", "credential", "auth", "bearer", "private", "apikey", "access")
PLAIN_NAMES = ("example", "sample", "test", "dummy", "fake", "placeholder", "hash", "sha", "md5", "checksum", "commit", "digest", "uuid", "guid", "version", "id", "url", "http", "https")
FIGURES = ["length", "digits", "upper", "lower", "other", "hex", "entropy", "to_digit", "from_digit", "case_switch", "vowel_consonant", "consonants", "repeats", "covered", "quoted", "assigned", "secret_name", "plain_name",
           "secret_near", "plain_near", "path_plain", "path_code"]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c in "aeiou" else 2 if c.islower() else 3 if c.isupper() else 4


def figures(value: str, quoted: bool, assigned: bool, name: str, near: list[str], path: str) -> list[float]:
    """The features of a candidate, but for the dictionary's share."""
    n = max(1, len(value))
    kinds = [_kind(c) for c in value]
    pairs = Counter(zip(kinds, kinds[1:]))
    share = lambda *ks: sum(k in ks for k in kinds) / n
    moves = lambda f: sum(v for (a, b), v in pairs.items() if f(a, b)) / n
    counts = Counter(value).values()
    name, path, near = name.lower(), path.lower(), [w.lower() for w in near]
    has = lambda words, texts: float(any(w in t for t in texts for w in words))
    parts = re.split(r"[\W_]+", name)
    return [float(len(value)), share(0), share(3), share(1, 2), share(4), float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), -sum(c / n * math.log2(c / n) for c in counts),
            moves(lambda a, b: a != 0 and b == 0), moves(lambda a, b: a == 0 and b != 0), moves(lambda a, b: (a == 3) != (b == 3)), moves(lambda a, b: {a, b} == {1, 2}), moves(lambda a, b: a == b == 2),
            sum(a == b for a, b in zip(value, value[1:])) / n, 0.0, float(quoted), float(assigned), has(SECRET_NAMES, [name]), float(any(p in PLAIN_NAMES for p in parts)),
            has(SECRET_NAMES, near), float(any(w in PLAIN_NAMES for w in near)), has(("test", "example", "sample", "doc", "fixture", "mock"), [path]), has((".env", "config", "secret", ".pem", ".key"), [path])]


def blocks(text: str):
    """(begin, end) of the key blocks, however long: from a first line to the next last line."""
    begin = _BEGIN.search(text)
    while begin and (end := _END.search(text, begin.end())):
        yield begin.start(), end.end()
        begin = _BEGIN.search(text, end.end())


def candidates(text: str) -> list[tuple[int, int, str, bool, str]]:
    """(begin, end, kind, quoted, name) of what may be a secret, to its real end, without overlaps: key blocks, then assigned values, then long tokens."""
    found: list[tuple[int, int, str, bool, str]] = []
    if "-----BEGIN" in text:
        found += [(a, b, "block", False, "") for a, b in blocks(text)]
    for m in _ASSIGNED.finditer(text):
        name = _NAME.search(text[max(0, m.start() - 64):m.start()])
        if name and not m[2].isalpha():
            found.append((m.start(2), m.end(2), "assigned", bool(m[1]), name[1]))
    for m in _LONG.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
            found.append((m.start(), m.end(), "token", text[m.start() - 1:m.start()] in ("'", '"'), ""))
    out, last = [], 0
    for f in sorted(found, key=lambda f: (f[0], f[2] != "block", f[2] != "assigned")):
        if f[0] >= last:
            out.append(f)
            last = f[1]
    return out


def _part_places(value: str) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the parts of a candidate's letter runs that may be dictionary words."""
    runs = [m.span() for m in re.finditer(r"[A-Za-z]{4,}", value)]
    at = [np.arange(a, b - n + 1) for a, b in runs for n in PART if n <= b - a]
    return (np.concatenate(at), np.repeat([n for a, b in runs for n in PART if n <= b - a], [len(x) for x in at])) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def parts_of(value: str) -> list[tuple[int, int, str]]:
    """(begin, length, part) of those parts, of the whole value."""
    return [(a, n, value[a:a + n].lower()) for a, n in zip(*(x.tolist() for x in _part_places(value)))]


def _parts(value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and hash of those parts. One byte stands for each character: parts are ASCII."""
    at, n = _part_places(value)
    with np.errstate(over="ignore"):
        return at, n, C.Rolling(np.frombuffer(value.encode("ascii", "replace"), np.uint8), C.byte_values(True)).spans(at, at + n).view(np.int64)


_FOUND = ("doc_id bigint, key bigint, begin bigint, end bigint, kind string, name string, value string, path string, figures array<double>, parts array<struct<at:int,n:int,h:bigint>>")


PARTS = 500_000  # parts of candidates in one batch


def _find(batches):
    schema = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "key", "begin", "end")], *[(c, pa.string()) for c in ("kind", "name", "value", "path")], ("figures", pa.list_(pa.float64())),
                        ("parts", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("h", pa.int64())])))])

    def made(rows, parts):
        sizes = np.cumsum([0] + [len(x[0]) for x in parts]).astype(np.int32)
        columns = [np.concatenate([x[i] for x in parts] or [np.zeros(0, np.int64)]) for i in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int64))], ["at", "n", "h"]))
        return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema) if f.name != "parts"], lists], schema=schema)

    for batch in batches:
        rows, parts, size = [], [], 0
        for doc, key, text, path in zip(*[batch.column(i).to_pylist() for i in (0, 1)], batch.column(2), batch.column(3).to_pylist()):
            text = text.as_py() or ""
            for begin, end, kind, quoted, name in candidates(text):
                value = text[begin:end]
                near = _WORDS.findall(text[max(0, begin - 80):begin])[-4:] + _WORDS.findall(text[end:end + 80])[:3]
                rows.append((doc, key, begin, end, kind, name, value, path, figures(value, quoted, kind == "assigned", name, near, path or "")))
                parts.append(_parts(value))
                size += len(parts[-1][0])
                if size > PARTS:
                    yield made(rows, parts)
                    rows, parts, size = [], [], 0
        yield made(rows, parts)


def _word_counts(wanted):
    """(h, c): how often words whose hash the bit set may hold occur in a batch."""
    def run(batches):
        bits = np.frombuffer(wanted.value, np.int64)
        schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])
        for batch in batches:
            data, offs = C.bytes_of(batch.column(0))
            got = []
            for i, j in C.row_blocks(offs):
                part, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                kind = _CLASS[part]
                edge = np.ones(len(part), bool)
                edge[1:] = kind[1:] != kind[:-1]
                edge[o[:-1][o[:-1] < len(part)]] = True
                start = np.flatnonzero(edge)
                end = np.r_[start[1:], len(part)].astype(np.int64)
                ok = (kind[start] == 1) & (end - start >= PART[0]) & (end - start <= PART[-1])
                with np.errstate(over="ignore"):
                    h = C.Rolling(part, C.byte_values(True)).spans(start[ok], end[ok]).view(np.int64)
                got.append(h[C.in_bits(h, bits)])
            h, c = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], schema=schema)
    return run


def findings(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """Candidates of all documents with their features: `(doc_id, key, begin, end, kind, name, value, path, figures)`; `key` is the text's hash."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"),
                       F.col("source").cast("string").alias("path"))
    found = C.stored(rows.mapInArrow(_find, _FOUND), "found")
    parts = found.select(F.xxhash64("value").alias("v"), "parts").select("v", F.explode("parts").alias("p")).select("v", "p.at", "p.n", "p.h").distinct()
    wanted = C.shared_array(spark, C.bit_set(found.select(F.explode("parts").alias("p")).select("p.h")))
    words = rows.select("text").mapInArrow(_word_counts(wanted), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= often).select("h")
    covered = parts.join(C.stored(words, "words"), "h").select("v", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("place")).groupBy("v").agg(F.count_distinct("place").alias("covered"))
    at = FIGURES.index("covered")
    share = F.coalesce(F.col("covered") / F.length("value"), F.lit(0.0))
    return found.drop("parts").withColumn("v", F.xxhash64("value")).join(covered, "v", "left").withColumn("figures", F.transform("figures", lambda x, i: F.when(i == at, share).otherwise(x))).drop("covered", "v")


def figure(name: str):
    return F.element_at("figures", FIGURES.index(name) + 1)


def clear_cases(found: DataFrame) -> DataFrame:
    """Adds `label`: 1 for key blocks and random values of a secret's name, 0 for values that words cover, that say they are something else, or that are one kind of character; null between."""
    random = (figure("length") >= 16) & (figure("digits") > 0.05) & (figure("covered") < 0.3) & (figure("entropy") >= 2.8)
    plain = (figure("covered") >= 0.6) | (figure("digits") >= 0.999) | (figure("digits") == 0) | ((figure("plain_name") + figure("path_plain")) > 0) | ((figure("plain_near") > 0) & (figure("secret_name") == 0))
    return found.withColumn("label", F.when(F.col("kind") == "block", 1).when(random & (figure("secret_name") > 0) & (figure("plain_name") == 0), 1).when(plain, 0))


def scan(docs: DataFrame, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """`docs(doc_id, text, source, ...)` to one row per candidate: `(doc_id, key, begin, end, kind, name, value, score, is_secret)`.

    `labelled(value, label)` are findings judged before (1 secret, 0 not); without them `clear_cases` of the corpus are taken. The forest is fitted on
    at most `max_labelled` of them, the first by hash. With labels of one kind only, or none, clear cases stand for themselves and the rest is
    no secret. Null and empty texts give no rows; repeated rows give repeated findings; null ids and sources are carried along; other
    columns are ignored; an empty table gives no rows.
    """
    found = clear_cases(findings(docs))
    if labelled is not None:
        found = found.drop("label").join(labelled.groupBy("value").agg(F.max("label").cast("int").alias("label")), "value", "left")
    found = C.stored(found, "findings").withColumn("f", F.col("figures"))
    known = found.where("label IS NOT NULL").orderBy(F.xxhash64("value", "doc_id"), "doc_id", "begin").limit(max_labelled)
    known = C.stored(known.select("label", *[figure(n).alias(n) for n in FIGURES]).coalesce(1), "known")
    out = ["doc_id", "key", "begin", "end", "kind", "name", "value", "score"]
    if known.select("label").distinct().count() < 2:
        return found.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.0))).select(*out, (F.col("score") >= 0.5).alias("is_secret"))
    asm = VectorAssembler(inputCols=FIGURES, outputCol="vector")
    known = known.withColumn("label", F.col("label").cast("double"))
    weight = known.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in weight}
    known = known.withColumn("weight", F.when(F.col("label") == 1, 0.5 / n[1.0]).otherwise(0.5 / n[0.0]) * sum(n.values()))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=7).fit(asm.transform(known))
    nodes = _saved(forest, found.sparkSession)
    scored = found.select(*out[:-1], "figures").mapInArrow(_forest_scores(nodes), ", ".join(f"{n} {t}" for n, t in found.select(*out[:-1]).dtypes) + ", score double")
    return scored.select(*out, (F.col("score") >= 0.5).alias("is_secret"))


def _saved(forest, spark: SparkSession) -> list[dict[str, np.ndarray]]:
    """The trees as arrays, through the model's own format in the shared folder: at most trees * 2**(depth + 1) nodes."""
    path = scratch_path(spark, "llm-forest")
    forest.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split").orderBy("treeID", "id").collect()
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r["treeID"], []).append(r)
    return [{"left": np.array([n["leftChild"] for n in t]), "right": np.array([n["rightChild"] for n in t]), "feature": np.array([n["split"]["featureIndex"] for n in t]),
             "most": np.array([(n["split"]["leftCategoriesOrThreshold"] or [0.0])[0] for n in t]), "chance": np.array([n["impurityStats"][1] / sum(n["impurityStats"]) for n in t])} for t in trees.values()]


def forest_scores(trees: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Mean over the trees of the share of secrets in the leaf that each row of `x` falls into."""
    total = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), np.int64)
        while (inner := t["left"][at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(t["feature"][at], 0)] <= t["most"][at]
            at = np.where(inner, np.where(go, t["left"][at], t["right"][at]), at)
        total += t["chance"][at]
    return total / max(1, len(trees))


def _forest_scores(trees: list[dict[str, np.ndarray]]):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).to_pylist(), float).reshape(batch.num_rows, len(FIGURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forest_scores(trees, x))], names=[*batch.schema.names[:-1], "score"])
    return run


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every secret replaced by `[SECRET]` and `n_chars` of changed texts counted anew; all other rows and columns as they are."""
    spans = scan(docs).where("is_secret").groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("begin").cast("int").alias("b"), F.col("end").cast("int").alias("e")))).alias("_spans"))
    spans = C.stored(spans, "secrets").withColumnRenamed("key", "_key")
    both = docs.join(spans, F.xxhash64(docs["text"].cast("string")) == spans["_key"], "left")
    start = F.struct(F.lit("").alias("done"), F.lit(1).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["done"], F.substring(F.col("text"), s["at"], x["b"] + 1 - s["at"]), F.lit("[SECRET]")).alias("done"), (x["e"] + 1).alias("at"))
    cut = F.aggregate("_spans", start, step, lambda s: F.concat(s["done"], F.substring(F.col("text"), s["at"], F.length("text"))))
    both = both.withColumn("_text", cut)
    columns = {"text": F.coalesce("_text", "text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.length("_text"), "n_chars").cast(docs.schema["n_chars"].dataType)
    return both.withColumns(columns).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of all documents, judged."""
    return scan(C.table(spark, sf_dir, "documents"))
