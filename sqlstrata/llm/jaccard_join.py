"""N-gram Jaccard join with set-relation skipping (operator 4).

Each text becomes the set of its distinct word 4-grams, as 64-bit hashes. Equal sets are one class from then on. A set's index entries
are the first few grams of one global order in which grams that many sets hold come last, so that a passage shared by a third of
all texts enters no index list of theirs. Entries of a gram lie in blocks by set size, and a block or an entry whose size or position
rules out the overlap is skipped. Answers are derived from those of similar sets: sets are first compared with the head of their
block only, and of the rest only pairs that these answers leave unconnected are compared. Every compared pair is checked on whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlstrata.llm import common as C

C.by_value(__name__)

GRAM = 4
NUM, DEN = 85, 100  # sets link when DEN * intersection >= NUM * union
SHARED = (8, 64, 512)  # a gram counted more often comes later in the order, by these steps; any values give the same result
ORDER_BITS = 1 << 25
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_COEF = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD1B54A32D192ED03, 0xA24BAED4963EE407, 0x8CB92BA72F3D8DD7)]


def gram_sets(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> list[np.ndarray]:
    """For each row the sorted distinct hashes (signed) of its word grams; all words as one gram where they are fewer."""
    rows = len(offsets) - 1
    gap = _SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = True, True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    words = C.Rolling(data, C.byte_values(True)).spans(start, end)
    first = np.searchsorted(start, offsets)  # words before each row's begin
    total = np.zeros(max(0, len(words) - gram + 1), np.uint64)
    for k in range(gram):
        total += words[k:k + len(total)] * _COEF[k % len(_COEF)]
    grams = C.mix(total).view(np.int64)
    out = []
    for r in range(rows):
        a, b = first[r], first[r + 1]
        if b - a >= gram:
            out.append(np.unique(grams[a:b - gram + 1]))
        elif b > a:
            s = np.uint64(b - a) * np.uint64(0xE7037ED1A0B428DB)
            for k in range(b - a):
                s = s + words[a + k] * _COEF[k % len(_COEF)]
            out.append(C.mix(np.array([s], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def lead_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Entries of a set of n grams: two sets that link share one of these. None where only equal sets can link: not even one of n + 1 grams that holds all n."""
    return n - -(-num * n // den) + 1 if den * n >= num * (n + 1) else 0


def _sets_of(batch: pa.RecordBatch, gram: int):
    ids, (data, offsets) = batch.column(0), C.bytes_of(batch.column(1))
    with np.errstate(over="ignore"):
        for i, j in C.row_blocks(offsets):
            yield ids.slice(i, j - i), gram_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], gram)


def _profile(gram: int, num: int, den: int):
    """(doc_id, n, sig_a, sig_b, lead, times): set size, 128-bit signature, and grams to be counted for the order.

    Counted are all grams that several sets of a batch hold (with their number, on the batch's first row) and the first of each set (once).
    """
    def run(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "sig_a", "sig_b")] + [("lead", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
        for batch in batches:
            found = [(ids, sets) for ids, sets in _sets_of(batch, gram)]
            sets = [s for _, part in found for s in part]
            sig = []
            with np.errstate(over="ignore"):
                for s in sets:
                    u = s.view(np.uint64)
                    sig.append(tuple(int(C.mix(u ^ c).sum(dtype=np.uint64).view(np.int64)) for c in _COEF[:2]))
            first = {x: i for i, x in reversed(list(enumerate(sig)))}
            one = [first[x] == i for i, x in enumerate(sig)]
            grams, times = np.unique(np.concatenate([s for s, o in zip(sets, one) if o] or [np.zeros(0, np.int64)]), return_counts=True)
            grams, times = grams[times > 1], times[times > 1]
            lead, count = [], []
            for s, o in zip(sets, one):
                s = s[:lead_length(len(s), num, den)] if o else s[:0]
                if len(grams):
                    s = s[grams[np.minimum(np.searchsorted(grams, s), len(grams) - 1)] != s]
                lead.append(s)
                count.append(np.ones(len(s), np.int64))
            if lead:
                lead[0], count[0] = np.r_[grams, lead[0]], np.r_[times, count[0]]
            sizes = pa.array(np.cumsum([0] + [len(x) for x in lead]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(x or [np.zeros(0, np.int64)]))) for x in (lead, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in sig], pa.int64()), pa.array([x for _, x in sig], pa.int64()), *lists], schema=schema)
    return run


def _entries(gram: int, num: int, den: int, late):
    """(doc_id, n, entries): the first grams of each set in the order of how many sets hold them (by steps), then of their hash."""
    def run(batches):
        steps = np.frombuffer(late.value, np.int64).reshape(len(SHARED), -1)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("entries", pa.list_(pa.int64()))])
        for batch in batches:
            for ids, sets in _sets_of(batch, gram):
                out = []
                for s in sets:
                    step = sum(C.in_bits(s, bits).astype(np.int8) for bits in steps)
                    out.append(s[np.argsort(step, kind="stable")[:lead_length(len(s), num, den)]])
                sizes = np.cumsum([0] + [len(x) for x in out]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))], schema=schema)
    return run


def _whole(gram: int, wanted):
    """(doc_id, grams): whole sets of the rows whose id the bit set `wanted` may hold."""
    def run(batches):
        bits = np.frombuffer(wanted.value, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("grams", pa.list_(pa.int64()))])
        for batch in batches:
            keep = C.in_bits(np.asarray(batch.column(0).fill_null(0)), bits) & np.asarray(batch.column(0).is_valid())
            part = batch.filter(pa.array(keep))
            for ids, sets in _sets_of(part, gram) if part.num_rows else ():
                sizes = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(sets)))], schema=schema)
    return run


FLUSH = 400_000
NONE = -(1 << 63)  # no such set


def _may_link(n, pos, m, at, num, den):
    """Sizes and positions of a shared entry still allow the overlap."""
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (np.minimum(n - pos, m - at) * (num + den) >= num * (n + m))


def _heads(num: int, den: int):
    """Rows sorted by (gram, block, pos, n, doc_id) to the rows of lists of two and more, with the head of their block and of the block before.

    The head has fewest rarer grams of its own: of all entries it can resemble most others.

    A head that size or position rules out is NONE. A list longer than FLUSH rows is passed on in parts; only its heads are remembered.
    """
    return lambda batches: _head_rows(batches, num, den)


def _head_rows(batches, num, den):
    names = ["gram", "block", "n", "doc_id", "pos"]
    schema = pa.schema([(c, pa.int64()) for c in [*names, "head", "before"]])
    rest = None
    known = None  # of a list already passed on in part: gram, block, and (doc_id, n, pos) of the head and of the head before

    def passed(rows: np.ndarray, known):
        gram, block = rows[0], rows[1]
        new_list = np.r_[True, gram[1:] != gram[:-1]]
        new_block = new_list | np.r_[True, block[1:] != block[:-1]]
        b = np.cumsum(new_block) - 1
        heads, lists, blocks = rows[[3, 2, 4]][:, new_block], gram[new_block], block[new_block]
        prior = np.full_like(heads, NONE)
        near = np.r_[False, (lists[1:] == lists[:-1]) & (blocks[1:] == blocks[:-1] + 1)]
        if known and lists[0] == known[0]:
            if blocks[0] == known[1]:
                heads[:, 0], prior[:, 0] = known[2], known[3]
            elif blocks[0] == known[1] + 1:
                prior[:, 0] = known[2]
        prior[:, near] = heads[:, np.flatnonzero(near) - 1]
        size = np.diff(np.r_[np.flatnonzero(new_list), len(gram)])
        keep = (size > 1)[np.cumsum(new_list) - 1]
        if known:
            keep |= gram == known[0]
        of = []
        for h in (heads[:, b], prior[:, b]):
            some = (h[0] != NONE) & _may_link(rows[2], rows[4], np.where(h[0] == NONE, 1, h[1]), np.where(h[0] == NONE, 0, h[2]), num, den)
            of.append(np.where(some, h[0], NONE))
        out = pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in [*rows, *of]], schema=schema)
        return out, (int(lists[-1]), int(blocks[-1]), heads[:, -1].copy(), prior[:, -1].copy())

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in names])
        if rows.shape[1] == 0:
            continue
        rest = rows if rest is None else np.concatenate([rest, rows], axis=1)
        cut = int(np.searchsorted(rest[0], rest[0][-1]))
        if cut:
            out, _ = passed(rest[:, :cut], known)
            yield out
            rest, known = rest[:, cut:], known if known and known[0] == rest[0][-1] else None
        if rest.shape[1] > FLUSH:
            head, rest = rest, None
            if known is None:  # the list is known to be long: none of its rows is alone
                known = (int(head[0][0]), int(head[1][0]), head[[3, 2, 4]][:, 0].copy(), np.full(3, NONE, np.int64))
            out, known = passed(head, known)
            yield out
    if rest is not None:
        yield passed(rest, known)[0]


def _verified(pairs: DataFrame, texts: DataFrame, gram: int, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets link."""
    spark = pairs.sparkSession
    pairs = C.stored(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = C.shared_array(spark, C.bit_set(ids))
    sets = texts.mapInArrow(_whole(gram, wanted), "doc_id bigint, grams array<bigint>")
    sets = C.stored(sets, "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a")
    common = F.size(F.array_intersect("ga", "gb")).cast("long")
    return both.where(den * common >= num * (F.size("ga") + F.size("gb") - common)).select("a", "b").distinct()


def _fits(na, nb, pa_, pb, num: int, den: int):
    """Sizes and positions that still allow the overlap."""
    need = F.ceil(num * (na + nb) / (num + den))
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & (F.least(na - pa_, nb - pb) >= need)


def jaccard_components(docs: DataFrame, gram: int = GRAM, num: int = NUM, den: int = DEN) -> DataFrame:
    """`docs(doc_id bigint, text string, ...)` to one row per input row: `(doc_id, n_shingles, component_id)`.

    Words are runs of non-space bytes with A-Z lower-cased; a set is the distinct `gram`-word shingles of the whole text, or all its
    words as one where they are fewer. `component_id` is the smallest doc_id reachable by links. A null or empty text has no shingles and is its own component. A null doc_id keeps its row with a null component and takes no part.
    Repeated rows give repeated results. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = C.stored(texts.mapInArrow(_profile(gram, num, den), "doc_id bigint, n bigint, sig_a bigint, sig_b bigint, lead array<bigint>, times array<bigint>"), "profile")
    classes = C.stored(profile.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")

    # 1. The order: grams that many first entries hold come last.
    counts = profile.select(F.explode(F.arrays_zip("lead", "times")).alias("x")).groupBy(F.col("x.lead").alias("gram")).agg(F.sum("x.times").alias("c")).where(F.col("c") > SHARED[0])
    late = C.shared_array(spark, C.bit_sets(counts, [F.col("c") > least for least in SHARED], ORDER_BITS))

    # 2. The index: entries of one set per class, in blocks by size.
    copies = profile.where("n > 0 AND doc_id IS NOT NULL").join(classes.where("copies > 1"), ["sig_a", "sig_b"]).where("doc_id <> rep").select("doc_id")
    entries = texts.mapInArrow(_entries(gram, num, den, late), "doc_id bigint, n bigint, entries array<bigint>").where(F.size("entries") > 0)
    entries = entries.where("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")
    step = math.log(den / num)
    index = entries.select("doc_id", "n", F.floor(F.log("n") / step).cast("long").alias("block"), F.posexplode("entries").alias("p", "gram"))
    index = index.select("gram", "block", "n", "doc_id", F.col("p").cast("long").alias("pos"))
    lists = index.repartition("gram").sortWithinPartitions("gram", "block", "pos", "n", "doc_id").mapInArrow(
        _heads(num, den), "gram bigint, block bigint, n bigint, doc_id bigint, pos bigint, head bigint, before bigint")
    lists = C.stored(lists, "lists")

    # 3. Answers of the heads of blocks, whole sets checked.
    heads = lists.select("doc_id", F.explode(F.array("head", "before")).alias("h")).where((F.col("h") != NONE) & (F.col("h") != F.col("doc_id")))
    known = C.stored(_verified(heads.select(F.least("h", "doc_id").alias("a"), F.greatest("h", "doc_id").alias("b")).distinct(), texts, gram, num, den), "links")

    # 4. The rest: only pairs in lists of several components, between them, and not yet answered.
    group = C.stored(C.components(known), "group")
    placed = lists.join(group.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    several = placed.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("gram")
    placed = C.stored(placed.join(several, "gram"), "placed")
    x = placed.select("gram", "block", *[F.col(c).alias(f"x_{c}") for c in ("n", "doc_id", "pos", "head", "before", "c")])
    y = placed.select("gram", F.col("block").alias("y_block"), *[F.col(c).alias(f"y_{c}") for c in ("n", "doc_id", "pos", "head", "before", "c")], F.explode(F.array("block", F.col("block") - 1)).alias("block"))
    far = x.join(y, ["gram", "block"]).where(
        ((F.col("y_block") != F.col("block")) | (F.col("x_doc_id") < F.col("y_doc_id"))) & (F.col("x_c") != F.col("y_c"))
        & ~F.col("x_doc_id").isin(F.col("y_head"), F.col("y_before")) & ~F.col("y_doc_id").isin(F.col("x_head"), F.col("x_before"))
        & _fits(F.col("x_n"), F.col("y_n"), F.col("x_pos"), F.col("y_pos"), num, den))
    pairs = far.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()
    more = C.stored(_verified(pairs, texts, gram, num, den), "links")

    # 5. Components of class representatives, from those found before and the new links, and each row's class.
    stars = group.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    comps = C.components(more.union(stars)).select(F.col("node").alias("rep"), "component")
    named = classes.join(comps, "rep", "left").select("sig_a", "sig_b", F.coalesce("component", "rep").alias("class_component"))
    out = profile.select("doc_id", "n", "sig_a", "sig_b").join(named, ["sig_a", "sig_b"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class_component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, gram: int = GRAM, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of `docs` without all but the smallest doc_id of each component; of repeated rows of one doc_id one stays. Rows without a doc_id stay."""
    found = C.stored(jaccard_components(docs, gram, num, den), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(C.stored(gone, "gone"), docs["doc_id"] == F.col("_gone"), "left_anti")
    again = C.stored(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "again")
    if again.isEmpty():
        return left
    twice = left.join(again, left["doc_id"] == F.col("_again"), "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, left["doc_id"] == F.col("_again"), "left_anti").union(twice)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link classes of all documents."""
    return jaccard_components(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s), e AS (SELECT doc_id, unnest(grams) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, component) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, component FROM r JOIN u ON a = node)
SELECT CAST(n.doc_id AS BIGINT) AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(min(component) AS BIGINT) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
