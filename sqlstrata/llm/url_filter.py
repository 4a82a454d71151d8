"""URL filter by the ratio of two character language models (operator 2), in DataFrame operations only.

URLs that a rule accepts or rejects train two models of variable order over the characters of whole URLs, as they are. What the models gather is a
table of rows: each run of ORDER + 1 characters of the corpus with its numbers of accepted and rejected URLs' places, so it grows with the input.
The probability of a character blends contexts of ORDER characters down to none: each order is smoothed with the next shorter one by how many different
characters followed the context, and a context seen too seldom is left to the shorter ones. Orders are joins of one table of counts with the next
shorter table. A URL's score is the mean log ratio of its characters and its end; the threshold is calibrated on rule-labelled URLs kept out of training.

Each different URL counts once, in training, calibration and scoring. Runs that make up at least 1 / FREQUENT of all places are at most FREQUENT by
their nature: that part of the table is broadcast, and only the places of rarer runs are shuffled to meet the rest of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sqlstrata.llm import common as C

ORDER = 4
LEAST = 2  # a context must have been seen so often to be used
HELD_OUT = 5  # one in so many labelled URLs calibrates
FREQUENT = 1 << 16
UNIT = 1_000_000  # log ratios are summed as whole numbers of this part, in any order the same
BINS, STEP = 4000, 0.005
BEFORE, END = "\x02", "\x03"  # what stands before the first character and after the last

# (verdict, host, path): a host fits itself and its subdomains, a path what begins with it; the longest rule wins
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased, and the path up to `?` or `#`; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. The first of two equally long ones."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_runs(rows: DataFrame, text: Column) -> DataFrame:
    """Adds `runs`: for each character, and the end, the ORDER characters before it and itself."""
    # places by array position: a long URL costs what its length says
    rows = rows.withColumn("_chars", F.concat(F.array(*[F.lit(BEFORE)] * ORDER), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit(END))))
    run = lambda i: F.concat(*[F.get("_chars", i + k) for k in range(ORDER + 1)])
    return rows.withColumn("runs", F.transform(F.sequence(F.lit(0), F.size("_chars") - 1 - ORDER), run)).drop("_chars")


def counted(texts: DataFrame) -> DataFrame:
    """`texts(url, ruled, held, ...)` to `(run, n, a, r)`: places of each run in all URLs, and in accepted and rejected ones that train."""
    train = ~F.coalesce("held", F.lit(False))
    kind = F.when(train & (F.col("ruled") == "allow"), 1).when(train & (F.col("ruled") == "block"), 2).alias("kind")
    # never empty, so the outer form drops nothing; the plain one would build the array a second time to filter on its size
    places = with_runs(texts, F.col("url")).select(kind, F.explode_outer("runs").alias("run"))
    return places.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == 1).alias("a"), F.count_if(F.col("kind") == 2).alias("r"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """`counts(run, n, a, r)` to `(run, n, ratio)`: log of the quotient of the two smoothed probabilities of each run's last character."""
    below = None
    for k in range(ORDER + 1):
        level = counts.groupBy(F.right("run", F.lit(k + 1)).alias("run")).agg(*[F.sum(c).alias(c) for c in "nar"])
        level = level.withColumn("ctx", F.substring("run", 1, k)).withColumn("short", F.right("run", F.lit(k)))
        context = level.groupBy("ctx").agg(F.count("*").alias("kinds"), *[F.sum(c).alias(f"n{c}") for c in "ar"], *[F.count_if(F.col(c) > 0).alias(f"t{c}") for c in "ar"])
        level = level.join(context, "ctx")
        if below is None:
            level = level.withColumns({"pa": 1.0 / F.col("kinds"), "pr": 1.0 / F.col("kinds")})
        else:
            level = level.join(below, "short")
        smooth = lambda c: F.when(F.col(f"n{c}") >= LEAST, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}"))
        below = C.stored(level.select(F.col("run").alias("short"), "n", smooth("a").alias("pa"), smooth("r").alias("pr")), f"order{k}")
        if k < ORDER:
            below = below.drop("n")
    return below.select(F.col("short").alias("run"), "n", F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def scored(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """`texts(k1, k2, url, ...)` to `(k1, k2, score)`: the mean log ratio of a URL's characters and its end."""
    total = ratios.agg(F.sum("n")).first()[0] or 0
    known = ratios.select("run", F.round(F.col("ratio") * UNIT).cast("long").alias("v"), (F.col("n") * FREQUENT >= total).alias("often"))
    often, rare = F.broadcast(known.where("often").drop("often")), known.where("NOT often").drop("often")
    places = with_runs(texts, F.col("url")).select("k1", "k2", F.explode_outer("runs").alias("run"))
    values = places.join(often, "run").unionByName(places.join(often, "run", "left_anti").join(rare, "run"))
    return values.groupBy("k1", "k2").agg((F.sum("v") / F.count("*") / UNIT).alias("score"))


def threshold(bins: DataFrame) -> DataFrame:
    """`bins(bin, a, r)`, at most 2 * BINS + 1 rows, to the bin from which on URLs are allowed.

    Of the cuts between two bins the one with the best mean of the two kinds' rates is taken, the higher of equal ones; it lies half-way.
    """
    order, every = Window.orderBy("bin"), Window.partitionBy()
    up = order.rowsBetween(Window.unboundedPreceding, -1)
    middle = F.ceil((F.col("bin") + F.coalesce(F.lag("bin").over(order), "bin")) / 2)
    rates = bins.select("bin", middle.alias("middle"), F.sum("a").over(every).alias("all_a"), F.sum("r").over(every).alias("all_r"),
                        F.coalesce(F.sum("a").over(up), F.lit(0)).alias("lost_a"), F.coalesce(F.sum("r").over(up), F.lit(0)).alias("cut_r"))
    good = F.struct(F.col("cut_r") / F.col("all_r") - F.col("lost_a") / F.col("all_a"), F.col("bin"))
    return rates.where("all_a > 0 AND all_r > 0").agg(F.max_by("middle", good).alias("bin"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """`pages(page_id bigint, url string, ...)` to `(page_id, host, path, rule, verdict, score)`, one row per input row.

    A URL that a rule fits has its verdict; any other is allowed when its score reaches the threshold that tells allowed and blocked held-out
    URLs apart best. One without `://` has empty host and path and is scored by its characters, a null URL as the
    empty text. Without labelled URLs of both kinds all others are allowed. Repeated rows and null ids are carried along; other columns are
    ignored; an empty table gives no rows. `rules` is a short list: it becomes one expression.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    # a key of 128 bits stands for a URL, however long
    rows = rows.select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled"), F.xxhash64("url").alias("k1"), F.xxhash64(F.lit(1), "url").alias("k2"))
    texts = C.stored(rows.select("k1", "k2", "url", "ruled").distinct().withColumn("held", F.col("ruled").isNotNull() & (F.pmod("k1", F.lit(HELD_OUT)) == 0)), "urls")

    scores = C.stored(scored(texts, log_ratios(C.stored(counted(texts), "runs"))), "scores")
    binned = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / STEP)))
    bins = texts.where("held").join(scores, ["k1", "k2"]).groupBy(binned.alias("bin")).agg(
        F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("r"))
    best = threshold(bins).first()["bin"]  # one number
    verdict = F.coalesce("ruled", F.when(F.floor(F.col("score") / STEP) < F.lit(best), "block").otherwise("allow"))
    return rows.join(scores, ["k1", "k2"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages' URLs."""
    return judge(C.table(spark, sf_dir, "pages"))
