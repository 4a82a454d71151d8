"""Differences between two versions: operators and statistics of a query, files of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def node_keys(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Operator nodes by normalised (kind, label). The last duplicate gives the signature."""
    label = F.lower(F.regexp_replace(F.trim("label"), r"\s+", " "))
    signature = F.xxhash64(F.col("signature"))
    return nodes.groupBy(*by, F.concat_ws(":", "kind", label).alias("node_key")).agg(F.max_by(signature, "pos").alias("signature"))


def diff_nodes(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """`(node_key, change)`: added, removed or changed; equal nodes are left out."""
    a, b = node_keys(left, by), node_keys(right, by)
    j = a.withColumnRenamed("signature", "_a").join(b.withColumnRenamed("signature", "_b"), [*by, "node_key"], "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return j.select(*by, "node_key", change.alias("change")).filter("change is not null")


def diff_stats(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    cols = ["joins", "subqueries", "complexity_score"]
    r = right.select(*by, *[F.col(c).alias(f"_{c}") for c in cols])
    return left.select(*by, *cols).join(r, by).select(*by, *[(F.col(f"_{c}") - F.col(c)).alias(f"{c}_delta") for c in cols])


def diff_corpus(old: DataFrame, new: DataFrame) -> DataFrame:
    """`(path, state)` by content hash: new, changed, deleted, same."""
    o, n = old.select("path", F.col("content_hash").alias("_o")), new.select("path", F.col("content_hash").alias("_n"))
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") != F.col("_n"), "changed").otherwise("same")
    return o.join(n, "path", "full_outer").select("path", state.alias("state"))


def merge_index(old: DataFrame, changed_paths: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows with those of the changed (or deleted) paths replaced by new ones."""
    return old.join(changed_paths.select("path").distinct(), "path", "left_anti").unionByName(new)


def dedupe_results(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["src", "dst"])
