"""The catalog: references joined to definitions, what is missing or orphaned, and the file and table graphs.

Joins run on distinct keys, not on single references: rows of a hot table are counted on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sqlstrata.functions import text as T

# Reference types in order of precedence.
REF_PRIORITY = ["insert", "update", "delete", "join", "select"]
MAX_SAMPLES = 12  # fixed value: an edge shows this many sample references


def _name(key: Column) -> Column:
    return T.key_name(key)


def def_keys(defs: DataFrame) -> DataFrame:
    """Distinct definition keys with name and whether they carry a schema."""
    return defs.select(F.col("table_key").alias("def_key")).distinct().select(
        "def_key", T.key_name(F.col("def_key")).alias("def_name"), F.col("def_key").contains(".").alias("def_has_schema"))


def key_resolution(ref_keys: DataFrame, defs: DataFrame) -> DataFrame:
    """`(ref_key, def_key, tier)`: the exact key (1), else the same name (2); a qualified reference then takes only
    definitions without a schema. `ref_keys` has one column `ref_key` of distinct keys."""
    keys = def_keys(defs)
    exact = ref_keys.join(keys.select("def_key"), F.col("ref_key") == F.col("def_key"), "inner").select("ref_key", "def_key", F.lit(1).alias("tier"))
    rest = ref_keys.join(exact.select("ref_key"), "ref_key", "left_anti").select("ref_key", T.key_name(F.col("ref_key")).alias("_n"))
    by_name = rest.join(keys, (F.col("_n") == F.col("def_name")) & ~(F.col("ref_key").contains(".") & F.col("def_has_schema")), "inner")
    return exact.unionByName(by_name.select("ref_key", "def_key", F.lit(2).alias("tier")))


def ref_keys(refs: DataFrame) -> DataFrame:
    return refs.select(F.col("table_key").alias("ref_key")).distinct()


def resolve_refs(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Every reference with the definition keys it may mean; null when there is none."""
    found = key_resolution(ref_keys(refs), defs)
    return refs.join(found, refs.table_key == found.ref_key, "left").drop("ref_key")


def first_definitions(defs: DataFrame) -> DataFrame:
    """One definition per key: the first by path and line."""
    first = F.min(F.struct("path", "line", "doc_id", "stmt_idx", "def_type", "name", "schema_name"))
    return defs.groupBy("table_key").agg(first.alias("d"), F.count("*").alias("n_definitions")).select(
        "table_key", "d.def_type", "d.path", "d.line", "n_definitions")


def find_definitions(wanted: DataFrame, defs: DataFrame) -> DataFrame:
    """First definition for each wanted key (column `ref_key`), tiered as above."""
    found = key_resolution(wanted, defs).join(first_definitions(defs), F.col("def_key") == F.col("table_key"))
    best = F.min(F.struct("tier", "path", "line", "def_key", "def_type"))
    return found.groupBy("ref_key").agg(best.alias("b")).select("ref_key", "b.def_key", "b.def_type", "b.path", "b.line", "b.tier")


def reference_keys_of(targets: DataFrame, refs: DataFrame) -> DataFrame:
    """`(target_key, ref_key)`: the exact key, else references of that name (unqualified ones for a qualified target)."""
    keys = ref_keys(refs)
    exact = targets.join(keys, F.col("target_key") == F.col("ref_key")).select("target_key", "ref_key")
    rest = targets.join(exact.select("target_key"), "target_key", "left_anti")
    by_name = rest.join(keys, (T.key_name(F.col("target_key")) == T.key_name(F.col("ref_key")))
                        & ~(F.col("target_key").contains(".") & F.col("ref_key").contains(".")))
    return exact.unionByName(by_name.select("target_key", "ref_key"))


def find_references(targets: DataFrame, refs: DataFrame) -> DataFrame:
    pairs = reference_keys_of(targets, refs)
    return pairs.join(refs, pairs.ref_key == refs.table_key).drop("ref_key")


def external_references(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References whose key the same file does not define."""
    return refs.join(defs.select("path", "table_key").distinct(), ["path", "table_key"], "left_anti")


def dependent_files(targets: DataFrame, refs: DataFrame) -> DataFrame:
    used = refs.groupBy("table_key", "path").agg(F.lit(1).alias("_one"))
    pairs = reference_keys_of(targets, refs)
    return pairs.join(used, pairs.ref_key == used.table_key).select("target_key", "path").distinct()


def table_lists(refs: DataFrame, defs: DataFrame) -> DataFrame:
    both = defs.select("table_key", F.lit(1).alias("d"), F.lit(0).alias("r")).unionByName(refs.select("table_key", F.lit(0).alias("d"), F.lit(1).alias("r")))
    return both.groupBy("table_key").agg((F.max("d") == 1).alias("is_defined"), (F.max("r") == 1).alias("is_referenced"))


def missing(refs: DataFrame, defs: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Referenced keys without a definition; `local` holds names (`cte_name`) that are never tables."""
    counts = refs.groupBy("table_key").agg(F.count("*").alias("references"))
    files = refs.groupBy("table_key", "path").agg(F.lit(1).alias("_one")).groupBy("table_key").agg(F.count("*").alias("files"))
    found = key_resolution(ref_keys(refs), defs).select(F.col("ref_key").alias("table_key"))
    out = counts.join(found, "table_key", "left_anti").join(files, "table_key")
    if local is not None:
        out = out.join(local.select("cte_name").distinct(), T.key_name(F.col("table_key")) == F.col("cte_name"), "left_anti")
    return out


def orphaned(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Definition keys referenced neither by key nor by name."""
    first, keys = first_definitions(defs), ref_keys(refs)
    by_key = first.join(keys, F.col("table_key") == F.col("ref_key"), "left_anti")
    names = keys.select(T.key_name(F.col("ref_key")).alias("_n")).distinct()
    return by_key.join(names, T.key_name(F.col("table_key")) == F.col("_n"), "left_anti").select("table_key", "def_type", "n_definitions")


def primary_type(types_seen: dict[str, Column] | None = None) -> Column:
    """Aggregate: the reference type of highest precedence in a group."""
    rank = F.lit(len(REF_PRIORITY))
    for i, t in reversed(list(enumerate(REF_PRIORITY, 1))):
        rank = F.when(F.col("ref_type") == t, i).otherwise(rank)
    return F.element_at(F.array(*[F.lit(t) for t in REF_PRIORITY]), F.min(rank))


def file_uses(refs: DataFrame) -> DataFrame:
    """References counted per (file, key, type): what the graphs are built from."""
    return refs.groupBy("path", "table_key", "ref_type").agg(F.count("*").alias("n"))


def _cross_file(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """(src file, dst file, key, type, n): uses of keys that other files define and this file does not."""
    uses = file_uses(refs)
    found = key_resolution(ref_keys(refs), defs).select("ref_key", "def_key")
    homes = defs.groupBy(F.col("table_key").alias("def_key"), F.col("path").alias("dst")).agg(F.count("*").alias("n_defs"))
    own = found.join(homes, "def_key").select(F.col("ref_key").alias("table_key"), F.col("dst").alias("path")).distinct()
    outside = uses.join(own, ["path", "table_key"], "left_anti")
    return (outside.join(found, outside.table_key == found.ref_key).join(homes, "def_key")
            .select(F.col("path").alias("src"), "dst", "table_key", "ref_type", (F.col("n") * F.col("n_defs")).alias("n")))


def file_graph(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Edges file -> file it depends on: `(src, dst, count, tables, reference_type)`."""
    pairs = _cross_file(refs, defs)
    per_table = pairs.groupBy("src", "dst", "table_key", "ref_type").agg(F.sum("n").alias("n"))
    tables = per_table.groupBy("src", "dst", "table_key").agg(F.lit(1).alias("_one")).groupBy("src", "dst").agg(F.count("*").alias("tables"))
    return per_table.groupBy("src", "dst").agg(F.sum("n").alias("count"), primary_type().alias("reference_type")).join(tables, ["src", "dst"])


def file_edge_tables(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """The tables behind each file edge, as a long table."""
    return _cross_file(refs, defs).groupBy("src", "dst", "table_key").agg(F.sum("n").alias("count"))


def file_edge_samples(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Up to twelve distinct sample references per file edge. Spark limits each group before it shuffles."""
    edges = file_edge_tables(refs, defs).select("src", "dst", "table_key")
    spots = refs.select(F.col("path").alias("src"), "table_key", "line", "context").distinct()
    order = Window.partitionBy("src", "dst").orderBy("line", "context", "table_key")
    return edges.join(spots, ["src", "table_key"]).withColumn("sample", F.row_number().over(order)).filter(F.col("sample") <= MAX_SAMPLES)


def view_references(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """`(view_key, path, table_key, ref_type)` references in a view's scope: its statement, else the lines up to the next view.

    The line scope is an as-of join: the last view at or before the line, within one text.
    """
    views = defs.filter(F.col("def_type") == "view").select("doc_id", "stmt_idx", F.col("table_key").alias("view_key"), F.col("line").alias("view_line"))
    r = refs.select("doc_id", "path", "stmt_idx", "line", "table_key", "ref_type")
    in_statement = r.join(views, ["doc_id", "stmt_idx"]).select("doc_id", "view_key", "path", "table_key", "ref_type")
    lonely = views.join(r.select("doc_id", "stmt_idx").distinct(), ["doc_id", "stmt_idx"], "left_anti")
    marks = views.select("doc_id", F.col("view_line").alias("line"), F.lit(0).alias("_o"), "view_key", *[F.lit(None).cast("string").alias(c) for c in ("path", "table_key", "ref_type")])
    rows = r.select("doc_id", "line", F.lit(1).alias("_o"), F.lit(None).cast("string").alias("view_key"), "path", "table_key", "ref_type")
    order = Window.partitionBy("doc_id").orderBy("line", "_o", "view_key").rowsBetween(Window.unboundedPreceding, 0)
    scoped = marks.unionByName(rows).withColumn("view_key", F.last("view_key", ignorenulls=True).over(order)).filter("_o = 1 and view_key is not null")
    by_line = scoped.join(lonely.select("doc_id", "view_key").distinct(), ["doc_id", "view_key"], "left_semi").select("doc_id", "view_key", "path", "table_key", "ref_type")
    return in_statement.unionByName(by_line)


def table_graph(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Edges view -> its source: `(src, dst, count, reference_type)`; keys the same file defines are left out."""
    uses = view_references(refs, defs).groupBy("view_key", "path", "table_key", "ref_type").agg(F.count("*").alias("n"))
    uses = uses.join(defs.select("path", "table_key").distinct(), ["path", "table_key"], "left_anti")
    found = key_resolution(ref_keys(refs), defs)
    n_defs = defs.groupBy(F.col("table_key").alias("def_key")).agg(F.count("*").alias("n_defs"))
    targets = found.join(n_defs, "def_key").select(F.col("ref_key").alias("table_key"), "def_key", "n_defs")
    rows = uses.join(targets, "table_key", "left").select(
        F.col("view_key").alias("src"), F.coalesce("def_key", "table_key").alias("dst"), "ref_type", (F.col("n") * F.coalesce("n_defs", F.lit(1))).alias("n"))
    return rows.filter("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("count"), primary_type().alias("reference_type"))


def external_nodes(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Referenced keys that no definition has; an unqualified key is also satisfied by a definition of that name."""
    keys = def_keys(defs)
    unknown = ref_keys(refs).join(keys, F.col("ref_key") == F.col("def_key"), "left_anti")
    names = keys.select("def_name").distinct()
    outside = unknown.join(names, ~F.col("ref_key").contains(".") & (F.col("ref_key") == F.col("def_name")), "left_anti")
    counts = refs.groupBy("table_key").agg(F.count("*").alias("references"))
    return outside.join(counts, F.col("ref_key") == F.col("table_key")).select("table_key", "references")


def foreign_keys_to(columns: DataFrame, targets: DataFrame) -> DataFrame:
    """Columns whose foreign key means the target; schemas are compared only when both sides have one."""
    fk = columns.filter(F.col("ref_table").isNotNull()).select("table_key", F.lower("column_name").alias("column_name"), F.lower("ref_table").alias("_fk"), "ref_column").distinct()
    t = targets.select("target_key").distinct()
    same_name = T.key_name(F.col("_fk")) == T.key_name(F.col("target_key"))
    schemas = ~(F.col("_fk").contains(".") & F.col("target_key").contains(".")) | (F.col("_fk") == F.col("target_key"))
    return fk.join(t, same_name & schemas).select("target_key", "table_key", "column_name", F.col("_fk").alias("ref_table"), F.lower("ref_column").alias("ref_column"))


def nearest_statement(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """As-of match of views and CTAS to the statement whose references start nearest at or after the definition,
    else the one that ends nearest before it, within one text."""
    spans = refs.filter(F.col("ref_type").isin("select", "join")).groupBy("doc_id", "stmt_idx").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    d = defs.filter((F.col("def_type") == "view") | F.col("is_ctas")).select("doc_id", "table_key", "line").distinct()
    # Forward and backward as-of by one ordered pass each: the nearest span start at or after, the nearest end before.
    marks = (d.select("doc_id", "line", F.lit(0).alias("_o"), "table_key", F.lit(None).cast("struct<at:int,stmt:int>").alias("span"))
             .unionByName(spans.select("doc_id", F.col("lo").alias("line"), F.lit(1).alias("_o"), F.lit(None).cast("string").alias("table_key"),
                                       F.struct(F.col("lo").cast("int").alias("at"), F.col("stmt_idx").cast("int").alias("stmt")).alias("span"))))
    ahead = Window.partitionBy("doc_id").orderBy("line", "_o", "span").rowsBetween(0, Window.unboundedFollowing)
    after = marks.withColumn("_a", F.first("span", ignorenulls=True).over(ahead)).filter("_o = 0").select("doc_id", "table_key", "line", F.col("_a.stmt").alias("_after"))
    ends = (d.select("doc_id", "line", F.lit(1).alias("_o"), "table_key", F.lit(None).cast("struct<at:int,neg:int>").alias("span"))
            .unionByName(spans.select("doc_id", F.col("hi").alias("line"), F.lit(0).alias("_o"), F.lit(None).cast("string").alias("table_key"),
                                      F.struct(F.col("hi").cast("int").alias("at"), (-F.col("stmt_idx")).cast("int").alias("neg")).alias("span"))))
    behind = Window.partitionBy("doc_id").orderBy("line", "_o", "span").rowsBetween(Window.unboundedPreceding, 0)
    before = ends.withColumn("_b", F.last("span", ignorenulls=True).over(behind)).filter("_o = 1").select("doc_id", "table_key", "line", (-F.col("_b.neg")).alias("_before"))
    return after.join(before, ["doc_id", "table_key", "line"]).select("doc_id", "table_key", "line", F.coalesce("_after", "_before").alias("stmt_idx"))


def workspace_stats(files: DataFrame, refs: DataFrame, defs: DataFrame) -> DataFrame:
    """One row of totals: files, tables, views, references, parse errors."""
    n_files = files.select("path").distinct().agg(F.count("*").alias("files"))
    errors = files.agg(F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"))
    d = defs.agg(F.count_if(F.col("def_type") == "table").alias("tables"), F.count_if(F.col("def_type") == "view").alias("views"))
    r = refs.agg(F.count("*").alias("references"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(n_files).join(one(d), "_k").join(one(r), "_k").join(one(errors), "_k").drop("_k")


def issues(refs: DataFrame, defs: DataFrame, files: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Orphaned and missing tables and unread files in one long table."""
    orph = orphaned(refs, defs).select(F.lit("orphaned").alias("issue"), F.col("table_key").alias("name"), F.col("n_definitions").alias("occurrences"), F.lit(0).cast("long").alias("files"))
    miss = missing(refs, defs, local).select(F.lit("missing").alias("issue"), F.col("table_key").alias("name"), F.col("references").alias("occurrences"), "files")
    bad = files.filter(F.col("parse_error").isNotNull()).groupBy("path").agg(F.count("*").alias("n")).select(F.lit("parse_error").alias("issue"), F.col("path").alias("name"), F.col("n").alias("occurrences"), F.lit(1).cast("long").alias("files"))
    return orph.unionByName(miss).unionByName(bad)
