"""Graph questions as loops of joins. Edges are `(src, dst)`; every result is a DataFrame.

A round joins the frontier to the edges, drops what was seen and is written to the shared folder. The loop stops at an
empty frontier. Spark picks a broadcast or a sort-merge join from the written size of each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlstrata.session import cut, cut_counted

DEFAULT_DEPTH, MAX_DEPTH = 5, 20  # fixed values: default and clamp of a requested depth
_COMPACT = 8  # rounds after which the seen set is rewritten as one table
_FILL = 64  # most edges that a contracted node may leave behind
_WAYS = 256  # most ways that a node may leave behind when cycles are listed


def clamp_depth(requested: int | None) -> int | None:
    """-1 is unlimited (None); otherwise 1..20, 5 when nothing was asked for."""
    if requested == -1:
        return None
    return min(max(requested or DEFAULT_DEPTH, 1), MAX_DEPTH)


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    e = edges.select("src", "dst")
    if direction == "up":
        e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "both":
        e = e.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e.distinct()


def _allowed(edges: DataFrame, nodes: DataFrame | None, types: list[str] | None, exclude_external: bool) -> DataFrame:
    """Edges whose end may be entered: a filtered node blocks the way, it is not only hidden."""
    if nodes is None or (not types and not exclude_external):
        return edges
    ok = nodes
    if types:
        ok = ok.filter(F.col("type").isin(types))
    if exclude_external:
        ok = ok.filter(F.col("type") != "external")
    return edges.join(ok.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def closure(edges: DataFrame, seeds: DataFrame, direction: str = "down", max_depth: int | None = None, nodes: DataFrame | None = None,
            types: list[str] | None = None, exclude_external: bool = False) -> DataFrame:
    """`(seed, node, depth)` reached from each seed (column `seed`), at its smallest depth; the seed itself is left out.

    Many seeds travel together: the loop runs once for all of them.
    """
    e = cut(_allowed(_directed(edges, direction), nodes, types, exclude_external), "edges")
    frontier = cut(seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")), "frontier")
    seen, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        step = step.join(_union(seen).select("seed", "node"), ["seed", "node"], "left_anti")
        frontier, rows = cut_counted(step.withColumn("depth", F.lit(depth)), "frontier")
        if rows == 0:
            break
        seen.append(frontier)
        if len(seen) > _COMPACT:
            seen = [cut(_union(seen), "seen")]
    return _union(seen).filter("depth > 0")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def both_ways(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Upstream and downstream, each node once per seed at its smaller depth."""
    up, down = closure(edges, seeds, "up", max_depth), closure(edges, seeds, "down", max_depth)
    return up.unionByName(down).groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def roots(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes nothing points to. With a node table, isolated nodes count and external ones do not."""
    base = node_ids(edges) if nodes is None else nodes.filter(F.col("type") != "external").select(F.col("id").alias("node"))
    return base.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def terminals(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return roots(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among `ids` (column `node`)."""
    keep = ids.select("node").distinct()
    return edges.join(keep, F.col("src") == F.col("node"), "left_semi").join(keep, F.col("dst") == F.col("node"), "left_semi")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within `hops` of the seeds, direction ignored, and the edges among them."""
    near = closure(edges, seeds, "both", hops).select("node").union(seeds.select(F.col("seed").alias("node"))).distinct()
    near = cut(near, "near")
    return near, induced(edges, near)


def shortest_path(edges: DataFrame, source, target, max_depth: int | None = None) -> DataFrame:
    """`(position, node)` of one shortest path; among equals the one whose parents have the smallest ids. Empty when there is none."""
    spark = edges.sparkSession
    e = cut(_directed(edges, "down"), "edges")
    kind = e.schema["src"].dataType
    start = spark.range(1).select(F.lit(source).cast(kind).alias("node")).select("node", F.array("node").alias("path"))
    frontier, depth = cut(start, "frontier"), 0
    seen = [frontier]
    while frontier.filter(F.col("node") == F.lit(target)).isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        step = frontier.join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.struct(F.col("src"), F.col("path"))).alias("p"))
        step = step.select(F.col("dst").alias("node"), F.array_append("p.path", F.col("dst")).alias("path"))
        step = step.join(_union([f.select("node") for f in seen]), "node", "left_anti")
        frontier, rows = cut_counted(step, "frontier")
        if rows == 0:
            break
        seen.append(frontier)
    return frontier.filter(F.col("node") == F.lit(target)).select(F.posexplode("path").alias("position", "node"))


def simple_paths(edges: DataFrame, source, target, max_depth: int | None = None) -> DataFrame:
    """Every path without a repeated node: `(path, depth)`, depth in nodes.

    Only nodes that lie on some way from source to target take part, so no dead end is ever extended.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    one = lambda v: spark.range(1).select(F.lit(v).cast(kind).alias("seed"))
    ahead = closure(edges, one(source), "down", max_depth).select("node").union(one(source)).distinct()
    behind = closure(edges, one(target), "up", max_depth).select("node").union(one(target)).distinct()
    useful = cut(induced(edges.select("src", "dst").distinct(), ahead.intersect(behind)), "useful")
    open_ = cut(one(source).select(F.array("seed").alias("path")), "paths")
    done, depth = [open_.filter(F.element_at("path", -1) == F.lit(target))], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        last = open_.filter(F.element_at("path", -1) != F.lit(target)).withColumn("_at", F.element_at("path", -1))
        step = last.join(useful, F.col("_at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        open_, rows = cut_counted(step.select(F.array_append("path", F.col("dst")).alias("path")), "paths")
        if rows == 0:
            break
        done.append(open_.filter(F.element_at("path", -1) == F.lit(target)))
    return _union(done).select("path", F.size("path").alias("depth"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """`(node, component)`: connected components of the undirected graph, named by their smallest node.

    Large-star and small-star rounds: the number of rounds grows with the logarithm of the size, not with the diameter.
    """
    pairs = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    pairs = cut(pairs, "pairs")
    everyone = node_ids(edges) if nodes is None else nodes.select(F.col("id").alias("node")).union(node_ids(edges)).distinct()
    while True:
        sym = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "pairs")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        small = cut(small.select("p.u", "p.v").filter("u <> v").distinct(), "pairs")
        unchanged = pairs.exceptAll(small).isEmpty() and small.exceptAll(pairs).isEmpty()
        pairs = small
        if unchanged:
            break
    return everyone.join(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_c")), "node", "left").select("node", F.coalesce("_c", "node").alias("component"))


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges at nodes without a way in or a way out, until none is left: such nodes are in no cycle."""
    e, size = cut_counted(edges.filter("src <> dst").select("src", "dst").distinct(), "core")
    while True:
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept, left = cut_counted(kept, "core")
        if left == size or left == 0:
            return kept
        e, size = kept, left


def _apart(edges: DataFrame, most: int, salt: int) -> DataFrame:
    """Nodes no two of which are neighbours and each of which has `most` ways through it or fewer, those of the fewest first: `(node)`."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out")).union(edges.select("dst", F.lit(0)))
    fill = ends.groupBy("node").agg((F.sum("out") * (F.count("*") - F.sum("out"))).alias("fill")).filter(F.col("fill") <= most)
    free = cut(fill.select("node", F.struct("fill", F.xxhash64("node", F.lit(salt)).alias("h"), "node").alias("rank")), "free")
    both = edges.join(free.select(F.col("node").alias("src"), F.col("rank").alias("_a")), "src").join(free.select(F.col("node").alias("dst"), F.col("rank").alias("_b")), "dst")
    later = both.select(F.when(F.col("_a") < F.col("_b"), F.col("dst")).otherwise(F.col("src")).alias("node"))
    return free.join(later, "node", "left_anti").select("node")


def _contract(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Take nodes out and join the ends of their edges, so that long ways become short: the edges left, and a table `(gone, node, out)` of the edges taken out in each round.

    A round takes nodes no two of which are neighbours, those of the fewest new edges first. It stops when only nodes of many edges are left, or when new edges have doubled the graph.
    """
    e, first = cut_counted(edges.filter("src <> dst").select("src", "dst").distinct(), "core")
    steps, left = [], first
    while 0 < left <= 2 * first:
        gone = _apart(e, _FILL, len(steps))
        into = e.join(gone, F.col("dst") == F.col("node"), "left_semi").select(F.col("dst").alias("gone"), F.col("src").alias("node"), F.lit(0).alias("out"))
        away = e.join(gone, F.col("src") == F.col("node"), "left_semi").select(F.col("src").alias("gone"), F.col("dst").alias("node"), F.lit(1).alias("out"))
        step, rows = cut_counted(into.union(away), "gone")
        if rows == 0:
            break
        steps.append(step)
        taken = step.select(F.col("gone").alias("src"), F.col("node").alias("dst"), "out")
        rest = e.join(taken.filter("out = 1"), ["src", "dst"], "left_anti").join(taken.filter("out = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
        joined = step.filter("out = 0").select("gone", F.col("node").alias("src")).join(step.filter("out = 1").select("gone", F.col("node").alias("dst")), "gone").select("src", "dst").filter("src <> dst")
        e, left = cut_counted(rest.select("src", "dst").union(joined).distinct(), "core")
    return e, steps


def strong_components(edges: DataFrame) -> DataFrame:
    """`(node, component)` of strongly connected components with more than one node.

    Contract, then trim what is left, spread the largest id forward until it settles, and walk back from each settled root inside its colour.
    Last, contracted nodes come back: a node is in a component when an edge into it and one out of it end there.
    """
    core, steps = _contract(edges)
    core, found = _trim(core), []
    while not core.isEmpty():
        colour = cut(node_ids(core).select("node", F.col("node").alias("colour")), "colour")
        while True:
            got = core.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("c"))
            new = colour.join(got, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") > F.col("colour")).alias("moved"))
            new = cut(new, "colour")
            settled = new.filter("moved").isEmpty()
            colour = new.select("node", "colour")
            if settled:
                break
        inside = (core.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst")
                  .filter("_a = _b").select("src", "dst"))
        root_seeds = colour.filter("node = colour").select(F.col("node").alias("seed"))
        members = closure(inside, root_seeds, "up").select("node", F.col("seed").alias("component"))
        members = cut(members.union(root_seeds.select(F.col("seed").alias("node"), F.col("seed").alias("component"))), "scc")
        real = members.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
        found.append(members.join(real, "component", "left_semi").select("node", "component"))
        rest = core.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        core = _trim(rest.select("src", "dst"))
    labels = _union(found) if found else node_ids(edges).limit(0).select("node", F.col("node").alias("component"))
    for step in reversed(steps):
        ends = step.join(labels, "node", "left").select("gone", "out", F.coalesce("component", "node").alias("component"))
        back = ends.groupBy("gone", "component").agg(F.max("out").alias("_o"), F.min("out").alias("_i")).filter("_o = 1 and _i = 0")
        back, rows = cut_counted(back.select(F.col("gone").alias("node"), "component"), "back")
        if rows:
            labels = cut(labels.union(back).union(back.select("component", "component")).distinct(), "labels")
    return labels


def cycle_members(edges: DataFrame) -> DataFrame:
    """`(group_id, node)`: strong components by their smallest node, and self-loops outside them."""
    scc = cut(strong_components(edges), "scc")
    named = scc.groupBy("component").agg(F.min("node").alias("group_id"))
    big = scc.join(named, "component").select("group_id", "node")
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().join(big.select("node"), "node", "left_anti")
    return big.unionByName(loops.select(F.col("node").alias("group_id"), "node"))


def cycle_groups(edges: DataFrame) -> DataFrame:
    """The rows of `cycle_members` with the size of their group: `(group_id, node, members)`. No group is gathered into one row, whatever its size."""
    rows = cut(cycle_members(edges), "members")
    return rows.join(rows.groupBy("group_id").agg(F.count("*").alias("members")), "group_id").select("group_id", "node", "members")


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ways `(src, dst, way)` continued by those that begin where they end, without a repeated node; `src = dst` closes a cycle. `way` holds the nodes before `dst`."""
    onward = right.select(F.col("src").alias("_via"), F.col("dst").alias("_to"), F.col("way").alias("_on"))
    both = left.join(onward, F.col("dst") == F.col("_via")).filter(~F.arrays_overlap("way", "_on"))
    both = both.filter((F.col("_to") == F.col("src")) | ~F.array_contains("way", F.col("_to")))
    return both.select("src", F.col("_to").alias("dst"), F.concat("way", "_on").alias("way"))


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """Every simple cycle once, starting at its smallest node: `(cycle, length)`. Paths never leave their strong component.

    Nodes of few ways are taken out, many at a time, and the ways through them joined; then ways are walked over the nodes left, from the smallest of each cycle.
    A walk in single steps would mostly end where its own nodes bar the way back.
    """
    scc = cut(strong_components(edges), "scc")
    a = scc.select(F.col("node").alias("src"), F.col("component").alias("_a"))
    b = scc.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    inner = edges.filter("src <> dst").select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("_a = _b")
    fits = F.lit(True) if max_length is None else F.size("way") + F.when(F.col("src") == F.col("dst"), 0).otherwise(1) <= max_length
    ways = cut(inner.select("src", "dst", F.array("src").alias("way")).filter(fits), "ways")
    done, rounds = [edges.filter("src = dst").select(F.array("src").alias("way")).distinct()], 0
    while True:
        gone, rows = cut_counted(_apart(ways.select("src", "dst"), _WAYS, rounds), "gone")
        if rows == 0:
            break
        into = ways.join(gone, F.col("dst") == F.col("node"), "left_semi")
        away = ways.join(gone, F.col("src") == F.col("node"), "left_semi")
        rest = ways.join(gone, F.col("dst") == F.col("node"), "left_anti").join(gone, F.col("src") == F.col("node"), "left_anti")
        step = cut(rest.union(_joined(into, away).filter(fits)), "ways")
        done.append(step.filter("src = dst").select("way"))
        ways, rounds = step.filter("src <> dst"), rounds + 1
    open_ = ways.filter("src < dst")
    while not open_.isEmpty():
        step = cut(_joined(open_, ways).filter("dst >= src").filter(fits).repartition("way"), "ways")
        done.append(step.filter("src = dst").select("way"))
        open_ = step.filter("src < dst")
    first = F.array_position("way", F.array_min("way")).cast("int")
    return _union(done).select(F.slice(F.concat("way", "way"), first, F.size("way")).alias("cycle")).select("cycle", F.size("cycle").alias("length"))


def levels(edges: DataFrame, acyclic: bool = False) -> DataFrame:
    """`(node, level)`: longest path from a source. Members of a cycle share the level of their condensed node."""
    e, label = edges.select("src", "dst").distinct(), None
    if not acyclic:
        label = cut(strong_components(edges), "scc")
        named = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        e = e.join(named("src"), "src", "left").join(named("dst"), "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).filter("src <> dst").distinct()
    e = cut(e, "edges")
    frontier = cut(node_ids(edges).join(e.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("level")), "level")
    if label is not None:
        heads = node_ids(edges).join(label, "node", "left").select(F.coalesce("component", "node").alias("node")).distinct()
        frontier = cut(heads.join(e.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("level")), "level")
    reached, level = [frontier], 0
    while True:
        level += 1
        frontier, rows = cut_counted(frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("level", F.lit(level)), "level")
        if rows == 0:
            break
        reached.append(frontier)
        if len(reached) > _COMPACT:
            reached = [cut(_union(reached).groupBy("node").agg(F.max("level").alias("level")), "level")]
    top = _union(reached).groupBy("node").agg(F.max("level").alias("level"))
    if label is None:
        return top
    return node_ids(edges).join(label, "node", "left").select("node", F.coalesce("component", "node").alias("_h")).join(top.select(F.col("node").alias("_h"), "level"), "_h").select("node", "level")


def strength(total: Column) -> Column:
    return F.when(total == 0, "none").when(total < 3, "low").when(total < 10, "medium").otherwise("high")


def connection_counts(edges: DataFrame, nodes: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """Distinct tables, views and CTEs up and down within a depth, for every table, view and CTE."""
    shown = nodes.filter(F.col("type").isin("table", "view", "cte")).select("id")
    seeds = shown.select(F.col("id").alias("seed"))
    def count(direction: str, name: str) -> DataFrame:
        near = closure(edges, seeds, direction, max_depth, nodes, exclude_external=True)
        near = near.join(shown, near.node == shown.id, "left_semi")
        return near.groupBy(F.col("seed").alias("id")).agg(F.count("*").alias(name))
    out = shown.join(count("up", "upstream"), "id", "left").join(count("down", "downstream"), "id", "left").fillna(0, ["upstream", "downstream"])
    return out.withColumn("total", F.col("upstream") + F.col("downstream")).withColumn("strength", strength(F.col("total")))


# --- node filters ----------------------------------------------------------------------------------------------

def filter_by_type(nodes: DataFrame, types: list[str]) -> DataFrame:
    return nodes.filter(F.col("type").isin(types))


def filter_by_search(nodes: DataFrame, query: str, case_sensitive: bool = False, regex: bool = False, metadata: bool = False) -> DataFrame:
    """Nodes whose name (or, on request, metadata) contains the text or matches the pattern."""
    def hit(col: Column) -> Column:
        if regex:
            return col.rlike(query if case_sensitive else "(?i)" + query)
        return col.contains(query) if case_sensitive else F.lower(col).contains(query.lower())
    found = hit(F.col("name"))
    if metadata:
        found = found | hit(F.to_json(F.col("metadata")))
    return nodes.filter(found)


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return induced(edges, nodes.select(F.col("id").alias("node")))


def search_names(nodes: DataFrame, query: str, types: list[str] | None = None, limit: int = 15) -> DataFrame:
    """Ranked name search: exact first, then by name; the report lists the first fifteen."""
    name = F.lower("name")
    hits = nodes.filter(name.contains(query.lower()) & (F.col("type").isin(types) if types else F.lit(True)))
    return hits.orderBy(F.when(name == query.lower(), 0).otherwise(1), name, "name", "id").limit(limit).select("id", "type", "name")
