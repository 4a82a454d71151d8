"""Micro graphs against brute force, and invariants."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sqlstrata.plans import graph as G

CHAIN = [(1, 2), (2, 3), (3, 4)]
DIAMOND = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)]
CYCLE = [(1, 2), (2, 1), (2, 3), (5, 5)]
MIXED = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8), (9, 1)]
GRAPHS = {"chain": CHAIN, "diamond": DIAMOND, "cycle": CYCLE, "mixed": MIXED}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def reach(edges, start, limit=None):
    depth, todo = {start: 0}, [start]
    for n in todo:
        for a, b in edges:
            if a == n and b not in depth and (limit is None or depth[n] < limit):
                depth[b] = depth[n] + 1
                todo.append(b)
    return {n: k for n, k in depth.items() if n != start}


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed long")


@pytest.mark.parametrize("name", GRAPHS)
def test_closure(spark, name):
    edges = GRAPHS[name]
    nodes = sorted({n for e in edges for n in e})
    got = {(r.seed, r.node): r.depth for r in G.closure(frame(spark, edges), seed(spark, *nodes)).collect()}
    assert got == {(s, n): k for s in nodes for n, k in reach(edges, s).items()}
    up = {(r.node, r.seed) for r in G.closure(frame(spark, edges), seed(spark, *nodes), "up").collect()}
    assert up == set(got)  # b is below a exactly when a is above b


def test_depth_limit_and_blocking(spark):
    e = frame(spark, DIAMOND)
    assert {r.node: r.depth for r in G.closure(e, seed(spark, 1), max_depth=2).collect()} == reach(DIAMOND, 1, 2)
    nodes = spark.createDataFrame([(1, "table"), (2, "external"), (3, "external"), (4, "table"), (5, "view")], "id long, type string")
    assert G.closure(e, seed(spark, 1), nodes=nodes, exclude_external=True).count() == 0
    assert G.clamp_depth(None) == 5 and G.clamp_depth(-1) is None and G.clamp_depth(99) == 20


def test_paths(spark):
    e = frame(spark, DIAMOND)
    assert sorted(tuple(r.path) for r in G.simple_paths(e, 1, 5).collect()) == [(1, 2, 4, 5), (1, 3, 4, 5)]
    assert [r.node for r in G.shortest_path(e, 1, 5).orderBy("position").collect()] == [1, 2, 4, 5]
    assert G.shortest_path(e, 5, 1).count() == 0


@pytest.mark.parametrize("name", GRAPHS)
def test_components_are_closures_without_direction(spark, name):
    edges = GRAPHS[name]
    both = edges + [(b, a) for a, b in edges]
    got = {r.node: r.component for r in G.components(frame(spark, edges)).collect()}
    assert got == {n: min([n, *reach(both, n)]) for e in edges for n in e}


def test_long_chain_is_one_component(spark):
    rows = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.components(rows).select("component").distinct().count() == 1


def test_cycles_and_groups(spark):
    e = frame(spark, MIXED)
    assert {(r.group_id, r.node, r.members) for r in G.cycle_groups(e).collect()} == {(1, 1, 3), (1, 2, 3), (1, 3, 3), (4, 4, 2), (4, 5, 2), (8, 8, 1)}
    assert sorted(tuple(r.cycle) for r in G.cycles(e).collect()) == [(1, 2, 3), (4, 5), (8,)]
    assert G.cycle_groups(frame(spark, CHAIN)).count() == 0


def test_all_cycles_of_a_full_graph(spark):
    full = [(a, b) for a, b in itertools.permutations(range(4), 2)]
    want = {p for k in (2, 3, 4) for c in itertools.combinations(range(4), k) for p in itertools.permutations(c) if p[0] == min(p)}
    assert {tuple(r.cycle) for r in G.cycles(frame(spark, full)).collect()} == want


def simple_cycles(edges):
    found, todo = set(), [(n,) for n in {a for a, _ in edges}]
    for way in todo:
        for a, b in edges:
            if a == way[-1] and b == way[0]:
                found.add(way)
            elif a == way[-1] and b > way[0] and b not in way:
                todo.append((*way, b))
    return found


@pytest.mark.parametrize("most", [-1, 6])
def test_cycles_equal_brute_force_however_many_nodes_are_taken_out(spark, monkeypatch, most):
    monkeypatch.setattr(G, "_WAYS", most)
    dice = random.Random(7)
    edges = sorted({(dice.randrange(9), dice.randrange(9)) for _ in range(26)} | {(20, 21), (21, 22), (22, 20), (8, 20), (30, 30)})
    want = simple_cycles(edges)
    assert len(want) > 30 and len({len(c) for c in want}) > 5
    e = frame(spark, edges)
    assert sorted((tuple(r.cycle), r.length) for r in G.cycles(e).collect()) == sorted((c, len(c)) for c in want)
    assert sorted(tuple(r.cycle) for r in G.cycles(e, 3).collect()) == sorted(c for c in want if len(c) <= 3)


def test_few_cycles_among_many_dead_ends_take_few_ways(spark, monkeypatch):
    """Steps of one up and down and of two up: 29 cycles of two or three nodes, but 35,856 ways that start at their smallest node, most of which can never turn back."""
    edges = [(i, j) for i in range(16) for j in (i - 1, i + 1, i + 2) if 0 <= j < 16]
    written = []
    for name in ("cut", "cut_counted"):
        monkeypatch.setattr(G, name, lambda df, label="step", f=getattr(G, name): written.append(f(df, label)) or written[-1])
    got = sorted(tuple(r.cycle) for r in G.cycles(frame(spark, edges)).collect())
    assert got == sorted([(i, i + 1) for i in range(15)] + [(i, i + 2, i + 1) for i in range(14)])
    tables = [t[0] if isinstance(t, tuple) else t for t in written]
    assert sum(t.count() for t in tables if any(f.dataType.typeName() == "array" for f in t.schema)) < 1500


def test_levels(spark):
    assert {r.node: r.level for r in G.levels(frame(spark, DIAMOND + [(1, 5)])).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    got = {r.node: r.level for r in G.levels(frame(spark, MIXED)).collect()}
    assert got[9] == 0 and got[1] == got[2] == got[3] == 1 and got[4] == got[5] == 2


def test_roots_terminals_neighbourhood(spark):
    e = frame(spark, DIAMOND)
    assert [r.node for r in G.roots(e).collect()] == [1] and [r.node for r in G.terminals(e).collect()] == [5]
    near, inside = G.neighbourhood(e, seed(spark, 5), 1)
    assert sorted(r.node for r in near.collect()) == [4, 5] and inside.count() == 1


def test_empty_graph(spark):
    e = frame(spark, [])
    assert G.closure(e, seed(spark, 1)).count() == 0 and G.components(e).count() == 0 and G.levels(e).count() == 0 and G.cycles(e).count() == 0


def test_components_of_long_ways_take_few_rounds(spark, monkeypatch):
    """A ring of 300 nodes with a way of 60 into it, one out of it, and a pair at the end of that."""
    ring = [(i, (i + 1) % 300) for i in range(300)]
    e = frame(spark, ring + [(i, i + 1) for i in range(1000, 1060)] + [(1060, 7), (9, 2000)] + [(i, i + 1) for i in range(2000, 2060)] + [(2060, 2059)])
    written = []
    for name in ("cut", "cut_counted"):
        monkeypatch.setattr(G, name, lambda df, label="step", f=getattr(G, name): written.append(label) or f(df, label))
    assert {(r.group_id, r.node, r.members) for r in G.cycle_groups(e).collect()} == {(0, i, 300) for i in range(300)} | {(2059, 2059, 2), (2059, 2060, 2)}
    assert len(written) < 150
