"""Operator graphs of statements: one graph per query scope, as arrays of nodes and edges inside a row.

A scope's graph holds its CTEs, then each branch's sources and its operators in their fixed order, then its set operations; so edges run from lower to higher
places, and longest ways and reached tables are folds over the arrays. Nothing is joined and nothing leaves the row until a result is listed.
A CTE is one node with an edge to each place that reads it, also to another CTE; derived tables and subqueries are nodes whose insides are the graphs of their own scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlstrata.functions import text as T
from sqlstrata.operators import items as I, refs as R, scopes as SC

_JOIN = r"(?i)\b((?:NATURAL\s+)?(?:(?:INNER|CROSS|(?:LEFT|RIGHT|FULL)(?:\s+OUTER)?)\s+)?JOIN)\b"
_AGGREGATE = r"(?i)\b(?:COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT|STRING_AGG|LISTAGG|ARRAY_AGG)\s*\("


def _squeezed(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"\s+", " "))


def _node(kind: Column | str, label: Column, scope: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), label.alias("label"), (F.lit(None).cast("int") if scope is None else scope).alias("inside"))


def _branch(text: Column, ctes: Column) -> Column:
    """(reads, inner, joins, chain, items) of one branch: what it reads, queries inside its clauses, joins, operators in order, output columns."""
    def tokens(of: Column, clause: str) -> Column:
        return F.transform(T.rx_all(of, SC._TOKEN, 1), lambda k: F.struct(k.cast("int").alias("scope"), F.lit(clause).alias("clause")))

    def read(s: Column) -> Column:
        token, cte = T.rx_or_null(s["key"], f"^{SC._TOKEN}$", 1).cast("int"), F.get(F.filter(ctes, lambda c: c["name"] == s["key"]), F.lit(0))["scope"]
        kind = F.when(token.isNotNull(), "subquery").when(cte.isNotNull(), "cte").otherwise("table")
        return F.struct(s["alias"].alias("alias"), kind.alias("kind"), F.when(token.isNotNull(), F.coalesce(F.nullif(s["alias"], s["key"]), F.lit("(subquery)"))).otherwise(s["key"]).alias("label"), F.coalesce(token, cte).alias("scope"))

    def parts(p: Column) -> Column:
        listed, where, group, having, order = (p[c] for c in ("listed", "where", "group", "having", "order"))
        flat = F.regexp_replace(listed, rf"\bOVER\s*\({T.BALANCED}\)", "OVER")
        called = F.regexp_replace(listed, rf"(?i)\b\w+\s*\({T.BALANCED}\)\s*OVER\b", "").rlike(_AGGREGATE)
        joins = F.transform(T.rx_all(text, _JOIN, 1), _squeezed)
        ops = F.filter(F.array(
            F.when(where != "", _node("filter", F.lit("WHERE"))), F.when(group != "", _node("aggregate", F.lit("GROUP BY"))), F.when(having != "", _node("filter", F.lit("HAVING"))),
            F.when(called & (group == ""), _node("aggregate", F.lit("AGGREGATE"))), F.when(flat.rlike(r"(?i)\bCASE\b"), _node("case", F.lit("CASE"))),
            F.when(listed.rlike(r"(?i)\bOVER\b"), _node("window", F.lit("WINDOW"))), F.when(listed != "", _node("select", F.lit("SELECT"))), F.when(order != "", _node("sort", F.lit("ORDER BY"))),
            F.when(text.rlike(r"(?i)\bLIMIT\s+\d+|\bTOP\s*\(?\s*\d+"), _node("limit", F.lit("LIMIT"))), F.when(listed != "", _node("result", F.lit("RESULT")))), lambda n: n.isNotNull())
        kept = F.filter(F.transform(SC.sources(text), read), lambda r: (r["kind"] != "table") | R.is_table_name(T.key_name(r["label"])))
        items = F.transform(F.transform(T.split_top_level(listed), SC._item), lambda i: F.struct(
            F.lower(F.regexp_replace(i["name"], SC._TOKEN, "(subquery)")).alias("name"), I.item_kind(i["expr"]).alias("kind"), T.rx_or_null(i["expr"], r"^(?:\w+\.)?(\w+)$", 1).alias("plain"),
            F.array_distinct(F.transform(F.filter(T.column_refs(i["expr"]), lambda r: ~r.rlike(SC._TOKEN)), lambda r: F.when(r.contains("."), F.lower(F.substring_index(r, ".", 1))).otherwise(""))).alias("aliases")))
        return F.struct(kept.alias("reads"), F.concat(tokens(listed, "SELECT"), tokens(where, "WHERE"), tokens(having, "HAVING"), tokens(group, "GROUP BY"), tokens(order, "ORDER BY")).alias("inner"),
                        F.size(joins).alias("joins"), F.concat(F.transform(joins, lambda j: _node("join", j)), ops).alias("chain"), items.alias("items"))
    clauses = F.struct(T.select_list(text).alias("listed"), *[T.clause(text, c).alias(c) for c in ("where", "group", "having", "order")])
    return SC.let(clauses, parts)


def _entry(i: Column, joins: Column) -> Column:
    """Operator that the i-th source enters: the first two sources the first join, each further one the next; sources without a join what follows the joins."""
    return F.when(i <= joins, F.greatest(i - 1, F.lit(0))).otherwise(joins)


def graphs(stmts: DataFrame) -> DataFrame:
    """`(doc_id, path, stmt_idx, scope, top, cte_depth, parts, nodes, edges)`, one row per scope.

    `nodes` are (kind, label, inside), where `inside` is the scope that a CTE or subquery node holds; `edges` are (src, dst, clause) between places in
    `nodes`. `cte_depth` counts the CTEs around a scope.
    """
    rows = T.hold(stmts.select(*SC.KEYS, "masked"), _t=SC.scope_texts(F.col("masked")))
    rows = T.hold(rows, ctes=SC.cte_scopes(F.col("_t")), top=F.size("_t") - 1, _parent=F.map_from_entries(F.flatten(F.transform("_t", lambda t, j: F.transform(F.array_distinct(T.rx_all(t, SC._TOKEN, 1)), lambda k: F.struct(k.cast("int"), j))))))
    is_cte = lambda k: F.exists("ctes", lambda c: c["scope"] == k).cast("int")
    depths = F.aggregate(F.sequence(F.col("top"), F.lit(0)), F.array().cast("array<int>"), lambda acc, k: F.array_append(acc, F.when(k == F.col("top"), 0).otherwise(
        F.coalesce(F.get(acc, F.col("top") - F.try_element_at("_parent", k)), F.lit(0)) + is_cte(k))))
    rows = T.hold(rows, _depth=depths)
    rows = rows.select(*SC.KEYS, "ctes", "top", "_depth", "_t", F.posexplode("_t").alias("scope", "text"))
    rows = T.hold(rows, _w=F.array_join(T.rx_all(F.col("text"), SC._WITH, 0), " "), _plain=F.regexp_replace("text", SC._WITH, " "))
    own = F.filter("ctes", lambda c: F.col("_w").contains(F.concat(F.lit("__q"), c["scope"].cast("string"), F.lit("__"))))
    # what each CTE's body reads, for edges between CTEs
    own = F.transform(own, lambda c: F.struct(c["name"].alias("name"), c["scope"].alias("scope"), F.transform(SC.sources(F.regexp_replace(F.get("_t", c["scope"]), SC._WITH, " ")), lambda s: s["key"]).alias("keys")))
    rows = T.hold(rows, _own=own, parts=F.transform(F.split("_plain", SC.SET_OP), lambda b: _branch(b, F.col("ctes"))), _ops=F.transform(T.rx_all(F.col("_plain"), SC.SET_OP, 0), _squeezed))
    names = F.transform("_own", lambda c: c["name"])
    is_own = lambda r: (r["kind"] == "cte") & F.array_contains(names, r["label"])
    placed = F.transform("parts", lambda p: F.concat(F.transform(F.filter(p["reads"], lambda r: ~is_own(r)), lambda r: _node(r["kind"], r["label"], r["scope"])),
                                                     F.transform(p["inner"], lambda k: _node("subquery", F.lit("(subquery)"), k["scope"])), p["chain"]))
    rows = T.hold(rows, _placed=placed, _names=names)
    starts = F.aggregate("_placed", F.struct(F.size("_own").alias("at"), F.array().cast("array<int>").alias("all")),
                         lambda a, b: F.struct((a["at"] + F.size(b)).alias("at"), F.array_append(a["all"], a["at"]).alias("all")))
    rows = T.hold(rows, _starts=starts)
    # set operations nest to the right: the last one comes first, the first one last
    unions = F.transform(F.reverse("_ops"), lambda o: _node("union", o))
    nodes = F.concat(F.transform("_own", lambda c: _node("cte", c["name"], c["scope"])), F.flatten("_placed"), unions)

    def edge(src: Column, dst: Column, clause: Column) -> Column:
        return F.struct(src.cast("int").alias("src"), dst.cast("int").alias("dst"), clause.alias("clause"))

    def of_branch(p: Column, b: Column) -> Column:
        start, placed_ = F.get(F.col("_starts")["all"], b), F.get("_placed", b)
        first = start + F.size(placed_) - F.size(p["chain"])
        outside = lambda k: F.size(F.filter(F.slice(p["reads"], 1, k), lambda r: ~F.array_contains("_names", r["label"]) | (r["kind"] != "cte")))
        into = F.transform(p["reads"], lambda r, i: F.when(_entry(i, p["joins"]) < F.size(p["chain"]), edge(
            F.when((r["kind"] == "cte") & F.array_contains("_names", r["label"]), F.array_position("_names", r["label"]) - 1).otherwise(start + outside(i)),
            first + _entry(i, p["joins"]), F.get(p["chain"], _entry(i, p["joins"]))["label"])))
        labels = F.transform(p["chain"], lambda c: c["label"])
        nested = F.transform(p["inner"], lambda k, i: F.when(F.array_contains(labels, k["clause"]), edge(first - F.size(p["inner"]) + i, first + F.array_position(labels, k["clause"]) - 1, k["clause"])))
        along = F.transform(p["chain"], lambda c, i: F.when(i > 0, edge(first + i - 1, first + i, c["label"])))
        return F.concat(into, nested, along)
    last = lambda b: F.get(F.col("_starts")["all"], b) + F.size(F.get("_placed", b)) - 1
    n, base = F.size("_ops"), F.col("_starts")["at"]
    joined = F.flatten(F.transform("_ops", lambda o, i: F.array(edge(last(i), base + n - 1 - i, o), edge(F.when(i == n - 1, last(n)).otherwise(base + n - 2 - i), base + n - 1 - i, o))))
    between = F.flatten(F.transform("_own", lambda c, i: F.transform(F.array_intersect(F.col("_names"), c["keys"]), lambda name: F.when(name != c["name"], edge(F.array_position("_names", name) - 1, i, F.lit("WITH"))))))
    edges = F.filter(F.concat(between, F.flatten(F.transform("parts", of_branch)), joined), lambda e: e.isNotNull() & (e["src"] < e["dst"]))
    rows = T.hold(rows, nodes=nodes, edges=edges)
    return rows.select(*SC.KEYS, "scope", "top", F.get("_depth", F.col("top") - F.col("scope")).alias("cte_depth"), "parts", "nodes", "edges")


def statement_graphs(stmts: DataFrame) -> DataFrame:
    """The graphs of whole statements, without those of nested scopes."""
    return graphs(stmts).filter("scope = top")


def longest_ways(nodes: Column, edges: Column) -> Column:
    """For each node the number of nodes on the longest way that ends there."""
    return F.aggregate(F.sequence(F.lit(0), F.size(nodes) - 1), F.array().cast("array<int>"), lambda acc, i: F.array_append(
        acc, F.aggregate(F.filter(edges, lambda e: e["dst"] == i), F.lit(0), lambda m, e: F.greatest(m, F.get(acc, e["src"]))) + 1))


def _fan_outs(edges: Column) -> Column:
    """(node, edges out) of each node with one, by runs of the sorted sources."""
    ends = F.sort_array(F.transform(edges, lambda e: e["src"]))
    first = F.filter(F.transform(ends, lambda s, i: F.when((i == 0) | (F.get(ends, i - 1) != s), F.struct(s.alias("node"), i.alias("at")))), lambda x: x.isNotNull())
    return SC.let(F.struct(first.alias("f"), F.size(ends).alias("n")), lambda x: F.transform(x["f"], lambda s, i: F.struct(s["node"].alias("node"), (F.coalesce(F.get(x["f"], i + 1)["at"], x["n"]) - s["at"]).alias("fan_out"))))


def shapes(stmts: DataFrame) -> DataFrame:
    """Per statement: nodes, tables, largest fan-out, nodes on the longest way, edges back from the result, nesting of CTEs, and whether it is complex.

    The nesting of CTEs needs all scopes of a statement: the only shuffle, of one number per scope, added up before it.
    """
    rows = T.hold(graphs(stmts), _ways=F.when(F.size("nodes") > 0, longest_ways(F.col("nodes"), F.col("edges"))).otherwise(F.array().cast("array<int>")), _out=_fan_outs(F.col("edges")))
    result = F.array_position(F.transform("nodes", lambda n: n["kind"]), "result").cast("int")
    depth = F.when(result > 0, F.get("_ways", result - 1) - 1).otherwise(0)
    tables = F.size(F.filter("nodes", lambda n: n["kind"] == "table"))
    whole = F.when(F.col("scope") == F.col("top"), F.struct(F.size("nodes").alias("nodes"), tables.alias("tables"), F.coalesce(F.array_max(F.transform("_out", lambda o: o["fan_out"])), F.lit(0)).alias("max_fan_out"),
                                                            F.coalesce(F.array_max("_ways"), F.lit(0)).alias("critical_path"), depth.alias("query_depth")))
    got = rows.groupBy(*SC.KEYS).agg(F.max(whole).alias("w"), F.max("cte_depth").alias("cte_depth"))
    return got.select(*SC.KEYS, "w.*", "cte_depth", ((F.col("w.nodes") >= 8) | (F.col("w.tables") >= 5) | (F.col("w.query_depth") >= 3)).alias("is_complex"))


def fan_outs(stmts: DataFrame) -> DataFrame:
    """Operators with three or more edges out, with the level from five on."""
    rows = T.hold(statement_graphs(stmts), _out=F.filter(_fan_outs(F.col("edges")), lambda o: o["fan_out"] >= 3))
    rows = rows.select(*SC.KEYS, "nodes", F.explode("_out").alias("o"))
    return rows.select(*SC.KEYS, F.col("o.node").alias("place"), F.get("nodes", F.col("o.node"))["kind"].alias("kind"), F.get("nodes", F.col("o.node"))["label"].alias("label"), F.col("o.fan_out").alias("fan_out"),
                       F.when(F.col("o.fan_out") >= 5, "high").otherwise("medium").alias("severity"))


def node_rows(stmts: DataFrame) -> DataFrame:
    """`(scope, place, kind, label, inside, fan_out)`: every operator of every scope, with the number of edges out of it."""
    rows = T.hold(graphs(stmts), _out=_fan_outs(F.col("edges")))
    rows = rows.select(*SC.KEYS, "scope", "top", "_out", F.posexplode("nodes").alias("place", "n"))
    out = F.coalesce(F.get(F.filter("_out", lambda o: o["node"] == F.col("place")), F.lit(0))["fan_out"], F.lit(0))
    return rows.select(*SC.KEYS, "scope", "top", "place", "n.kind", "n.label", "n.inside", out.alias("fan_out"))


def edge_rows(stmts: DataFrame) -> DataFrame:
    """`(scope, top, src, dst, src_label, dst_label, clause)`: every edge of every scope."""
    rows = graphs(stmts).select(*SC.KEYS, "scope", "top", "nodes", F.explode("edges").alias("e"))
    return rows.select(*SC.KEYS, "scope", "top", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), F.get("nodes", F.col("e.src"))["label"].alias("src_label"), F.get("nodes", F.col("e.dst"))["label"].alias("dst_label"), F.col("e.clause").alias("clause"))


def levels(stmts: DataFrame) -> DataFrame:
    """Complexity level of joins, aggregates and subqueries of a statement, and bottlenecks: fan-out of three, more than three joins or aggregates."""
    rows = statement_graphs(stmts)
    count = lambda kind: F.size(F.filter("nodes", lambda n: n["kind"] == kind))
    rows = T.hold(rows, _out=_fan_outs(F.col("edges")), _j=count("join"), _a=F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(F.filter(p["items"], lambda i: i["kind"] == "aggregate"))), _q=count("subquery"))
    rows = rows.select(*SC.KEYS, "_out", "_j", "_a", "_q", F.posexplode("nodes").alias("place", "n"))
    out = F.coalesce(F.get(F.filter("_out", lambda o: o["node"] == F.col("place")), F.lit(0))["fan_out"], F.lit(0))
    kind, j, a, q = F.col("n.kind"), F.col("_j"), F.col("_a"), F.col("_q")
    level = (F.when(kind == "join", F.when(j > 5, "high").when(j > 2, "medium").otherwise("low")).when(kind == "aggregate", F.when(a > 4, "high").when(a > 2, "medium").otherwise("low"))
             .when(kind == "subquery", F.when(q > 2, "high").otherwise("low")))
    heavy = (out >= 3) | ((kind == "join") & (j > 3)) | ((kind == "aggregate") & (a > 3))
    return rows.select(*SC.KEYS, "place", kind.alias("kind"), F.col("n.label").alias("label"), level.alias("complexity_level"), heavy.alias("is_bottleneck"))


def filter_tables(stmts: DataFrame) -> DataFrame:
    """`(scope, place, filter, table_name)`: tables met walking back from each filter operator, within its scope."""
    def reached(acc: Column, i: Column) -> Column:
        node = F.get("nodes", i)
        behind = F.array_distinct(F.flatten(F.transform(F.filter("edges", lambda e: e["dst"] == i), lambda e: F.get(acc, e["src"]))))
        return F.array_append(acc, F.when(node["kind"] == "table", F.array(node["label"])).otherwise(behind))
    rows = T.hold(graphs(stmts).filter("size(nodes) > 0"), _r=F.aggregate(F.sequence(F.lit(0), F.size("nodes") - 1), F.array().cast("array<array<string>>"), reached))
    rows = rows.select(*SC.KEYS, "scope", "_r", F.posexplode("nodes").alias("place", "n")).filter("n.kind = 'filter'")
    return rows.select(*SC.KEYS, "scope", "place", F.col("n.label").alias("filter"), F.explode(F.get("_r", F.col("place"))).alias("table_name"))


def column_ways(stmts: DataFrame) -> DataFrame:
    """`(branch, position, output_name, source, steps)`: each output column's way from each source it reads through the operators behind that source.

    Steps are (operator:what) with source, joined, passthrough, aggregated, calculated or renamed; a source enters at its own join.
    """
    rows = statement_graphs(stmts).select(*SC.KEYS, F.posexplode("parts").alias("branch", "p"))
    rows = rows.select(*SC.KEYS, "branch", "p", F.posexplode("p.items").alias("position", "i"))
    reads, alone = F.col("p.reads"), F.size("p.reads") == 1
    index = F.filter(F.transform(reads, lambda r, k: F.when(F.array_contains("i.aliases", r["alias"]) | (F.array_contains("i.aliases", "") & alone), k)), lambda k: k.isNotNull())
    rows = rows.select(*SC.KEYS, "branch", "position", "p", "i", F.explode(index).alias("_k"))
    kind = F.col("i.kind")
    last = F.when(kind == "direct", F.when(F.lower("i.plain") == F.col("i.name"), "passthrough").otherwise("renamed")).when(kind == "aggregate", "aggregated").otherwise("calculated")

    def step(op: Column) -> Column:
        what = (F.when(op["kind"] == "join", "joined").when(op["kind"] == "select", last).when((op["kind"] == "aggregate") & (kind == "aggregate"), "aggregated")
                .when((op["kind"] == "window") & (kind == "window") | (op["kind"] == "case") & (kind == "case"), "calculated").otherwise("passthrough"))
        return F.concat(op["label"], F.lit(":"), what)
    entry = _entry(F.col("_k"), F.col("p.joins"))
    source = F.get("p.reads", F.col("_k"))
    ops = F.slice("p.chain", entry + 1, F.greatest(F.size("p.chain") - entry, F.lit(0)))
    return rows.select(*SC.KEYS, "branch", "position", F.col("i.name").alias("output_name"), source["label"].alias("source"), F.concat(F.array(F.concat(source["label"], F.lit(":source"))), F.transform(ops, step)).alias("steps"))
