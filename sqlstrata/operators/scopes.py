"""Query scopes of a statement at any nesting, and where each scope's output columns come from.

A text is folded from the inside out: in each round every innermost parenthesised query becomes a scope of its own and leaves the name `__q<number>__`
behind, which reads like a table in FROM and like a column in an expression. So no pattern has to match nested queries, and nesting has no limit.
All of it is arrays inside the statement's row; the only shuffles are the joins that replace a nested scope's column by what that scope reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sqlstrata.functions import patterns as P, text as T
from sqlstrata.operators import definitions as D, items as I, refs as R
from sqlstrata.session import cut, cut_counted

KEYS = ["doc_id", "path", "stmt_idx"]
SET_OP = r"(?i)\b(?:UNION(?:\s+(?:ALL|DISTINCT))?|INTERSECT(?:\s+ALL)?|EXCEPT(?:\s+ALL)?|MINUS)\b"
_TOKEN = r"__q(\d+)__"
_OPEN, _CLOSE = "\uE000", "\uE001"  # parentheses of calls and groups, while queries are looked for
_STARTS = r"(?:SELECT|WITH)\b|__q\d+__\s*(?:UNION|INTERSECT|EXCEPT|MINUS)\b"
_GROUP = rf"(?i)\((?!\s*(?:{_STARTS}))([^()]*)\)"
_QUERY = rf"(?i)\((\s*(?:{_STARTS})[^()]*)\)"
_CTE = rf"([\w$]+)\s*(?:\(([^()]*)\)\s*)?AS\s+(?:(?:NOT\s+)?MATERIALIZED\s+)?{_TOKEN}"
_WITH = rf"(?i)\bWITH\s+(?:RECURSIVE\s+)?(?:{_CTE}\s*,?\s*)+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _round(state: Column, _: Column) -> Column:
    bare = rf"{_OPEN}\s*(__q\d+__)\s*{_CLOSE}"
    grouped = F.regexp_replace(F.regexp_replace(state["text"], _GROUP, f"{_OPEN}$1{_CLOSE}"), bare, " $1 ")

    def folded(text: Column) -> Column:
        found, base = T.rx_all(text, _QUERY, 1), F.size(state["found"])
        pieces = F.transform(F.split(text, _QUERY, -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(" __q"), (base + i - 1).cast("string"), F.lit("__ "), p)))
        return F.struct(F.array_join(pieces, "").alias("text"), F.concat(state["found"], found).alias("found"))
    return F.when(state["text"].contains("("), let(grouped, folded)).otherwise(state)


def nesting(text: Column) -> Column:
    """How deep parentheses nest."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("deepest"))

    def step(a: Column, x: Column) -> Column:
        now = a["now"] + F.when(x == "(", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["deepest"], now).alias("deepest"))
    return F.aggregate(T.rx_all(text, "[()]"), zero, step)["deepest"]


def scope_texts(masked: Column) -> Column:
    """Array of scope texts: nested queries in the order they close, the statement itself last."""
    start = F.struct(masked.alias("text"), F.array().cast("array<string>").alias("found"))
    done = F.aggregate(F.sequence(F.lit(0), nesting(masked)), start, _round)
    return F.transform(let(done, lambda d: F.concat(d["found"], F.array(d["text"]))), lambda t: F.translate(t, _OPEN + _CLOSE, "()"))


def outermost_queries(masked: Column) -> Column:
    """Texts of the queries in parentheses that lie in no other one, put together again from their scopes."""
    def whole(texts: Column) -> Column:
        top = F.size(texts) - 1

        def grown(text: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.greatest(top - 1, F.lit(0))), text, lambda t, i: F.replace(t, F.concat(F.lit(" __q"), (top - 1 - i).cast("string"), F.lit("__ ")), F.concat(F.lit("("), F.get(texts, top - 1 - i), F.lit(")"))))
        direct = T.rx_all(F.get(texts, top), _TOKEN, 1)
        return F.filter(F.transform(direct, lambda k: F.trim(grown(F.get(texts, k.cast("int"))))), lambda q: F.lower(q).contains("from"))
    return let(scope_texts(masked), whole)


def cte_scopes(texts: Column) -> Column:
    """Array of (name, scope, columns) of all CTEs in the statement's scopes."""
    with_parts = F.filter(F.transform(texts, lambda t: F.array_join(T.rx_all(t, _WITH, 0), " ")), lambda w: w != "")
    found = F.flatten(F.transform(with_parts, lambda w: T.rx_all(w, f"(?i){_CTE}", 0)))
    return F.transform(found, lambda c: F.struct(F.lower(T.rx(c, f"(?i){_CTE}", 1)).alias("name"), T.rx(c, f"(?i){_CTE}", 3).cast("int").alias("scope"),
                                                 T.split_top_level(T.rx(c, f"(?i){_CTE}", 2)).alias("columns")))


# --- sources and items of one branch ---------------------------------------------------------------------------

_PART = r"""(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[A-Za-z_][\w$]*+)"""
_NAME = rf"((?:{_PART}\.)*+{_PART})(?!\s*\()"
_ALIAS = rf"(?:\s+(?:AS\s+)?(?!(?:{'|'.join(P.NOT_AN_ALIAS)}|SET|USING|WHEN|SELECT|VALUES)\b)([A-Za-z_]\w*))?"
_SOURCE = rf"(?i)(?:\bFROM|\bJOIN|\bUSING|\bINTO|\bMERGE(?!\s+INTO\b)|\bUPDATE|,)\s+(?:ONLY\s+|LATERAL\s+)?{_NAME}{_ALIAS}"
_FROM_END = r"\b(?:WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|QUALIFY|WINDOW|RETURNING|ON\s+CONFLICT|WHEN|FETCH|CONNECT\s+BY|START\s+WITH|SET)\b"
_HEAD = (r"(?is)^\s*(?:INSERT\s+(?:OR\s+\w+\s+)?(?:INTO|OVERWRITE)(?:\s+INTO)?(?:\s+TABLE)?|REPLACE\s+INTO|MERGE(?:\s+INTO)?|UPDATE(?:\s+ONLY)?"
         r"|CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:TEMP|TEMPORARY|MATERIALIZED)\s+)?(?:TABLE|VIEW)(?:\s+IF\s+NOT\s+EXISTS)?)\s+")
_TARGET = rf"{_HEAD}{_NAME[:-len('(?!\\s*\\()')]}"


def key_of(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, T.QUOTES, ""))


def sources(text: Column) -> Column:
    """Array of (alias, key) of the tables a branch reads by FROM, JOIN, comma lists and USING, and those UPDATE and MERGE write."""
    text = R.without_function_from(text)
    area = F.concat_ws(" ", T.rx_or_null(text, rf"(?i)^\s*(?:UPDATE|MERGE)\b(?:(?!{_FROM_END})[\s\S])+"), T.rx_or_null(text, rf"(?i)\bFROM\b(?:(?!{_FROM_END})[\s\S])+"))
    calls = F.regexp_replace(area, rf"(?i)(?<![\s,(])(?<!\bFROM)(?<!\bJOIN)\s*+\({T.BALANCED}\)", "()")
    no_conditions = F.regexp_replace(calls, r"(?i)\bON\b(?:(?!\b(?:INNER|LEFT|RIGHT|FULL|CROSS|NATURAL|JOIN)\b|,)[\s\S])*+", " ")
    open_ = F.regexp_replace(no_conditions, r"(?<!\()[()](?!\))|(?<=\s)\((?=\w)", " ")
    pairs = F.transform(T.rx_all(open_, _SOURCE, 0), lambda m: F.struct(key_of(T.rx(m, _SOURCE, 1)).alias("key"), F.lower(T.rx(m, _SOURCE, 2)).alias("alias")))
    named = F.transform(pairs, lambda p: F.struct(F.when(p["alias"] == "", F.regexp_replace(p["key"], r"^.*\.", "")).otherwise(p["alias"]).alias("alias"), p["key"].alias("key")))
    return F.array_distinct(named)


_EXPLICIT = r"(?is)\s+AS\s+[\"`]?(\w+)[\"`]?\s*$"
_IMPLICIT = rf"(?is)^(?:[\w.]+|\w+\s*\({T.BALANCED}\)|__q\d+__)\s+(?!(?:END|NULL|ASC|DESC)\b)([A-Za-z_]\w*)\s*$"


def _item(text: Column) -> Column:
    """(name, expr) of one element of a select list."""
    alias = F.coalesce(T.rx_or_null(text, _EXPLICIT, 1), T.rx_or_null(text, _IMPLICIT, 1))
    expr = F.trim(F.when(text.rlike(_EXPLICIT), F.regexp_replace(text, _EXPLICIT, "")).when(text.rlike(_IMPLICIT), F.regexp_replace(text, r"\s+\w+\s*$", "")).otherwise(text))
    return let(expr, lambda e: F.struct(F.coalesce(alias, T.rx_or_null(e, r"^(?:[\w\"`]+\.)*[\"`]?(\w+|\*)[\"`]?$", 1), e).alias("name"), e.alias("expr")))


def _assignments(text: Column) -> Column:
    """(name, expr) of what UPDATE SET and the branches of MERGE write."""
    stop = r"\b(?:FROM|WHERE|WHEN|DELETE|RETURNING|ORDER\s+BY|LIMIT|OUTPUT)\b"
    sets = F.flatten(F.transform(T.rx_all(text, rf"(?i)\bSET\s+((?:\({T.BALANCED}\)|(?!{stop})[^()])+)", 1), T.split_top_level))
    parts = F.filter(F.transform(sets, lambda s: F.struct(F.trim(F.regexp_replace(F.substring_index(s, "=", 1), r"^[\s\S]*\.|[\"`\[\]]", "")).alias("name"), F.trim(F.regexp_replace(s, r"^[^=]*=", "")).alias("expr"))),
                     lambda p: p["name"].rlike(r"^\s*\w+\s*$"))
    insert = rf"(?i)\bINSERT\s*\(([^()]*)\)\s*VALUES\s*\(({T.BALANCED})\)"
    values = F.flatten(F.transform(T.rx_all(text, insert, 0), lambda m: F.zip_with(T.split_top_level(T.rx(m, insert, 1)), T.split_top_level(T.rx(m, insert, 2)), lambda n, e: F.struct(n.alias("name"), e.alias("expr")))))
    return F.filter(F.concat(parts, values), lambda p: p["name"].isNotNull() & p["expr"].isNotNull())


def branches(stmts: DataFrame) -> DataFrame:
    """`(scope, top, branch, text, ctes, first_names, columns, target, listed)`: a row per branch of each scope; the statement is scope `top`.

    `first_names` are the output names of the scope's first branch, `columns` those its CTE declares, `target` and `listed` the table and the columns it writes.
    """
    rows = T.hold(stmts.select(*KEYS, "masked"), _t=scope_texts(F.col("masked")))
    rows = T.hold(rows, ctes=cte_scopes(F.col("_t")))
    rows = rows.select(*KEYS, "ctes", (F.size("_t") - 1).alias("top"), F.posexplode("_t").alias("scope", "text"))
    plain = F.regexp_replace("text", _WITH, " ")
    # a whole query in parentheses behind CREATE or INSERT
    plain = F.when(plain.rlike(r"(?i)\bSELECT\b"), plain).otherwise(F.regexp_replace(plain, r"^(\s*(?:(?i:CREATE|INSERT|REPLACE)\b[\s\S]*?)?)(__q\d+__)\s*$", "$1 SELECT * FROM $2"))
    rows = T.hold(rows, text=plain)
    rows = T.hold(rows, _b=F.split("text", SET_OP))
    columns = F.get(F.filter("ctes", lambda c: c["scope"] == F.col("scope")), F.lit(0))["columns"]
    head = F.when(F.col("scope") == F.col("top"), F.col("text"))
    into = F.when(head.rlike(D._INTO), F.concat(T.rx(head, D._INTO, 2), T.rx(head, D._INTO, 3)))
    rows = T.hold(rows, first_names=F.transform(T.split_top_level(T.select_list(F.get("_b", F.lit(0)))), lambda i: _item(i)["name"]), columns=columns,
                  target=key_of(F.coalesce(T.rx_or_null(head, _TARGET, 1), into)),
                  listed=T.split_top_level(F.regexp_replace(T.rx(head, rf"{_TARGET}\s*\(([^()]*)\)\s*(?:AS\s+)?SELECT\b", 2), T.QUOTES, "")))
    return rows.select(*KEYS, "ctes", "top", "scope", "first_names", "columns", "target", "listed", F.posexplode("_b").alias("branch", "text"))


def scope_items(stmts: DataFrame) -> DataFrame:
    """`(scope, top, branch, position, name, expr, kind, sources, target, listed)`: output columns of every branch, also what UPDATE and MERGE assign.

    `sources` is an array of (alias, key, scope): a table by key or a nested scope (a CTE or a derived table) by number.
    """
    rows = branches(stmts)
    writes = (F.col("scope") == F.col("top")) & F.col("text").rlike(r"(?i)^\s*(?:UPDATE|MERGE)\b")
    rows = T.hold(rows, _i=F.when(writes, _assignments(F.col("text"))).otherwise(F.transform(T.split_top_level(T.select_list(F.col("text"))), _item)), _s=sources(F.col("text")))

    def placed(s: Column) -> Column:
        token, cte = T.rx_or_null(s["key"], f"^{_TOKEN}$", 1).cast("int"), F.get(F.filter("ctes", lambda c: c["name"] == s["key"]), F.lit(0))["scope"]
        return let(F.coalesce(token, cte), lambda k: F.struct(s["alias"].alias("alias"), F.when(k.isNull(), s["key"]).alias("key"), k.alias("scope")))
    rows = T.hold(rows, sources=F.filter(F.transform("_s", placed), lambda s: s["scope"].isNotNull() | R.is_table_name(T.key_name(s["key"]))))
    # an alias that UPDATE names is the table behind it
    target = F.coalesce(F.get(F.filter("sources", lambda s: (s["alias"] == F.col("target")) & s["key"].isNotNull() & (s["key"] != F.col("target"))), F.lit(0))["key"], F.col("target"))
    rows = rows.select(*KEYS, "scope", "top", "branch", "first_names", "columns", "sources", target.alias("target"), "listed", F.posexplode("_i").alias("position", "_i"))
    name = F.coalesce(F.get("columns", F.col("position")), F.when((F.col("branch") > 0) & (F.col("_i.name") != "*"), F.get("first_names", F.col("position"))), F.col("_i.name"))
    kind = F.when(F.col("_i.expr").rlike(f"^{_TOKEN}$"), "subquery").otherwise(I.item_kind(F.col("_i.expr")))
    return rows.select(*KEYS, "scope", "top", "branch", "position", F.lower(name).alias("name"), F.col("_i.expr").alias("expr"), kind.alias("kind"), "sources", "target", "listed")


def scope_inputs(stmts: DataFrame) -> DataFrame:
    """`(scope, top, position, name, kind, expr, target, listed, in_scope, table, column)`: one row per output column and what it reads directly.

    A column without a qualifier belongs to the only source there is; with several its table is null. `*` stands for all columns of a source.
    """
    rows = scope_items(stmts)
    sources_ = F.col("sources")

    def of(alias: Column) -> Column:
        return F.get(F.filter(sources_, lambda s: (s["alias"] == alias) | (s["key"] == alias)), F.lit(0))

    def read(ref: Column) -> Column:
        column = F.lower(F.regexp_replace(ref, r"^.*\.", ""))
        alias = F.lower(F.when(ref.contains("."), F.substring_index(ref, ".", 1)))
        one = let(F.when(alias.isNotNull(), of(alias)).otherwise(F.when(F.size(sources_) == 1, F.get(sources_, F.lit(0)))),
                  lambda s: F.array(F.struct(s["scope"].alias("in_scope"), s["key"].alias("table"), column.alias("column"))))
        every = F.transform(sources_, lambda s: F.struct(s["scope"].alias("in_scope"), s["key"].alias("table"), F.lit("*").alias("column")))
        nested = F.array(F.struct(T.rx(ref, _TOKEN, 1).cast("int").alias("in_scope"), F.lit(None).cast("string").alias("table"), F.lit("*").alias("column")))
        return F.when(ref == "*", every).when(ref.rlike(f"^{_TOKEN}$"), nested).otherwise(one)
    star = F.col("expr").rlike(r"^(?:\w+\.)?\*$")
    rows = T.hold(rows, _r=F.when(star, F.array("expr")).otherwise(F.array_distinct(T.column_refs(F.col("expr")))))
    rows = rows.select(*KEYS, "scope", "top", "position", F.when(star, "*").otherwise(F.col("name")).alias("name"), "kind", "expr", "target", "listed", F.explode(F.flatten(F.transform("_r", read))).alias("_in"))
    return rows.select(*KEYS, "scope", "top", "position", "name", "kind", "expr", "target", "listed", "_in.*")


_PLAIN = ("direct", "alias", "subquery")


def base_inputs(stmts: DataFrame) -> DataFrame:
    """`(position, name, kind, expr, target, listed, table, column)`: what each output column of a statement reads in the end, through CTEs, derived tables,
    scalar subqueries and all branches of set operations.

    Statements without nested queries are done at once. In the others every nested column's inputs are replaced by the inputs of those inputs, so the
    levels looked through double with each join on (statement, scope): 40 nested queries take six. What only leads back to itself, as in a
    recursive CTE, has no base input and falls out when the doubled length exceeds the columns there are.
    """
    keys = ["doc_id", "stmt_idx"]
    rows = cut(scope_inputs(stmts), "scope_inputs")
    front = rows.filter("scope = top").drop("scope", "top")
    nested, left = cut_counted(rows.filter("scope < top").select(*keys, "scope", "name", "kind", "in_scope", "table", "column"), "scope_nested")
    if not left:
        return _shown(front.drop("in_scope"))
    longest = nested.groupBy(*keys).count().agg(F.max("count")).first()[0]
    known, length = nested.filter("in_scope is null"), 1
    todo, left = cut_counted(nested.filter("in_scope is not null"), "scope_todo")
    while left and length < 2 * longest:
        met = cut(_through(todo, known.unionByName(todo)).distinct(), "scope_step")
        known = known.unionByName(met.filter("in_scope is null"))
        todo, left = cut_counted(met.filter("in_scope is not null and not (in_scope = scope and name = `column`)"), "scope_todo")
        length *= 2
    done = front.filter("in_scope is null").unionByName(_through(front.filter("in_scope is not null"), known))
    return _shown(done.drop("in_scope").distinct())


def _through(rows: DataFrame, nested: DataFrame) -> DataFrame:
    """Rows with what they read of a nested scope replaced by what that scope's columns read."""
    inner = nested.select("doc_id", "stmt_idx", F.col("scope").alias("in_scope"), F.col("name").alias("_n"), F.col("kind").alias("_k"), F.col("in_scope").alias("_s"), F.col("table").alias("_t"), F.col("column").alias("_c"))
    met = rows.join(inner, ["doc_id", "stmt_idx", "in_scope"]).filter((F.col("_n") == F.col("column")) | (F.col("column") == "*") | (F.col("_n") == "*"))
    new = {"name": F.when(F.col("name") == "*", F.col("_n")).otherwise(F.col("name")), "in_scope": F.col("_s"), "table": F.col("_t"),
           "kind": F.when(F.col("kind").isin(*_PLAIN), F.when(F.col("_k").isin("direct", "subquery"), F.col("kind")).otherwise(F.col("_k"))).otherwise(F.col("kind")),
           "column": F.when((F.col("_c") == "*") & (F.col("column") != "*"), F.col("column")).otherwise(F.col("_c"))}
    return met.select(*[new[c].alias(c) if c in new else c for c in rows.columns])


def _shown(done: DataFrame) -> DataFrame:
    renamed = F.when(F.col("kind").isin("direct", "alias"), F.when(F.col("name") == F.col("column"), "direct").otherwise("alias")).otherwise(F.col("kind"))
    shown = lambda c: F.regexp_replace(c, _TOKEN, "(subquery)")
    return done.select(*KEYS, "position", shown("name").alias("name"), renamed.alias("kind"), shown("expr").alias("expr"), "target", "listed", "table", "column")
