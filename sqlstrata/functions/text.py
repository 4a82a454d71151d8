"""Column expressions over SQL text. Everything here runs inside the JVM, one row at a time.

Alternations inside a repetition are possessive, so long texts neither backtrack nor overflow the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SINGLE = r"'(?:[^']|'')*+(?:'|\z)"
SINGLE_ESC = r"'(?:[^'\\]|\\[\s\S]|'')*+(?:'|\z)"
DOUBLE = r'"[^"]*+(?:"|\z)'
DOUBLE_ESC = r'"(?:[^"\\]|\\[\s\S]|"")*+(?:"|\z)'
BACKTICK = r"`[^`]*+(?:`|\z)"
BLANKS = " \t\n\x0b\f\r"  # the characters of \\s


def _block_comment(nesting: int) -> str:
    inner = r"[^*/]|\*(?!/)|/(?!\*)"
    body = rf"/\*(?:{inner})*+(?:\*/|\z)"
    for _ in range(nesting):
        body = rf"/\*(?:{inner}|{body})*+(?:\*/|\z)"
    return body


BLOCK = _block_comment(12)
COMMENT = rf"(?:{BLOCK}|--[^\n\r]*+|#(?![A-Za-z0-9_])[^\n\r]*+)"
NOT_COMMENT = rf"""(?:[^'"`\-/#]++|{SINGLE}|{DOUBLE}|{BACKTICK}|-(?!-)|/(?!\*)|#(?=[A-Za-z0-9_]))"""


def balanced(depth: int = 24) -> str:
    """Text whose parentheses close, nested up to `depth` levels."""
    body = r"[^()]*+"
    for _ in range(depth):
        body = rf"(?:[^()]++|\({body}\))*+"
    return body


BALANCED = balanced()
TOP_LEVEL_PART = rf"(?:[^,()]++|\({BALANCED}\)|[()])++"


def rx(col: Column, pattern: str, group: int = 0) -> Column:
    """First match, or the empty string."""
    return F.regexp_extract(col, pattern, group)


def rx_or_null(col: Column, pattern: str, group: int = 0) -> Column:
    got = F.regexp_extract(col, pattern, group)
    return F.when(got != "", got)


def rx_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def rx_count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def strip_blanks(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def strip_comments(sql: Column) -> Column:
    """Each comment becomes one blank; quoted text stays. `\\G` keeps the scan from entering a literal. A text without the marks of a comment is not scanned."""
    return F.when(sql.contains("--") | sql.contains("/*") | sql.contains("#"), F.regexp_replace(sql, rf"\G({NOT_COMMENT}*+){COMMENT}", "$1 ")).otherwise(sql)


def mask_literals(sql: Column) -> Column:
    """String contents removed, so later patterns cannot match inside them."""
    return F.when(sql.contains("'"), F.regexp_replace(sql, SINGLE, "''")).otherwise(sql)


def strip_leading_comments(sql: Column) -> Column:
    lead = rf"^(?:\s++|--[^\n]*+(?:\n|\z)|/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)|#(?![A-Za-z0-9_])[^\n]*+(?:\n|\z))*+"
    return F.regexp_replace(F.regexp_replace(sql, lead, ""), r"\s+\z", "")


def leading_keyword(clean: Column) -> Column:
    return F.upper(rx(clean, r"^\s*(\w+)", 1))


def newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))


def line_at(sql: Column, position: Column) -> Column:
    """1-based line of a 1-based character position; line 1 when the position is 0."""
    return F.when(position < 1, F.lit(1)).otherwise(
        newlines(F.substring(sql, F.lit(1), F.greatest(position - 1, F.lit(0)))) + 1)


def hold(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row.

    Without it the optimizer copies a column into the one place that uses it, and inside an array function that place
    runs once per element. A one-element explode is the barrier; it is pipelined and moves no data.
    """
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def with_prefix_sums(df: DataFrame, values: str) -> tuple[DataFrame, Column]:
    """The frame with a helper column, and the exclusive prefix sums of an int array.

    Blocks of sqrt(n) are summed first, so a long array costs n * sqrt(n), never n * n.
    """
    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0), lambda acc, x: acc + x)
    size = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("starts"))
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor(F.size(values) / size).cast("int")), start, lambda acc, k: F.struct(
        (acc["sum"] + total(F.slice(values, k * size + 1, size))).alias("sum"), F.array_append(acc["starts"], acc["sum"]).alias("starts")))
    df = hold(df, _starts=blocks["starts"], _size=size)
    at = lambda i: F.floor(i / F.col("_size")).cast("int")
    return df, F.transform(values, lambda _, i: F.get("_starts", at(i)) + total(F.slice(values, at(i) * F.col("_size") + 1, F.pmod(i, F.col("_size")))))


# --- templates -------------------------------------------------------------------------------------------------

QUOTED_NAME = r"""['"]([^'"]+)['"]"""


def has_template(sql: Column) -> Column:
    return strip_comments(sql).rlike(r"\{\{|\{%|\{#")


def prune_template_blocks(sql: Column) -> Column:
    """Keep the `if` branch, drop `elif` / `else` branches and `macro` bodies, at any nesting.

    One fold over tags and the text between them: `level` counts open blocks, `off` is the level whose branch is being dropped (0: none).
    """
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("off"), F.lit("").alias("text"))

    def step(s: Column, t: Column) -> Column:
        tag = F.lower(F.regexp_extract(t, r"^\{%[-+]?\s*(\w+)", 1))
        level = s["level"] + tag.isin("if", "macro").cast("int")
        stays = s["off"] != 0
        off = (F.when(tag == "macro", F.when(stays, s["off"]).otherwise(level)).when(tag.isin("else", "elif") & (s["level"] > 0), F.when(stays, s["off"]).otherwise(s["level"]))
               .when(tag.isin("endif", "endmacro") & (s["off"] == s["level"]), 0).otherwise(s["off"]))
        shut = F.greatest(F.lit(0), level - tag.isin("endif", "endmacro").cast("int"))
        return F.struct(shut.alias("level"), off.alias("off"), F.when(~t.startswith("{%") & ~stays, F.concat(s["text"], t)).otherwise(s["text"]).alias("text"))
    tokens = rx_all(sql, r"\{%[\s\S]*?%\}|(?:(?!\{%)[\s\S])++|\{")
    return F.when(sql.contains("{%"), F.aggregate(tokens, start, step)["text"]).otherwise(sql)


def normalise_template(sql: Column) -> Column:
    """Template expressions become plain identifiers; template comments and block tags go."""
    out = F.regexp_replace(sql, r"\{#[\s\S]*?#\}", "")
    out = prune_template_blocks(out)
    opened, closed = r"\{\{-?\s*", r"\s*-?\}\}"
    out = F.regexp_replace(out, rf"(?i){opened}ref\s*\(\s*{QUOTED_NAME}\s*\){closed}", "$1")
    out = F.regexp_replace(out, rf"(?i){opened}source\s*\(\s*{QUOTED_NAME}\s*,\s*{QUOTED_NAME}\s*\){closed}", "$1.$2")
    out = F.regexp_replace(out, rf"(?i){opened}config\s*\([\s\S]*?\){closed}", "")
    out = F.regexp_replace(out, rf"(?i){opened}this{closed}", "__dbt_this")
    out = F.regexp_replace(out, rf"(?i){opened}var\s*\(\s*['\"](\w+)['\"](?:\s*,[^}}]*)?\){closed}", "__dbt_var_$1__")
    out = F.regexp_replace(out, rf"{opened}(\w+){closed}", "$1")
    return F.regexp_replace(out, r"\{\{[\s\S]*?\}\}", "__dbt_expr")


# --- identifiers -----------------------------------------------------------------------------------------------

def normalise_identifier(col: Column) -> Column:
    """Trimmed and lower-cased; null when nothing is left."""
    return F.nullif(F.lower(F.trim(col)), F.lit(""))


def qualified_key(name: Column, schema: Column) -> Column:
    return F.concat_ws(".", normalise_identifier(schema), F.coalesce(normalise_identifier(name), F.lit("")))


def display_name(name: Column, schema: Column) -> Column:
    return F.concat_ws(".", F.nullif(schema, F.lit("")), name)


# A name of any number of parts, each quoted or not, blanks inside quotes too: group 1 the qualifier with its dots and quotes, group 2 the last part.
TABLE_NAME = r"""((?:(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|'\w+'|\w[\w$]*+)\.)*+)["'`\[]?((?<=["`\[])[^"`\[\]\n]+(?=["`\]])|\w+)["'`\]]?"""
QUOTES = r"""["'`\[\]]"""


def qualifier(text: Column) -> Column:
    """The first group of TABLE_NAME without quotes and its last dot; null where there is none."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, QUOTES, ""), r"\.$", ""), F.lit(""))


def key_schema(key: Column) -> Column:
    return F.when(key.contains("."), F.regexp_replace(key, r"\.[^.]*$", ""))


def key_name(key: Column) -> Column:
    return F.regexp_replace(key, r"^.*\.", "")


# --- structure -------------------------------------------------------------------------------------------------

def outer_text(masked: Column) -> Column:
    """The statement with every parenthesised query replaced by `(subq)`."""
    return F.regexp_replace(masked, rf"(?i)\(\s*(?:SELECT|WITH)\b{BALANCED}\)", "(subq)")


_CLAUSE_END = (r"\b(?:WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|UNION|INTERSECT|EXCEPT|MINUS|QUALIFY|WINDOW|RETURNING"
               r"|ON\s+CONFLICT|WHEN|FETCH|CONNECT\s+BY|START\s+WITH)\b")
_CLAUSE_START = {
    "where": r"\bWHERE\b", "group": r"\bGROUP\s+BY\b", "having": r"\bHAVING\b", "order": r"\bORDER\s+BY\b",
}


def clause(outer: Column, name: str) -> Column:
    """Text of the first such clause at the outer level; the empty string when there is none.

    An ORDER BY inside a window specification is in parentheses, hence not at the outer level.
    """
    start = _CLAUSE_START[name]
    return F.trim(rx(outer, rf"(?i)^(?:\({BALANCED}\)|(?!{start})[^()])*+{start}((?:\({BALANCED}\)|(?!{_CLAUSE_END})[^();])*+)", 1))


def join_conditions(outer: Column) -> Column:
    """Text of every ON condition of a join."""
    end = rf"(?:{_CLAUSE_END}|\b(?:INNER|LEFT|RIGHT|FULL|CROSS|NATURAL|JOIN)\b|,)"
    return rx_all(outer, rf"(?i)\bJOIN\b(?:(?!\b(?:ON|JOIN|WHERE)\b)[\s\S])*+\bON\b((?:\({BALANCED}\)|(?!{end})[^()])*+)", 1)


def select_list(outer: Column) -> Column:
    stop = r"\b(?:FROM|INTO|UNION|INTERSECT|EXCEPT|WHERE)\b"
    return F.trim(rx(outer, rf"(?i)\bSELECT\s+(?:DISTINCT\s+|ALL\s+)?((?:\({BALANCED}\)|(?!{stop})[^()])*+)", 1))


def split_top_level(text: Column) -> Column:
    """Parts between commas that are outside parentheses, trimmed; blank parts dropped."""
    return F.filter(F.transform(rx_all(text, TOP_LEVEL_PART), lambda p: F.trim(p)), lambda p: p != "")


def subqueries(masked: Column) -> Column:
    """Every outermost parenthesised query with a FROM, without its parentheses."""
    found = rx_all(masked, rf"(?i)\(\s*(SELECT\b{BALANCED})\)", 1)
    return F.filter(F.transform(found, lambda q: F.trim(q)), lambda q: F.lower(q).contains("from"))


def _not_alias() -> str:
    from .patterns import NOT_AN_ALIAS
    return "|".join(NOT_AN_ALIAS)


def normalise_query(query: Column) -> Column:
    """Lower case, single blanks, table aliases removed: the text two equal subqueries share."""
    out = F.lower(F.regexp_replace(query, r"\s+", " "))
    return F.regexp_replace(out, rf"\b(from|join|,)\s+(\w+)\s+(?:as\s+)?(?!(?:{_not_alias()})\b)\w+\b", "$1 $2")


def fingerprint(sql: Column) -> Column:
    """Hash of the normalised statement."""
    return F.sha2(F.trim(normalise_query(strip_comments(sql))), 256)


def column_refs(text: Column) -> Column:
    """Qualified or plain column names in an expression: no functions, keywords, numbers."""
    words = (r"(?:and|or|not|in|is|null|like|between|exists|case|when|then|else|end|as|asc|desc|distinct|subq|select|from"
             r"|interval|true|false|over|partition|by|order|rows|range|cast|using|any|all|on|nulls|first|last|grouping|sets|rollup|cube"
             r"|preceding|following|current|row|unbounded)")
    text = F.regexp_replace(text, r"(?i)\b(?:year|quarter|month|week|day|hour|minute|second)\s+FROM\b", "")
    text = F.regexp_replace(text, r"(?i)\bAS\s+\w+(?:\s*\([^()]*\))?", "")  # a CAST's type is no column
    return rx_all(text, rf"(?i)(?<![\w.@:])(?!{words}\b)([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)\b(?!\s*[(.])", 1)
