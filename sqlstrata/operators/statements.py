"""Statements of a corpus: split, classified, with dialect evidence. One projection per text, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sqlstrata.functions import patterns as P, text as T

_SPLIT_COMMENT = rf"(?:{T.BLOCK}|--[^\n]*+|//[^\n]*+|#(?![A-Za-z0-9_])[^\n]*+)"
_UNIT = (rf"""(?:[^;'"`\-/#$]++|{T.SINGLE_ESC}|{T.DOUBLE_ESC}|{T.BACKTICK}|{_SPLIT_COMMENT}"""
         r"""|\$(\w*+)\$(?:(?!\$\1\$)[\s\S])*+(?:\$\1\$|\z)|[\-/#$])""")
# A run up to a separator that is in no quotes and no comment: enough for texts without blocks.
STATEMENT = rf"(?i){_UNIT}*+(?:;|\z)"

# Texts whose separators depend on what is open around them: a parenthesis, a block, or another delimiter.
NEEDS_DEPTH = r"(?i)\bDELIMITER\s+\S|\([^)]*;|\bBEGIN\b"
_DELIMITER = r"(?im)^[ \t]*DELIMITER[ \t]+(\S+)[^\n]*"
# A block's BEGIN takes the blank behind it along, so that the BEGIN of a transaction is another token; END IF and its like are one token that closes nothing.
_OPENS = r"\bBEGIN\s++(?!;|\z|(?:TRANSACTION|WORK|TRAN)\b)"
_CLOSES = r"\bEND\s+(?:CASE|TRY|CATCH|IF|LOOP|WHILE|REPEAT|FOR)\b"
_TOKEN = (rf"""(?i:{T.SINGLE_ESC}|{T.DOUBLE_ESC}|{T.BACKTICK}|{_SPLIT_COMMENT}|\$(\w*+)\$(?:(?!\$\1\$)[\s\S])*+(?:\$\1\$|\z)"""
          rf"""|{_OPENS}|{_CLOSES}|\w++|[^\w'"`\-/#$();]++|[\s\S])""")


def _tokens(sql: Column) -> Column:
    """A text in quotes, comments, words, marks and runs of the rest; joined they are the text again. Its own delimiters come before all but the lines that set them."""
    line = _DELIMITER.replace("(\\S+)", "\\S+")
    stops = F.array_join(F.transform(F.array_distinct(T.rx_all(sql, _DELIMITER, 1)), lambda d: F.concat(F.lit("\\Q"), d, F.lit("\\E|"))), "")
    own = F.concat(F.lit(f"{line}|(?:"), stops, F.lit(f"(?!))|{_TOKEN}"))
    return F.regexp_extract_all(sql, F.when(sql.rlike(_DELIMITER), own).otherwise(F.lit(_TOKEN)), F.lit(0))


def _pieces_by_depth(sql: Column) -> Column:
    """Pieces of a text by one fold over its tokens: a separator counts where no parenthesis and no block is open. Nesting has no limit."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("parens"), F.lit(0).alias("blocks"), F.lit(";").alias("stop"), F.array().cast("array<struct<end:int,own:boolean>>").alias("cuts"))

    def step(s: Column, t: Column) -> Column:
        sets = t.rlike(_DELIMITER)
        parens = F.greatest(F.lit(0), s["parens"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0))
        word = F.length(t) < 1000
        blocks = F.greatest(F.lit(0), s["blocks"] + F.when(word & t.rlike(r"(?i)^(?:BEGIN\s+|CASE)$"), 1).when(word & t.rlike(r"(?i)^END(?:\s+(?:CASE|TRY|CATCH))?$"), -1).otherwise(0))
        ends = (t == s["stop"]) & (s["parens"] == 0) & ((s["blocks"] == 0) | (s["stop"] != ";"))
        zero = lambda x: F.when(ends | sets, 0).otherwise(x)
        return F.struct((s["at"] + 1).alias("at"), zero(parens).alias("parens"), zero(blocks).alias("blocks"), F.when(sets, F.regexp_extract(t, _DELIMITER, 1)).otherwise(s["stop"]).alias("stop"),
                        F.when(ends | sets, F.array_append(s["cuts"], F.struct((s["at"] + 1).alias("end"), (ends & (t != ";")).alias("own")))).otherwise(s["cuts"]).alias("cuts"))

    def cut(tokens: Column) -> Column:
        whole = F.concat(F.aggregate(tokens, start, step)["cuts"], F.array(F.struct(F.size(tokens).alias("end"), F.lit(False).alias("own"))))
        return F.get(F.transform(F.array(whole), lambda cuts: F.transform(cuts, lambda c, i: F.get(F.transform(F.array(F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))), lambda first: F.when(
            c["own"], F.concat(F.array_join(F.slice(tokens, first + 1, c["end"] - first - 1), ""), F.lit(";"))).otherwise(F.array_join(F.slice(tokens, first + 1, c["end"] - first), ""))), F.lit(0)))), F.lit(0))
    return F.get(F.transform(F.array(_tokens(sql)), cut), F.lit(0))


def pieces(sql: Column) -> Column:
    """All statements of a text with their separators; joined they are the text again, but for separators of its own, which become semicolons."""
    whole = ~sql.contains(";") & ~sql.rlike("(?i)DELIMITER")  # nothing to cut at
    return F.when(whole, F.array(sql)).when(sql.rlike(NEEDS_DEPTH), _pieces_by_depth(sql)).otherwise(T.rx_all(sql, STATEMENT))


def _without_separator(piece: Column) -> Column:
    text = T.strip_blanks(piece)
    return F.when(text.endswith(";"), F.rtrim(F.left(text, F.length(text) - 1), F.lit(T.BLANKS))).otherwise(text)


def statement_texts(sql: Column) -> Column:
    """Statements without separators; pieces that hold only comments or set a delimiter are dropped."""
    return F.filter(F.transform(pieces(sql), _without_separator), _says_something)


def _says_something(piece: Column) -> Column:
    return (piece.rlike(r"^\w") | (T.strip_leading_comments(piece) != "")) & ~piece.rlike(r"(?i)^\s*DELIMITER(?:[ \t]+\S+[^\n]*)?$")


def statement_count(sql: Column) -> Column:
    return F.size(statement_texts(sql))


def statements(corpus: DataFrame, templates: bool = True) -> DataFrame:
    """`(doc_id, path, stmt_idx, start_line, end_line, sql, clean, masked)`, one row per statement."""
    cut = pieces(F.col("sql"))
    cols = [c for c in ("doc_id", "path") if c in corpus.columns]
    parts = T.hold(corpus.select(*cols, "sql"), _pieces=cut).drop("sql")
    parts = T.hold(parts, _newlines=F.transform("_pieces", T.newlines), _texts=F.transform("_pieces", _without_separator))
    lines, before = T.with_prefix_sums(parts, "_newlines")
    kept = F.filter(F.arrays_zip(F.col("_pieces").alias("_pieces"), F.col("_texts").alias("_texts"), before.alias("_before")),
                    lambda p: _says_something(p["_texts"]))
    rows = lines.select(*cols, F.posexplode(kept).alias("stmt_idx", "_p"))
    lead = T.newlines(F.regexp_extract("_p._pieces", r"^\s*", 0))
    rows = rows.select(*cols, "stmt_idx", (F.col("_p._before") + lead + 1).alias("start_line"),
                       F.col("_p._texts").alias("sql"))
    rows = rows.withColumn("end_line", F.col("start_line") + T.newlines(F.col("sql")))
    # Most texts hold no template: they skip its eight replacements.
    text = F.when(F.col("sql").contains("{"), F.when(F.col("sql").rlike(r"\{[{%#]"), T.normalise_template(F.col("sql"))).otherwise(F.col("sql"))).otherwise(F.col("sql")) if templates else F.col("sql")
    rows = T.hold(rows, _text=text)
    rows = T.hold(rows, clean=T.strip_blanks(T.strip_comments(F.col("_text")))).drop("_text")
    return T.hold(rows, masked=T.mask_literals(F.col("clean")))


# --- classification --------------------------------------------------------------------------------------------

def statement_kind(clean: Column) -> Column:
    """One of the nine statement kinds."""
    starts = lambda words: clean.rlike(rf"(?i)^\s*(?:{words})")
    return (F.when(starts(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?:EXTERNAL\s+)?TABLE\b"), "create_table")
            .when(starts(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\b"), "create_view")
            .when(starts(r"WITH\b"), "cte")
            .when(starts(r"SELECT\b"), "select").when(starts(r"INSERT\b"), "insert")
            .when(starts(r"UPDATE\b"), "update").when(starts(r"DELETE\b"), "delete")
            .when(starts(r"MERGE\b"), "merge").otherwise("unknown"))


def operation(clean: Column) -> Column:
    """One of the thirteen operation types; null for text that is none of them."""
    starts = lambda words: clean.rlike(rf"(?i)^\s*(?:{words})")
    return (F.when(starts(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?TABLE\b(?:(?!\bAS\b)[\s\S])*\bAS\s+(?:SELECT\b|WITH\b|\()"),
                   "CREATE_TABLE_AS")
            .when(starts(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\b"), "CREATE_VIEW")
            .when(starts(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?:EXTERNAL\s+)?TABLE\b"), "CREATE_TABLE")
            .when(starts(r"CREATE\b"), "CREATE_OBJECT").when(starts(r"(?:WITH|SELECT)\b"), "SELECT")
            .when(starts(r"INSERT\b"), "INSERT").when(starts(r"UPDATE\b"), "UPDATE").when(starts(r"DELETE\b"), "DELETE")
            .when(starts(r"MERGE\b"), "MERGE").when(starts(r"REPLACE\b"), "REPLACE").when(starts(r"ALTER\b"), "ALTER")
            .when(starts(r"DROP\b"), "DROP").when(starts(r"TRUNCATE\b"), "TRUNCATE"))


# The kinds of object each action takes.
_OBJECTS = {
    "CREATE": "TABLE, EXTERNAL TABLE, VIEW, MATERIALIZED VIEW, INDEX, SCHEMA, DATABASE, FUNCTION, PROCEDURE, TRIGGER, SEQUENCE, TYPE, STAGE, STREAM, TASK, PIPE",
    "ALTER": "TABLE, VIEW, INDEX, SCHEMA, DATABASE, FUNCTION, PROCEDURE",
    "DROP": "TABLE, VIEW, MATERIALIZED VIEW, INDEX, SCHEMA, DATABASE, FUNCTION, PROCEDURE, TRIGGER, SEQUENCE, TYPE",
    "TRUNCATE": "TABLE",
}


def _ddl_pattern(action: str) -> str:
    """Group 1 the kind of object, group 2 its name as written."""
    kinds = "|".join(k.strip().replace(" ", r"\s+") for k in _OBJECTS[action].split(","))
    wanted = rf"(?:({kinds})\s+)?" if action == "TRUNCATE" else rf"({kinds})\s+"
    return rf"(?i)^{action}\s+(?:OR\s+REPLACE\s+)?{wanted}(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([^\s(;]+)"


def ddl_info(sql: Column) -> Column:
    """Struct (action, keyword, object_name); null when the statement is no DDL."""
    body = T.strip_leading_comments(sql)
    out = F.lit(None)
    for action in reversed(list(_OBJECTS)):
        pattern = _ddl_pattern(action)
        keyword = F.lit("TABLE") if action == "TRUNCATE" else F.upper(F.regexp_replace(T.rx(body, pattern, 1), r"\s+", " "))
        name = F.regexp_replace(T.rx(body, pattern, 2), r'[`"\[\]]', "")
        out = F.when(body.rlike(pattern), F.struct(F.lit(action).alias("action"), keyword.alias("keyword"),
                                                   name.alias("object_name"))).otherwise(out)
    return out


def session_command(sql: Column, dialect: Column) -> Column:
    """Type of the first session command, in order of precedence, that matches and is allowed in the dialect."""
    def first(body: Column) -> Column:
        hits = []
        for kind, pattern, dialects in P.SESSION_COMMANDS:
            hit = body.rlike("(?i)^" + pattern)
            if dialects:
                hit = hit & dialect.isin(dialects.split())
            hits.append(F.when(hit, F.lit(kind)))
        return F.coalesce(*hits)
    return F.get(F.transform(F.array(T.strip_leading_comments(sql)), first), F.lit(0))  # the text is stripped once for all patterns


def merged_runs(stmts: DataFrame, dialect: str = "MySQL") -> DataFrame:
    """Runs of consecutive DDL or session statements of one text, one row per run, by gaps and islands."""
    session = session_command(F.col("sql"), F.lit(dialect))
    ddl = ddl_info(F.col("sql"))
    marked = T.hold(stmts.select("doc_id", "start_line", "stmt_idx", "sql"), _s=session, _d=ddl).select(
        "doc_id", "start_line", "stmt_idx",
        F.when(F.col("_s").isNotNull(), "session").when(F.col("_d").isNotNull(), "ddl").otherwise("other").alias("unit"),
        F.coalesce("_s", F.concat_ws(" ", "_d.action", "_d.keyword")).alias("what"))
    order = Window.partitionBy("doc_id").orderBy("stmt_idx")
    changed = (F.lag("unit").over(order).isNull() | (F.lag("unit").over(order) != F.col("unit")) | (F.col("unit") == "other")).cast("int")
    runs = marked.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(order))
    return (runs.filter(F.col("unit") != "other").groupBy("doc_id", "run", "unit")
            .agg(F.count("*").alias("n_statements"), F.concat_ws(", ", F.array_sort(F.collect_list("what"))).alias("what"),
                 F.min("start_line").alias("start_line")))


# --- dialects --------------------------------------------------------------------------------------------------

def dialect_markers(stmts: DataFrame, keep: tuple[str, ...] = ("doc_id", "stmt_idx")) -> DataFrame:
    """One boolean column per syntax marker, all in one projection over the text without comments. A pattern is tried only where the text that each of its matches holds is there."""
    base = T.hold(stmts.select(*dict.fromkeys([*keep, "sql"])), _clean=T.strip_comments(F.col("sql")))
    base = T.hold(base, _masked=T.mask_literals(F.col("_clean")), _upper=F.upper("_clean"))

    def mark(name: str, pattern: str) -> Column:
        hit, sign = F.col("_clean" if name in P.UNMASKED_MARKERS else "_masked").rlike(pattern), P.marker_sign(name, pattern)
        return (F.col("_upper").contains(sign) & hit if sign else hit).alias(name)
    return base.select(*keep, *[mark(name, pattern) for name, pattern in P.DIALECT_MARKERS])


def dialect_scores(markers: DataFrame, keep: tuple[str, ...] = ("doc_id", "stmt_idx")) -> DataFrame:
    """Long table (dialect, score) with scores above zero; the points are added in the row, so nothing is shuffled."""
    typed = markers.withColumn("bigquery_unnest_typed",
                               F.col("bigquery_unnest") & (F.col("bigquery_struct") | F.col("bigquery_array_type")))
    scores = F.array(*[
        F.struct(F.lit(d).alias("dialect"),
                 reduce(lambda a, b: a + b, [F.col(m).cast("int") * pts for m, pts in points.items()]).alias("score"))
        for d, points in P.DIALECT_POINTS.items()])
    return (typed.select(*keep, "oracle_minus", "teradata_sample", F.explode(scores).alias("s"))
            .select(*keep, "oracle_minus", "teradata_sample", "s.dialect", "s.score").filter("score > 0"))


def detected_dialect(markers: DataFrame, keep: tuple[str, ...] = ("doc_id", "stmt_idx")) -> DataFrame:
    """`(dialect, top_score, confidence)` per statement: high when alone or clearly ahead, two weak signals excepted.

    The ranking is an array sort inside the row: no shuffle.
    """
    typed = markers.withColumn("bigquery_unnest_typed",
                               F.col("bigquery_unnest") & (F.col("bigquery_struct") | F.col("bigquery_array_type")))
    ranked = F.array(*[
        F.struct(reduce(lambda a, b: a + b, [F.col(m).cast("int") * pts for m, pts in points.items()]).alias("score"),
                 F.lit(-i).alias("order"), F.lit(d).alias("dialect"))
        for i, (d, points) in enumerate(P.DIALECT_POINTS.items())])
    met = reduce(lambda a, b: a | b, [F.col(m) for m in dict.fromkeys(m for points in P.DIALECT_POINTS.values() for m in points)])
    ranked = F.filter(ranked, lambda s: s["score"] > 0)
    rows = T.hold(typed, _r=F.when(met, F.sort_array(ranked, asc=False)).otherwise(F.array().cast("array<struct<score:int,order:int,dialect:string>>")))  # most texts hold no marker: nothing to rank
    top, second = F.get("_r", F.lit(0)), F.coalesce(F.get("_r", F.lit(1))["score"], F.lit(0))
    weak = (((top["dialect"] == "Oracle") & (top["score"] == 1) & F.col("oracle_minus"))
            | ((top["dialect"] == "Teradata") & (top["score"] == 2) & F.col("teradata_sample")))
    high = ((F.size("_r") == 1) & ~weak) | ((top["score"] >= 3) & (top["score"] >= second + 2))
    return rows.select(*keep, F.when(high, top["dialect"]).alias("dialect"), F.coalesce(top["score"], F.lit(0)).alias("top_score"),
                       F.when(F.size("_r") == 0, "none").when(high, "high").otherwise("low").alias("confidence"))


def declared_dialect(sql: Column) -> Column:
    """Dialect named by a `dialect:` directive in the leading comments; the earliest wording in the line wins."""
    lead = T.rx(sql, r"^(?:\s++|--[^\n]*+(?:\n|\z)|/\*(?:[^*]|\*(?!/))*+(?:\*/|\z))*+", 0)
    body = T.rx(lead, r"(?i)dialect\s*:\s*([^\n]+)", 1)
    hits = F.array(*[F.struct(F.when(body.rlike(p), F.length(T.rx(body, rf"(?s)^(.*?){p}", 1))).alias("at"), F.lit(i).alias("i"),
                              F.lit(d).alias("d")) for i, (p, d) in enumerate(P.DIRECTIVES)])
    return F.array_min(F.filter(hits, lambda h: h["at"].isNotNull()))["d"]
