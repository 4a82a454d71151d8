"""Where SQL text comes from: folders of files, or any table with a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlstrata.functions import text as T

# Folders whose files are not part of a corpus.
SKIPPED_FOLDERS = ["node_modules", ".git", "dist", "build", "out", "coverage", ".vscode", "__pycache__", "target", "vendor"]

# Limits of one text.
MAX_TEXT_BYTES = 100 * 1024
MAX_STATEMENTS = 50


def in_skipped_folder(path: Column) -> Column:
    names = "|".join(n.replace(".", r"\.") for n in SKIPPED_FOLDERS)
    return path.rlike(rf"/(?:{names})/")


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("sql",)) -> DataFrame:
    """One row per corpus file with raw bytes. Skipped folders are filtered before any content is read."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root))
    return files.filter(~in_skipped_folder(F.col("path")))


def analyse_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """`(path, file_name, last_modified, size, content_hash, sql, parse_error)`; a failure is a value, not an exception.

    `max_bytes` marks larger files in `parse_error`; their text and hash stay, so nothing is lost to later tables.
    """
    too_big = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    body = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.select(
        "path",
        F.substring_index("path", "/", -1).alias("file_name"),
        F.col("modificationTime").alias("last_modified"),
        F.col("length").alias("size"),
        F.sha2(body, 256).alias("content_hash"),
        body.alias("sql"),
        F.when(too_big, F.format_string("size %d exceeds %d bytes", F.col("length"), F.lit(max_bytes or 0))).alias("parse_error"),
    )


def read_corpus(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("sql",), max_bytes: int | None = None) -> DataFrame:
    """Files of a folder as a corpus: `doc_id` is the path."""
    return analyse_files(scan_files(spark, root, extensions), max_bytes).withColumn("doc_id", F.col("path"))


def from_query_log(log: DataFrame, text_col: str, id_col: str, path_col: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """A table of SQL texts as a corpus. One row is one text, so no text is ever gathered from many rows. `max_bytes` only marks larger ones."""
    body = F.regexp_replace(F.col(text_col), "^﻿", "")
    size = F.octet_length(F.col(text_col))
    too_big = F.lit(False) if max_bytes is None else size > max_bytes
    return log.select(
        F.col(id_col).alias("doc_id"),
        (F.col(path_col) if path_col else F.col(id_col).cast("string")).alias("path"),
        size.cast("long").alias("size"),
        F.sha2(body, 256).alias("content_hash"),
        body.alias("sql"),
        F.when(too_big, F.lit("text too large")).when(F.trim(body) == "", F.lit("empty text")).alias("parse_error"),
    )


def validate(corpus: DataFrame, statement_count: Column, max_bytes: int = MAX_TEXT_BYTES, max_statements: int = MAX_STATEMENTS) -> DataFrame:
    """Which limit a text breaks first, with the measured value, the limit and its unit; null columns when none."""
    size = F.octet_length("sql")
    kind = (F.when(F.coalesce(F.trim("sql"), F.lit("")) == "", "empty_input")
            .when(size > max_bytes, "size_limit").when(statement_count > max_statements, "query_count_limit"))
    def pick(empty, by_size, by_count):
        return F.when(kind == "empty_input", empty).when(kind == "size_limit", by_size).when(kind == "query_count_limit", by_count)
    return corpus.select(
        "doc_id", kind.alias("error"),
        pick(F.lit(0), size, statement_count).alias("actual"),
        pick(F.lit(1), F.lit(max_bytes), F.lit(max_statements)).alias("limit_value"),
        pick(F.lit("characters"), F.lit("bytes"), F.lit("statements")).alias("unit"),
    )


