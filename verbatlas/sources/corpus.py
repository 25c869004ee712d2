"""The corpus tables that every view reads: documents, passages and their token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.text import tokens

#: A line with such a character has a token.
TOKEN_START = r"[\p{L}\p{N}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """Lines that have a token: doc_id, lang, source, line_start (from 1), line."""
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # a filter on the tokens would take them twice
    return rows.select("doc_id", "lang", "source", (F.col("pos") + 1).cast("long").alias("line_start"), "line").filter(F.col("line").rlike(TOKEN_START))


def passages(docs: DataFrame) -> DataFrame:
    """Non-blank lines with tokens: doc_id, lang, source, line_start (from 1), line, toks, n_tok."""
    return lines(docs).withColumn("toks", tokens(F.col("line"))).withColumn("n_tok", F.size("toks").cast("long"))


def words(rows: DataFrame) -> DataFrame:
    """One row a token: doc_id, lang, source, line_start, i (from 0), word."""
    return rows.select("doc_id", "lang", "source", "line_start", F.posexplode("toks").alias("i", "word"))


def frontmatter(files: DataFrame) -> DataFrame:
    """Of (path, text): path, fields (map of ``key: value`` lines between leading --- marks) and body; CRLF and a BOM are accepted."""
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n", "\n")
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n(?:---|\.\.\.)(?:\n|\z)", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([A-Za-z0-9_-]+):", 1)).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(x, r"^[A-Za-z0-9_-]+:(.*)$", 1), "^\\s*[\"']|[\"']\\s*$", "")).alias("v"))), lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("value")))
    return files.select("path", F.map_from_entries(last).alias("fields"), F.regexp_replace(text, r"(?s)\A---\n.*?\n(?:---|\.\.\.)(?:\n|\z)", "").alias("body"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two (path, mtime, size, hash) snapshots: path and what an incremental build does with it."""
    old = before.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.col("hash").alias("h0"))
    same = (F.col("mtime") == F.col("m0")) & (F.col("size") == F.col("s0"))
    change = F.when(F.col("m0").isNull(), "added").when(F.col("mtime").isNull(), "removed").when(same, "unchanged").when(F.col("hash") == F.col("h0"), "touched").otherwise("changed")
    return after.join(old, "path", "full").select("path", change.alias("change"))
