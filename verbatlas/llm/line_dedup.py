"""Line dedup by overlapping three-line windows.

Every run of ``width`` consecutive lines is hashed (128 bits).  A window that also
occurs earlier, by document id and then line number, is a later occurrence, and
the lines that later occurrences cover are removed; overlapping windows merge.
The first place of a line's text is never covered, so no text is lost altogether.

One window is never compared with another: the first place of each hash is a
minimum that is combined before the shuffle, and the windows that many rows share
are few, so their first places are broadcast; only rarer ones meet their rows in
an exchange.

Defined results: a null text stays null and an empty one empty; texts with fewer
lines than ``width`` stay as they are; a null id comes before every other; rows of
one id and one text count as one place and get the same result, and of one id
with several texts each is a place of its own, ordered by text hash; an empty
table gives an empty table; other columns pass through, whatever their names (but
``dedup`` replaces columns named like the two that it adds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import id_key, settle, spread_join


def _windows(lines: Column, width: int) -> Column:
    """Hashes of the windows of an array of lines, in order; empty if there are fewer lines than ``width``."""
    # two hashes of each line, then of each run of line hashes
    pair = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b")))
    starts = F.when(F.size(lines) >= width, F.sequence(F.lit(1), F.size(lines) - width + 1)).otherwise(F.array().cast("array<int>"))

    def of(i: Column) -> Column:
        run = F.slice(pair, i, width)
        return F.struct(F.xxhash64(F.transform(run, lambda x: x["a"])).alias("a"), F.xxhash64(F.transform(run, lambda x: x["b"])).alias("b"))

    return F.transform(starts, of)


def later_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(i, h, starts): by place, the sorted 0-based starts of windows that occur earlier somewhere."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    places = docs.select(id_key().alias("i"), F.xxhash64(text).alias("h"), F.split(text, "\n", -1).alias("lines"))
    rows = places.filter(F.size("lines") >= width).select("i", "h", F.posexplode(_windows(F.col("lines"), width)).alias("at", "w"))
    rows = settle(rows.select("i", "h", "at", F.col("w.a").alias("a"), F.col("w.b").alias("b")))  # hashed once, read twice
    first = rows.groupBy("a", "b").agg(F.min(F.struct("i", "h", "at")).alias("first"), F.max(F.struct("i", "h", "at")).alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = settle(first.filter(F.col("first") != F.col("last")).select("a", "b", "first", "n"))
    later = spread_join(rows, repeated, ["a", "b"]).filter(F.struct("i", "h", "at") != F.col("first"))
    return later.groupBy("i", "h").agg(F.collect_set("at").alias("starts"))


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """One row a row of ``docs``: row (all its columns), kept (the text without later occurrences), n_lines, n_removed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key().alias("i"), F.xxhash64(text).alias("h"), F.col("text").cast("string").alias("text"))
    joined = rows.join(later_windows(docs, width), ["i", "h"], "left").withColumn("lines", F.split("text", "\n", -1))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))
    joined = joined.withColumn("covered", covered)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    kept = F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return joined.select("row", kept.alias("kept"), size("lines").alias("n_lines"), size("covered").alias("n_removed"))


def dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and n_lines and n_removed, which replace columns of those names."""
    own = [F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _marked(docs, width).select(*own, "n_lines", "n_removed")


def clean(docs: DataFrame, width: int = 3, size: str | None = None) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and just its columns; the column ``size``, if given, follows the text's code points."""
    kind = {f.name: f.dataType for f in docs.schema.fields}
    chars = lambda c: F.when(F.col("kept").isNull(), F.col("row")[c]).otherwise(F.char_length("kept").cast(kind[c])).alias(c)
    return _marked(docs, width).select(*[F.col("kept").alias(c) if c == "text" else chars(c) if c == size else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_lines, n_removed, kept_sha256."""
    done = dedup(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
