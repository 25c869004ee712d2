"""The topic layer joined to its documents, kept as a table and redone only for keys whose document or tag row has changed.

A refresh compares content hashes of both sides with those of the last state, and only keys that differ go through the
join, into a delta of their own.  A state is the newest base and the deltas after it; of each key the last delta counts.
Over ``MOST_DELTAS`` deltas a new base is written.  Tables are written under another name and renamed, so a refresh that
is lost half-way leaves the state as it was.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verbatlas.sources.store import _file_system

MOST_DELTAS = 8


def _hash(rows: DataFrame, key: str) -> Column:
    own = F.struct(*sorted(c for c in rows.columns if c != key))
    return F.unhex(F.sha1(F.to_json(own, {"ignoreNullFields": "false"}).cast("binary")))


def _tables(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(generation, name) of the newest base and the deltas after it, in order."""
    fs, at = _file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = sorted((int(m[2]), n) for n in names if (m := re.fullmatch(r"(base|delta)-(\d+)", n)))
    base = max((g for g, n in found if n.startswith("base")), default=-1)
    return [(g, n) for g, n in found if g > base or n == f"base-{base}"]


def _put(df: DataFrame, folder: str, name: str) -> None:
    fs, written = _file_system(df.sparkSession, f"{folder}/.{uuid.uuid4().hex}")
    _, final = _file_system(df.sparkSession, f"{folder}/{name}")
    df.write.parquet(str(written))
    if fs.exists(final) or not fs.rename(written, final):
        fs.delete(written, True)
        raise RuntimeError(f"another refresh has made {name} of {folder}")


def _drop_before(spark: SparkSession, folder: str, generation: int) -> None:
    """Delete what is older than a generation: the state before the last base stays for those that still read it."""
    fs, at = _file_system(spark, folder)
    for status in fs.listStatus(at):
        m = re.fullmatch(r"(?:base|delta)-(\d+)", status.getPath().getName())
        if m and int(m[1]) < generation:
            fs.delete(status.getPath(), True)


def _last(rows: DataFrame, columns: list[str]) -> DataFrame:
    each = rows.groupBy("key").agg(F.max_by(F.struct("change", *columns), "generation").alias("m"))
    return each.select("key", "m.*").filter("change <> 'removed'").drop("change")


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    names = [n for _, n in _tables(spark, folder)]
    return spark.read.parquet(*[f"{folder}/{n}" for n in names]) if names else None


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The joined rows as of the last refresh: key, doc and row, structs of what the two sides hold beside their keys."""
    return _last(_stored(spark, folder), ["doc", "row"])


def refresh(docs: DataFrame, rows: DataFrame, folder: str, key: str = "key") -> DataFrame:
    """Bring the layer in ``folder`` up to ``docs`` and ``rows`` (each with ``key``); gives what was done: key, change.

    change: added, document, tags, both, or removed (a side is gone); keys that are as they were are not named.  Rows
    with a null key have no part; of rows with one key the one with the greatest content hash counts."""
    spark = docs.sparkSession
    sides = {}
    for name, side in (("doc", docs), ("row", rows)):
        own = [c for c in side.columns if c != key]
        sides[name] = side.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), _hash(side, key).alias(f"{name}_hash"), F.struct(*own).alias(name))
    hashes = [s.groupBy("key").agg(F.max(f"{n}_hash").alias(f"{n}_hash")) for n, s in sides.items()]
    now = hashes[0].join(hashes[1], "key")
    stored, tables = _stored(spark, folder), _tables(spark, folder)
    generation = tables[-1][0] + 1 if tables else 0
    if stored is None:
        before = spark.createDataFrame([], StructType([now.schema["key"]])).select("key", F.lit(None).cast("binary").alias("doc_was"), F.lit(None).cast("binary").alias("row_was"))
    else:
        before = _last(stored, ["doc_hash", "row_hash"]).withColumnsRenamed({"doc_hash": "doc_was", "row_hash": "row_was"})
    doc, row = F.col("doc_hash") != F.col("doc_was"), F.col("row_hash") != F.col("row_was")
    change = F.when(F.col("doc_was").isNull(), "added").when(F.col("doc_hash").isNull(), "removed").when(doc & row, "both").when(doc, "document").when(row, "tags")
    todo = now.join(before, "key", "full").select("key", "doc_hash", "row_hash", change.alias("change")).filter("change IS NOT NULL")
    redone = todo
    for name, side in sides.items():  # equal hashes are equal rows, so any one of a key's will do
        redone = redone.join(side, ["key", f"{name}_hash"], "left")
    out = redone.groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_hash", "row_hash", "change", "doc", "row"))).withColumn("generation", F.lit(generation))
    _put(out, folder, f"delta-{generation}")
    if len(tables) >= MOST_DELTAS:
        whole = _last(_stored(spark, folder), ["doc_hash", "row_hash", "doc", "row"])
        _put(whole.withColumns({"change": F.lit("kept"), "generation": F.lit(generation + 1)}).select(out.columns), folder, f"base-{generation + 1}")
        _drop_before(spark, folder, tables[0][0])
    return spark.read.parquet(f"{folder}/delta-{generation}").select("key", "change")
