"""Passage vectors beside the segments of a stored index: a segment is embedded once, so what has not changed is never embedded again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.functions.stats import round6
from verbatlas.sources.store import Index, _file_system, _write, among, tokenised

SCHEMA = "doc_id long, line_start long, v array<double>, seg int"


def _there(index: Index, model: str) -> list[bool]:
    """Which segments have vectors of a model."""
    out = []
    for s in index.state.segments:
        fs, at = _file_system(index.spark, f"{index.folder}/{s['name']}/vectors-{model}/_SUCCESS")
        out.append(fs.exists(at))
    return out


def freshness(index: Index, model: str) -> str:
    """missing, stale (some segments lack vectors of the model) or current."""
    there = _there(index, model)
    return "current" if all(there) else "stale" if any(there) else "missing"


def build(index: Index, model: str, embed: Callable[[Column], Column], least: int = 5) -> int:
    """Embed the passages with ``least`` tokens or more of the segments that lack vectors; how many segments that were.  ``embed``: toks to a unit vector."""
    made = 0
    for s, there in zip(index.state.segments, _there(index, model), strict=True):
        if not there:
            whole = replace(index, kept=None)
            rows = whole.lines if len(index.state.segments) == 1 else among(whole.lines, whole.docs.filter(F.col("seg") == s["seg"]).select("doc_id"))
            rows = tokenised(rows).filter(F.col("n_tok") >= least)
            _write(rows.select("doc_id", "line_start", embed(F.col("toks")).alias("v"), F.lit(s["seg"]).alias("seg")), f"{index.folder}/{s['name']}/vectors-{model}")
            made += 1
    return made


def read(index: Index, model: str) -> DataFrame:
    """doc_id, line_start, v of the live passages."""
    return index.live(index.spark.read.schema(SCHEMA).parquet(*[f"{index.folder}/{s['name']}/vectors-{model}" for s in index.state.segments]))


def ranked(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """Documents by their best passage's cosine with a unit vector: doc_id, line_start (ties: the smallest), score; the vector is the only thing sent."""
    dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, query)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.select("doc_id", F.struct((-round6(dot)).alias("less"), "line_start").alias("x"))
    best = scored.groupBy("doc_id").agg(F.min("x").alias("b")).select("doc_id", F.col("b.line_start").alias("line_start"), (-F.col("b.less")).alias("score"))
    return best.orderBy(F.desc("score"), "doc_id").limit(limit)
