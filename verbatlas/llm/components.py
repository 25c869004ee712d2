"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a minimum by node (combined before the shuffle) and one join, so hubs
of any degree are spread, nothing is gathered on the driver, and the number of
rounds grows with the logarithm of the component size.  Before the first round each
task replaces its links by a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import discard, settle

#: Links that a task looks at together when it thins them out.
CHUNK = 200_000


def roots(a: list[int], b: list[int]) -> dict[int, int]:
    """Union-find over links: each node that is not the smallest of its component, with that smallest."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []

    def out() -> pa.RecordBatch:
        found = roots(a, b)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["a", "b"])

    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) >= CHUNK:
            yield out()
            a, b = [], []
    if a:
        yield out()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link: the smallest node that it reaches.

    ``links`` has two columns of non-null longs; loops and repeated links are fine.
    """
    first, second = links.columns
    pairs = links.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b")).filter("a <> b")
    # a: the larger end, b: the smaller end
    edges = settle(pairs.mapInArrow(_thin, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: larger neighbours of a node go to its least neighbour
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: smaller neighbours of a node, and the node, go to its least neighbour
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = settle(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    found = edges.groupBy("a").agg(F.min("b").alias("b"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
