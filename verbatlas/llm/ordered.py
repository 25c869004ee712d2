"""Places of rows within their groups, and blocks of rows that a task reads one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.llm.common import settle


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place (from 0) in their ``group`` by ``order`` (ascending, nulls first), as a written table.

    Rows are dealt out by ranges of group and order, so a group with very many rows is spread; rows that are equal in
    both are told apart by where they were read.  Each range is numbered where it lies.  Only the first group of a range
    can have begun before it, so what is broadcast is a row a range at most."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_read"]
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_read")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    place = dealt.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(place)
            before = pa.concat_arrays([own.slice(0, 1) if last is None else last, own.slice(0, len(own) - 1)])
            new = pc.or_(pc.fill_null(pc.not_equal(own, before), False), pc.xor(pc.is_null(own), pc.is_null(before))).to_numpy(zero_copy_only=False)
            at = np.arange(len(own))
            starts = at.copy()
            starts[~new] = -count  # rows that go on from the batch before
            idx = at - np.maximum.accumulate(starts)
            last, count = own.slice(len(own) - 1, 1), int(idx[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(idx)], names=[*batch.schema.names, "own"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    placed = settle(dealt.mapInArrow(run, f"{kinds}, own long"))
    ranges = placed.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a range
    base = ranges.select(F.col("part").alias("_part"), F.col(group).alias("_group"), (F.sum("n").over(before) - F.col("n")).alias("base")).filter("base > 0")
    both = placed.join(F.broadcast(base), (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return both.withColumn("idx", F.col("own") + F.coalesce("base", F.lit(0))).drop("part", "own", "_part", "_group", "base")


def blocks(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows that are equal in the columns ``keys``; a run is held as a whole, so it must be bounded."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = tuple(row[k] for k in keys)
            if rows and own != key:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def packed(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of ``size`` rows."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def typed(rows: Iterator[tuple], kinds: Callable[[], list[tuple[str, pa.DataType]]]) -> Iterator[pa.RecordBatch]:
    """``packed`` with columns whose types are known once the first row is."""
    first = next(rows, None)
    if first is not None:
        yield from packed(chain([first], rows), kinds())
