"""Helpers that several operators share: durable lineage cuts and row keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in joins and orders: a null id comes before every other.
NULL_ID = -(2**63)


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoint() works: the cluster's folder, else, on one machine only, one of our own.

    A cluster names a folder that the driver and all executors share in
    ``spark.checkpoint.dir``.  Where that is unset a local session (tests) gets a folder in
    the temporary one; a session on a cluster is refused, as its executors would not see it.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "verbatlas-checkpoints"))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from the written rows.

    The table is compressed, can be read by column, and outlives any executor.
    """
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._settled = path
    return written


def discard(df: DataFrame) -> None:
    """Delete the table behind a settled DataFrame that nothing reads any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``table``, one settled row a key, whose ``count`` is the key's number of rows.

    Keys of a thousandth of all counted rows or more, of which there are at most a thousand, are broadcast and
    joined where the rows lie; only the others go through an exchange, so no key fills a task."""
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    least = max(1, total // 1000)
    hot, cold = (table.filter(F.col(count) >= least), table.filter(F.col(count) < least)) if total > 100_000 else (None, table)
    if hot is None:
        return rows.join(cold, on)
    shared = F.broadcast(hot)
    return rows.join(shared, on).unionByName(rows.join(shared.select(*on), on, "left_anti").join(cold, on))


def id_key(column: str = "doc_id") -> Column:
    """The id with nulls as NULL_ID, so that joins and orders have no nulls."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get texts in batches of 4 MB at most, which bounds their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def trim() -> None:
    """Give memory that a Python worker has freed back to the machine; idle workers stay small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
