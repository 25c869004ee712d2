"""Tables that a loop writes between its steps, so that no step's plan holds the ones before it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from verbatlas.sources.store import _file_system, index_folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; it outlives any executor."""
    path = f"{index_folder(df.sparkSession)}/scratch/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table behind ``written`` rows that nothing reads any more."""
    fs, at = _file_system(df.sparkSession, df._written)
    fs.delete(at, True)
