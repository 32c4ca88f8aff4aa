"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from fluentrail.session import scratch_path

#: Bytes of text that one step of a task works on at a time.
STEP_BYTES = 1 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def steps(batch: pa.RecordBatch, column: int = 1, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``most`` bytes of text, one row at least."""
    text = batch.column(column)
    if not len(text):
        return
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(text), 0).cast(pa.int64())).to_numpy()
    at, rows = 0, len(text)
    while at < rows:
        limit = (ends[at - 1] if at else 0) + most
        upto = max(at + 1, int(ends.searchsorted(limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto
