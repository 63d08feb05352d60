"""Shared steps: rows with a fixed key, staged tables, text columns of any kind."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import staged

__all__ = ["staged", "table", "text_of", "row_keys", "parts", "with_fields"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text column, a missing text as the empty one."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def row_keys() -> Iterator[np.ndarray]:
    """A generator that is sent row counts and yields keys unique over all tasks.

    Keys hold the partition number, so a task that runs again writes the same keys; whoever uses
    them writes the keyed table once and reads it from there.
    """
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 33
    keys = np.empty(0, np.int64)
    done = 0
    while True:
        count = yield keys
        keys = np.arange(base + done, base + done + count, dtype=np.int64)
        done += count


def parts(batch: pa.RecordBatch, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch with a ``text`` column in slices of at most so many rows and bytes of text.

    A text beyond the size is a slice of its own: texts are never cut.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = int(np.searchsorted(ends, done + size, "right"))
        stop = max(at + 1, min(stop, at + rows))
        yield batch.slice(at, stop - at)
        at = stop


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])
