"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Texts are long: few rows make a batch, so that neither side of the pipe holds many at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def release() -> None:
    """Give freed memory back to the system: a worker process serves one stage after another."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast that workers need not import this package to read; call the result in a task."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(shared.value)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches, whose workers keep no memory after a task."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def map_groups(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """``applyInArrow`` per value of a column, likewise."""

    def tidy(table):
        try:
            return run(table)
        finally:
            release()

    return df.groupBy(key).applyInArrow(tidy, schema)


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, nulls as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with some of its columns exchanged, types and order kept."""
    arrays = [
        columns[f.name].cast(f.type) if f.name in columns else batch.column(i)
        for i, f in enumerate(batch.schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)


def slices(batches: Iterator[pa.RecordBatch], size_col: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of one column hold about ``limit`` bytes; a row is never cut."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(size_col)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
