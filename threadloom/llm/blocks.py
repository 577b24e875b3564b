"""Arrow batches in, bounded blocks of rows out; shared folders."""

from __future__ import annotations

import uuid

import pyarrow as pa

from pyspark.sql import types as T

from threadloom.session import checkpoint_dir

BLOCK_BYTES = 4_000_000


def blocks(batches, column: str, limit: int = BLOCK_BYTES):
    """Slices of the batches whose ``column`` (text) holds about ``limit`` bytes; one longer
    text is a block of its own. Nulls have no bytes."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        values = batch.column(at)
        start, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield batch.slice(start)


def small_batches(spark) -> None:
    """Arrow batches of at most 1000 rows, where the session has the default of ten times as many: those of whole texts
    take tens of MB in the executor and again in its workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def tidy(task):
    """The task, which gives what it freed back to the system when it ends: Python workers live on for
    other tasks, and their executor counts what they hold."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            import ctypes
            import gc

            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run


def shared_folder(spark, what: str) -> str:
    """A new folder name below the shared folder the session names."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def extended(schema: T.StructType, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """The schema with more fields at its end."""
    return T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in fields)])
