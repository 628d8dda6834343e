"""Whole texts as bytes in the Python workers, batch by batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: Rows, and bytes, that Spark sends to a Python worker at once; texts may be long.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches(spark) -> None:
    """Send texts to Python a few at a time, so that a worker's memory does not grow with the batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 with A-Z in lower case (bytes.lower and bytes.split know ASCII only)."""
    return text.lower().split()


def release() -> None:
    """Give freed memory back to the system: a worker lives on for other tasks, beside an executor that needs the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes at most, a row at least; freed memory goes before the first and after the last."""
    release()
    for b in batches:
        at = 0
        each = max(1, int(limit * b.num_rows / max(b.nbytes, 1)))
        while at < b.num_rows:
            yield b.slice(at, each)
            at += each
    release()
