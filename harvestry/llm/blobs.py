"""Arrays of words' keys and counts as bytes, for tables that send many of them from bucket to bucket.

A row has the bucket it goes to, its kind, where it comes from, a number and up to four arrays. What one task has for one
bucket is a row, so the cost of a row is shared by many numbers, and a hot key costs an entry a sender, not one a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Columns of such rows; an Arrow schema of the same.
ROWS = "to int, kind int, src int, i long, p binary, q binary, r binary, s binary"
_FIELDS = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("src", pa.int32()), ("i", pa.int64()), *[(c, pa.binary()) for c in "pqrs"]])
#: Bytes of a batch that a task hands on.
BATCH = 4 << 20


def pack(keys: np.ndarray, width: int = 2) -> bytes:
    """Keys of 64 bits, those below 2**(8 * width) in width bytes."""
    small = (keys >= 0) & (keys < 1 << (8 * width))
    return len(keys).to_bytes(8, "little") + np.packbits(small).tobytes() + keys[small].astype(f"<u{width}").tobytes() + keys[~small].astype("<i8").tobytes()


def unpack(data: bytes, width: int = 2) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    at = 8 + (n + 7) // 8
    small = np.unpackbits(np.frombuffer(data, np.uint8, at - 8, 8), count=n).astype(bool)
    k = int(small.sum())
    out = np.empty(n, dtype=np.int64)
    out[small] = np.frombuffer(data, f"<u{width}", k, at)
    out[~small] = np.frombuffer(data, "<i8", n - k, at + width * k)
    return out


def pack_counts(n: np.ndarray) -> bytes:
    """Counts, those below 255 in a byte."""
    small = np.minimum(n, 255).astype(np.uint8)
    return len(n).to_bytes(8, "little") + small.tobytes() + n[small == 255].astype("<i8").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    large = out == 255
    out[large] = np.frombuffer(data, "<i8", int(large.sum()), 8 + n)
    return out


def mixed(keys: np.ndarray) -> np.ndarray:
    """Well mixed bits of keys."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def placed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key."""
    return (mixed(keys) % np.uint64(buckets)).astype(np.int32)


def split(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket that keeps the order within, and (bucket, begin, end) of each that occurs."""
    if not len(bucket):
        return np.zeros(0, dtype=np.int64), []
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True))


class Out:
    """Rows on their way out, handed on in batches."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, to: int, kind: int, src: int = 0, i: int = 0, p: bytes | None = None, q: bytes | None = None, r: bytes | None = None, s: bytes | None = None) -> None:
        self.rows.append((to, kind, src, i, p, q, r, s))
        self.size += 64 + sum(len(x) for x in (p, q, r, s) if x)

    def ready(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or self.size > BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)
            self.rows, self.size = [], 0


class Batches:
    """Finished batches on their way out."""

    def __init__(self):
        self.rows: list[pa.RecordBatch] = []

    def ready(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        yield from self.rows
        self.rows = []


def stream(*columns: pa.Array) -> bytes:
    """Columns of any type as bytes."""
    batch, sink = pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def streamed(data: bytes) -> list[pa.Array]:
    return [c.combine_chunks() for c in pa.ipc.open_stream(data).read_all().columns]


def grouped(batches: Iterator[pa.RecordBatch], column: int, begin: Callable, each: Callable, end: Callable, out) -> Iterator[pa.RecordBatch]:
    """Run begin(key) -> state, each(state, row), end(state) over rows sorted by the key in a column; out.ready() has the results."""
    now, state = None, None
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[column] != now:
                if now is not None:
                    end(state)
                    yield from out.ready()
                now = row[column]
                state = begin(now)
            each(state, row)
            yield from out.ready()
    if now is not None:
        end(state)
    yield from out.ready(last=True)
