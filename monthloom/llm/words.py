"""Words of whole texts as numpy arrays: spans, hashes, shingles.

A text reaches a Python task as the UTF-8 buffer of an Arrow column, so words are cut and
hashed for many documents at once without a Python object per word. All functions work on
slices of at most `CHUNK_BYTES` (a longer single text is a slice of its own), which bounds
the memory of a task whatever the number of documents.

Hashes have 64 bits. Two different words (or shingles) are taken as one with probability
2**-64 per compared pair.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1_000_000
BATCH_ROWS = 256

_RANDOM = np.random.default_rng(20)
_BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEP = 0xD1342543DE82EF95

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]` as a table over bytes; every byte of a longer character counts.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


def limit_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts. Only ever lowers the setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """`mapInArrow` in small batches. A worker gives freed memory back when a task ends:
    idle workers stay alive beside the next stages' JVM work."""
    limit_batches(df.sparkSession)

    def task(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, dtype=np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


_power_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; one long text makes tables for itself only."""
    if size <= CHUNK_BYTES:
        if 0 not in _power_cache:
            _power_cache[0] = (
                _powers(_BASE, CHUNK_BYTES),
                _powers(_BASE_INVERSE, CHUNK_BYTES),
            )
        return _power_cache[0]
    return _powers(_BASE, size), _powers(_BASE_INVERSE, size)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = values.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of consecutive documents: `doc` is the row within the slice."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def documents(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.documents).astype(np.int64)

    def hashes(self) -> np.ndarray:
        up, down = _power_tables(len(self.data))
        running = np.empty(len(self.data) + 1, dtype=np.uint64)
        running[0] = 0
        np.cumsum(_BYTE_CODE[self.data] * up[: len(self.data)], out=running[1:])
        value = (running[self.ends] - running[self.starts]) * down[self.starts]
        value += (self.ends - self.starts).astype(np.uint64) * np.uint64(_STEP)
        return mix(value)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is an empty text."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if data is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8), at.astype(np.int64)


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold at most `limit` bytes, or one row."""
    _, offsets = text_buffer(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end
        row = end


def cut(column: pa.Array, first: int, last: int, table: np.ndarray, lower: bool = True) -> Words:
    """Words of the rows `first` to `last` (exclusive): maximal runs of bytes in `table`."""
    data, offsets = text_buffer(column)
    offsets = offsets[first : last + 1]
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = table[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    heads = edges[edges < len(data)]
    begins[heads] = inside[heads]
    tails = edges[edges > 0] - 1
    stops[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, offsets, starts, ends, doc)


def runs(hashes: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `length` words that stays in one document, and its first word."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    value = np.zeros(count, dtype=np.uint64)
    for k in range(length):
        value *= np.uint64(_BASE)
        value += hashes[k : k + count]
    first = np.flatnonzero(doc[:count] == doc[length - 1 :])
    return mix(value[first] + np.uint64(length * _STEP % 2**64)), first


def lists(row: np.ndarray, values: pa.Array | np.ndarray, rows: int) -> pa.ListArray:
    """A list column from values whose rows ascend."""
    bounds = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    if isinstance(values, np.ndarray):
        values = pa.array(values)
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
