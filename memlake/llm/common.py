"""Shared pieces: table access, bounded Arrow chunks, vectorised word hashing, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.scratch import Scratch  # noqa: F401  the operators' scratch tables

#: Bytes of text that one vectorised step takes; bounds the Python worker's memory.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 when divided by 4 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fields(schema: T.StructType, more: str) -> T.StructType:
    """The fields of schema, then those of a DDL string: names of any kind stay as they are."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(more).fields])


#: What this process keeps between tasks, by owner: a Python worker is reused by later stages, which have no need of it.
_kept: dict[str, object] = {}


def keep(owner: str, make):
    """The owner's object, made where it is missing; an owner's task drops what other owners kept."""
    if owner not in _kept:
        release()
        _kept[owner] = make()
    return _kept[owner]


def release() -> None:
    """Drops what tasks kept and gives free memory back to the system."""
    _kept.clear()
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sizes(col: pa.Array) -> np.ndarray:
    """Bytes of each string (null: 0)."""
    return np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(sizes(batch.column(text)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
    pa.default_memory_pool().release_unused()


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in a row and the n + 1 bounds (null: empty)."""
    n = sizes(col)
    bounds = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=bounds[1:])
    if not bounds[-1]:
        return np.zeros(0, dtype=np.uint8), bounds
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], bounds


def texts(col: pa.Array) -> list[str]:
    return ["" if x is None else x for x in col.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; x is changed in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.RandomState(20240131).randint(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes 0x20 and 0x09 to 0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def _hash_span(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_bounds(data: np.ndarray, bounds: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (n + 1 values)."""
    solid = ~white[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]  # words end where rows end
    begins[inner] |= solid[inner]
    stops[inner - 1] |= solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in windows of about CHUNK_BYTES (a longer word: one window)."""
    if len(data) <= 2 * CHUNK_BYTES:
        return _hash_span(data, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        low = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, side="right")))
        out[at:upto] = _hash_span(data[low : ends[upto - 1]], starts[at:upto] - low, ends[at:upto] - low)
        at = upto
    return out


def reduce_rows(op: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: float = 0) -> np.ndarray:
    """op.reduceat over rows, which may be empty."""
    full = bounds[:-1] < bounds[1:]
    out = np.full(len(full), empty, dtype=values.dtype)
    if full.any():
        out[full] = op.reduceat(values, bounds[:-1][full])
    return out
