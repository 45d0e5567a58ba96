"""Packing along a space-filling curve.

A document's vector is the sum of a hashed sign vector for each word. It is
projected to few dimensions, each is cut into quantiles of the normal curve, and
the cell's place on the Hilbert curve is the document's key. Documents are range
partitioned by key (ties: by id), with bounds from an approximate quantile sketch
over a sample of rows, sorted within each partition and cut into sequences of LENGTH
ids; the last stretch of a partition becomes sequences of powers of two, which
need no padding. So no padding is left at all, and neighbours on the curve meet.

The curve's key is padded with bits of the id's hash: thousands of copies, which
share a key, are split like any other documents.

Null text counts as empty (its end id alone). A null id is packed like others.
Repeated rows are packed once each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import chunks, fields, flat, reduce_rows, release, word_bounds, word_hashes
from memlake.llm.tokens import TOKEN_CHUNK, encoder, vocabulary

LENGTH = 2048
DIMENSIONS, BITS = 4, 7
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Ranges for each partition: their sizes even out. Rows of the sample for each range.
RANGES, PER_RANGE = 4, 64

#: The cell of a coordinate, by quantiles of the normal curve (Acklam's starting points are not needed: a logistic fits well enough).
_QUANTILES = np.arange(1, 1 << BITS) / (1 << BITS)
_EDGES = np.log(_QUANTILES / (1 - _QUANTILES)) / 1.702


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows, dimensions), by Gray-code transposition."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The curve place of each row's hashed word vector, shifted left to leave 31 bits for a tie-break."""
    starts, ends, first = word_bounds(data, bounds)
    words = word_hashes(data, starts, ends)
    count = np.maximum(np.diff(first), 1)
    cells = np.empty((len(count), DIMENSIONS), dtype=np.int64)
    for d in range(DIMENSIONS):
        # sixteen bits of the hash as a number of unit variance
        part = ((words >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64)
        part = (part - 32767.5) / 18918.6
        cells[:, d] = np.searchsorted(_EDGES, reduce_rows(np.add, part, first) / np.sqrt(count))
    return hilbert(cells, BITS) << 31


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of each row."""

    def run(batches):
        release()
        for part in chunks(batches, "text"):
            keys = curve_keys(*flat(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys + np.array([zlib.crc32(str(x).encode()) >> 1 for x in part.column("doc_id").to_pylist()], dtype=np.int64))], ["doc_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, fields(docs.select("doc_id").schema, "key bigint"))


def cut_points(docs: DataFrame, ranges: int) -> list[int]:
    """Bounds of ranges of about equal rows, from a mergeable quantile sketch over a sample by hash: where they lie changes the sizes of tasks alone."""
    steps = [k / ranges for k in range(1, ranges)]
    share = PER_RANGE * ranges / max(docs.count(), 1)
    if share < 1:
        docs = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = _keyed(docs).agg(F.percentile_approx("key", steps, 20_000).alias("q")).first() if steps else None
    return sorted(set((found and found.q) or []))


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 16-bit), ids_crc32 (of 32-bit ids)."""
    spark = docs.sparkSession
    path = path or vocabulary(VOCABULARY)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(cut_points(docs, RANGES * parts), dtype=np.int64)

    def encode(batches):
        ids = encoder(path, end_id, "<u2")
        for part in chunks(batches, "text", TOKEN_CHUNK):
            col = part.column("text")
            tie = np.array([zlib.crc32(str(x).encode()) >> 1 for x in part.column("doc_id").to_pylist()], dtype=np.int64)
            keys = curve_keys(*flat(col)) + tie
            values, limits = ids.encode(col)
            raw = pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer((2 * limits).astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, keys, side="right"), pa.int32()), pa.array(keys), part.column("doc_id"), raw], ["range", "key", "doc_id", "ids"])

    def pack(batches):
        release()
        sequence, used = (TaskContext.get().partitionId() << 40), 0
        held: list[tuple] = []  # pieces of the open sequence: doc_id, start, ids, doc_tokens

        def emit(pieces, first_sequence, size):
            """Pieces in sequences of size; each sequence is full."""
            rows, at, seq = [], 0, first_sequence
            for doc, start, ids, n in pieces:
                low = 0
                while low < len(ids):
                    take = min(len(ids) - low, size[seq - first_sequence] - at)
                    part = ids[low : low + take]
                    rows.append((doc, start + low, take, zlib.crc32(part.astype("<u4").tobytes()), n, seq, at, part.tobytes()))
                    low, at = low + take, at + take
                    if at == size[seq - first_sequence]:
                        seq, at = seq + 1, 0
            cols = list(zip(*rows))
            types = [doc_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u2")
                held.append((doc, 0, ids, len(ids)))
                used += len(ids)
                if used >= 64 * length:
                    full = used // length
                    left, keep, room = [], [], full * length
                    for piece in held:
                        take = min(room, len(piece[2]))
                        room -= take
                        if take:
                            left.append((piece[0], piece[1], piece[2][:take], piece[3]))
                        if take < len(piece[2]):
                            keep.append((piece[0], piece[1] + take, piece[2][take:].copy(), piece[3]))
                    yield emit(left, sequence, [length] * full)
                    sequence, used, held = sequence + full, used - full * length, keep
        if held:
            sizes, rest = [length] * (used // length), used % length
            sizes += [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1]
            yield emit(held, sequence, sizes)

    own = docs.select("doc_id").schema
    keyed = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("key", T.LongType()), *own, T.StructField("ids", T.BinaryType())])
    encoded = docs.select("doc_id", "text").mapInArrow(encode, keyed)
    ranged = encoded.repartition(parts, "range").sortWithinPartitions("range", "key", "doc_id", F.xxhash64("ids"))
    return ranged.select("doc_id", "ids").mapInArrow(pack, fields(own, "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"))


def pack_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
