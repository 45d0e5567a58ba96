"""Importance resampling towards a target, on hashed counts of runs of words.

Text is read as Arrow's UTF-8 buffer: a table of 256 entries classifies and
lower-cases its bytes, word boundaries are where the class differs from that of the
byte before, and the words are put behind each other with one space between. Then a
CRC-32 register for each word start advances one byte a step through the 256-entry
table of the polynomial, all starts at once; a start leaves when its run of words
ends, and the registers at the word ends on the way are those of the shorter runs.
Runs that are longer than STEPS bytes (few, if any) are finished one by one with
zlib, from where they stand.

Counts of buckets are summed in each task, so a shuffle carries one row for each
bucket and task. A bucket's gain is the logarithm of its share in the target over
its share in the source, in thousandths; a document's weight is the mean of its
gains. Sampling without replacement adds Gumbel noise, drawn from a hash of the
document's id, and keeps the largest; ranks come from a sort by ranges and one sum
for each range, so that no task sees all documents and rows that are all alike are
spread too.

Null text has no words; a document without words has weight 0. A null id is hashed
as an empty one and comes first among ties. Repeated rows are ranked one by one,
texts of any length are read whole (one text is one step), extra columns are
ignored, an empty table gives an empty result, an empty target all-zero counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.llm.common import LOWER, Scratch, chunks, fields, flat, release, word_bounds

WORDS, BUCKETS = 1, 10_000
SEED, LEAST_WORDS, PERCENT = "2024", 20, 10
#: Bytes of a run that are stepped through together with other runs.
STEPS = 64

#: Bytes that are in no word: all of ASCII but letters and digits.
BREAK = np.ones(256, dtype=bool)
BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


CRC = _crc_table()


def run_crcs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC-32 of data[starts[k] : stops[k, j]] for each start k and column j, ascending in j; stops below the start: 0."""
    out = np.zeros(stops.shape, dtype=np.uint32)
    if not len(starts):
        return out
    last = stops.max(axis=1)
    order = np.argsort(starts - last, kind="stable")  # longest first: those that go on are a prefix
    at, ends, far = starts[order], stops[order], (last - starts)[order]
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    done = np.zeros(ends.shape, dtype=np.uint32)
    for step in range(1, min(int(far[0]), STEPS) + 1):
        n = int(np.searchsorted(-far, -step, side="right"))
        now = state[:n]
        now[:] = CRC[(now ^ data[at[:n] + (step - 1)]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        for j in range(ends.shape[1]):
            here = np.flatnonzero(ends[:n, j] - at[:n] == step)
            done[here, j] = ~now[here]
    for k in range(int(np.searchsorted(-far, -STEPS, side="left"))):
        low = int(at[k]) + STEPS
        crc = int(~state[k])
        for j in range(ends.shape[1]):
            if (stop := int(ends[k, j])) > low:
                crc, low = zlib.crc32(data[low:stop], crc), stop
                done[k, j] = crc
    out[order] = done
    return out


def features(col: pa.Array, words: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of all rows, the bounds of each row's features (n + 1 values), words a row."""
    data, bounds = flat(col)
    starts, ends, first = word_bounds(data, bounds, BREAK)
    # words behind each other, one space between, so that a run of words is one stretch of bytes
    length = ends - starts
    begin = np.cumsum(length + 1) - (length + 1)
    line = np.full(int(length.sum()) + len(length), 0x20, dtype=np.uint8)
    inside = ~BREAK[data]
    solid = LOWER[data[inside]]
    line[np.arange(len(solid)) + np.repeat(np.arange(len(length)), length)] = solid
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    upto = first[1:][row]  # a run stays in its row
    k = np.arange(len(starts))
    stops = np.stack([np.where(k + j < upto, (begin + length)[np.minimum(k + j, len(k) - 1)], 0) for j in range(words)], axis=1) if len(k) else np.zeros((0, words), dtype=np.int64)
    found = (run_crcs(line, begin, stops) % np.uint32(buckets)).astype(np.int64)
    there = stops > 0
    counts = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
    return found[there], counts[first], np.diff(first)


def bucket_counts(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all texts; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        total = np.zeros(buckets, dtype=np.int64)
        for part in chunks(batches, "text"):
            total += np.bincount(features(part.column("text"), words, buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths, from the counts of bucket_counts: ``buckets`` rows at most come to the driver."""
    counts = []
    for df in (source, target):
        n = np.zeros(buckets, dtype=np.int64)
        for r in df.collect():
            n[r.bucket] = r.n
        counts.append(n)
    s, t = counts
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s, t)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, words: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        for part in chunks(batches, "text"):
            found, bounds, n_words = features(part.column("text"), words, buckets)
            total = np.concatenate([[0], np.cumsum(gain[found])])
            n = np.diff(bounds)
            mean = (total[bounds[1:]] - total[bounds[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, n, mean))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, fields(docs.select("doc_id").schema, "n_words bigint, n_features bigint, weight bigint"))


def noise(doc_id: F.Column, seed: str = SEED) -> F.Column:
    """Gumbel noise in thousandths, from the first eight hex digits of sha256("seed:id")."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored: doc_id, n_words, score and more. Adds rank (from 1) to the floor(percent * N / 100) best of the N rows of enough words."""
    scratch = Scratch(scored.sparkSession)
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that are all alike differ by their place in the table, so that ranges split them
    kept = scratch.write(scored.withColumn("tie", F.monotonically_increasing_id()))
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    best = kept.where(F.col("n_words") >= least_words).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    best = scratch.write(best.select("*", F.spark_partition_id().alias("part"), place.alias("place")))
    sizes = best.groupBy("part").agg(F.count("*").alias("n"))
    # one row a range, in one small window
    before, every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    bases = sizes.select(F.col("part").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.floor(F.sum("n").over(every) * percent / 100).alias("drawn"))
    rank = F.col("base") + F.col("place") + 1
    names = [F.col(f"`{c}`") for c in scored.columns]
    top = best.join(F.broadcast(bases), F.col("part") == F.col("at")).select(*names, F.when(rank <= F.col("drawn"), rank).alias("rank"))
    return top.union(kept.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs, drawn towards the texts of target."""
    gain = gains(bucket_counts(docs, words, buckets), bucket_counts(target, words, buckets), buckets)
    scored = weigh(docs, gain, words).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, least_words, percent)


def digest(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
