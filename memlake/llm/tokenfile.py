"""Token files: ORC stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range partitioned by id, so that the files and their stripes follow
each other in id order; each file's ids are encoded where they are written.
Readers take stripes in parallel; a predicate on doc_id prunes files and stripes by
the indexes' bounds and Bloom filters. Offsets within a file are in the file, those
of the files before it come from one sum for each file.

Null text counts as empty (its end id alone). Null ids sort first. Repeated rows
are written once each, ordered by their text; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.llm.common import Scratch, chunks, fields, release
from memlake.llm.tokens import TOKEN_CHUNK, encoder, vocabulary

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Options of the files.
ORC = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.dictionary.key.threshold": "0",
}


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Files of (part, doc_id, local_start, ids) in ascending doc_id order."""
    path = path or vocabulary(VOCABULARY)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        ids, at = encoder(path, end_id), 0
        for part in chunks(batches, "text", TOKEN_CHUNK):
            values, limits = ids.encode(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(values.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("part"), part.column("doc_id"), pa.array(at + limits[:-1]), lists], ["part", "doc_id", "local_start", "ids"])
            at += int(limits[-1])

    encoded = ranged.mapInArrow(run, fields(ranged.select("part", "doc_id").schema, "local_start bigint, ids array<int>"))
    writer = encoded.write.format("orc")
    for k, v in ORC.items():
        writer = writer.option(k, v)
    writer.save(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(part, doc_id, local_start, ids) of the files; a filter on doc_id reaches the stripes."""
    return spark.read.orc(out)


def file_digest(spark: SparkSession, out: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document."""
    rows = read_tokens(spark, out)
    sizes = rows.groupBy("part").agg(F.sum(F.size("ids").cast("bigint")).alias("n"))
    # one row a file, in one small window
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("part").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    def run(batches):
        release()
        for batch in batches:
            lists = batch.column("ids")
            values = np.asarray(lists.values).view("<u4")
            bounds = np.asarray(lists.offsets)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("local_start"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    read = rows.mapInArrow(run, fields(rows.select("part", "doc_id", "local_start").schema, "n_tokens bigint, ids_crc32 bigint"))
    return read.join(bases, F.col("part") == F.col("at")).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write docs to token files in the shared scratch folder and read them back."""
    out = Scratch(docs.sparkSession).path()
    write_tokens(docs, out)
    return file_digest(docs.sparkSession, out)
