"""The training corpus in five stages, each over all rows that the one before it kept.

Stages but the last return the columns of ``documents``; the last returns the
pieces of packed sequences. run() writes every stage as Parquet to the shared
scratch folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import contamination, neardup, packing, pii, quality
from memlake.llm.common import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below the threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates at five words and a similarity of 0.8: the smallest id of each group stays."""
    return neardup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text is masked; n_chars follows."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids along the curve."""
    return packing.pack_digest(packing.packed(docs))


STAGES = [
    ("quality", keep_good),
    ("near-dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: No SQL can express the trained stages; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
