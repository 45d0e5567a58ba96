"""Tables in the shared folder that the session names, so that rounds don't pile up a plan and a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a session on one machine (tests) uses a folder of its own; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/memlake-checkpoint"
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        if spark.sparkContext._jsc is not None:
            delete(spark, path)


class Scratch:
    """Written tables under one folder. Results may read them, so what is left of them goes when the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_at_exit, spark, self.root)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def write(self, df: DataFrame) -> DataFrame:
        return self.add(df, self.path())

    def add(self, df: DataFrame, path: str) -> DataFrame:
        """df appended to the table at path, and all that is there."""
        df.write.mode("append").parquet(path)
        again = self.spark.read.schema(df.schema).parquet(path)
        again._scratch_path = path
        return again

    def drop(self, df: DataFrame) -> None:
        if out := getattr(df, "_scratch_path", None):
            delete(self.spark, out)
