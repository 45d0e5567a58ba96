"""The queue as streams: idempotent enqueue, per-session state, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.operators.queue import job_id
from memlake.plans.views import JOBS
from memlake.scratch import Scratch

STATE = "session_id string, events bigint, failures bigint, last_event bigint"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Queue jobs as a file stream over the events table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    jobs = raw.selectExpr(*[f"{e} AS {c}" for c, e in JOBS.items()])
    return jobs.withColumn("job_id", job_id(*map(F.col, ("host", "session_id", "event", "boundary"))))


def dedup_stream(jobs: DataFrame) -> DataFrame:
    """One row for each job id, however often it is sent; receipts are kept for ever, so there is no watermark."""
    return jobs.dropDuplicates(["job_id"]).select("job_id", "session_id")


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    events, failures, last = state.get if state.exists else (0, 0, -1)
    for pdf in batches:
        events += len(pdf)
        failures += int((pdf["state"] == "dead").sum())
        last = max(last, int(pdf["rowid"].max()))
    state.update((events, failures, last))
    yield pd.DataFrame([(key[0], events, failures, last)], columns=["session_id", "events", "failures", "last_event"])


def session_state(jobs: DataFrame) -> DataFrame:
    """Counts and the last event of each session; a session's events come in batches, its state is three numbers."""
    rows = jobs.select("session_id", "state", "rowid")
    return rows.groupBy("session_id").applyInPandasWithState(_update, STATE, "events bigint, failures bigint, last_event bigint", "update", GroupStateTimeout.NoTimeout)


def latest_state(updates: DataFrame) -> DataFrame:
    """The last update of each session."""
    return updates.groupBy("session_id").agg(F.max_by(F.struct("events", "failures", "last_event"), "events").alias("s")).select("session_id", "s.*")


def run_available(spark: SparkSession, stream: DataFrame, mode: str | None = None) -> DataFrame:
    """Run a stream over all that is there into a table in the shared folder, and read it.

    foreachBatch appends under the batch's id, so a batch that is tried again replaces itself.
    """
    root = Scratch(spark).path()
    schema = stream.schema

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    mode = mode or ("update" if "last_event" in stream.columns else "append")
    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out").select(*[f.name for f in schema])


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by type and window; late rows beyond the watermark are dropped on a stream only."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select("event_type", F.unix_timestamp(F.col("window.start").cast("timestamp")).alias("start"), "n", "total")
