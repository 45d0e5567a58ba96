"""Session pre-check, audit of distilled memories, and the rendering of memories for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.functions import text as tx
from memlake.operators.filters import active


def skip_sessions(turns: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """(conv_id, skip, reason): a session is skipped only if all it shows is noise.

    Contents count once each. A session that touched files (touched: conv_id) is
    never skipped. One partial aggregate over the turns; a long session costs no
    more than its flags.
    """
    s = tx.strip(F.coalesce("content", F.lit("")))
    t = F.col("s")
    noise = tx.is_acknowledgement(t, True) | tx.is_placeholder(t)
    flags = turns.select("conv_id", s.alias("s")).select("conv_id", (t != "").alias("full"), ((t != "") & ~noise & ~tx.is_raw_log(t, True)).alias("substantive"), ((t != "") & ~noise & tx.is_raw_log(t, True)).alias("log"), tx.has_durable_hint(t).alias("hint"))
    by = flags.groupBy("conv_id").agg(F.bool_or("full").alias("full"), F.bool_or("substantive").alias("substantive"), F.bool_or("log").alias("log"), F.bool_or(F.col("log") & F.col("hint")).alias("durable"))
    if touched is not None:
        by = by.join(touched.select("conv_id", F.lit(True).alias("files")).distinct(), "conv_id", "left")
    else:
        by = by.withColumn("files", F.lit(False))
    reason = (
        F.when(F.coalesce("files", F.lit(False)), "has_touched_files").when(~F.col("full"), "pre_empty_turns").when(F.col("substantive"), "has_substantive_content")
        .when(F.col("durable"), "raw_log_may_contain_durable_fact").when(F.col("log"), "pre_raw_log_only").otherwise("pre_transient_only")
    )
    return by.select("conv_id", reason.startswith("pre_").alias("skip"), reason.alias("reason"))


def audit_reason(s: Column) -> Column:
    """Why a distilled memory, trimmed by the caller, is dropped, or post_accepted; the first rule that matches."""
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "post_empty").when(tx.is_control_tag(s, True), "post_control_tag").when(tx.is_override(s, True), "post_instruction_override")
        .when(tx.is_acknowledgement(s, True), "post_transient_only").when(tx.is_raw_log(s, True), "post_raw_log").when(tx.is_placeholder(s), "post_placeholder_noise").otherwise("post_accepted")
    )


def render_envelope(memories: DataFrame, limit: int) -> DataFrame:
    """Escaped lines of each user's first active memories as one text."""
    tag = F.when(F.col("agent_id") == "global", F.lit("global")).otherwise(F.concat(F.lit("project:"), "agent_id"))
    rows = memories.where(active()).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("doc_id"))).where(F.col("k") <= limit)
    rows = rows.select("user_id", "k", F.concat(F.lit("["), tag, F.lit("] "), tx.xml_escape(F.col("memory"))).alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("k", "line")))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("n"))
