"""Records: payload projection, updates, deletes, journals, identifiers, merges of reports, model seams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload keys that are columns of a record.
CORE_KEYS = ["data", "hash", "created_at", "updated_at", "id", "text_lemmatized"]
PROMOTED_KEYS = ["user_id", "agent_id", "run_id", "actor_id", "role", "attributed_to", "expiration_date"]


def record(points: DataFrame) -> DataFrame:
    """(id, payload map) as a record: known keys promoted, data as memory, the rest a metadata map, null when empty."""
    known = F.array(*[F.lit(k) for k in CORE_KEYS + PROMOTED_KEYS])
    rest = F.map_filter("payload", lambda k, _: ~F.array_contains(known, k))
    promoted = [F.col("payload")[k].alias(k) for k in ("hash", "created_at", "updated_at", *PROMOTED_KEYS)]
    return points.select("id", F.col("payload")["data"].alias("memory"), *promoted, F.when(F.size(rest) > 0, rest).alias("metadata"))


def merge_metadata(old: Column, patch: Column) -> Column:
    """old with the patch's entries; a null entry removes its key."""
    patch = F.coalesce(patch, F.expr("cast(map() as map<string,string>)"))
    kept = F.map_filter(F.coalesce(old, F.expr("cast(map() as map<string,string>)")), lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, F.map_filter(patch, lambda _, v: v.isNotNull()))


def update(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """memories (id, memory, metadata, ...) after patches (id, memory, metadata): null text keeps the text."""
    p = patches.select("id", F.col("memory").alias("_text"), F.col("metadata").alias("_patch"))
    rows = memories.join(p, "id", "left")
    return rows.withColumn("memory", F.coalesce("_text", "memory")).withColumn("metadata", F.when(F.col("_patch").isNotNull(), merge_metadata(F.col("metadata"), F.col("_patch"))).otherwise(F.col("metadata"))).drop("_text", "_patch")


def delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id").distinct(), "id", "left_anti")


def append_history(history: DataFrame, events: DataFrame, skipped: DataFrame) -> DataFrame:
    """The journal with new events, without those of skipped ids."""
    return history.unionByName(events.join(skipped.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_anti"))


def conversation(messages: Column, text: Column) -> Column:
    """Messages with a text as the assistant's last word; a text alone is the user's; neither is an error."""
    said = lambda role: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    some, full = F.coalesce(F.size(messages) > 0, F.lit(False)), F.coalesce(text != "", F.lit(False))
    error = F.raise_error(F.lit("neither messages nor text")).cast("array<struct<role:string,content:string>>")
    return F.when(some & full, F.concat(messages, said("assistant"))).when(some, messages).when(full, said("user")).otherwise(error)


def logical_id(metadata: Column, own: Column, mapped: Column, raw: Column) -> Column:
    """The benchmark id of a result: from its metadata, itself, the id map, or as it is."""
    return F.coalesce(F.nullif(metadata, F.lit("")), F.nullif(own, F.lit("")), mapped, raw)


def namespace(anchors: DataFrame, bindings: DataFrame) -> DataFrame:
    """(anchor, namespace): the binding of a repository anchor, else a name by its hash."""
    return anchors.join(bindings.select("anchor", "namespace"), "anchor", "left").select("anchor", F.coalesce("namespace", F.concat(F.lit("repo_"), F.sha2("anchor", 256))).alias("namespace"))


def agreed_anchor(candidates: DataFrame) -> DataFrame:
    """(request, anchor, verdict): candidates agree, or the one that is a root decides, or none does."""
    by = candidates.groupBy("request").agg(F.collect_set("anchor").alias("all"), F.collect_set(F.when(F.col("is_root"), F.col("anchor"))).alias("roots"))
    return by.select(
        "request", F.when(F.size("all") == 1, F.col("all")[0]).when(F.size("roots") == 1, F.col("roots")[0]).alias("anchor"),
        F.when(F.size("all") == 0, "none").when(F.size("all") == 1, "agreed").when(F.size("roots") == 1, "root").otherwise("ambiguous").alias("verdict"),
    )


def collection_name(provider: Column, model: Column, dimensions: Column, prefix: str = "memories") -> Column:
    """A table name for an embedding profile; a model's path before the last slash doesn't count."""
    name = F.regexp_replace(F.substring_index(model, "/", -1), r"[^a-zA-Z0-9]+", "_")
    return F.concat_ws("_", F.lit(prefix), F.lower(provider), F.lower(F.regexp_replace(name, r"^_+|_+$", "")), dimensions.cast("string"))


def prompt(text: Column, action: Column) -> Column:
    """Text as the embedder wants it for a query, a document, or neither."""
    return F.concat(F.when(action == "search", "task: search result | query: ").when(action.isin("add", "update"), "title: none | text: ").otherwise("task: sentence similarity | query: "), text)


def iso_time(epoch: Column) -> Column:
    """Epoch seconds as UTC text; null, zero and negative give null."""
    return F.when(epoch > 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def dataset_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """One digest of a dataset whatever its order: the sums of the rows' digests, word by word, and their number; partial sums, so that no task holds rows."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    word = lambda k: F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = rows.select(digest.alias("d")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(word(k)), F.lit(0)).cast("string").alias(f"w{k}") for k in range(8)])
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[f"w{k}" for k in range(8)]), 256).alias("dataset_hash"))


def scale_curve(reports: DataFrame) -> DataFrame:
    """Reports by corpus size; fewer than two sizes are an error."""
    if reports.select("corpus_size").distinct().limit(2).count() < 2:
        raise ValueError("a scale curve needs two corpus sizes")
    return reports.orderBy("corpus_size")


def merge_profiles(reports: DataFrame) -> DataFrame:
    """One row for each profile, best nDCG first; a profile with two results is an error."""
    if not reports.groupBy("name").agg(F.count_distinct("ndcg").alias("n")).where("n > 1").limit(1).isEmpty():
        raise ValueError("conflicting results of one profile")
    return reports.dropDuplicates(["name"]).orderBy(F.desc("ndcg"), "name")


def hypotheses(answers: DataFrame) -> DataFrame:
    """One JSON line for each answer."""
    return answers.select(F.to_json(F.struct("question_id", "hypothesis")).alias("value"))


# --- model seams ------------------------------------------------------------------


def with_embedding(rows: DataFrame, text: str, embed: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 32) -> DataFrame:
    """rows with an embedding column by an embedder that takes lists; any picklable callable."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list = []
            values = pdf[text].fillna("").tolist()
            for k in range(0, len(values), batch):
                out += [[float(x) for x in v] for v in embed(values[k : k + batch])]
            yield pdf.assign(embedding=out)

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


class HashEmbedder:
    """A stand-in without a model: for each token its digest's bytes scaled to [-1, 1], summed, of unit length, rounded to 6."""

    def __init__(self, dimensions: int = 16):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import hashlib
        import math
        import re

        out = []
        for t in texts:
            total = [0.0] * self.dimensions
            for token in re.findall(r"\w+", t.lower()) or [t]:
                raw = hashlib.sha256(token.encode()).digest()
                for j in range(self.dimensions):
                    total[j] += raw[j % 32] / 255.0 * 2.0 - 1.0
            size = math.sqrt(sum(x * x for x in total)) or 1.0
            out.append([round(x / size, 6) for x in total])
        return out


def classified(pairs: DataFrame, classify: Callable[[str, str], str]) -> DataFrame:
    """pairs (text_a, text_b, ...) with raw verdict text by an injected classifier; an exception becomes a null verdict."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for a, b in zip(pdf["text_a"], pdf["text_b"]):
                try:
                    out.append(classify(a, b))
                except Exception:  # the seam fails closed: decide() reads null as classifier_exception
                    out.append(None)
            yield pdf.assign(verdict=out)

    from pyspark.sql.types import StringType, StructField, StructType

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField("verdict", StringType())]))
