"""Consolidation: candidate pairs, winners, plans, idempotent application, lineage, and re-indexing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from memlake.functions import text as tx
from memlake.operators import lineage, similarity
from memlake.operators.components import components
from memlake.operators.filters import active
from memlake.scratch import Scratch

RECENCY_MARGIN = 60
AUTHORITY = {"agent_explicit": 2, "session_distillation": 1}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def knn_edges(vectors: DataFrame, top_k: int = 10, threshold: float = 0.85, seeds: Column | None = None, block: int = similarity.BLOCK) -> DataFrame:
    """(seed_id, neighbor_id, score): each seed's top_k neighbours of its own identity by cosine, at or above the threshold.

    vectors: id, identity, embedding. Exact; pivots prune what can't reach the threshold.
    """
    return similarity.Join(vectors, threshold, seeds, block).edges(top_k)


def best_pairs(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair: the best score, ties by seed, then neighbour."""
    pair = [F.least("seed_id", "neighbor_id").alias("a"), F.greatest("seed_id", "neighbor_id").alias("b")]
    best = F.min_by(F.struct("seed_id", "neighbor_id", "score"), F.struct((-F.col("score")).alias("s"), "seed_id", "neighbor_id"))
    return edges.select(*pair, "seed_id", "neighbor_id", "score").groupBy("a", "b").agg(best.alias("e")).select("a", "b", "e.*")


def preclassify(id_a: Column, id_b: Column, text_a: Column, text_b: Column) -> Column:
    """A relation that needs no model, or null."""
    x, y = tx.normalised(text_a), tx.normalised(text_b)
    return F.when(id_a == id_b, "DISTINCT").when((x == "") | (y == ""), "DISTINCT").when(x == y, "EQUIVALENT")


def confirmations(c: Column) -> Column:
    """A usable count: a missing or negative one is 1."""
    return F.when(c.isNotNull() & (c >= 0), c).otherwise(1)


def arbitrate(pairs: DataFrame, margin: int = RECENCY_MARGIN) -> DataFrame:
    """winner_id, loser_id, reason of pairs with columns id, source, last_confirmed_at, confirmation_count, created_at suffixed _a, _b.

    Symmetric in a and b: recency by more than the margin, authority, confirmations, earlier creation, smaller id.
    """
    f = lambda n, s: F.col(f"{n}_{s}")
    rank = lambda s: F.when(f("source", s) == "agent_explicit", 2).when(f("source", s) == "session_distillation", 1).otherwise(0)
    gap = f("last_confirmed_at", "a") - f("last_confirmed_at", "b")
    conf = [confirmations(f("confirmation_count", s)) for s in "ab"]
    created = [F.coalesce(f("created_at", s), F.lit(0)) for s in "ab"]
    rules = [
        ("recency", F.abs(gap) > margin, gap > 0), ("authority", rank("a") != rank("b"), rank("a") > rank("b")), ("confirmation", conf[0] != conf[1], conf[0] > conf[1]),
        ("stability_created_at", created[0] != created[1], created[0] < created[1]),
    ]
    reason, first = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(True))
    for name, decides, a_wins in rules:
        reason, first = reason.when(F.coalesce(decides, F.lit(False)), name), first.when(F.coalesce(decides, F.lit(False)), a_wins)
    reason, first = reason.otherwise("stability_id"), first.otherwise(f("id", "a") <= f("id", "b"))
    return pairs.select("*", F.when(first, f("id", "a")).otherwise(f("id", "b")).alias("winner_id"), F.when(first, f("id", "b")).otherwise(f("id", "a")).alias("loser_id"), reason.alias("reason"))


def version(updated: Column, content_hash: Column, status: Column) -> Column:
    """A fingerprint of what a change of the record changes."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in (updated, content_hash, status)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def operation_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256), 1, 20)


#: Edges of a component that one task takes in order, and of a greater component at once.
CHUNK = 500_000


def _in_order(batches):
    """Edges, in order within each component, that no edge taken before them forbids; a flag says which ones are taken."""
    dead, at = set(), None
    for batch in batches:
        of, a, b, lost = (batch.column(c).to_pylist() for c in ("component", "a", "b", "loser_id"))
        taken = []
        for c, x, y, loser in zip(of, a, b, lost):
            if c != at:
                dead.clear()
                at = c
            taken.append(x not in dead and y not in dead)
            if taken[-1]:
                dead.add(loser)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], [*batch.schema.names, "taken"])


def first_edges(decided: DataFrame, rounds: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Edges that take effect when taken in order (a, b): an edge whose member was superseded before is skipped.

    decided: a, b, winner_id, loser_id. An edge waits only for earlier open edges that
    may supersede one of its members. Rounds of joins settle all edges that wait for
    none, the bulk of any table. What is left are chains; those without a common
    member are components, which are packed into tasks, and a task takes the edges of
    one component after the other in order. A component of more than ``chunk`` edges
    is cut by order into chunks, one after the other. A chain may be of any length;
    memory is bounded by the chunk.
    """
    spark = decided.sparkSession
    scratch = Scratch(spark)
    columns = decided.columns
    won_at = scratch.path()
    left = scratch.write(decided.withColumn("key", F.struct("a", "b")))
    taken = scratch.add(left.limit(0), won_at)
    for _ in range(rounds):
        if left.isEmpty():
            return taken.select(*columns)
        ends = left.select("key", F.explode(F.array("a", "b")).alias("m"))
        threat = left.groupBy(F.col("loser_id").alias("m")).agg(F.min("key").alias("first"))
        ready = ends.join(threat, "m", "left").groupBy("key").agg(F.bool_and(F.col("first").isNull() | (F.col("key") <= F.col("first"))).alias("ok")).where("ok").select("key")
        won = scratch.write(left.join(ready, "key", "left_semi").select(*left.columns))
        taken = scratch.add(won, won_at)
        dead = won.groupBy(F.col("loser_id").alias("m")).agg(F.min("key").alias("at"))
        hit = ends.join(dead, "m").where("key > at").select("key").distinct()
        left, before = scratch.write(left.join(won.select("key"), "key", "left_anti").join(hit, "key", "left_anti").select(*left.columns)), left
        scratch.drop(before)
        scratch.drop(won)
    if left.isEmpty():
        return taken.select(*columns)
    of = components(left.select("a", "b"))
    rows = scratch.write(left.join(of.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")).select(*left.columns, "component"))
    sizes = scratch.write(rows.groupBy("component").agg(F.count("*").alias("n")))
    schema = T.StructType([*rows.schema.fields, T.StructField("taken", T.BooleanType())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = rows.join(sizes.where(F.col("n") <= chunk).select("component"), "component", "left_semi").select(*rows.columns)
    found = small.repartition(parts, "component").sortWithinPartitions("component", "a", "b").mapInArrow(_in_order, schema).where("taken")
    taken = scratch.add(found.select(*left.columns), won_at)
    great = rows.join(sizes.where(F.col("n") > chunk).select("component"), "component", "left_semi").select(*rows.columns)
    n = great.count()
    if not n:
        return taken.select(*columns)
    chunks = -(-n // chunk)
    ranged = scratch.write(great.repartitionByRange(chunks, "component", "a", "b").withColumn("chunk", F.spark_partition_id()))
    gone_at, gone = scratch.path(), None
    for k in range(chunks):
        mine = ranged.where(F.col("chunk") == k).drop("chunk")
        if gone is not None:
            for c in ("a", "b"):
                mine = mine.join(gone, F.col(c) == F.col("m"), "left_anti")
        found = scratch.write(mine.select(*rows.columns).repartition(1).sortWithinPartitions("component", "a", "b").mapInArrow(_in_order, schema).where("taken").select(*left.columns))
        taken = scratch.add(found, won_at)
        gone = scratch.add(found.select(F.col("loser_id").alias("m")), gone_at)
    return taken.select(*columns)


def apply_supersede(memories: DataFrame, plan: DataFrame) -> DataFrame:
    """Memories after a plan (loser_id, winner_id, relation): losers superseded, winners of equal pairs confirmed; applying twice changes nothing."""
    lost = plan.groupBy(F.col("loser_id").alias("id")).agg(F.min("winner_id").alias("superseded_by"))
    gain = plan.where("relation = 'EQUIVALENT'").groupBy(F.col("winner_id").alias("id")).agg(F.array_sort(F.collect_set("loser_id")).alias("merged_ids"))
    rows = memories.join(lost, "id", "left").join(gain, "id", "left")
    return rows.withColumn("old_status", F.col("status")).withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")))


def own_counts(members: DataFrame) -> DataFrame:
    """(id, own): each member's own confirmations, its count less what all members below it own, at least 1. members: id, count, merged_ids."""
    return lineage.owned(lineage.member_rows(members.select("id", "count", "merged_ids")))


def lineage_counts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(winner_id, confirmation_count, merged_ids, freshness) after winners take in their losers, as these are.

    members: id, count, merged_ids, freshness; edges: winner_id, loser_id. The count
    is what the winner and every member of the union own, each member once however
    many of the records held it.
    """
    rows = lineage.member_rows(members, fresh=F.col("freshness"))
    merged = lineage.absorbed(rows, edges.select(F.lit("").alias("operation_id"), "winner_id", "loser_id"), chained=False)
    return merged.select(F.col("id").alias("winner_id"), "confirmation_count", "merged_ids", F.col("fresh").cast(members.schema["freshness"].dataType).alias("freshness"))


def new_only(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates without an existing, active memory of their identity and equal hash or equal trimmed text.

    Two anti-joins on hashes instead of one on a disjunction, so that both are equi-joins and no text is shuffled twice.
    """
    live = existing.where(active())
    keyed = candidates.withColumn("_t", F.md5(tx.strip(F.col("memory"))))
    by_hash = keyed.join(live.select("user_id", "agent_id", F.col("hash")).distinct(), ["user_id", "agent_id", "hash"], "left_anti")
    texts = live.select("user_id", "agent_id", F.md5(tx.strip(F.col("memory"))).alias("_t")).distinct()
    return by_hash.join(texts, ["user_id", "agent_id", "_t"], "left_anti").drop("_t")


def version_check(observed: DataFrame, current: DataFrame) -> DataFrame:
    """Whether each observed (batch, id, version) still holds: ok, missing, superseded or changed."""
    now = current.select("id", F.col("version").alias("now"), F.col("status").alias("now_status"), F.lit(True).alias("there"))
    why = F.when(F.col("there").isNull(), "missing").when(~active("now_status"), "superseded").when(~F.col("now").eqNullSafe(F.col("version")), "changed").otherwise("ok")
    return observed.join(now, "id", "left").select("batch", "id", why.alias("verdict"))


def reindex_classes(source: DataFrame, target: DataFrame) -> DataFrame:
    """new, skipped, recompute (equal payload, other text embedding input) or conflicted, for each source row; equality is null-safe by field."""
    t = target.select("id", F.col("payload").alias("t_payload"), F.col("profile").alias("t_profile"), F.lit(True).alias("there"))
    why = F.when(F.col("there").isNull(), "new").when(~F.col("payload").eqNullSafe(F.col("t_payload")), "conflicted").when(~F.col("profile").eqNullSafe(F.col("t_profile")), "recompute").otherwise("skipped")
    return source.join(t, "id", "left").select("id", why.alias("action"))


def prune_link_rows(links: DataFrame, removed: DataFrame) -> DataFrame:
    """Links (entity_id, id) without those to removed memories, each once; nothing is gathered by entity."""
    return links.select("entity_id", "id").join(removed.select("id").distinct(), "id", "left_anti").select("entity_id", "id").distinct()


def prune_links(entities: DataFrame, removed: DataFrame) -> DataFrame:
    """Entities without links to removed memories; an entity without links goes."""
    links = entities.select("entity_id", F.explode("linked_memory_ids").alias("id"))
    return prune_link_rows(links, removed).groupBy("entity_id").agg(F.array_sort(F.collect_list("id")).alias("linked_memory_ids"))
