"""What records own of their confirmations, and what winners take in: lineages as graphs with shared members.

A record's lineage is the graph of its merged ids, theirs, and so on. A record owns
max(1, its count less what all members below it own), each member once however many
ways lead to it; a record with a snapshot of contributions owns what that says; an id
without a record owns what a snapshot says of it, 1 otherwise; what lies on a cycle,
or above one, owns 1. A winner's new count is what it and all members of the union of
its and its losers' lineages own.

Lineages that share members are one connected component. Components are packed into
tasks, and a task folds one component after the other, in topological order: memory is
that of the largest component of at most LIMIT rows. Greater ones are settled by
rounds of joins: closures by doubling, then a round for each level.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.components import components
from memlake.scratch import Scratch

#: Members and merged ids of a component that one task folds.
LIMIT = 500_000
#: Members of a component whose closures are kept as bits.
DENSE = 20_000

MEMBER = "id string, count bigint, merged_ids array<string>, contributions map<string,bigint>, sources array<string>, fresh bigint, identity string"
PATCH = "id string, own bigint, confirmation_count bigint, merged_ids array<string>, merged_sources array<string>, contributions map<string,bigint>, fresh bigint, operation_id string, foreign string"


class Fold:
    """One component: members by id, each (count, merged ids, contributions or None, sources, fresh, identity)."""

    def __init__(self, members: dict[str, tuple]):
        self.members = members
        self.below = {m: sorted({c for c in r[1] if c != m}) for m, r in members.items()}
        #: What snapshots name beside the merged ids: members that are not entered.
        self.named = {m: sorted(set(r[2]) - {m, *self.below[m]}) for m, r in members.items() if r[2]}
        self.hints: dict[str, int] = {}
        for r in members.values():
            for m, n in (r[2] or {}).items():
                self.hints[m] = max(self.hints.get(m, 0), n)
        self.own = {m: max(1, self.hints.get(m, 0)) for r in (self.below, self.named) for children in r.values() for m in children if m not in members}
        self._settle(self._order())
        for m, r in members.items():
            if m not in self.own:  # on a cycle, or above one
                self.own[m] = r[2].get(m, 1) if r[2] else 1

    def _order(self) -> list[str]:
        """Members, those below first, without those on a cycle or above one."""
        above, open_ = defaultdict(list), {}
        for m in self.members:
            known = [c for c in (*self.below[m], *self.named.get(m, ())) if c in self.members]
            open_[m] = len(known)
            for c in known:
                above[c].append(m)
        order = [m for m, n in open_.items() if not n]
        for m in order:
            for parent in above[m]:
                open_[parent] -= 1
                if not open_[parent]:
                    order.append(parent)
        return order

    def _settle(self, order: list[str]) -> None:
        number = {m: k for k, m in enumerate([*self.own, *order])}
        dense, size = len(number) <= DENSE, len(number) // 8 + 1
        values = np.zeros(len(number), dtype=np.int64)
        values[: len(self.own)] = list(self.own.values())
        bits: dict[str, int] = {}  # of each member, all below it
        total: dict[str, int] = {}  # what it and all below it own
        for m in order:
            count, _, snapshot, *_ = self.members[m]
            children, named = self.below[m], self.named.get(m, [])
            deep = [c for c in children if c in self.members and (self.below[c] or c in self.named)]
            if dense:
                mask = 0
                for c in (*children, *named):
                    mask |= 1 << number[c]
                for c in deep:
                    mask |= bits[c]
                bits[m] = mask
            if not deep:
                under = sum(self.own[c] for c in (*children, *named))
            elif len(children) == 1 and not named:
                under = total[children[0]]
            elif dense:
                there = np.unpackbits(np.frombuffer(mask.to_bytes(size, "little"), dtype=np.uint8), bitorder="little")[: len(number)]
                under = int(values @ there)
            else:
                under = sum(self.own[c] for c in self.closure([m]) if c != m)
            self.own[m] = snapshot.get(m, 1) if snapshot else max(1, count - under)
            values[number[m]], total[m] = self.own[m], self.own[m] + under

    def closure(self, roots: list[str], more: dict[str, list[str]] | None = None) -> set[str]:
        """roots, all below them, also by the edges in more, and what the snapshots of all these name."""
        entered, stack, named = set(roots), list(roots), set()
        while stack:
            m = stack.pop()
            named.update(self.named.get(m, ()))
            for c in (*self.below.get(m, ()), *((more or {}).get(m, ()))):
                if c not in entered:
                    entered.add(c)
                    stack.append(c)
        return entered | named

    def patches(self, operations: list[tuple[str, str, str]], chained: bool) -> Iterator[tuple]:
        """Rows of PATCH: one for each winner, one for each operation that meets a member of another identity."""
        losers = defaultdict(list)
        for operation, winner, loser in operations:
            mine = self.members[winner][5] if winner in self.members else None
            strange = sorted(m for m in self.closure([winner, loser]) if m in self.members and mine is not None and self.members[m][5] not in (None, mine))
            if strange:
                yield (winner, None, None, None, None, None, None, operation, strange[0])
            else:
                losers[winner].append(loser)
        for winner, lost in losers.items():
            union = self.closure([winner, *lost], losers if chained else None)
            there = [self.members[m] for m in union if m in self.members]
            own = {m: self.own.get(m, max(1, self.hints.get(m, 0))) for m in union}
            fresh = [r[4] for r in there if r[4] is not None]
            yield (winner, own[winner], max(1, sum(own.values())), sorted(union - {winner}), sorted({s for r in there for s in r[3] or ()}), sorted(own.items()), max(fresh, default=None), None, None)


_ARROW = pa.schema([
    ("id", pa.string()), ("own", pa.int64()), ("confirmation_count", pa.int64()), ("merged_ids", pa.list_(pa.string())), ("merged_sources", pa.list_(pa.string())),
    ("contributions", pa.map_(pa.string(), pa.int64())), ("fresh", pa.int64()), ("operation_id", pa.string()), ("foreign", pa.string()),
])


def _fold(chained: bool, owns: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        members: dict[str, tuple] = {}
        operations: list[tuple[str, str, str]] = []
        at, rows = None, []

        def settled() -> None:
            fold = Fold(members)
            if owns:
                rows.extend((m, fold.own[m], None, None, None, None, None, None, None) for m in members)
            else:
                rows.extend(fold.patches(operations, chained))
            members.clear()
            operations.clear()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows.clear()
            return out

        for part in batches:
            for r in part.to_pylist():
                if r["component"] != at and (members or operations):
                    settled()
                    if len(rows) >= 1000:
                        yield batch()
                at = r["component"]
                if r["loser_id"] is not None:
                    operations.append((r["operation_id"], r["id"], r["loser_id"]))
                else:
                    members[r["id"]] = (r["count"], r["merged_ids"] or [], dict(r["contributions"]) if r["contributions"] is not None else None, r["sources"], r["fresh"], r["identity"])
        if members or operations:
            settled()
        if rows:
            yield batch()

    return run


def _closures(scratch: Scratch, down: DataFrame) -> DataFrame:
    """(m, d): every d that can be reached from m over down (m, d), by doubling."""
    now, n = scratch.write(down.where("m <> d").distinct()), -1
    while True:
        further = now.select("m", F.col("d").alias("via")).join(now.select(F.col("m").alias("via"), "d"), "via").select("m", "d").where("m <> d")
        new = scratch.write(now.union(further).distinct())
        scratch.drop(now)
        now, before, n = new, n, new.count()
        if n == before:
            return now


def _own_by_rounds(scratch: Scratch, members: DataFrame, pairs: DataFrame, hints: DataFrame) -> DataFrame:
    """(id, own) of members and of the ids below them that have no record. pairs: closures of the members."""
    every_at = scratch.path()
    outside = pairs.select(F.col("d").alias("id")).distinct().join(members.select("id"), "id", "left_anti")
    first = outside.join(hints, "id", "left").select("id", F.greatest(F.lit(1), F.coalesce("hint", F.lit(0))).cast("bigint").alias("own"))
    said = members.where("contributions is not null").select("id", F.coalesce(F.element_at("contributions", F.col("id")), F.lit(1)).alias("own"))
    every = scratch.add(first.unionByName(said), every_at)
    open_ = scratch.write(members.join(every.select("id"), "id", "left_anti").select("id", "count"))
    while True:
        under = pairs.join(open_.select(F.col("id").alias("m")), "m", "left_semi").join(every.select(F.col("id").alias("d"), "own"), "d", "left")
        under = under.groupBy("m").agg(F.count_if(F.col("own").isNull()).alias("wait"), F.sum("own").alias("under"))
        ready = open_.join(under, F.col("id") == F.col("m"), "left").where("coalesce(wait, 0) = 0")
        new = scratch.write(ready.select("id", F.greatest(F.lit(1), F.col("count") - F.coalesce("under", F.lit(0))).cast("bigint").alias("own")))
        if new.isEmpty():
            return every.unionByName(open_.select("id", F.lit(1).cast("bigint").alias("own")))
        every = scratch.add(new, every_at)
        open_, before = scratch.write(open_.join(new.select("id"), "id", "left_anti")), open_
        scratch.drop(before)
        scratch.drop(new)


def _patches_by_rounds(scratch: Scratch, members: DataFrame, operations: DataFrame, chained: bool) -> DataFrame:
    down = members.select(F.col("id").alias("m"), F.explode("merged_ids").alias("d")).where("d is not null")
    said = members.where("contributions is not null").select(F.col("id").alias("m"), F.explode(F.map_keys("contributions")).alias("d"))
    hints = members.where("contributions is not null").select(F.explode("contributions").alias("id", "hint")).groupBy("id").agg(F.max("hint").alias("hint"))

    def whole(edges: DataFrame) -> DataFrame:
        """Closures, with what the snapshots of all reached members name."""
        pairs = _closures(scratch, edges)
        reached = pairs.union(members.select(F.col("id").alias("m"), F.col("id").alias("d")))
        return scratch.write(reached.select("m", F.col("d").alias("via")).join(said.select(F.col("m").alias("via"), "d"), "via").select("m", "d").union(pairs).where("m <> d").distinct())

    pairs = whole(down)
    own = scratch.write(_own_by_rounds(scratch, members, pairs, hints))
    null = lambda *names: [F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ", 1) for x in PATCH.split(", ")) if c in names]
    rest = ("confirmation_count", "merged_ids", "merged_sources", "contributions", "fresh")
    if operations is None:
        return members.select("id").join(own, "id").select("id", "own", *null(*rest, "operation_id", "foreign"))
    ends = operations.select("operation_id", F.col("id").alias("winner"), F.explode(F.array("id", "loser_id")).alias("m"))
    touched = ends.select("operation_id", "winner", F.col("m").alias("d")).union(ends.join(pairs, "m").select("operation_id", "winner", "d"))
    named = members.select("id", "identity")
    foreign = touched.join(named.select(F.col("id").alias("winner"), F.col("identity").alias("mine")), "winner").join(named.select(F.col("id").alias("d"), "identity"), "d").where("identity <> mine")
    foreign = scratch.write(foreign.groupBy("operation_id", "winner").agg(F.min("d").alias("foreign")))
    kept = scratch.write(operations.join(foreign.select("operation_id"), "operation_id", "left_anti").select(F.col("id").alias("m"), F.col("loser_id").alias("d")))
    winners = kept.select("m").distinct()
    if chained:
        union = whole(down.union(kept)).join(winners, "m", "left_semi")
    else:
        union = pairs.join(winners, "m", "left_semi").union(kept).union(kept.select("m", F.col("d").alias("via")).join(pairs.select(F.col("m").alias("via"), "d"), "via").select("m", "d"))
    union = union.union(winners.select("m", F.col("m").alias("d"))).distinct()
    rows = union.join(own.select(F.col("id").alias("d"), "own"), "d", "left").join(members.select(F.col("id").alias("d"), "sources", "fresh"), "d", "left")
    n = F.coalesce("own", F.lit(1).cast("bigint"))
    out = rows.groupBy(F.col("m").alias("id")).agg(
        F.max(F.when(F.col("d") == F.col("m"), n)).alias("own"), F.greatest(F.lit(1), F.sum(n)).cast("bigint").alias("confirmation_count"), F.array_sort(F.collect_list(F.when(F.col("d") != F.col("m"), F.col("d")))).alias("merged_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sources", F.array().cast("array<string>")))))).alias("merged_sources"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", n.alias("n"))))).alias("contributions"), F.max("fresh").alias("fresh"),
    )
    refused = foreign.select(F.col("winner").alias("id"), *null("own"), *null(*rest), "operation_id", "foreign")
    return out.select("*", *null("operation_id", "foreign")).union(refused)


def _run(members: DataFrame, operations: DataFrame | None, chained: bool, limit: int) -> DataFrame:
    """Rows of PATCH: of each winner, or of each member where there are no operations."""
    spark = members.sparkSession
    scratch = Scratch(spark)
    members = scratch.write(members)
    pairs = members.select("id", F.explode(F.concat(F.coalesce("merged_ids", F.array().cast("array<string>")), F.coalesce(F.map_keys("contributions"), F.array().cast("array<string>")))).alias("other"))
    none = operations is None
    if not none:
        operations = scratch.write(operations.select("operation_id", F.col("winner_id").alias("id"), "loser_id"))
        pairs = pairs.union(operations.select("id", F.col("loser_id").alias("other")))
    of = scratch.write(components(pairs).select(F.col("node").alias("id"), "component"))
    columns = [F.col(c.split(" ")[0]) for c in MEMBER.split(", ")]
    rows = members.join(of, "id", "left").select(F.coalesce("component", "id").alias("component"), *columns, F.lit(None).cast("string").alias("operation_id"), F.lit(None).cast("string").alias("loser_id"))
    if not none:
        blank = [F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in MEMBER.split(", ")[1:]]
        asked = operations.join(of, "id", "left").select(F.coalesce("component", "id").alias("component"), "id", *blank, "operation_id", "loser_id")
        # components that no operation touches bring nothing
        rows = rows.join(asked.select("component").distinct(), "component", "left_semi").union(asked)
    rows = scratch.write(rows)
    weight = F.sum(1 + F.coalesce(F.size("merged_ids"), F.lit(0)))
    great = scratch.write(rows.groupBy("component").agg(weight.alias("n")).where(F.col("n") > limit).select("component"))
    small = rows.join(great, "component", "left_anti").select(*rows.columns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = small.repartition(parts, "component").sortWithinPartitions("component").mapInArrow(_fold(chained, none), PATCH)
    if great.isEmpty():
        return out
    rest = rows.join(great, "component", "left_semi").select(*rows.columns)
    theirs = rest.where("loser_id is null").select(*columns)
    return out.unionByName(_patches_by_rounds(scratch, scratch.write(theirs), None if none else rest.where("loser_id is not null").select("operation_id", "id", "loser_id"), chained))


def member_rows(records: DataFrame, **names) -> DataFrame:
    """Rows of MEMBER from records; names: an expression for each field that isn't a column of its own name. Missing ones are null."""
    out = []
    for field in MEMBER.split(", "):
        name, kind = field.split(" ", 1)
        e = names.get(name, F.col(name) if name in records.columns else F.lit(None))
        out.append(e.cast(kind).alias(name))
    return records.select(*out)


def owned(members: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, own) of every member (rows of MEMBER, one an id)."""
    return _run(members, None, False, limit).select("id", "own")


def absorbed(members: DataFrame, operations: DataFrame, chained: bool = True, limit: int = LIMIT) -> DataFrame:
    """Rows of PATCH: what each winner becomes by its operations (operation_id, winner_id, loser_id), and the operations that are refused.

    An operation is refused, with the least id of a member that isn't of the winner's
    identity, where the lineages of its winner and loser hold such a member; members
    and winners without an identity refuse nothing. chained: a winner that is another
    one's loser hands on what it takes in.
    """
    return _run(members, operations, chained, limit)
