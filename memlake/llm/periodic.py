"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text are in one class at level l where the l words from them on are
the same. A level comes from the one before by the smaller-half strategy: only the
classes that were split off as the smaller parts split others, by the positions
just before theirs, so a position is moved a logarithmic number of times. Classes
are stretches of one array, moved positions swap to the end of their class's
stretch, and a linked list through each class in text order is mended where
positions left it. All of that is done for the positions of a level at once, in
numpy, over many texts together; a position beyond each text, alike to no other,
keeps them apart.

Neighbours of a class of level l that are l words apart are a square whose root is
primitive. Squares of one period at consecutive positions are one run: a stretch
with that smallest period which neither neighbour extends.

Null text has no words, hence no runs; null and repeated ids keep a row each; texts
of any length are read whole (one text is one step, about 150 bytes for each word);
ties are resolved as said at longest(). Extra columns are ignored by find_runs and
kept by collapse_runs; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import WHITE, chunks, fields, flat, release, word_bounds

LEAST_WORDS = 12
#: Bytes of text whose levels are refined together: each level costs a fixed time besides.
REFINE_BYTES = 4 << 20


def words_of(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all rows behind each other, and each row's first (n + 1 values)."""
    data, bounds = flat(col)
    starts, ends, first = word_bounds(data, bounds)
    solid = np.ascontiguousarray(data[~WHITE[data]])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]), first


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... (counts[k] of them), for all k behind each other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _sorted(n: int, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns of numbers below n, sorted by the first, then the next: as one number where it fits."""
    bits = n.bit_length()
    if bits * len(keys) > 63:
        order = np.lexsort(keys[::-1])
        return tuple(k[order] for k in keys)
    one = keys[0].copy()
    for k in keys[1:]:
        one <<= bits
        one |= k
    one.sort()
    return tuple((one >> (bits * (len(keys) - 1 - j))) & ((1 << bits) - 1) for j in range(len(keys)))


class Partition:
    """Classes of positions 0 .. n - 1, in text order within lists, with room for new classes."""

    def __init__(self, labels: np.ndarray):
        self.n = n = len(labels)
        labels, self.perm = _sorted(max(n, int(labels.max(initial=0)) + 1), labels, np.arange(n))  # classes are stretches of perm
        self.place = np.empty(n, dtype=np.int64)
        self.place[self.perm] = np.arange(n)
        cuts = np.flatnonzero(np.diff(labels, prepend=-1))
        self.start, self.size = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.count = len(cuts)
        self.start[: self.count], self.size[: self.count] = cuts, np.diff(cuts, append=n)
        self.of = np.empty(n, dtype=np.int64)
        self.of[self.perm] = np.repeat(np.arange(self.count), self.size[: self.count])
        self.after, self.before = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        self._link(self.perm, self.of[self.perm])

    def _link(self, at: np.ndarray, group: np.ndarray) -> None:
        """Lists through positions that are sorted by group and by place in the text."""
        if not len(at):
            return
        joined = group[1:] == group[:-1]
        self.after[at[:-1]] = np.where(joined, at[1:], -1)
        self.before[at[1:]] = np.where(joined, at[:-1], -1)
        self.after[at[-1]] = self.before[at[0]] = -1

    def members(self, classes: np.ndarray) -> np.ndarray:
        return self.perm[_ranges(self.start[classes], self.size[classes])]

    def split(self, at: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at leave their classes, those of one class with equal ``by`` together. The classes that are not the largest part of one that was split; the positions whose successor in a list is another one now."""
        old = self.of[at]
        many = self.size[old] > 1  # nothing comes from a class of one
        at, by, old = at[many], by[many], old[many]
        if not len(at):
            return np.zeros(0, dtype=np.int64), at
        old, by, at = _sorted(self.n, old, by, at)
        first = np.ones(len(at), dtype=bool)
        first[1:] = (old[1:] != old[:-1]) | (by[1:] != by[:-1])
        group = np.cumsum(first) - 1
        parent, moved = old[first], np.bincount(group)
        # a class of which nothing stays gives its number and place to its first part
        top = np.ones(len(parent), dtype=bool)
        top[1:] = parent[1:] != parent[:-1]
        family = np.cumsum(top) - 1
        total = np.bincount(family, weights=moved).astype(np.int64)
        parents = parent[top]
        rest = self.size[parents] - total
        stays = top & (rest[family] == 0)
        whole = stays & (moved == self.size[parent])  # the class moves as a whole: it is as before
        # lists: chains of neighbours that leave are bridged
        leaves = ~stays[group]
        stay_at = at[stays[group] & ~whole[group]]
        gone, gone_old = at[leaves], old[leaves]
        touched = self._unlink(gone, gone_old)
        # places: what leaves swaps to the end of its class's stretch
        self._to_the_end(gone, gone_old)
        new = np.where(stays, parent, -1)
        fresh = ~stays
        new[fresh] = self.count + np.arange(int(fresh.sum()))
        self.count += int(fresh.sum())
        ends = self.start[parents] + self.size[parents]
        left = moved * fresh
        # a family's parts stand behind each other at the end of the stretch
        upto = np.cumsum(left)
        family_end = upto[np.append(np.flatnonzero(top)[1:] - 1, len(parent) - 1)]
        begin = ends[family] - family_end[family] + (upto - left)
        self.start[new[fresh]], self.size[new[fresh]] = begin[fresh], moved[fresh]
        self.size[parents] -= np.bincount(family, weights=left).astype(np.int64)
        g = group[leaves]
        self.of[gone] = new[g]
        slot = begin[g] + np.arange(len(g)) - np.repeat(np.cumsum(left[fresh]) - left[fresh], left[fresh])
        self.perm[slot], self.place[gone] = gone, slot
        self._link(gone, g)
        # all parts of a class that was split, but its largest, are small
        parts = np.concatenate([new, parents[rest > 0]])
        kin = np.concatenate([family, np.flatnonzero(rest > 0)])
        order = np.lexsort((self.size[parts], kin))
        parts, kin = parts[order], kin[order]
        largest = np.append(kin[1:] != kin[:-1], True)
        return parts[~largest], np.concatenate([gone, touched, stay_at])

    def _unlink(self, gone: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Takes positions (by class, then text order) out of their lists; those before them, which stay, have other successors now."""
        if not len(gone):
            return gone
        _, gone = _sorted(self.n, group, gone)
        chain = np.ones(len(gone), dtype=bool)
        chain[1:] = self.after[gone[:-1]] != gone[1:]
        first = np.flatnonzero(chain)
        last = np.append(first[1:] - 1, len(gone) - 1)
        a, b = self.before[gone[first]], self.after[gone[last]]
        self.after[a[a >= 0]] = b[a >= 0]
        self.before[b[b >= 0]] = a[b >= 0]
        return a[a >= 0]

    def _to_the_end(self, gone: np.ndarray, old: np.ndarray) -> None:
        if not len(gone):
            return
        first = np.flatnonzero(np.diff(old, prepend=-1))
        classes, n = old[first], np.diff(first, append=len(old))
        edge = self.start[classes] + self.size[classes] - n
        tail = _ranges(edge, n)
        beyond = self.place[gone] - np.repeat(edge, n)
        inner = beyond < 0  # not yet in the tail
        leaving = np.zeros(len(tail), dtype=bool)
        leaving[(np.repeat(first, n) + beyond)[~inner]] = True
        hole = self.place[gone[inner]]  # by class, as the tails
        stay = self.perm[tail[~leaving]]
        self.perm[hole], self.place[stay] = stay, hole


class _Waiting:
    """Neighbours by their distance, until the level that makes a square of them."""

    def __init__(self, part: Partition, most: int):
        self.part, self.most, self.by_distance = part, most, {}

    def add(self, at: np.ndarray, level: int) -> None:
        at = at[self.part.after[at] >= 0]
        far = self.part.after[at] - at
        some = (far >= level) & (far <= self.most)
        if not some.any():
            return
        far, at = _sorted(self.part.n, far[some], at[some])
        cut = np.flatnonzero(np.diff(far, prepend=-1)).tolist()
        for low, high in zip(cut, [*cut[1:], len(at)]):
            self.by_distance.setdefault(int(far[low]), []).append(at[low:high])

    def at(self, level: int) -> np.ndarray | None:
        """Those whose distance is still the level; what is not is dropped."""
        if level not in self.by_distance:
            return None
        at = np.unique(np.concatenate(self.by_distance[level]))
        at = at[self.part.after[at] - at == level]
        self.by_distance[level] = [at]
        if not len(at):
            del self.by_distance[level]
            return None
        return at


def _ripple(part: Partition, row: np.ndarray, edge: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Levels at once where each small class is a single position, edge: at level + s the position s before it is single too.

    Such a position leaves its class at one end, and nothing else changes, up to
    the first that leaves two neighbours behind, which are new to each other. The
    positions, the last of those that go on, and the number of levels.
    """
    at = edge[:, None] - 1 - np.arange(most)
    there = at >= 0
    at = np.maximum(at, 0)
    after, before = part.after[at], part.before[at]
    there &= (row[at] == row[edge][:, None]) & ((after >= 0) | (before >= 0))
    there = np.logical_and.accumulate(there, axis=1)
    bridge = (there & (before >= 0) & (after >= edge[:, None])).any(axis=0)
    if bridge.any():
        most = int(np.argmax(bridge)) + 1
    at, there = at[:, :most], there[:, :most]
    return at[there], at[there[:, -1], -1], most


def squares(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of all squares of primitive root in each row. words: a number for each word; row r is words[first[r] : first[r + 1]]."""
    rows = np.diff(first)
    n = int(rows.sum()) + len(rows)
    row = np.repeat(np.arange(len(rows)), rows + 1)
    ends = np.cumsum(rows + 1) - 1  # the position beyond each row
    symbol = np.empty(n, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    symbol[inside] = words
    symbol[ends] = -1
    # equal words of one row: a number of the pair
    part = Partition(row * (int(words.max(initial=-1)) + 2) + symbol + 1)
    most = int(rows.max(initial=0)) // 2
    waiting = _Waiting(part, most)
    waiting.add(np.arange(n), 1)
    found: list[tuple[np.ndarray, int]] = []
    small, level, reach = np.arange(part.count), 1, 8
    while level <= most:
        if (at := waiting.at(level)) is not None:
            found.append((at, level))
            del waiting.by_distance[level]
        if not len(small):
            if not waiting.by_distance:
                break
            level = min(waiting.by_distance)
            continue
        splitters = part.members(small)
        step = 1
        if len(splitters) == len(small):  # single positions
            step = min(reach, most - level + 1)
            step = next((k for k in range(1, step) if waiting.at(level + k) is not None), step)
        if step > 1:
            leaving, edge, step = _ripple(part, row, splitters, step)
            _, changed = part.split(leaving, leaving)
            small = part.of[edge]
            reach = min(1024, 2 * reach) if step == reach else max(8, 2 * step)
        else:
            by = part.of[splitters]
            back = (splitters > 0) & inside[np.maximum(splitters - 1, 0)]
            small, changed = part.split(splitters[back] - 1, by[back])
        level += step
        waiting.add(changed, level)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, period = np.concatenate([x for x, _ in found]), np.repeat([p for _, p in found], [len(x) for x, _ in found])
    return at - row[at], period


def runs(words: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of the runs of at least ``least`` words, by row, start, period."""
    at, period = squares(words, first)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    begin = np.ones(len(at), dtype=bool)
    begin[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    begins = np.flatnonzero(begin)
    start, period, length = at[begins], period[begins], np.diff(begins, append=len(at)) - 1 + 2 * period[begins]
    long = length >= least
    start, period, length = start[long], period[long], length[long]
    row = np.searchsorted(first, start, side="right") - 1
    start = start - first[row]
    order = np.lexsort((period, start, row))
    return row[order], start[order], length[order], period[order]


def dropped(first: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """True for words that a run holds after its first period."""
    edge = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    np.add.at(edge, first[row] + start + period, 1)
    np.add.at(edge, first[row] + start + length, -1)
    return np.cumsum(edge[:-1]) > 0


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ARROW_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(part: pa.RecordBatch, least: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Runs of each row, text without what they repeat (words joined by one space), number of words."""
    words, first = words_of(part.column("text"))
    coded = words.dictionary_encode()
    row, start, length, period = runs(np.asarray(coded.indices, dtype=np.int64), first, least)
    bounds = np.searchsorted(row, np.arange(len(first)))
    values = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_ARROW_RUNS))
    found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
    gone = dropped(first, row, start, length, period)
    kept = words.filter(pa.array(~gone)) if gone.any() else words
    left = np.concatenate([[0], np.cumsum(~gone)])[first]
    lines = pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept)
    return found, pc.binary_join(lines, " "), np.diff(first)


def find_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs by start and period, and the words that no run repeats, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        for part in chunks(batches, "text", REFINE_BYTES):
            found, text, n = _found(part, least)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), found, text], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, fields(docs.select("doc_id").schema, f"n_words bigint, runs {_RUNS}, collapsed string"))


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs with the texts that hold runs replaced by what is left without the repetitions; other texts stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        for part in chunks(batches, "text", REFINE_BYTES):
            found, text, _ = _found(part, least)
            some = pc.greater(pc.list_value_length(found), 0)
            new = pc.if_else(some, text, part.column("text").cast(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("row"), new], ["row", "text"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    new = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return new.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """A row of numbers and hashes for each row of find_runs. The longest run: ties go to the smallest start, then period."""

    best = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)))
    top = F.get(best, 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"), lines.alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the checksum of their ids, become periodic from some word on. A null id stays as it is."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    turned = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), turned).otherwise(F.col("text")).alias("text"))
