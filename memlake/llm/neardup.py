"""Near-duplicate detection by min-max hashing, with links confirmed on full shingle sets.

Each permutation gives two signature values, the least and the greatest hash of the
set, so that a signature of V values takes V / 2 hash evaluations a shingle. Bands
of values make buckets.

1. Documents of equal sets collapse to a class (partial aggregation on a 128-bit
   digest), so that thousands of copies are one row from here on.
2. Classes meet in buckets. Each is compared with the least class of its buckets:
   a star, not all pairs; sets are fetched for those classes alone.
3. Buckets that still hold more than one component are open. Their classes are
   gathered into clusters, split by set size (sets whose sizes differ too much
   can't be linked) and into blocks; blocks that share an open bucket and may hold
   links between different components meet two by two, and a task multiplies the
   blocks' incidence matrices slice by slice and returns a spanning forest of the
   links.

A class therefore meets every class it could be linked with, no group is gathered
in a task, and no pairs of a group are emitted. Nodes are classes, not ids: rows
that share an id but differ in text are documents of their own.

Null and empty texts have an empty set, n_shingles 0 and are linked with nothing.
Rows with a null id keep their n_shingles, have a null component and are kept.
Repeated rows give repeated results. Texts with fewer words than a shingle: one
shingle of all words. Extra columns are ignored; an empty table: an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import LOWER, Scratch, chunks, flat, mix, release, word_bounds, word_hashes
from memlake.llm.graph import components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
VALUES = 144
#: Bands are chosen so that two sets just at the threshold miss each other with at most this probability.
MAX_MISS = 1e-4
BLOCK = 192
#: Columns of an incidence slice.
SLICE = 4096


def bands_for(threshold: float, values: int = VALUES) -> tuple[int, int]:
    """Rows of a band and number of bands: the longest band that still finds what must be found."""
    return max((r, values // r) for r in range(1, 17) if (1 - threshold**r) ** (values // r) <= MAX_MISS)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; words are runs without ASCII white space, A-Z lower-cased."""
    lowered = LOWER[data]
    starts, ends, first = word_bounds(lowered, bounds)
    words = word_hashes(lowered, starts, ends)
    out = []
    if len(words) >= k:
        whole = words[: len(words) - k + 1] * np.uint64(0x9E3779B97F4A7C15)
        for j in range(1, k):
            whole = mix(whole ^ (words[j : len(words) - k + 1 + j] + np.uint64(j))) * np.uint64(0x9E3779B97F4A7C15)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            short = np.full(1, b - a, dtype=np.uint64)
            for w in words[a:b]:
                short = mix(short * np.uint64(0x9E3779B97F4A7C15) ^ w)
            out.append(short)
        else:
            out.append(words[:0])
    return out


class MinMax:
    def __init__(self, rows: int, bands: int, values: int = VALUES):
        state = np.random.RandomState(99)
        self.rows, self.bands = rows, bands
        self.scale = state.randint(0, 2**63, values // 2).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = state.randint(0, 2**63, values // 2).astype(np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Least and greatest hash of each non-empty set under each permutation."""
        every = np.concatenate(sets)
        at = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), 2 * len(self.scale)), dtype=np.uint64)
        for j, (a, b) in enumerate(zip(self.scale, self.shift)):
            h = every ^ b
            h *= a
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            out[:, 2 * j] = np.minimum.reduceat(h, at)
            out[:, 2 * j + 1] = np.maximum.reduceat(h, at)
        return out

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """A 64-bit key for each set and band."""
        values = self.signatures(sets)
        out = np.empty((len(sets), self.bands), dtype=np.uint64)
        for b in range(self.bands):
            key = np.full(len(sets), b + 1, dtype=np.uint64)
            for j in range(b * self.rows, (b + 1) * self.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ values[:, j])
            out[:, b] = key
        return out.view(np.int64)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([mix(s.copy()).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    two = np.array([mix(s ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return one.view(np.int64), two.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat_ = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat_.view(np.int64), pa.int64()))


_NUMBERS = [T.StructField(c, T.LongType()) for c in ("n", "h1", "h2")]
_SET = T.ArrayType(T.LongType())


def sketch(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(id, t, n, h1, h2, keys) of (id, t, text)."""
    rows, bands = bands_for(threshold)

    def run(batches):
        release()
        hasher = MinMax(rows, bands)
        for part in chunks(batches, "text"):
            sets = shingle_sets(*flat(part.column("text")), k)
            h1, h2 = _digests(sets)
            full = [j for j, s in enumerate(sets) if len(s)]
            keys = [np.zeros(0, dtype=np.int64)] * len(sets)
            if full:
                for j, row in zip(full, hasher.keys([sets[j] for j in full])):
                    keys[j] = row
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), _lists(keys)], ["id", "t", "n", "h1", "h2", "keys"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], docs.schema["t"], *_NUMBERS, T.StructField("keys", _SET)]))


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, h1, h2, s) of (id, text)."""

    def run(batches):
        for part in chunks(batches, "text"):
            sets = shingle_sets(*flat(part.column("text")), k)
            h1, h2 = _digests(sets)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), _lists(sets)], ["id", "n", "h1", "h2", "s"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], *_NUMBERS, T.StructField("s", _SET)]))


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix: which sets of left and right reach the similarity, by sliced incidence products."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
    values, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    total = int(sizes[0].sum())
    in_left, in_right = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    in_left[code[:total]], in_right[code[total:]] = True, True
    both = in_left & in_right
    rank = np.cumsum(both) - 1
    owners = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes)]
    parts = []
    for own, c in zip(owners, (code[:total], code[total:])):
        keep = both[c]
        column = rank[c[keep]]
        order = np.argsort(column, kind="stable")
        parts.append((own[keep][order], column[order]))
    shared = np.zeros((len(left), len(right)), dtype=np.int64)
    for low in range(0, int(both.sum()), SLICE):
        width = min(SLICE, int(both.sum()) - low)
        dense = []
        for (own, column), side in zip(parts, (left, right)):
            a, b = np.searchsorted(column, [low, low + width])
            m = np.zeros((len(side), width), dtype=np.float32)
            m[own[a:b], column[a:b] - low] = 1
            dense.append(m)
        shared += (dense[0] @ dense[1].T).astype(np.int64)
    return 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)


def _forest(ids_a, ids_b, comps_a, comps_b, hits: np.ndarray) -> list[tuple]:
    """Of the links between different components so many as join them."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(hits)):
        a, b = find(comps_a[i]), find(comps_b[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids_a[i], ids_b[j]))
    return out


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """members (task, side, id, comp, s), tasks in a row: links (a, b) between sides 0 and 1."""

    def groups(batches):
        held: list[dict] = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("task", "side", "id", "comp")], batch.column("s")):
                if held and held[0][0] != row[0]:
                    yield held
                    held = []
                held.append((*row[:4], np.asarray(row[4].values).view(np.uint64)))
        if held:
            yield held

    def run(batches):
        for held in groups(batches):
            sides = [[r for r in held if r[1] == s] for s in (0, 1)]
            if not sides[1]:  # a block with itself
                sides[1] = sides[0]
            if not sides[0] or len({r[3] for side in sides for r in side}) < 2:
                continue
            hits = linked_pairs([r[4] for r in sides[0]], [r[4] for r in sides[1]], percent)
            links = _forest(*[[r[2] for r in side] for side in sides], *[[r[3] for r in side] for side in sides], hits)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return members.mapInArrow(run, "a bigint, b bigint")


def place(member: DataFrame) -> DataFrame:
    """member (cid, comp, cluster, cell, mk): each class's block of at most about BLOCK classes.

    A large component has blocks of its own: they need not meet each other. The other
    classes of a cluster's cell share one block; where they are too many for it, those
    of one bucket (mk, the least open one of a class) stay together.
    """
    here = ["cluster", "cell"]
    alone = F.col("m") >= BLOCK // 2
    by_comp = member.groupBy(*here, "comp").agg(F.count("*").alias("m")).where(alone).select(*here, "comp", F.col("m").alias("m_comp"))
    rest = member.join(by_comp, [*here, "comp"], "left")
    small = F.col("m_comp").isNull()
    by_bucket = rest.where(small).groupBy(*here, "mk").agg(F.count("*").alias("m_mk"))
    mixed = by_bucket.groupBy(*here).agg(F.sum("m_mk").alias("mixed"))
    rest = rest.join(by_bucket, [*here, "mk"], "left").join(mixed, here, "left")
    crowded = small & (F.col("mixed") > BLOCK)
    tied = crowded & (F.col("m_mk") >= BLOCK // 2)
    parts = lambda m: F.ceil(F.col(m) / BLOCK).cast("bigint")
    split = lambda c, m: F.pmod(F.xxhash64(c), parts(m))
    block = (
        F.when(~small, F.xxhash64(F.lit("comp"), "comp", split("cid", "m_comp"))).when(tied, F.xxhash64(F.lit("bucket"), "mk", split("cid", "m_mk")))
        .when(crowded, F.xxhash64(F.lit("mixed"), split("mk", "mixed"))).otherwise(F.lit(0).cast("bigint"))
    )
    return rest.select("cid", "comp", *here, block.alias("block"))


def block_pairs(open_: DataFrame, placed: DataFrame) -> DataFrame:
    """(cluster, cell, block, cell2, block2): blocks that share an open bucket, of equal or next sizes, and not all of one component."""
    blocks = placed.groupBy("cluster", "cell", "block").agg(F.min("comp").alias("p"), F.max("comp").alias("q"))
    held = open_.select("key", "cid").join(placed, "cid").select("key", "cluster", "cell", "block").distinct().join(blocks, ["cluster", "cell", "block"])
    other = held.select("key", F.col("cell").alias("cell2"), F.col("block").alias("block2"), F.col("p").alias("p2"), F.col("q").alias("q2"))
    order = (F.col("cell2") == F.col("cell") + 1) | ((F.col("cell2") == F.col("cell")) & (F.col("block2") >= F.col("block")))
    differ = ~((F.col("p") == F.col("q")) & (F.col("p2") == F.col("q2")) & (F.col("p") == F.col("p2")))
    return held.join(other, "key").where(order & differ).select("cluster", "cell", "block", "cell2", "block2").distinct()


def _resolve(docs: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """marks (id, t, n, h1, h2) of every row and classes (h1, h2, n, component, root) of every set: the component's least id, and whether the class is its least one."""
    percent = round(100 * threshold)
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), F.col("text").alias("text"))
    marks = scratch.write(sketch(source, k, threshold))
    real = marks.where((F.col("n") > 0) & F.col("id").isNotNull())
    # classes are numbered in the order of their least ids, so that a component's least class holds its least id
    classes = real.groupBy("h1", "h2", "n").agg(F.min("id").alias("id")).orderBy("id", "h1", "h2", "n")
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()))
    own = ["id", "h1", "h2", "n"]

    # buckets of classes
    keyed = scratch.write(real.select(*own, "keys").join(classes, own).select("cid", F.explode("keys").alias("key")).distinct())
    shared = keyed.groupBy("key").agg(F.min("cid").alias("leader"), F.count("*").alias("m")).where("m > 1").drop("m")
    met = scratch.write(keyed.join(shared, "key"))
    scratch.drop(keyed)

    # full sets of the classes that meet another
    wanted = classes.join(met.select("cid").distinct(), "cid", "left_semi")
    texts = source.select("id", "text").join(wanted.select("id").distinct(), "id", "left_semi")
    sets = scratch.write(_full_sets(texts, k).dropDuplicates(own).join(wanted, own).select("cid", "s", "n"))

    # a star in each bucket
    star = met.where("cid <> leader").select("cid", "leader").distinct()
    one, two = sets.select("cid", F.col("s").alias("s1"), F.col("n").alias("n1")), sets.select(F.col("cid").alias("leader"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    common = F.size(F.array_intersect("s1", "s2"))
    fits = F.lit(100) * F.least("n1", "n2") >= F.lit(percent) * F.greatest("n1", "n2")
    near = star.join(one, "cid").join(two, "leader").where(fits).select("cid", "leader", common.alias("x"), (F.col("n1") + F.col("n2")).alias("m"))
    links = scratch.write(near.where(F.lit(100) * F.col("x") >= F.lit(percent) * (F.col("m") - F.col("x"))).select(F.col("cid").alias("a"), F.col("leader").alias("b")))
    first = scratch.write(components(scratch, links))

    # open buckets: more than one component
    known = met.join(first.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "leader", F.coalesce("component", "cid").alias("comp"))
    open_keys = known.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("key")
    open_ = scratch.write(known.join(open_keys, "key", "left_semi"))
    cluster = components(scratch, open_.where("cid <> leader").select("cid", "leader").distinct())
    cell = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    member = open_.groupBy("cid", "comp").agg(F.min("key").alias("mk")).join(cluster.withColumnRenamed("node", "cid"), "cid").withColumnRenamed("component", "cluster")
    member = scratch.write(member.join(sets.select("cid", "n"), "cid").select("cid", "comp", "cluster", cell.alias("cell"), "mk"))
    placed = scratch.write(place(member))
    tasks = scratch.write(block_pairs(open_, placed).withColumn("task", F.xxhash64("cluster", "cell", "block", "cell2", "block2")))
    here = placed.join(tasks.select("task", "cluster", "cell", "block"), ["cluster", "cell", "block"]).select("task", F.lit(0).alias("side"), "cid", "comp")
    apart = tasks.where("cell <> cell2 or block <> block2").select("task", "cluster", F.col("cell2").alias("cell"), F.col("block2").alias("block"))
    there = placed.join(apart, ["cluster", "cell", "block"]).select("task", F.lit(1).alias("side"), "cid", "comp")
    loaded = here.union(there).join(sets.select("cid", "s"), "cid").select("task", "side", F.col("cid").alias("id"), "comp", "s")
    loaded = loaded.repartition("task").sortWithinPartitions("task", "side", "id")

    final = components(scratch, links.union(_block_links(loaded, percent)))
    roots = classes.select(F.col("cid").alias("component"), F.col("id").alias("least"))
    final = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").select("h1", "h2", "n", "cid", F.coalesce("component", "cid").alias("component")).join(roots, "component")
    final = scratch.write(final.select("h1", "h2", "n", F.col("least").alias("component"), (F.col("cid") == F.col("component")).alias("root")))
    for table in (met, sets, links, first, open_, member, placed, tasks, classes):
        scratch.drop(table)
    return marks.drop("keys"), final


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    marks, final = _resolve(docs, shingle_words, threshold)
    hit = (F.col("m.h1") == F.col("f.h1")) & (F.col("m.h2") == F.col("f.h2")) & (F.col("m.n") == F.col("f.n")) & (F.col("m.n") > 0) & F.col("m.id").isNotNull()
    joined = marks.alias("m").join(final.alias("f"), hit, "left")
    component = F.when(F.col("m.id").isNotNull(), F.coalesce("f.component", "m.id"))
    return joined.select(F.col("m.id").alias("doc_id"), F.col("m.n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("m.id") == component, F.lit(True)).alias("kept"))


def _comparable(kind: T.DataType) -> bool:
    """Whether columns of this type can be hashed."""
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of docs, with its own columns: that of the least doc_id and, of rows with that id, of the least digests.

    Rows that are alike in id and text: the one whose columns have the least hash.
    Rows with a null id or without words belong to no group and stay, each of them.
    """
    marks, final = _resolve(docs, shingle_words, threshold)
    root = final.where("root").select("h1", "h2", "n", F.col("component").alias("id"))
    kept = marks.join(root, ["h1", "h2", "n", "id"]).groupBy("h1", "h2", "n", "id").agg(F.min("t").alias("t")).select(F.col("id").alias("__id"), F.col("t").alias("__text")).distinct()
    every = [F.col(f"`{c}`") for c in docs.columns]
    rank = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if _comparable(f.dataType)])
    free = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(~free).select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), F.struct(*every).alias("row"), rank.alias("rank"))
    # the aggregate needs no shuffle beyond the join's
    one = rows.join(kept, ["__id", "__text"], "left_semi").groupBy("__id", "__text").agg(F.min_by("row", "rank").alias("row"))
    return one.select("row.*").unionByName(docs.where(free))
