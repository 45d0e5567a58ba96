"""Exact similarity joins of vectors by cosine, with pairs pruned by pivots.

Angles between vectors obey the triangle inequality. Pivots are far-apart vectors of
a bounded sample, numbered so that near ones follow each other; every vector lies in
the cell of its nearest pivot. A vector can be within the angle t of a member of a
cell whose angles to the pivot are from l to h only if its own is from l - t to h + t,
and at most 2 t further than that to its own pivot.

The vectors of an identity are laid out by cell, and by quantiles of the angle where a
cell holds more than a block (equal angles: by hash), and cut into parts of bounded
bytes, about 16 of them in a large identity. Two parts whose cells may reach each other
are a tile; a vector goes once to each tile of its part, whatever the number of cells.
A tile's task cuts the members into runs of one cell and at most a block, and compares
each run with the seeds that the bounds leave it, or all with all where they leave more
than half. Of a seed's neighbours a task holds the best alone. So nothing within the
threshold is lost, and no group, batch or product outgrows a tile.

Null vectors, and those with null or non-finite components, take no part, nor do
those of another dimension than most of the sample, nor zero vectors. Null ids take
no part; repeated ids are separate vectors that aren't each other's neighbours. Null
identities equal none, not even each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from memlake.scratch import Scratch

#: Vectors that pivots are chosen from (a bounded sample, by hash), and how many pivots at most.
SAMPLE, PIVOTS = 4096, 256
#: Members of a run of a cell, and seeds that are compared with it at once.
BLOCK = 1024
#: Bytes of the vectors of a part, and pairs above the threshold that a task holds before it keeps the best of them.
PART_BYTES, HELD = 16 << 20, 1 << 20
#: What angles of rounded products may be off by, and how far below the threshold a score is still rounded to it.
_SLACK, _ROUNDED = 1e-6, 5e-7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def pivots_of(sample: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors of the sample, each the farthest from those before it."""
    chosen = [sample[0]]
    near = sample @ sample[0]
    while len(chosen) < min(most, len(sample)) and near.min() < 1 - 1e-12:
        chosen.append(sample[int(near.argmin())])
        near = np.maximum(near, sample @ chosen[-1])
    left, chain = np.stack(chosen), []
    at = 0
    while len(left):  # near ones follow each other
        chain.append(left[at])
        left = np.delete(left, at, axis=0)
        at = int((left @ chain[-1]).argmax()) if len(left) else 0
    return np.stack(chain)


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit vectors in double precision, of the bytes of floats or doubles."""
    flat = b"".join(column.to_pylist())
    return _unit(np.frombuffer(flat, f"f{len(flat) // (len(column) * dim)}").reshape(-1, dim).astype(float))


def _comparisons(x: np.ndarray, own: np.ndarray, cell: np.ndarray, angle: np.ndarray, centres: np.ndarray, reach: float, block: int):
    """(rows of x, slice of members) that may be within reach. Members are in order of cell and angle; own: the angles of x to their pivots."""
    n = len(cell)
    turns = np.flatnonzero((cell[1:] != cell[:-1]) | ((angle[1:] > reach / 2) != (angle[:-1] > reach / 2))) + 1
    bounds = [0, *turns.tolist(), n]
    starts = np.concatenate([np.arange(a, b, block) for a, b in zip(bounds, bounds[1:])])
    ends = np.append(starts[1:], n)
    low, high = angle[starts], angle[ends - 1]
    held, of = np.unique(cell[starts], return_inverse=True)
    for first in range(0, len(x), BLOCK):
        some = np.arange(first, min(first + BLOCK, len(x)))
        if len(x) * n > block * block:
            far = _angles(x[some], centres[held])[:, of]
            reached = (far >= low - reach) & (far <= high + reach) & (far - own[some, None] <= 2 * reach)
            if reached.sum(axis=0) @ (ends - starts) <= len(some) * n / 2:
                for k in np.flatnonzero(reached.any(axis=0)):
                    yield some[reached[:, k]], slice(starts[k], ends[k])
                continue
        for a in range(0, n, block):
            yield some, slice(a, min(a + block, n))


def _first_copies(ids: np.ndarray, vectors: list[bytes], most: int) -> np.ndarray:
    """Rows in order of id, of equal vectors those of the first ids alone: no seed can have others of them among its best."""
    order, kept, seen = np.argsort(ids, kind="stable"), [], {}
    for k in order.tolist():
        n, last = seen.get(vectors[k], (0, None))
        n += ids[k] != last
        seen[vectors[k]] = n, ids[k]
        if n <= most:
            kept.append(k)
    return np.array(kept, int)


class Join:
    """Cells, parts and tiles of one table: id, identity, embedding, and whether a row is a seed."""

    def __init__(self, vectors: DataFrame, threshold: float, seeds: Column | None = None, block: int = BLOCK, pivots: int = PIVOTS):
        self.spark, self.threshold, self.block = vectors.sparkSession, threshold, block
        self.reach = float(np.arccos(np.clip(threshold - _ROUNDED, -1.0, 1.0))) + _SLACK
        self.scratch = Scratch(self.spark)
        value = F.transform("embedding", lambda x: x.cast("double"))
        fine = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
        clean = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("identity"), value.alias("v"), F.coalesce(seeds if seeds is not None else F.lit(True), F.lit(False)).alias("seed")).where(fine)
        picked = clean.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        self.empty = not picked
        if self.empty:
            return
        dim = Counter(len(r.v) for r in picked).most_common(1)[0][0]
        # about one pivot for an eighth of a block of the largest identity, so that runs don't get too small
        largest = clean.where("identity IS NOT NULL").groupBy("identity").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        self.centres = pivots_of(_unit(np.array([r.v for r in picked if len(r.v) == dim])), int(np.clip(8 * largest // block, 1, pivots)))
        self.most = max(1, PART_BYTES // (8 * dim))
        self.dim, centres = dim, self.centres
        # what fits into floats travels as floats
        kind = "f4" if isinstance(vectors.schema["embedding"].dataType.elementType, (T.FloatType, T.ShortType, T.ByteType)) else "f8"

        def place(batches):
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                angles = _angles(_unit(x), centres)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(x)), cell]), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], ["row", "cell", "angle", "vec"])

        row = clean.where(F.size("v") == dim).select(F.struct("id", "identity", "seed").alias("row"), "v")
        placed = row.mapInArrow(place, f"row {row.schema['row'].dataType.simpleString()}, cell int, angle double, vec binary")
        self.rows = self.scratch.write(placed.select(F.col("row.id").alias("id"), F.when(F.col("row.identity").isNotNull(), F.xxhash64(F.col("row.identity").cast("string"))).alias("g"), F.col("row.seed").alias("seed"), "cell", "angle", "vec"))
        self._parts()
        self._tiles()

    def _parts(self) -> None:
        """homes: rows with the part they are in; self.parts: (g, part, cell, low, high, asks); asks: 0 where no row is a seed."""
        cell, shell, unit = ["g", "cell"], ["g", "cell", "shell"], min(self.block, self.most)
        steps = [k / 64 for k in range(1, 64)]
        rows = self.rows.where("g IS NOT NULL")
        cuts = rows.groupBy(*cell).agg(F.percentile_approx("angle", steps, 10_000).alias("q"), F.ceil(F.count("*") / unit).cast("int").alias("shells")).where("shells > 1")
        # as many bounds as the cell has blocks, 63 at most
        some = F.filter(F.col("q"), lambda x, i: ((i + 1) % F.greatest(F.lit(1), F.floor(F.lit(64) / F.col("shells")))) == 0)
        cuts = self.scratch.write(cuts.select(*cell, F.array_distinct(some).alias("cuts")))
        inner = F.when(F.col("cuts").isNull(), 0).otherwise(F.aggregate("cuts", F.lit(0), lambda acc, c: acc + F.when(F.col("angle") > c, 1).otherwise(0)))
        homes = rows.join(cuts, cell, "left").withColumn("shell", inner.cast("int")).drop("cuts")
        shells = homes.groupBy(*shell).agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("members"), F.count_if("seed").alias("asks"))
        before = Window.partitionBy("g").orderBy("cell", "shell").rowsBetween(Window.unboundedPreceding, -1)
        n = F.sum("members").over(Window.partitionBy("g"))  # a row for each shell: 64 for each pivot at most
        side = F.least(F.greatest(F.ceil(n / 16), F.lit(4 * self.block)), F.lit(self.most))
        layout = self.scratch.write(shells.select("*", F.coalesce(F.sum("members").over(before), F.lit(0)).alias("start"), side.alias("side"), F.ceil(F.col("members") / unit).cast("int").alias("subs")))
        part = F.floor((F.col("start") + F.col("sub") * F.col("members") / F.col("subs")) / F.col("side")).cast("int")
        self.homes = homes.join(layout.select(*shell, "start", "members", "side", "subs"), shell).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs"))).select("g", part.alias("part"), "id", "seed", "cell", "angle", "vec")
        subs = layout.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        self.parts = subs.groupBy("g", part.alias("part"), "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("asks").alias("asks"))

    def _tiles(self) -> None:
        """(g, a, b): parts of which a's seeds may be within reach of b's vectors."""
        reach, gaps = self.reach, _angles(self.centres, self.centres)

        def near(batches):
            for b in batches:
                low, high, cell = ([b.column(f"{c}_{s}").to_numpy() for s in "ab"] for c in ("low", "high", "cell"))
                gap = gaps[cell[0], cell[1]]
                least = np.max([gap - high[0] - high[1], low[0] - gap - high[1], low[1] - gap - high[0], gap / 2 - high[0], gap / 2 - high[1]], axis=0)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(least <= reach)) for c in ("g", "a", "b")], ["g", "a", "b"])

        several = self.parts.groupBy("g").agg((F.max("part") > 0).alias("several"))
        parts = self.scratch.write(self.parts.join(several, "g"))
        a, b = (parts.where("several").where(F.lit(s == "b") | (F.col("asks") > 0)).select("g", F.col("part").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "low", "high")]) for s in "ab")
        alone = parts.where("NOT several AND asks > 0").select("g", F.lit(0).alias("a"), F.lit(0).alias("b"))
        self.tiles = self.scratch.write(a.join(b, "g").mapInArrow(near, "g bigint, a int, b int").union(alone).distinct())

    def _meet(self, f, schema: str) -> DataFrame:
        """f of the seeds and the members of each tile."""
        asked = self.homes.where("seed").withColumnRenamed("part", "a").join(self.tiles, ["g", "a"])
        asked = asked.select(*[F.col(c).alias(f"s_{c}") for c in ("g", "a", "b", "id", "angle", "vec")])  # names apart: both sides come from one table
        members = self.homes.withColumnRenamed("part", "b").join(self.tiles, ["g", "b"]).select("g", "a", "b", "id", "cell", "angle", "vec")
        return asked.groupBy("s_g", "s_a", "s_b").cogroup(members.groupBy("g", "a", "b")).applyInArrow(f, schema)

    def compared(self) -> DataFrame:
        """(pairs, all_pairs): how many pairs of seed and vector are compared, and how many there are within identities."""
        if self.empty:
            return self.spark.createDataFrame([(0, 0)], "pairs bigint, all_pairs bigint")
        centres, reach, block, dim = self.centres, self.reach, self.block, self.dim

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            total = 0
            if left.num_rows and right.num_rows:
                right = right.sort_by([("cell", "ascending"), ("angle", "ascending")])
                for rows, run in _comparisons(_vectors(left.column("s_vec"), dim), np.asarray(left.column("s_angle")), np.asarray(right.column("cell")), np.asarray(right.column("angle")), centres, reach, block):
                    total += len(rows) * int(run.stop - run.start)
            return pa.table({"pairs": pa.array([total], pa.int64())})

        every = self.rows.groupBy("g").agg((F.when(F.col("g").isNull(), 1).otherwise(F.count("*")) * F.count_if("seed")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("all_pairs"))
        return self._meet(count, "pairs bigint").agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("pairs")).crossJoin(every)

    def edges(self, top_k: int) -> DataFrame:
        """(seed_id, neighbor_id, score): the top_k of each seed at or above the threshold, score rounded to six places; ties by id."""
        schema = "seed_id bigint, neighbor_id bigint, score double"
        if self.empty:
            return self.spark.createDataFrame([], schema)
        centres, reach, block, threshold, dim = self.centres, self.reach, self.block, self.threshold, self.dim

        def match(left: pa.Table, right: pa.Table) -> pa.Table:
            out = pa.schema([("seed_id", pa.int64()), ("neighbor_id", pa.int64()), ("score", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return out.empty_table()
            right = right.take(pa.array(_first_copies(np.asarray(right.column("id")), right.column("vec").to_pylist(), top_k + 1)))
            right = right.sort_by([("cell", "ascending"), ("angle", "ascending")])
            asker, other, x, y = np.asarray(left.column("s_id")), np.asarray(right.column("id")), _vectors(left.column("s_vec"), dim), _vectors(right.column("vec"), dim)
            least = np.full(len(x), threshold - 1e-6)  # what a score must reach, before it is rounded
            at_once = max(1, PART_BYTES // (8 * dim))

            def best(found):
                a, b, s = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((other[b], -s, a))
                a, b, s = a[order], b[order], s[order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                last = rank == top_k - 1
                least[a[last]] = np.maximum(least[a[last]], s[last] - 1e-6)
                return a[rank < top_k], b[rank < top_k], s[rank < top_k]

            found, held = [], 0
            for rows, run in _comparisons(x, np.asarray(left.column("s_angle")), np.asarray(right.column("cell")), np.asarray(right.column("angle")), centres, reach, block):
                score = x[rows] @ y[run].T
                score[asker[rows, None] == other[None, run]] = -2
                near = score >= least[rows, None]
                n = np.count_nonzero(near)
                if n > 4 * top_k * len(rows) and score.shape[1] > top_k > 0:  # others can't be among the best, however they are rounded
                    near &= score >= np.partition(score, -top_k, axis=1)[:, -top_k, None] - 2e-6
                a, b = np.nonzero(near) if n else ([], [])
                for k in range(0, len(a), at_once):
                    i, j = rows[a[k : k + at_once]], run.start + b[k : k + at_once]
                    s = np.round((x[i] * y[j]).sum(axis=1), 6)
                    fits = s >= threshold
                    found.append((i[fits], j[fits], s[fits]))
                    held += len(s)
                    if held > HELD:
                        found = [best(found)]
                        held = 0
            if not found:
                return out.empty_table()
            a, b, s = best(found)
            return pa.Table.from_arrays([pa.array(asker[a]), pa.array(other[b]), pa.array(s)], schema=out)

        ranked = Window.partitionBy("seed_id").orderBy(F.desc("score"), "neighbor_id")
        return self._meet(match, schema).withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= top_k).drop("k")
