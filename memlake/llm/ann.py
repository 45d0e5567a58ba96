"""Nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is
indexed: its list is its nearest centroid, its code the quantised residual. There
are about as many lists as the square root of the number of vectors. A query probes
the lists whose centroids lie best; its inner product with a vector is guessed as
that with the centroid plus a sum over one entry of the query's table for each code
byte. The RERANK best guesses are scored exactly, in double precision, and then all
whose guess may still reach the k-th of these: a guess is wrong by about the lengths
of the query's parts times those of the quantisation errors, as of random
directions, and SIGMAS times that is allowed for. A dense cluster whose codes can't
tell its vectors apart has equal guesses and is thus scored as a whole.

Lists are put together into bins of about BIN vectors, a longer list is cut into
several; queries come in blocks. A task scores a block of queries against a bin, so
neither a list with a third of all vectors nor a vector that many rows repeat meets
in one task. A query is sent to a bin once, its probes as bits beside it, and each
pair of block and bin returns at most k rows a query.

Null vectors, zero vectors, vectors with null or non-finite components or of
another dimension than the sample's most common take no part, nor do null ids.
Ties go to the smaller id. Rows that repeat an id are one vector, the one of the
smallest hash if they differ, and one query if any of them is. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.llm.common import Scratch

#: Vectors the index is fitted on, those of least hash.
SAMPLE = 16_384
MAX_LISTS = 1024
PROBED_SHARE = 0.75
SUBSPACES, CODES = 16, 256
#: Vectors of a bin scored exactly first; the k-th best of them says how far to go on.
RERANK = 64
#: How many standard deviations of the quantisation error a guess may fall short by.
SIGMAS = 3.0
BIN, QUERY_BLOCK = 4096, 2048
#: Pairs of query and vector that are guessed at once.
STEP_PAIRS = 1 << 20
NEIGHBOURS = 20


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    state = np.random.RandomState(seed)
    centres = x[state.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        full = count > 0
        centres[full] = total[full] / count[full][:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[k : k + 8192] @ centres.T - half).argmax(axis=1) for k in range(0, len(x), 8192)]) if len(x) else np.zeros(0, dtype=np.int64)


class Index:
    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.centres = k_means(sample, min(lists, len(sample)), 12, 1)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.books = [k_means(rest[:, c], min(CODES, len(sample)), 8, 2 + k) for k, c in enumerate(self.cuts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centres)
        rest = x - self.centres[lists]
        return lists, np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(subspaces, codes, queries) inner products with the codebooks."""
        out = np.zeros((len(self.cuts), CODES, len(q)), dtype=np.float32)
        for k, (c, b) in enumerate(zip(self.cuts, self.books)):
            out[k, : len(b)] = b @ q[:, c].T
        return out

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(vectors, subspaces) mean square of what the codes leave out of a component."""
        rest = x - self.centres[lists]
        return np.stack([((rest[:, c] - b[codes[:, k]]) ** 2).mean(axis=1) for k, (c, b) in enumerate(zip(self.cuts, self.books))], axis=1)

    def lengths(self, q: np.ndarray) -> np.ndarray:
        """(queries, subspaces) squared lengths of the parts of queries."""
        return np.stack([(q[:, c] ** 2).sum(axis=1) for c in self.cuts], axis=1)

    def probes(self, q: np.ndarray, sizes: np.ndarray, k: int, share: float = PROBED_SHARE) -> np.ndarray:
        """(queries, lists) whether a query probes a list: the best share of all, and as many as hold enough vectors."""
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        most = np.maximum(max(1, int(np.ceil(share * len(sizes)))), (held < 4 * k + 1).sum(axis=1) + 1)
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order, np.arange(order.shape[1]) < most[:, None], axis=1)
        return out


def _valid(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors and the vectors."""
    rows, at = [], []
    for k, x in enumerate(col):
        if not x.is_valid:
            continue
        v = x.values
        if v.null_count or (dim is not None and len(v) != dim) or not len(v):
            continue
        a = np.asarray(v, dtype=np.float64)
        if np.isfinite(a).all() and a.any():
            rows.append(a)
            at.append(k)
    return np.array(at, dtype=np.int64), (np.stack(rows) if rows and dim is not None else rows)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Index | None:
    picked = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)

    def pack(batches):
        for b in batches:
            _, rows = _valid(b.column("embedding"))
            yield pa.RecordBatch.from_pydict({"v": pa.array([r.tobytes() for r in rows], pa.binary())})

    raw = [bytes(r.v) for r in picked.select("embedding").mapInArrow(pack, "v binary").collect()]
    if not raw:
        return None
    size = Counter(map(len, raw)).most_common(1)[0][0]
    x = np.stack([np.frombuffer(r) for r in sorted(raw) if len(r) == size])
    return Index(x, int(np.clip(np.sqrt(max(vectors.count(), len(x))), 1, MAX_LISTS)))


def bins_of(sizes: np.ndarray, most: int = BIN) -> tuple[np.ndarray, np.ndarray]:
    """First bin and number of bins of each list: short lists share a bin while they fit, a long one is cut into bins of its own."""
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    at, held = -1, most
    for k in np.argsort(sizes, kind="stable"):
        n = int(sizes[k])
        if n > most:
            parts[k] = -(-n // most)
            first[k], at, held = at + 1, at + int(parts[k]), most
        else:
            if held + n > most:
                at, held = at + 1, 0
            first[k], held = at, held + n
    return first, parts


class Scorer:
    """Of a bin's vectors: the k best for each query of a block."""

    def __init__(self, index: Index, ids: np.ndarray, lists: np.ndarray, codes: np.ndarray, x: np.ndarray, rerank: int, sigmas: float):
        order = np.lexsort((ids, lists))
        self.index, self.rerank, self.sigmas = index, rerank, sigmas
        self.ids, self.lists, self.codes, self.x = ids[order], lists[order], codes[order], x[order]
        self.own, edges = np.unique(self.lists, return_index=True)
        self.edges = np.append(edges, len(ids))
        self.errors = index.errors(self.x, self.lists, self.codes).astype(np.float32)
        # sums of floats differ from those of doubles by less than this times the query's length
        self.rounding = np.float32(2e-6) * np.float32(np.linalg.norm(self.x, axis=1).max() + np.linalg.norm(index.centres[self.own], axis=1).max())

    def guesses(self, q: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """(queries, vectors) guessed products, minus infinity where a list isn't probed."""
        tables, out = self.index.tables(q), np.full((len(self.ids), len(q)), -np.inf, dtype=np.float32)
        centre = (self.index.centres[self.own] @ q.T).astype(np.float32)
        for k, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:])):
            asks = np.flatnonzero(probed[:, self.own[k]])
            if not len(asks):
                continue
            whole = len(asks) == len(q)
            part = np.broadcast_to(centre[k] if whole else centre[k, asks], (b - a, len(asks))).copy()
            for m in range(self.codes.shape[1]):
                part += (tables[m] if whole else tables[m][:, asks])[self.codes[a:b, m]]
            if whole:
                out[a:b] = part
            else:
                out[a:b, asks] = part
        return out.T

    def exactly(self, q: np.ndarray, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Row by row, so that equal vectors get equal scores wherever they stand."""
        out = np.empty(len(rows))
        for low in range(0, len(rows), 1 << 15):
            part = slice(low, low + (1 << 15))
            out[part] = (self.x[rows[part]] * q[asked[part]]).sum(axis=1)
        return out

    def best(self, q: np.ndarray, own: np.ndarray, probed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Positions of queries, positions of vectors, scores: at most k a query; and how many pairs were scored exactly."""
        guess = self.guesses(q, probed)
        guess[own[:, None] == self.ids[None, :]] = -np.inf
        n = guess.shape[1]
        depth = min(max(self.rerank, k), n)
        first = np.argpartition(-guess, depth - 1, axis=1)[:, :depth] if depth < n else np.broadcast_to(np.arange(n), guess.shape)
        asked, rows = np.repeat(np.arange(len(q)), depth), first.ravel()
        real = np.isfinite(guess[asked, rows])
        exact = np.where(real, self.exactly(q, asked, rows), -np.inf).reshape(len(q), depth)
        scored = int(real.sum())
        asked, rows, score = asked[real], rows[real], exact.ravel()[real]
        if depth < n:
            kth = -np.partition(-exact, k - 1, axis=1)[:, k - 1]
            spread = np.sqrt(self.index.lengths(q).astype(np.float32) @ self.errors.T)
            spread *= np.float32(self.sigmas)
            spread += guess
            spread += (self.rounding * np.linalg.norm(q, axis=1).astype(np.float32))[:, None]
            open_ = (spread >= kth[:, None].astype(np.float32)) & np.isfinite(guess)
            open_[np.repeat(np.arange(len(q)), depth), first.ravel()] = False  # scored before
            more_asked, more_rows = np.nonzero(open_)
            scored += len(more_rows)
            asked, rows, score = np.concatenate([asked, more_asked]), np.concatenate([rows, more_rows]), np.concatenate([score, self.exactly(q, more_asked, more_rows)])
        order = np.lexsort((self.ids[rows], -score, asked))
        asked, rows, score = asked[order], rows[order], score[order]
        place = np.arange(len(asked)) - np.searchsorted(asked, asked)
        keep = place < k
        return asked[keep], rows[keep], score[keep], scored


def _once(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows with each vec_id once. Ids and hashes are shuffled; vectors only of ids that rows repeat, and those of one id meet after each task kept one."""
    again = scratch.write(rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("vec")).alias("least"), F.max("q").alias("asks")).where("n > 1"))
    if again.isEmpty():
        return rows
    one = rows.join(again, "vec_id").where(F.xxhash64("vec") == F.col("least")).groupBy("vec_id").agg(F.max("asks").alias("q"), *[F.min(c).alias(c) for c in ("list", "code", "vec")])
    return scratch.write(rows.join(again, "vec_id", "left_anti").select(*rows.columns).unionByName(one))


def search(vectors: DataFrame, is_query, index: Index | None = None, k: int = NEIGHBOURS, share: float = PROBED_SHARE, rerank: int = RERANK, sigmas: float = SIGMAS, bin_size: int = BIN, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best of all other rows for each row where is_query holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    source = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("q"))
    index = index or fit(source)
    if index is None:
        return spark.createDataFrame([], schema)
    packed, scratch = pickle.dumps(index), Scratch(spark)

    def encode(batches):
        fitted = pickle.loads(packed)
        for b in batches:
            at, x = _valid(b.column("embedding"), fitted.dim)
            if not len(at):
                continue
            lists, codes = fitted.encode(x)
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(keep), b.column("q").take(keep), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "q", "list", "code", "vec"])

    rows = scratch.write(source.mapInArrow(encode, "vec_id bigint, q boolean, list int, code binary, vec binary"))
    rows = _once(scratch, rows)
    sizes, asking = np.zeros(len(index.centres), dtype=np.int64), 0
    for r in rows.groupBy("list").agg(F.count("*").alias("n"), F.count_if("q").alias("q")).collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["n"]
        asking += r["q"]
    first, parts = bins_of(sizes, bin_size)
    n_bins, n_blocks = int((first + parts).max()), max(1, -(-asking // query_block))
    shape = F.broadcast(spark.createDataFrame([(k, int(a), int(p)) for k, (a, p) in enumerate(zip(first, parts))], "list int, first int, parts int"))
    homes = F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts").cast("int")
    mine = rows.join(shape, "list").select(homes.alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "vec_id", "list", "code", "vec")

    def probe(batches):
        fitted = pickle.loads(packed)
        in_bin = np.zeros((len(sizes), n_bins), dtype=bool)
        for c in range(len(sizes)):
            in_bin[c, first[c] : first[c] + parts[c]] = True
        for b in batches:
            if not b.num_rows:
                continue
            probed = fitted.probes(np.stack([np.frombuffer(v.as_buffer()) for v in b.column("vec")]), sizes, k, share)
            asked, bins = np.nonzero(probed @ in_bin)
            take = pa.array(asked)
            bits = pa.array([x.tobytes() for x in np.packbits(probed, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("vec").take(take), bits.take(take), pa.array(bins, pa.int32())], ["query_id", "query", "probed", "bin"])

    theirs = rows.where("q").select("vec_id", "vec").mapInArrow(probe, "query_id bigint, query binary, probed binary, bin int")
    theirs = theirs.select("bin", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"), "query_id", "query", "probed")

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        fitted = pickle.loads(packed)
        ids = np.asarray(left.column("vec_id"))
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        x = np.frombuffer(b"".join(left.column("vec").to_pylist())).reshape(len(ids), -1)
        scorer = Scorer(fitted, ids, np.asarray(left.column("list")), codes, x, rerank, sigmas)
        queries = np.asarray(right.column("query_id"))
        q = np.frombuffer(b"".join(right.column("query").to_pylist())).reshape(len(queries), -1)
        probed = np.unpackbits(np.frombuffer(b"".join(right.column("probed").to_pylist()), dtype=np.uint8).reshape(len(queries), -1), axis=1, count=len(sizes)).astype(bool)
        step, found = max(1, STEP_PAIRS // len(ids)), []
        for low in range(0, len(q), step):
            asked, at, score, _ = scorer.best(q[low : low + step], queries[low : low + step], probed[low : low + step], k)
            found.append((queries[low + asked], scorer.ids[at], score))
        return pa.Table.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(3)], schema=out)

    near = mine.groupBy("bin", "block").cogroup(theirs.groupBy("bin", "block")).applyInArrow(match, "query_id bigint, vec_id bigint, score double")
    # at most k rows a query and bin; the limit by rank is applied before the shuffle, too
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
