"""Hybrid search: lexical candidates, BM25, fusion, and the relevance gate.

Queries are a stated set, small beside the memories: they go to the memories in
blocks, and counts and sums come from their inverted index in numpy batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from memlake.functions import text as tx

K1, B, HALF = 1.2, 0.75, 4.0
#: Least semantic score of a candidate where a call names none.
THRESHOLD = 0.1


def pool_size(limit: int) -> int:
    return max(4 * limit, 20)


#: Queries that are scored at once, and cells of a table of memories by queries.
QUERY_BLOCK, CELLS = 2048, 1 << 22


class Postings:
    """The tokens of a block of queries and which queries hold each: small, and sent to every task."""

    def __init__(self, rows: list):
        self.ids = [r.query_id for r in rows]
        if rows and "embedding" in rows[0]:
            width = max((len(r.embedding or ()) for r in rows), default=0)
            self.vectors = _vectors(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), width)
        held: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            for token in r.tokens:
                held.setdefault(token, []).append(k)
        self.tokens = pa.array(list(held), pa.string())
        self.starts = np.cumsum([0, *map(len, held.values())])
        self.queries = np.array([k for ks in held.values() for k in ks], dtype=np.int64)

    def hits(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(row, token) of every element of the lists that a query asks for."""
        rows = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        codes = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=self.tokens), -1))
        found = codes >= 0
        return rows[found], codes[found]

    def sums(self, n_rows: int, rows: np.ndarray, codes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """(rows, queries) counts, or sums of weights, of the hits that a query asks for."""
        n, out = len(self.ids), np.zeros(n_rows * len(self.ids))
        sizes = self.starts[codes + 1] - self.starts[codes]
        ends = np.cumsum(sizes)
        low = 0
        while low < len(rows):
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + 2 * CELLS, side="right")))
            size = sizes[low:high]
            at = np.repeat(self.starts[codes[low:high]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = np.repeat(rows[low:high], size) * n + self.queries[at]
            out += np.bincount(cell, None if weights is None else np.repeat(weights[low:high], size), minlength=len(out))
            low = high
        return out.reshape(n_rows, n)

    def slices(self, batch: pa.RecordBatch):
        step = max(1, CELLS // max(1, len(self.ids)))
        for low in range(0, batch.num_rows, step):
            yield batch.slice(low, step)


def _blocks(queries: DataFrame, *more: str) -> list[Postings]:
    """The queries in blocks of about QUERY_BLOCK, by hash. They are a stated set, and all of its tokens come to the driver."""
    asked = queries.select("query_id", tx.proxy_tokens(F.coalesce("query", F.lit(""))).alias("tokens"), *more)
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    return [Postings(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).orderBy("query_id").collect()) for b in range(n)]


def _each_block(blocks: list[Postings], score) -> DataFrame:
    out = score(blocks[0])
    for block in blocks[1:]:
        out = out.unionByName(score(block))
    return out


class Best:
    """The k best rows of each query among all batches of a task: (asked, points, row), ties by id."""

    def __init__(self, k: int, queries: int, greater_id: bool):
        self.k, self.limit, self.parts, self.rows = k, max(4 * k * queries, 1 << 14), [], 0
        self.order = [("asked", "ascending"), ("points", "descending"), ("id", "descending" if greater_id else "ascending")]

    def add(self, asked: np.ndarray, points: np.ndarray, columns: dict[str, pa.Array]) -> None:
        self.parts.append(pa.table({"asked": pa.array(asked.astype(np.int32)), "points": pa.array(points), **columns}))
        self.rows += len(asked)
        if self.rows > self.limit:
            self.parts = [self._kept()]
            self.rows = self.parts[0].num_rows

    def _kept(self) -> pa.Table:
        every = pa.concat_tables(self.parts)
        every = every.take(pc.sort_indices(every, sort_keys=self.order))
        asked = np.asarray(every.column("asked"))
        return every.filter(pa.array(np.arange(len(asked)) - np.searchsorted(asked, asked) < self.k))

    def batches(self, names: pa.Array, schema: list[str]):
        """Batches of query_id and the columns, once all are seen."""
        if self.rows:
            found = self._kept().combine_chunks()
            yield from found.append_column("query_id", names.take(found.column("asked"))).select(schema).to_batches()


def _top(total: np.ndarray, k: int, ids: pa.Array, greater_id: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the k largest of each column; what ties with the k-th stays too, for ids to decide."""
    if k >= len(total):
        rows, asked = np.nonzero(np.isfinite(total))
        return rows, asked
    kth = np.partition(total, len(total) - k, axis=0)[len(total) - k]
    tied = (total == kth).sum(axis=0) > 1
    rows, asked = np.nonzero((total >= kth) & np.isfinite(total) & ~tied)
    if tied.any():
        # columns with ties at the k-th: in the order of ids, so that no more than k of a column stay
        order = np.asarray(pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "descending" if greater_id else "ascending")])).astype(np.int64)
        some = np.flatnonzero(tied)
        best = order[np.argsort(-total[np.ix_(order, some)], axis=0, kind="stable")[:k]]
        more = np.tile(some, k)
        fine = np.isfinite(total[best.ravel(), more])
        rows, asked = np.concatenate([rows, best.ravel()[fine]]), np.concatenate([asked, more[fine]])
    return rows, asked


def proxy_candidates(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """The k best memories of each query by share of its tokens: (query_id, id, overlap, n_tokens, score, rank).

    Ties go to the greater id; a memory that shares no token is a candidate, too. Each
    task counts overlaps of its memories with a block of queries and passes on the k
    best of all its memories for each query: no pairs of queries and memories are
    shuffled, and no more than k rows a query and task.
    """
    words = memories.select("id", tx.proxy_tokens(F.coalesce("memory", F.lit(""))).alias("tokens"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), memories.schema["id"], T.StructField("overlap", T.LongType()), T.StructField("n_tokens", T.IntegerType())])
    kind = to_arrow_type(schema["query_id"].dataType)

    def score(block: Postings) -> DataFrame:
        sizes = np.bincount(block.queries, minlength=len(block.ids))

        def run(batches):
            best = Best(k, len(block.ids), True)
            for batch in batches:
                for part in block.slices(batch):
                    overlap = block.sums(part.num_rows, *block.hits(part.column("tokens")))
                    points = np.where(overlap > 0, 0.05 + 0.90 * (overlap / np.maximum(sizes, 1)) ** 1.35, 0.05)
                    points = np.floor(np.clip(points, 0.01, 0.99) * 1e4 + 0.5)  # to four places
                    rows, asked = _top(points, k, part.column("id"), True)
                    best.add(asked, points[rows, asked], {"id": part.column("id").take(pa.array(rows)), "overlap": pa.array(overlap[rows, asked].astype(np.int64)), "n_tokens": pa.array(sizes[asked].astype(np.int32))})
            yield from best.batches(pa.array(block.ids, kind), schema.names)

        return words.mapInArrow(run, schema)

    every = _each_block(_blocks(queries), score)
    share = F.when(F.col("overlap") > 0, F.lit(0.05) + F.lit(0.90) * F.pow(F.col("overlap") / F.col("n_tokens"), F.lit(1.35))).otherwise(0.05)
    scored = every.withColumn("score", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), share)), 4))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Bm25:
    """Okapi sums of a block's queries; counts of documents by token, of those asked for alone, come from one pass."""

    def __init__(self, block: Postings, words: DataFrame):
        self.block = block

        def count(batches):
            n = length = 0
            df = np.zeros(len(block.tokens), dtype=np.int64)
            for batch in batches:
                lists = batch.column("tokens")
                rows, codes = block.hits(lists)
                df += np.bincount(np.unique(rows * len(df) + codes) % len(df), minlength=len(df)) if len(df) else 0
                n, length = n + batch.num_rows, length + len(lists.flatten())
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "length": pa.array([length]), "df": pa.array([df.tobytes()], pa.binary())})

        n = length = 0
        df = np.zeros(len(block.tokens), dtype=np.int64)
        for r in words.select("tokens").where(F.size("tokens") > 0).mapInArrow(count, "n bigint, length bigint, df binary").collect():  # one row a task
            n, length, df = n + r.n, length + r.length, df + np.frombuffer(r.df, dtype=np.int64)
        self.idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
        self.average = length / n if n else 1.0

    def sums(self, lists: pa.ListArray) -> np.ndarray:
        """(rows, queries)."""
        width = max(1, len(self.idf))
        rows, codes = self.block.hits(lists)
        pairs, tf = np.unique(rows * width + codes, return_counts=True)
        rows, codes = pairs // width, pairs % width
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))[rows]
        gain = self.idf[codes] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.average))
        return self.block.sums(len(lists), rows, codes, gain)


def _terms(memories: DataFrame, *more: str) -> DataFrame:
    return memories.select("id", tx.proxy_terms(F.coalesce("memory", F.lit(""))).alias("tokens"), *more)


def bm25(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """Okapi BM25 of every pair that shares a token: (query_id, id, bm25_raw)."""
    words = _terms(memories).where(F.size("tokens") > 0)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), memories.schema["id"], T.StructField("bm25_raw", T.DoubleType())])
    kind = to_arrow_type(schema["query_id"].dataType)

    def score(block: Postings) -> DataFrame:
        okapi = Bm25(block, words)

        def run(batches):
            names = pa.array(block.ids, kind)
            for batch in batches:
                for part in block.slices(batch):
                    sums = okapi.sums(part.column("tokens"))
                    at, asked = np.nonzero(sums)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(asked)), part.column("id").take(pa.array(at)), pa.array(sums[at, asked])], schema.names)

        return words.mapInArrow(run, schema)

    return _each_block(_blocks(queries), score)


def _vectors(col: pa.Array, width: int) -> np.ndarray:
    """(rows, width) unit vectors; a missing vector, or one of other length, is all zero."""
    out = np.zeros((len(col), width))
    for k, v in enumerate(col):
        if v.is_valid and len(v) == width and not v.values.null_count:
            x = np.asarray(v.values, dtype=np.float64)
            n = np.linalg.norm(x)
            out[k] = x / n if np.isfinite(n) and n else 0
    return out


def pooled(queries: DataFrame, memories: DataFrame, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """The pool of each query: the k memories of the best sum of signals whose semantic score reaches the threshold.

    queries: query_id, query, embedding; memories: id, memory, embedding, entity_boost.
    Gives query_id, id, semantic_score (cosine), bm25_score (r / (r + HALF)),
    entity_boost, rank; ties go to the smaller id, and what has no vector is not found
    and finds nothing. Each task scores its memories
    against a block of queries and passes on the k best of all for each.
    """
    words = _terms(memories, "embedding", F.coalesce("entity_boost", F.lit(0.0)).cast("double").alias("boost"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), memories.schema["id"], *[T.StructField(c, T.DoubleType()) for c in ("semantic_score", "bm25_score", "entity_boost")]])
    kind = to_arrow_type(schema["query_id"].dataType)

    def score(block: Postings) -> DataFrame:
        okapi, asks = Bm25(block, words), block.vectors

        def run(batches):
            best = Best(k, len(block.ids), False)
            for batch in batches:
                for part in block.slices(batch):
                    vectors = _vectors(part.column("embedding"), asks.shape[1])
                    semantic = vectors @ asks.T
                    raw = okapi.sums(part.column("tokens"))
                    lexical, boost = raw / (raw + HALF), np.asarray(part.column("boost"))
                    total = semantic + lexical + boost[:, None]
                    total[(semantic < threshold) | ~vectors.any(axis=1)[:, None] | ~asks.any(axis=1)] = -np.inf
                    rows, asked = _top(total, k, part.column("id"), False)
                    best.add(asked, total[rows, asked], {"id": part.column("id").take(pa.array(rows)), "semantic_score": pa.array(semantic[rows, asked]), "bm25_score": pa.array(lexical[rows, asked]), "entity_boost": pa.array(boost[rows])})
            yield from best.batches(pa.array(block.ids, kind), schema.names)

        return words.mapInArrow(run, schema)

    every = _each_block(_blocks(queries, "embedding"), score)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.col("semantic_score") + F.col("bm25_score") + F.col("entity_boost")), "id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fuse(candidates: DataFrame) -> DataFrame:
    """final = least(1, (semantic + bm25 + boost) / m); m is 2 for a query with any lexical or entity signal, else 1."""
    w = Window.partitionBy("query_id")
    signal = F.max(F.greatest("bm25_score", "entity_boost")).over(w) > 0
    raw = F.col("semantic_score") + F.col("bm25_score") + F.col("entity_boost")
    most = F.when(signal, F.lit(2.0)).otherwise(1.0)
    return candidates.withColumn("raw_score", raw).withColumn("max_possible_score", most).withColumn("final_score", F.least(F.lit(1.0), raw / most))


@dataclass(frozen=True)
class GateConfig:
    final_threshold: float = 0.32
    dense_only_threshold: float = 0.70
    relative_ratio: float = 0.50
    min_coverage: float = 0.35
    bm25_threshold: float = 0.15
    lexical_semantic_threshold: float = 0.48
    enabled: bool = True

    def __post_init__(self):
        for name, v in vars(self).items():
            if name != "enabled" and (isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1):
                raise ValueError(f"{name} must be a finite number from 0 to 1")


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


#: Columns of memory_features.
FEATURES = ("memory_tokens", "memory_cjk", "memory_hazard")


def memory_features(memories: DataFrame) -> DataFrame:
    """memories (id, memory, ...) with what the gate looks at in a memory: distinct tokens, CJK characters, hazards."""
    tokens = F.array_distinct(F.transform(tx.all_matches(F.col("memory"), r"(?U)\b[A-Za-z0-9_.\-]+\b"), F.lower))
    return memories.select("*", *[c.alias(n) for n, c in zip(FEATURES, (tokens, tx.cjk_characters(F.col("memory")), tx.is_hazard(F.col("memory"))))])


def gate(candidates: DataFrame, limit: int, config: GateConfig | None = None, with_query: bool = True) -> DataFrame:
    """Candidates with accepted and reason; first rule that matches wins.

    candidates: query_id, rank (input order), query, memory or the columns of
    memory_features, score, semantic_score, bm25_score, entity_boost, final_score,
    has_details, and the ids user_id, agent_id that name a subject. Two windows over a query's candidates: the best
    score of those that pass the absolute rules, then the place among the accepted.
    """
    cfg = config or GateConfig()
    limit = max(limit, 0)
    place = Window.partitionBy("query_id").orderBy("rank")
    if not cfg.enabled:
        ok = F.row_number().over(place) <= limit
        return candidates.withColumn("accepted", ok).withColumn("reason", F.when(ok, "gate_disabled").otherwise("truncated_by_limit"))
    if not set(FEATURES) <= set(candidates.columns):
        candidates = memory_features(candidates)
    q = F.col("query") if with_query else F.lit("")
    m_tokens, m_cjk, m_hazard = map(F.col, FEATURES)
    q_tokens, q_cjk = tx.query_tokens(q), tx.cjk_characters(q)
    rows = candidates.select(
        "*", q_tokens.alias("_qt"), F.array_intersect(q_tokens, m_tokens).alias("_shared"), q_cjk.alias("_qc"), F.array_intersect(q_cjk, m_cjk).alias("_sc"),
        tx.identity_subjects(q).alias("_subjects"), F.array_union(m_tokens, F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("user_id", "agent_id")])).alias("_names"),
    )
    share = lambda n, of: F.when(F.size(of) > 0, F.size(n) / F.size(of)).otherwise(0.0)
    coverage = F.greatest(share(F.col("_shared"), F.col("_qt")), share(F.col("_sc"), F.col("_qc")))
    overlap = (coverage >= cfg.min_coverage) | ((F.size("_qt") <= 2) & (F.size("_shared") >= 1)) | ((F.size("_qc") <= 4) & (F.size("_sc") >= 2))
    lexical = overlap & (F.col("bm25_score") >= cfg.bm25_threshold)
    final, semantic = F.col("final_score"), F.col("semantic_score")
    passes_final, passes_dense = final >= cfg.final_threshold, semantic >= cfg.dense_only_threshold
    if with_query:
        signal = (
            F.when(F.col("entity_boost") > 0, F.when(~passes_final, "final_threshold_failed"))
            .when(lexical, F.when(~(passes_final & (semantic >= cfg.lexical_semantic_threshold)), "lexical_semantic_threshold_failed"))
            .when(F.col("bm25_score") == 0, F.when(~(passes_final & passes_dense), "dense_threshold_failed"))
            .otherwise("weak_lexical_collision_failed")
        )
    else:
        support = (F.col("entity_boost") > 0) | (F.col("bm25_score") > 0)
        signal = F.when(support, F.when(~passes_final, "final_threshold_failed")).when(~passes_dense, "dense_threshold_failed").when(~passes_final, "final_threshold_failed")
    numbers = [F.col(c) for c in ("semantic_score", "bm25_score", "entity_boost", "final_score")]
    missing, bad = F.lit(False), F.lit(False)
    for c in numbers:
        missing, bad = missing | c.isNull(), bad | ~finite(c)
    strangers = (F.size("_subjects") > 0) & (F.size(F.array_intersect("_subjects", "_names")) == 0)
    absolute = (
        F.when(tx.is_hazard(q), "query_transient_log_or_directive").when(~F.col("has_details"), "missing_or_invalid_score_details").when(missing, "missing_required_score_fields")
        .when(bad | ~finite(F.col("score")), "non_numeric_score_fields").when(F.abs(F.col("score") - final) > 1e-4, "score_consistency_mismatch")
        .when(m_hazard, "candidate_transient_or_log_pollution").when(strangers, "explicit_identity_subject_mismatch").otherwise(signal)
    )
    rows = rows.withColumn("_reason", absolute)
    best = F.max(F.when(F.col("_reason").isNull(), final)).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_reason", F.coalesce("_reason", F.when(final < best * cfg.relative_ratio, "relative_floor_failed")))
    passed = F.col("_reason").isNull()
    nth = F.sum(passed.cast("int")).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reason = F.coalesce("_reason", F.when(nth <= limit, "passed").otherwise("truncated_by_limit"))
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "passed").drop("_qt", "_shared", "_qc", "_sc", "_subjects", "_names", "_reason")


def reject_reason(user: Column, project: Column) -> Column:
    """Why a replayed candidate is out of the caller's scope; null: it is in."""
    return (
        F.when(F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("active")) == "superseded", "superseded").when(F.col("user_id").isNotNull() & (F.col("user_id") != user), "cross_user")
        .when((F.col("scope") == "project") & (F.col("agent_id") != project), "cross_project").when(~F.col("scope").isin("project", "global"), "scope_mismatch")
    )
