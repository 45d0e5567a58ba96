"""Language identification by multilingual mixture inference.

A document's words are draws from a mixture of languages; each word's likelihood
is a product of hashed byte trigrams. Expectation-maximisation estimates the
proportions; languages enter the set one by one while the likelihood, less half
the logarithm of the number of words for each further language, grows. The
largest proportion gives the prediction.

Null text or text without a letter: ``und``, score 0. Ties: the language that
sorts first. With nothing to learn from, every document is ``und``. Repeated rows
give repeated results, extra columns are ignored, an empty table an empty result.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.llm.common import LOWER, Scratch, chunks, fields, flat, held_out, reduce_rows, release, word_bounds

#: Training documents of each language, those of least hash: a bounded sample, drawn in SPREAD parts.
MAX_DOCS_PER_LANGUAGE = 1536
SPREAD = 64
#: Ids of a sample that are broadcast; more of them (very many languages) are joined by a shuffle.
BROADCAST_IDS = 200_000
BUCKETS = 1 << 16
UNKNOWN = "und"

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[32] = True


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the three bytes around each letter byte, first trigram of each word, first word of each row."""
    folded = _FOLD[data]
    starts, ends, first = word_bounds(folded, bounds, _BLANK)
    left, right = np.empty(len(folded), dtype=np.uint32), np.empty(len(folded), dtype=np.uint32)
    left[1:], right[:-1] = folded[:-1], folded[1:]
    left[starts], right[ends - 1] = 32, 32
    code = (left << np.uint32(16)) | (folded.astype(np.uint32) << np.uint32(8)) | right
    inside = ~_BLANK[folded]
    grams = ((code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    size = ends - starts
    return grams, np.cumsum(size) - size, first


def second_may_pay(like: np.ndarray, at: np.ndarray, count: np.ndarray, best: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Whether some second language may raise a row's likelihood by more than the price; false is certain.

    like: (words, languages); at, count: each row's first word and words. With the
    share e of a second language the likelihood is concave in e: where its slope at e
    is not positive, its greatest value lies before e and below the tangent at e.
    """
    may = np.zeros(len(at), dtype=bool)
    for j in range(like.shape[1]):
        left = np.flatnonzero((best != j) & ~may)
        before = np.zeros(len(at))
        for step in (0.5, 2.0, 8.0, 32.0):
            if not len(left):
                break
            words = np.concatenate([np.arange(a, a + c) for a, c in zip(at[left], count[left])])
            edges = np.cumsum(count[left]) - count[left]
            share = np.minimum(step * price[left] / count[left], 0.5)
            ratio = np.expm1(np.minimum(like[words, j].astype(np.float64) - like[words, np.repeat(best[left], count[left])], 60.0))
            mix = 1 + np.repeat(share, count[left]) * ratio
            gain, slope = np.add.reduceat(np.log(mix), edges), np.add.reduceat(ratio / mix, edges)
            down = slope <= 0
            bound = gain - slope * (share - before[left])
            # a hair below the price, so that rounding can't close what is open
            may[left[(down & (bound > price[left] - 1e-6)) | (~down & (gain > price[left]))]] = True
            before[left] = share
            left = left[~down & ~may[left]]
        may[left] = True
    return may


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        # every byte is in three trigrams: a third of the logarithm each
        self.logs = (np.log(smooth / smooth.sum(axis=0)) / 3).astype(np.float32) if languages else None

    def infer(self, data: np.ndarray, bounds: np.ndarray, rounds: int = 8) -> np.ndarray:
        """Proportions of the selected languages for each row."""
        grams, firsts, row_first = trigrams(data, bounds)
        n, k = len(bounds) - 1, len(self.languages)
        share = np.zeros((n, k))
        words = np.diff(row_first)
        live = np.flatnonzero(words > 0)
        if not len(live):
            return share
        like = np.add.reduceat(self.logs[grams], firsts, axis=0)
        at = row_first[:-1][live]
        count = words[live]
        alone = np.add.reduceat(like.astype(np.float64), at, axis=0)
        best = alone.argmax(axis=1)
        value = alone[np.arange(len(live)), best]
        chosen = np.zeros((len(live), k), dtype=bool)
        chosen[np.arange(len(live)), best] = True
        share[live, best] = 1
        price = 0.5 * np.log(count + 1.0) + 1
        # positions in live whose set may still grow
        open_ = np.flatnonzero(second_may_pay(like, at, count, best, price))
        for _ in range(k - 1):
            if not len(open_):
                break
            rows = np.concatenate([np.arange(a, a + c) for a, c in zip(at[open_], count[open_])])
            part, top = like[rows], None
            top = part.max(axis=1, keepdims=True)
            p = np.exp(part - top)
            base = np.add.reduceat(top[:, 0].astype(np.float64), np.cumsum(count[open_]) - count[open_])
            edges = np.cumsum(count[open_]) - count[open_]
            owner = np.repeat(np.arange(len(open_)), count[open_])
            gain, pick, mixes = np.full(len(open_), -np.inf), np.zeros(len(open_), dtype=int), np.zeros((len(open_), k))
            for lang in range(k):
                allowed = chosen[open_].copy()
                fresh = ~allowed[:, lang]
                allowed[:, lang] = True
                pi = allowed / allowed.sum(axis=1, keepdims=True)
                for _ in range(rounds):
                    r = p * pi[owner]
                    r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
                    pi = np.add.reduceat(r, edges, axis=0) / count[open_][:, None]
                total = np.add.reduceat(np.log(np.maximum((p * pi[owner]).sum(axis=1), 1e-30)).astype(np.float64), edges) + base
                better = fresh & (total - value[open_] > gain)
                gain[better], pick[better], mixes[better] = (total - value[open_])[better], lang, pi[better]
            grown = gain > price[open_]
            won = open_[grown]
            chosen[won, pick[grown]] = True
            share[live[won]] = mixes[grown]
            value[won] += gain[grown]
            open_ = won
        return share


def train_language(docs: DataFrame, per_language: int = MAX_DOCS_PER_LANGUAGE) -> LanguageModel:
    """Trigram counts of a bounded sample for each language, made on the executors."""
    spread = F.xxhash64("doc_id")
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", spread.alias("h"))
    part = Window.partitionBy("lang", F.pmod("h", F.lit(SPREAD))).orderBy("h", "doc_id")
    ids = ids.withColumn("k", F.row_number().over(part)).where(F.col("k") <= -(-per_language // SPREAD)).select("doc_id", "lang").distinct()
    ids = Scratch(docs.sparkSession).write(ids)
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # of rows that repeat an id and language one counts: each task keeps one before they meet
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(small, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for part in chunks(batches, "text"):
            names = np.array(part.column("lang").to_pylist(), dtype=object)
            for name in sorted(set(names)):
                rows = part.take(pa.array(np.flatnonzero(names == name)))
                grams, _, _ = trigrams(*flat(rows.column("text")))
                totals.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                totals[name] += np.bincount(grams, minlength=BUCKETS)
        if totals:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(totals), pa.string()), "counts": pa.array([zlib.compress(x.astype(np.int32).tobytes(), 1) for x in totals.values()], pa.binary())})

    found: dict[str, np.ndarray] = {}
    for r in sample.repartition(8, F.xxhash64("doc_id")).mapInArrow(count, "lang string, counts binary").collect():
        found.setdefault(r.lang, np.zeros(BUCKETS, dtype=np.int64))
        found[r.lang] += np.frombuffer(zlib.decompress(bytes(r.counts)), dtype=np.int32)
    names = sorted(found)
    return LanguageModel(names, np.stack([found[x] for x in names], axis=1).astype(float) if names else np.zeros((BUCKETS, 0)))


def _lettered(data: np.ndarray, bounds: np.ndarray, col: pa.Array) -> np.ndarray:
    """Whether a row has a letter of any script."""
    kinds = np.zeros(256, dtype=np.int64)
    kinds[97:123], kinds[65:91] = 1, 1
    out = reduce_rows(np.maximum, kinds[data], bounds) > 0
    for k in np.flatnonzero(~out & (np.diff(bounds) > 0)):
        out[k] = any(map(str.isalpha, col[int(k)].as_py()))
    return out


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (the proportion of that language) and the proportions of all selected languages."""
    packed = pickle.dumps(model)

    def run(batches):
        release()
        fitted = pickle.loads(packed)
        names = np.array([*fitted.languages, UNKNOWN], dtype=object)
        for part in chunks(batches, "text"):
            col = part.column("text")
            data, bounds = flat(col)
            share = fitted.infer(data, bounds) if fitted.languages else np.zeros((len(col), 1))
            known = _lettered(data, bounds, col) & (share.max(axis=1) > 0)
            best = np.where(known, share.argmax(axis=1), len(names) - 1)
            mixes = [[(names[j], float(s[j])) for j in np.flatnonzero(s)] if ok else [] for s, ok in zip(share, known)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.where(known, np.minimum(share.max(axis=1), 1.0), 0.0)), pa.array(mixes, pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "proportions"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, fields(docs.select("doc_id").schema, "lang_pred string, score double, proportions map<string,double>"))
