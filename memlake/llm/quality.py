"""Quality classifier: a linear-chain CRF over the lines of a document.

Every line gets features of itself and of its neighbours; the chain is fitted on
lines that carry the label of their document. Forward-backward gives P(good) of
each line; the mean weighted by line length, mapped by a logistic curve fitted on
the same rows, is the score of the document.

Null text counts as empty; an empty text is one empty line. Repeated rows give
repeated results, extra columns are ignored, an empty table gives an empty result.
With no labelled row, or labels of one class only, scores are that class's rate.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import Scratch, chunks, fields, flat, held_out, reduce_rows, release, word_bounds, word_hashes
from memlake.llm.crf import Batch, Crf

#: The chain is fitted on a bounded sample: of so many labelled documents, those of least hash, the ones of at most
#: MAX_DOC_LINES lines, and of these, in the same order, as many as have MAX_TRAIN_LINES lines together.
MAX_TRAIN_DOCS, MAX_DOC_LINES, MAX_TRAIN_LINES = 3000, 500, 200_000
#: A document is kept from this score on.
THRESHOLD = 0.7

_CLASS = np.full(256, 7, dtype=np.uint8)  # 7: other
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", ".,;:?'\"()-", "!", "|", "#$%&*@+=<>~^\\/{}[]_`")):
    _CLASS[[ord(c) for c in _chars]] = _k
_SHARE = np.array([0.002, 0.01, 0.03, 0.08, 0.2, 0.5])
#: Buckets of each feature of a line, in order.
_SIZES = [14, 7, 7, 7, 7, 7, 7, 7, 9, 7, 7, 4, 3, 3]
_NEAR = [1, 4, 5, 6, 9, 11]  # of these the neighbours' values count too
_ALL = _SIZES + [_SIZES[k] + 1 for k in _NEAR] * 2
_SHIFT = np.cumsum([0, *_ALL[:-1]])
N_FEATURES = int(sum(_ALL))


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indexes of every line, the lines' lengths in bytes, and how many lines each row has."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(bounds, breaks, side="right") - 1
    per_row = np.bincount(row, minlength=len(bounds) - 1) + 1
    first = np.cumsum(per_row) - per_row
    starts = np.empty(int(per_row.sum()), dtype=np.int64)
    is_first = np.zeros(len(starts), dtype=bool)
    is_first[first] = True
    starts[first], starts[~is_first] = bounds[:-1], breaks + 1
    ends = np.empty_like(starts)
    ends[first + per_row - 1] = bounds[1:]
    last = np.zeros(len(starts), dtype=bool)
    last[first + per_row - 1] = True
    ends[~last] = breaks
    length = ends - starts
    kinds = _CLASS[data]
    share = []
    for k in range(8):
        total = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(kinds == k, out=total[1:])
        share.append((total[ends] - total[starts]) / np.maximum(length, 1))
    w_start, w_end, _ = word_bounds(data, bounds)
    words = word_hashes(data, w_start, w_end)
    w_first = np.searchsorted(w_start, starts)
    w_count = np.searchsorted(w_start, ends) - w_first
    edges = np.append(w_first, len(words))
    same = np.zeros(len(words), dtype=np.int64)
    line_of = np.repeat(np.arange(len(starts)), w_count)
    for back in (1, 2, 3):
        same[back:] |= (words[back:] == words[:-back]) & (line_of[back:] == line_of[:-back])
    again = reduce_rows(np.add, same, edges) / np.maximum(w_count, 1)
    letters = reduce_rows(np.add, w_end - w_start, edges) / np.maximum(w_count, 1)
    whole = reduce_rows(np.add, words * (np.arange(len(words)) - np.repeat(w_first, w_count) + 1).astype(np.uint64), edges)
    doc = np.repeat(np.arange(len(per_row)), per_row)
    order = np.lexsort((whole, doc))
    twin = (doc[order][1:] == doc[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    copies = np.zeros(len(starts), dtype=np.int64)
    copies[order[1:]] += twin
    copies[order[:-1]] += twin
    tail = np.where(length > 0, kinds[np.maximum(ends - 1, 0)] if len(data) else 7, 7)
    head = np.where(length > 0, kinds[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else 7, 7)
    own = [np.minimum(np.log2(length + 1).astype(np.int64), 13)]
    own += [np.searchsorted(_SHARE, share[k]) for k in (0, 1, 2, 3, 4, 5, 6)]
    own += [np.minimum(letters.astype(np.int64) // 2, 8), np.searchsorted(_SHARE, again), np.minimum(np.log2(w_count + 1).astype(np.int64), 6)]
    own += [np.minimum(copies, 2) + (length == 0), np.where(tail == 3, 1, np.where(tail == 7, 0, 2)), np.where(head == 0, 1, np.where(head == 7, 0, 2))]
    near = []
    for k in _NEAR:
        prev, nxt = np.full(len(starts), _SIZES[k]), np.full(len(starts), _SIZES[k])
        prev[1:][~is_first[1:]] = own[k][:-1][~is_first[1:]]
        nxt[:-1][~last[:-1]] = own[k][1:][~last[:-1]]
        near.append((prev, nxt))
    cols = own + [x[0] for x in near] + [x[1] for x in near]
    return np.stack([c + s for c, s in zip(cols, _SHIFT)], axis=1).astype(np.int32), length, per_row


class QualityModel:
    """The fitted chain and the logistic curve (slope, offset) from mean log odds to a score."""

    def __init__(self, crf: Crf | None, slope: float, offset: float):
        self.crf, self.slope, self.offset = crf, slope, offset

    def evidence(self, features: np.ndarray, length: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean of P(good) over each document's lines."""
        good = self.crf.marginals(self.crf.emissions(features), Batch(per_row))[:, 1]
        edges = np.concatenate([[0], np.cumsum(per_row)])
        weight = length + 1.0
        p = np.clip(np.add.reduceat(good * weight, edges[:-1]) / np.add.reduceat(weight, edges[:-1]), 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x = self.evidence(*line_features(data, bounds)) if self.crf else np.zeros(len(bounds) - 1)
        return 1 / (1 + np.exp(-(self.slope * x + self.offset)))


def fit(rows: list[tuple[bytes, bytes, int]]) -> QualityModel:
    """rows: (line features, line lengths, label) of each training document."""
    labels = np.array([r[2] for r in rows], dtype=float)
    if not len(rows) or labels.min() == labels.max():
        rate = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(None, 0.0, float(np.log(rate / (1 - rate))))
    width = len(_ALL)
    features = np.concatenate([np.frombuffer(r[0], dtype=np.int32).reshape(-1, width) for r in rows])
    length = np.concatenate([np.frombuffer(r[1], dtype=np.int64) for r in rows])
    per_row = np.array([len(r[1]) // 8 for r in rows])
    model = QualityModel(Crf(N_FEATURES, 2).fit(features, np.repeat(labels.astype(int), per_row), per_row, rounds=80), 1.0, 0.0)
    x = model.evidence(features, length, per_row)
    design, theta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(30):  # Newton steps of a logistic regression in one variable
        p = 1 / (1 + np.exp(-design @ theta))
        slope = design.T @ (labels - p) - 1e-3 * theta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    model.slope, model.offset = float(max(theta[0], 1e-3)), float(theta[1])
    return model


def train_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, doc_lines: int = MAX_DOC_LINES, max_lines: int = MAX_TRAIN_LINES) -> QualityModel:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Features are made on the executors; the driver gets one row an id, 112 bytes a line, of at most max_lines lines.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = picked.groupBy("doc_id").agg(F.min("quality").cast("int").alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("id"), "text", F.col("__label").alias("label"))

    def make(batches):
        for part in chunks(batches, "text"):
            features, length, per_row = line_features(*flat(part.column("text")))
            ends = np.cumsum(per_row)
            some = np.flatnonzero(per_row <= doc_lines)
            out = [(features[e - n : e].tobytes(), length[e - n : e].tobytes()) for e, n in zip(ends[some], per_row[some])]
            part = part.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("id"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), part.column("label")], ["h", "id", "f", "n", "label"])

    # of rows that repeat an id one counts: each task keeps one before they meet
    one = F.min(F.struct("f", "n", "label"))
    scratch = Scratch(docs.sparkSession)
    made = scratch.write(rows.mapInArrow(make, "h bigint, id string, f binary, n binary, label int").groupBy("h", "id").agg(one.alias("r")).select("h", "id", "r.*"))
    # ids and numbers of lines first, then the lines of those that fit
    sizes = sorted((r.h, r.id, r.n // 8) for r in made.select("h", "id", F.length("n").alias("n")).collect())
    ends = np.cumsum([n for *_, n in sizes])
    fit_in = int(np.searchsorted(ends, max_lines, side="right"))
    if not fit_in:
        return fit([])
    h, id_, _ = sizes[fit_in - 1]
    kept = made.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("id") <= id_))).collect()
    sample = [(bytes(r.f), bytes(r.n), r.label) for r in sorted(kept, key=lambda r: (r.h, r.id))]
    scratch.drop(made)
    return fit(sample)


def _scored(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """(row, score): a struct of the kept columns, so that their names can't clash, and the score."""
    packed = pickle.dumps(model)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").alias("text"))

    def run(batches):
        release()
        fitted = pickle.loads(packed)
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(fitted.score(*flat(part.column("text"))))], ["row", "score"])

    return source.mapInArrow(run, fields(source.select("row").schema, "score double"))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and the score of each whole text."""
    return _scored(docs, model, ["doc_id"]).select("row.doc_id", "score")


def keep_good(docs: DataFrame, labels: DataFrame, train_docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    model = train_quality(train_docs, labels)
    return _scored(docs, model, docs.columns).where(F.col("score") >= threshold).select("row.*")

