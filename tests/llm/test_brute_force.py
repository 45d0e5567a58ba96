"""Registered queries that SQL can't express, against slow and plain versions of what they do."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.llm import language, pii, quality
from memlake.llm.common import flat, table
from memlake.llm.queries import QUERIES


def log_sum(values):
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def test_quality_scores(spark, sf):
    """Forward-backward in logarithms, line by line, and the weighted mean; one document at a time."""
    docs = table(spark, sf, "documents")
    model = quality.train_quality(docs, table(spark, sf, "labels"))
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    for r in docs.orderBy("n_chars").limit(120).collect():
        features, length, _ = quality.line_features(*flat(pa.array([r.text])))
        emit = [[sum(model.crf.weights[f, s] for f in line) for s in (0, 1)] for line in features]
        forward = [[model.crf.first[s] + emit[0][s] for s in (0, 1)]]
        for e in emit[1:]:
            forward.append([e[s] + log_sum([forward[-1][b] + model.crf.moves[b, s] for b in (0, 1)]) for s in (0, 1)])
        backward = [[0.0, 0.0]]
        for e in emit[:0:-1]:
            backward.append([log_sum([model.crf.moves[s, b] + e[b] + backward[-1][b] for b in (0, 1)]) for s in (0, 1)])
        backward.reverse()
        good = [math.exp(f[1] + b[1] - log_sum([f[0] + b[0], f[1] + b[1]])) for f, b in zip(forward, backward)]
        mean = sum(g * (n + 1) for g, n in zip(good, length)) / sum(n + 1 for n in length)
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        score = 1 / (1 + math.exp(-(model.slope * math.log(mean / (1 - mean)) + model.offset)))
        held = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert got[r.doc_id] == (held, pytest.approx(score, abs=1e-9), int(got[r.doc_id][1] >= 0.7))
    assert len(got) == docs.count()


def slow_trigrams(text):
    """Words of a text as lists of hashed trigrams of bytes."""
    words, word = [], []
    raw = text.encode()
    folded = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in raw]
    for b in [*folded, 32]:
        if b != 32:
            word.append(b)
        elif word:
            padded = [32, *word, 32]
            words.append([((((x << 16) | (y << 8) | z) * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for x, y, z in zip(padded, padded[1:], padded[2:])])
            word = []
    return words


def slow_mixture(model, text):
    """Proportions: languages enter one by one while the likelihood, less the price, grows."""
    words, k = slow_trigrams(text), len(model.languages)
    if not words:
        return None
    like = [[sum(float(model.logs[g, j]) for g in w) for j in range(k)] for w in words]
    value, chosen = max((sum(x[j] for x in like), -j) for j in range(k))
    chosen = [-chosen]
    share = {chosen[0]: 1.0}
    price = 0.5 * math.log(len(words) + 1.0) + 1
    while len(chosen) < k:
        best = None
        for j in range(k):
            if j in chosen:
                continue
            langs = sorted([*chosen, j])
            pi = {a: 1 / len(langs) for a in langs}
            for _ in range(8):
                total = dict.fromkeys(langs, 0.0)
                for x in like:
                    top = max(x)
                    p = {a: pi[a] * math.exp(x[a] - top) for a in langs}
                    s = max(sum(p.values()), 1e-30)
                    for a in langs:
                        total[a] += p[a] / s
                pi = {a: total[a] / len(like) for a in langs}
            gain = sum(math.log(max(sum(pi[a] * math.exp(x[a] - max(x)) for a in langs), 1e-30)) + max(x) for x in like) - value
            if best is None or gain > best[0]:
                best = (gain, j, pi)
        if best[0] <= price:
            break
        value, chosen, share = value + best[0], [*chosen, best[1]], best[2]
    return share


def test_languages(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.train_language(docs)
    whole = docs.where("n_chars between 600 and 3000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).orderBy("lang").collect()
    mixed = "\n".join(r.text for r in whole[:2])
    rows = [(r.doc_id, r.text) for r in docs.orderBy("n_chars").limit(60).collect()] + [(-1, mixed), (-2, "der the la de 12 !! und"), (-3, ""), (-4, None), (-5, "12 34"), (-6, "日本語")]
    got = {r.doc_id: r for r in language.predict_language(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    registered = {r.doc_id: r.lang_pred for r in QUERIES["op4_language_id"](spark, sf).collect()}
    for i, text in rows:
        share = slow_mixture(model, text or "")
        if share is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        want = {model.languages[j]: v for j, v in share.items()}
        assert got[i].proportions == pytest.approx(want, abs=2e-3)
        if len(want) == 1 or sorted(want.values())[-1] - sorted(want.values())[-2] > 0.01:
            assert got[i].lang_pred == max(want, key=want.get) and registered.get(i, got[i].lang_pred) == got[i].lang_pred
    assert len(got[-1].proportions) > 1


def slow_added(crf, text):
    """Spans of the chains of a text: windows found word by word, the best path by a plain table."""
    raw, words, at = text.encode(), [], 0
    for piece in text.encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" "):
        if piece:
            words.append((at, at + len(piece)))
        at += len(piece) + 1
    seed = []
    for a, b in words:
        w = raw[a:b]
        big = sum(65 <= c <= 90 for c in w)
        seed.append(any(48 <= c <= 57 or c == 64 for c in w) or len(w) >= pii.LONG_WORD and 4 <= big <= len(w) - 4)
    near = [any(seed[max(0, k - pii.REACH) : k + pii.REACH + 1]) for k in range(len(words))]
    chains, run = [], []
    for k in range(len(words)):
        if near[k]:
            run.append(k)
        elif run:
            chains.append(run)
            run = []
    if run:
        chains.append(run)
    spans = []
    for chain in chains:
        shapes = np.array([pii.word_shape(raw[words[k][0] : words[k][1]]) for k in chain])
        features = pii.chain_features(shapes, np.array([len(chain)]))
        n = len(pii.STATES)
        best, back = [sum(crf.weights[f, s] for f in features[0]) + crf.first[s] for s in range(n)], []
        for row in features[1:]:
            ways = [max((best[b] + crf.moves[b, s], -b) for b in range(n)) for s in range(n)]
            back.append([-w[1] for w in ways])
            best = [ways[s][0] + sum(crf.weights[f, s] for f in row) for s in range(n)]
        path = [max(range(n), key=lambda s: (best[s], -s))]
        for b in reversed(back):
            path.append(b[path[-1]])
        path.reverse()
        k = 0
        while k < len(chain):
            name = pii.STATES[path[k]]
            if name[:1] == "B":
                stop = k + 1
                while stop < len(chain) and pii.STATES[path[stop]] == "I-" + name[2:]:
                    stop += 1
                a, b = words[chain[k]][0], words[chain[stop - 1]][1]
                while a < b and raw[a : a + 1] in [bytes([c]) for c in pii._EDGE]:
                    a += 1
                while a < b and raw[b - 1 : b] in [bytes([c]) for c in pii._EDGE]:
                    b -= 1
                if a < b:
                    spans.append((pii.KINDS.index(name[2:]), a, b))
            k += 1
    return spans


def test_added_personal_data(spark, sf):
    crf = pii.train_pii()
    found = 0
    for r in table(spark, sf, "documents").where(F.col("text").rlike("[0-9@]") & (F.col("n_chars") < 4000)).collect():
        got = pii.crf_spans(crf, *flat(pa.array([r.text])))[0]
        want = slow_added(crf, r.text)
        found += len(want)
        assert sorted(got) == sorted(want), r.doc_id
    assert found > 10
