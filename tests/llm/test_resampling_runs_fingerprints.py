"""Importance resampling, periodic runs and Merkle fingerprints against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.llm import fingerprints, periodic, queries, resampling
from memlake.llm.common import table

LONG = "word and word again " * 20_000
NAMES = "doc_id long, text string, lang string, n int, score double, rank string, part int, place int, row int, `a b` string, `x.y` string"
ODD = [(1, "one two three"), (2, None), (3, ""), (4, LONG), (5, "one two three"), (None, "no id"), (6, "   \n\n "), (7, "ß日本 é́ ,, A-b \x01l \x01"), (7, "ß日本 é́ ,, A-b \x01l \x01"), (8, " ".join(["x"] * 30)), (9, "a b c\n" * 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1, 2.0, "r", 3, 4, 5, "s", "t") for i, t in ODD], NAMES)


# --- importance resampling -----------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text, most, buckets):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(w[k : k + j]).encode()) % buckets for k in range(len(w)) for j in range(1, most + 1) if k + j <= len(w)], len(w)


def slow_resample(docs, target, most, buckets, seed, least, percent):
    """doc_id: (n_features, weight, score, rank) by loops; docs: (doc_id, text), ids not repeated."""
    s, t = [0] * buckets, [0] * buckets
    rows = {i: slow_features(x, most, buckets) for i, x in docs}
    for f, _ in rows.values():
        for b in f:
            s[b] += 1
    for x in target:
        for b in slow_features(x, most, buckets)[0]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = {}
    for i, (f, n) in rows.items():
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n]
    order = sorted((i for i in out if out[i][3] >= least), key=lambda i: (-out[i][2], -1 if i is None else i))
    rank = {i: k + 1 for k, i in enumerate(order[: percent * len(order) // 100])}
    return {i: (f, w, score, rank.get(i)) for i, (f, w, score, _) in out.items()}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_run_crcs_equal_zlib(most):
    r = random.Random(most)
    texts = ["".join(r.choice("ab Z-9é日\n") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", None, "x" * 300, "y" * 64 + " " + "z" * 65]
    found, bounds, words = resampling.features(pa.array(texts), most, 10_007)
    for k, text in enumerate(texts):
        assert (found[bounds[k] : bounds[k + 1]].tolist(), words[k]) == slow_features(text, most, 10_007)


@pytest.mark.parametrize("most,buckets,percent", [(1, 10_000, 10), (3, 500, 33)])
def test_resampling_equals_loops(spark, sf, most, buckets, percent):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = resampling.digest(resampling.resample(docs, bench, most, buckets, "7", 20, percent)).collect()
    want = slow_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], most, buckets, "7", 20, percent)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_resampling_of_awkward_tables(spark, odd):
    got = resampling.resample(odd, odd, percent=50, least_words=3).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[2].n_features == by[3].weight == 0 and by[2]["rank"] is None and by[4].n_words == 80_000
    n = sum(r.n_words >= 3 for r in got)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, n // 2 + 1))
    assert resampling.resample(odd.limit(0), odd).count() == 0
    assert resampling.resample(odd, odd.limit(0)).count() == len(ODD)
    # one id and text for all rows: ranks are still 1, 2, 3, ...
    same = spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("w " * 25).alias("text"))
    assert sorted(r["rank"] for r in resampling.resample(same, same).where("rank is not null").collect()) == list(range(1, 101))


# --- periodic runs ---------------------------------------------------------------


def slow_runs(w, least):
    """(start, length, period) by comparing each pair of words, with the smallest period of each stretch."""
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, m, q) for (i, m), q in out.items()), key=lambda x: (x[0], x[2]))


def made(r):
    n, k = r.choice([0, 1, 2, 5, 13, 30, 60, 90]), r.choice([1, 2, 3, 5, 20])
    w = [r.randrange(k) for _ in range(n)]
    if r.random() < 0.5 and n > 4:
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_comparison_of_all_pairs(least):
    r = random.Random(least)
    fib = [0], [0, 1]
    for _ in range(8):
        fib = fib[1], fib[1] + fib[0]
    for trial in range(300):
        docs = [made(r) for _ in range(r.randint(1, 5))] + ([fib[1]] if trial == 0 else [])
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = [[] for _ in docs]
        for row, *run in zip(*periodic.runs(np.array([x for d in docs for x in d], dtype=np.int64), first, least)):
            got[row].append(tuple(run))
        assert got == [slow_runs(d, least) for d in docs]


def test_a_long_periodic_text():
    """Half a million words in one text: levels that only shorten are taken at once."""
    w = np.tile(np.arange(50_000), 10)
    assert [x.tolist() for x in periodic.runs(w, np.array([0, len(w)]))] == [[0], [0], [500_000], [50_000]]


def test_runs_of_awkward_tables(spark, odd):
    got = periodic.find_runs(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[2].runs == by[3].runs == [] and by[2].collapsed == "" and by[None].collapsed == "no id"
    assert [tuple(x) for x in by[8].runs] == [(0, 30, 1)] and by[8].collapsed == "x"
    assert [tuple(x) for x in by[9].runs] == [(0, 27, 3)] and [tuple(x) for x in by[4].runs] == [(0, 80_000, 4)]
    left = periodic.collapse_runs(odd)
    assert left.columns == odd.columns and left.count() == len(ODD)
    assert {r.doc_id: r.text for r in left.collect()}[7] == ODD[7][1] and {r.doc_id: r.text for r in left.collect()}[4] == "word and word again"
    assert periodic.digest(periodic.find_runs(odd.limit(0))).count() == 0
    assert periodic.planted(odd).where("doc_id is null").first().text == "no id"


# --- fingerprints ----------------------------------------------------------------


def slow_fingerprint(text):
    """Root and pieces (section, paragraph, piece text) by the rules as written."""
    lines = re.split(r"(?<=\n)", text)
    own = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    sections, now = [], []
    for d in own:
        now.append(d)
        if d[0] in fingerprints.SECTION:
            sections.append(now)
            now = []
    sections.append(now)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    # a section's text of digests ends with a full stop where no section ends
    joined = "".join(d + ("/" if d[0] in fingerprints.SECTION else ".") for d in own).split("/")
    pieces = [[m.group() for m in re.finditer(fingerprints.WORD_PATTERN if len(x) <= fingerprints.SHORT else fingerprints.PIECE_PATTERN, x)] for x in lines]
    return sha("".join(sha(x) for x in joined))[:32], pieces


def slow_likeness(a, b):
    from collections import Counter

    x, y = (Counter(re.findall(r"[0-9]+", f.split(":")[1])) for f in (a, b))
    n = [int(f.split(":")[0].split("x")[1]) for f in (a, b)]
    return 1.0 if a == b else 2 * sum((int(p) % 128) * c for p, c in (x & y).items()) / sum(n) if min(n) else 0.0


def test_fingerprints_equal_loops(spark, sf):
    docs = table(spark, sf, "documents").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in fingerprints.edits(table(spark, sf, "documents")).collect()}
    seen = {}
    for k, d in enumerate(docs):
        after = docs[(k + 1) % len(docs)].text
        q = len(d.text) // 4
        edited, r = d.text[: len(d.text) - q] + after[:q], got[d.doc_id]
        assert (r.n_chars, r.edited) == (len(d.text), edited)
        top, pieces = slow_fingerprint(d.text)
        assert "".join(x for p in pieces for x in p) == d.text
        head, tail = r.fingerprint.split(":")
        assert head == f"{top}x{len(d.text)}" and [[int(x) % 128 for x in p.split(",") if x] for p in re.split("[./]", tail)[:-1]] == [[len(x) for x in p] for p in pieces]
        assert seen.setdefault(r.fingerprint, d.text) == d.text
        assert r.near_edited == pytest.approx(slow_likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(slow_likeness(r.fingerprint, got[docs[(k + 1) % len(docs)].doc_id].fingerprint))
    assert len(set(seen.values())) == len({d.text for d in docs})
    long = [r for r in got.values() if r.n_chars >= 200]
    assert min(r.near_edited for r in long) > 0.3 and np.mean([r.near_edited for r in long]) > 0.7
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.98


def test_differing_branches_locate_an_edit(spark):
    text = "".join(f"Line {k}, with words of its own: {k * 7919} and {k * 104729}; nothing else is here to say, but that it is long enough.\n" for k in range(40))
    other = text.replace("Line 17,", "Line seventeen,")
    df = spark.createDataFrame([(text, other)], "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    row = df.select(fingerprints.differing(F.col("fa"), F.col("fb")).alias("x"), fingerprints.differing(F.col("fa"), F.col("fa")).alias("none"), fingerprints.likeness(F.col("fa"), F.col("fb")).alias("near")).first()
    assert row.none == [] and row.near > 0.98
    assert len(row.x) == 1 and text[row.x[0].start : row.x[0].start + row.x[0].length].startswith("Line 17,") and row.x[0].length < 60


def test_fingerprints_of_awkward_tables(spark, odd):
    got = fingerprints.digest(fingerprints.edits(odd)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[5].fingerprint and by[2].fingerprint == by[3].fingerprint
    assert by[2].near_edited == by[2].near_next == 1.0  # an empty text, and the next is empty too
    assert by[None].near_next == 0.0 and by[4].n_chars == len(LONG) and by[4].near_edited > 0.7
    assert by[9].edited_sha256 == hashlib.sha256((ODD[-1][1][:41] + "one two three").encode()).hexdigest()  # after the last comes the first
    # repeated ids: the next is the next id, whichever of its rows stands for it
    assert by[7].near_next == 0.0 and fingerprints.fingerprints(odd).count() == len(ODD)
    assert fingerprints.edits(odd.limit(0)).count() == 0
    one = odd.where("doc_id = 8")
    assert fingerprints.edits(one).first().near_next == 1.0


def test_registered_query_of_fingerprints_is_native(spark, sf):
    plan = queries.QUERIES["op13_merkle_fingerprints"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
