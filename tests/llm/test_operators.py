"""Operators against brute force, exact round trips, held-out accuracy and awkward inputs."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.llm import ann, chat, contamination, extraction, language, neardup, packing, pii, quality, tokenfile
from memlake.llm.common import Scratch, chunks, flat, held_out, table
from memlake.llm.crf import Batch, Crf
from memlake.llm.graph import components
from memlake.llm.tokens import Encoder, vocabulary

LONG = "word " * 60_000
ODD = [(1, "The quick brown fox", "a"), (2, None, "b"), (3, "", None), (4, LONG, "d"), (5, "The quick brown fox", "a"), (None, "no id", "x"), (6, "   \n\n ", "y"), (7, "ß日本 é́ <|endoftext|> don't", "z"), (7, "ß日本 é́ <|endoftext|> don't", "z")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, ties, repeats, and extra columns with names the operators use inside."""
    return spark.createDataFrame([(i, t, x, 1, "k", 2.0, [1]) for i, t, x in ODD], "doc_id bigint, text string, lang string, n int, key string, score double, ids array<int>")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- quality -------------------------------------------------------------------


def test_crf_marginals_equal_enumeration():
    rng = np.random.RandomState(0)
    crf = Crf(4, 2)
    crf.weights[:], crf.moves[:], crf.first[:] = rng.randn(4, 2), rng.randn(2, 2), rng.randn(2)
    features, lengths = rng.randint(0, 4, (7, 1)), np.array([3, 4])
    post = crf.marginals(crf.emissions(features), Batch(lengths))
    best = crf.viterbi(crf.emissions(features), Batch(lengths))
    emit, at = crf.emissions(features), 0
    for n in lengths:
        paths = np.array(np.meshgrid(*[[0, 1]] * n, indexing="ij")).reshape(n, -1).T
        score = np.array([crf.first[p[0]] + sum(emit[at + t, p[t]] for t in range(n)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        w = np.exp(score - score.max())
        for t in range(n):
            assert post[at + t, 1] == pytest.approx(w[paths[:, t] == 1].sum() / w.sum())
        assert (best[at : at + n] == paths[score.argmax()]).all()
        at += n


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality.score_quality(docs, quality.train_quality(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert len(got) > 50 and ((got.score >= 0.7) == (got.quality == 1)).mean() > 0.95


def test_quality_odd_inputs(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (None, 0), (6, None)], "doc_id bigint, quality int")
    got = quality.score_quality(odd, quality.train_quality(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = quality.train_quality(odd, labels.limit(0))
    assert quality.score_quality(empty, none).count() == 0
    assert quality.score_quality(odd, none).select("score").distinct().count() == 1
    assert quality.keep_good(odd, labels, odd, 0.0).columns == odd.columns


# --- packing and token files ---------------------------------------------------


@pytest.mark.parametrize("name,end,kind", [("byte_bpe_50k.json", 2, "<u4"), ("word_bpe_49k.json", 1, "<u2")])
def test_pieces_give_the_ids_of_whole_texts(name, end, kind):
    import random

    from tokenizers import Tokenizer

    r = random.Random(5)
    letters = list(" \n  \n ab'cdéÉ0.,|!$\t ß日本İΣς’-×÷ɏɐ́\x00\x7f 　 ₂½º") + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000)] + ["", None, LONG, "x" * 99 + " " + "é" * 40]
    plain = Tokenizer.from_file(vocabulary(name))
    ours = Encoder(vocabulary(name), end, kind)
    for low in range(0, len(texts), 500):
        part = texts[low : low + 500]
        ids, at = ours.encode(pa.array(part))
        for t, a, b in zip(part, at[:-1], at[1:]):
            assert ids[a:b].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [end], repr(t)


def whole_ids(texts, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], dtype="<u4") for x in texts]


def test_hilbert_neighbours():
    cells = np.array([(a, b) for a in range(8) for b in range(8)])
    path = cells[np.argsort(packing.hilbert(cells, 3))]
    assert len(set(packing.hilbert(cells, 3))) == 64
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark, docs, odd, empty):
    for rows, ids in ((docs, None), (odd.where("doc_id is not null and doc_id <> 7"), None)):
        want = {r.doc_id: x for r, x in zip(rows.collect(), whole_ids([r.text for r in rows.collect()], packing.VOCABULARY, 1))}
        got = packing.pack_digest(packing.packed(rows)).toPandas().sort_values(["doc_id", "start"])
        assert set(got.doc_id) == set(want)
        for doc, g in got.groupby("doc_id"):
            assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(want[doc]) == g.doc_tokens.iloc[0]
            for p in g.itertuples():
                assert zlib.crc32(want[doc][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
            n = int(g.length.sum())
            assert n <= 2048 and n & (n - 1) == 0
    assert packing.packed(empty).count() == 0
    assert packing.packed(odd).agg(F.sum("length")).first()[0] == sum(map(len, whole_ids([t for _, t, _ in ODD], packing.VOCABULARY, 1)))


def test_token_files(spark, docs, odd, empty):
    rows = docs.orderBy("doc_id").collect()
    want, at = {}, 0
    for r, x in zip(rows, whole_ids([r.text for r in rows], tokenfile.VOCABULARY, 2)):
        want[r.doc_id] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    out = Scratch(spark).path()
    tokenfile.write_tokens(docs, out)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.file_digest(spark, out).collect()} == want
    one = tokenfile.read_tokens(spark, out).where("doc_id = 17")
    assert one.count() == 1 and "EqualTo(doc_id,17)" in one._jdf.queryExecution().toString()
    assert tokenfile.round_trip(odd).count() == len(ODD)
    assert tokenfile.round_trip(empty).count() == 0


def scanned(df):
    """Rows that left the scan."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_token_files_are_pruned_by_index_and_bloom_filter(spark):
    docs = spark.range(0, 20_000, 2).selectExpr("id AS doc_id", "concat('text ', id) AS text")  # even ids alone
    out = Scratch(spark).path()
    tokenfile.write_tokens(docs, out)
    rows = tokenfile.read_tokens(spark, out)
    assert scanned(rows) == 10_000
    assert 1 <= scanned(rows.where("doc_id = 5000")) <= 1000  # a row group at most
    assert scanned(rows.where("doc_id between 5000 and 5010")) <= 2000
    # within the bounds of a row group, but not in it: the Bloom filters say so, but for one in a hundred
    assert sum(scanned(rows.where(f"doc_id = {k}")) > 0 for k in range(4001, 4101, 10)) <= 2
    jvm = spark._jvm
    name = next(f for f in jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(jvm.org.apache.hadoop.fs.Path(out)) if f.getPath().getName().endswith(".orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(name.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsparkSession.sessionState().newHadoopConf()))
    assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
    stripe = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {s.getKind().toString() for s in stripe.getStreamsList()}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds and {e.getKind().toString() for e in stripe.getColumnsList()} <= {"DIRECT", "DIRECT_V2"}  # run-length encoding of integers, second version


# --- personal data -------------------------------------------------------------

SLOW = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= sum(c in "0123456789" for c in m) <= 19 and pii.luhn("".join(c for c in m if c in "0123456789").encode())),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c in "0123456789" for c in m) <= 15),
}


def test_base_spans_equal_plain_regexes():
    import random

    r = random.Random(1)
    letters = list("a.@-+ ()0123456789éX%_日\n") + ["4111 1111 1111 1111", "a.b@c.de", "10.0.0.1", "+1 (017) 555-7713", "378282246310005"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        want = sorted((m.start(), list(SLOW).index(k), k, m.end()) for k, (p, ok) in SLOW.items() for m in re.finditer(p, text) if ok(m[0]))
        raw = text.encode()
        chars = {len(text[:k].encode()): k for k in range(len(text) + 1)}
        got = [(chars[a], k, pii.KINDS[k], chars[b]) for k, a, b in pii.base_spans(raw)]
        assert got == want, repr(text)


def test_windows_decode_like_whole_texts():
    crf = pii.train_pii()
    for text in ("plain words alone here and there", "call +1 (017) 555-7713 or mail bob@x.org now", 'the token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" ends', "year 1999 page 12 at 10:30 costs $12.50"):
        words = text.split()
        shapes = np.array([pii.word_shape(w.encode()) for w in words])
        whole = crf.viterbi(crf.emissions(pii.chain_features(shapes, np.array([len(words)]))), Batch([len(words)]))
        spans = pii.crf_spans(crf, *flat(pa.array([text])))[0]
        assert len(spans) == sum(pii.STATES[s][:1] == "B" for s in whole)


def test_pii_finds_and_leaves_alone(spark, odd, empty):
    rows = [(1, "mail bob@x.org or call +1 (017) 555-7713 soon", 0), (2, 'a token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" b', 0), (3, "Version 2.0, page 12 of 1999 and 3.14", 0), (4, None, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int")
    got = by_id(pii.find_pii(d))
    assert (got[1].n_email, got[1].n_phone, got[2].n_added, got[3].spans, got[4].spans) == (1, 1, 1, "", "")
    assert got[1].base_sha256 == hashlib.sha256(b"email:5:14,phone:23:40").hexdigest()
    masked = by_id(pii.mask_pii(d))
    assert masked[1].text == "mail [EMAIL] or call [PHONE] soon" and masked[1].n_chars == len(masked[1].text)
    assert masked[3].text == rows[2][1] and masked[4].text is None
    assert pii.find_pii(odd).count() == len(ODD) and pii.find_pii(empty).count() == 0
    assert pii.mask_pii(odd).columns == odd.columns and pii.mask_pii(odd).count() == len(ODD)


# --- language ------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.predict_language(docs, language.train_language(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id")))
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_mixtures_and_odd_inputs(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.train_language(docs)
    part = {r.lang: r.text for r in docs.where("n_chars > 3000").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(1, part["de"][:3000] + "\n" + part["fr"][:1200])], "doc_id int, text string")
    got = language.predict_language(mixed, model).first()
    assert got.lang_pred == "de" and set(got.proportions) >= {"de", "fr"} and got.proportions["fr"] > 0.2
    rows = language.predict_language(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {2, 3, 6}
    assert language.predict_language(odd, language.train_language(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.predict_language(empty, model).count() == 0


# --- contamination -------------------------------------------------------------


def slow_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_contamination_equals_brute_force(spark, odd, empty):
    items = [("b", "one two three four five six seven eight nine ten eleven"), ("a", "THE quick-brown"), ("c", "word word"), ("d", None), (None, "quick brown fox"), ("e", "!!"), ("a", "THE quick-brown")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    text = "x one two three four five six seven eight nine ten eleven, the QUICK brown y one two"
    rows = odd.select("doc_id", "text").union(spark.createDataFrame([(90, text)], "doc_id bigint, text string")).where("doc_id is null or doc_id <> 7")
    want = {}
    for r in rows.collect():
        w, hit, names = slow_words(r.text), set(), set()
        for item, t in items:
            v = slow_words(t)
            for k in range(max(1, len(v) - 9) if v and item else 0):
                win = v[k : k + 10]
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        names.add(item)
            if r.doc_id == 4 and item == "c":
                hit, names = set(range(len(w))), names | {"c"}
        want[r.doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    for size in (1 << 20, 40):  # one block, several blocks
        found = contamination.find_contamination(rows, bench, block_bytes=size)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in contamination.digest(found).collect()}
        assert got == want
    span = by_id(contamination.find_contamination(rows, bench))[90].spans
    assert [text[s.a : s.b] for s in span] == ["one two three four five six seven eight nine ten eleven, the QUICK brown"]
    assert {r.doc_id for r in contamination.drop_contaminated(rows, bench).collect()} == {2, 3, None, 6}
    assert contamination.find_contamination(empty, bench).count() == 0
    assert contamination.digest(contamination.find_contamination(odd, bench.limit(0))).where("contaminated").count() == 0


# --- near-duplicates -----------------------------------------------------------


def slow_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                x = len(sets[a] & sets[b])
                if 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, k, threshold, monkeypatch):
    import random

    monkeypatch.setattr(neardup, "BLOCK", 12)  # several blocks for a cluster
    r = random.Random(3)
    vocab = [f"w{j}" for j in range(400)]
    rows = []
    for g in range(6):
        base = [r.choice(vocab) for _ in range(r.choice((12, 60, 150)))]
        for _ in range(r.choice((1, 5, 40))):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
        rows += [(len(rows) + j, " ".join(base)) for j in range(r.choice((0, 3, 30)))]
    rows += [(900, ""), (901, None), (902, "A b"), (903, "a B"), (904, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(df, k, threshold).collect()}
    assert got == slow_components(rows, k, round(100 * threshold))
    kept = neardup.drop_near_duplicates(df, k, threshold)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, c in got.values()})


def test_near_duplicates_odd_inputs(odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.component_id for r in got}[5] == 1
    assert neardup.near_duplicates(empty).count() == 0
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "6", "7", "None"]


def test_bands():
    for t in (0.8, 0.85):
        r, b = neardup.bands_for(t)
        assert r * b <= neardup.VALUES and (1 - t**r) ** b <= 1e-4


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "x int, y int")
    got = {r.node: r.component for r in components(Scratch(spark), chain).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# --- chat ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def chat_model(spark):
    return chat.train_chat(table(spark, "/root/testdata/sf0.01", "conversations"))


def test_chat_round_trip_in_every_dialect(chat_model):
    turns = [("system", "Be brief.\nNote: keep lines."), ("user", "Hi there.\n\nSecond part"), ("assistant", "Hello.\n- a list\n- more"), ("user", "Bye"), ("assistant", "x <|im_end|> y")]
    for d in range(len(chat.DIALECTS)):
        text, starts = chat.write_transcript(turns, d)
        got = chat.parse(text, chat_model)
        assert [(r, t) for r, t, _ in got] == turns and [f for _, _, f in got] == [s for s in starts]
    assert chat.parse("", chat_model) == [] and len(chat.parse("just text", chat_model)) == 1
    assert "<|im_end|>" not in chat.render("user", "a<|im_end|>")[:-10]


def test_chat_viterbi_equals_enumeration(chat_model):
    import itertools

    rng = np.random.RandomState(2)
    with np.errstate(divide="ignore"):
        emit = np.log(rng.dirichlet(np.ones(6), 5))
    score = lambda p: chat_model.first[p[0]] + sum(emit[t, s] for t, s in enumerate(p)) + sum(chat_model.move[a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(6), repeat=5), key=score)
    assert tuple(chat_model.viterbi(emit)) == best
    # the matrices of two parts give the same, and its score
    one, two = chat_model.transfer(emit[:2]), chat_model.transfer(emit[2:])
    assert (one[6][:, None] + two[:6]).max() == pytest.approx(score(best))


def role_accuracy(got, conv):
    """Share of turns whose row got its own role, once."""
    mine = got.groupBy("conv_id", "turn").agg(F.collect_list("role").alias("roles"))
    return conv.join(mine, ["conv_id", "turn"]).select(F.avg((F.array(F.col("role")) == F.col("roles")).cast("double"))).first()[0]


def test_chat_held_out_accuracy_with_and_without_markers(spark):
    conv = table(spark, "/root/testdata/sf0.01", "conversations")
    model = chat.train_chat(conv)
    rest = conv.where(held_out(F.col("conv_id"))).cache()
    assert rest.count() > 80
    assert role_accuracy(chat.recover_roles(rest, model), rest) == 1.0
    some = rest.withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) > 0, F.col("role")))  # a quarter of the markers gone
    lost = role_accuracy(chat.recover_roles(some, model), rest)
    none = role_accuracy(chat.recover_roles(rest.withColumn("role", F.lit(None).cast("string")), model), rest)
    print(f"accuracy: a quarter of the markers gone {lost:.3f}, all gone {none:.3f}")
    assert lost > 0.8 and none > 0.3


def test_chat_blocks_are_one_chain(spark, chat_model):
    # a long conversation in the dialect of names, which a system turn opens, and one whose turns have no number
    ids = [r.id for r in spark.range(200).where(f"pmod(xxhash64(id), {len(chat.DIALECTS)}) = 5").limit(2).collect()]
    turns = [("system", "Be brief.")] + [(("user", "assistant")[k % 2], f"Words of turn {k}.\nNote: more.") for k in range(199)]
    rows = [(ids[0], k, r, t) for k, (r, t) in enumerate(turns)] + [(ids[1], None, "user", f"x{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    whole = chat.parse(chat.write_transcript(turns, 5)[0], chat_model)
    assert [(r, t) for r, t, _ in whole] == turns
    for size in (7, 64, 1000):
        got = chat.recover_roles(df, chat_model, block_turns=size).where(F.col("conv_id") == ids[0]).orderBy("turn").collect()
        assert [r.role for r in got] == [r for r, _ in turns]
    assert chat.recover_roles(df, chat_model, block_turns=7).where(F.col("conv_id") == ids[1]).count() == 50


def test_chat_table(spark, sf):
    conv = table(spark, sf, "conversations")
    got = chat.recover_roles(conv)
    pairs = got.join(conv.select("conv_id", "turn", F.col("role").alias("want")), ["conv_id", "turn"])
    assert pairs.where("role = want").count() == conv.count() == got.count()
    rows = [(1, 0, "user", None, 1), (1, None, None, "x", 1), (None, 3, "assistant", "", 1), (1, 0, "user", None, 1), (2, 1, "robot", "y\nUser: z", 1)]
    odd = spark.createDataFrame(rows, "conv_id smallint, turn smallint, role string, text string, block int")
    assert chat.recover_roles(odd).count() >= len(rows)
    assert chat.recover_roles(odd.limit(0)).count() == 0


# --- pages ---------------------------------------------------------------------


def test_extraction_of_unseen_labelled_pages():
    model = extraction.train_pages()
    pages = extraction.labelled_pages(150, seed=77)
    assert sum(model.extract(p) == "\n".join(b) for p, b in pages) >= 145


def test_extraction_cases(spark):
    model = extraction.train_pages()
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy <b>now</b></div><article><h1>A &amp; B</h1><p>One\n two&nbsp;three<br>four <i>five</i>.<p>Six<!-- x --> seven<div class="share">Share me</div><p>Eight</article><section class="comments"><p>Nice post, thank you very much indeed</p></section><footer>&copy; me</footer>'
    assert model.extract(page) == "A & B\nOne two three\nfour five.\nSix seven\nEight"
    assert model.extract("") == "" and model.extract("<nav>x</nav>") == ""
    rows = [(1, "u", None, 1), (2, None, page, 1), (None, "v", "<p", 1), (3, "w", "<p>" + "word " * 50_000, 1), (2, None, page, 1)]
    odd = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = extraction.extract_text(odd).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert extraction.extract_text(odd.limit(0)).count() == 0


def test_extraction_follows_the_rules_of_attributes_and_references():
    model = extraction.train_pages()
    inside = lambda x: model.extract(f"<article><h1>T</h1>{x}<p>Some more words to end with here.</p></article>").split("\n")[1:-1]
    assert inside("<p title=don't>Hello there</p>") == ["Hello there"]
    assert inside("<p title='a > b' data-x=\"</p>\">Hello there</p >") == ["Hello there"]
    assert inside("<p>E = <math><mi>m</mi></math> c and a < b</p>") == ["E = m c and a < b"]
    assert inside("<p>one<svg><text>no</text></svg> two<script>if (a<b) '</p>'</script>.</p>") == ["one two."]
    assert inside("<p>&#65;&#0000000000066;&#" + "9" * 6000 + "; &amp;lt; &nosuch; &#x1F600;</p>") == ["AB\ufffd &lt; &nosuch; \U0001f600"]
    assert inside("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert inside("<p hidden>secret words</p><p>seen</p>") == ["seen"]
    assert model.extract("<p>Words before it all ends <a href='x") == "Words before it all ends"


@pytest.mark.parametrize("part", ["<a b ", "<div>", "<div>x", "<p title=\"x ", "<!-- ", "<script>", "<li>x", "</b <", "<ul><li><p>", "<p>x<span>", "&#x", "<table><tr><td>y", "<p><x><hr>", "< "])
def test_extraction_takes_time_in_proportion(part):
    import time

    model = extraction.train_pages()
    page = part * ((1 << 20) // len(part))
    began = time.process_time()
    model.extract(page)
    assert time.process_time() - began < 6  # some 200,000 tags; a quadratic scan takes hours


def test_extraction_of_the_tables_pages(spark, sf):
    import html

    pages = table(spark, sf, "pages")
    for r in extraction.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


# --- nearest neighbours --------------------------------------------------------


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_search_recall_and_exact_scores(spark, scale):
    vectors = table(spark, f"/root/testdata/sf{scale}", "embeddings")
    rows = vectors.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    got: dict = {}
    for r in ann.search(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        top = set(ids[np.lexsort((ids, -s))[:20]])
        mine = got[ids[k]]
        hit.append(len(top & {v for v, _ in mine}) / 20)
        assert len(mine) == 20 and mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        assert all(p[1] == pytest.approx(float(x[k] @ x[ids == p[0]][0]), abs=1e-12) for p in mine)
    assert np.mean(hit) >= 0.9


def test_search_ties_blocks_and_odd_vectors(spark):
    same = [1.0, 2.0]
    rows = [(k, same) for k in range(200)] + [(300, None), (301, [0.0, 0.0]), (302, [float("nan"), 1.0]), (303, [None, 1.0]), (304, [1.0]), (None, same), (400, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, bin_size=16, query_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {*range(0, 200, 20), 400}
    for q, near in got.items():
        # all products are 5: the smaller ids first
        assert near == [v for v in range(30) if v != q][:20]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, same), (1, [2.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.search(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1)]


def test_search_inside_a_tight_cluster(spark):
    state = np.random.RandomState(7)
    x = state.randn(3000, 16)
    x[:1000] = 2 * x[0] + 0.002 * state.randn(1000, 16)
    # few lists and few of its vectors fitted on: one list holds the whole cluster, its codes can't tell the vectors apart
    index = ann.Index(x[995:], 4)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, (F.col("vec_id") < 1000) & (F.col("vec_id") % 25 == 0), index).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 40
    for k, near in got.items():
        s = x @ x[k]
        s[k] = -np.inf
        assert near == np.lexsort((np.arange(3000), -s))[:20].tolist()


def test_quantised_guesses_decide_what_is_scored():
    x = np.random.RandomState(3).randn(4000, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, queries, k = np.arange(len(x)), np.arange(0, len(x), 80), 20
    index = ann.Index(x, 60)
    lists, codes = index.encode(x)
    probed = index.probes(x[queries], np.bincount(lists, minlength=60), k, 1.0)

    def measured(rerank, sigmas):
        asked, rows, _, scored = (s := ann.Scorer(index, ids, lists, codes, x, rerank, sigmas)).best(x[queries], queries, probed, k)
        hit = 0
        for j, q in enumerate(queries):
            score = x @ x[q]
            score[q] = -np.inf
            hit += len(set(np.argsort(-score, kind="stable")[:k]) & set(s.ids[rows[asked == j]]))
        return hit / len(queries) / k, scored / len(queries) / len(x)

    wide, narrow, bounded = measured(80, 0.0), measured(20, 0.0), measured(64, 3.0)
    assert narrow[0] < wide[0] - 0.02 and narrow[1] < wide[1] < 0.05  # the depth of exact scoring matters
    assert bounded[0] > 0.99 and bounded[1] < 0.3  # and what the error leaves open is made good


def test_chunks_are_bounded():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 100, "c", "d" * 5])})
    assert [p.num_rows for p in chunks(iter([batch]), "text", 12)] == [2, 1, 2]
