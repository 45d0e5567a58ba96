"""Every operator and stage on tables with awkward names, types, ids and rows."""

import pytest
from pyspark.sql import functions as F

from memlake.llm import ann, chat, contamination, extraction, language, neardup, packing, pii, quality, tokenfile

NAMES = "doc_id smallint, text string, lang string, n_chars int, `my-col` int, `a b` string, `x.y` string, `m` map<string,int>, `row` int, `ids` string, `struct` struct<`p q`:int>"
ROWS = [(1, "The quick brown fox jumps over it"), (2, None), (3, ""), (None, "no id, one"), (None, "no id, two"), (None, None), (7, "seven of one kind"), (7, "seven of another kind, quite"), (7, "seven of one kind"), (8, "The quick brown fox jumps over it"), (9, "mail bob@x.org or call +1 (017) 555-7713")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en", len(t or ""), 5, "s", "t", {"k": k}, 1, "z", (2,)) for k, (i, t) in enumerate(ROWS)], NAMES)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox"), (2, "seven of another")], "item_id int, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (8, 1)], "doc_id smallint, quality int")


def test_filtering_stages_keep_columns_and_rows(awkward, bench, labels):
    for out, n in (
        (quality.keep_good(awkward, labels, awkward, 0.0), len(ROWS)),
        (pii.mask_pii(awkward), len(ROWS)),
        (contamination.drop_contaminated(awkward, bench), len(ROWS) - 3),
        (neardup.drop_near_duplicates(awkward), len(ROWS) - 2),
    ):
        assert out.columns == awkward.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in awkward.schema]
        assert out.count() == n and out.where("doc_id is null").count() == 3
        assert out.limit(0).count() == 0
    left = neardup.drop_near_duplicates(awkward)
    assert sorted(r.text for r in left.where("doc_id = 7").collect()) == ["seven of another kind, quite", "seven of one kind"]
    assert left.where("doc_id = 8").count() == 0


def test_results_have_a_row_a_document(awkward, bench, labels):
    model = quality.train_quality(awkward, labels)
    for out in (
        quality.score_quality(awkward, model), pii.find_pii(awkward), language.predict_language(awkward, language.train_language(awkward)),
        contamination.digest(contamination.find_contamination(awkward, bench)), neardup.near_duplicates(awkward), tokenfile.round_trip(awkward),
    ):
        assert out.count() == len(ROWS) and out.where("doc_id is null").count() == 3
    assert packing.packed(awkward).select("doc_id").where("doc_id is null").count() >= 3


def test_contamination_is_alike_in_any_number_of_blocks(awkward, bench):
    one, many = (contamination.find_contamination(awkward, bench, block_bytes=size) for size in (1 << 20, 8))
    key = lambda df: sorted(map(repr, df.collect()))
    assert len(key(one)) == len(ROWS) and key(one) == key(many)
    assert contamination.drop_contaminated(awkward, bench, block_bytes=8).count() == len(ROWS) - 3


def test_near_duplicates_take_rows_of_one_id_apart(awkward):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(awkward, 3, 0.85).collect()}
    assert got[8, 5] == (1, False) and got[7, 2] == (7, True) and got[7, 3] == (7, True) and got[None, 1] == (None, True)


def test_near_duplicate_blocks_share_a_bucket(spark):
    """Many families in one cluster: pairs of blocks follow the buckets, not the square of the blocks."""
    n, per = 3000, 3
    rows = [(k * per + j, k * 10 + j, 0, 1, k) for k in range(n) for j in range(per)]
    member = spark.createDataFrame(rows, "cid long, comp long, cluster long, cell int, mk long")
    open_ = member.select(F.col("mk").alias("key"), "cid")
    placed = neardup.place(member)
    sizes = placed.groupBy("block").count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * neardup.BLOCK
    blocks = sizes.count()
    assert blocks >= n * per // neardup.BLOCK
    assert neardup.block_pairs(open_, placed).count() == blocks  # each with itself alone
    # a bucket with more classes than a block holds is cut, and all its parts meet
    hot = spark.createDataFrame([(k, k, 0, 1, 5) for k in range(5 * neardup.BLOCK)], "cid long, comp long, cluster long, cell int, mk long")
    placed = neardup.place(hot)
    parts = placed.select("block").distinct().count()
    assert parts >= 4 and neardup.block_pairs(hot.select(F.col("mk").alias("key"), "cid"), placed).count() == parts * (parts + 1) // 2


def test_other_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x", 1), (None, None, None, 2)], "page_id smallint, url string, html string, `a b` int")
    assert extraction.extract_text(pages).count() == 2
    conv = spark.createDataFrame([(1, 1, "user", "x", 1), (None, None, None, None, 2)], "conv_id smallint, turn tinyint, role string, text string, `a-b` int")
    assert chat.recover_roles(conv).count() == 2
    vec = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (None, [1.0], 1)], "vec_id smallint, embedding array<float>, `a.b` int")
    assert ann.search(vec, F.col("vec_id") % 20 == 0).count() == 1


def test_repeated_rows_of_a_vector_are_one(spark):
    """A repeated query has all its neighbours once, and a repeated neighbour takes one place."""
    rows = [(k, [float(k % 7 + 1), float(k % 11), 1.0 + k / 100]) for k in range(60)]
    repeated = rows + [rows[0]] * 3 + [rows[21]] * 5 + [(40, [0.5, 0.5, 0.5])]
    plain, again = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, repeated))
    key = lambda df: sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect()))
    got = key(again)
    assert key(spark.createDataFrame(rows + rows, plain.schema)) == key(plain)
    for q in (0, 20, 40):
        mine = [x for x in got if x[0] == q]
        assert [x[1] for x in mine] == list(range(1, 21)) and len({x[2] for x in mine}) == 20 and q not in {x[2] for x in mine}


def test_samples_take_one_row_of_an_id(spark):
    """An id that very many rows repeat brings one of them to a sample."""
    rows = [(k, f"line one of {k}\nline two, which is good\n", "en" if k % 2 else "fr") for k in range(40)]
    docs = spark.createDataFrame(rows + [rows[1]] * 4000 + [(3, "another text", "en")] * 50, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    once = spark.createDataFrame(rows, docs.schema)
    some, all_ = (language.train_language(d).logs for d in (docs, once))
    assert some.shape == all_.shape and abs(some - all_).max() < 1.0  # one text of a thousand copies wouldn't
    seen = []
    old, quality.fit = quality.fit, lambda sample: seen.append(sample) or old(sample)
    try:
        quality.train_quality(docs, labels, max_docs=10)
        quality.train_quality(docs, labels, max_lines=7)
    finally:
        quality.fit = old
    assert len(seen[0]) <= 10 and 0 < sum(len(n) // 8 for _, n, _ in seen[1]) <= 7


def test_many_spans_in_one_text_take_time_in_proportion():
    import random
    import time

    spans = [(0, 10 * k, 10 * k + 5) for k in range(60_000)]
    began = time.perf_counter()
    assert pii.apart([(4, 10 * k + 6, 10 * k + 9) for k in range(60_000)], spans)[-1] == (4, 599_996, 599_999)
    assert pii.apart(spans, spans) == [] and time.perf_counter() - began < 2
    r = random.Random(1)
    for _ in range(300):
        made = lambda n: [(0, a, a + r.randint(1, 6)) for a in sorted(r.randint(0, 60) for _ in range(n))]
        some, base = made(8), made(r.randint(0, 8))
        assert pii.apart(some, base) == [x for x in some if not any(x[1] < b[2] and b[1] < x[2] for b in base)]
