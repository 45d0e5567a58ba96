"""Registered queries of the subpackage and the pipeline."""

import duckdb
import pandas as pd
import pytest

from memlake.llm import contamination, neardup, pii, quality
from memlake.llm.common import table
from memlake.llm.queries import ORACLES, QUERIES


def cells(df):
    """Rows as tuples, in order; a missing number is None, and a column with some holds whole numbers as before."""
    whole = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted((tuple(map(whole, row)) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert cells(got[cols]) == cells(want[cols])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "decontamination", "pii", "packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
            out = out.cache()
        if name == "quality":
            scores = quality.score_quality(docs, quality.train_quality(docs, table(spark, sf, "labels"))).collect()
            assert ids(out) == {r.doc_id for r in scores if r.score >= quality.THRESHOLD}
        elif name == "near-dedup":
            from tests.llm.test_operators import slow_components

            want = slow_components([(r.doc_id, r.text) for r in docs.collect()], neardup.SHINGLE_WORDS, 80)
            assert ids(out) == {i for i, (_, c) in want.items() if i == c}
        elif name == "decontamination":
            scanner = contamination.Scanner([(str(r.item_id), r.text) for r in table(spark, sf, "benchmark").collect()])
            assert ids(out) == {r.doc_id for r in docs.collect() if not scanner.scan(r.text)[1]}
        elif name == "pii":
            before = {r.doc_id: r.text for r in docs.collect()}
            found = {r.doc_id for r in pii.find_pii(docs).collect() if r.spans}
            assert {r.doc_id for r in out.collect() if r.text != before[r.doc_id]} == found
            assert all(r.n_chars == len(r.text) for r in out.collect())
        else:
            assert ids(out) == ids(docs) and out.columns[:2] == ["doc_id", "start"]
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
