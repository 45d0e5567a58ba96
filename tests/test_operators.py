"""Behaviours that the registered tables don't reach, on literal rows."""

import pytest
from pyspark.sql import functions as F

from memlake.operators import calibration, consolidate, filters, queue, search, timeline
from memlake.sources import readers

GATE = "query_id int, rank int, query string, memory string, user_id string, agent_id string, score double, semantic_score double, bm25_score double, entity_boost double, final_score double, has_details boolean"


def gated(spark, rows, limit=10, with_query=True, **config):
    full = [(1, k + 1, q, m, "u", "a", f if s is None else s, sem, bm, e, f, True) for k, (q, m, f, sem, bm, e, s) in enumerate(rows)]
    out = search.gate(spark.createDataFrame(full, GATE), limit, search.GateConfig(**config), with_query)
    return [r.reason for r in out.orderBy("rank").collect()]


def test_gate_without_query_then_limit(spark):
    rows = [("", "m", .63, .70, .56, 0.0, None), ("", "m", .62, .68, .56, 0.0, None), ("", "m", .60, .64, .56, 0.0, None), ("", "m", .34, .68, 0.0, 0.0, None), ("", "m", .30, .60, 0.0, 0.0, None)]
    assert gated(spark, rows, 3, False, dense_only_threshold=.62) == ["passed"] * 3 + ["truncated_by_limit", "dense_threshold_failed"]


def test_gate_equal_to_threshold_passes(spark):
    assert gated(spark, [("", "m", .32, .70, 0.0, 0.0, None)], 5, False) == ["passed"]


def test_relative_floor_counts_only_rows_that_pass(spark):
    rows = [("", "m", .80, .9, .5, 0.0, None), ("", "m", .35, .5, .5, 0.0, None), ("", "m", .99, .99, .9, 0.0, .5)]
    assert gated(spark, rows, 5, False) == ["passed", "relative_floor_failed", "score_consistency_mismatch"]


def test_gate_zero_config_accepts_zero(spark):
    zero = dict(final_threshold=0, dense_only_threshold=0, relative_ratio=0, min_coverage=0, bm25_threshold=0, lexical_semantic_threshold=0)
    assert gated(spark, [("", "m", 0.0, 0.0, 0.0, 0.0, None)], 5, False, **zero) == ["passed"]


def test_gate_query_hazards_and_weak_collision(spark):
    assert gated(spark, [("Understood.", "m", .9, .9, .9, 0.0, None)]) == ["query_transient_log_or_directive"]
    weak = ("alpha beta gamma delta epsilon", "alpha only here", .36, .5, .2, 0.0, None)
    dense = ("alpha beta", "nothing shared", .85, .85, 0.0, 0.0, None)
    boost = ("alpha beta", "other", .40, .45, .1, .35, None)
    assert gated(spark, [weak, dense, boost]) == ["weak_lexical_collision_failed", "passed", "relative_floor_failed"]
    assert gated(spark, [boost]) == ["passed"]


def test_gate_numbers(spark):
    assert gated(spark, [("x y", "m", float("nan"), .5, .5, 0.0, None), ("x y", "m", None, .5, .5, 0.0, .4)]) == ["non_numeric_score_fields", "missing_required_score_fields"]
    assert gated(spark, [("xx yy", "xx yy", .9, .9, .9, 0.0, None)], 0) == ["truncated_by_limit"]
    with pytest.raises(ValueError):
        search.GateConfig(final_threshold=1.5)


def test_filters_fail_closed(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert df.where(filters.compile_filter({"NOT": [{"v": 1}]})).count() == 1
    assert df.where(filters.compile_filter({"v": {"ne": 1}})).count() == 1
    for bad in ({"v": {"like": 1}}, {"AND": []}):
        with pytest.raises(ValueError):
            filters.compile_filter(bad)
    with pytest.raises(ValueError):
        filters.scope_filter("project", "u")
    with pytest.raises(ValueError):
        filters.guarded_scan(df, 1)


def test_temporal_window():
    now = 1706659199
    assert timeline.temporal_window("past 2 hours", now) == (now - 7200, None, 2)
    assert timeline.temporal_window("昨天", now)[1] == now - now % 86400
    assert timeline.temporal_window("the port", now) is None and timeline.temporal_window("", now) is None
    with pytest.raises(ValueError):
        filters.validate_recent(0, 5, "all")


def test_arbitration_margin_and_symmetry(spark):
    cols = "id_{0} string, source_{0} string, last_confirmed_at_{0} bigint, confirmation_count_{0} int, created_at_{0} bigint"
    a, b = ("m1", "import", 1000, 1, 5), ("m2", "agent_explicit", 1060, 1, 4)
    for x, y in ((a, b), (b, a)):
        row = spark.createDataFrame([x + y], f"{cols.format('a')}, {cols.format('b')}")
        got = consolidate.arbitrate(row).first()
        assert (got.winner_id, got.reason) == ("m2", "authority")  # exactly at the margin: not recency


def test_lineage_floor(spark):
    members = spark.createDataFrame([("w", 3, ["m1"], 5), ("l", 1, ["m2"], 9)], "id string, count int, merged_ids array<string>, freshness int")
    edges = spark.createDataFrame([("w", "l")], "winner_id string, loser_id string")
    got = consolidate.lineage_counts(members, edges).first()
    assert (got.confirmation_count, got.merged_ids, got.freshness) == (5, ["l", "m1", "m2"], 9)


def test_lineage_counts_shared_members_once(spark):
    rows = [("A", 3, ["B", "C"], 1), ("B", 2, ["C"], 1), ("C", 1, [], 1), ("D", 1, [], 7), ("X", 5, ["Y"], 1), ("Y", 4, ["X"], 2)]
    members = spark.createDataFrame(rows, "id string, count int, merged_ids array<string>, freshness int")
    edges = spark.createDataFrame([("A", "D"), ("D", "X")], "winner_id string, loser_id string")
    got = {r.winner_id: (r.confirmation_count, r.merged_ids, r.freshness) for r in consolidate.lineage_counts(members, edges).collect()}
    assert got == {"A": (4, ["B", "C", "D"], 7), "D": (3, ["X", "Y"], 7)}  # a cycle owns 1 each


def test_first_edges_against_a_loop(spark):
    rows = [(1, 2, 1, 2), (2, 3, 3, 2), (1, 4, 4, 1), (4, 5, 4, 5), (3, 6, 3, 6), (7, 8, 8, 7), (7, 9, 7, 9)]
    got = {(r.a, r.b) for r in consolidate.first_edges(spark.createDataFrame(rows, "a int, b int, winner_id int, loser_id int")).collect()}
    assert got == in_order(rows)


def in_order(rows):
    dead, want = set(), set()
    for a, b, _, loser in sorted(rows):
        if a not in dead and b not in dead:
            want.add((a, b))
            dead.add(loser)
    return want


def test_first_edges_of_long_chains_and_hubs(spark):
    import random

    r = random.Random(4)
    chain = [(k, k + 1, k, k + 1) for k in range(1000)]  # each edge waits for the one before
    hub = [(2000, k, *r.choice(((2000, k), (2000, k), (k, 2000)))) for k in range(2001, 2300)]
    web = []
    for _ in range(600):
        a, b = sorted(r.sample(range(3000, 3150), 2))
        web.append((a, b, *r.choice(((a, b), (b, a)))))
    rows = chain + hub + list({(a, b): (a, b, c, d) for a, b, c, d in web}.values())
    df = spark.createDataFrame(rows, "a int, b int, winner_id int, loser_id int")
    for rounds, chunk in ((2, 100_000), (1, 150)):
        assert {(x.a, x.b) for x in consolidate.first_edges(df, rounds, chunk).collect()} == in_order(rows)


def test_deep_lineage_is_settled_to_its_end(spark):
    depth = 60
    rows = [(f"m{k}", k + 2, [f"m{k + 1}"] if k < depth else [], 1) for k in range(depth + 1)]
    members = spark.createDataFrame(rows, "id string, count int, merged_ids array<string>, freshness int")
    want = {}
    for k in range(depth, -1, -1):  # less what all below it own, not the next alone
        want[f"m{k}"] = max(1, k + 2 - sum(want.values()))
    assert {x.id: x.own for x in consolidate.own_counts(members).collect()} == want


def test_branches_of_any_length(spark):
    deep = spark.createDataFrame([(k, k - 1 if k else None) for k in range(3000)] + [(10_000 + k, 10_000 + (k + 1) % 5) for k in range(5)] + [(20_000, 99_999)], "id int, parent int")
    got = {(x.leaf, x.id): x.depth for x in queue.branch(deep, spark.createDataFrame([(2999,), (7,), (10_002,), (20_000,), (5_555,)], "leaf int")).collect()}
    want = {(2999, 2999 - d): d for d in range(3000)} | {(7, 7 - d): d for d in range(8)} | {(10_002, 10_000 + (2 + d) % 5): d for d in range(5)} | {(20_000, 20_000): 0}
    assert got == want


def test_knn_blocks_equal_one_block(spark):
    rows = [(k, k % 2, [float((k * 7 + j * 3) % 11 - 5) for j in range(4)]) for k in range(60)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "id bigint, identity int, embedding array<float>")
    one = {tuple(r) for r in consolidate.knn_edges(df, 3, 0.1, block=1000).collect()}
    many = {tuple(r) for r in consolidate.knn_edges(df, 3, 0.1, block=7).collect()}
    assert one == many and one


def test_queue_rules(spark):
    with pytest.raises(ValueError):
        queue.prunable(spark.range(1), ["pending"], 1, 1)
    jobs = spark.createDataFrame([("a", "processing", 1, 10)], "job_id string, state string, attempt int, claimed_at bigint")
    assert queue.expired_leases(jobs, 1000).first().next_state == "pending"
    assert queue.expired_leases(jobs, 310).count() == 0
    cyc = spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int")
    assert queue.branch(cyc, spark.createDataFrame([(1,)], "leaf int")).count() == 2


def test_chunks_against_a_loop(spark):
    texts = ["x" * n for n in (1000, 2600, 900, 3600, 10, 3490, 5)]
    got = spark.createDataFrame([(texts,)], "t array<string>").select(readers.pack_chunks(F.col("t")).alias("c")).first().c
    want, n = [], 0
    for t in texts:
        if want and n + len(t) <= 3500:
            want[-1] += "\n---\n" + t
            n += len(t)
        else:
            want.append(t)
            n = len(t)
    assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "proj-0123abcd").mkdir()
    (tmp_path / "proj-0123abcd" / "a.md").write_text("---\nname: n\n---\nbody")
    (tmp_path / "proj-0123abcd" / "MEMORY.md").write_text("index")
    r = rows = readers.markdown_notes(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and r[0].project == "proj" and r[0].body == "body"
    (tmp_path / "t.jsonl").write_text("\n".join(['{"role":"user","content":"x%d"}' % k for k in range(30)]))
    lines = readers.transcript_lines(spark, str(tmp_path / "t.jsonl"), 7)
    assert [t.content for t in readers.parse_turns(lines, "flat").orderBy("n").collect()] == [f"x{k}" for k in range(23, 30)]
    (tmp_path / "q.tsv").write_text("a\tb\tc\nq\td\t1\nq\te\t0\n")
    assert readers.qrels_tsv(spark, str(tmp_path / "q.tsv")).count() == 1
    with pytest.raises(ValueError):
        readers.digest_guard(spark, str(tmp_path / "q.tsv"), "0")
    assert readers.detect_shape({"sample_id", "conversation", "qa"}) == "dialogue"
    bad = spark.createDataFrame([("q", "t", "?", "a", ["s"], [], [[("user", "x")]], [])], f"question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<{readers.TURN}>>, answer_session_ids array<string>")
    with pytest.raises(Exception, match="unequal"):
        readers.long_memory(bad)[0].collect()


def test_decision_lists_every_reason():
    good = {"n": 40, "false_merge": 0, "false_supersede": 0, "must_abstain_violations": 0, "coverage": 0.6, "recall_equivalent": 0.9, "recall_conflict": 0.8, "cost_usd": 0.1, "latency_p95": 200}
    old = {"recall_equivalent": 0.91, "recall_conflict": 0.8, "cost_usd": 0.5, "latency_p95": 300}
    go = lambda t=None, b=None, accepts=2, origins=("measured", "measured"), **slices: calibration.disqualified({"EQUIVALENT": accepts, "CONFLICT": 2}, {"overall": good | (t or {}), **slices}, {"overall": old | (b or {})}, origins)
    assert go() == []
    assert go(accepts=0) == ["calibration_evidence_insufficient:EQUIVALENT"]
    assert go({"n": 3, "false_merge": 1, "must_abstain_violations": 1, "coverage": 0.4}) == ["sample_size_insufficient", "false_merges_exceeded", "must_abstain_violated", "coverage_below_minimum"]
    assert go(zh={"false_merge": 0, "false_supersede": 2}) == ["language_slice_safety_failure:zh:false_supersede"]
    assert go({"recall_equivalent": 0.88, "recall_conflict": None}, origins=("synthetic fixture", "x")) == ["non_decision_grade_measurements", "recall_drop_exceeded:overall:EQUIVALENT", "recall_evidence_missing:overall:CONFLICT"]
    assert go({"cost_usd": 0.3, "latency_p95": 301}) == ["cost_gate_failed", "latency_gate_failed"] and go(b={"cost_usd": 0, "latency_p95": None}) == ["baseline_cost_missing", "latency_evidence_missing"]


def test_links_of_frequent_and_rare_entities_stay(spark, tmp_path):
    from memlake.plans import registry

    rows = [(k, "frequent frequent" + (" singular" if k == 3 else ""), "en") for k in range(100)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["entity_link_prune"](spark, str(tmp_path)).collect())
    assert got == sorted([("frequent", str(k)) for k in range(100) if k % 7] + [("singular", "3")])


def test_later_sentences_are_asked(spark, tmp_path):
    from memlake.plans import registry

    spark.createDataFrame([(1, "First words. Then zebras!")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "zebras graze", "en"), (2, "nothing here", "en")], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.query_id, r.id) for r in registry.QUERIES["bm25_scores"](spark, str(tmp_path)).collect()] == [(1, "1")]
    assert [(r.id, r.overlap) for r in registry.QUERIES["lexical_candidates_topk"](spark, str(tmp_path)).orderBy("rank").collect()] == [("1", 1), ("2", 0)]


def test_agreement_is_counted_over_all_observations(spark, sf):
    from memlake.operators import decisions
    from memlake.plans import registry

    rows = spark.range(10).selectExpr("CAST(id AS STRING) AS id_a", "concat('x', id) AS id_b", "'DISTINCT' AS relation", "IF(id < 4, 'CONFLICT', 'DISTINCT') AS shadow_relation")
    assert {r.agrees: r["count"] for r in decisions.observations(rows, "salt").groupBy("agrees").count().collect()} == {True: 6, False: 4}
    assert decisions.shadow(rows, "salt", 3).count() == 3
    assert "Limit" not in registry.QUERIES["shadow_agreement"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_whole_tables_without_subset_filters(spark, sf):
    from memlake.plans import registry

    count = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").count()
    assert registry.QUERIES["epoch_to_iso"](spark, sf).count() == count("events")
    status = {r.state: r.n for r in registry.QUERIES["queue_status"](spark, sf).collect()}
    assert sum(status.values()) == count("events") and status["skipped"] > 0
    assert sum(r.n for r in registry.QUERIES["takeover_thresholds"](spark, sf).collect()) == count("labels")


def test_zero_counts_and_ties(spark):
    from memlake.operators import decisions

    jobs = spark.createDataFrame([("skipped",), ("skipped",)], "state string")
    assert {r.state: r.n for r in queue.status_counts(jobs).collect() if r.n} == {"skipped": 2}
    assert queue.status_counts(jobs).count() == len(queue.STATES)
    tie = F.create_map(F.lit("EQUIVALENT"), F.lit(0.4), F.lit("CONFLICT"), F.lit(0.4), F.lit("DISTINCT"), F.lit(0.2))
    assert spark.range(1).select(decisions.takeover(tie).alias("t")).first().t.reason == "tie"


# --- search as a call ----------------------------------------------------------


@pytest.fixture(scope="module")
def recalled(spark):
    memories = [
        ("1", "the store listens on port 6333", [1.0, 0.0], 0.0, "u", "global", "global", None), ("2", "the store port was 6000", [0.9, 0.1], 0.0, "u", "p", "project", "superseded"),
        ("3", "colours of the kitchen", [0.0, 1.0], 0.0, "u", "p", "project", ""), ("4", "port of another user", [1.0, 0.0], 0.0, "x", "p", "project", None),
        ("5", "a port in another project", [1.0, 0.0], 0.0, "u", "q", "project", None), ("6", None, None, None, "u", "p", "project", None), ("7", "store port default", [0.6, 0.8], 0.0, "u", "p", "project", "active"),
    ]
    mem = spark.createDataFrame(memories, "id string, memory string, embedding array<double>, entity_boost double, user_id string, agent_id string, scope string, status string")
    asks = spark.createDataFrame([(1, "which port does the store use", [1.0, 0.0]), (2, "", [0.0, 0.0]), (3, None, None)], "query_id int, query string, embedding array<double>")
    return asks, mem


def test_search_call_scope_threshold_and_limit(spark, recalled):
    from memlake.operators import recall

    asks, mem = recalled
    loose = search.GateConfig(final_threshold=0, dense_only_threshold=0, relative_ratio=0, min_coverage=0, bm25_threshold=0, lexical_semantic_threshold=0)
    ids = lambda **more: {(r.query_id, r.id) for r in recall.find(asks, mem, "u", project="p", config=loose, **more).collect()}
    assert ids(threshold=0.0) == {(1, "1"), (1, "3"), (1, "7")}  # of cosine 0, too
    assert ids() == {(1, "1"), (1, "7")}  # below the usual threshold
    assert ids(limit=1) == {(1, "1")} and ids(limit=0) == ids(limit=-3) == set()
    assert ids(custom={"id": ["3", "4", "5", "7"]}, threshold=0.0) == {(1, "3"), (1, "7")}  # a filter only narrows
    assert {r.id for r in recall.find(asks, mem, "u", scope="global", config=loose).collect()} == {"1"}
    with pytest.raises(ValueError):
        recall.find(asks, mem, "u", scope="project")
    rows = recall.trace(asks, mem, "u", project="p", limit=1, config=loose).collect()
    assert {(r.stage, r.id, r.passed) for r in rows} == {("candidate", "1", True), ("candidate", "7", True), ("lifecycle_scope", "1", True), ("lifecycle_scope", "7", True), ("gate", "1", True), ("gate", "7", False), ("final", "1", True)}
    assert recall.trace(asks, mem, "u", project="p", limit=0).count() == 0


def test_agent_search_routes(spark, recalled):
    from memlake.operators import recall

    _, mem = recalled
    now = 1706659199
    history = spark.createDataFrame([(1, "1", "ADD", None, "told today", "2024-01-30T10:00:00Z", ""), (2, "1", "ADD", None, "told yesterday", "2024-01-29T10:00:00Z", ""), (3, "2", "ADD", None, "superseded since", "2024-01-30T10:00:00Z", "")], "rowid int, memory_id string, event string, old_memory string, new_memory string, created_at string, updated_at string")
    call = lambda q, **more: {(r.route, r.text) for r in recall.agent_search(q, [1.0, 0.0], mem, history, now, "u", project="p", **more).collect()}
    assert call("what did I do yesterday") == {("timeline", "told yesterday")}
    assert call("what happened today") == {("timeline", "told today")}
    assert {r for r, _ in call("which port does the store use")} == {"search"}
    assert ("timeline", "told today") not in call("what happened today", custom={"agent_id": "p"})  # filters ask for a search


def test_lexical_scores_against_a_loop(spark, monkeypatch):
    import math
    import re

    monkeypatch.setattr(search, "QUERY_BLOCK", 2)  # several blocks
    mem = [(str(k), t) for k, t in enumerate(["alpha beta gamma alpha", "beta", "", None, "端口配置 port", "gamma delta delta", "x y z", "alpha"])]
    asks = [(1, "alpha delta"), (2, "gamma beta beta"), (3, "端口"), (4, ""), (5, "nothing here"), (6, None)]
    m, q = spark.createDataFrame(mem, "id string, memory string"), spark.createDataFrame(asks, "query_id int, query string")

    def terms(text):
        chars = re.findall("[一-鿿]", text or "")
        return [w for w in re.findall(r"[a-zA-Z0-9_\-]+", (text or "").lower()) if len(w) >= 2] + chars + [a + b for a, b in zip(chars, chars[1:])]

    held = {i: terms(t) for i, t in mem if terms(t)}
    average = sum(map(len, held.values())) / len(held)
    want = {}
    for k, t in asks:
        for i, words in held.items():
            total = 0.0
            for w in set(terms(t)):
                df, tf = sum(w in x for x in held.values()), words.count(w)
                total += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average)) if tf else 0
            if total:
                want[k, i] = total
    got = {(r.query_id, r.id): r.bm25_raw for r in search.bm25(q, m).collect()}
    assert got == pytest.approx(want) and want
    best = {}
    for r in search.proxy_candidates(q, m, 3).collect():
        best.setdefault(r.query_id, {})[r.rank] = (r.id, r.overlap)
    for k, t in asks:
        ranked = sorted(((len(set(terms(t)) & set(terms(x))), i) for i, x in mem), reverse=True)[:3]
        assert [best[k][r] for r in (1, 2, 3)] == [(i, n) for n, i in ranked]


def test_link_arrays_are_pruned(spark):
    entities = spark.createDataFrame([("a", ["1", "2"]), ("b", ["2"]), ("c", ["3", "3"])], "entity_id string, linked_memory_ids array<string>")
    got = {r.entity_id: r.linked_memory_ids for r in consolidate.prune_links(entities, spark.createDataFrame([("2",)], "id string")).collect()}
    assert got == {"a": ["1"], "c": ["3"]}


def test_stand_in_embedder_is_stable_and_of_unit_length(spark):
    from memlake.operators import records

    df = spark.createDataFrame([(1, "port"), (2, "port"), (3, "other"), (4, None)], "item_id int, text string")
    got = {r.item_id: r.embedding for r in records.with_embedding(df, "text", records.HashEmbedder(16)).collect()}
    assert got[1] == got[2] != got[3] and all(len(v) == 16 for v in got.values() if v)
    assert sum(x * x for x in got[1]) == pytest.approx(1.0, abs=1e-5)


def test_job_states_on_a_stream_of_several_batches(spark, tmp_path):
    import random

    from memlake.operators import machine
    from memlake.streaming import jobs as stream

    r = random.Random(6)
    rows = [(f"j{r.randrange(12)}", 100 * k, k, r.choice(machine.ACTIONS), r.random() < 0.7) for k in range(400)]
    kinds = "job_id string, moment bigint, seq bigint, action string, retryable boolean"
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], kinds).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    want = {}
    for job, moment, _, action, retryable in rows:
        want[job] = machine.advance(want.get(job, machine.Job()), moment, action, retryable)
    batch = {x.job_id: machine.Job(*x[1:]) for x in machine.final_states(spark.createDataFrame(rows, kinds)).collect()}
    assert batch == want and len({x.state for x in want.values()}) > 2
    # files come in the order of their age
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    live = {x.job_id: machine.Job(*x[1:]) for x in machine.latest(stream.run_available(spark, machine.follow(source), "update")).collect()}
    assert live == want


def test_job_rules():
    from memlake.operators.machine import Job, advance

    job = advance(Job(), 0, "enqueue", None)
    assert advance(job, 0, "enqueue", None)._replace(actions=1) == job  # an existing job stays
    job = advance(job, 10, "claim", None)
    assert (job.state, job.claimed_at) == ("processing", 10) and advance(job, 310, "expire", None).state == "processing"
    job = advance(job, 311, "expire", None)
    assert (job.state, job.attempt, job.not_before) == ("pending", 1, 321) and advance(job, 320, "claim", None).state == "pending"
    job = advance(advance(job, 321, "claim", None), 322, "fail", True)
    assert (job.state, job.attempt, job.not_before) == ("pending", 2, 342)
    job = advance(job, 400, "fail", True)
    assert (job.state, job.attempt) == ("dead", 3) and advance(job, 401, "retry", None).attempt == 0
    gone = advance(job, 402, "prune", None)
    assert gone.tombstone and advance(gone, 403, "enqueue", None).state is None and advance(gone, 403, "retry", None).state is None
    with pytest.raises(ValueError):
        advance(job, 1, "lose", None)


def test_overlay_needs_an_exact_cover(spark):
    samples = spark.createDataFrame([(1, "a"), (2, "b")], "id int, gold string")
    seen = spark.createDataFrame([(1, "x", None), (2, None, 5)], "id int, relation string, latency_ms int")
    got = {r.id: (r.gold, r.relation, r.latency_ms, r.cost) for r in calibration.with_defaults(samples, seen, {"latency_ms": 9, "cost": 0.1}).collect()}
    assert got == {1: ("a", "x", 9, 0.1), 2: ("b", None, 5, 0.1)}
    for bad in (seen.where("id = 1"), seen.union(seen.limit(1)), seen.union(spark.createDataFrame([(3, "x", 1)], seen.schema))):
        with pytest.raises(ValueError):
            calibration.with_defaults(samples, bad, {})


def test_thresholds_and_ties(spark):
    rows = [("EQUIVALENT", .80, .25), ("EQUIVALENT", .79, .9), ("CONFLICT", .75, .2), ("CONFLICT", .9, .19), ("DISTINCT", .34, .01), ("DISTINCT", .5, 0.0), (None, None, None), ("OTHER", .9, .9)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, prediction string, probability double, margin double")
    assert [r.a for r in df.select("k", calibration.accepted().alias("a")).orderBy("k").collect()] == ["EQUIVALENT", None, "CONFLICT", None, "DISTINCT", None, None, None]


def test_guards(spark):
    from datetime import date

    rows = spark.createDataFrame([("1", "2020-01-01"), ("2", None), ("3", "2099-01-01")], "id string, expiration_date string")
    assert filters.guarded_identity(rows, date(2024, 1, 1), 3).count() == 2
    with pytest.raises(ValueError):
        filters.guarded_identity(rows, date(2024, 1, 1), 2)  # the expired one counts in the first probe
    assert filters.validate_addition(" x ", "global", "pitfall") == "x"
    for bad in (("", "global", "general"), ("y" * 2001, "global", "general"), ("y", "all", "general"), ("y", "global", "other")):
        with pytest.raises(ValueError):
            filters.validate_addition(*bad)
    with pytest.raises(ValueError):
        filters.ingest_budget(rows, 0, 1.0, 1.0, F.lit(1))
    verdict = lambda n, cost: filters.ingest_budget(rows, n, cost, 1.0, F.lit(1_000_000)).first().verdict
    assert (verdict(3, 3.0), verdict(2, 3.0), verdict(3, 2.9)) == ("ok", "too_many_items", "too_costly")


def test_held_turns_are_found_in_a_row(spark):
    rows = [("new", "s", 9, ["a", "b", "c", "b"]), ("in", "s", 1, ["b", "c"]), ("gap", "s", 2, ["a", "c"]), ("none", "s", 3, []), ("long", "s", 4, ["a", "b", "c", "b", "d"]), ("part", "s", 5, ["a", "b", "c", "b"])]
    got = {r.job_id: r.state for r in queue.coalesce_sessions(spark.createDataFrame(rows, "job_id string, session_id string, created_at int, turns array<string>")).collect()}
    assert got == {"new": "pending", "in": "coalesced", "gap": "pending", "none": "coalesced", "long": "pending", "part": "coalesced"}


def test_apply_then_revert_gives_the_same_records(spark):
    from memlake.operators import journal

    kinds = "id string, memory string, status string, superseded_by string, merged_ids array<string>, confirmation_count int, last_confirmed_at bigint, updated_at bigint, `odd name` int"
    rows = [("w", "x", None, None, ["m"], 2, 50, 5, 1), ("l", "x", "", None, ["k"], 3, 90, 6, 2), ("c", "y", "active", None, None, None, None, None, 3), ("d", "z", None, None, None, 1, 7, 8, 4), ("other", "q", None, None, None, 1, 7, 8, 5)]
    before = spark.createDataFrame(rows, kinds)
    outcome = spark.createDataFrame([("1", "w", "l", "EQUIVALENT", "applied"), ("2", "d", "c", "CONFLICT", "applied"), ("3", "other", "w", "EQUIVALENT", "loser_changed")], "operation_id string, winner_id string, loser_id string, relation string, outcome string")
    after, entries = journal.applied(before, outcome, 100)
    got = {r.id: r for r in after.collect()}
    assert (got["w"].confirmation_count, got["w"].merged_ids, got["w"].last_confirmed_at, got["w"].status, got["w"].updated_at) == (5, ["k", "l", "m"], 90, None, 100)
    assert (got["l"].status, got["l"].superseded_by, got["c"].superseded_by) == ("superseded", "w", "d")
    assert (got["d"].confirmation_count, got["d"].updated_at) == (1, 8) and got["other"].updated_at == 8  # a conflict leaves its winner alone
    back = journal.restored(after, entries)
    assert back.schema == before.schema and sorted(map(repr, back.collect())) == sorted(map(repr, before.collect()))


def test_claimed_jobs_are_processed(spark):
    from memlake.operators import machine

    turns = spark.createDataFrame([(1, 0, "user", "Please move the store to port 7001"), (1, 1, "assistant", "The store listens on 7001 now."), (2, 0, "user", "ok"), (2, 1, "assistant", "done."), (3, 0, "user", "  ")], "conv_id int, turn int, role string, content string")
    jobs = spark.createDataFrame([("j1", 1), ("j2", 2), ("j3", 3), ("j4", 4), ("j5", 1)], "job_id string, conv_id int")
    none = spark.createDataFrame([], "cursor string")
    got = {r.job_id: r for r in machine.process(jobs, turns, none, "p").collect()}
    assert {k: (r.action, r.reason) for k, r in got.items()} == {"j1": ("complete", None), "j2": ("skip", "pre_transient_only"), "j3": ("skip", "no_turns"), "j4": ("skip", "no_turns"), "j5": ("skip", "already_distilled")}
    again = machine.process(jobs.where("job_id = 'j1'"), turns, spark.createDataFrame([(got["j1"].cursor,)], "cursor string"), "p").first()
    assert (again.action, again.reason) == ("skip", "already_distilled")


def test_transcripts_within_a_byte_bound(spark, tmp_path):
    text = "\n".join(['{"role":"user","content":"é%d"}' % k for k in range(10)])
    (tmp_path / "t.jsonl").write_text(text)
    (tmp_path / "u.jsonl").write_text(text)
    whole = readers.transcript_lines(spark, str(tmp_path / "t.jsonl"), 3)
    file = whole.first().file
    cut = len("\n".join(text.split("\n")[:4]).encode()) + 5  # into the fifth line
    bound = spark.createDataFrame([(file, cut)], "file string, max_bytes bigint")
    got = readers.parse_turns(readers.transcript_lines(spark, str(tmp_path), 3, bound), "flat").orderBy("file", "n").collect()
    assert [(r.file[-7], r.content) for r in got] == [("t", "é2"), ("t", "é3"), ("u", "é7"), ("u", "é8"), ("u", "é9")]


def test_consolidation_recovers_applies_in_order_and_repeats_nothing(spark):
    from memlake.operators import consolidation, journal

    kinds = "id string, memory string, status string, source string, created_at bigint, superseded_by string, merged_ids array<string>, confirmation_count int, last_confirmed_at bigint, updated_at bigint"
    row = lambda i, at, **k: (i, k.get("text", i), k.get("status"), "import", at, None, None, 1, at, at)
    memories = spark.createDataFrame([row("a", 1), row("b", 1000), row("c", 2000), row("d", 3000), row("e", 4000), row("f", 5000, status="superseded"), row("g", 6000)], kinds)
    old = consolidation.plan(memories, spark.createDataFrame([("d", "e", "EQUIVALENT")], "a string, b string, relation string"))  # planned, not applied
    decided = spark.createDataFrame([("b", "a", "EQUIVALENT"), ("b", "c", "CONFLICT"), ("a", "c", "EQUIVALENT"), ("d", "g", "EQUIVALENT"), ("f", "g", "EQUIVALENT"), ("a", "a", "EQUIVALENT"), ("c", "g", "DISTINCT")], "a string, b string, relation string")
    none = spark.createDataFrame([], "operation_id string, status string")
    after, outcomes, entries = consolidation.run(memories, decided, old, none, 9999)
    # d lost to e in the recovery, so its later pair is no pair; a lost to b, so a-c is skipped; b lost to c afterwards
    assert {(r.phase, r.winner_id, r.loser_id, r.outcome) for r in outcomes.collect()} == {("recovery", "e", "d", "applied"), ("run", "b", "a", "applied"), ("run", "c", "b", "applied")}
    now = {r.id: (r.status, r.superseded_by, r.confirmation_count) for r in after.collect()}
    assert now["d"] == ("superseded", "e", 1) and now["e"][2] == 2 and now["a"][:2] == ("superseded", "b") and now["b"][:2] == ("superseded", "c") and now["c"] == (None, None, 1) and now["g"] == (None, None, 1)
    again, second, _ = consolidation.run(after, decided, old, outcomes.select("operation_id", journal.F.lit("applied").alias("status")), 10_000)
    assert {r.outcome for r in second.collect()} <= {"already_applied"} and sorted(map(repr, again.collect())) == sorted(map(repr, after.collect()))
    assert sorted(map(repr, journal.restored(after, entries).collect())) == sorted(map(repr, memories.collect()))


def test_a_second_opinion_has_guards_and_a_budget(spark):
    from memlake.operators import decisions

    kinds = ", ".join(f"{c}_{s} string" for s in "ab" for c in ("id", "text", "user_id", "agent_id", "status")) + ", relation string, shadow_relation string"
    pair = lambda k, said="DISTINCT", b=(None, None), **x: (f"a{k}", "t", "u", "p", None, x.get("id", f"b{k}"), x.get("text", "t"), b[0] or "u", b[1] or "p", x.get("status"), "DISTINCT", said)
    rows = spark.createDataFrame([pair(k) for k in range(5)] + [pair(5, "CONFLICT"), pair(6, None), pair(7, b=("x", None)), pair(8, b=(None, "q")), pair(9, status="superseded"), pair(10, id=""), pair(11, text=None)], kinds)
    run = lambda n, **k: decisions.shadow_run(rows, "u", "p", k.get("scope", "project"), ["p"], "salt", n)
    report = lambda df: decisions.shadow_report(df).first().asDict()
    assert report(run(100)) == {"attempted": 7, "observed": 6, "failed": 1, "skipped_guard": 5, "skipped_budget": 0, "disagreements": 1, "status": "degraded"}
    some = report(run(3))
    assert (some["attempted"], some["skipped_budget"]) == (3, 4) and report(run(0))["skipped_budget"] == 7
    assert report(run(9, scope="all"))["status"] == "not_allowed" and run(9, scope="all").where("shadow_relation is not null").count() == 0
    assert run(100).select("fingerprint").distinct().count() == 12 and run(100).where("relation <> 'DISTINCT'").count() == 0


def slow_lineage(members, operations, chained):
    """(own by id, {winner: (count, merged ids, fresh)}) by recursion over sets; members: {id: (count, merged ids, contributions, fresh)}."""
    hints = {}
    for r in members.values():
        for m, n in (r[2] or {}).items():
            hints[m] = max(hints.get(m, 0), n)

    def closure(roots, more):
        entered, stack = set(roots), list(roots)
        while stack:
            m = stack.pop()
            for c in [*(members[m][1] if m in members else ()), *more.get(m, ())]:
                if c not in entered:
                    entered.add(c)
                    stack.append(c)
        return entered | {k for m in entered if m in members for k in members[m][2] or ()}

    own = {}

    def value(m):
        if m not in own:
            if m not in members:
                own[m] = max(1, hints.get(m, 0))
            elif members[m][2]:
                own[m] = members[m][2].get(m, 1)
            else:
                own[m] = max(1, members[m][0] - sum(value(c) for c in closure([m], {}) - {m}))
        return own[m]

    for m in members:
        value(m)
    losers = {}
    for w, x in operations:
        losers.setdefault(w, []).append(x)
    out = {}
    for w, lost in losers.items():
        union = closure([w, *lost], losers if chained else {})
        out[w] = (sum(value(m) for m in union), sorted(union - {w}), max([members[m][3] for m in union if m in members and members[m][3] is not None], default=None))
    return {m: own[m] for m in members}, out


def made_lineages(r, n):
    """Lineages without cycles: members name some of those before them, some ids have no record, some members a snapshot."""
    members = {}
    for k in range(n):
        below = sorted({f"m{r.randrange(k)}" for _ in range(r.choice((0, 0, 1, 1, 2, 4)))}) if k else []
        below += [f"gone{r.randrange(5)}"] if r.random() < 0.1 else []
        said = {f"m{k}": r.randint(0, 3), **{x: r.randint(0, 4) for x in below}} if r.random() < 0.1 else None
        members[f"m{k}"] = (r.randint(1, 9), below, said, r.choice((None, r.randint(1, 99))))
    return members


@pytest.mark.parametrize("limit", [500_000, 0])
def test_lineages_equal_recursion(spark, limit):
    """In tasks, and by rounds of joins where no component is small enough."""
    import random

    from memlake.operators import lineage

    for trial in range(2 if limit else 1):
        r = random.Random(trial)
        members = {f"{part}.{k}": (c, [f"{part}.{x}" for x in below], {f"{part}.{x}": v for x, v in said.items()} if said else None, at) for part in range(6) for k, (c, below, said, at) in made_lineages(r, r.choice((1, 3, 9, 20))).items()}
        names = sorted(members)
        operations = [(a, b) for a, b in (r.sample(names, 2) for _ in range(8)) if a.split(".")[0] < b.split(".")[0]]
        rows = lineage.member_rows(spark.createDataFrame([(m, *v) for m, v in members.items()], "id string, count bigint, merged_ids array<string>, contributions map<string,bigint>, fresh bigint"))
        asked = spark.createDataFrame([(f"o{k}", *o) for k, o in enumerate(operations)], "operation_id string, winner_id string, loser_id string")
        for chained in (True, False) if limit else (True,):
            own, merged = slow_lineage(members, operations, chained)
            got = lineage.absorbed(rows, asked, chained, limit).collect()
            assert {x.id: (x.confirmation_count, x.merged_ids, x.fresh) for x in got} == merged
            assert all(x.own == own[x.id] and sum(x.contributions.values()) == x.confirmation_count for x in got)
        assert {x.id: x.own for x in lineage.owned(rows, limit).collect()} == own


def test_lineages_that_are_deep_or_wide():
    """A fold of a chain of 100,000 levels, of a hub of 100,000 members, and of a flat lineage of 400, in which each holds all before it."""
    from memlake.operators.lineage import Fold

    none = (None, None, None, None)
    chain = Fold({k: (k + 2, [k - 1] if k else [], *none) for k in range(100_000)})
    want, total = {}, 0
    for k in range(100_000):
        want[k] = max(1, k + 2 - total)
        total += want[k]
    assert chain.own == want
    hub = Fold({0: (100_007, list(range(1, 100_001)), *none)} | {k: (1, [], *none) for k in range(1, 100_001)})
    assert hub.own[0] == 7 and next(hub.patches([("o", 0, 100_001)], True))[2] == 100_008
    flat = Fold({k: (2 * k + 1, list(range(k)), *none) for k in range(400)})
    assert all(flat.own[k] == (1 if k == 0 else 2) for k in range(400))


def test_components_of_chains_and_hubs(spark):
    from memlake.operators.components import components

    edges = [(k, k + 1) for k in range(1000)] + [(5000, 5001 + k) for k in range(3000)] + [(9000, 9000), (9001, None), (20_002, 20_001), (20_003, 20_002), (20_001, 20_003)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert got == {k: 0 for k in range(1001)} | {k: 5000 for k in range(5000, 8001)} | {20_001 + k: 20_001 for k in range(3)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_shared_lineage_counts_once_and_other_identities_refuse(spark):
    from memlake.operators import journal

    kinds = "id string, status string, superseded_by string, merged_ids array<string>, confirmation_count int, last_confirmed_at bigint, updated_at bigint, user_id string, agent_id string, source string, merged_sources array<string>, merged_contributions map<string,int>, supersede_reason string, superseded_at bigint"
    row = lambda i, ids, n, at=1, user="u", source="import": (i, None, None, ids, n, at, 1, user, "p", source, None, None, None, None)
    memories = spark.createDataFrame([row("W", ["x"], 5), row("L", ["x"], 4, 9, source="agent_explicit"), row("x", None, 2), row("A", ["B", "C"], 3), row("B", ["C"], 2), row("C", None, 1), row("D", None, None, 7), row("F", ["y"], 2), row("y", None, 1, user="other"), row("G", None, 1), row("K", None, 1), row("M", None, 1)], kinds)
    outcome = spark.createDataFrame([(k, w, x, kind, "applied") for k, w, x, kind in (("1", "W", "L", "EQUIVALENT"), ("2", "A", "D", "EQUIVALENT"), ("3", "G", "F", "EQUIVALENT"), ("4", "K", "M", "CONFLICT"))], "operation_id string, winner_id string, loser_id string, relation string, outcome string")
    patches, judged = journal.absorbed(memories, outcome)
    assert {r.operation_id: r.outcome for r in judged.collect()} == {"1": "applied", "2": "applied", "3": "cross_identity_lineage", "4": "applied"}
    after, entries = journal.applied(memories, judged, 50, patches)
    got = {r.id: r for r in after.collect()}
    assert (got["W"].confirmation_count, got["W"].merged_ids, got["W"].merged_sources, got["W"].last_confirmed_at) == (7, ["L", "x"], ["agent_explicit", "import"], 9)  # 3 + 2 + 2, x once
    assert (got["A"].confirmation_count, got["A"].merged_ids, got["A"].merged_contributions) == (4, ["B", "C", "D"], {"A": 1, "B": 1, "C": 1, "D": 1})
    assert (got["L"].status, got["L"].supersede_reason, got["L"].superseded_at) == ("superseded", "equivalent_merged", 50) and got["M"].supersede_reason == "conflict_overridden"
    assert (got["F"].status, got["G"].confirmation_count, got["K"].confirmation_count) == (None, 1, 1)
    assert sorted(map(repr, journal.restored(after, entries).collect())) == sorted(map(repr, memories.collect()))


def test_consolidation_run_equals_a_loop(spark, sf):
    """The registered run over all records: pairs in order, those of a superseded record left out, then every winner by recursion."""
    from memlake.plans import q_consolidate, q_lineage, registry
    from memlake.plans.views import NOW

    mem = {r.id: r for r in q_lineage.view(spark, sf, "mem").collect()}
    arb = {(r.id_a, r.id_b): r for r in consolidate.arbitrate(q_consolidate.pairs(spark, sf)).collect()}
    gone = lambda i: mem[i].status == "superseded"
    edges = sorted((*sorted(k), r.winner_id, r.loser_id, "CONFLICT" if int(k[1]) % 9 == 0 else "EQUIVALENT") for k, r in arb.items() if not gone(k[0]) and not gone(k[1]))
    lost, merged = {}, []
    for a, b, winner, loser, kind in edges:
        if a not in lost and b not in lost:
            lost[loser] = winner
            if kind == "EQUIVALENT":
                merged.append((winner, loser))
    members = {i: (r.confirmation_count or 1 if (r.confirmation_count or 1) >= 0 else 1, [], None, r.last_confirmed_at) for i, r in mem.items()}
    _, grown = slow_lineage(members, merged, True)
    want = set()
    for i, r in mem.items():
        n, ids, fresh = grown.get(i, (r.confirmation_count, None, r.last_confirmed_at))
        want.add((i, "superseded" if i in lost else r.status, lost.get(i), n, ",".join(ids) if ids is not None else None, fresh, NOW if i in lost or i in grown else r.updated_at))
    assert set(map(tuple, registry.QUERIES["consolidation_run"](spark, sf).collect())) == want and lost


def test_windows_by_rolling_hashes_equal_a_loop():
    import random

    import numpy as np

    r = random.Random(8)
    for _ in range(200):
        newest = np.array([r.randrange(3) for _ in range(r.randint(0, 30))], dtype=np.uint64)
        older = [np.array(newest[a : a + r.randint(0, 9)] if r.random() < 0.5 else [r.randrange(3) for _ in range(r.randint(0, 6))], dtype=np.uint64) for a in [r.randint(0, 30) for _ in range(12)]]
        inside = lambda x: any((newest[i : i + len(x)] == x).all() for i in range(len(newest) - len(x) + 1)) or not len(x)
        assert queue.held(newest, older).tolist() == [inside(x) for x in older]


def test_snapshots_of_one_session_in_many_buckets(spark):
    """A hundred thousand snapshots of one session; another host, user or namespace of the same session id keeps its jobs."""
    turns = [f"t{k % 7}-{k % 11}" for k in range(400)]
    rows = [(k, "codex", "s", "u", "n", k, turns[k % 350 : k % 350 + 1 + k % 40] if k % 3 else [f"t{k}", "x"]) for k in range(100_000)]
    rows += [(200_000, "codex", "s", "u", "n", 999_999, turns), (200_001, "pi", "s", "u", "n", 1, turns[:3]), (200_002, "codex", "s", "v", "n", 1, turns[:3]), (200_003, "codex", "s", "u", "m", 1, turns[:3]), (200_004, "codex", "s", None, "n", 1, turns[:3]), (200_005, "codex", "s", "u", "n", 2, None)]
    df = spark.createDataFrame(rows, "job_id long, host string, session_id string, user_id string, namespace string, created_at long, turns array<string>")
    got = {r.job_id: (r.state, r.superseded_by) for r in queue.coalesce_sessions(df, bucket_turns=100_000).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == (("coalesced", 200_000) if k % 3 else ("pending", None)) for k in range(100_000))
    assert all(got[k] == ("pending", None) for k in range(200_000, 200_005)) and got[200_005] == ("coalesced", 200_000)


def test_pivots_prune_pairs_and_lose_none(spark):
    """Skewed clusters: one identity holds most vectors, one cluster a third of them, some of them copies."""
    import numpy as np

    from pyspark.sql import functions

    from memlake.operators import similarity

    r = np.random.RandomState(5)
    centres = r.randn(30, 16)
    sizes = [1000, *[60] * 29]
    x = np.concatenate([c + 0.25 * r.randn(n, 16) for c, n in zip(centres, sizes)])
    x[:200] = x[0]
    identity = np.where(r.rand(len(x)) < 0.85, 0, r.randint(1, 5, len(x)))
    rows = [(k, int(g), v.tolist()) for k, (g, v) in enumerate(zip(identity, x))] + [(90_000, 0, None), (90_001, 0, [0.0] * 16), (90_002, 0, [1.0]), (90_003, None, x[3].tolist()), (90_004, 0, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id bigint, identity int, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    cosine[identity[:, None] != identity[None, :]] = -2
    np.fill_diagonal(cosine, -2)
    for threshold, k, block, seeds in ((0.85, 10, 64, None), (0.85, 5, 1024, functions.col("id") % 3 == 0), (0.0, 3, 200, None)):
        want = set()
        for a in range(len(x)):
            if seeds is None or a % 3 == 0:
                order = np.lexsort((np.arange(len(x)), -cosine[a]))[:k]
                want |= {(a, int(b)) for b in order if cosine[a, b] >= threshold}
        join = similarity.Join(df, threshold, seeds, block)
        got = join.edges(k).collect()
        near = {(e.seed_id, e.neighbor_id): e.score for e in got}
        assert len(near) == len(got) == len(want)
        # products that are rounded another way may swap neighbours of equal score
        assert all(abs(s - cosine[a, b]) <= 1.5e-6 for (a, b), s in near.items()) and len(set(near) ^ want) <= 0.002 * len(want)
        pairs, every = join.compared().first()
        if seeds is None:
            assert every == sum(int((identity == g).sum()) ** 2 for g in range(5)) + 1
        if threshold == 0.85 and block == 64:
            assert 0 < pairs < 0.3 * every
    assert similarity.Join(df.limit(0), 0.85).edges(3).count() == 0


def _shuffled(spark, run):
    """MB that the stages of run write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gate = spark.sparkContext._gateway
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (x for x in gate.jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())))}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = stages().keys()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(n for k, n in stages().items() if k not in before) / 1e6


def _unpruned(spark, path, n=5000, dim=64):
    """Vectors of two labels at random, which no pivot prunes, and the best ten neighbours of each by brute force."""
    import numpy as np

    r = np.random.RandomState(8)
    x, label = r.randn(n, dim).astype("float32"), r.randint(0, 2, n)
    x[: n // 20] = x[0]
    spark.createDataFrame([(k, v.tolist(), int(g)) for k, (v, g) in enumerate(zip(x, label))], "vec_id bigint, embedding array<float>, label int").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    cosine[label[:, None] != label[None, :]] = -2
    np.fill_diagonal(cosine, -2)

    def best(threshold):
        return {(a, int(b)): cosine[a, b] for a in range(n) for b in np.lexsort((np.arange(n), -cosine[a]))[:10] if cosine[a, b] >= threshold}

    return best


def _same(got, want):
    assert all(abs(got[k] - want[k]) <= 1.5e-6 for k in got.keys() & want.keys()) and len(got) == len(want) and len(got.keys() ^ want.keys()) <= 0.002 * len(want)


def test_seeds_go_to_tiles_not_to_cells(spark, tmp_path):
    from memlake.plans import registry

    best = _unpruned(spark, tmp_path)
    got, mb = _shuffled(spark, lambda: registry.QUERIES["knn_edges_strict"](spark, str(tmp_path)).collect())
    _same({(r.seed_id, r.neighbor_id): r.score for r in got}, best(0.5))
    assert mb < 12  # 5; with a copy of a seed for each cell that it may reach, 30


def test_pairs_of_several_parts(spark, tmp_path, monkeypatch):
    """Tiles of several parts in either identity, copies across them, and null vectors; pairs equal brute force."""
    from memlake.operators import similarity
    from memlake.plans import registry

    best = {}
    for (a, b), score in _unpruned(spark, tmp_path)(0.3).items():
        best[min(a, b), max(a, b)] = max(score, best.get((min(a, b), max(a, b)), -2))
    spark.createDataFrame([(90_000, None, 0), (90_001, [0.0] * 64, 1)], "vec_id bigint, embedding array<float>, label int").write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(similarity, "PART_BYTES", 512 * 900, raising=False)  # three parts of 2500 vectors
    got, mb = _shuffled(spark, lambda: registry.QUERIES["knn_pairs_dedup"](spark, str(tmp_path)).collect())
    _same({(r.a, r.b): r.score for r in got}, best)
    assert mb < 22  # 16; with a copy of a seed for each cell that it may reach, 32


def test_floats_travel_as_floats(spark, tmp_path, monkeypatch):
    """Vectors of floats go to their tiles in four bytes a number; doubles that no float holds stay as they are."""
    from pyspark.sql import functions

    from memlake.operators import similarity
    from memlake.plans import registry

    best = {}
    for (a, b), score in _unpruned(spark, tmp_path / "f")(0.3).items():
        best[min(a, b), max(a, b)] = max(score, best.get((min(a, b), max(a, b)), -2))
    large = functions.transform("embedding", lambda x: x.cast("double") * 1e60)
    spark.read.parquet(f"{tmp_path}/f/embeddings.parquet").withColumn("embedding", large).write.parquet(f"{tmp_path}/d/embeddings.parquet")
    monkeypatch.setattr(similarity, "PART_BYTES", 512 * 900)  # three parts of 2500 vectors
    for kind in "df":
        got, mb = _shuffled(spark, lambda: registry.QUERIES["knn_pairs_dedup"](spark, f"{tmp_path}/{kind}").collect())  # noqa: B023
        _same({(r.a, r.b): r.score for r in got}, best)
    assert mb < 13  # 9.6 for the floats; as unit vectors of doubles, 16.4


def test_null_identities_have_no_neighbours(spark, tmp_path):
    """As in the SQL, where a null label equals none; a table of null labels alone has no edges."""
    from memlake.plans import registry

    copies = [(k, [1.0, float(k % 2)], label) for k, label in enumerate((None, None, 0, 0, None, 1, 0))]
    schema = "vec_id bigint, embedding array<float>, label int"
    spark.createDataFrame(copies, schema).write.parquet(f"{tmp_path}/some/embeddings.parquet")
    spark.createDataFrame(copies[:2], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    got = {name: sorted(tuple(r) for r in registry.QUERIES[name](spark, f"{tmp_path}/some").collect()) for name in ("knn_edges", "knn_pairs_dedup")}
    near = {(2, 3): 0.707107, (2, 6): 1.0, (3, 6): 0.707107}
    assert got["knn_pairs_dedup"] == [(a, b, s) for (a, b), s in near.items()]
    assert got["knn_edges"] == sorted(e for (a, b), s in near.items() for e in ((a, b, s), (b, a, s)))
    assert registry.QUERIES["knn_edges"](spark, f"{tmp_path}/none").count() == 0


def test_pairs_equal_the_sql_on_odd_rows(spark, tmp_path, monkeypatch):
    """Repeated and null ids, null labels and vectors, copies, several parts: as DuckDB gives them."""
    import duckdb
    import numpy as np

    from memlake.operators import similarity
    from memlake.plans import registry

    r = np.random.RandomState(6)
    x = r.randn(40, 8)[r.randint(0, 40, 400)] + 0.3 * r.randn(400, 1) * r.randn(400, 8)
    x[:30] = x[0]
    rows = [(None if k % 50 == 7 else k - k % 40 // 39, None if k % 60 == 11 else v.tolist(), None if k % 9 == 4 else int(g)) for k, (v, g) in enumerate(zip(x.astype("float32"), r.randint(0, 3, 400)))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(similarity, "PART_BYTES", 64 * 50)  # parts of 50 vectors
    got = sorted(tuple(r) for r in registry.QUERIES["knn_pairs_dedup"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(db.sql(registry.ORACLES["knn_pairs_dedup"]).fetchall())
    assert got == want and len(got) > 1000


def test_a_dense_tile_takes_little_memory(spark, tmp_path, monkeypatch):
    """A tile of near copies, all of them neighbours, and one of exact copies: what its task holds at once, and its result."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from memlake.plans import registry

    r = np.random.RandomState(4)
    near = r.randn(64) + 0.3 * r.randn(1200, 64)
    x = np.concatenate([near, np.repeat(near[:1], 400, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = r.permutation(len(x))
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x[:50])], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = []
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: made.append(f) or spark.createDataFrame([], schema))
    registry.QUERIES["knn_edges"](spark, str(tmp_path))
    rows = {"id": pa.array(ids), "cell": pa.array(np.zeros(len(x), "int32")), "angle": pa.array(np.zeros(len(x))), "vec": pa.array([v.tobytes() for v in x], pa.binary())}
    tracemalloc.start()
    got = made[0](pa.table({f"s_{c}": v for c, v in rows.items()}), pa.table(rows)).to_pydict()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    cosine = np.round(np.stack([(x * v).sum(axis=1) for v in x]), 6)
    np.fill_diagonal(cosine, -2)
    want = {(int(ids[a]), int(ids[b])): cosine[a, b] for a in range(len(x)) for b in np.lexsort((ids, -cosine[a]))[:10]}
    best = {}
    for s, n, score in sorted(zip(*got.values()), key=lambda e: (e[0], -e[2], e[1])):
        best.setdefault(s, []).append((n, score))
    assert {(s, n): score for s, found in best.items() for n, score in found[:10]} == want
    assert peak < 200  # 22; with all products of a block at once, 1718


def test_greedy_chunks_equal_a_loop(spark):
    import random

    r = random.Random(2)
    rows = [(s, k // 2 if s == "b" else k, "x" * r.choice((0, 1, 5, 9, 10, 11, 40)) if k % 13 else None) for s, n in (("a", 400), ("b", 60), (None, 7), ("c", 1)) for k in range(n)]
    want = {}
    for source in ("a", None, "c"):  # of "b" the order of equal numbers is the hash's
        chunks, held = [], 0
        for _, _, t in (x for x in rows if x[0] == source):
            t = t or ""
            if chunks and held + len(t) <= 20:
                chunks[-1].append(t)
                held += len(t)
            else:
                chunks.append([t])
                held = len(t)
        want |= {(source, k): "\n---\n".join(c) for k, c in enumerate(chunks)}
    got = readers.pack_sources(spark.createDataFrame(rows, "source string, seq int, text string"), 20).collect()
    assert {(x.source, x.chunk): x.text for x in got if x.source != "b"} == want
    b = sorted((x.chunk, x.n_texts, x.text) for x in got if x.source == "b")
    assert [k for k, *_ in b] == list(range(len(b))) and sum(n for _, n, _ in b) == 60
    assert readers.pack_sources(spark.createDataFrame([], "source string, seq int, text string")).count() == 0


def test_running_sums_of_one_large_group(spark):
    from pyspark.sql import functions

    from memlake.operators.running import running

    rows = spark.range(5000).select(functions.lit("g").alias("g"), "id", (functions.col("id") % 7).alias("n"))
    got = running(rows, "g", ["id"], {"s": functions.col("n")}).orderBy("id").collect()
    total = 0
    for k, x in enumerate(got):
        total += k % 7
        assert (x.id, x.s) == (k, total)


def test_first_edges_of_many_chains(spark):
    """Two thousand chains of fifty, in which each edge waits for the one before, and one component beyond a chunk."""
    rows = [(c * 100 + k, c * 100 + k + 1, c * 100 + k, c * 100 + k + 1) if (c + k) % 3 else (c * 100 + k, c * 100 + k + 1, c * 100 + k + 1, c * 100 + k) for c in range(2000) for k in range(50)]
    df = spark.createDataFrame(rows, "a int, b int, winner_id int, loser_id int")
    assert {(r.a, r.b) for r in consolidate.first_edges(df).collect()} == in_order(rows)
    few = [r for r in rows if r[0] < 2000] + [(900_000 + k, 900_001 + k, 900_000 + k, 900_001 + k) for k in range(700)]
    assert {(r.a, r.b) for r in consolidate.first_edges(spark.createDataFrame(few, df.schema), chunk=100).collect()} == in_order(few)


def test_a_migration_that_is_stopped_goes_on(spark, tmp_path):
    from pyspark.sql import functions

    from memlake.operators import reindex

    kinds = "id string, payload string, profile string, text string"
    source = spark.createDataFrame([(str(k), f"p{k}", "new", f"t{k}") for k in range(60)], kinds)
    target = spark.createDataFrame([(str(k), f"p{k}" if k % 5 else "other", "new" if k % 3 else "old") for k in range(30)], "id string, payload string, profile string")
    batch = functions.col("id").cast("int") % 4
    make = lambda df: df.withColumn("vector", functions.array(functions.length("text").cast("double")))
    once = reindex.migrate(source, target, batch, f"file://{tmp_path}/once", make)
    want = sorted(map(repr, reindex.migrated(spark, f"file://{tmp_path}/once").collect()))
    assert len(want) == 30 + sum(k % 5 and not k % 3 for k in range(30)) > 0 and reindex.verified(source, target, once).first().complete
    for at in ((1, "write"), (1, "verify"), (2, "enter")):
        out, steps = f"file://{tmp_path}/{at[0]}{at[1]}", []

        def stop(k, step, at=at, steps=steps):
            steps.append((k, step))
            if (k, step) == at and steps.count(at) == 1:
                raise KeyboardInterrupt

        with pytest.raises(KeyboardInterrupt):
            reindex.migrate(source, target, batch, out, make, stop)
        assert {r.batch for r in reindex._ledger(spark, f"{out}/ledger").collect()} == set(range(at[0]))
        again = reindex.migrate(source, target, batch, out, make, stop)
        assert sorted(map(repr, again.collect())) == sorted(map(repr, once.collect())) and sorted(map(repr, reindex.migrated(spark, out).collect())) == want
        assert [k for k, step in steps if step == "write"] == [*range(at[0] + 1), *range(at[0], 4)]  # one batch is repeated
        # a changed record of one batch is written again, with its batch alone
        steps.clear()
        reindex.migrate(source.withColumn("text", functions.when(functions.col("id") == "57", "changed").otherwise(functions.col("text"))), target, batch, out, make, stop)
        assert {k for k, _ in steps} == {1}


def test_windows_of_time():
    from datetime import datetime, timedelta, timezone

    from memlake.operators.journal import parse_since

    now = datetime(2024, 3, 10, 12, tzinfo=timezone.utc)
    assert [parse_since(x, now) for x in ("12h", " 3D ", "2 w", None, "")] == [now - timedelta(hours=12), now - timedelta(days=3), now - timedelta(weeks=2), None, None]
    assert parse_since("2024-01-02T03:04:05Z", now) == parse_since("2024-01-02T03:04:05", now) == datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert parse_since("2024-01-02T03:04:05+02:00", now).utcoffset() == timedelta(hours=2)
    for wrong in ("soon", "3y", "-1d"):
        with pytest.raises(ValueError):
            parse_since(wrong, now)


def test_a_classifier_that_fails_gives_no_verdict(spark):
    from memlake.operators import records

    def classify(a, b):
        if a == "bad":
            raise RuntimeError("down")
        return "EQUIVALENT" if a == b else "DISTINCT"

    pairs = spark.createDataFrame([(1, "x", "x"), (2, "x", "y"), (3, "bad", "y")], "n int, text_a string, text_b string")
    assert {r.n: r.verdict for r in records.classified(pairs, classify).collect()} == {1: "EQUIVALENT", 2: "DISTINCT", 3: None}
    assert records.classified(pairs.limit(0), classify).count() == 0


def test_the_best_of_many_batches():
    import random

    import numpy as np
    import pyarrow as pa

    from memlake.operators import search

    r = random.Random(6)
    for greater in (True, False):
        best, rows = search.Best(3, 4, greater), []
        best.limit = 20
        for _ in range(30):
            n = r.randint(1, 8)
            ids, total = [r.randrange(50) for _ in range(n)], np.array([[r.choice((0.0, 1.0, 2.0, -np.inf)) for _ in range(4)] for _ in range(n)])
            rows += [(q, float(total[k, q]), ids[k]) for k in range(n) for q in range(4) if np.isfinite(total[k, q])]
            at, asked = search._top(total, 3, pa.array(ids), greater)
            assert max(np.bincount(asked, minlength=4)) <= 3
            best.add(asked, total[at, asked], {"id": pa.array(ids).take(pa.array(at))})
        got = [(b["query_id"][k].as_py(), b["id"][k].as_py()) for b in best.batches(pa.array(list("abcd")), ["query_id", "id"]) for k in range(b.num_rows)]
        want = [("abcd"[q], i) for q in range(4) for _, _, i in sorted((x for x in rows if x[0] == q), key=lambda x: (-x[1], -x[2] if greater else x[2]))[:3]]
        assert got == want
