"""Sources and dataset shapes over literal rows and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.plans.registry import query
from memlake.plans.views import literal_cte, table
from memlake.sources import readers as rd

_NOTES = [("/h/proj-0123abcd/a.md", "---\nname: ports\ndescription: the ports\ntype: decision\n---\nUse 6333.\n"), ("/h/plain/b.md", "No front matter here."), ("/h/x-12/c.md", "---\nname: n\n---\nbody\nmore")]


@query("markdown_notes", f"WITH {literal_cte('n', 'file, value', _NOTES)}, x AS (SELECT file, value, regexp_matches(value, '^---\\s*\\n') AS has, regexp_extract(value, '(?s)^---\\s*\\n(.*?)\\n---\\s*\\n?(.*)$', 1) AS head FROM n) SELECT file, nullif(trim(regexp_extract(head, '(?m)^name:\\s*(.*)$', 1)), '') AS name, nullif(trim(regexp_extract(head, '(?m)^description:\\s*(.*)$', 1)), '') AS description, CASE WHEN has THEN trim(regexp_extract(value, '(?s)^---\\s*\\n(.*?)\\n---\\s*\\n?(.*)$', 2)) ELSE value END AS body, regexp_replace(regexp_extract(file, '([^/]+)/[^/]*$', 1), '-[0-9a-fA-F]{{8,}}$', '') AS project FROM x")
def notes(spark, sf):
    return rd.parse_notes(spark.createDataFrame(_NOTES, "file string, value string")).select("file", "name", "description", "body", "project")


_QRELS = [("q1", "d1", "1"), ("q1", "d2", "0"), ("q2", "d3", "2.5"), ("q2", "d4", "x"), ("q3", "d5", "-1")]


@query("qrels_tsv", f"WITH {literal_cte('q', 'query_id, doc_id, grade', _QRELS)} SELECT query_id, doc_id, try_cast(grade AS DOUBLE) AS grade FROM q WHERE try_cast(grade AS DOUBLE) > 0")
def qrels(spark, sf):
    return rd.positive_qrels(spark.createDataFrame(_QRELS, "query_id string, doc_id string, grade string"))


_LINES = {
    "flat": [(1, '{"role":"user","content":" hi "}'), (2, '{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}'), (3, "not json"), (4, '{"role":"tool","content":"x"}')],
    "nested": [(1, '{"response_item":{"payload":{"role":"user","content":[{"type":"t","text":"n1"}]}}}'), (2, '{"payload":{"role":"assistant","content":"n2"}}')],
    "step": [(1, '{"type":"USER_INPUT","content":"do"}'), (2, '{"type":"PLANNER_RESPONSE","content":"<thought>x</thought>done"}'), (3, '{"type":"OTHER","content":"y"}')],
    "tree": [(1, '{"type":"message","id":"a","message":{"role":"user","content":"t1"}}'), (2, '{"type":"model_change","id":"b"}')],
}
_TURNS = [("flat", 1, "user", "hi"), ("flat", 2, "assistant", "a\nb"), ("nested", 1, "user", "n1"), ("nested", 2, "assistant", "n2"), ("step", 1, "user", "do"), ("step", 2, "assistant", "done"), ("tree", 1, "user", "t1")]


@query("transcript_turns", f"WITH {literal_cte('t', 'file, n, role, content', _TURNS)} SELECT * FROM t")
def transcripts(spark, sf):
    parts = [rd.parse_turns(spark.createDataFrame([(d, n, x) for n, x in rows], "file string, n int, line string"), d) for d, rows in _LINES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_ITEMS = [("q1", "type-a", "where?", "here", ["s1", "s2"], ["2024-01-01", "2024-01-02"], [[("user", "hi"), ("assistant", "yo")], [("user", "bye")]], ["s2"]), ("q2_abs", "type-b", "who?", "nobody", ["s3"], ["2024-02-01"], [[("user", "x")]], [])]
_ITEM = f"question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<{rd.TURN}>>, answer_session_ids array<string>"
_CORPUS = [("q1_s1", "Date: 2024-01-01\nUser: hi\nAssistant: yo"), ("q1_s2", "Date: 2024-01-02\nUser: bye"), ("q2_abs_s3", "Date: 2024-02-01\nUser: x")]


@query("dataset_corpus", f"WITH {literal_cte('c', 'id, text', _CORPUS)} SELECT * FROM c")
def corpus(spark, sf):
    return rd.long_memory(spark.createDataFrame(_ITEMS, _ITEM))[0].select("id", "text")


@query("dataset_queries", f"WITH {literal_cte('q', 'query_id, category, expected_empty, relevant', [('q1', 'type-a', False, 1), ('q2_abs', 'type-b', True, 0)])} SELECT query_id, category, expected_empty, CAST(relevant AS BIGINT) AS relevant FROM q")
def dataset_queries(spark, sf):
    _, queries, rels = rd.long_memory(spark.createDataFrame(_ITEMS, _ITEM))
    n = rels.groupBy("query_id").agg(F.count("*").alias("relevant"))
    return queries.join(n, "query_id", "left").select("query_id", "category", "expected_empty", F.coalesce("relevant", F.lit(0).cast("bigint")).alias("relevant"))


_DIALOGUE = [("s1", '{"session_2":[{"speaker":"B","dia_id":"D2:1","text":"later"}],"session_2_date_time":"Feb","session_10":[{"speaker":"A","dia_id":"D10:1","text":"last"}],"session_1":[{"speaker":"A","dia_id":"D1:1","text":"one"},{"speaker":"B","dia_id":"D1:2","text":"two"}],"session_1_date_time":"Jan","speaker_a":"A"}', [("q?", ["D1:2", "D9:9"])])]


@query("dialogue_corpus", f"WITH {literal_cte('c', 'id, session, text', [('s1:D1:1', 1, '[Jan] A: one'), ('s1:D1:2', 1, '[Jan] B: two'), ('s1:D2:1', 2, '[Feb] B: later'), ('s1:D10:1', 10, '[] A: last')])} SELECT id, session, text FROM c")
def dialogue(spark, sf):
    return rd.dialogue(spark.createDataFrame(_DIALOGUE, "sample_id string, conversation string, qa array<struct<question:string,evidence:array<string>>>"))[0].select("id", "session", "text")


@query("dialogue_evidence", f"WITH {literal_cte('c', 'query_id, doc_id', [('s1_q0', 's1:D1:2')])} SELECT query_id, doc_id FROM c")
def evidence(spark, sf):
    return rd.dialogue(spark.createDataFrame(_DIALOGUE, "sample_id string, conversation string, qa array<struct<question:string,evidence:array<string>>>"))[1].select("query_id", "doc_id")


@query("legacy_group", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'global' ELSE concat('proj', doc_id % 3) END AS project, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def legacy(spark, sf):
    folder = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("/home/x/proj"), F.col("doc_id") % 3, F.lit("/"))).otherwise(F.lit("/tmp/new-chat"))
    raw = table(spark, sf, "documents").select(F.concat(F.lit("cwd: "), folder, F.lit("\ndescription: d\n"), "text").alias("raw_memory"), F.length("text").alias("n"))
    parsed = rd.legacy_sections(raw.select("raw_memory")).select("project", F.length("raw_memory").alias("n"))
    extra = 16 + F.when(F.col("project") == "global", 5 + len("/tmp/new-chat")).otherwise(5 + len("/home/x/proj1/"))
    return parsed.select("project", (F.col("n") - extra).alias("n")).groupBy("project").agg(F.count("*").alias("n"), F.sum("n").cast("bigint").alias("chars"))


_LEGACY = "cwd: /h/alpha/\ndescription: fix it\n\nPreference signals:\n- short\n\nReusable knowledge:\n- port 1\n- port 2\n---\nrest"


@query("legacy_content", "SELECT 'alpha' AS project, concat('任务: fix it', chr(10), chr(10), '用户偏好:', chr(10), '- short', chr(10), chr(10), '项目核心经验:', chr(10), '- port 1', chr(10), '- port 2') AS content")
def legacy_content(spark, sf):
    return rd.legacy_sections(spark.createDataFrame([(_LEGACY,), (None,), ("cwd: /x\n",)], "raw_memory string")).select("project", "content")


_CALLS = [
    ("f", 1, '{"turnId":"t1","request":{"messages":[{"role":"system","content":"s"},{"role":"user","content":"ask 1"}]},"response":{"text":"draft"}}'), ("f", 2, '{"turnId":"t1","request":{"messages":[]},"response":{"text":"final 1"}}'),
    ("f", 3, '{"turnId":"t1","response":{"text":"  "}}'), ("f", 4, '{"turnId":"t2","request":{"messages":[{"role":"user","content":"ask 2"}]},"response":{"text":""}}'), ("f", 5, "broken"),
]


@query("model_io_turns", f"WITH {literal_cte('t', 'first_n, role, content', [(1, 'user', 'ask 1'), (1, 'assistant', 'final 1'), (4, 'user', 'ask 2')])} SELECT * FROM t")
def model_io(spark, sf):
    return rd.model_io_turns(spark.createDataFrame(_CALLS, "file string, n int, line string")).select("first_n", "role", "content")


_TYPES = [("a", "single-session-user"), ("b_abs", "multi-session"), ("c", "temporal-reasoning"), ("d", "knowledge update")]


@query("category_mapping", f"WITH {literal_cte('c', 'id, category', [('a', 'information_extraction'), ('b_abs', 'abstention'), ('c', 'temporal_reasoning'), ('d', 'knowledge_update')])} SELECT * FROM c")
def categories(spark, sf):
    rows = spark.createDataFrame(_TYPES, "id string, kind string")
    return rows.select("id", rd.question_category(F.col("id"), F.col("kind")).alias("category"))


_EVIDENCE = [("q1", ["s2"], [("s1", [("no", True)]), ("s2", [(" yes ", True), ("skip", None), ("more", True)])]), ("q2", [], [("s3", [("x", True)]), ("s4", [("y", False)])])]


@query("evidence_by_session", f"WITH {literal_cte('e', 'question_id, session_id, evidence', [('q1', 's2', 'yes' + chr(10) + 'more'), ('q2', 's3', 'x')])} SELECT * FROM e")
def session_evidence(spark, sf):
    return rd.evidence_by_session(spark.createDataFrame(_EVIDENCE, "question_id string, answer_session_ids array<string>, sessions array<struct<id:string,turns:array<struct<content:string,has_answer:boolean>>>>"))


_NESTED = [("a", '[{"turns":[{"role":"user","content":"x"},[{"id":1,"content":"y"}]]},{"other":{"deep":[{"index":0,"content":"z"}]}}]'), ("b", "bad")]


@query("nested_turns", f"WITH {literal_cte('t', 'id, pos, content', [('a', 0, 'x'), ('a', 1, 'y'), ('a', 2, 'z')])} SELECT * FROM t")
def nested(spark, sf):
    return rd.nested_turns(spark.createDataFrame(_NESTED, "id string, json string")).select("id", "pos", "content")


_LITERALS = [("a", "{'k': [1, None]}"), ("b", '{"k": null}'), ("c", "[1]"), ("d", "oops("), ("e", None)]


@query("literal_questions", f"WITH {literal_cte('t', 'id, json', [('a', '{' + chr(34) + 'k' + chr(34) + ': [1, null]}'), ('b', '{' + chr(34) + 'k' + chr(34) + ': null}'), ('c', '{}'), ('d', '{}'), ('e', '{}')])} SELECT * FROM t")
def literals(spark, sf):
    return rd.literal_maps(spark.createDataFrame(_LITERALS, "id string, raw string"))


@query("first_non_empty", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'c' WHEN doc_id % 3 = 1 THEN 'b' ELSE 'a' END AS value FROM documents")
def first_field(spark, sf):
    k = F.col("doc_id") % 3
    return table(spark, sf, "documents").select("doc_id", rd.first_non_empty(F.when(k == 2, "a").otherwise(""), F.when(k == 1, "b"), F.lit("c")).alias("value"))


@query("chunk_pack", """WITH RECURSIVE d AS (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
w AS (SELECT source, k, 0 AS chunk, n AS held FROM d WHERE k = 1 UNION ALL SELECT d.source, d.k, CASE WHEN held + n > 3500 THEN chunk + 1 ELSE chunk END, CASE WHEN held + n > 3500 THEN n ELSE held + n END FROM w JOIN d ON d.source = w.source AND d.k = w.k + 1)
SELECT source, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_texts, CAST(max(held) + 5 * (count(*) - 1) AS BIGINT) AS n_chars FROM w GROUP BY source, chunk""")
def chunks(spark, sf):
    """All texts of each source, in order of their numbers, packed greedily."""
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").alias("seq"), "text")
    return rd.pack_sources(docs).select("source", "chunk", F.col("n_texts").cast("bigint").alias("n_texts"), F.length("text").cast("bigint").alias("n_chars"))
