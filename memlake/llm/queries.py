"""Registered queries op1 to op13, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import ann, chat, contamination, extraction, fingerprints, language, neardup, packing, periodic, pii, quality, resampling, tokenfile
from memlake.llm.common import held_out, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    score = F.col("score")
    return quality.score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (score >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(packing.packed(table(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict_language(docs, language.train_language(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(contamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, threshold=0.85)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recover_roles(table(spark, sf_dir, "conversations"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_text(table(spark, sf_dir, "pages"))


def op9_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.digest(resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.planted(table(spark, sf_dir, "documents"))))


def op13_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.edits(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_packing, op3_pii, op4_language_id, op5_decontamination, op6_minhash_neardup, op7_chat_format, op8_html_extraction, op9_ivfpq_search, op10_orc_tokens, op11_importance_resampling, op12_periodic_runs, op13_merkle_fingerprints)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: s and c, the CRC-32 of its bytes, for the texts s of "named".
_CRC = """crc_table AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
crc AS (SELECT s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(s), 2), lambda i: CAST('0x' || substr(hex(s), i, 2) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) AS c FROM named, crc_table)"""

ORACLES: dict[str, str] = {
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bl AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT d.*, ls.l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (s, l)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op6_minhash_neardup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
r(doc_id, c) AS (SELECT a, a FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op11_importance_resampling": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
ds AS (SELECT doc_id, unnest(w) AS s FROM d),
bs AS (SELECT unnest({_ITEM_WORDS}) AS s FROM benchmark),
named AS (SELECT s FROM ds UNION SELECT s FROM bs), {_CRC},
bucket AS (SELECT s, c % 10000 AS b FROM crc),
source AS (SELECT b, count(*) AS n FROM ds JOIN bucket USING (s) GROUP BY b),
target AS (SELECT b, count(*) AS n FROM bs JOIN bucket USING (s) GROUP BY b),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM source) + 10000.0 AS s, (SELECT coalesce(sum(n), 0) FROM target) + 10000.0 AS t),
gain AS (SELECT source.b, CAST(floor(1000 * ln((coalesce(target.n, 0) + 1.0)::DOUBLE * total.s / ((source.n + 1.0)::DOUBLE * total.t))) AS BIGINT) AS g FROM total, source LEFT JOIN target USING (b)),
mean AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM ds JOIN bucket USING (s) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[:8] AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN mean USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN r USING (doc_id)""",
    "op12_periodic_runs": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
named AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM d), {_CRC},
h AS (SELECT doc_id, w, len(w) AS n, c AS h, c // 10 AS g FROM d JOIN crc ON s = CAST(doc_id AS VARCHAR)),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN a < n THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
x AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS s FROM t),
eq AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i),
island AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq) GROUP BY doc_id, q, k HAVING count(*) >= q AND count(*) + q >= 12),
run AS (SELECT doc_id, start, length, min(q) AS period FROM island GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS k FROM run),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS r FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS c FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM t LEFT JOIN best ON best.doc_id = t.doc_id AND k = 1 LEFT JOIN lines ON lines.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id""",
}
