"""Model output, read strictly: verdicts, extractions, choices with probabilities; thresholds and shadow records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators.calibration import FLOORS
from memlake.operators.filters import active

RELATIONS = ("EQUIVALENT", "CONFLICT", "DISTINCT")
MIN_CONFIDENCE = 0.6


def parse_verdict(c: Column) -> Column:
    """A struct (relation, confidence) of text that is one JSON object with a known relation and a finite confidence in [0, 1]; else null."""
    body = tx.strip(c)
    one_object = body.rlike(r"(?s)^\{.*\}$")
    relation = F.get_json_object(body, "$.relation")
    confidence = F.get_json_object(body, "$.confidence")
    number = F.when(confidence.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), confidence.cast("double"))
    ok = one_object & relation.isin(*RELATIONS) & (number >= 0) & (number <= 1)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(relation.alias("relation"), number.alias("confidence")))


def decide(pairs: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Pairs (id, text, user_id, agent_id, status with suffixes _a, _b; verdict) with relation and reason; DISTINCT wherever a check fails."""
    c = F.col
    v = parse_verdict(c("verdict"))
    same_text = tx.normalised(c("text_a")) == tx.normalised(c("text_b"))
    reason = (
        F.when((F.coalesce(c("id_a"), F.lit("")) == "") | (F.coalesce(c("id_b"), F.lit("")) == ""), "missing_memory_id")
        .when(c("user_id_a").isNull() | c("user_id_b").isNull() | c("agent_id_a").isNull() | c("agent_id_b").isNull(), "missing_identity_boundary")
        .when((c("user_id_a") != c("user_id_b")) | (c("agent_id_a") != c("agent_id_b")), "identity_boundary_mismatch")
        .when(~active("status_a") | ~active("status_b"), "inactive_memory").when(c("id_a") == c("id_b"), "same_memory").when(same_text, "normalized_equal")
        .when(c("verdict").isNull(), "classifier_exception").when(v.isNull(), "malformed_classifier_output").when(v["confidence"] < min_confidence, "low_confidence").otherwise("classified")
    )
    relation = F.when(reason == "normalized_equal", "EQUIVALENT").when(reason == "classified", v["relation"]).otherwise("DISTINCT")
    confidence = F.when(reason == "normalized_equal", 1.0).when(reason == "classified", v["confidence"]).otherwise(0.0)
    return pairs.select("*", relation.alias("relation"), confidence.alias("confidence"), reason.alias("reason"))


def extraction_error(c: Column) -> Column:
    """Why an extraction response can't be used: empty_response, invalid_json, invalid_schema; null: it can."""
    body = tx.strip(F.coalesce(c, F.lit("")))
    items = F.from_json(body, "memory array<struct<text:string>>")["memory"]
    blank = F.exists(items, lambda m: F.coalesce(m["text"], F.lit("")) == "")
    return F.when(body == "", "empty_response").when(F.get_json_object(body, "$").isNull(), "invalid_json").when(items.isNull() | blank, "invalid_schema")


def choice(probabilities: Column) -> Column:
    """Of a probability map: the best key, the margin to the next (6 places) and whether it is valid: the three relations, each in [0, 1], summing to 1."""
    values = F.map_values(probabilities)
    keys_ok = (F.size(probabilities) == len(RELATIONS)) & F.forall(F.map_keys(probabilities), lambda k: k.isin(*RELATIONS))
    sane = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    ranked = F.sort_array(values, asc=False)
    margin = F.round(ranked[0] - ranked[1], 6)
    entries = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key"))))
    valid = F.coalesce(keys_ok & sane & (F.abs(total - 1) <= 1e-3), F.lit(False))
    return F.struct(valid.alias("valid"), F.when(valid, entries[0]["key"]).alias("best"), F.when(valid, ranked[0]).alias("p"), F.when(valid, margin).alias("margin"))


def takeover(probabilities: Column, floors: dict[str, tuple[float, float]] | None = None) -> Column:
    """Whether a calibrated choice may act: (relation, reason). Ties abstain, then probability, then margin; DISTINCT needs no floor."""
    floors = floors or FLOORS
    x = choice(probabilities)
    p_floor, m_floor = F.lit(0.0), F.lit(0.0)
    for relation, (p, m) in floors.items():
        p_floor, m_floor = F.when(x["best"] == relation, p).otherwise(p_floor), F.when(x["best"] == relation, m).otherwise(m_floor)
    reason = F.when(~x["valid"], "invalid_probabilities").when(x["margin"] <= 1e-5, "tie").when(x["p"] < p_floor, "probability_below_floor").when(x["margin"] < m_floor, "margin_below_floor").otherwise("accepted")
    return F.struct(F.when(reason == "accepted", x["best"]).alias("relation"), reason.alias("reason"))


def observations(decided: DataFrame, salt: str) -> DataFrame:
    """Observations of a second opinion (relation, shadow_relation, pair ids), all of them: salted fingerprints instead of ids; the primary stays as it is."""
    mark = F.sha2(F.concat_ws("|", F.lit(salt), F.least("id_a", "id_b"), F.greatest("id_a", "id_b")), 256)
    return decided.select(F.substring(mark, 1, 16).alias("fingerprint"), "relation", "shadow_relation", (F.col("relation") == F.col("shadow_relation")).alias("agrees"))


def shadow_run(pairs: DataFrame, user: str, project: str, scope: str, allowed_projects: Sequence[str], salt: str, max_calls: int) -> DataFrame:
    """Each decided pair as one run of a second opinion sees it: (fingerprint, relation, shadow_relation, status).

    pairs: relation, shadow_relation (null: the call failed) and id, text, user_id,
    agent_id, status suffixed _a, _b. Status: not_allowed where the run's project or
    scope has no leave, skipped_guard for records of another identity, that are
    superseded or lack id or text, skipped_budget beyond max_calls of the run, by
    fingerprint, else degraded or observed. What is skipped shows no second opinion;
    the primary relation is never changed.
    """
    whole = F.lit(True)
    for s in "ab":
        whole = whole & (F.col(f"user_id_{s}") == user) & (F.col(f"agent_id_{s}") == project) & active(f"status_{s}") & (F.coalesce(f"id_{s}", F.lit("")) != "") & (F.coalesce(f"text_{s}", F.lit("")) != "")
    sides = [F.concat_ws("\x1f", f"id_{s}", f"text_{s}") for s in "ab"]
    mark = F.substring(F.sha2(F.concat_ws("\x1e", F.lit(salt), F.least(*sides), F.greatest(*sides)), 256), 1, 24)
    allowed = F.lit(scope == "project" and project in allowed_projects)
    rows = pairs.select(mark.alias("fingerprint"), "relation", "shadow_relation", F.when(~allowed, "not_allowed").when(~F.coalesce(whole, F.lit(False)), "skipped_guard").alias("_why"))
    # the last fingerprint within the budget, by a bounded sort
    last = rows.where("_why is null").select("fingerprint").orderBy("fingerprint").limit(max(max_calls, 0)).agg(F.max("fingerprint").alias("_last"))
    status = F.coalesce("_why", F.when(F.col("_last").isNull() | (F.col("fingerprint") > F.col("_last")), "skipped_budget").when(F.col("shadow_relation").isNull(), "degraded").otherwise("observed"))
    out = rows.join(F.broadcast(last)).withColumn("status", status)  # one row
    return out.select("fingerprint", "relation", F.when(status == "observed", F.col("shadow_relation")).alias("shadow_relation"), "status")


def shadow_report(run: DataFrame) -> DataFrame:
    """One row: attempted, observed, failed, skipped_guard, skipped_budget, disagreements, status (not_allowed, degraded or ok)."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = run.agg((n("observed") + n("degraded")).alias("attempted"), n("observed").alias("observed"), n("degraded").alias("failed"), n("skipped_guard").alias("skipped_guard"), n("skipped_budget").alias("skipped_budget"), F.count_if(F.col("shadow_relation") != F.col("relation")).alias("disagreements"), n("not_allowed").alias("_barred"))
    return out.withColumn("status", F.when(F.col("_barred") > 0, "not_allowed").when((F.col("failed") > 0) | (F.col("skipped_budget") > 0), "degraded").otherwise("ok")).drop("_barred")


def shadow(decided: DataFrame, salt: str, budget: int) -> DataFrame:
    """The observations to store: at most budget rows by fingerprint. Counts are taken over observations()."""
    return observations(decided, salt).orderBy("fingerprint").limit(budget)


def transient_error(message: Column) -> Column:
    """Whether an error is worth another try."""
    return F.lower(message).rlike("|".join(tx.TRANSIENT_ERRORS))


def rule_judge(gold: Column, answer: Column, abstain: Column, least: float = 0.5) -> Column:
    """Whether an answer holds the gold text or half of its longer words as substrings; where it should abstain, whether it does."""
    g, a = F.lower(tx.strip(gold)), F.lower(tx.strip(answer))
    words = F.array_distinct(F.filter(tx.all_matches(g, r"(?U)\b[a-zA-Z0-9_\x{4e00}-\x{9fa5}]+\b"), lambda w: (F.length(w) > 2) & ~w.isin("the", "and", "for", "with")))
    found = F.size(F.filter(words, lambda w: F.contains(a, w)))
    return F.when(abstain, tx.holds_any(answer, tx.ABSTENTIONS)).otherwise(F.contains(a, g) | ((F.size(words) > 0) & (found >= F.size(words) * least)))


def adversarial(answer: Column, trap: Column, strict: bool = False) -> Column:
    """Whether an answer refuses a false premise; one that repeats the trap doesn't. strict: the two official phrases alone."""
    if strict:
        return tx.holds_any(answer, tx.STRICT_ABSTENTIONS)
    words = lambda c: F.array_join(tx.answer_words(c), " ")
    trapped = F.coalesce((words(trap) != "") & F.contains(words(F.lower(answer)), words(trap)), F.lit(False))
    return ~trapped & tx.holds_any(answer, tx.PREMISE_ABSTENTIONS)
