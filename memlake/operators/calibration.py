"""Classifier evaluation: confusion, probability buckets, Brier score, zero-error thresholds, Go/No-Go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("EQUIVALENT", "CONFLICT", "DISTINCT")


def confusion(rows: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """(relation, tp, fp, fn, support, precision, recall) of (gold, predicted); a ratio without denominator is null."""
    each = rows.select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("relation"), "gold", "predicted")
    g, p = F.col("gold") == F.col("relation"), F.coalesce(F.col("predicted") == F.col("relation"), F.lit(False))
    by = each.groupBy("relation").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(g).alias("support"))
    return by.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4).alias("precision"), F.round(F.try_divide("tp", F.col("support")), 4).alias("recall"))


def bucket(p: Column) -> Column:
    return F.when(p <= 0.5, "[0,0.5]").when(p <= 0.7, "(0.5,0.7]").when(p <= 0.9, "(0.7,0.9]").otherwise("(0.9,1]")


def brier(probabilities: Column, gold: Column, classes: Sequence[str] = CLASSES) -> Column:
    """Sum of squared distances from the true class, averaged by the caller."""
    out = F.lit(0.0)
    for c in classes:
        out = out + F.pow(F.coalesce(F.element_at(probabilities, c), F.lit(0.0)) - (gold == c).cast("double"), F.lit(2.0))
    return out


def error_bound(n: Column, confidence: float = 0.95) -> Column:
    """The error rate that n faultless cases exclude with this confidence."""
    return F.round(F.least(F.lit(1.0), -F.log(F.lit(1 - confidence)) / n), 4)


def threshold_grid(rows: DataFrame, probabilities: Sequence[float], margins: Sequence[float]) -> DataFrame:
    """The (probability, margin) that accepts most without an unsafe case; ties: the lower probability, then margin.

    rows: p, margin, unsafe. The grid is bounded by the two lists, so its product with the rows is one explode.
    """
    grid = F.array(*[F.struct(F.lit(float(p)).alias("min_p"), F.lit(float(m)).alias("min_margin")) for p in probabilities for m in margins])
    cells = rows.select("p", "margin", "unsafe", F.explode(grid).alias("g"))
    inside = (F.col("p") >= F.col("g.min_p")) & (F.col("margin") >= F.col("g.min_margin"))
    by = cells.groupBy("g.min_p", "g.min_margin").agg(F.count_if(inside).alias("accepted"), F.count_if(inside & F.col("unsafe")).alias("unsafe"))
    return by.where("unsafe = 0").orderBy(F.desc("accepted"), "min_p", "min_margin").limit(1)


#: Least probability and margin by which a relation that changes a record is accepted.
FLOORS = {"EQUIVALENT": (0.80, 0.25), "CONFLICT": (0.75, 0.20)}


def accepted(thresholds: dict[str, tuple[float, float]] | None = None) -> Column:
    """The prediction where it may be acted on, else null: by its relation's thresholds, or DISTINCT; never at a tie.

    Columns: prediction, probability, margin.
    """
    out = F.when(F.coalesce(F.col("margin") <= 0, F.lit(True)), F.lit(None).cast("string"))
    for relation, (least_p, least_margin) in (FLOORS | (thresholds or {})).items():
        out = out.when(F.col("prediction") == relation, F.when((F.col("probability") >= least_p) & (F.col("margin") >= least_margin), relation))
    return out.when(F.col("prediction") == "DISTINCT", "DISTINCT")


def thresholded(rows: DataFrame, by: Sequence[str] = (), thresholds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Figures of a classifier behind thresholds, for each group of ``by``.

    rows: gold, must_abstain, prediction, probability, margin, probabilities (a map),
    latency_ms, input_tokens, output_tokens, cost_usd. A ratio without denominator is
    0 for the coverages and null for the recalls; the error bound holds where no error
    was made. One pass of partial aggregates, but for the two exact percentiles.
    """
    must = F.coalesce("must_abstain", F.lit(False))
    x = rows.withColumn("_said", accepted(thresholds)).withColumn("_must", must)
    free, said, gold = ~F.col("_must"), F.col("_said"), F.col("gold")
    acts = said.isin(*FLOORS)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    at = lambda p: F.percentile_disc(p).within_group(F.col("latency_ms")) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)")
    support = {r: F.count_if(free & (gold == r)) for r in FLOORS}
    known = free & F.col("probabilities").isNotNull() & gold.isin(*CLASSES)
    out = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(free).alias("eligible"), F.count_if(free & said.isNotNull()).alias("accepted"), F.count_if(free & acts).alias("destructive"),
        F.count_if(~free | said.isNull()).alias("abstentions"), F.count_if(free & (said == "EQUIVALENT") & ~gold.eqNullSafe(said)).alias("false_merge"),
        F.count_if(free & (said == "CONFLICT") & ~gold.eqNullSafe(said)).alias("false_supersede"), F.count_if(~free & said.isNotNull()).alias("must_abstain_violations"),
        ratio(F.count_if(free & acts), sum(support.values(), F.lit(0))).alias("destructive_coverage"),
        *[F.round(F.try_divide(F.count_if(free & (said == r) & (gold == r)), n), 4).alias(f"recall_{r.lower()}") for r, n in support.items()],
        F.round(F.avg(F.when(known, brier(F.col("probabilities"), gold))), 6).alias("brier"), at(0.5).alias("latency_p50"), at(0.95).alias("latency_p95"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )
    clean = (F.col("false_merge") + F.col("false_supersede") == 0) & (F.col("destructive") > 0)
    return out.withColumn("coverage", ratio(F.col("accepted"), F.col("eligible"))).withColumn("abstention_rate", ratio(F.col("abstentions"), F.col("n"))).withColumn("error_bound", F.when(clean, error_bound(F.col("destructive"))))


POLICY = {
    "min_accepts": 1, "min_samples": 30, "max_false_merges": 0, "max_false_supersedes": 0, "max_violations": 0, "min_coverage": 0.5, "max_recall_drop": 0.02, "max_cost_ratio": 0.5,
    "slices": ("zh", "mixed"), "evidence": True,
}
#: Words in the name of measurements that decide nothing.
NO_EVIDENCE = ("synthetic", "fixture", "not_measured", "gold_as_baseline")


def disqualified(accepts: dict[str, int], test: dict[str, dict], baseline: dict[str, dict], origins: Sequence[str], policy: dict | None = None) -> list[str]:
    """Every reason against a takeover, in order; none: it may go.

    accepts: safe accepted calibration samples by relation. test, baseline: figures of
    thresholded() and of the way it is done today, by slice ("overall", languages).
    """
    p, out, of = POLICY | (policy or {}), [], test["overall"]
    out += [f"calibration_evidence_insufficient:{r}" for r in FLOORS if accepts.get(r, 0) < p["min_accepts"]]
    limits = (("sample_size_insufficient", of["n"] < p["min_samples"]), ("false_merges_exceeded", of["false_merge"] > p["max_false_merges"]), ("false_supersedes_exceeded", of["false_supersede"] > p["max_false_supersedes"]), ("must_abstain_violated", of["must_abstain_violations"] > p["max_violations"]), ("coverage_below_minimum", of["coverage"] < p["min_coverage"]))
    out += [name for name, bad in limits if bad]
    for name in p["slices"]:
        out += [f"language_slice_safety_failure:{name}:{kind}" for kind in ("false_merge", "false_supersede") if test.get(name, {}).get(kind, 0) > 0]
    if not p["evidence"]:
        return out
    if any(word in origin.lower() for origin in origins for word in NO_EVIDENCE):
        out.append("non_decision_grade_measurements")
    for name in ("overall", *p["slices"]):
        for r in FLOORS:
            was, now = (figures.get(name, {}).get(f"recall_{r.lower()}") for figures in (baseline, test))
            if was is not None and now is None:
                out.append(f"recall_evidence_missing:{name}:{r}")
            elif was is not None and now + p["max_recall_drop"] < was:
                out.append(f"recall_drop_exceeded:{name}:{r}")
    old = baseline["overall"]
    if not old.get("cost_usd") or old["cost_usd"] <= 0:
        out.append("baseline_cost_missing")
    elif of["cost_usd"] > old["cost_usd"] * p["max_cost_ratio"]:
        out.append("cost_gate_failed")
    if not old.get("latency_p95") or not of.get("latency_p95"):
        out.append("latency_evidence_missing")
    elif of["latency_p95"] > old["latency_p95"]:
        out.append("latency_gate_failed")
    return out


def with_defaults(samples: DataFrame, observations: DataFrame, defaults: dict) -> DataFrame:
    """samples (id, ...) with their observations (id, ...), a missing field taken from the defaults; ids must cover each other exactly.

    Where ids don't, a sample without an observation, one without a sample or one that
    is there twice, it is an error.
    """
    keys = samples.select("id").withColumn("s", F.lit(1)).withColumn("o", F.lit(0)).unionByName(observations.select("id").withColumn("s", F.lit(0)).withColumn("o", F.lit(1)))
    off = keys.groupBy("id").agg(F.sum("s").alias("s"), F.sum("o").alias("o")).where("s <> 1 or o <> 1")
    if not off.isEmpty():
        raise ValueError("samples and observations must cover each other exactly")
    filled = [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in observations.columns]
    more = [F.lit(v).alias(c) for c, v in defaults.items() if c not in observations.columns]
    return samples.join(observations.select(*filled, *more), "id")
