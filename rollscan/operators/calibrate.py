"""Thresholds from a false-alarm budget, and what they promise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscan.functions import grading
from rollscan.operators.ranks import at_ranks, interpolated, sketched
from rollscan.staging import sized, stage


def _supported(groups: DataFrame, budget: Column, metres_per_tile: Column, margin: int) -> DataFrame:
    """A4's ranks from n: alpha, k, k_low, status."""
    n, alpha = F.col("n"), F.col("alpha")
    groups = groups.withColumn("_budget", grading.refuse(budget <= 0, "the budget is not positive", budget))
    groups = groups.withColumn("_metres", grading.refuse(metres_per_tile <= 0, "metres per tile are not positive", metres_per_tile))
    groups = groups.withColumn("alpha", F.col("_budget") * F.col("_metres") / F.lit(100.0)).withColumn("k", F.ceil((n + 1) * (1 - alpha)).cast("long"))
    low = F.ceil((n + 1) * (1 - F.least(F.lit(1.0), 5 * alpha))).cast("long")
    status = F.when(F.col("k") > n, "sample_too_small").when((F.lit(margin) > 0) & (F.col("k") > n - margin), "unstable_tail").otherwise("ok")
    return groups.withColumns({"k_low": F.greatest(F.lit(1), F.least(n, low)), "status": status}).drop("_budget", "_metres")


def conformal_threshold(scores: DataFrame, keys: list[str], budget: float | str, metres_per_tile: float | str, margin: int = 10, strict: bool = False) -> DataFrame:
    """A4: for each group the k-th smallest clean score, k = ceil((n + 1)(1 - alpha)), alpha = budget * metres_per_tile / 100.

    scores: keys, score. budget and metres_per_tile are numbers or columns that are constant in a group. status is ok,
    sample_too_small (k > n) or unstable_tail (k within `margin` of n; margin 0 waives it); refused groups have no
    threshold, or raise in strict mode. abstain_low is the order statistic at five times alpha. Two scans of scores: one for
    a sketch of each group, one that is exact in the bands it leaves.
    """
    number = lambda v: F.lit(float(v)) if not isinstance(v, str) else F.col(v)
    named = [c for c in (budget, metres_per_tile) if isinstance(c, str) and c not in keys]
    groups = _supported(sketched(scores, keys, "score", *[F.first(c).alias(c) for c in named]), number(budget), number(metres_per_tile), margin)
    if strict:
        groups = groups.withColumn("status", grading.refuse(F.col("status") != "ok", "the sample does not support the budget", F.col("status")))
    k = F.greatest(F.lit(1), F.col("k")) if margin == 0 else F.col("k")
    out = at_ranks(scores, keys, "score", groups, F.array(k, F.col("k_low")))
    ok = F.col("status") == "ok"
    return out.select(*keys, F.col("n").alias("n_clean_tiles"), "alpha", "k", F.when(ok, F.col("found")[0]).alias("threshold"), F.when(ok, F.col("found")[1]).alias("abstain_low"), "status")


def hand_set(keys: DataFrame, threshold: float) -> DataFrame:
    """A threshold by hand, labelled as uncalibrated."""
    return keys.select("*", F.lit(threshold).alias("threshold"), F.lit(0.8 * threshold).alias("abstain_low"), F.lit(float("nan")).alias("budget_fa"), F.lit(0).alias("n_clean_tiles"), F.lit("hand_set").alias("status"))


def self_thresholds(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Interpolated 99.5th and 98.5th percentiles of the scores themselves; they carry no guarantee."""
    p = interpolated(scores, keys, "score", [0.995, 0.985])
    return p.select(*keys, F.col("at")[0].alias("threshold"), F.col("at")[1].alias("abstain_low"), F.lit("self_thresholded").alias("status"))


def thresholds_or_fallback(calibrated: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """A4, and A33 where it refuses."""
    own = self_thresholds(scores, keys).withColumnsRenamed({"threshold": "own_threshold", "abstain_low": "own_low", "status": "own_status"})
    ok = F.col("status") == "ok"
    pick = lambda a, b: F.when(ok, F.col(a)).otherwise(F.col(b))
    return calibrated.join(own, keys).select(*keys, pick("threshold", "own_threshold").alias("threshold"), pick("abstain_low", "own_low").alias("abstain_low"), pick("status", "own_status").alias("status"))


def classified(scores: DataFrame, calibrations: DataFrame, keys: list[str]) -> DataFrame:
    """Scores with assertion and confidence; a group without an accepted calibration is refused."""
    c = stage(calibrations.filter("status IN ('ok', 'hand_set', 'self_thresholded')").select(*keys, "threshold", "abstain_low"), "calibrations")
    joined = scores.join(sized(c), keys, "left")
    score = grading.refuse(F.col("threshold").isNull(), "a group has no calibration", F.col("score"))
    return joined.select(*scores.columns, grading.classify(score, F.col("threshold"), F.col("abstain_low")).alias("assertion"), grading.confidence(F.col("score"), F.col("threshold"), F.col("abstain_low")).alias("confidence"))


def calibration_curve(fit: DataFrame, validation: DataFrame, keys: list[str], fractions: list[float], margin: int = 10) -> DataFrame:
    """For each group and requested exceedance the threshold or refusal, and the realised exceedance on scores that are not
    in fit. All fractions of a group come from the same two scans of fit and one of validation."""
    groups = sketched(fit, keys, "score")
    k = F.array(*[F.ceil((F.col("n") + 1) * (1 - 100.0 * F.lit(f) / 100.0)).cast("long") for f in fractions])
    n = F.col("n")
    status = lambda k: F.when(k > n, "sample_too_small").when((F.lit(margin) > 0) & (k > n - margin), "unstable_tail").otherwise("ok")
    found = at_ranks(fit, keys, "score", groups, k).withColumn("k", k)
    asked = F.array(*[F.struct(F.lit(f).alias("requested"), status(F.col("k")[i]).alias("status"), F.col("found")[i].alias("threshold")) for i, f in enumerate(fractions)])
    asked = F.transform(asked, lambda a: F.struct(a.requested, a.status, F.when(a.status == "ok", a.threshold).alias("threshold")))
    cals = stage(found.select(*keys, asked.alias("_asked")), "calibrations")
    # a validation row counts for all fractions at once
    over = [F.count_if(F.col("score") > F.col("_asked")[i]["threshold"]).alias(f"_o{i}") for i in range(len(fractions))]
    counted = validation.join(sized(cals), keys).groupBy(*keys, "_asked").agg(F.count("*").alias("n_validation"), *over)
    each = F.explode(F.arrays_zip("_asked", F.array(*[f"_o{i}" for i in range(len(fractions))]).alias("over")))
    out = counted.select(*keys, "n_validation", each.alias("_e")).select(*keys, F.col("_e._asked.*"), "n_validation", F.col("_e.over").alias("n_over"))
    realised = F.when(F.col("status") == "ok", F.col("n_over") / F.col("n_validation"))
    return out.select(*keys, "requested", "status", "threshold", "n_validation", realised.alias("realised"), (realised / F.col("requested")).alias("ratio"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """Over all groups and fractions: resolved, refusals by kind, hot ones (ratio above 1), median ratio."""
    curve = stage(curve, "curve")
    refused = [F.count_if(F.col("status") == s).alias(s) for s in ("unstable_tail", "sample_too_small")]
    out = interpolated(curve, [], "ratio", [0.5], F.count("*").alias("rows"), *refused, F.count_if(F.col("ratio") > 1).alias("hot"))
    return out.select(F.col("rows").alias("n"), F.col("n").alias("resolved"), "unstable_tail", "sample_too_small", "hot", F.col("at")[0].alias("median_ratio"))
