"""Four-point grading of rolls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.functions import grading


def roll_lengths(events: DataFrame, keys: list[str]) -> DataFrame:
    """The furthest position of a roll in metres (1e-6 at least)."""
    return events.groupBy(*keys).agg(F.greatest(F.max("along_start_mm") / F.lit(1000.0), F.lit(1e-6)).alias("length_m"))


def roll_extents(events: DataFrame, geometry: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, length_m and gap_warnings of every roll that has frames: the length by its events' furthest position or, where that is
    further, its frames'. geometry: keys, along_mm, gap_warning (frame_geometry)."""
    g = geometry.groupBy(*keys).agg(F.max("along_mm").alias("_frames"), F.count_if("gap_warning").alias("gap_warnings"))
    e = events.groupBy(*keys).agg(F.max("along_start_mm").alias("_events"))
    furthest = F.greatest("_frames", "_events") / F.lit(1000.0)
    return g.join(e, keys, "left").select(*keys, F.greatest(furthest, F.lit(1e-6)).alias("length_m"), "gap_warnings")


def metre_points(events: DataFrame, rolls: DataFrame, keys: list[str]) -> DataFrame:
    """Points of each metre of each roll, 4 at most. A continuous event gives 4 to each of ceil(length) metres from its
    start; positions beyond the ends count to the first or last metre."""
    counted = events.filter(grading.counts_toward_score(F.col("status"), F.col("assertion")))
    long_one = grading.is_continuous(F.col("length_mm"))
    steps = F.when(long_one, F.sequence(F.lit(0), grading.metres_of(F.col("length_mm")) - 1)).otherwise(F.array(F.lit(0)))
    points = F.when(long_one, F.lit(4)).otherwise(grading.points_by_band(F.col("length_mm")))
    entries = counted.select(*keys, "along_start_mm", points.alias("points"), F.explode(steps).alias("step"))
    at = F.floor(F.col("along_start_mm") / 1000.0).cast("long") + F.col("step")
    last = F.ceil("length_m").cast("long") - 1
    binned = entries.join(rolls.select(*keys, "length_m").hint("merge"), keys).select(*keys, F.greatest(F.lit(0), F.least(at, last)).alias("metre"), "points")
    return binned.groupBy(*keys, "metre").agg(F.least(F.lit(4), F.sum("points")).alias("points"))


def roll_verdicts(events: DataFrame, rolls: DataFrame, keys: list[str], hold_at: float = 20.0, reject_at: float = 40.0) -> DataFrame:
    """Points, density and verdict of every roll, those without events too. rolls: keys, length_m, width_m."""
    totals = metre_points(events, rolls, keys).groupBy(*keys).agg(F.sum("points").alias("points"))
    out = rolls.join(totals, keys, "left").withColumn("points", F.coalesce("points", F.lit(0)).cast("long"))
    out = out.withColumn("points_per_100yd2", grading.density(F.col("points"), F.col("length_m"), F.col("width_m")))
    return out.withColumn("verdict", grading.verdict(F.col("points_per_100yd2"), hold_at, reject_at))


def fleet(verdicts: DataFrame) -> DataFrame:
    """Rolls, points and area by sku and verdict, with subtotals."""
    return verdicts.rollup("sku", "verdict").agg(F.count("*").alias("rolls"), F.sum("points").alias("points"), F.sum((F.col("length_m") * F.col("width_m")).cast("decimal(18,6)")).alias("area_m2"))
