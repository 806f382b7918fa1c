"""Reports on rolls, events and the operators' decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollscan.functions import grading
from rollscan.operators.ranks import interpolated
from rollscan.staging import sized, stage


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The latest decision of each event (ties: the largest decision id). decisions: roll_id, event_id, status, operator, at, decision_id."""
    last = F.struct("at", "decision_id")
    return decisions.groupBy("roll_id", "event_id").agg(F.max_by("status", last).alias("status"), F.max_by("operator", last).alias("operator"), F.max("at").alias("at"))


def realised_false_alarms(events: DataFrame, decisions: DataFrame, rolls: DataFrame, budget: float) -> DataFrame:
    """Events that operators rejected, per 100 m, next to the budget. rolls: roll_id, length_m."""
    now = events.select("roll_id", "event_id").join(latest_decisions(decisions), ["roll_id", "event_id"], "left")
    n = now.groupBy("roll_id").agg(F.count_if(F.col("status") == "rejected").alias("false_alarms"), F.count("*").alias("events"))
    out = rolls.join(n, "roll_id", "left").fillna(0, ["false_alarms", "events"])
    return out.withColumn("fa_per_100m", F.col("false_alarms") * 100 / F.col("length_m")).withColumn("budget", F.lit(budget)).withColumn("over_budget", F.col("fa_per_100m") > F.lit(budget))


def latency_table(timings: DataFrame, stages: list[str], stride: int) -> DataFrame:
    """Median of each stage and of their total."""
    total = sum((F.col(s) for s in stages[1:]), F.col(stages[0]))
    long = timings.select(*stages, total.alias("total")).unpivot([], [*stages, "total"], "stage", "ms")
    out = interpolated(long, ["stage"], "ms", [0.5], F.count("*").alias("frames"))
    return out.select("stage", F.col("at")[0].alias("median_ms"), "frames", F.lit(stride).alias("stride"))


def near_misses(scores: DataFrame, calibrations: DataFrame) -> DataFrame:
    """frames' peaks of each sku against its threshold: median and largest peak, frames at or above, closest below. scores: sku, frame, score."""
    peaks = stage(scores.groupBy("sku", "frame").agg(F.max("score").alias("peak")).join(sized(stage(calibrations.select("sku", "threshold"), "calibrations")), "sku"), "peaks")
    peak = F.col("peak")
    aggs = F.count("*").alias("frames"), F.max(peak).alias("max_peak"), F.count_if(peak >= F.col("threshold")).alias("at_or_above"), F.max(F.when(peak < F.col("threshold"), peak)).alias("closest_below")
    out = interpolated(peaks, ["sku"], "peak", [0.5], *aggs)
    return out.select("sku", "frames", F.col("at")[0].alias("median_peak"), "max_peak", "at_or_above", "closest_below")


def score_strip(peaks: DataFrame, geometry: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Each frame's peak against its position; refused without a calibration. peaks: sku, roll_id, frame_index, peak."""
    joined = peaks.join(geometry.select("roll_id", "frame_index", "along_mm"), ["roll_id", "frame_index"])
    return _with_threshold(joined, calibrations).withColumn("what", F.lit("frame maxima"))


def event_strip(events: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Where frames' peaks were not kept, the peaks of events only, at their first position. events: sku, roll_id, event_id,
    along_start_mm, max_score."""
    e = events.select("sku", "roll_id", "event_id", F.col("along_start_mm").alias("along_mm"), F.col("max_score").alias("peak"))
    return _with_threshold(e, calibrations).withColumn("what", F.lit("events only"))


def _with_threshold(rows: DataFrame, calibrations: DataFrame) -> DataFrame:
    joined = rows.join(sized(stage(calibrations.select("sku", "threshold"), "calibrations")), "sku", "left")
    return joined.withColumn("threshold", grading.refuse(F.col("threshold").isNull(), "a strip needs a calibration", F.col("threshold")))


def counters(events: DataFrame, rolls: DataFrame) -> DataFrame:
    """A25, ST8: per roll: events by assertion and status, points that count, density. rolls: roll_id, length_m, width_m, points (capped, A11)."""
    c = events.groupBy("roll_id").agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col("assertion") == a).alias(a) for a in ("asserted", "uncertain")],
        *[F.count_if(F.col("status") == s).alias(s) for s in ("proposed", "confirmed", "rejected")],
        F.sum(F.when(grading.counts_toward_score(F.col("status"), F.col("assertion")), grading.points_of_event(F.col("length_mm"))).otherwise(0)).alias("uncapped_points"),
    )
    out = rolls.join(c, "roll_id", "left")
    return out.withColumn("points_per_100yd2", grading.density(F.col("points"), F.col("length_m"), F.col("width_m")))


def defect_map(events: DataFrame) -> DataFrame:
    """Centre, class, mark area and run segment of each event."""
    counted = grading.counts_toward_score(F.col("status"), F.col("assertion"))
    points = F.when(counted, grading.points_of_event(F.col("length_mm"))).otherwise(0)
    kind = F.when(F.col("status") == "rejected", "rejected").otherwise(F.col("assertion"))
    long_one = grading.is_continuous(F.col("length_mm"))
    return events.select("sku", "roll_id", "event_id", ((F.col("along_start_mm") + F.col("length_mm") / 2) / 1000.0).alias("along_m"), (F.col("across_start_mm") + F.col("width_mm") / 2).alias("across_mm"), kind.alias("kind"), grading.marker_area(points).alias("area"), F.when(long_one, F.col("along_start_mm") / 1000.0).alias("run_from_m"), F.when(long_one, (F.col("along_start_mm") + F.col("length_mm")) / 1000.0).alias("run_to_m"))


def defect_table(events: DataFrame) -> DataFrame:
    """The rows of a roll's table of defects."""
    counted = grading.counts_toward_score(F.col("status"), F.col("assertion"))
    state = F.when(F.col("status").isin("rejected", "confirmed"), F.col("status")).otherwise(F.col("assertion"))
    return events.select("sku", "roll_id", "event_id", (F.col("along_start_mm") / 1000.0).alias("position_m"), F.col("across_start_mm").alias("across_mm"), "length_mm", "width_mm", "max_score", state.alias("state"), F.when(counted, grading.points_of_event(F.col("length_mm"))).otherwise(0).alias("points"), (~counted).alias("shaded"))


def latest_rolls(rolls: DataFrame, n: int) -> DataFrame:
    """The newest n rolls by the time they finished, or began."""
    return rolls.orderBy(F.coalesce("finished_at", "started_at").desc(), F.desc("roll_id")).limit(n)


def roll_with_calibration(rolls: DataFrame, calibrations: DataFrame, roll_id=None) -> DataFrame:
    """T4: one roll, the newest where none is named, with the calibration of its sku (nulls where it has none). rolls: sku, roll_id
    and what latest_rolls reads; calibrations: sku and any columns."""
    one = latest_rolls(rolls, 1) if roll_id is None else rolls.filter(F.col("roll_id") == roll_id)
    return one.join(calibrations, "sku", "left")


def roll_events(events: DataFrame, roll_id, status: str | None = None) -> DataFrame:
    """Events of a roll by position, of one status where it is given."""
    e = events.filter(F.col("roll_id") == roll_id)
    return (e.filter(F.col("status") == status) if status else e).orderBy("along_start_mm", "event_id")


def top_by_position(events: DataFrame, n: int = 60) -> DataFrame:
    """The n furthest events of each roll."""
    w = Window.partitionBy("roll_id").orderBy(F.desc("along_start_mm"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def evidence(detections: DataFrame, frames: int) -> DataFrame:
    """Detections in the first `frames` frames of a roll that have any."""
    w = Window.partitionBy("roll_id").orderBy("frame_index")
    return detections.withColumn("nth", F.dense_rank().over(w).cast("long")).filter(F.col("nth") <= frames)


def evidence_events(events: DataFrame, most: int = 24) -> DataFrame:
    """The first `most` events of each roll that have a crop, by position. events: roll_id, event_id, along_start_mm, crop_path."""
    w = Window.partitionBy("roll_id").orderBy("along_start_mm", "event_id")
    return events.filter("crop_path IS NOT NULL").withColumn("nth", F.row_number().over(w).cast("long")).filter(F.col("nth") <= most)


def documents(rolls: DataFrame, events: DataFrame) -> DataFrame:
    """Each roll as a JSON document with its events."""
    e = events.groupBy("roll_id").agg(F.array_sort(F.collect_list(F.struct("along_start_mm", "event_id", "length_mm", "width_mm", "max_score", "assertion", "status"))).alias("events"))
    return rolls.join(e, "roll_id", "left").select("roll_id", F.to_json(F.struct("*")).alias("document"))
