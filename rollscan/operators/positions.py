"""Positions of frames on the roll: markers, dead reckoning, gaps, health of the trace and of the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.functions.grading import refuse
from rollscan.operators.ranks import interpolated
from rollscan.operators.scan import PART, before, inside, lagged, ranged, with_summaries
from rollscan.staging import sized, stage


def mm_per_px(corners: Column, length_mm: Column) -> Column:
    """A marker's physical side over the mean of its four edges. corners: array of structs x, y in order."""
    turned = F.concat(F.slice(corners, 2, 3), F.slice(corners, 1, 1))
    edges = F.zip_with(corners, turned, lambda a, b: F.hypot(a.x - b.x, a.y - b.y))
    mean = F.aggregate(edges, F.lit(0.0), lambda s, e: s + e) / 4
    return refuse(mean <= 0, "a marker has no extent", length_mm / mean)


def marker_geometry(readings: DataFrame, pitch_mm: float = 100.0, length_mm: float = 40.0) -> DataFrame:
    """along_mm of the frame's top edge, scale and sorted marker ids of each frame. The position uses the mean scale.
    readings: roll_id, frame_index, marker_id, corners, top_y_px."""
    r = readings.withColumn("scale", mm_per_px(F.col("corners"), F.lit(length_mm)))
    scale = Window.partitionBy("roll_id", "frame_index")
    r = r.withColumn("mean_scale", F.avg("scale").over(scale))
    top = F.col("marker_id") * F.lit(pitch_mm) - F.col("top_y_px") * F.col("mean_scale")
    return r.groupBy("roll_id", "frame_index").agg(F.avg(top).alias("along_mm"), F.max("mean_scale").alias("mm_per_px"), F.array_sort(F.collect_list("marker_id")).alias("marker_ids"))


def frame_geometry(frames: DataFrame, fallback_speed: float | None = 0.04, max_gap_mm: float = 250.0, max_gap_s: float = 2.0, parts: int | None = None) -> DataFrame:
    """Position of every frame. frames: roll_id, frame_index, ts_s, measured_mm and mm_per_px (null without a marker).

    Without a marker the position is the last anchor's, carried on at the last known speed. Anchors are frames with a
    marker, and the first frame (at 0) where a fallback speed is declared. The speed is the slope between the two latest
    anchors that are apart in time, else the fallback. placed is false where neither is known.

    Frames are dealt in ranges of (roll, frame). A range carries on what stands at its beginning: the anchor, speed and scale
    that the summaries of the roll's earlier ranges lead to. So a roll may fill any number of tasks.
    """
    keys, order = ["roll_id"], ["frame_index"]
    measured = F.col("measured_mm").isNotNull()
    f = ranged(frames.select(*keys, *order, "ts_s", "measured_mm", "mm_per_px"), keys, order, parts)
    w = inside(keys, order)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.when(measured, F.struct(F.col("measured_mm").alias("mm"), F.col("ts_s").alias("s")))
    slope = lambda a: F.when(measured & (F.col("ts_s") - a["s"] > 0), (F.col("measured_mm") - a["mm"]) / (F.col("ts_s") - a["s"]))
    f = f.withColumn("anchor", anchor).withColumn("prior", F.last("anchor", True).over(earlier)).withColumn("slope", slope(F.col("prior")))
    f = f.select("*", F.last("anchor", True).over(upto).alias("at"), F.last("slope", True).over(upto).alias("own_speed"), F.last("mm_per_px", True).over(upto).alias("own_scale"))
    f = stage(f.drop("prior"), "frames")

    known = lambda c, f: f(c, F.when(F.col(c).isNotNull(), F.col("frame_index")))
    parts_of = f.groupBy(PART, *keys).agg(
        known("anchor", F.min_by).alias("first"), known("anchor", F.max_by).alias("last"), known("slope", F.max_by).alias("slope"), known("mm_per_px", F.max_by).alias("scale"),
        F.min_by(F.struct("ts_s", measured.alias("measured")), "frame_index").alias("head"),
    )
    # a declared start counts as an anchor that the first range begins with
    begins = F.when(F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy(PART)).isNull() & ~F.col("head.measured") & F.lit(fallback_speed is not None), F.struct(F.lit(0.0).alias("mm"), F.col("head.ts_s").alias("s")))
    parts_of = parts_of.withColumn("begins", begins)
    roll = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.coalesce(F.last("last", True).over(before(keys)), F.first("begins", True).over(roll))
    parts_of = parts_of.withColumn("held", held)
    apart = F.col("first.s") - F.col("held.s")
    entry = F.when(apart > 0, (F.col("first.mm") - F.col("held.mm")) / apart)
    parts_of = parts_of.withColumn("entry", entry).withColumn("leaves", F.coalesce("slope", "entry"))
    parts_of = parts_of.select(PART, *keys, "held", "entry", F.last("leaves", True).over(before(keys)).alias("held_speed"), F.last("scale", True).over(before(keys)).alias("held_scale"))

    f = with_summaries(f, parts_of, keys)
    # the slope at a range's first anchor needs the anchor before the range
    speed = F.coalesce("own_speed", F.when(F.col("at").isNotNull(), F.col("entry")), "held_speed", F.lit(fallback_speed).cast("double"))
    f = f.withColumn("speed", speed).withColumn("at", F.coalesce("at", "held"))
    advance = F.col("speed") * (F.col("ts_s") - F.col("at.s"))
    along = F.when(measured, F.col("measured_mm")).otherwise(F.col("at.mm") + F.coalesce(advance, F.lit(0.0)))
    gap = F.when(measured, F.lit(False)).when(F.col("speed").isNull(), F.col("ts_s") - F.col("at.s") > max_gap_s).otherwise(advance > max_gap_mm)
    scale = F.coalesce("own_scale", "held_scale", F.lit(1.0))
    return f.select("roll_id", "frame_index", "ts_s", along.alias("along_mm"), scale.alias("scale"), (~measured).alias("interpolated"), F.coalesce(gap, F.lit(False)).alias("gap_warning"), F.col("at").isNotNull().alias("placed"))


def inferred_roi() -> Column:
    """The region that a frame's own marker band leaves, null without a marker. The axis on which the band is narrow is
    cropped from its nearer end, a margin of 0.1 marker more, 25 % at most. Columns: frame_w, frame_h, band_x0, band_x1,
    band_y0, band_y1, marker_px."""
    margin, zero = 0.1 * F.col("marker_px"), F.lit(0)
    narrow_x = (F.col("band_x1") - F.col("band_x0")) <= (F.col("band_y1") - F.col("band_y0"))

    def kept(a0: Column, a1: Column, size: Column) -> tuple[Column, Column]:
        near = a0 < size - a1
        start = F.when(near, F.least(a1 + margin, 0.25 * size).cast("int")).otherwise(zero)
        end = F.when(near, size).otherwise(F.greatest(a0 - margin, 0.75 * size)).cast("int")
        return start, F.greatest(F.lit(1), end - start)

    x, w = kept(F.col("band_x0"), F.col("band_x1"), F.col("frame_w"))
    y, h = kept(F.col("band_y0"), F.col("band_y1"), F.col("frame_h"))
    wide, high = F.col("frame_w").cast("int"), F.col("frame_h").cast("int")
    roi = F.struct(F.when(narrow_x, x).otherwise(zero).alias("x"), F.when(narrow_x, zero).otherwise(y).alias("y"), F.when(narrow_x, w).otherwise(wide).alias("w"), F.when(narrow_x, high).otherwise(h).alias("h"))
    return F.when(F.col("band_x0").isNotNull(), roi)


def full_roi() -> Column:
    return F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("frame_w").cast("int").alias("w"), F.col("frame_h").cast("int").alias("h"))


def held_roi(frames: DataFrame, configured: Column | None = None) -> DataFrame:
    """The region of interest of every frame: the configured one, else that inferred from the first marker frame and held,
    else the full frame. frames: roll_id, frame_index and the columns of inferred_roi(). What is held is one row a roll."""
    roi = inferred_roi()
    first = frames.select(F.col("roll_id").alias("_roll"), "frame_index", roi.alias("_held")).filter("_held IS NOT NULL")
    first = stage(first.groupBy("_roll").agg(F.min("frame_index").alias("_from"), F.min_by("_held", "frame_index").alias("_held")), "regions")
    joined = frames.join(sized(first), F.col("roll_id").eqNullSafe(F.col("_roll")), "left")
    held = F.when(F.col("frame_index") >= F.col("_from"), F.col("_held"))
    return joined.withColumn("roi", F.coalesce(*([configured] if configured is not None else []), held, full_roi())).drop("_roll", "_from", "_held")


def trace_steps(geometry: DataFrame) -> DataFrame:
    """Step from the frame before."""
    return lagged(geometry, ["roll_id"], ["frame_index"], "along_mm", "_before").withColumn("step_mm", F.col("along_mm") - F.col("_before")).drop("_before")


def position_health(geometry: DataFrame, pitch_mm: float = 100.0) -> DataFrame:
    """Problems of each roll's trace: backward steps (below -5 mm), jumps (above 3 pitches), scale spread above 8 %, gaps."""
    aggs = (
        F.count("*").alias("frames"),
        F.count_if(F.col("step_mm") < -5).alias("backward"),
        F.count_if(F.col("step_mm") > 3 * pitch_mm).alias("jumps"),
        F.count_if("interpolated").alias("interpolated"),
        F.count_if("gap_warning").alias("gaps"),
        (F.max("along_mm") - F.min("along_mm")).alias("travel_mm"),
        ((F.max("scale") - F.min("scale")) / F.min("scale")).alias("scale_spread"),
    )
    g = interpolated(stage(trace_steps(geometry), "steps"), ["roll_id"], "step_mm", [0.5], *aggs)
    g = g.withColumn("median_step_mm", F.col("at")[0]).drop("at", "n")
    named = (("backward", F.col("backward") > 0), ("jump", F.col("jumps") > 0), ("scale", F.col("scale_spread") > 0.08), ("gap", F.col("gaps") > 0))
    return g.withColumn("problems", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named])), ","))


def arrival_rate(frames: DataFrame, key: str = "source_id", last: int = 30) -> DataFrame:
    """Frames a second over the last 30 arrivals; null below two."""
    w = Window.partitionBy(key).orderBy("ts_s", "frame_index").rowsBetween(1 - last, 0)
    span, n = F.max("ts_s").over(w) - F.min("ts_s").over(w), F.count("*").over(w)
    return frames.withColumn("fps", F.when((n >= 2) & (span > 0), (n - 1) / span))


def stream_health(frames: DataFrame, key: str = "source_id") -> DataFrame:
    """Fps, brightness range and trend, median focus, marker coverage and the problems they show. frames: key, ts_s,
    brightness, focus, has_marker."""
    aggs = (
        F.count("*").alias("frames"),
        ((F.count("*") - 1) / (F.max("ts_s") - F.min("ts_s"))).alias("fps"),
        (F.max("brightness") - F.min("brightness")).alias("brightness_range"),
        F.regr_slope("brightness", "ts_s").alias("brightness_trend"),
        F.count_if("has_marker").alias("with_marker"),
    )
    g = interpolated(frames, [key], "focus", [0.5], *aggs).withColumn("median_focus", F.col("at")[0]).drop("at", "n")
    coverage = F.col("with_marker") / F.col("frames")
    named = (("slow", F.col("fps") < 5), ("unsteady light", F.col("brightness_range") > 60), ("few markers", coverage < 0.5))
    return g.withColumn("coverage", coverage).withColumn("problems", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named])), ","))


def tape_ratio(readings: DataFrame, key: str = "source_id", pitch_mm: float = 100.0, length_mm: float = 40.0, most: float = 0.03) -> DataFrame:
    """How the printed tape fits its parameters. For each frame of two markers or more: the axis along which it lies (x or y, the
    wider spread of centres) and the pixels between neighbouring marker ids over the markers' mean edge. For each source: the median of
    these ratios, its relative error against pitch_mm / length_mm, the axis (x only where every frame says so), and problems.
    readings: key, frame_index, marker_id, corners."""
    c = F.col("corners")
    turned = F.concat(F.slice(c, 2, 3), F.slice(c, 1, 1))
    edge = F.aggregate(F.zip_with(c, turned, lambda a, b: F.hypot(a.x - b.x, a.y - b.y)), F.lit(0.0), lambda s, e: s + e) / 4
    centre = lambda axis: F.aggregate(F.transform(c, lambda p: p[axis]), F.lit(0.0), lambda s, v: s + v) / 4
    r = readings.select(key, "frame_index", "marker_id", edge.alias("edge"), centre("x").alias("cx"), centre("y").alias("cy"))
    ends = lambda v, f: f(v, "marker_id")
    f = r.groupBy(key, "frame_index").agg(
        (F.max("marker_id") - F.min("marker_id")).alias("steps"), F.avg("edge").alias("edge"),
        (F.max("cx") - F.min("cx")).alias("wide"), (F.max("cy") - F.min("cy")).alias("high"),
        F.abs(ends("cx", F.max_by) - ends("cx", F.min_by)).alias("dx"), F.abs(ends("cy", F.max_by) - ends("cy", F.min_by)).alias("dy"),
    )
    across = F.col("wide") >= F.col("high")
    f = f.filter("steps > 0").select(key, across.alias("across"), F.when(F.col("edge") > 0, F.when(across, F.col("dx")).otherwise(F.col("dy")) / F.col("steps") / F.col("edge")).alias("ratio"))
    g = interpolated(stage(f, "ratios"), [key], "ratio", [0.5], F.bool_and("across").alias("all_across"), F.count("*").alias("frames_of_two"))
    g = g.withColumn("ratio", F.col("at")[0]).drop("at", "n").withColumn("ratio_error", F.col("ratio") / F.lit(pitch_mm / length_mm) - 1).withColumn("tape_axis", F.when(F.col("all_across"), "x").otherwise("y"))
    named = (("tape lies across", F.col("all_across")), ("pitch does not fit the markers", F.abs("ratio_error") > most))
    return g.withColumn("problems", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named])), ",")).drop("all_across")


def frame_time(pos_ms: Column, index: Column, fps: Column) -> Column:
    """The container's position, else index over fps, else the index."""
    return F.coalesce(F.when(pos_ms > 0, pos_ms / 1000.0), F.when(fps > 0, index / fps), index.cast("double"))


def tape_intrusion(frames: DataFrame) -> DataFrame:
    """P25: does the marker band reach into the region of interest, and by how many pixels. frames: roll_id, frame_index, band_x0, band_x1, roi_x, roi_w."""
    px = F.greatest(F.lit(0.0), F.least("band_x1", F.col("roi_x") + F.col("roi_w")) - F.greatest("band_x0", "roi_x"))
    return frames.select("roll_id", "frame_index", px.alias("intrusion_px"), (px > 0).alias("intrudes"))
