"""Registered queries: a Spark plan for each, and the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollscan.functions import grading
from rollscan.functions.sql import register as register_sql
from rollscan.operators import astm, bank, calibrate, components, evaluate, neighbours, params, positions, ranks, raster, report, tiles, track
from rollscan.plans import views as v
from rollscan.sources import images, store
from rollscan.staging import shared_dir, sized, stage
from rollscan.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ROLL = ["sku", "roll_id"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- grading -------------------------------------------------------------------------------------------------------

COUNTED = "(status = 'confirmed' OR (status <> 'rejected' AND assertion = 'asserted'))"
BAND = "CASE WHEN length_mm <= 75 THEN 1 WHEN length_mm <= 150 THEN 2 WHEN length_mm <= 230 THEN 3 ELSE 4 END"
METRES = "greatest(1, ceil(length_mm / 1000::DOUBLE))::BIGINT"
POINTS = f"CASE WHEN length_mm >= 230 THEN 4 * {METRES} ELSE {BAND} END"
VERDICTS = f"""{v.EVENTS}, {v.ROLLS},
entries AS (
  SELECT sku, roll_id, CASE WHEN length_mm >= 230 THEN 4 ELSE {BAND} END AS points, floor(along_start_mm / 1000)::BIGINT + unnest(range(0, CASE WHEN length_mm >= 230 THEN {METRES} ELSE 1 END)) AS metre
  FROM v_events WHERE {COUNTED}),
metres AS (
  SELECT sku, roll_id, greatest(0, least(metre, ceil(length_m)::BIGINT - 1)) AS metre, least(4, sum(points))::BIGINT AS points
  FROM entries JOIN v_rolls USING (sku, roll_id) GROUP BY 1, 2, 3),
totals AS (SELECT sku, roll_id, sum(points)::BIGINT AS points FROM metres GROUP BY 1, 2),
verdicts AS (
  SELECT *, CASE WHEN points_per_100yd2 >= 40 THEN 'reject' WHEN points_per_100yd2 >= 20 THEN 'hold' ELSE 'pass' END AS verdict
  FROM (SELECT r.sku, r.roll_id, r.length_m, r.width_m, coalesce(t.points, 0) AS points, coalesce(t.points, 0) * 83.61::DOUBLE / (r.length_m * r.width_m) AS points_per_100yd2
        FROM v_rolls r LEFT JOIN totals t USING (sku, roll_id)))"""


@query(f"WITH {VERDICTS} SELECT * FROM verdicts")
def roll_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir, ("sku", "roll_id", "along_start_mm", "length_mm", "assertion", "status"))
    return astm.roll_verdicts(e, v.rolls(spark, sf_dir), ROLL)


@query(f"""WITH {VERDICTS}
SELECT sku, verdict, count(*)::BIGINT AS rolls, sum(points)::BIGINT AS points, sum((length_m * width_m)::DECIMAL(18,6))::DECIMAL(28,6) AS area_m2 FROM verdicts GROUP BY ROLLUP (sku, verdict)""")
def fleet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return astm.fleet(roll_verdicts(spark, sf_dir))


@query(f"""WITH {v.EVENTS} SELECT sku, roll_id, event_id, {COUNTED} AS counts, ({BAND})::INT AS by_band, ({POINTS})::INT AS by_event FROM v_events""")
def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir)
    return e.select("sku", "roll_id", "event_id", grading.counts_toward_score(F.col("status"), F.col("assertion")).alias("counts"), grading.points_by_band(F.col("length_mm")).alias("by_band"), grading.points_of_event(F.col("length_mm")).alias("by_event"))


@query(f"""WITH {v.EVENTS}
SELECT sku, roll_id, event_id, (along_start_mm + length_mm / 2) / 1000 AS along_m, across_start_mm + width_mm / 2 AS across_mm,
  CASE WHEN status = 'rejected' THEN 'rejected' ELSE assertion END AS kind,
  least(260::DOUBLE, greatest(28::DOUBLE, 260::DOUBLE * (CASE WHEN {COUNTED} THEN {POINTS} ELSE 0 END) / 8::DOUBLE)) AS area,
  CASE WHEN length_mm >= 230 THEN along_start_mm / 1000 END AS run_from_m, CASE WHEN length_mm >= 230 THEN (along_start_mm + length_mm) / 1000 END AS run_to_m FROM v_events""")
def defect_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.defect_map(v.events(spark, sf_dir))


@query(f"""WITH {v.EVENTS}
SELECT sku, roll_id, event_id, along_start_mm / 1000 AS position_m, across_start_mm AS across_mm, length_mm, width_mm, max_score,
  CASE WHEN status IN ('rejected', 'confirmed') THEN status ELSE assertion END AS state, (CASE WHEN {COUNTED} THEN {POINTS} ELSE 0 END)::INT AS points, NOT {COUNTED} AS shaded FROM v_events""")
def defect_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.defect_table(v.events(spark, sf_dir))


@query(f"""WITH {VERDICTS},
c AS (
  SELECT roll_id, count(*)::BIGINT AS events, count(*) FILTER (assertion = 'asserted') AS asserted, count(*) FILTER (assertion = 'uncertain') AS uncertain,
    count(*) FILTER (status = 'proposed') AS proposed, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'rejected') AS rejected,
    sum(CASE WHEN {COUNTED} THEN {POINTS} ELSE 0 END)::BIGINT AS uncapped_points FROM v_events GROUP BY 1)
SELECT roll_id, length_m, width_m, points, events, asserted, uncertain, proposed, confirmed, rejected, uncapped_points, points_per_100yd2 FROM verdicts JOIN c USING (roll_id)""")
def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counters(v.events(spark, sf_dir), roll_verdicts(spark, sf_dir).select("roll_id", "length_m", "width_m", "points"))


# --- thresholds ----------------------------------------------------------------------------------------------------

BUDGET, METRES_PER_TILE = 20.0, 0.5


def _threshold_sql(budget: float, source: str = "v_scores", keys: str = "sku", where: str = "") -> str:
    alpha = f"({budget}::DOUBLE * {METRES_PER_TILE}::DOUBLE / 100::DOUBLE)"
    return f"""n AS (SELECT {keys}, count(score)::BIGINT AS n, {alpha} AS alpha, ceil((count(score) + 1) * (1 - {alpha}))::BIGINT AS k,
    greatest(1, least(count(score), ceil((count(score) + 1) * (1 - least(1::DOUBLE, 5 * {alpha})))::BIGINT)) AS k_low FROM {source} {where} GROUP BY {keys}),
r AS (SELECT {keys}, score, row_number() OVER (PARTITION BY {keys} ORDER BY score) AS rn FROM {source} {where}),
p AS (SELECT {keys}, n, alpha, k, max(score) FILTER (rn = k) AS t, max(score) FILTER (rn = k_low) AS a FROM n JOIN r USING ({keys}) GROUP BY {keys}, n, alpha, k, k_low),
cal AS (
  SELECT {keys}, n AS n_clean_tiles, alpha, k, CASE WHEN k > n THEN 'sample_too_small' WHEN k > n - 10 THEN 'unstable_tail' ELSE 'ok' END AS status,
    CASE WHEN k <= n - 10 THEN t END AS threshold, CASE WHEN k <= n - 10 THEN a END AS abstain_low FROM p)"""


@query(f"WITH {v.SCORES}, {_threshold_sql(BUDGET)} SELECT * FROM cal")
def conformal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.conformal_threshold(v.clean_scores(spark, sf_dir), ["sku"], BUDGET, METRES_PER_TILE)


@query(f"WITH {v.SCORES}, {_threshold_sql(BUDGET)} SELECT sku, threshold FROM cal")
def conformal_threshold_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql(spark)
    return spark.sql(f"SELECT sku, conformal_threshold(score, {BUDGET}D, {METRES_PER_TILE}D, 10) AS threshold FROM {{scores}} GROUP BY sku", scores=v.clean_scores(spark, sf_dir))


@query(f"WITH {v.SCORES}, {_threshold_sql(1.0)} SELECT * FROM cal")
def refused_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.conformal_threshold(v.clean_scores(spark, sf_dir), ["sku"], 1.0, METRES_PER_TILE)


@query(f"""WITH {v.SCORES}, {_threshold_sql(BUDGET)}
SELECT sku, tile_id, score, CASE WHEN score >= threshold THEN 'asserted' WHEN score >= abstain_low THEN 'uncertain' END AS assertion,
  round(CASE WHEN threshold - abstain_low <= 0 THEN CASE WHEN score >= threshold THEN 1::DOUBLE ELSE 0::DOUBLE END WHEN score <= abstain_low THEN 0::DOUBLE
       WHEN score < threshold THEN 0.5::DOUBLE * (score - abstain_low) / (threshold - abstain_low) ELSE 0.5::DOUBLE + 0.5::DOUBLE * (1 - exp(-(score - threshold) / (threshold - abstain_low))) END, 9) AS confidence
FROM v_scores JOIN cal USING (sku)""")
def classify_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calibrate.classified(v.clean_scores(spark, sf_dir), conformal_threshold(spark, sf_dir), ["sku"])
    return c.withColumn("confidence", F.round("confidence", 9))  # exp differs in its last digit from engine to engine


@query(f"""WITH {v.SCORES}
SELECT sku, count(*)::BIGINT AS n, 100::DOUBLE / {METRES_PER_TILE}::DOUBLE / count(*) AS finest, 10 * (100::DOUBLE / {METRES_PER_TILE}::DOUBLE / count(*)) AS stable,
  ceil(10::DOUBLE / ({BUDGET}::DOUBLE * {METRES_PER_TILE}::DOUBLE / 100::DOUBLE))::BIGINT AS tiles_needed FROM v_scores GROUP BY sku""")
def budget_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.lit(METRES_PER_TILE)
    g = v.clean_scores(spark, sf_dir).groupBy("sku").agg(F.count("*").alias("n"))
    finest = grading.achievable_fa_per_100m(F.col("n"), m)
    return g.select("sku", "n", finest.alias("finest"), (10 * finest).alias("stable"), grading.tiles_needed(F.lit(BUDGET), m).alias("tiles_needed"))


FRACTIONS = [0.01, 0.02, 0.05, 0.1]
CURVE = f"""{v.SCORES}, f (requested) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in FRACTIONS)}),
fit AS (SELECT * FROM v_scores WHERE tile_id % 2 = 0), n AS (SELECT sku, count(*)::BIGINT AS n FROM fit GROUP BY sku),
k AS (SELECT sku, requested, n, ceil((n + 1) * (1 - 100::DOUBLE * requested / 100::DOUBLE))::BIGINT AS k FROM n CROSS JOIN f),
r AS (SELECT sku, score, row_number() OVER (PARTITION BY sku ORDER BY score) AS rn FROM fit),
t AS (SELECT sku, requested, CASE WHEN k > n THEN 'sample_too_small' WHEN k > n - 10 THEN 'unstable_tail' ELSE 'ok' END AS status, CASE WHEN k <= n - 10 THEN score END AS threshold
      FROM k LEFT JOIN r USING (sku) WHERE rn = least(k, n)),
o AS (SELECT sku, requested, status, threshold, count(*)::BIGINT AS n_validation, count(*) FILTER (score > threshold) AS n_over
      FROM (SELECT * FROM v_scores WHERE tile_id % 2 = 1) JOIN t USING (sku) GROUP BY 1, 2, 3, 4),
curve AS (SELECT sku, requested, status, threshold, n_validation, CASE WHEN status = 'ok' THEN n_over / n_validation::DOUBLE END AS realised FROM o)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.clean_scores(spark, sf_dir)
    fit, validation = s.filter("tile_id % 2 = 0"), s.filter("tile_id % 2 = 1")
    return calibrate.calibration_curve(fit, evaluate.disjoint(fit, validation, ["sku", "tile_id"]), ["sku"], FRACTIONS)


@query(f"WITH {CURVE} SELECT *, realised / requested AS ratio FROM curve")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir)


@query(f"""WITH {CURVE}
SELECT count(*)::BIGINT AS n, count(realised)::BIGINT AS resolved, count(*) FILTER (status = 'unstable_tail') AS unstable_tail, count(*) FILTER (status = 'sample_too_small') AS sample_too_small,
  count(*) FILTER (realised / requested > 1) AS hot, median(realised / requested) AS median_ratio FROM curve""")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.curve_summary(_curve(spark, sf_dir))


@query(f"""WITH {v.SCORES}, {_threshold_sql(1.0)}, own AS (SELECT sku, quantile_cont(score, 0.995) AS t, quantile_cont(score, 0.985) AS a FROM v_scores GROUP BY sku)
SELECT sku, CASE WHEN status = 'ok' THEN threshold ELSE round(t, 6) END AS threshold, CASE WHEN status = 'ok' THEN abstain_low ELSE round(a, 6) END AS abstain_low, CASE WHEN status = 'ok' THEN status ELSE 'self_thresholded' END AS status FROM cal JOIN own USING (sku)""")
def fallback_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = calibrate.thresholds_or_fallback(refused_threshold(spark, sf_dir), v.clean_scores(spark, sf_dir), ["sku"])
    return t.withColumns({c: F.when(F.col("status") == "ok", F.col(c)).otherwise(F.round(c, 6)) for c in ("threshold", "abstain_low")})


@query(f"WITH {v.SCORES} SELECT DISTINCT sku, 50::DOUBLE AS threshold, 0.8::DOUBLE * 50 AS abstain_low, 'NaN'::DOUBLE AS budget_fa, 0::INT AS n_clean_tiles, 'hand_set' AS status FROM v_scores")
def hand_set_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.hand_set(v.clean_scores(spark, sf_dir).select("sku").distinct(), 50.0)


@query(f"""WITH {v.SCORES}, {_threshold_sql(BUDGET)}, peaks AS (SELECT sku, tile_id // 10 AS frame, max(score) AS peak FROM v_scores GROUP BY ALL)
SELECT sku, count(*)::BIGINT AS frames, median(peak) AS median_peak, max(peak) AS max_peak, count(*) FILTER (peak >= threshold) AS at_or_above, max(peak) FILTER (peak < threshold) AS closest_below
FROM peaks JOIN cal USING (sku) GROUP BY sku""")
def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.clean_scores(spark, sf_dir).withColumn("frame", F.expr("tile_id div 10"))
    return report.near_misses(s, conformal_threshold(spark, sf_dir))


# --- positions -----------------------------------------------------------------------------------------------------

GEOMETRY = f"""{v.FRAMES},
a AS (SELECT *, coalesce(measured_mm, CASE WHEN row_number() OVER w = 1 THEN 0::DOUBLE END) AS anchor_mm FROM v_frames WINDOW w AS (PARTITION BY roll_id ORDER BY frame_index)),
b AS (SELECT *, CASE WHEN anchor_mm IS NOT NULL THEN ts_s END AS anchor_s FROM a),
c AS (SELECT *, last_value(anchor_mm IGNORE NULLS) OVER p AS prior_mm, last_value(anchor_s IGNORE NULLS) OVER p AS prior_s FROM b
      WINDOW p AS (PARTITION BY roll_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, CASE WHEN measured_mm IS NOT NULL AND ts_s - prior_s > 0 THEN (measured_mm - prior_mm) / (ts_s - prior_s) END AS slope FROM c),
e AS (SELECT *, coalesce(last_value(slope IGNORE NULLS) OVER u, 0.04::DOUBLE) AS speed, last_value(anchor_mm IGNORE NULLS) OVER u AS at_mm, last_value(anchor_s IGNORE NULLS) OVER u AS at_s,
        coalesce(last_value(mm_per_px IGNORE NULLS) OVER u, 1::DOUBLE) AS scale FROM d WINDOW u AS (PARTITION BY roll_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
geometry AS (
  SELECT roll_id, frame_index, ts_s, CASE WHEN measured_mm IS NOT NULL THEN measured_mm ELSE at_mm + speed * (ts_s - at_s) END AS along_mm, scale, measured_mm IS NULL AS interpolated,
    measured_mm IS NULL AND speed * (ts_s - at_s) > 250 AS gap_warning, at_mm IS NOT NULL AS placed FROM e)"""


@query(f"WITH {GEOMETRY} SELECT * FROM geometry")
def frame_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.frame_geometry(v.frames(spark, sf_dir))


@query(f"""WITH {GEOMETRY}, s AS (SELECT *, along_mm - lag(along_mm) OVER (PARTITION BY roll_id ORDER BY frame_index) AS step_mm FROM geometry),
g AS (SELECT roll_id, count(*)::BIGINT AS frames, count(*) FILTER (step_mm < -5) AS backward, count(*) FILTER (step_mm > 300) AS jumps, count(*) FILTER (interpolated) AS interpolated, count(*) FILTER (gap_warning) AS gaps,
        max(along_mm) - min(along_mm) AS travel_mm, median(step_mm) AS median_step_mm, (max(scale) - min(scale)) / min(scale) AS scale_spread FROM s GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN backward > 0 THEN 'backward' END, CASE WHEN jumps > 0 THEN 'jump' END, CASE WHEN scale_spread > 0.08::DOUBLE THEN 'scale' END, CASE WHEN gaps > 0 THEN 'gap' END], lambda x: x IS NOT NULL), ',') AS problems FROM g""")
def position_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.position_health(frame_geometry(spark, sf_dir))


@query(f"""WITH {v.FRAMES}, w AS (SELECT roll_id, frame_index, ts_s, count(*) OVER k AS n, max(ts_s) OVER k - min(ts_s) OVER k AS span FROM v_frames
  WINDOW k AS (PARTITION BY roll_id ORDER BY ts_s, frame_index ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT roll_id, frame_index, CASE WHEN n >= 2 AND span > 0 THEN (n - 1) / span END AS fps FROM w""")
def arrival_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.arrival_rate(v.frames(spark, sf_dir).select("roll_id", "frame_index", "ts_s"), "roll_id").drop("ts_s")


@query(f"""WITH {v.FRAMES}, g AS (
  SELECT roll_id, count(*)::BIGINT AS frames, (count(*) - 1) / (max(ts_s) - min(ts_s)) AS fps, max(value) - min(value) AS brightness_range, round(regr_slope(value, ts_s), 9) AS brightness_trend, median(value * 2) AS median_focus, count(*) FILTER (marked) AS with_marker FROM v_frames GROUP BY 1)
SELECT *, with_marker / frames::DOUBLE AS coverage, array_to_string(list_filter([CASE WHEN fps < 5 THEN 'slow' END, CASE WHEN brightness_range > 60 THEN 'unsteady light' END, CASE WHEN with_marker / frames::DOUBLE < 0.5 THEN 'few markers' END], lambda x: x IS NOT NULL), ',') AS problems FROM g""")
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir).select("roll_id", "ts_s", F.col("value").alias("brightness"), (F.col("value") * 2).alias("focus"), F.col("marked").alias("has_marker"))
    h = positions.stream_health(f, "roll_id")
    return h.withColumn("brightness_trend", F.round("brightness_trend", 9))  # a slope's last digits depend on the order of sums


@query(f"""WITH {v.FRAMES} SELECT roll_id, frame_index, coalesce(CASE WHEN value > 50 THEN value / 1000 END, CASE WHEN roll_id % 2 = 0 THEN frame_index / 25::DOUBLE END, frame_index::DOUBLE) AS ts_s FROM v_frames""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, fps = F.when(F.col("value") > 50, F.col("value")), F.when(F.col("roll_id") % 2 == 0, F.lit(25.0))
    return v.frames(spark, sf_dir).select("roll_id", "frame_index", positions.frame_time(pos, F.col("frame_index"), fps).alias("ts_s"))


@query(f"""WITH {v.FRAMES}, m AS (SELECT roll_id, frame_index, frame_index AS marker_id, value AS top_y_px, 40::DOUBLE / (10 + value) AS s FROM v_frames WHERE marked)
SELECT roll_id, frame_index, marker_id * 100::DOUBLE - top_y_px * s AS along_mm, s AS mm_per_px, [marker_id] AS marker_ids FROM m""")
def marker_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.col("value") + 10
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    corners = F.array(point(zero, zero), point(side, zero), point(side, side), point(zero, side))
    r = v.frames(spark, sf_dir).filter("marked").select("roll_id", "frame_index", F.col("frame_index").alias("marker_id"), corners.alias("corners"), F.col("value").alias("top_y_px"))
    return positions.marker_geometry(r)


@query(f"""WITH {v.FRAMES} SELECT roll_id, frame_index, greatest(0::DOUBLE, least(value + 40, 900::DOUBLE) - greatest(value, 60::DOUBLE)) AS intrusion_px, greatest(0::DOUBLE, least(value + 40, 900::DOUBLE) - greatest(value, 60::DOUBLE)) > 0 AS intrudes FROM v_frames""")
def tape_intrusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir).select("roll_id", "frame_index", F.col("value").alias("band_x0"), (F.col("value") + 40).alias("band_x1"), F.lit(60.0).alias("roi_x"), F.lit(840.0).alias("roi_w"))
    return positions.tape_intrusion(f)


@query(f"""WITH {v.FRAMES}, r AS (
  SELECT roll_id, frame_index, CASE WHEN marked THEN least(value + 40 + 4, 320::DOUBLE)::DOUBLE END AS cut FROM v_frames),
h AS (SELECT roll_id, frame_index, first_value(trunc(cut)::INT IGNORE NULLS) OVER (PARTITION BY roll_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM r)
SELECT roll_id, frame_index, coalesce(cut, 0) AS x, 0 AS y, 1280 - coalesce(cut, 0) AS w, 720 AS h FROM h""")
def held_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda c: F.when(F.col("marked"), c)
    f = v.frames(spark, sf_dir).select("roll_id", "frame_index", F.lit(1280).alias("frame_w"), F.lit(720).alias("frame_h"), m(F.col("value")).alias("band_x0"), m(F.col("value") + 40).alias("band_x1"), m(F.lit(0.0)).alias("band_y0"), m(F.lit(700.0)).alias("band_y1"), m(F.lit(40.0)).alias("marker_px"))
    return positions.held_roi(f).select("roll_id", "frame_index", "roi.*")


# --- patches and banks ---------------------------------------------------------------------------------------------

_DIST = "sqrt(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"


def _bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = v.patches(spark, sf_dir)
    return p.filter("vec_id % 4 = 0"), p.filter("vec_id % 4 <> 0")


@query(f"""SELECT q.vec_id AS query_id, min({_DIST}) AS distance FROM embeddings q JOIN embeddings b ON q.label = b.label AND b.vec_id % 4 = 0 WHERE q.vec_id % 4 <> 0 GROUP BY 1""")
def nn_distance_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = _bank(spark, sf_dir)
    return bank.nearest_pairs(q.select("sku", F.col("vec_id").alias("query_id"), "embedding"), b, ["sku"]).drop("sku")


@query(f"""SELECT q.vec_id AS query_id, min({_DIST}) AS distance FROM embeddings q LEFT JOIN embeddings b ON q.label = b.label AND b.vec_id % 4 = 0 WHERE q.vec_id % 4 <> 0 GROUP BY 1""")
def nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = _bank(spark, sf_dir)
    return bank.nearest_distance(q.withColumnRenamed("vec_id", "query_id"), b.withColumnRenamed("vec_id", "point_id"))


@query(f"""SELECT q.vec_id AS query_id, min({_DIST}) AS distance FROM embeddings q JOIN embeddings b ON q.label = b.label AND b.vec_id % 4 = 0 WHERE q.vec_id % 4 <> 0 GROUP BY 1""")
def nn_distance_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = _bank(spark, sf_dir)
    key = F.col("sku").cast("string").alias("k")
    found = neighbours.nearest(q.select(F.col("vec_id").alias("row"), key, "embedding"), b.select(key, "embedding"))
    return found.select(F.col("row").alias("query_id"), "distance")


CROSS = f"""x AS (
  SELECT b.label AS bank_sku, q.label AS sku, q.vec_id, min({_DIST}) AS distance, q.label = b.label AS own FROM embeddings q, embeddings b WHERE b.vec_id % 4 = 0 AND q.vec_id % 4 <> 0 GROUP BY ALL)"""


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = _bank(spark, sf_dir)
    return evaluate.cross_scores(b.select(F.col("sku").alias("bank_sku"), "embedding"), q.withColumnRenamed("vec_id", "query_id"))


@query(f"""WITH {CROSS}, r AS (SELECT *, rank() OVER (PARTITION BY bank_sku ORDER BY distance) + (count(*) OVER (PARTITION BY bank_sku, distance) - 1) / 2.0::DOUBLE AS rk FROM x)
SELECT bank_sku, count(*) FILTER (NOT own) AS n_pos, count(*) FILTER (own) AS n_neg,
  CASE WHEN count(*) FILTER (NOT own) > 0 AND count(*) FILTER (own) > 0 THEN (2 * sum(rk) FILTER (NOT own) - count(*) FILTER (NOT own) * (count(*) FILTER (NOT own) + 1)) / (2.0::DOUBLE * count(*) FILTER (NOT own) * count(*) FILTER (own)) END AS auroc
FROM r GROUP BY 1""")
def auroc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auroc_matrix(_cross(spark, sf_dir))


@query(f"""WITH {v.LABELLED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS rk FROM v_labelled)
SELECT lang, count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic <> 1) AS n_neg,
  CASE WHEN count(*) FILTER (toxic = 1) > 0 AND count(*) FILTER (toxic <> 1) > 0 THEN (2 * sum(rk) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1)) / (2.0::DOUBLE * count(*) FILTER (toxic = 1) * count(*) FILTER (toxic <> 1)) END AS auroc
FROM r GROUP BY 1""")
def auroc_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.auroc(v.labelled(spark, sf_dir), ["lang"], "score", F.col("toxic") == 1)


@query("""WITH e AS (SELECT label AS sku, vec_id, md5('0:' || vec_id) AS m FROM embeddings)
SELECT sku, vec_id, place FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY m, vec_id) AS place FROM e) WHERE place <= 20""")
def random_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.sample(v.patches(spark, sf_dir).select("sku", "vec_id"), ["sku"], "vec_id", 20)


@query("""WITH e AS (SELECT label AS sku, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS "at", count(*) OVER (PARTITION BY label) AS total FROM embeddings)
SELECT sku, vec_id FROM e WHERE list_contains(list_transform(range(0, 7), lambda i: round_even(i * (total - 1) / 6::DOUBLE, 0)::BIGINT), "at")""")
def even_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.evenly_spaced(v.patches(spark, sf_dir).select("sku", "vec_id"), ["sku"], "vec_id", 7)


@query()
def kcenter_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.greedy_coreset(v.patches(spark, sf_dir).withColumnRenamed("vec_id", "point_id"), 0.1).drop("embedding")


@query()
def projected_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.patches(spark, sf_dir).withColumn("sku", F.col("sku").cast("string"))
    m = bank.projection(spark, "all", 64, 16).drop("sku")
    return bank.project(p, p.select("sku").distinct().crossJoin(F.broadcast(m)))


GRID = "g AS (SELECT label AS sku, vec_id // 16 AS tile, (vec_id % 16 // 4)::INT AS gy, (vec_id % 4)::INT AS gx, embedding FROM (SELECT 0 AS label, vec_id, embedding FROM embeddings))"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.patches(spark, sf_dir).select(F.lit("0").alias("sku"), F.expr("vec_id div 16").alias("tile"), F.expr("vec_id % 16 div 4").cast("int").alias("gy"), (F.col("vec_id") % 4).cast("int").alias("gx"), "embedding")


@query(f"""WITH {GRID}, s AS (SELECT tile, max(gy) AS my, max(gx) AS mx FROM g GROUP BY 1),
o AS (SELECT tile, gy + dy AS gy, gx + dx AS gx, unnest(embedding) AS v, unnest(range(0, 64)) AS d FROM g, (VALUES (-1), (0), (1)) a (dy), (VALUES (-1), (0), (1)) b (dx))
SELECT o.tile, o.gy, o.gx, d::INT AS d, (sum(v::DOUBLE) / 9)::FLOAT::DOUBLE AS v FROM o JOIN s ON o.tile = s.tile AND gy BETWEEN 0 AND my AND gx BETWEEN 0 AND mx GROUP BY ALL""")
def pooled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bank.pooled(_grid(spark, sf_dir)).drop("sku")
    return p.select("tile", "gy", "gx", F.posexplode("embedding").alias("d", "v")).withColumn("v", F.col("v").cast("double"))


@query()
def bank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    m = bank.projection(spark, "0", 64, 16)
    points = bank.fit_banks(g.filter("tile % 2 = 0"), m, 0.25)
    return bank.score_grids(g.filter("tile % 2 = 1"), m, points)


# --- evaluation ----------------------------------------------------------------------------------------------------


@query(f"""WITH {CROSS} SELECT bank_sku, round(avg(distance) FILTER (NOT own) / max(distance) FILTER (own), 9) AS over_max_clean,
  round(avg(distance) FILTER (NOT own) / avg(distance) FILTER (own), 9) AS over_mean_clean FROM x GROUP BY 1""")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.separation(_cross(spark, sf_dir), ["bank_sku"], "distance", ~F.col("own"))
    return found.select("bank_sku", *[F.round(c, 9).alias(c) for c in ("over_max_clean", "over_mean_clean")])


IMAGES = "i AS (SELECT lang AS code, doc_id AS image, toxic = 0 AS clean FROM labels JOIN documents USING (doc_id))"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.labelled(spark, sf_dir).select(F.col("lang").alias("code"), F.col("doc_id").alias("image"), (F.col("toxic") == 0).alias("clean"))


@query(f"""WITH {IMAGES}, n AS (SELECT code AS fold, count(*)::BIGINT AS n_normal FROM i WHERE clean GROUP BY 1)
SELECT fold, n_normal, count(*)::BIGINT AS n_defective FROM n JOIN i ON fold <> code AND NOT clean GROUP BY ALL""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leave_one_out(_images(spark, sf_dir))


@query(f"""WITH {IMAGES} SELECT code, count(*) FILTER (clean) AS n_fit, count(*) FILTER (NOT clean) AS n_defective, count(*) FILTER (clean) >= 30 AND count(*) FILTER (NOT clean) >= 5 AS usable FROM i GROUP BY 1""")
def usable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.usable(_images(spark, sf_dir).withColumn("defective", ~F.col("clean")), ["code"])


@query(f"""WITH {IMAGES}, r AS (SELECT code, image, row_number() OVER (PARTITION BY code ORDER BY image) AS k, count(*) OVER (PARTITION BY code) AS n FROM i WHERE NOT clean)
SELECT code, image, CASE WHEN k <= n // 2 THEN 'fit' ELSE 'test' END AS half FROM r WHERE n >= 4""")
def half_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.half_split(_images(spark, sf_dir).filter("NOT clean").drop("clean"), "code", "image")


RESULTS = "res AS (SELECT l_linenumber AS point, l_returnflag AS method, l_quantity AS value FROM lineitem)"


@query(f"""WITH {RESULTS}, m AS (SELECT point, avg(value) AS mean, stddev_pop(value) AS sd, count(*)::BIGINT AS n FROM res GROUP BY 1)
SELECT point, round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(mean - lag(mean) OVER (ORDER BY point), 6) AS step,
  round((mean - first_value(mean) OVER w) / (last_value(mean) OVER w - first_value(mean) OVER w), 6) + 0 AS captured FROM m
WINDOW w AS (ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = v.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("point"), F.col("l_quantity").alias("value"))
    return evaluate.sweep(li, "point", "value").select("point", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "step", "captured")])


@query(f"""WITH {RESULTS} SELECT point, avg(value) FILTER (method = 'A') AS A, avg(value) FILTER (method = 'R') AS R, avg(value) FILTER (method = 'A') - avg(value) FILTER (method = 'R') AS gap FROM res GROUP BY 1""")
def method_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = v.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("point"), F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("value"))
    return evaluate.by_method(li, "point", "method", "value", ["A", "R"])


@query("SELECT avg(l_quantity) FILTER (l_linestatus = 'F') AS own, avg(l_quantity) FILTER (l_linestatus <> 'F') AS unseen, avg(l_quantity) FILTER (l_linestatus = 'F') - avg(l_quantity) FILTER (l_linestatus <> 'F') AS cost FROM lineitem")
def transfer_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.transfer_cost(v.table(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "F").alias("own"), F.col("l_quantity").alias("value")))


@query(f"""WITH {v.EVENTS}, {v.ROLLS}, n AS (SELECT sku, roll_id, count(*) FILTER (status = 'rejected') AS fp FROM v_events GROUP BY 1, 2)
SELECT sku, roll_id, length_m, width_m, coalesce(fp, 0)::BIGINT AS false_positives, coalesce(fp, 0) * 100 / length_m AS per_100m FROM v_rolls LEFT JOIN n USING (sku, roll_id)""")
def false_positives_per_100m(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = v.events(spark, sf_dir, ("sku", "roll_id", "status")).withColumn("hit", F.col("status") != "rejected")
    return evaluate.false_positives_per_100m(hits, v.rolls(spark, sf_dir), ROLL)


# --- tiles, cells, components --------------------------------------------------------------------------------------

AXES = "list_distinct(list_concat(range(0, {n} - 256 + 1, 224), [{n} - 256]))"
TILES = f"""{v.TILE_FRAMES},
t AS (SELECT roll_id, h, w, unnest(list_sort({AXES.format(n="h")})) AS y FROM v_tiles),
u AS (SELECT roll_id, h, w, y, unnest(list_sort({AXES.format(n="w")})) AS x FROM t),
tiles AS (SELECT roll_id, h, w, 256 AS size, (row_number() OVER (PARTITION BY roll_id ORDER BY y, x) - 1)::INT AS tile_index, x::INT AS x, y::INT AS y FROM u)"""


@query(f"WITH {TILES} SELECT * FROM tiles")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tile_grid(tiles.dealt(v.tile_frames(spark, sf_dir)), 256, 32)


@query(f"WITH {TILES} SELECT roll_id, h, w, tile_index, x, y FROM tiles")
def tile_grid_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql(spark)
    f = v.tile_frames(spark, sf_dir)
    # Python lays out each shape of frame once
    laid = stage(spark.sql("SELECT * FROM tiles_of(TABLE(SELECT DISTINCT h, w FROM {f}), 256, 32)", f=f), "shapes")
    return tiles.dealt(f).join(sized(laid), ["h", "w"]).select("roll_id", "h", "w", "tile_index", "x", "y")


@query(f"WITH {TILES}, n AS (SELECT roll_id, h, w, count(*)::INT AS n_tiles FROM tiles GROUP BY ALL) SELECT roll_id, h, w, n_tiles, h * 0.2::DOUBLE / 1000::DOUBLE / n_tiles AS metres_per_tile FROM n")
def tile_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.metres_per_tile(v.tile_frames(spark, sf_dir), F.lit(0.2), 256, 32)


@query(f"WITH {TILES} SELECT * FROM tiles WHERE tile_index < 6")
def first_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first tiles of a roll are among the first of its frames
    found = tiles.tile_grid(tiles.dealt(v.tile_frames(spark, sf_dir), "roll_id"), 256, 32, most=6)
    return tiles.first_tiles(found.withColumn("frame_index", F.lit(0)), 6).drop("frame_index")


PATCHES = """pt AS (SELECT l_suppkey % 10 AS roll_id, l_linenumber::BIGINT AS frame_index, l_partkey % 4 AS tile_index, l_quantity::BIGINT - 1 AS y, l_orderkey % 50 AS x, max(l_discount) AS score FROM lineitem GROUP BY ALL)"""


def _patch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = v.table(spark, sf_dir, "lineitem")
    p = li.select((F.col("l_suppkey") % 10).alias("roll_id"), F.col("l_linenumber").cast("long").alias("frame_index"), (F.col("l_partkey") % 4).alias("tile_index"), (F.col("l_quantity").cast("long") - 1).alias("y"), (F.col("l_orderkey") % 50).alias("x"), F.col("l_discount").alias("score"))
    return p.groupBy("roll_id", "frame_index", "tile_index", "y", "x").agg(F.max("score").alias("score"))


@query(f"WITH {PATCHES} SELECT roll_id, frame_index, y, x, max(score) AS score FROM pt GROUP BY ALL")
def mosaic_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.mosaic(_patch_cells(spark, sf_dir), "max")


@query(f"WITH {PATCHES} SELECT roll_id, frame_index, y, x, arg_max(score, tile_index) AS score FROM pt GROUP BY ALL")
def mosaic_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.mosaic(_patch_cells(spark, sf_dir), "last")


@query(f"WITH {PATCHES} SELECT roll_id, frame_index, tile_index, max(score) AS score FROM pt GROUP BY ALL")
def tile_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tile_maxima(_patch_cells(spark, sf_dir))


FOOT = """ft AS (SELECT roll_id, frame_index, k AS tile_index, (k % 3) * 16 AS tx, (k // 3) * 16 AS ty, 18 AS size FROM (SELECT DISTINCT roll_id, frame_index FROM v_cells), range(0, 9) r (k))"""


def _footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.cells(spark, sf_dir).select("roll_id", "frame_index").distinct()
    return f.withColumn("tile_index", F.explode(F.sequence(F.lit(0), F.lit(8)))).selectExpr("roll_id", "frame_index", "tile_index", "(tile_index % 3) * 16 AS x", "(tile_index div 3) * 16 AS y", "18 AS size")


@query(f"""WITH {v.CELLS}, {FOOT} SELECT c.roll_id, c.frame_index, tile_index::INT AS tile_index, max(score) AS score, false AS single_tile FROM ft f JOIN v_cells c ON f.roll_id = c.roll_id AND f.frame_index = c.frame_index
AND x BETWEEN tx AND tx + 17 AND y BETWEEN ty AND ty + 17 GROUP BY ALL""")
def footprint_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.footprint_maxima(_footprints(spark, sf_dir), v.cells(spark, sf_dir), 16)


@query(f"""WITH {v.CELLS}, {FOOT} SELECT DISTINCT f.roll_id, f.frame_index, tile_index::INT AS tile_index, tx::INT AS x, ty::INT AS y FROM ft f JOIN v_cells c ON f.roll_id = c.roll_id AND f.frame_index = c.frame_index
AND x BETWEEN tx AND tx + 17 AND y BETWEEN ty AND ty + 17 AND score >= 0.1""")
def defective_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = v.cells(spark, sf_dir).filter("score >= 0.1")
    return tiles.defective_tiles(_footprints(spark, sf_dir), mask, 16).select("roll_id", "frame_index", "tile_index", F.col("x").cast("int"), F.col("y").cast("int"))


@query(f"WITH {v.CELLS} SELECT roll_id, frame_index, x - 10 AS x, y - 5 AS y, score FROM v_cells WHERE x >= 10 AND x < 40 AND y >= 5 AND y < 35")
def roi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.roi_cells(v.cells(spark, sf_dir), 10, 5, 30, 30)


@query(f"WITH {v.CELLS} SELECT * FROM v_cells WHERE x % 4 = 0 AND y % 4 = 0")
def strided_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.strided_cells(v.cells(spark, sf_dir), 4)


@query(f"""WITH {v.CELLS}, s AS (SELECT *, min(score) OVER f AS lo, max(score) OVER f AS hi FROM v_cells WINDOW f AS (PARTITION BY roll_id, frame_index))
SELECT roll_id, frame_index, y, x, score, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0::DOUBLE END AS shown FROM s""")
def display_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.display(v.cells(spark, sf_dir))


RUNS = f"""{v.CELLS}, hot AS (SELECT *, x - row_number() OVER (PARTITION BY roll_id, frame_index, y ORDER BY x) AS island FROM v_cells WHERE score > 0.08),
runs AS (SELECT roll_id, frame_index, y, min(x) AS x0, max(x) AS x1 FROM hot GROUP BY roll_id, frame_index, y, island)"""
LABELS = f"""{RUNS}, id AS (SELECT *, y * 1000 + x0 AS id FROM runs),
adj AS (SELECT a.roll_id, a.frame_index, a.id AS a, b.id AS b FROM id a JOIN id b ON a.roll_id = b.roll_id AND a.frame_index = b.frame_index AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
reach AS (SELECT roll_id, frame_index, id, id AS label FROM id UNION SELECT r.roll_id, r.frame_index, adj.b, r.label FROM reach r JOIN adj ON r.roll_id = adj.roll_id AND r.frame_index = adj.frame_index AND r.id = adj.a WHERE r.label < adj.b),
lab AS (SELECT roll_id, frame_index, id, min(label) AS label FROM reach GROUP BY ALL),
cc AS (SELECT c.*, l.label FROM id r JOIN lab l USING (roll_id, frame_index, id) JOIN v_cells c ON c.roll_id = r.roll_id AND c.frame_index = r.frame_index AND c.y = r.y AND c.x BETWEEN r.x0 AND r.x1),
stats AS (SELECT roll_id, frame_index, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*)::BIGINT AS area, max(score) AS max_score FROM cc GROUP BY ALL)"""


def _components(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = stage(v.cells(spark, sf_dir), "cells")
    labelled = components.label_runs(components.runs(c, 0.08))
    return c, labelled, stage(components.component_stats(c, labelled, min_area=2), "stats")


@query(f"WITH {RUNS} SELECT * FROM runs")
def score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.runs(v.cells(spark, sf_dir), 0.08)


@query(f"WITH RECURSIVE {LABELS} SELECT * FROM stats WHERE area >= 2")
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _components(spark, sf_dir)[2]
    return s.withColumn("label", F.col("component.y") * 1000 + F.col("component.x0")).drop("component", "mean_score")


@query(f"""WITH RECURSIVE {LABELS}, fl AS (SELECT s.roll_id, s.frame_index, s.label, min(c.score) AS lo FROM stats s JOIN v_cells c ON s.roll_id = c.roll_id AND s.frame_index = c.frame_index AND c.y BETWEEN s.y0 AND s.y1 AND c.x BETWEEN s.x0 AND s.x1 GROUP BY ALL),
ext AS (SELECT s.roll_id, s.frame_index, s.label, min(cc.x) AS ex0, min(cc.y) AS ey0, max(cc.x) AS ex1, max(cc.y) AS ey1 FROM stats s JOIN fl USING (roll_id, frame_index, label) JOIN cc ON s.roll_id = cc.roll_id AND s.frame_index = cc.frame_index AND s.label = cc.label AND cc.score >= lo + 0.5::DOUBLE * (s.max_score - lo) GROUP BY ALL)
SELECT s.roll_id, s.frame_index, label, area, max_score, s.frame_index * 1000 + ey0 * 0.5::DOUBLE AS along_mm, ex0 * 0.5::DOUBLE AS across_mm, (ey1 - ey0 + 1) * 0.5::DOUBLE AS length_mm, (ex1 - ex0 + 1) * 0.5::DOUBLE AS width_mm
FROM stats s JOIN ext USING (roll_id, frame_index, label) WHERE area >= 2""")
def component_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, labelled, stats = _components(spark, sf_dir)
    geometry = stats.select("roll_id", "frame_index").distinct().select("*", (F.col("frame_index") * 1000.0).alias("along_mm"), F.lit(0.5).alias("mm_per_px"))
    d = components.detections(components.extents(c, labelled, stats), stats, geometry)
    return d.withColumn("label", F.col("component.y") * 1000 + F.col("component.x0")).drop("component", "mean_score")


@query(f"""WITH RECURSIVE {LABELS}, m AS (SELECT * FROM v_cells WHERE score >= 0.1 AND (x + y) % 3 = 0)
SELECT s.roll_id, s.frame_index, label, count(m.x) > 0 AS hit FROM stats s LEFT JOIN m ON s.roll_id = m.roll_id AND s.frame_index = m.frame_index AND m.x BETWEEN x0 AND x1 AND m.y BETWEEN y0 AND y1 WHERE area >= 2 GROUP BY ALL""")
def detection_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, stats = _components(spark, sf_dir)
    hits = tiles.detection_hits(stats, c.filter("score >= 0.1 AND (x + y) % 3 = 0"))
    return hits.select("roll_id", "frame_index", (F.col("component.y") * 1000 + F.col("component.x0")).alias("label"), "hit")


# --- events --------------------------------------------------------------------------------------------------------

DET = f"{v.EVENTS}, d AS (SELECT sku, roll_id, frame_index, event_id AS detection_id, along_start_mm AS along_mm, across_start_mm AS across_mm, length_mm, width_mm, max_score, assertion FROM v_events)"


BOXES = f"""{v.EVENTS}, det AS (
  SELECT sku, roll_id, frame_index, event_id AS id, along_start_mm AS a0, along_start_mm + length_mm AS a1, across_start_mm AS c0, across_start_mm + width_mm AS c1, length_mm AS h, width_mm AS w FROM v_events)"""


@query(f"""WITH {BOXES}, p AS (
  SELECT a.roll_id, a.id AS a, b.id AS b, least(a.a1, b.a1) - greatest(a.a0, b.a0) AS along, greatest(0, least(a.c1, b.c1) - greatest(a.c0, b.c0)) AS across, a.h * a.w + b.h * b.w AS area, least(a.w, b.w) AS narrow
  FROM det a JOIN det b ON a.roll_id = b.roll_id AND b.frame_index > a.frame_index AND b.frame_index <= a.frame_index + 3)
SELECT roll_id, a, b FROM p
WHERE greatest(0, along) * across >= (0.3::DOUBLE - 1e-9) * (area - greatest(0, along) * across) OR (across >= (0.3::DOUBLE - 1e-9) * narrow AND -along <= 50 + 1e-9::DOUBLE)""")
def track_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.detections(spark, sf_dir).withColumn("_id", F.col("detection_id"))
    return track.partners(d, 0.3, 50.0, 2).select("roll_id", "a", "b")


@query(f"""WITH {BOXES}, f AS (SELECT DISTINCT sku, roll_id, frame_index FROM det),
g AS (SELECT *, frame_index - lag(frame_index) OVER w AS before, lead(frame_index) OVER w - frame_index AS after FROM f WINDOW w AS (PARTITION BY roll_id ORDER BY frame_index)),
s AS (SELECT sku, roll_id, frame_index, (sum(CASE WHEN before <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY roll_id ORDER BY frame_index) - 1)::BIGINT AS segment,
        coalesce(before > 3, true) AND coalesce(after > 3, true) AS lone FROM g)
SELECT roll_id, frame_index, id AS detection_id, segment, lone FROM det JOIN s USING (sku, roll_id, frame_index)""")
def roll_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.segments(v.detections(spark, sf_dir)).select("roll_id", "frame_index", "detection_id", "segment", "lone")


@query()
def tracked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.summarise(track.track(v.detections(spark, sf_dir), blocks=True), ("_block",))


@query(f"WITH {DET} SELECT *, row_number() OVER (PARTITION BY sku, roll_id ORDER BY frame_index, detection_id) AS event_id FROM d")
def per_detection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.track(v.detections(spark, sf_dir), iou_threshold=0.0)


@query(f"""WITH {DET}, l AS (SELECT sku, roll_id, floor(across_mm / 100)::BIGINT AS lane, detection_id, along_mm, along_mm + length_mm AS end_mm, max_score FROM d),
m AS (SELECT *, max(end_mm) OVER (PARTITION BY sku, roll_id, lane ORDER BY along_mm, end_mm, detection_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
r AS (SELECT *, sum(coalesce((along_mm - reach > 50)::INT, 0)) OVER (PARTITION BY sku, roll_id, lane ORDER BY along_mm, end_mm, detection_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM m)
SELECT sku, roll_id, lane, run, min(along_mm) AS along_start_mm, max(end_mm) AS along_end_mm, max(max_score) AS max_score, count(*)::BIGINT AS n_detections FROM r GROUP BY ALL""")
def lane_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.lane_runs(v.detections(spark, sf_dir, ("sku", "roll_id", "along_mm", "across_mm", "length_mm", "max_score")))


@query(f"""WITH {DET}, s AS (SELECT *, (detection_id % 5)::BIGINT AS event_id FROM d)
SELECT sku, roll_id, event_id, min(along_mm) AS along_start_mm, max(along_mm + length_mm) AS along_end_mm, min(across_mm) AS across_start_mm, max(across_mm + width_mm) AS across_end_mm, max(max_score) AS max_score,
  count(DISTINCT frame_index)::BIGINT AS n_frames, arg_max(detection_id, (max_score, -detection_id)) AS best_detection, CASE WHEN bool_or(assertion = 'asserted') THEN 'asserted' ELSE 'uncertain' END AS assertion FROM s GROUP BY ALL""")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.summarise(v.detections(spark, sf_dir).withColumn("event_id", F.col("detection_id") % 5))


@query(f"""WITH {v.DECISIONS}, {v.ROLLS}, l AS (SELECT roll_id, event_id, arg_max(status, ("at", decision_id)) AS status FROM v_decisions GROUP BY 1, 2),
n AS (SELECT e.roll_id, count(*) FILTER (l.status = 'rejected') AS false_alarms, count(*)::BIGINT AS events FROM v_events e LEFT JOIN l USING (roll_id, event_id) GROUP BY 1)
SELECT roll_id, length_m, coalesce(false_alarms, 0)::BIGINT AS false_alarms, coalesce(events, 0)::BIGINT AS events, coalesce(false_alarms, 0) * 100 / length_m AS fa_per_100m, 20::DOUBLE AS budget, coalesce(false_alarms, 0) * 100 / length_m > 20 AS over_budget FROM v_rolls LEFT JOIN n USING (roll_id)""")
def realised_false_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.realised_false_alarms(v.events(spark, sf_dir, ("roll_id", "event_id")), v.decisions(spark, sf_dir), v.rolls(spark, sf_dir).select("roll_id", "length_m"), 20.0)


@query(f"""WITH {v.DECISIONS} SELECT roll_id, event_id, arg_max(status, ("at", decision_id)) AS status, arg_max(operator, ("at", decision_id)) AS operator, max("at") AS "at" FROM v_decisions GROUP BY 1, 2""")
def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latest_decisions(v.decisions(spark, sf_dir))


@query("""WITH t AS (SELECT l_tax AS geometry, l_quantity AS preprocess, l_discount AS backbone FROM lineitem), u AS (UNPIVOT (SELECT *, geometry + preprocess + backbone AS total FROM t) ON geometry, preprocess, backbone, total INTO NAME stage VALUE ms)
SELECT stage, median(ms) AS median_ms, count(*)::BIGINT AS frames, 2::INT AS stride FROM u GROUP BY 1""")
def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("geometry"), F.col("l_quantity").alias("preprocess"), F.col("l_discount").alias("backbone"))
    return report.latency_table(t, ["geometry", "preprocess", "backbone"], 2)


@query("SELECT o_orderkey AS roll_id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS finished_at FROM orders ORDER BY coalesce(finished_at, started_at) DESC, roll_id DESC LIMIT 50")
def latest_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("roll_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("finished_at"))
    return report.latest_rolls(o, 50)


@query(f"WITH {v.EVENTS} SELECT event_id, along_start_mm, length_mm, status FROM v_events WHERE roll_id = 7 AND status = 'confirmed'")
def confirmed_events_of_a_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.roll_events(v.events(spark, sf_dir), 7, "confirmed").select("event_id", "along_start_mm", "length_mm", "status")


@query(f"WITH {v.EVENTS}, r AS (SELECT roll_id, event_id, along_start_mm, row_number() OVER (PARTITION BY roll_id ORDER BY along_start_mm DESC, event_id DESC) AS place FROM v_events) SELECT * FROM r WHERE place <= 5")
def furthest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_by_position(v.events(spark, sf_dir, ("roll_id", "event_id", "along_start_mm")), 5)


@query(f"WITH {DET}, r AS (SELECT sku, roll_id, frame_index, detection_id, dense_rank() OVER (PARTITION BY roll_id ORDER BY frame_index) AS nth FROM d) SELECT * FROM r WHERE nth <= 3")
def evidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.evidence(v.detections(spark, sf_dir).select("sku", "roll_id", "frame_index", "detection_id"), 3)


@query(f"""WITH {v.EVENTS} SELECT roll_id, event_id, greatest(0, floor(across_start_mm)::INT - 16) AS x0, greatest(0, 100 - 16) AS y0, least(1600, floor(across_start_mm)::INT + floor(width_mm)::INT + 16) AS x1, least(1080, 100 + floor(length_mm)::INT + 16) AS y1 FROM v_events""")
def evidence_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir, ("roll_id", "event_id", "across_start_mm", "width_mm", "length_mm"))
    i = lambda c: F.floor(c).cast("int")
    return e.select("roll_id", "event_id", grading.evidence_box(i("across_start_mm"), F.lit(100), i("width_mm"), i("length_mm"), 16, F.lit(1600), F.lit(1080)).alias("b")).select("roll_id", "event_id", "b.*")


@query(f"""WITH {v.EVENTS} SELECT roll_id, event_id, CASE WHEN width_mm >= length_mm THEN width_mm ELSE length_mm END AS machine_mm, (256::DOUBLE / 20 * 3 + 2 * 4::DOUBLE) * 0.2::DOUBLE AS resolution_mm,
  CASE WHEN width_mm >= length_mm THEN width_mm ELSE length_mm END <= (256::DOUBLE / 20 * 3 + 2 * 4::DOUBLE) * 0.2::DOUBLE AS unresolved FROM v_events""")
def machine_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir, ("roll_id", "event_id", "width_mm", "length_mm"))
    m = grading.machine_length(F.col("width_mm"), F.col("length_mm"), F.col("width_mm"), F.col("length_mm"))
    r = grading.resolution_mm(F.lit(256.0), F.lit(20), F.lit(3), F.lit(4.0), F.lit(0.2))
    return e.select("roll_id", "event_id", m.alias("machine_mm"), r.alias("resolution_mm"), (m <= r).alias("unresolved"))


BOX = "along_start_mm, along_start_mm + length_mm, across_start_mm, across_start_mm + width_mm"


@query(f"""WITH {v.EVENTS}, p AS (SELECT *, lead(along_start_mm) OVER w AS a2, lead(length_mm) OVER w AS l2, lead(across_start_mm) OVER w AS c2, lead(width_mm) OVER w AS w2 FROM v_events WINDOW w AS (PARTITION BY roll_id ORDER BY event_id)),
o AS (SELECT *, greatest(0::DOUBLE, least(along_start_mm + length_mm, a2 + l2) - greatest(along_start_mm, a2)) AS oa, greatest(0::DOUBLE, least(across_start_mm + width_mm, c2 + w2) - greatest(across_start_mm, c2)) AS oc FROM p WHERE a2 IS NOT NULL)
SELECT roll_id, event_id, oa * oc / ((along_start_mm + length_mm - along_start_mm) * (across_start_mm + width_mm - across_start_mm) + (a2 + l2 - a2) * (c2 + w2 - c2) - oa * oc) AS iou,
  oc / least(across_start_mm + width_mm - across_start_mm, c2 + w2 - c2) >= 0.3::DOUBLE AND greatest(along_start_mm, a2) - least(along_start_mm + length_mm, a2 + l2) <= 50 AS continues FROM o""")
def neighbour_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir, ("roll_id", "event_id", "along_start_mm", "length_mm", "across_start_mm", "width_mm"))
    w = Window.partitionBy("roll_id").orderBy("event_id")
    e = e.select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("along_start_mm", "length_mm", "across_start_mm", "width_mm")]).filter("n_along_start_mm IS NOT NULL")
    box = lambda p: (F.col(f"{p}along_start_mm"), F.col(f"{p}along_start_mm") + F.col(f"{p}length_mm"), F.col(f"{p}across_start_mm"), F.col(f"{p}across_start_mm") + F.col(f"{p}width_mm"))
    return e.select("roll_id", "event_id", grading.iou(box(""), box("n_")).alias("iou"), grading.continues(box(""), box("n_")).alias("continues"))


# --- parameters ----------------------------------------------------------------------------------------------------

DEFAULTS = [("tiling", "size", "512"), ("tiling", "overlap", "64"), ("calibration", "margin", "10"), ("scoring", "hold_at", "20"), ("scoring", "reject_at", "40")]


@query(f"""WITH def (section, key, value) AS (VALUES {", ".join(map(str, DEFAULTS))}), s AS (SELECT DISTINCT l_partkey % 8 AS sku FROM lineitem),
o AS (SELECT DISTINCT l_partkey % 8 AS sku, 'tiling' AS section, 'size' AS key, '256' AS own FROM lineitem WHERE l_partkey % 8 < 3)
SELECT sku, section, key, coalesce(own, value) AS value, own IS NOT NULL AS overridden FROM s CROSS JOIN def LEFT JOIN o USING (sku, section, key)""")
def sku_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    skus = v.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 8).alias("sku")).distinct()
    own = skus.filter("sku < 3").select("sku", F.lit("tiling").alias("section"), F.lit("size").alias("key"), F.lit("256").alias("value"))
    return params.resolved(skus, spark.createDataFrame(DEFAULTS, "section string, key string, value string"), own)


# --- raster --------------------------------------------------------------------------------------------------------

FULL = """full_ AS (SELECT roll_id, frame_index, y, x, coalesce(score, 0) * 1000 AS value FROM (SELECT DISTINCT roll_id, frame_index FROM v_cells) f CROSS JOIN range(0, 50) a (y) CROSS JOIN range(0, 50) b (x) LEFT JOIN v_cells USING (roll_id, frame_index, y, x))"""


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.cells(spark, sf_dir)
    axis = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")))
    f = c.select("roll_id", "frame_index").distinct().withColumn("y", axis).withColumn("x", axis)
    return f.join(c.hint("merge"), ["roll_id", "frame_index", "y", "x"], "left").select("roll_id", "frame_index", "y", "x", (F.coalesce("score", F.lit(0.0)) * 1000).alias("value"))


LAP = "coalesce(lag(value) OVER r, lead(value) OVER r) + coalesce(lead(value) OVER r, lag(value) OVER r) + (coalesce(lag(value) OVER c, lead(value) OVER c) + coalesce(lead(value) OVER c, lag(value) OVER c)) - 4 * value"


@query(f"""WITH {v.CELLS}, {FULL}, l AS (SELECT roll_id, frame_index, value, {LAP} AS lap FROM full_ WINDOW r AS (PARTITION BY roll_id, frame_index, y ORDER BY x), c AS (PARTITION BY roll_id, frame_index, x ORDER BY y))
SELECT roll_id, frame_index, round(var_pop(lap), 3) AS focus, round(avg(value), 6) AS brightness FROM l GROUP BY 1, 2""")
def frame_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raster.sharpness(_full(spark, sf_dir))
    return s.select("roll_id", "frame_index", F.round("focus", 3).alias("focus"), F.round("brightness", 6).alias("brightness"))


def _blur_sql(source: str, n: int, sigma: float, radius: int) -> str:
    """Two passes of a Gaussian over full n x n grids of (roll_id, frame_index, y, x, value), borders mirrored: the last one is `blur`."""
    weights = ", ".join(f"({k - radius}, {w!r}::DOUBLE)" for k, w in enumerate(raster.kernel(sigma, radius)))
    fold = f"((i + k) % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2}"
    line = lambda table, axis, other: f"SELECT roll_id, frame_index, {other}, t.i AS {axis}, sum(w * value) AS value FROM {table} JOIN taps t ON {axis} = t.j GROUP BY ALL"
    return f"""w7 (k, w) AS (VALUES {weights}), taps AS (SELECT i, least({fold}, {2 * n - 2} - {fold}) AS j, w FROM range(0, {n}) r (i), w7),
  across AS ({line(source, "x", "y")}), blur AS ({line("across", "y", "x")})"""


@query(f"""WITH {v.CELLS}, {FULL}, {_blur_sql("full_", 50, 5.0, 2)}, f AS (SELECT roll_id, frame_index, y, x, u.value, u.value / greatest(1::DOUBLE, b.value) AS flat FROM full_ u JOIN blur b USING (roll_id, frame_index, y, x)),
s AS (SELECT *, flat * avg(value) OVER w / greatest(1e-6::DOUBLE, avg(flat) OVER w) AS scaled FROM f WINDOW w AS (PARTITION BY roll_id, frame_index))
SELECT roll_id, frame_index, y, x, trunc(round(greatest(0::DOUBLE, least(255::DOUBLE, scaled)), 9))::INT AS value FROM s""")
def flat_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.flat_field(_full(spark, sf_dir), sigma=5.0)


@query(f"""WITH {v.CELLS}, {FULL}, axis_at AS (SELECT i, greatest(0::DOUBLE, least(49::DOUBLE, (i + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)) AS p FROM range(0, 100) r (i)),
c AS (SELECT i, least(49, floor(p)::BIGINT + d) AS j, abs(1 - d - (p - floor(p))) AS part FROM axis_at, (VALUES (0), (1)) e (d)),
up AS (SELECT roll_id, frame_index, a.i AS y, b.i AS x, sum(a.part * b.part * value) AS value FROM full_ JOIN c a ON full_.y = a.j JOIN c b ON full_.x = b.j GROUP BY ALL),
{_blur_sql("up", 100, 1.0, 3)} SELECT roll_id, frame_index, y, x, round(value, 5) AS value FROM blur""")
def pixel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = raster.upsampled(_full(spark, sf_dir), 2, 1.0)
    return up.withColumn("value", F.round("value", 5))


@query(f"""WITH {v.CELLS}, m AS (SELECT roll_id * 100 + frame_index AS image, x, max(score) * 2000 AS mean FROM v_cells GROUP BY ALL),
i AS (SELECT *, x - row_number() OVER (PARTITION BY image ORDER BY x) AS island FROM m WHERE mean <= 190), r AS (SELECT image, island, min(x) AS x0, max(x) AS x1 FROM i GROUP BY ALL),
b AS (SELECT image, arg_max(x0, (x1 - x0, -x0)) AS x0, arg_max(x1, (x1 - x0, -x0)) AS x1 FROM r GROUP BY 1), f AS (SELECT image, min(x) AS f0, max(x) AS f1 FROM m GROUP BY 1)
SELECT image, CASE WHEN x0 IS NULL THEN f0 WHEN x1 - x0 > 2 THEN x0 + 1 ELSE x0 END AS x0, CASE WHEN x0 IS NULL THEN f1 WHEN x1 - x0 > 2 THEN x1 - 1 ELSE x1 END AS x1 FROM f LEFT JOIN b USING (image)""")
def fabric_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.cells(spark, sf_dir).groupBy((F.col("roll_id") * 100 + F.col("frame_index")).alias("image"), "x").agg((F.max("score") * 2000).alias("mean"))
    return raster.fabric_extent(c, 190.0, 1)


HASH = "('0x' || substr(md5({}), 1, 12))::BIGINT"


@query(f"""WITH {v.CELLS}, c AS (SELECT roll_id * 100 + frame_index AS image, y, x, score FROM v_cells),
m AS (SELECT image, y AS cy, x AS cx, row_number() OVER (PARTITION BY image ORDER BY {HASH.format("'0:cell:' || y || ':' || x")}, y, x) - 1 AS crop FROM c WHERE score >= 0.1),
k AS (SELECT DISTINCT image, unnest(range(0, 4))::INT AS crop FROM c),
j AS (SELECT image, k.crop, {HASH.format("'0:coin:' || image || ':' || k.crop")} / 281474976710656::DOUBLE < 0.5 AND cy IS NOT NULL AS on_defect, cy, cx FROM k LEFT JOIN m USING (image, crop))
SELECT image, crop, on_defect, (CASE WHEN on_defect THEN greatest(0, least(50 - 16, cy - 8)) ELSE floor({HASH.format("'0:y:' || image || ':' || crop")} / 281474976710656::DOUBLE * 35) END)::INT AS y,
  (CASE WHEN on_defect THEN greatest(0, least(50 - 16, cx - 8)) ELSE floor({HASH.format("'0:x:' || image || ':' || crop")} / 281474976710656::DOUBLE * 35) END)::INT AS x FROM j""")
def balanced_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.cells(spark, sf_dir).withColumn("image", F.col("roll_id") * 100 + F.col("frame_index"))
    images = c.select("image").distinct().select("image", F.lit(50).alias("h"), F.lit(50).alias("w"))
    return evaluate.balanced_crops(images, c.filter("score >= 0.1").select("image", "y", "x"), 4, 16)


@query(f"""WITH {v.CELLS}, {FULL} SELECT roll_id, frame_index, round(avg(value), 6) AS brightness FROM full_ WHERE y BETWEEN 10 AND 39 AND x BETWEEN 10 AND 39 GROUP BY 1, 2""")
def central_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.central(_full(spark, sf_dir)).groupBy("roll_id", "frame_index").agg(F.round(F.avg("value"), 6).alias("brightness"))


@query(f"""WITH {v.CELLS}, {FULL}, b AS (SELECT DISTINCT roll_id, frame_index, m AS marker_id, greatest(0, m * 15 + frame_index - 12) AS x0, 8 AS y0, least(50, m * 15 + frame_index + 24) AS x1, 42 AS y1 FROM v_cells, range(0, 3) r (m)),
c AS (SELECT f.*, marker_id FROM full_ f JOIN b ON f.roll_id = b.roll_id AND f.frame_index = b.frame_index AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 WHERE x1 - x0 > 8),
l AS (SELECT roll_id, frame_index, marker_id, {LAP} AS lap FROM c WINDOW r AS (PARTITION BY roll_id, frame_index, marker_id, y ORDER BY x), c AS (PARTITION BY roll_id, frame_index, marker_id, x ORDER BY y)),
v AS (SELECT roll_id, frame_index, marker_id, var_pop(lap) AS focus FROM l GROUP BY ALL)
SELECT roll_id, frame_index, round(median(focus), 3) AS marker_focus, count(*)::BIGINT AS markers FROM v GROUP BY 1, 2""")
def marker_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stage(_full(spark, sf_dir), "full")
    m = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("marker_id")
    boxes = c.select("roll_id", "frame_index").distinct().select("roll_id", "frame_index", m)
    x0 = F.col("marker_id") * 15 + F.col("frame_index")
    boxes = boxes.select("roll_id", "frame_index", "marker_id", x0.alias("x0"), F.lit(20).alias("y0"), (x0 + 12).alias("x1"), F.lit(30).alias("y1"))
    return raster.marker_sharpness(c, boxes).withColumn("marker_focus", F.round("marker_focus", 3))


# --- strips, listings, stored tables, phases -----------------------------------------------------------------------


@query(f"""WITH {GEOMETRY}, {v.SCORES}, {_threshold_sql(BUDGET)}
SELECT f.event_type AS sku, f.roll_id, f.frame_index, f.value AS peak, g.along_mm, threshold, 'frame maxima' AS what FROM v_frames f JOIN geometry g USING (roll_id, frame_index) JOIN cal ON cal.sku = f.event_type""")
def score_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir)
    peaks = f.select(F.col("event_type").alias("sku"), "roll_id", "frame_index", F.col("value").alias("peak"))
    return report.score_strip(peaks, positions.frame_geometry(f), conformal_threshold(spark, sf_dir))


@query(f"WITH {PATCHES} SELECT roll_id, frame_index, y, x, round(avg(score), 9) AS score FROM pt GROUP BY ALL")
def mosaic_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.mosaic(_patch_cells(spark, sf_dir), "mean").withColumn("score", F.round("score", 9))


@query("""WITH f AS (SELECT '/' || lang || '/Frame' || doc_id || '.png' AS path, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS raw_index FROM documents)
SELECT path, raw_index, raw_index // 3 AS frame_index, raw_index / 30::DOUBLE AS ts_s, 3::INT AS stride FROM f WHERE raw_index % 3 = 0""")
def natural_frame_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = v.table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "lang", F.lit("/Frame"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return images.strided(images.numbered(files), 3)


@query("""SELECT doc_id::INT AS number, CASE WHEN toxic = 1 THEN '007' ELSE '000' END AS defect, lpad((doc_id % 9)::VARCHAR, 2, '0') AS fabric, toxic <> 1 AS clean, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS masks FROM labels""")
def labelled_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    name = F.concat_ws("_", number, F.when(F.col("toxic") == 1, "007").otherwise("000"), F.lpad((F.col("doc_id") % 9).cast("string"), 2, "0"))
    lab = v.table(spark, sf_dir, "labels").select("doc_id", name.alias("name"))
    plain = lab.select(F.concat(F.lit("/images/"), "name", F.lit(".png")).alias("path"))
    masks = lab.filter("doc_id % 5 = 0").select(F.explode(F.array(*[F.concat(F.lit("/masks/"), "name", F.lit(f"_mask{i}.png")) for i in (1, 2)])).alias("path"))
    return images.labelled_images(plain.unionByName(masks)).select("number", "defect", "fabric", "clean", F.size("mask_paths").alias("masks"))


@query(f"""WITH {v.EVENTS}, w AS (SELECT roll_id, event_id % 10 AS event_id, event_id % 3 AS batch, max(event_id) AS line, arg_max(status, event_id) AS status FROM v_events GROUP BY 1, 2, 3)
SELECT roll_id, event_id, arg_max(line, batch) AS line, arg_max(status, batch) AS status FROM w GROUP BY 1, 2""")
def upserted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir, ("roll_id", "event_id", "status"))
    w = e.groupBy("roll_id", (F.col("event_id") % 10).alias("k"), (F.col("event_id") % 3).alias("batch")).agg(F.max("event_id").alias("line"), F.max_by("status", "event_id").alias("status"))
    w = stage(w.withColumnRenamed("k", "event_id"), "written")
    root = f"{shared_dir(spark)}/upserted-{uuid.uuid4().hex}"
    write = store.upsert_events(root)
    for batch in range(3):
        write(w.filter(F.col("batch") == batch).drop("batch"), batch)
    return store.read_table(spark, root)


@query(f"WITH {v.EVENTS} SELECT roll_id, event_id % 10 AS event_id, max(event_id) AS batch_id, arg_max(status, event_id) AS status FROM v_events GROUP BY 1, 2")
def current_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir, ("roll_id", "event_id", "status"))
    written = e.select("roll_id", (F.col("event_id") % 10).alias("event_id"), F.col("event_id").alias("batch_id"), "status")
    return store.current_events(written)


@query(f"WITH {v.FRAMES} SELECT roll_id, frame_index, CASE WHEN frame_index < 30 THEN 'learn' WHEN frame_index < 190 THEN 'calibrate' ELSE 'inspect' END AS phase FROM v_frames")
def frame_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.phases(v.frames(spark, sf_dir).select("roll_id", "frame_index"), 30, 160)


@query(f"""WITH {v.EVENTS} SELECT roll_id, count(*)::BIGINT AS events, count(*) FILTER (assertion = 'asserted') AS asserted, count(*) FILTER (status = 'rejected') AS rejected,
  sum(CASE WHEN {COUNTED} THEN {POINTS} ELSE 0 END)::BIGINT AS points FROM v_events GROUP BY 1""")
def running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.counters_live(v.events(spark, sf_dir, ("roll_id", "assertion", "status", "length_mm")))


# --- rolls with their calibration, extents, events alone -----------------------------------------------------------

POSITIONS = "pos AS (SELECT sku, along_start_mm AS score FROM v_events)"


def _position_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir, ("sku", "along_start_mm")).withColumnRenamed("along_start_mm", "score")
    return calibrate.conformal_threshold(e, ["sku"], BUDGET, METRES_PER_TILE)


@query(f"""WITH {v.EVENTS}, {POSITIONS}, {_threshold_sql(BUDGET, "pos")}, rolls AS (SELECT o_custkey % 8 AS sku, o_orderkey AS roll_id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS finished_at FROM orders)
SELECT * FROM (SELECT * FROM rolls ORDER BY coalesce(finished_at, started_at) DESC, roll_id DESC LIMIT 1) LEFT JOIN cal USING (sku)""")
def latest_roll_with_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("sku"), F.col("o_orderkey").alias("roll_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("finished_at"))
    return report.roll_with_calibration(o, stage(_position_calibrations(spark, sf_dir), "calibrations"))


@query(f"""WITH {v.EVENTS}, {POSITIONS}, {_threshold_sql(BUDGET, "pos")}
SELECT sku, roll_id, event_id, along_start_mm AS along_mm, max_score AS peak, threshold, 'events only' AS what FROM v_events JOIN cal USING (sku)""")
def event_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.event_strip(v.events(spark, sf_dir), _position_calibrations(spark, sf_dir))


@query(f"""WITH {v.EVENTS}, c AS (SELECT roll_id, event_id, along_start_mm, 'crops/' || event_id AS crop_path FROM v_events WHERE event_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY roll_id ORDER BY along_start_mm, event_id) AS nth FROM c) SELECT * FROM r WHERE nth <= 4""")
def evidence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir, ("roll_id", "event_id", "along_start_mm"))
    return report.evidence_events(e.withColumn("crop_path", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("crops/"), F.col("event_id").cast("string")))), 4)


@query(f"""WITH {GEOMETRY}, {v.EVENTS}, fr AS (SELECT roll_id, max(along_mm) AS f, count(*) FILTER (gap_warning) AS gap_warnings FROM geometry GROUP BY 1), ev AS (SELECT roll_id, max(along_start_mm) AS m FROM v_events GROUP BY 1)
SELECT roll_id, greatest(greatest(f, m) / 1000, 1e-6::DOUBLE) AS length_m, gap_warnings FROM fr LEFT JOIN ev USING (roll_id)""")
def roll_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return astm.roll_extents(v.events(spark, sf_dir, ("roll_id", "along_start_mm")), frame_geometry(spark, sf_dir), ["roll_id"])


@query(f"WITH {v.TILE_FRAMES} SELECT roll_id, h, w, (256 - 32) * 0.2::DOUBLE / 1000::DOUBLE AS metres_per_tile FROM v_tiles")
def stride_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.metres_per_tile(v.tile_frames(spark, sf_dir), F.lit(0.2), 256, 32, with_roi=False)


FITTED = "list_sort(list_distinct(list_concat(range(0, {n} - size + 1, size - 100), [{n} - size])))"


@query(f"""WITH {v.TILE_FRAMES}, s AS (SELECT *, least(900, h, w) AS size FROM v_tiles), t AS (SELECT *, unnest({FITTED.format(n="h")}) AS y FROM s), u AS (SELECT *, unnest({FITTED.format(n="w")}) AS x FROM t)
SELECT roll_id, h, w, size, (row_number() OVER (PARTITION BY roll_id ORDER BY y, x) - 1)::INT AS tile_index, x::INT AS x, y::INT AS y FROM u""")
def fitted_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tile_grid(v.tile_frames(spark, sf_dir), *tiles.fitted(900, 100))


@query(f"""WITH {PATCHES}, f AS (SELECT DISTINCT roll_id, frame_index FROM pt), m AS (SELECT roll_id, frame_index, y, x, max(score) AS score FROM pt GROUP BY ALL)
SELECT roll_id, frame_index, y, x, coalesce(score, 0) AS score FROM f CROSS JOIN range(0, 52) a (y) CROSS JOIN range(0, 51) b (x) LEFT JOIN m USING (roll_id, frame_index, y, x)""")
def filled_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stage(mosaic_max(spark, sf_dir), "mosaic")
    return tiles.filled(m, m.select("roll_id", "frame_index").distinct().select("*", F.lit(52).alias("h"), F.lit(51).alias("w")))


@query(f"""WITH {v.CELLS}, c AS (SELECT *, (x * 3 + y) % 7 = 0 AS "on" FROM v_cells)
SELECT roll_id, frame_index, arg_max("on", (score, -y, -x)) AS peak_inside, round(avg(score) FILTER ("on"), 9) AS mean_on, round(avg(score) FILTER (NOT "on"), 9) AS mean_off,
  round(avg(score) FILTER ("on") / greatest(avg(score) FILTER (NOT "on"), 1e-6::DOUBLE), 9) AS separation FROM c GROUP BY 1, 2 HAVING count(*) FILTER ("on") > 0""")
def peak_in_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.cells(spark, sf_dir)
    found = tiles.peak_in_mask(c, c.filter("(x * 3 + y) % 7 = 0"))
    return found.withColumns({n: F.round(n, 9) for n in ("mean_on", "mean_off", "separation")})


@query(f"""WITH RECURSIVE {LABELS} SELECT roll_id, frame_index, label, area, max_score, frame_index * 1000 + y0 * 0.5::DOUBLE AS along_mm, x0 * 0.5::DOUBLE AS across_mm, (y1 - y0 + 1) * 0.5::DOUBLE AS length_mm, (x1 - x0 + 1) * 0.5::DOUBLE AS width_mm
FROM stats WHERE area >= 2""")
def component_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, labelled, stats = _components(spark, sf_dir)
    geometry = stats.select("roll_id", "frame_index").distinct().select("*", (F.col("frame_index") * 1000.0).alias("along_mm"), F.lit(0.5).alias("mm_per_px"))
    d = components.detections(components.extents(c, labelled, stats, rule="threshold"), stats, geometry)
    return d.withColumn("label", F.col("component.y") * 1000 + F.col("component.x0")).drop("component", "mean_score")


@query(f"""WITH {v.FRAMES}, f AS (SELECT roll_id, (100 + frame_index % 3) / 1 / 40::DOUBLE AS ratio FROM v_frames WHERE marked),
g AS (SELECT roll_id, median(ratio) AS ratio, count(*)::BIGINT AS frames_of_two FROM f GROUP BY 1)
SELECT *, ratio / 2.5::DOUBLE - 1 AS ratio_error, 'y' AS tape_axis, CASE WHEN abs(ratio / 2.5::DOUBLE - 1) > 0.03 THEN 'pitch does not fit the markers' ELSE '' END AS problems FROM g""")
def tape_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir).filter("marked").select("roll_id", "frame_index", F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"))
    x, y = F.col("nth") * 5.0, F.col("nth") * (100.0 + F.col("frame_index") % 3)
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    corners = F.array(point(x, y), point(x + 40, y), point(x + 40, y + 40), point(x, y + 40))
    return positions.tape_ratio(f.select("roll_id", "frame_index", (F.col("frame_index") + F.col("nth")).alias("marker_id"), corners.alias("corners")), "roll_id")
