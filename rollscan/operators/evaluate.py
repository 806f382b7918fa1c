"""Evaluation of detectors on labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.operators.bank import distances_to_banks
from rollscan.operators.ranks import auroc


def cross_scores(bank: DataFrame, queries: DataFrame) -> DataFrame:
    """Every bank's scores of every fabric's queries: bank_sku, sku, query_id, distance, own (in distribution).
    bank: bank_sku, embedding; queries: sku, query_id, embedding. Batches of queries meet each bank in one product."""
    found = distances_to_banks(queries.select("sku", "query_id", "embedding"), bank.select(F.col("bank_sku").alias("sku"), "embedding"))
    return found.withColumn("own", F.col("bank_sku") == F.col("sku"))


def auroc_matrix(scores: DataFrame) -> DataFrame:
    """For each bank how well it tells its own sku's queries (normal) from the others (anomalous)."""
    return auroc(scores, ["bank_sku"], "distance", ~F.col("own"))


def separation(scores: DataFrame, keys: list[str], score: str, anomalous: Column) -> DataFrame:
    """Mean anomalous over largest clean, and mean anomalous over mean clean."""
    bad, good = F.avg(F.when(anomalous, F.col(score))), F.when(~anomalous, F.col(score))
    return scores.groupBy(*keys).agg((bad / F.max(good)).alias("over_max_clean"), (bad / F.avg(good)).alias("over_mean_clean"))


def leave_one_out(images: DataFrame) -> DataFrame:
    """Per code the number of its normal images and of every other code's defective ones; codes without normals, and codes with all
    the defective ones, make no fold. images: code, image, clean."""
    g = images.groupBy("code").agg(F.count_if("clean").alias("n_normal"), F.count_if(~F.col("clean")).alias("own"))
    everyone = Window.partitionBy()  # one row for each code
    g = g.withColumn("n_defective", F.sum("own").over(everyone) - F.col("own"))
    return g.filter("n_normal > 0 AND n_defective > 0").select(F.col("code").alias("fold"), "n_normal", "n_defective")


def disjoint(fit: DataFrame, calibration: DataFrame, keys: list[str]) -> DataFrame:
    """Calibration, refused where a row of it was fitted on."""
    both = fit.select(*keys).distinct().withColumn("fitted", F.lit(True))
    joined = calibration.join(both, keys, "left")
    checked = F.when(F.col("fitted"), F.raise_error(F.lit("fit and calibration share rows"))).otherwise(F.lit(True))
    return joined.filter(checked).drop("fitted")


def sweep(results: DataFrame, point: str, value: str) -> DataFrame:
    """Mean and population deviation over fabrics for each sweep point (not-a-numbers left out), step from the point before,
    and the share of the whole gain reached."""
    r = results.filter(~F.isnan(value)).groupBy(point).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count("*").alias("n"))
    w = Window.orderBy(point)  # one row for each sweep point
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("mean").over(whole), F.last("mean").over(whole)
    return r.withColumn("step", F.col("mean") - F.lag("mean").over(w)).withColumn("captured", F.when(last != first, (F.col("mean") - first) / (last - first)))


def by_method(results: DataFrame, point: str, method: str, value: str, methods: list[str]) -> DataFrame:
    """Means by sweep point and method side by side, and the first method's lead over the second."""
    p = results.groupBy(point).pivot(method, methods).agg(F.avg(value))
    return p.withColumn("gap", F.col(f"`{methods[0]}`") - F.col(f"`{methods[1]}`"))


def transfer_cost(matrix: DataFrame) -> DataFrame:
    """Mean score in distribution, on unseen fabrics, and what the change costs. matrix: own, value."""
    return matrix.agg(F.avg(F.when(F.col("own"), F.col("value"))).alias("own"), F.avg(F.when(~F.col("own"), F.col("value"))).alias("unseen")).withColumn("cost", F.col("own") - F.col("unseen"))


def false_positives_per_100m(hits: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Detections that meet no truth, per 100 m. hits: keys, hit; lengths: keys, length_m."""
    n = hits.groupBy(*keys).agg(F.count_if(~F.col("hit")).alias("false_positives"))
    out = lengths.join(n, keys, "left").withColumn("false_positives", F.coalesce("false_positives", F.lit(0)))
    return out.withColumn("per_100m", F.col("false_positives") * 100 / F.col("length_m"))


def usable(groups: DataFrame, keys: list[str], least_fit: int = 30, least_defective: int = 5) -> DataFrame:
    """Groups with enough fit and defective tiles; the others are reported with usable = false. groups: keys, defective."""
    g = groups.groupBy(*keys).agg(F.count_if(~F.col("defective")).alias("n_fit"), F.count_if("defective").alias("n_defective"))
    return g.withColumn("usable", (F.col("n_fit") >= least_fit) & (F.col("n_defective") >= least_defective))


def half_split(images: DataFrame, key: str, name: str, least: int = 4) -> DataFrame:
    """Each group's images halved in name order; groups under `least` are left out."""
    w = Window.partitionBy(key)
    r = images.withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy(name)))
    return r.filter(F.col("n") >= least).withColumn("half", F.when(F.col("at") <= F.expr("n div 2"), "fit").otherwise("test")).drop("n", "at")


def balanced_crops(images: DataFrame, mask: DataFrame, per_image: int, crop: int, seed: int = 0) -> DataFrame:
    """Crops of which about half are centred on a defect cell picked by hash, the rest anywhere; offsets are clamped.
    images: image, h, w; mask: image, y, x."""
    number = lambda what, *c: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{what}"), *[F.col(x).cast("string") for x in c])), 1, 12), 16, 10).cast("long")
    pick = lambda what, *c: number(what, *c) / F.lit(float(1 << 48))
    crops = images.select("image", "h", "w", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))).alias("crop"))
    w = Window.partitionBy("image").orderBy(number("cell", "y", "x"), "y", "x")
    chosen = mask.withColumn("crop", F.row_number().over(w) - 1).filter(F.col("crop") < per_image).select("image", "crop", F.col("y").alias("cy"), F.col("x").alias("cx"))
    c = crops.join(chosen.hint("merge"), ["image", "crop"], "left").withColumn("on_defect", (pick("coin", "image", "crop") < 0.5) & F.col("cy").isNotNull())
    at = lambda centre, size, what: F.when(F.col("on_defect"), F.greatest(F.lit(0), F.least(F.col(size) - crop, F.col(centre) - crop // 2))).otherwise(F.floor(pick(what, "image", "crop") * (F.col(size) - crop + 1)))
    return c.select("image", "crop", "on_defect", at("cy", "h", "y").cast("int").alias("y"), at("cx", "w", "x").cast("int").alias("x"))
