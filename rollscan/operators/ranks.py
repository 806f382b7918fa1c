"""Order statistics of groups of any size: quantile buckets in place of one window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.staging import sized, stage


def bucketed(df: DataFrame, keys: list[str], value: str, buckets: int = 64) -> DataFrame:
    """df with `bucket`: about equal parts of each group in order of value; equal values share one. The cut points are a
    sketch of each group, so the table joined has one row for each group."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("cuts"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cuts = stage(cuts.withColumnsRenamed({k: f"_{k}" for k in keys}), "cuts")
    joined = df.join(sized(cuts), on, "left")
    return joined.withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts", *[f"_{k}" for k in keys])


#: A group's sketch: quantiles at multiples of 1 / GRID, each off by 1 / ACCURACY of the group's rows at most.
GRID, ACCURACY = 500, 10_000


def sketched(df: DataFrame, keys: list[str], value: str, *aggs: Column) -> DataFrame:
    """keys, n (rows with a value), cuts (quantiles of the values as doubles; NaN has none and counts as largest) and aggs."""
    v = F.col(value).cast("double")
    cuts = F.percentile_approx(F.when(~F.isnan(v), v), [i / GRID for i in range(GRID + 1)], ACCURACY)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.isnan(v)).alias("nans"), cuts.alias("cuts"), *aggs)


def at_ranks(df: DataFrame, keys: list[str], value: str, groups: DataFrame, wanted: Column) -> DataFrame:
    """groups (from sketched()) with `found`: the values at the ranks of the array `wanted`, from 1, as doubles; null where the
    group has no such rank. Exact at every size: the sketch narrows each rank to a band that holds it for certain, and a second
    scan counts what lies below the band and the values in it, some 1 in GRID / 4 of the group's rows."""
    share = lambda r: (r - 1) / F.greatest(F.col("n") - F.col("nans"), F.lit(1)) * GRID
    cut = lambda i, none: F.when((i < 0) | (i > GRID), none).otherwise(F.get(F.col("cuts"), i.cast("int")))
    least, most = F.lit(float("-inf")), F.lit(float("inf"))
    asked = F.transform(
        wanted,
        lambda r, i: F.struct(i.alias("i"), r.cast("long").alias("rank"), F.coalesce(cut(F.floor(share(r)) - 1, least), least).alias("lo"), F.coalesce(cut(F.ceil(share(r)) + 2, most), most).alias("hi")),
    )
    groups = stage(groups.withColumn("asked", asked).drop("cuts"), "bands")
    bands = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], "asked")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter("_v IS NOT NULL")
    rows = rows.join(sized(bands), on) if keys else rows.crossJoin(F.broadcast(bands))
    rows = rows.select(*keys, "_v", F.explode("asked").alias("b")).filter((F.col("_v") <= F.col("b.hi")) | F.isnan("_v"))
    # what is below a band is one null for each rank, summed before it is sent
    rows = rows.select(*keys, F.col("b.i").alias("_i"), F.col("b.rank").alias("_rank"), F.when((F.col("_v") >= F.col("b.lo")), F.col("_v")).alias("_v"))
    counted = rows.groupBy(*keys, "_i", "_rank", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    hit = counted.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
    hit = hit.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_at"))
    out = groups.join(sized(stage(hit, "found")), on, "left") if keys else groups.crossJoin(F.broadcast(stage(hit, "found")))
    found = F.transform("asked", lambda a: F.try_element_at(F.col("_at"), a["i"]))
    return out.withColumn("found", found).drop("_at", "asked", *[f"_{k}" for k in keys])


def interpolated(df: DataFrame, keys: list[str], value: str, fractions: list[float], *aggs: Column) -> DataFrame:
    """keys, n, aggs and `at`: the values at fractions of the way from the least to the largest, linear between neighbours (the
    median at 0.5); nulls are left out. At every size of group, by at_ranks()."""
    groups = sketched(df, keys, value, *aggs)
    place = [F.lit(f) * (F.col("n") - 1) for f in fractions]
    ranks = F.array(*[r for p in place for r in (F.floor(p) + 1, F.ceil(p) + 1)])
    out = at_ranks(df, keys, value, groups, ranks)

    def between(i: int, p: Column) -> Column:
        low, high, part = F.col("found")[2 * i], F.col("found")[2 * i + 1], p - F.floor(p)
        return F.when(part == 0, low).when(part == 0.5, (low + high) / 2).otherwise(low + (high - low) * part)

    return out.withColumn("at", F.array(*[between(i, p) for i, p in enumerate(place)])).drop("found", "nans")


def auroc(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Keys, n_pos, n_neg, auroc with ties averaged (Mann-Whitney); null where a class is missing. Counts per distinct
    score come first, so ties never gather; without keys the whole table is one group, in buckets like any other."""
    by = keys or ["_all"]
    t = df.select(*(keys or [F.lit(0).alias("_all")]), F.col(score).alias("_s"), positive.cast("long").alias("_p"))
    t = stage(t.groupBy(*by, "_s").agg(F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg")), "counts")
    t = bucketed(t, by, "_s")
    base = t.groupBy(*by, "bucket").agg(F.sum("neg").alias("b"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("below", F.coalesce(F.sum("b").over(before), F.lit(0))).drop("b")
    inner = Window.partitionBy(*by, "bucket").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(base, "bases").withColumnsRenamed({k: f"_{k}" for k in by} | {"bucket": "_bucket"})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*by, "bucket"]]
    t = t.join(sized(base), on).withColumn("under", F.col("below") + F.coalesce(F.sum("neg").over(inner), F.lit(0)))
    # twice the statistic, so that sums stay whole numbers
    out = t.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (2 * F.col("under") + F.col("neg"))).alias("u2"))
    area = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u2") / (2.0 * F.col("n_pos") * F.col("n_neg")))
    return out.select(*keys, "n_pos", "n_neg", area.alias("auroc"))
