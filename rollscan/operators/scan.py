"""Ordered work on groups of any size: rows are dealt in ranges of (keys, order), each range leaves one summary row for each
group in it, and the summaries alone are scanned in order. What a range needs from all before it is joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rollscan.staging import sized, stage

#: The number of a row's range; it rises with the order.
PART = "_part"


#: Rows of a part in clustered().
ROWS = 400_000


def clustered(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by keys in parts of some ROWS rows (counted), as many as a shuffle has at least, so that what a task sorts does
    not grow with df. A single group is one part."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    return df.repartition(n, *keys)


def ranged(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df dealt in ranges of (keys, order), with PART. Rows that agree in all of these share a range."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id())


def inside(keys: list[str], order: list[str | Column]) -> WindowSpec:
    """The window of a group's rows in one range."""
    return Window.partitionBy(PART, *keys).orderBy(*order)


def before(keys: list[str]) -> WindowSpec:
    """Over summaries: those of the group's earlier ranges."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def with_summaries(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """rows (in a table) with what the summaries (PART, keys, one row each) say; keys may be null."""
    s = summaries.withColumnsRenamed({k: f"_s{k}" for k in [PART, *keys]})
    on = [F.col(PART) == F.col(f"_s{PART}"), *[F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]]
    return rows.join(sized(stage(s, "summaries")), on).drop(PART, *[f"_s{k}" for k in [PART, *keys]])


def running_count(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the group's rows up to each row, in order."""
    rows = stage(ranged(df.withColumn("_value", value.cast("long")), keys, order), "ranges")
    sums = rows.groupBy(PART, *keys).agg(F.sum("_value").alias("_held"))
    base = F.coalesce(F.sum("_held").over(before(keys)), F.lit(0))
    sums = sums.select(PART, *keys, base.alias("_base"))
    upto = inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_upto", F.sum("_value").over(upto))
    return with_summaries(rows, sums, keys).withColumn(name, F.col("_base") + F.col("_upto")).drop("_value", "_upto", "_base")


def row_numbers(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with each row's place in its group, from 1."""
    return running_count(df, keys, order, F.lit(1), name)


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the value of the group's row before."""
    w = inside(keys, order)
    first = F.row_number().over(w) == 1
    rows = stage(ranged(df, keys, order).select("*", F.lag(value).over(w).alias(name), first.alias("_first")), "ranges")
    ends = rows.groupBy(PART, *keys).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_end"))
    ends = ends.select(PART, *keys, F.lag("_end").over(Window.partitionBy(*keys).orderBy(PART)).alias("_end"))
    out = with_summaries(rows, ends, keys)
    return out.withColumn(name, F.when(F.col("_first"), F.col("_end.v")).otherwise(F.col(name))).drop("_first", "_end")
