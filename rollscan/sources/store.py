"""Stored rolls, events, decisions, banks and calibrations: published snapshots and Parquet tables partitioned by sku."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollscan.sources.snapshots import Snapshots
from rollscan.staging import sized, stage

def save_rolls(rolls: DataFrame, root: str) -> None:
    """Publishes the table with rolls (or their events) in place of those of the same sku and roll_id, and no others touched.
    A write that fails leaves the table as it was."""
    Snapshots(rolls.sparkSession, root).write(rolls, ["sku", "roll_id"], most_deltas=0)


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The rows that are published now."""
    return Snapshots(spark, root).read()


def roll_documents(rolls: DataFrame, meta: str = "meta", schema: str = "map<string,string>") -> DataFrame:
    """Stored rolls with their free-form JSON column read back as a map, or as the struct that schema names."""
    return rolls.withColumn(meta, F.from_json(meta, schema))


def upsert_events(root: str):
    """A foreachBatch function that publishes each micro-batch of events once: a row takes the place of that with its roll_id
    and event_id (of several in a batch, any). Batches are merged as they add up, so that reads do not grow with their number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        one = batch.dropDuplicates(["roll_id", "event_id"])
        Snapshots(batch.sparkSession, root).write(one, ["roll_id", "event_id"], batch_id)

    return write


def current_events(stored: DataFrame) -> DataFrame:
    """The last written row of each (roll_id, event_id)."""
    w = Window.partitionBy("roll_id", "event_id").orderBy(F.desc("batch_id"))
    return stored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def append_decisions(decisions: DataFrame, root: str) -> None:
    """Decisions are only ever added; statuses outside the three are refused."""
    known = F.col("status").isin("proposed", "confirmed", "rejected")
    decisions.withColumn("status", F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null")))))).write.mode("append").parquet(root)


def save_bank(bank: DataFrame, matrices: DataFrame, meta: DataFrame, root: str, parameters: DataFrame | None = None) -> None:
    """Points, projection, what they were fitted with and, where given, the resolved parameters of each sku (params.resolved)."""
    tables = {"points": bank, "projections": matrices, "meta": meta} | ({"parameters": parameters} if parameters is not None else {})
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sku").parquet(f"{root}/{name}")


def load_bank(spark: SparkSession, root: str, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and projections of the requested skus; a bank fitted otherwise is refused when it is read."""
    from rollscan.operators.bank import assert_compatible

    ok = stage(assert_compatible(spark.read.parquet(f"{root}/meta"), requested).select("sku"), "compatible")
    return tuple(spark.read.parquet(f"{root}/{name}").join(sized(ok), "sku") for name in ("points", "projections"))


def load_parameters(spark: SparkSession, root: str) -> DataFrame:
    """The parameters that the banks were fitted with."""
    return spark.read.parquet(f"{root}/parameters")


def save_calibrations(calibrations: DataFrame, root: str) -> None:
    """S12."""
    calibrations.write.mode("append").partitionBy("sku").parquet(root)


def latest_calibrations(stored: DataFrame) -> DataFrame:
    """Each sku's latest."""
    w = Window.partitionBy("sku").orderBy(F.desc("fit_timestamp"))
    return stored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def save_csv(table: DataFrame, root: str) -> None:
    """S13."""
    table.write.mode("overwrite").option("header", True).csv(root)


def save_documents(documents: DataFrame, root: str) -> None:
    """One JSON document a line."""
    documents.select("document").write.mode("overwrite").text(root)
