"""Per-sku parameters: defaults overlaid by what a sku states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.staging import sized


def unknown_keys(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """P10: overrides of keys that no default has."""
    return overrides.join(sized(defaults.select("section", "key")), ["section", "key"], "left_anti")


def resolved(skus: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """P10: every sku's parameters, (section, key, value), with where the value is from. An unknown key is an error. The table of
    defaults has a row for each key, so crossing it with the skus is the result's own size."""
    known = sized(defaults.select("section", "key", F.lit(True).alias("known")))
    o = overrides.join(known, ["section", "key"], "left")
    name = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown key "), "section", F.lit("."), "key"))).otherwise(F.col("key"))
    o = o.select("sku", "section", name.alias("key"), F.col("value").alias("own"))
    return skus.crossJoin(sized(defaults)).join(o, ["sku", "section", "key"], "left").select("sku", "section", "key", F.coalesce("own", "value").alias("value"), F.col("own").isNotNull().alias("overridden"))
