"""Helpers shared by the corpus operators: tables in the shared folder, checked join sides, Arrow text batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollscan.staging import BROADCAST_ROWS, shared_dir, sized, stage  # noqa: F401  (used through this module)

#: White space of every word contract; anything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns memory that is free in this process to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about max_bytes of text (one row at least)."""
    give_back()  # what the task before has left
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
        del batch
        give_back()


def running(df: DataFrame, order: list[Column], value: str, name: str = "before", parts: int | None = None) -> DataFrame:
    """df with `name`: the sum of value over all rows that are earlier in the order, and `part`, a number that rises with it.

    Rows are dealt in ranges of the order and summed up range by range, so that no task holds more than a range, whatever the
    keys; only the ranges' own sums, one row for each, are summed in one place. What is summed does not depend on the ranges.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("part").agg(F.sum(value).alias("_held"))
    base = F.sum("_held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", F.coalesce(base, F.lit(0)).alias("_base"))
    inner = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = ranged.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(sums), "part")
    return both.withColumn(name, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


#: Tasks that one stage deals its rows to at most; above them a task takes more than one shard, one after the other.
MOST_TASKS = 50_000


@dataclass
class Cuts:
    """First keys of ranges of a table, each key (whether the id is missing, id, mark): missing ids come last, rows of one id
    are in order of mark. Found by cut_keys()."""

    missing: int
    ids: np.ndarray
    marks: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def place(self, none: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of the cuts are at or before each key (whether the id is missing, id, mark)."""
        first = len(self.ids) - self.missing
        out, upto = np.searchsorted(self.ids[:first], a, "left"), np.searchsorted(self.ids[:first], a, "right")
        out[none], upto[none] = first, len(self.ids)
        tied, low = np.flatnonzero(out < upto), out.copy()
        for lo, hi in set(zip(out[tied].tolist(), upto[tied].tolist())):
            at = tied[low[tied] == lo]
            out[at] = lo + np.searchsorted(self.marks[lo:hi], b[at], "right")
        return out

    def column(self, key: Column, mark: Column) -> Column:
        @F.pandas_udf("int")
        def place(none: pd.Series, ids: pd.Series, marks: pd.Series) -> pd.Series:
            return pd.Series(self.place(none.to_numpy(bool), ids.to_numpy(np.int64), marks.to_numpy(np.int64))).astype("int32")

        # no nulls go to pandas: it would turn ids into floats
        return place(key.isNull(), F.coalesce(key, F.lit(0)).cast("long"), mark)


def cut_keys(rows: DataFrame, key: Column, mark: Column, size: Column, each: int) -> Cuts:
    """Where to cut a table, in order of key (missing ones last) and mark, into ranges of about `each` of size. The cuts follow
    from the rows alone; ids that fill several ranges are cut by mark. One key for each range is brought to the driver."""
    named = rows.select(key.isNull().cast("int").alias("none"), F.coalesce(key, F.lit(0)).cast("long").alias("id"), mark.alias("mark"), size.cast("long").alias("size"))
    order = ["none", "id", "mark"]
    summed = running(named, [F.col(c) for c in order], "size").withColumn("range", F.floor(F.col("before") / each))
    found = summed.groupBy("range").agg(F.min(F.struct(*order)).alias("k")).select("k.*").distinct().orderBy(*order).collect()[1:]
    return Cuts(sum(r.none for r in found), np.array([r.id for r in found], np.int64), np.array([r.mark for r in found], np.int64))


def held_out(parts: int, which: int) -> Column:
    """Whether crc32 of doc_id as text leaves `which` when divided by `parts`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % parts == which
