"""Tables in the folder that driver and executors share; they cut lineage and outlive executors. Join sides of a counted size."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted join side is broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, gone when the process ends; a cluster
    is refused, as its executors do not share the driver's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="rollscan-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: What is written inside each scratch() that is open.
_written: list[list[str]] = []


def stage(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df written out and read back. The table stays until its scratch() ends, for good where there is none or it is lasting."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _written and not lasting:
        _written[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what was staged inside when it ends, failed writes too. For callers who have written their result by then: what
    they still hold of the tables inside cannot be read any more."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df hinted for the join it is the smaller side of: broadcast up to limit rows (counted), else sort-merge, whose skewed
    keys AQE splits."""
    n = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df.hint("merge")
