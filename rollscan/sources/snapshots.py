"""Tables as published snapshots: Parquet folders under a manifest that one rename puts in place.

A manifest names the folder of each bucket of keys and the deltas written since; readers see the folders of the newest manifest
and nothing else, so that a write that is killed leaves the table as it was. Deltas replace the rows of their keys; once there
are several, they are merged into the buckets they fall in, so that a read costs the same however many batches were written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollscan.staging import sized

#: Deltas that a table may have before they are merged, and rows of a bucket above which the buckets are doubled.
MOST_DELTAS, BUCKET_ROWS = 8, 2_000_000


class Conflict(RuntimeError):
    """Another writer has published a version since the one that this write began from."""


@dataclass
class Manifest:
    version: int = 0
    keys: list[str] = field(default_factory=list)
    schema: str = ""
    buckets: int = 16
    base: dict[str, str] = field(default_factory=dict)  # folder of each bucket
    rows: dict[str, int] = field(default_factory=dict)
    deltas: list[str] = field(default_factory=list)  # folders, oldest first
    batch: int | None = None  # the last micro-batch that is in the table


class Snapshots:
    """The table at root. Everything that decides a read or write is in its newest manifest, a few names for each bucket."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _names(self) -> list[str]:
        folder = self._path(f"{self.root}/_manifests")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def manifest(self) -> Manifest:
        """The newest manifest, that of an empty table where there is none."""
        named = [n for n in self._names() if n.endswith(".json") and not n.startswith(".")]
        if not named:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{named[-1]}"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, m: Manifest) -> None:
        """Puts m in place as the next version, unless another writer has done so."""
        m.version += 1
        temporary = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        options = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf)
        try:
            context.rename(temporary, self._path(f"{self.root}/_manifests/{m.version:012d}.json"), self.spark.sparkContext._gateway.new_array(options, 0))
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {m.version} of {self.root} exists") from e
            raise

    def _parts(self, m: Manifest, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(m.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def _changes(self, m: Manifest) -> DataFrame:
        """Of the deltas the rows of the newest that has their key."""
        layers = [self._parts(m, [f]).withColumn("_layer", F.lit(i)) for i, f in enumerate(m.deltas)]
        rows = layers[0]
        for layer in layers[1:]:
            rows = rows.unionByName(layer)
        newest = F.max("_layer").over(Window.partitionBy(*m.keys))
        return rows.withColumn("_newest", newest).filter("_layer = _newest").drop("_layer", "_newest")

    def _without(self, rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
        gone = changes.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        return rows.join(sized(gone), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")

    def read(self) -> DataFrame:
        """The table as it is now: what a later write does is not seen."""
        m = self.manifest()
        if not m.schema:
            raise FileNotFoundError(f"no table at {self.root}")
        base = self._parts(m, sorted(set(m.base.values()))) if m.base else self.spark.createDataFrame([], m.schema)
        if not m.deltas:
            return base
        changes = self._changes(m)
        return self._without(base, changes, m.keys).unionByName(changes)

    def write(self, rows: DataFrame, keys: list[str], batch: int | None = None, most_deltas: int = MOST_DELTAS) -> None:
        """Replaces the rows of all keys in `rows`, and no others. A micro-batch that is in the table already is left out. The
        table's keys and columns are those of its first write."""
        m = self.manifest()
        if batch is not None and m.batch is not None and batch <= m.batch:
            return
        m.keys, m.schema = m.keys or keys, m.schema or _ddl(rows.schema)
        if m.keys != keys:
            raise ValueError(f"the table is kept by {m.keys}, not by {keys}")
        folder = f"delta-{uuid.uuid4().hex}"
        kinds = StructType.fromDDL(m.schema)
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds]).write.parquet(f"{self.root}/{folder}")
        m.deltas.append(folder)
        m.batch = batch if batch is not None else m.batch
        if len(m.deltas) > most_deltas:
            self._merge(m)
        self._publish(m)

    def _merge(self, m: Manifest) -> None:
        """Writes the buckets that deltas fall in anew; all buckets, twice as many, where they have grown too large."""
        changes = self._changes(m)
        if sum(m.rows.values()) > BUCKET_ROWS * m.buckets:
            base = self._parts(m, sorted(set(m.base.values())))
            m.buckets, m.base, m.rows = 2 * m.buckets, {}, {}
            touched = base
        else:
            place = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(*m.keys), F.lit(m.buckets)).cast("int"))
            folders = [m.base[b] for b in sorted(str(r[0]) for r in place(changes).select("_bucket").distinct().collect()) if b in m.base]
            touched = self._parts(m, folders) if folders else None
        merged = changes if touched is None else self._without(touched, changes, m.keys).unionByName(changes)
        folder = f"base-{uuid.uuid4().hex}"
        merged = merged.withColumn("_bucket", F.pmod(F.xxhash64(*m.keys), F.lit(m.buckets)).cast("int"))
        # a bucket's keys are spread over tasks too, so that a large key's bucket is many files
        merged.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        for r in self.spark.read.schema(f"{m.schema}, _bucket int").parquet(f"{self.root}/{folder}").groupBy("_bucket").count().collect():
            m.base[str(r[0])], m.rows[str(r[0])] = f"{folder}/_bucket={r[0]}", r[1]
        m.deltas = []

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the folders that none of the newest `keep` versions names. Not while a write or an older read goes on."""
        names = [n for n in self._names() if n.endswith(".json") and not n.startswith(".")]
        used = set()
        for name in names[-keep:]:
            stream = self._fs.open(self._path(f"{self.root}/_manifests/{name}"))
            held = Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
            used |= {f.split("/")[0] for f in [*held.base.values(), *held.deltas]}
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith(("base-", "delta-")) and name not in used:
                self._fs.delete(status.getPath(), True)
        for name in names[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{name}"), False)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
