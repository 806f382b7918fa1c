"""Exact dedup: a tree merge of sorted digest runs that partitions exchange in binomial rounds.

Every partition begins with a run of its own rows: sorted by digest, equal ones merged. There are 2^k places. In a round
2^b places whose numbers differ only in b bits exchange their runs, so that each is left with the digests that have its own
number in those bits, and merges what it got; after all rounds a place holds every text whose digest begins with its number.
A text that fills a third of the table is one row of each run from the first level on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.llm.common import sized, stage

KEY = ("digest", "n_bytes", "mark")
RUN = "place int, digest binary, n_bytes int, mark long, keep_id long, n long, ties long"
_NAMES = [c.split()[0] for c in RUN.split(", ")]


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with its text's SHA-256, length in bytes and a second hash. Equal keys are equal texts: the last two verify the first."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).alias("n_bytes"), F.xxhash64(t).alias("mark"))


def merged(batch: pa.RecordBatch, largest: bool) -> pa.RecordBatch:
    """Rows of RUN in order of KEY, equal keys as one: the kept id (null only where none has one), n rows, ties of them with that id."""
    digest = np.frombuffer(batch.column("digest").buffers()[2], np.uint8, 32 * batch.num_rows, batch.column("digest").offset * 32).reshape(-1, 32)
    n_bytes, mark, n, ties = (batch.column(c).to_numpy() for c in ("n_bytes", "mark", "n", "ties"))
    new = np.ones(batch.num_rows, bool)
    new[1:] = (digest[1:] != digest[:-1]).any(1) | (n_bytes[1:] != n_bytes[:-1]) | (mark[1:] != mark[:-1])
    starts = np.flatnonzero(new)
    named = batch.column("keep_id").is_valid().to_numpy(zero_copy_only=False)
    ids = batch.column("keep_id").fill_null(0).to_numpy()
    # ids in the order in which they lose: complemented where the smallest stays, rows without one below all
    worth = np.where(named, ids if largest else ~ids, np.iinfo(np.int64).min)
    some = np.logical_or.reduceat(named, starts)
    best = np.maximum.reduceat(worth, starts)
    group = np.cumsum(new) - 1
    kept = (worth == best[group]) & (named == some[group])
    out = batch.take(pa.array(starts))
    columns = [*out.columns[:4], pa.array(best if largest else ~best, pa.int64(), mask=~some), pa.array(np.add.reduceat(n, starts)), pa.array(np.add.reduceat(np.where(kept, ties, 0), starts))]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def merging(places: int, bits: tuple[int, int] | None, largest: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges a sorted run in a stream and addresses its rows: bits (first, number) of a place come from the digest's own."""

    def addressed(batch: pa.RecordBatch) -> pa.RecordBatch:
        if bits is None or not batch.num_rows:
            return batch
        lead = np.frombuffer(b"".join(d[:4] for d in batch.column("digest").to_pylist()), ">u4").astype(np.int64)
        total = places.bit_length() - 1
        low = total - bits[0] - bits[1]
        mask = ((1 << bits[1]) - 1) << low
        place = (batch.column("place").to_numpy() & ~mask) | ((lead >> (32 - total)) & mask)
        return batch.set_column(0, "place", pa.array(place.astype(np.int32)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last key may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                batch = pa.RecordBatch.from_arrays(batch.columns, names=_NAMES)
                both = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
                both = merged(both, largest)
                last = both.slice(both.num_rows - 1)
                yield addressed(both.slice(0, both.num_rows - 1))
        if last is not None:
            yield addressed(last)

    return run


def places_for(partitions: int) -> int:
    """The power of two that is not below the number of partitions."""
    return 1 << max(0, partitions - 1).bit_length()


def rounds_of(places: int, step: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each round, most significant first."""
    total = places.bit_length() - 1
    return [(b, min(step, total - b)) for b in range(0, total, step)]


def merge_runs(rows: DataFrame, keep: str = "largest", places: int | None = None, step: int = 2) -> DataFrame:
    """One row for each text: KEY, keep_id, group_size, ties (rows of the text that have keep_id). `step` bits of a place's
    number are settled in a round, so that 2^step runs meet in a merge."""
    places = places or places_for(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rounds = [*rounds_of(places, step), None]
    one = F.lit(1).cast("long")
    runs = rows.select(F.pmod(F.spark_partition_id(), F.lit(places)).alias("place"), *KEY, F.col("doc_id").alias("keep_id"), one.alias("n"), one.alias("ties"))
    for r, bits in enumerate(rounds):
        runs = runs.repartitionById(places, "place") if r else runs
        runs = runs.sortWithinPartitions(*KEY).mapInArrow(merging(places, bits, keep == "largest"), RUN)
    return runs.select(*KEY, "keep_id", F.col("n").alias("group_size"), "ties")


def copies(rows: DataFrame, keep: str = "largest") -> DataFrame:
    """The texts of several rows, as merge_runs gives them. rows: digests()."""
    return stage(merge_runs(rows, keep).filter("group_size > 1"), "copies")


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are compared whole and unchanged; null counts as empty. Of equal texts the row with the largest (or smallest)
    doc_id stays; rows that also share that doc_id all carry kept = true. A null doc_id stays only where its whole group
    has none. Empty input gives an empty result; further columns are ignored.
    """
    rows = stage(digests(docs), "digests")
    joined = rows.join(sized(copies(rows, keep)), list(KEY), "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
