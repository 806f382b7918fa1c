"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits, bias-corrected likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.llm.common import MOST_TASKS, cut_keys, sized, slices
from rollscan.llm.textnum import U, mix64, shingle_hashes, utf8, word_hashes

BIN_BITS, LOW_BITS = 9, 4
BINS = 1 << BIN_BITS
#: No hash: a bin that no shingle fell in.
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def _bins(column: pa.Array) -> np.ndarray:
    """The least hash of each text in each bin; a shingle's bin is its hash's leading bits."""
    values, number = shingle_hashes(*word_hashes(*utf8(column)))
    out = np.full((len(number), BINS), EMPTY, U)
    at = np.concatenate(([0], np.cumsum(number)))
    for i in np.flatnonzero(number):
        part = np.sort(values[at[i] : at[i + 1]])
        bins = (part >> U(64 - BIN_BITS)).astype(np.int64)
        lead = np.concatenate(([True], bins[1:] != bins[:-1]))
        out[i, bins[lead]] = part[lead]
    return out


def densify(bins: np.ndarray) -> np.ndarray:
    """Fills each empty bin from the first occupied one of its own sequence of random bins, the same for all texts."""
    full = bins != EMPTY
    out = bins.copy()
    some = full.sum(1)
    row, col = np.nonzero(~full & (some > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        donor = (mix64(col.astype(U) * U(0x9E3779B97F4A7C15) + U(attempt)) >> U(64 - BIN_BITS)).astype(np.int64)
        hit = full[row, donor]
        out[row[hit], col[hit]] = bins[row[hit], donor[hit]]
        row, col = row[~hit], col[~hit]
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """LOW_BITS of each bin (uint8, one row per text); 255 throughout for texts without words."""
    bins = densify(_bins(column))
    return np.where(bins == EMPTY, np.uint8(255), (mix64(bins) & U((1 << LOW_BITS) - 1)).astype(np.uint8))


def packed(rows: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text, two bins a byte; empty for texts without words."""
    joined = ((rows[:, ::2] & 15) << 4) | (rows[:, 1::2] & 15)
    return ["" if r[0] == 255 else j.tobytes().hex() for r, j in zip(rows, joined)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of shingle sets. Of bins that differ 1 in 2^LOW_BITS agree by chance, which is taken off.
    Two texts without words are alike (1), one without words is unlike any other (0)."""
    chance = 1 / (1 << LOW_BITS)
    out = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    none = (a[:, 0] == 255), (b[:, 0] == 255)
    return np.where(none[0] | none[1], (none[0] & none[1]).astype(float), out)


def edited(text: str, following: str) -> str:
    """text with its last third (code points, rounded down) replaced by as many first ones of the following text, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """One row per document; its next document is the one with the next smaller doc_id, after the last the first.

    Fingerprints are of the lower-cased (A-Z) five-word shingles of the whole text; fewer words make one shingle. Null
    texts count as empty. Rows that share a doc_id follow each other by a hash of their text; a null doc_id comes last. A
    single document is its own next. An empty table gives no row; further columns are ignored.

    The table is dealt once, in ranges of (doc_id, hash) that hold about as many bytes; the first document of each range also
    goes to the end of the range before it, so that every task meets the next of each of its documents.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark"))
    # descending: the complement rises where doc_id falls
    down, size = F.bitwise_not("doc_id"), F.octet_length("text") + 64
    total = docs.agg(F.sum(size)).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut_keys(docs, down, F.col("mark"), size, max(1, min(range_bytes, -(-total // n)), -(-total // MOST_TASKS)))
    ranges = len(cuts) + 1
    dealt = docs.withColumn("part", cuts.column(down, F.col("mark")))
    # the first of each range: one row for each, and the least of all for the last range
    keys = [(None if i >= len(cuts) - cuts.missing else ~int(a), int(b), i) for i, (a, b) in enumerate(zip(cuts.ids, cuts.marks))]
    least = docs.agg(F.min(F.struct(F.col("doc_id").isNull(), down.alias("down"), "doc_id", "mark")).alias("k")).select("k.*").first()
    keys += [(least.doc_id, least.mark, ranges - 1)] if least.mark is not None else []
    listed = spark.createDataFrame(keys, "head long, head_mark long, before int")
    same = (F.col("mark") == F.col("head_mark")) & F.col("doc_id").eqNullSafe(F.col("head"))
    heading = docs.join(sized(listed, rows=len(keys)), same).groupBy("doc_id", "mark", "before").agg(F.first("text").alias("text"))
    heading = heading.select("doc_id", "text", "mark", F.col("before").alias("part"), F.lit(True).alias("extra"))
    dealt = dealt.withColumn("extra", F.lit(False)).unionByName(heading)
    dealt = dealt.repartitionById(ranges, "part").sortWithinPartitions("extra", F.desc_nulls_last("doc_id"), "mark")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a batch's last row waits for the next
        for batch in slices(batches, "text"):
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "extra")]
            if held:
                cols = [[h, *c] for h, c in zip(held, cols)]
            held = [c[-1] for c in cols]
            ids, texts, extra = cols
            own = [i for i in range(len(ids) - 1) if not extra[i]]
            if not own:
                continue
            new = [edited(texts[i], texts[i + 1]) for i in own]
            marks = fingerprints(pa.array(texts, pa.large_string()))
            changed = fingerprints(pa.array(new, pa.large_string()))
            mine, nexts = marks[own], marks[[i + 1 for i in own]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    pa.array(packed(mine)),
                    pa.array(packed(changed)),
                    pa.array(likeness(mine, changed)),
                    pa.array(likeness(mine, nexts)),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return dealt.mapInArrow(run, RESULT)
