"""Best-fit packing: patterns of a few document lengths, their repeats fitted to the histogram by non-negative least squares.

Only the histogram of piece lengths (at most `capacity` numbers) is solved on the driver; pieces are numbered within
their length on the executors and take their places from the table of runs that the solution makes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import sized, slices, stage
from rollscan.llm.tokens import encoder_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END = 2


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """Tokens of each text (null: empty) and the end id, in pieces of at most capacity; of longer ones the first piece takes the rest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in slices(batches, "text", 1 << 18):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def patterns(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pattern of a few documents that fills the capacity exactly: (lengths, times), rows of three lengths (0: none) and how
    often each occurs. They are all patterns of one to three documents, and all of one length repeated with one other, which
    are those that fill sequences where pieces are short."""
    capacity = len(counts) - 1
    there = counts > 0
    have = np.flatnonzero(there)
    # a >= b >= c > 0, the third given by the first two
    a, b = np.meshgrid(have, have, indexing="ij")
    c = capacity - a - b
    ok = (a >= b) & (c >= 0) & (c <= b)
    ok &= there[np.maximum(c, 0)] | (c == 0)
    few = np.stack((a[ok], b[ok], c[ok]), 1)
    times = [(few > 0).astype(np.int64)]
    lengths = [few]
    if there[capacity]:
        lengths.append(np.array([[capacity, 0, 0]]))
        times.append(np.array([[1, 0, 0]]))
    for k in range(3, capacity + 1):  # k of one length and one other, or none
        once = have[have * k <= capacity]
        if not len(once):
            break
        rest = capacity - k * once
        ok = there[rest] | (rest == 0)
        lengths.append(np.stack((once[ok], rest[ok], np.zeros(ok.sum(), np.int64)), 1))
        times.append(np.stack((np.full(ok.sum(), k), (rest[ok] > 0).astype(np.int64), np.zeros(ok.sum(), np.int64)), 1))
    return np.concatenate(lengths), np.concatenate(times)


def fit(counts: np.ndarray, lengths: np.ndarray, times: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeats x >= 0 that minimise |A x - counts|^2, where A holds how often each pattern has each length (accelerated projected gradient)."""
    n = len(lengths)
    cells, weight, goal = lengths.ravel(), times.ravel().astype(float), counts.astype(float)
    goal[0] = 0
    owner = np.repeat(np.arange(n), lengths.shape[1])

    def made(x: np.ndarray) -> np.ndarray:
        out = np.bincount(cells, x[owner] * weight, len(counts))
        out[0] = 0
        return out

    back = lambda r: (r[lengths] * times).sum(1)
    v = np.ones(n)
    for _ in range(30):
        v = back(made(v))
        scale = np.linalg.norm(v)
        v /= scale
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(made(y) - goal) / (1.05 * scale))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Packs a histogram: the longest piece opens a sequence, the longest that still fits follows, until none does; the
    sequence is repeated while its lengths last."""
    left, out = left.copy(), []
    top = len(left) - 1
    while top:
        if not left[top]:
            top -= 1
            continue
        shape, used = [], {}
        space, at = len(left) - 1, top
        while space and at:
            at = min(at, space)
            while at and left[at] - used.get(at, 0) <= 0:
                at -= 1
            if at:
                used[at] = used.get(at, 0) + 1
                shape.append(at)
                space -= at
        repeats = min(int(left[k]) // u for k, u in used.items())
        for k, u in used.items():
            left[k] -= u * repeats
        out.append((tuple(shape), repeats))
    return out


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram counts[length] exactly: fitted repeats rounded down, then best fit of what is left."""
    left = counts.astype(np.int64).copy()
    lengths, times = patterns(left)
    out = []
    if len(lengths):
        x = fit(left, lengths, times)
        order = np.argsort(-x, kind="stable")
        for i in order[x[order] >= 1 - 1e-9].tolist():
            used: dict[int, int] = {}
            for a, k in zip(lengths[i].tolist(), times[i].tolist()):
                if k:
                    used[a] = used.get(a, 0) + k
            repeats = min(int(x[i] + 1e-9), *[int(left[a]) // k for a, k in used.items()])
            if repeats > 0:
                out.append((tuple(a for a, k in used.items() for _ in range(k)), repeats))
                for a, k in used.items():
                    left[a] -= k * repeats
    return out + best_fit(left)


def runs(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, sequence, offset): the pieces numbered lo..hi-1 of a length go to sequence, sequence+1, ... at offset."""
    out, used, sequence = [], {}, 0
    for shape, repeats in found:
        offset = 0
        for a in shape:
            lo = used.get(a, 0)
            used[a] = lo + repeats
            out.append((a, lo, lo + repeats, sequence, offset))
            offset += a
        sequence += repeats
    return out


def numbered(pieces: DataFrame, rows: int) -> DataFrame:
    """pieces with `number`: 0, 1, ... within each length, in an order that reruns repeat. Chunks of a length are numbered apart and then
    shifted, so that no window holds all pieces of a length."""
    chunks = max(1, round(rows**0.5 / 4))
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    held = pieces.groupBy("length", "chunk").agg(F.count("*").alias("held"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = stage(held.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held"), "bases")
    inner = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    return pieces.withColumn("inner", F.row_number().over(inner) - 1).join(sized(held), ["length", "chunk"]).withColumn("number", F.col("base") + F.col("inner")).drop("chunk", "base", "inner")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds the end id. Ties of a length are placed by doc_id and piece within
    chunks of a hash; repeated rows are packed each. An empty table gives no row. Further columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stage(cut_pieces(docs, tokenizer, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    found = runs(plan(counts))
    names = ("length", "lo", "hi", "sequence", "offset")
    columns = list(zip(*found)) or [[]] * 5
    # one row for each document of a pattern: as many as there are patterns at most, whatever the number of pieces
    table = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=list(names)))
    # by bins of a length's numbers, so that a piece meets only the few runs of its bin
    width = F.greatest(F.lit(1), F.ceil(F.col("n") / 64)).cast("long")
    sizes = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(counts) if n], "length long, n long").select("length", width.alias("width"))
    table = table.join(F.broadcast(sizes), "length").withColumn("bin", F.explode(F.expr("sequence(lo div width, (hi - 1) div width)"))).drop("width")
    at = numbered(pieces, int(counts.sum())).join(F.broadcast(sizes), "length").withColumn("bin", F.expr("number div width"))
    most = len(found) + 64 * int((counts > 0).sum())
    at = at.join(sized(table, rows=most), ["length", "bin"]).filter("number >= lo AND number < hi")
    return at.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("number") - F.col("lo")).alias("sequence_id"), "offset")


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
