"""Nearest points of large banks: blocks of points and queries, and balls round pivots that keep queries from most blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollscan.staging import sized, stage

#: Bytes of pivots that every task may hold.
PIVOT_BYTES = 32 << 20
#: Rows and points that meet in one product, so that a task holds 8 MB of it, however large batch and bank are.
ROWS, POINTS = 512, 2048


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _in_blocks(q: DataFrame, b: DataFrame, block: int = 4096) -> DataFrame:
    """(row, k, distance) for the rows of q (row, k, embedding) whose key has points in b (k, embedding). Both sides are cut into blocks
    of about `block` rows; each pair of blocks is a cell, in which batches of queries meet the cell's points in one product."""
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, name: df.groupBy("k").agg(F.ceil(F.count("*") / block).cast("long").alias(name))
    shape = stage(count(q, "rows").join(count(b, "cols").hint("merge"), "k"), "blocks")
    side = lambda df, mine, parts, other: df.join(sized(shape), "k").withColumn(mine, F.pmod(F.xxhash64("embedding"), F.col(parts))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col({"rows": "cols", "cols": "rows"}[parts]) - 1)))
    points = side(b, "j", "cols", "i").select(F.lit(-1).cast("long").alias("row"), "k", "i", "j", "embedding")
    asked = side(q, "i", "rows", "j").select("row", "k", "i", "j", "embedding")
    # the points of a cell come before its queries
    cells = points.unionByName(asked).repartition(n, "k", "i", "j").sortWithinPartitions("k", "i", "j", F.expr("row >= 0"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in ("k", "i", "j")]))
            rows, x = batch.column("row").to_numpy(), _matrix(batch.column("embedding"))
            cuts = [0, *[t for t in range(1, len(names)) if names[t] != names[t - 1]], len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if names[lo] != now:
                    now, held = names[lo], []
                at = np.arange(lo, hi)
                if (rows[at] < 0).any():
                    held.append(x[at[rows[at] < 0]])
                at = at[rows[at] >= 0]
                if len(at):
                    held = [np.concatenate(held)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array([now[0]] * len(at)), pa.array(_least(x[at], held[0]))], names=["row", "k", "distance"])

    return cells.mapInArrow(run, "row long, k string, distance double").groupBy("row", "k").agg(F.min("distance").alias("distance"))


def _least(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances to the nearest point: candidates by products of ROWS and POINTS, the distance itself summed term by term, in order."""
    best, least, norms = np.zeros(len(x), np.int64), np.full(len(x), np.inf), (points**2).sum(1)
    for j in range(0, len(points), POINTS):
        some = points[j : j + POINTS].T
        for i in range(0, len(x), ROWS):
            at = slice(i, i + ROWS)
            square = (-2 * x[at]) @ some
            square += norms[j : j + POINTS]
            own = square.argmin(1)
            value = square[np.arange(len(own)), own]
            nearer = value < least[at]
            best[at], least[at] = np.where(nearer, own + j, best[at]), np.where(nearer, value, least[at])
    return np.sqrt(np.cumsum((x - points[best]) ** 2, axis=1)[:, -1])


def _pivots(b: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, int]] | None:
    """Pivots of each key, about the root of its number of points, fewer where they would pass PIVOT_BYTES, and the number of
    each key's first ball; None where one for each key is too much. They are points of b, those with the least hashes."""
    mark = F.xxhash64("embedding", F.lit(5))
    sizes = stage(b.groupBy("k").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.min_by("embedding", mark).alias("one")), "sizes")
    shape = sizes.agg(F.count("*").alias("keys"), F.sum(F.sqrt("n")).alias("roots"), F.max("d").alias("d")).first()
    most = PIVOT_BYTES // (8 * max(1, shape.d or 1))
    if not shape.keys or shape.keys > most // 2:
        return None if shape.keys else ({}, {})
    each = F.greatest(F.lit(1), F.floor(F.sqrt("n") * min(1.0, (most // 2) / shape.roots))).cast("long")
    few = b.join(sized(sizes.select("k", "n", each.alias("each"))), "k").filter(F.pmod(mark, F.lit(1 << 30)) < F.lit(float(1 << 30)) * (1.2 * F.col("each") + 16) / F.col("n"))
    few = few.select("k", "embedding", "each").unionByName(sizes.select("k", F.col("one").alias("embedding"), each.alias("each"))).groupBy("k", "embedding").agg(F.first("each").alias("each"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.pmod(mark, F.lit(1 << 30)), mark))
    rows = few.withColumn("place", place).filter("place <= each").select("k", "embedding").orderBy("k", mark).collect()
    held: dict[str, list] = {}
    for k, v in rows:
        held.setdefault(k, []).append(v)
    first, at = {}, 0
    for k, v in held.items():
        first[k], at = at, at + len(v)
    return {k: np.array(v, np.float64) for k, v in held.items()}, first


def _apart(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """All distances between rows of x and points."""
    square = (x**2).sum(1)[:, None] - 2 * x @ points.T + (points**2).sum(1)
    return np.sqrt(np.maximum(square, 0.0))


def _pieces(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """batches in slices whose rows times width are at most ROWS * POINTS."""
    rows = max(1, ROWS * POINTS // max(1, width))
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _groups(keys: list) -> Iterator[tuple[str, np.ndarray]]:
    names = np.array(keys, object)
    for k in set(keys):
        yield k, np.flatnonzero(names == k)


def nearest(q: DataFrame, b: DataFrame) -> DataFrame:
    """(row, k, distance, compared) for the rows of q (row, k, embedding) whose key has points in b (k, embedding): the exact least
    distance, and how many points it took, pivots counted.

    Each point lies in the ball of its nearest pivot. A query first meets its own nearest pivot's ball, whose nearest point bounds
    its distance from above; another ball is met only if the distance to its pivot less the ball's radius does not exceed that.
    Queries and points meet in blocks of balls (see _in_blocks), so that a ball of a third of all points is many cells. Pivots
    and the balls' sizes are held by every task up to PIVOT_BYTES; keys too many for that meet in blocks without pivots.
    """
    found = _pivots(b)
    if found is None:
        per_key = stage(b.groupBy("k").agg(F.count("*").alias("compared")), "sizes")
        return _in_blocks(q, b).join(sized(per_key), "k").select("row", "k", "distance", "compared")
    shared = q.sparkSession.sparkContext.broadcast(found)

    def to_balls(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, first = shared.value
        for batch in _pieces(batches, max(map(len, pivots.values()), default=1)):
            keys, x = batch.column("k").to_pylist(), _matrix(batch.column("embedding"))
            ball, far = np.zeros(len(keys), np.int64), np.zeros(len(keys))
            for k, at in _groups(keys):
                away = _apart(x[at], pivots[k])
                own = away.argmin(1)
                ball[at], far[at] = first[k] + own, away[np.arange(len(at)), own]
            yield pa.RecordBatch.from_arrays([pa.array(ball), batch.column("embedding"), pa.array(far)], names=["ball", "embedding", "far"])

    points = stage(b.mapInArrow(to_balls, "ball long, embedding array<float>, far double"), "balls")
    total = sum(len(v) for v in found[0].values())
    radius, size = np.full(total, -np.inf), np.zeros(total, np.int64)
    for r in points.groupBy("ball").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r.ball], size[r.ball] = r.far, r.n
    balls = q.sparkSession.sparkContext.broadcast((radius, size))
    points = points.select(F.col("ball").cast("string").alias("k"), "embedding")

    def met(batches: Iterable[pa.RecordBatch], bound: bool) -> Iterator[pa.RecordBatch]:
        """The balls that each query meets: the nearest one, or (bound) all others within reach of its distance so far."""
        (pivots, first), (radius, size) = shared.value, balls.value
        for batch in _pieces(batches, max(map(len, pivots.values()), default=1)):
            keys, x = batch.column("k").to_pylist(), _matrix(batch.column("embedding"))
            so_far = batch.column("distance").to_numpy() if bound else None
            rows, cells = [], []
            for k, at in _groups(keys):
                if k not in pivots:
                    continue
                away = _apart(x[at], pivots[k])
                mine = slice(first[k], first[k] + len(pivots[k]))
                own = np.where(size[mine] > 0, away, np.inf).argmin(1)
                if bound:
                    slack = 1e-6 * (1 + away)  # distances are rounded
                    reached = (away - radius[mine] - slack <= so_far[at][:, None]) & (size[mine] > 0)
                    reached[np.arange(len(at)), own] = False
                    i, j = np.nonzero(reached)
                else:
                    i, j = np.arange(len(at)), own
                rows.append(at[i])
                cells.append(first[k] + j)
            take = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            ball = np.concatenate(cells) if cells else np.zeros(0, np.int64)
            n = size[ball] if bound else size[ball] + np.array([len(pivots[keys[t]]) for t in take.tolist()], np.int64)
            for lo in range(0, len(take), 4096):
                part = pa.array(take[lo : lo + 4096])
                columns = [batch.column(c).take(part) for c in ("row", "k", "embedding")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ball[lo : lo + 4096]), pa.array(n[lo : lo + 4096])], names=["row", "key", "embedding", "ball", "n"])

    schema = "row long, key string, embedding array<float>, ball long, n long"
    pairs = lambda df, bound: df.mapInArrow(lambda batches: met(batches, bound), schema)
    least = lambda p: _in_blocks(p.select("row", F.col("ball").cast("string").alias("k"), "embedding"), points)
    # rows of one query that asks several keys are told apart by a number of their own
    asked = stage(q.select("row", "k", "embedding").filter("k IS NOT NULL").withColumn("_q", F.monotonically_increasing_id()), "asked")
    numbered = asked.select(F.col("_q").alias("row"), "k", "embedding")
    near = stage(pairs(numbered, False), "nearest-balls")
    own = stage(near.select("row", "n").join(least(near).select("row", "distance").hint("merge"), "row"), "own-balls")
    others = stage(pairs(numbered.join(own.select("row", "distance").hint("merge"), "row"), True), "reached-balls")
    more = least(others).groupBy("row").agg(F.min("distance").alias("_less"))
    counts = others.groupBy("row").agg(F.sum("n").alias("_n"))
    out = own.join(more.hint("merge"), "row", "left").join(counts.hint("merge"), "row", "left")
    out = out.select(F.col("row").alias("_q"), F.least("distance", "_less").alias("distance"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("compared"))
    return asked.select("row", "k", "_q").join(out.hint("merge"), "_q").select("row", "k", "distance", "compared")
