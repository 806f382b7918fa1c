"""Memory banks: projection, pooling, coresets, saved banks, and distances to them."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollscan.operators.neighbours import _in_blocks, _least, _matrix, nearest  # noqa: F401
from rollscan.operators.scan import row_numbers
from rollscan.staging import shared_dir, sized, stage

#: Bytes of a bank that every task may hold; larger ones are met in blocks.
BROADCAST_BYTES = 64 << 20
#: Pairs of queries and points above which nearest_distance_sql refuses them as rows, and above which nearest_pairs no longer makes rows of them.
MOST_PAIRS, PAIR_ROWS = 2_000_000_000, 5_000_000


def projection(spark: SparkSession, sku: str, d_in: int, d_out: int, seed: int = 0) -> DataFrame:
    """A stored random matrix, entries N(0, 1 / d_out): sku, row, weights."""
    if d_out > d_in:
        raise ValueError(f"{d_out} dimensions out of {d_in}")
    m = np.random.default_rng(seed).normal(0, d_out**-0.5, (d_in, d_out)).astype(np.float32)
    return spark.createDataFrame([(sku, i, r.tolist()) for i, r in enumerate(m)], "sku string, row int, weights array<float>")


def project(embeddings: DataFrame, matrices: DataFrame) -> DataFrame:
    """Embeddings (with a string sku) times their sku's stored matrix, one product per Arrow batch. Matrices are a few hundred rows a sku."""
    held: dict[str, np.ndarray] = {}
    for sku, rows in matrices.groupBy("sku").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "weights"))), lambda r: r.weights)).collect():
        held[sku] = np.array(rows, np.float32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skus = np.array(batch.column("sku").to_pylist(), object)
            x = np.array(batch.column("embedding").to_pylist(), np.float32)
            out: list = [None] * len(x)
            for sku in set(skus):
                at = np.flatnonzero(skus == sku)
                for i, v in zip(at, x[at] @ held[sku]):
                    out[i] = v
            i = batch.schema.get_field_index("embedding")
            yield batch.set_column(i, "embedding", pa.array([v.tolist() for v in out], pa.list_(pa.float32())))

    return embeddings.mapInArrow(run, embeddings.schema)


def pooled(grid: DataFrame, k: int = 3) -> DataFrame:
    """K x k mean over each tile's patch grid, stride 1; the zero border counts (the sum is divided by k * k).
    grid: keys, gy, gx, embedding; keys are all other columns, one tile each. A tile's grid is summed in one product of arrays;
    patches that a tile lacks count as zero, and cells without any patch near are left out."""
    if k <= 1:
        return grid
    keys = [c for c in grid.columns if c not in ("gy", "gx", "embedding")]
    r = k // 2

    def one(tile: pd.DataFrame) -> pd.DataFrame:
        y, x = tile["gy"].to_numpy(), tile["gx"].to_numpy()
        v = np.stack(tile["embedding"].to_numpy()).astype(np.float64)
        high, wide = y.max() + 1, x.max() + 1
        held, there = np.zeros((high + 2 * r, wide + 2 * r, v.shape[1])), np.zeros((high + 2 * r, wide + 2 * r), bool)
        np.add.at(held, (y + r, x + r), v)
        there[y + r, x + r] = True
        shifts = [(slice(i, i + high), slice(j, j + wide)) for i in range(2 * r + 1) for j in range(2 * r + 1)]
        total, near = sum(held[s] for s in shifts), np.logical_or.reduce([there[s] for s in shifts])
        gy, gx = np.nonzero(near)
        out = pd.DataFrame({c: [tile[c].iloc[0]] * len(gy) for c in keys})
        return out.assign(gy=gy, gx=gx, embedding=list((total[gy, gx] / (k * k)).astype(np.float32)))

    kinds = dict(grid.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"gy {kinds['gy']}", f"gx {kinds['gx']}", "embedding array<float>"])
    return grid.groupBy(*keys).applyInPandas(one, schema)


def _k_center(x: np.ndarray, k: int, first: int) -> list[int]:
    picks, near = [first], np.linalg.norm(x - x[first], axis=1)
    while len(picks) < k:
        picks.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[picks[-1]], axis=1))
    return picks


def _at_rank(points: DataFrame, rank: int) -> int:
    """The point_id at a place (from 0) in their order; only counts and one part of the ids meet."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = stage(points.select("point_id").repartitionByRange(n, "point_id").withColumn("part", F.spark_partition_id()), "ids")
    for row in ids.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        if rank < row["n"]:
            return ids.filter(F.col("part") == row["part"]).orderBy("point_id").offset(rank).first()["point_id"]
        rank -= row["n"]
    raise IndexError(rank)


#: Cells that the points of a large sku are kept in.
CELLS = 256


class _Cells:
    """Points of one sku in cells, a folder each: those nearest to one of the first CELLS picks. `reach` is a cell's radius,
    `near` the largest least distance to a pick in it. A pick that is `reach + near` away from a cell's centre or farther brings
    no point of it nearer, so that its folder stays; only the other cells are written again, under a new name."""

    def __init__(self, points: DataFrame) -> None:
        self.spark, self.base = points.sparkSession, f"{shared_dir(points.sparkSession)}/cells-{uuid.uuid4().hex}"
        self.rows = stage(points.select("sku", "point_id", "embedding", F.lit(float("inf")).cast("float").alias("near")), "near")
        self.centres, self.paths = np.zeros((0, 0), np.float32), {}
        self.reach = self.near = np.zeros(0)
        self.written: list[int] = []  # cells written in each round
        self.version = 0

    def all(self) -> DataFrame:
        if not self.paths:
            return self.rows
        return self.spark.read.schema("sku string, point_id long, embedding array<float>, near float").parquet(*self.paths.values())

    def update(self, picks: np.ndarray) -> None:
        """Brings least distances up to date after further picks, in order."""
        if not self.paths:
            self.rows = stage(self.all().mapInArrow(_nearer(self.spark, picks), self.rows.schema), "near")
            self.centres = picks if not len(self.centres) else np.concatenate((self.centres, picks))
            if len(self.centres) >= CELLS:
                self.centres = self.centres[:CELLS]
                self._write(self.rows)
            return
        apart = np.sqrt(((self.centres[:, None].astype(np.float64) - picks[None]) ** 2).sum(2))
        bound = (self.reach + self.near) * (1 + 1e-5)  # distances are single numbers
        touched = [c for c in np.flatnonzero((apart < bound[:, None]).any(1)).tolist() if c in self.paths]
        self.written.append(len(touched))
        if touched:
            rows = self.spark.read.schema(self.rows.schema).parquet(*[self.paths[c] for c in touched])
            self._write(rows.mapInArrow(_nearer(self.spark, picks), self.rows.schema))

    def _write(self, rows: DataFrame) -> None:
        """Writes rows into their cells and notes the cells' radii."""
        shared, self.version = self.spark.sparkContext.broadcast(self.centres), self.version + 1

        def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("embedding"))
                cell, far = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
                for c, centre in enumerate(shared.value):
                    d = np.sqrt(((x - centre) ** 2).sum(1))
                    cell, far = np.where(d < far, c, cell), np.minimum(d, far)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

        path = f"{self.base}/{self.version}"
        rows.mapInArrow(placed, "sku string, point_id long, embedding array<float>, near float, cell int, far double").write.partitionBy("cell").parquet(path)
        if not len(self.reach):
            self.reach, self.near = np.full(len(self.centres), -np.inf), np.full(len(self.centres), -np.inf)
        for r in self.spark.read.parquet(path).groupBy("cell").agg(F.max("far").alias("far"), F.max("near").alias("near")).collect():
            self.paths[r.cell], self.reach[r.cell], self.near[r.cell] = f"{path}/cell={r.cell}", r.far, r.near


def _nearer(spark: SparkSession, picks: np.ndarray):
    """A function over batches that brings `near` up to date."""
    shared = spark.sparkContext.broadcast(picks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy().astype(np.float32).reshape(batch.num_rows, -1)
            near = batch.column("near").to_numpy()
            for p in shared.value:
                near = np.minimum(near, np.linalg.norm(x - p, axis=1))
            i = batch.schema.get_field_index("near")
            yield batch.set_column(i, "near", pa.array(near, pa.float32()))

    return run


def _k_center_rounds(points: DataFrame, k: int, first: int, most: int) -> DataFrame:
    """The picks of _k_center over a table of any size. points: sku, point_id, embedding, of one sku.

    Each round brings the `most` points farthest from the picks to the driver and picks among them as long as the farthest
    of them comes before all others, whose distances can only fall. Then the least distances are brought up to date in the cells
    that the picks reach. To find the farthest, a round reads ids and distances, and embeddings of the points found alone.
    """
    spark, schema = points.sparkSession, "sku string, point_id long, embedding array<float>"
    path = f"{shared_dir(spark)}/picks-{uuid.uuid4().hex}"
    cells = _Cells(points)
    chosen = points.filter(F.col("point_id") == first).select("sku", "point_id", "embedding").limit(1).toPandas()
    done = 0
    while True:
        spark.createDataFrame(chosen.to_dict("records"), schema).write.mode("append").parquet(path)
        done += len(chosen)
        if done >= k:
            return spark.read.schema(schema).parquet(path)
        cells.update(np.stack(chosen["embedding"].to_numpy()).astype(np.float32))
        rows = cells.all()
        farthest = rows.select("point_id", "near").orderBy(F.desc("near"), "point_id").limit(most + 1).toPandas()
        last = farthest.iloc[most] if len(farthest) > most else None
        ids = spark.createDataFrame(farthest[["point_id"]].iloc[:most], "point_id long")
        top = rows.join(F.broadcast(ids), "point_id").toPandas().sort_values("point_id").reset_index(drop=True)
        x, near, ids = np.stack(top["embedding"].to_numpy()).astype(np.float32), top["near"].to_numpy(np.float32), top["point_id"].to_numpy()
        picks: list[int] = []
        while done + len(picks) < k:
            i = int(near.argmax())
            if last is not None and (near[i], -ids[i]) <= (last["near"], -last["point_id"]):
                break
            picks.append(i)
            near = np.minimum(near, np.linalg.norm(x - x[i], axis=1))
        chosen = top.loc[picks, ["sku", "point_id", "embedding"]]


def greedy_coreset(points: DataFrame, fraction: float, seed: int = 0, exact_limit: int = 50_000, candidates: int = 4096) -> DataFrame:
    """K-center greedy per sku: size max(1, round half even of fraction * N), ties to the lowest id. The selection is exact
    at every size: skus up to exact_limit points are taken in one task each (method: exact), larger ones in rounds over all
    tasks (method: composed), which pick the same points. points: sku, point_id (one row each), embedding."""
    schema = "sku string, point_id long, embedding array<float>, method string"

    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id").reset_index(drop=True)
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float32)
        picks = _k_center(x, min(int(rows["k"].iloc[0]), len(rows)), int(np.random.default_rng(seed).integers(len(rows))))
        return rows.loc[picks, ["sku", "point_id", "embedding"]].assign(method="exact")

    p = points.select(F.col("sku").cast("string"), F.col("point_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
    sizes = p.groupBy("sku").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.count("*"))).cast("long").alias("k"))
    sizes = stage(sizes, "sizes")
    small = p.join(sized(sizes.filter(F.col("n") <= exact_limit)), "sku")
    out = small.groupBy("sku").applyInPandas(thin, schema)
    large = sizes.filter(F.col("sku").isNotNull() & (F.col("n") > exact_limit)).orderBy("sku").collect()
    for sku, n, k in large:
        one = stage(p.filter(F.col("sku") == sku), "points")
        first = _at_rank(one, int(np.random.default_rng(seed).integers(n)))
        picked = _k_center_rounds(one, min(k, n), first, candidates)
        out = out.unionByName(picked.withColumn("method", F.lit("composed")))
    return out


def sample(rows: DataFrame, keys: list[str], row_id: str, n: int | Column, seed: int = 0) -> DataFrame:
    """N rows of each group without replacement, in an order fixed by the seed, so that smaller samples are nested in larger ones; `place` is the order."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), row_id)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def evenly_spaced(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """N rows at even steps through each ordered group, first and last included (positions round half to even). Places come
    from counts of ranges, so that no group is sorted in one task."""
    r = stage(row_numbers(rows, keys, [order], "_at"), "places")
    total = r.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("_at").alias("_total"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_total") - 1) / F.lit(float(max(1, n - 1)))).cast("long") + 1)
    wanted = stage(total.withColumn("_steps", F.array_distinct(steps)).drop("_total"), "steps")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return r.join(sized(wanted), on).filter(F.array_contains("_steps", F.col("_at"))).select(*rows.columns)


def nearest_distance(queries: DataFrame, bank: DataFrame, key: str = "sku") -> DataFrame:
    """query_id and the exact L2 distance to the nearest bank point of its key for every row of queries, null where the key
    is null or has no bank point. A bank whose size is counted as small enough is held by every task and met batch by batch in one
    product; of a larger one each query meets the balls round pivots that it can reach. queries: any columns with key, query_id
    and embedding; bank: key, point_id, embedding."""
    q = queries.select(F.col(key).cast("string").alias("k"), F.col("query_id").cast("long"), "embedding")
    b = bank.select(F.col(key).cast("string").alias("k"), "embedding").filter("k IS NOT NULL")
    if _held_bytes(b) <= BROADCAST_BYTES:
        shared = queries.sparkSession.sparkContext.broadcast(_collected(b))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = np.array(batch.column("k").to_pylist(), object)
                x, out = _matrix(batch.column("embedding")), np.full(len(keys), np.nan)
                for k in set(keys):
                    at, points = np.flatnonzero(keys == k), shared.value.get(k)
                    if points is not None:
                        out[at] = _least(x[at], points)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(out, from_pandas=True)], names=["query_id", "distance"])

        return q.mapInArrow(run, "query_id long, distance double")
    q = stage(q.withColumn("row", F.monotonically_increasing_id()), "queries")
    least = nearest(q.select("row", "k", "embedding"), b).select("row", "distance")
    return q.select("row", "query_id").join(least.hint("merge"), "row", "left").select("query_id", "distance")


def distances_to_banks(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """For every row of queries (sku, query_id, embedding) and every sku of the bank (sku, embedding) the distance to the nearest
    point of it: bank_sku, sku, query_id, distance. The skus' names, not their points, are listed on the driver."""
    kind, b = dict(bank.dtypes)["sku"], bank.select(F.col("sku").cast("string").alias("k"), "embedding").filter("k IS NOT NULL")
    q = queries.select("sku", F.col("query_id").cast("long"), "embedding")
    if _held_bytes(b) <= BROADCAST_BYTES:
        shared = queries.sparkSession.sparkContext.broadcast(_collected(b))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("embedding"))
                for k, points in shared.value.items():
                    columns = [pa.array([k] * batch.num_rows), batch.column("sku"), batch.column("query_id"), pa.array(_least(x, points))]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "sku", "query_id", "distance"])

        out = q.mapInArrow(run, f"k string, sku {dict(q.dtypes)['sku']}, query_id long, distance double")
    else:
        q = stage(q.withColumn("row", F.monotonically_increasing_id()), "queries")
        names = [r.k for r in b.select("k").distinct().collect()]
        each = q.select("row", F.explode(F.array(*[F.lit(k) for k in names])).alias("k"), "embedding")
        out = q.select("row", "sku", "query_id").join(nearest(each, b).drop("compared").hint("merge"), "row")
    return out.select(F.col("k").cast(kind).alias("bank_sku"), "sku", "query_id", "distance")


def _held_bytes(b: DataFrame) -> int:
    shape = b.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    return shape["n"] * (shape["d"] or 0) * 4


def _collected(b: DataFrame) -> dict[str, np.ndarray]:
    """The points of each key, of a bank that was counted as small."""
    return {k: np.stack(part["embedding"].to_numpy()).astype(np.float64) for k, part in b.toPandas().groupby("k")}


def nearest_distance_sql(queries: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """J1, J2 in built-in functions only, the form that SQL engines share. Every pair of a key is a row, so that more than
    MOST_PAIRS (counted) are refused: nearest_pairs is the way for them."""
    pairs = _pairs(queries, bank, keys)
    if pairs > MOST_PAIRS:
        raise ValueError(f"{pairs:.0f} pairs of queries and points are too many for this form; use nearest_pairs")
    square = F.aggregate(F.zip_with("embedding", "point", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    b = bank.select(*keys, F.col("embedding").alias("point"))
    joined = queries.join(b, keys)
    return joined.groupBy(*[c for c in queries.columns if c != "embedding"]).agg(F.min(F.sqrt(square)).alias("distance"))


def _pairs(queries: DataFrame, bank: DataFrame, keys: list[str]) -> float:
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return count(queries, "n").join(count(bank, "m").hint("merge"), keys).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0


def nearest_pairs(queries: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of nearest_distance_sql, however many pairs there are. Above PAIR_ROWS pairs (counted) no pair is a row: blocks of
    queries meet blocks of points of their key in products, dealt over all tasks. The work is still the pairs' number."""
    if _pairs(queries, bank, keys) <= PAIR_ROWS:
        return nearest_distance_sql(queries, bank, keys)
    given = lambda df: df.dropna(subset=keys).withColumn("k", F.to_json(F.struct(*keys)))
    q = stage(given(queries).withColumn("row", F.monotonically_increasing_id()), "queries")
    meet = lambda df: df.filter("embedding IS NOT NULL")
    least = _in_blocks(meet(q).select("row", "k", "embedding"), meet(given(bank)).select("k", "embedding"))
    asked = q.join(sized(given(bank).select("k").distinct()), "k", "left_semi").join(least.select("row", "distance").hint("merge"), "row", "left")
    return asked.groupBy(*[c for c in queries.columns if c != "embedding"]).agg(F.min("distance").alias("distance"))


def bank_meta(spark: SparkSession, rows: list[tuple[str, str, int, str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "sku string, backbone string, input_size int, layers string, projection_dim int")


def assert_compatible(meta: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested banks, refused where a key differs from what the bank was fitted with."""
    names = ["backbone", "input_size", "layers", "projection_dim"]
    r = requested.select("sku", *[F.col(c).alias(f"_{c}") for c in names])
    joined = r.join(meta, "sku", "left")
    wrong = F.array_join(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in names])), ", ")
    checked = F.when(wrong != "", F.raise_error(F.concat(F.lit("the bank of "), "sku", F.lit(" differs in "), wrong))).otherwise(F.col("sku"))
    return joined.select(checked.alias("sku"), *names)


def fit_banks(grids: DataFrame, matrices: DataFrame | None, fraction: float, pool: int = 3, seed: int = 0) -> DataFrame:
    """Bank points of every sku in one job: pooled, projected, thinned. grids: sku, tile, gy, gx, embedding. A sku of fewer
    than two tiles is refused."""
    tiles = grids.groupBy("sku").agg(F.count_distinct("tile").alias("tiles"))
    enough = F.when(F.col("tiles") < 2, F.raise_error(F.lit("a sku has fewer than two tiles"))).otherwise(F.col("sku"))
    g = pooled(grids.join(sized(stage(tiles.withColumn("ok", enough), "tiles")), "sku").filter("ok IS NOT NULL").drop("ok", "tiles"), pool)
    g = project(g, matrices) if matrices is not None else g
    return greedy_coreset(g.select("sku", F.xxhash64("tile", "gy", "gx").alias("point_id"), "embedding"), fraction, seed)


def score_grids(grids: DataFrame, matrices: DataFrame | None, bank: DataFrame, pool: int = 3) -> DataFrame:
    """A score for each patch: pooled, projected, distance to its sku's bank. grids as in fit_banks."""
    g = pooled(grids, pool)
    g = stage((project(g, matrices) if matrices is not None else g).withColumn("query_id", F.xxhash64("sku", "tile", "gy", "gx")), "patches")
    found = nearest_distance(g, bank).withColumnRenamed("distance", "score")
    return g.drop("embedding").join(found.hint("merge"), "query_id").drop("query_id")


def score_with(df: DataFrame, make_predict_fn, columns: list[str], batch_size: int = 64, return_type=None) -> DataFrame:
    """A model of the caller as a batched column: make_predict_fn loads it once per worker and returns the function
    over batches. The result is `score` (unbounded float), or an embedding where return_type says so."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import FloatType

    udf = predict_batch_udf(make_predict_fn, return_type=return_type or FloatType(), batch_size=batch_size)
    return df.withColumn("score", udf(*columns))
