"""A caller's model behind the scorer seam, and banks fitted and scored in one job."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rollscan.operators import bank, evaluate, neighbours


def test_caller_model(spark):
    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return (x.reshape(len(x), -1) ** 2).sum(1).astype(np.float32)

        return predict

    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x float")
    assert [r.score for r in bank.score_with(df, make, ["x"]).orderBy("x").collect()] == [1, 4, 9]


def test_caller_embedding(spark):
    def make():
        return lambda x: np.stack((x, 2 * x, -x), axis=1).astype(np.float32)

    df = spark.createDataFrame([(1.0,), (2.0,)], "x float")
    out = bank.score_with(df, make, ["x"], return_type=ArrayType(FloatType()))
    assert [r.score for r in out.orderBy("x").collect()] == [[1, 2, -1], [2, 4, -2]]


def test_projection_is_the_stored_matrix(spark):
    m = bank.projection(spark, "a", 6, 3).unionByName(bank.projection(spark, "b", 6, 3, seed=1))
    x = np.random.default_rng(3).normal(size=(10, 6)).astype(np.float32)
    df = spark.createDataFrame([("ab"[i % 2], i, v.tolist()) for i, v in enumerate(x)], "sku string, id long, embedding array<float>")
    of = {s: np.array([r.weights for r in m.filter(F.col("sku") == s).orderBy("row").collect()]) for s in "ab"}
    for r in bank.project(df, m).collect():
        assert r.embedding == pytest.approx(x[r.id] @ of[r.sku], abs=1e-5)
    with pytest.raises(ValueError):
        bank.projection(spark, "a", 3, 6)


def test_bank_scores_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4, 3, 3, 5)).astype(np.float32)
    rows = [("a", t, y, c, x[t, y, c].tolist()) for t in range(4) for y in range(3) for c in range(3)]
    grids = spark.createDataFrame(rows, "sku string, tile long, gy int, gx int, embedding array<float>").repartition(5)
    padded = np.pad(x.astype(float), ((0, 0), (1, 1), (1, 1), (0, 0)))
    pool = sum(padded[:, i : i + 3, j : j + 3] for i in range(3) for j in range(3)) / 9
    got = {(r.tile, r.gy, r.gx): r.embedding for r in bank.pooled(grids).collect()}
    assert len(got) == 36 and all(v == pytest.approx(pool[k], abs=1e-6) for k, v in got.items())
    points = bank.fit_banks(grids.filter("tile < 2"), None, 0.3)
    held = np.array([r.embedding for r in points.collect()])
    assert len(held) == round(0.3 * 18)
    for r in bank.score_grids(grids.filter("tile >= 2"), None, points).collect():
        assert r.score == pytest.approx(np.linalg.norm(held - pool[r.tile, r.gy, r.gx], axis=1).min(), abs=1e-5)


def test_products_of_a_large_bank_stay_small():
    rng = np.random.default_rng(5)
    x, points = rng.normal(size=(3000, 4)), rng.normal(size=(9000, 4))
    tracemalloc.start()
    got = neighbours._least(x, points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # all pairs are 216 MB
    assert all(got[i] == pytest.approx(np.linalg.norm(points - x[i], axis=1).min(), abs=1e-12) for i in range(0, 3000, 100))


def test_bank_knows_its_own(spark):
    rng = np.random.default_rng(0)
    rows = [(s, t, y, x, (rng.normal(size=6) + 5 * (s == "b")).astype(float).tolist()) for s in "ab" for t in range(4) for y in range(3) for x in range(3)]
    grids = spark.createDataFrame(rows, "sku string, tile long, gy int, gx int, embedding array<float>")
    points = bank.fit_banks(grids, None, 0.5)
    assert {(r.sku, r.n) for r in points.groupBy("sku").agg(F.count("*").alias("n")).collect()} == {("a", 18), ("b", 18)}
    scores = bank.score_grids(grids, None, points)
    assert scores.count() == 72 and scores.agg(F.min("score")).first()[0] == 0
    far = bank.score_grids(grids.filter("sku = 'a'").withColumn("sku", F.lit("b")), None, points)
    assert far.agg(F.min("score")).first()[0] > scores.agg(F.max("score")).first()[0]


def test_pooling_counts_the_border(spark):
    grid = spark.createDataFrame([("a", 0, y, x, [9.0]) for y in range(3) for x in range(3)], "sku string, tile long, gy int, gx int, embedding array<float>")
    got = {(r.gy, r.gx): r.embedding[0] for r in bank.pooled(grid).collect()}
    assert got[1, 1] == 9 and got[0, 0] == 4 and got[0, 1] == 6


def test_samples_are_nested(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "sku string, id long")
    ids = lambda n: {r.id for r in bank.sample(df, ["sku"], "id", n).collect()}
    assert ids(10) < ids(30) and len(ids(30)) == 30
    assert [r.id for r in bank.evenly_spaced(df, ["sku"], "id", 4).orderBy("id").collect()] == [0, 33, 66, 99]


def test_sweep_and_halves(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 6.0), (2, float("nan")), (3, 7.0)], "point int, v double")
    got = [(r["mean"], r.sd, r.step, r.captured) for r in evaluate.sweep(df, "point", "v").orderBy("point").collect()]
    assert got == [(3, 1, None, 0), (6, 0, 3, 0.75), (7, 0, 1, 1)]
    images = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "code string, image int")
    assert [(r.image, r.half) for r in evaluate.half_split(images, "code", "image").orderBy("image").collect()] == [(0, "fit"), (1, "fit"), (2, "test"), (3, "test"), (4, "test")]


def test_banks_meet_queries_in_pieces(monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 4)
    monkeypatch.setattr(neighbours, "POINTS", 7)
    x = np.random.default_rng(6).normal(size=(120, 3)).astype(np.float32)
    q = x[40:].astype(float)
    for k in range(3):
        want = [min(np.linalg.norm(v - x[j]) for j in range(40) if j % 3 == k) for v in q]
        assert neighbours._least(q, x[:40][k::3].astype(float)) == pytest.approx(want)
    batch = pa.RecordBatch.from_pylist([{"row": i} for i in range(50)])
    cut = list(neighbours._pieces([batch, batch], 9))
    assert max(b.num_rows for b in cut) == 3 and [r["row"] for b in cut for r in b.to_pylist()] == [*range(50)] * 2
