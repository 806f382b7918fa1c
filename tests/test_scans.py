"""Ordered work over ranges, order statistics by sketch and band, components of pair graphs: against plain loops."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_frames import DET, chosen

from rollscan import staging
from rollscan.operators import graph, positions, ranks, scan, track


def located(rows, fallback=0.04, max_gap_mm=250.0, max_gap_s=2.0):
    """frame_geometry of one roll, frame by frame."""
    out, at, speed, scale = {}, None, fallback, 1.0
    for i, (f, s, mm, px) in enumerate(rows):
        if mm is not None:
            if at and s > at[1]:
                speed = (mm - at[0]) / (s - at[1])
            at, scale = (mm, s), px if px is not None else scale
            out[f] = (mm, scale, False, False, True)
            continue
        scale = px if px is not None else scale
        if i == 0 and fallback is not None:
            at = (0.0, s)
        if at is None:
            out[f] = (None, scale, True, False, False)
            continue
        advance = None if speed is None else speed * (s - at[1])
        gap = s - at[1] > max_gap_s if advance is None else advance > max_gap_mm
        out[f] = (at[0] + (advance or 0.0), scale, True, gap, True)
    return out


@pytest.mark.parametrize("fallback", [0.04, None])
@pytest.mark.parametrize("marks", [0.02, 0.5])
def test_positions_of_one_roll_in_many_ranges(spark, fallback, marks):
    rng = np.random.default_rng(int(marks * 100))
    n = 400
    ts = np.cumsum(rng.integers(0, 3, n)) / 10.0  # some frames share a time
    rows = [(f, float(ts[f]), float(f * 40 + rng.normal()) if rng.random() < marks else None, None) for f in range(n)]
    rows = [(f, s, mm, 0.2 + f / 1e4 if mm is not None else None) for f, s, mm, _ in rows]
    more = [(7, f, s, mm, px) for f, s, mm, px in rows] + [(None, 0, 0.0, None, None), (None, 1, 5.0, 3.0, 0.1), (8, 0, 1.0, 2.0, 0.3)]
    df = spark.createDataFrame(more, "roll_id long, frame_index long, ts_s double, measured_mm double, mm_per_px double").repartition(3)
    for parts in (1, 23):
        got = {(r.roll_id, r.frame_index): (r.along_mm, r.scale, r.interpolated, r.gap_warning, r.placed) for r in positions.frame_geometry(df, fallback, parts=parts).collect()}
        want = {(7, f): v for f, v in located(rows, fallback).items()} | {(8, 0): (2.0, 0.3, False, False, True)}
        want |= {(None, f): v for f, v in located([(0, 0.0, None, None), (1, 5.0, 3.0, 0.1)], fallback).items()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k][1:] == v[1:] and got[k][0] == (pytest.approx(v[0], abs=1e-9) if v[0] is not None else None), k


def test_places_and_steps_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else int(g), int(i), float(v)) for i, (g, v) in enumerate(zip(rng.choice([0, 1, 2, 3], 500, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 50, 500)))]
    df = spark.createDataFrame(rows, "g int, i int, v double").repartition(5)
    by = {}
    for g, i, v in rows:
        by.setdefault(g, []).append((i, v))
    want = {(g, i): (k + 1, held[k - 1][1] if k else None) for g, held in by.items() for k, (i, _) in enumerate(held)}
    numbered = scan.row_numbers(df, ["g"], ["i"], "place")
    assert {(r.g, r.i): r.place for r in numbered.collect()} == {k: v[0] for k, v in want.items()}
    assert {(r.g, r.i): r.b for r in scan.lagged(df, ["g"], ["i"], "v", "b").collect()} == {k: v[1] for k, v in want.items()}
    assert scan.row_numbers(df.limit(0), ["g"], ["i"], "place").count() == 0


def test_order_statistics_of_any_group(spark):
    rng = np.random.default_rng(3)
    parts = {"even": rng.normal(size=30_000), "tied": rng.integers(0, 5, 20_000).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "same": np.full(9000, 7.0), "heavy": np.exp(rng.normal(0, 4, 9000))}
    rows = [(k, float(v)) for k, x in parts.items() for v in x] + [("nan", float("nan")), ("nan", 1.0), ("nan", 2.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    sorted_parts = {k: np.sort(x) for k, x in parts.items()} | {"nan": np.array([1.0, 2.0, np.nan]), None: np.array([3.0]), "none": np.array([])}
    groups = ranks.sketched(df, ["k"], "v")
    n = F.col("n")
    wanted = F.array(F.lit(1), F.ceil(n * 0.01), F.ceil(n / 2), F.ceil(n * 0.995), n, n + 1)
    for r in ranks.at_ranks(df, ["k"], "v", groups, wanted).collect():
        x = sorted_parts[r.k]
        assert r.n == len(x)
        places = [1, int(np.ceil(len(x) * 0.01)), int(np.ceil(len(x) / 2)), int(np.ceil(len(x) * 0.995)), len(x), len(x) + 1]
        for p, v in zip(places, r.found):
            assert (v is None) if not 1 <= p <= len(x) else (v == x[p - 1] or (np.isnan(v) and np.isnan(x[p - 1]))), (r.k, p)
    for r in ranks.interpolated(df.filter("k NOT IN ('nan', 'none')"), ["k"], "v", [0.5, 0.985, 0.0, 1.0], F.max("v").alias("top")).collect():
        assert list(r["at"]) == pytest.approx(list(np.quantile(sorted_parts[r.k], [0.5, 0.985, 0.0, 1.0]))) and r.top == sorted_parts[r.k][-1]
    whole = ranks.interpolated(df, [], "v", [0.5]).first()
    assert whole["at"][0] == np.quantile(np.concatenate([*parts.values(), [1.0, 2.0, 3.0, np.inf]]), 0.5)


def test_scratch_tables_go(spark):
    def held():
        return set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))

    before = held()
    with pytest.raises(ZeroDivisionError), staging.scratch(spark):
        kept = staging.stage(spark.range(3), "kept", lasting=True)
        with staging.scratch(spark):
            assert staging.stage(spark.range(5), "inner").count() == 5
        outer = staging.stage(spark.range(4), "outer")
        assert outer.count() == 4 and len(held() - before) == 2
        raise ZeroDivisionError
    assert kept.count() == 3 and [n.split("-")[0] for n in held() - before] == ["kept"]


def test_components_of_pairs(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(0, 300)] + [(i, i + 2) for i in range(400, 480)]
    edges = chain + [tuple(map(int, e)) for e in rng.integers(500, 900, (150, 2))]
    rng.shuffle(edges)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long").repartition(7)
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(int(a)), root(int(b))))
        up[y] = x
    assert {r.node: r.component for r in graph.connected(df).collect()} == {i: root(i) for i in list(up)}
    assert graph.connected(df.limit(0)).count() == 0


def test_events_are_numbered_over_blocks_of_frames(spark, monkeypatch):
    monkeypatch.setattr(track, "FRAMES", 16)
    rng = np.random.default_rng(8)
    n = 500
    rows = [(1, 1, int(f), i, float(a) * 40, float(c) * 90, 60.0, 40.0, 6.0, "asserted") for i, (f, a, c) in enumerate(zip(np.sort(rng.integers(-40, 300, n)), rng.integers(0, 60, n), rng.integers(0, 12, n)))]
    d = spark.createDataFrame(rows + [(1, 2, 5, 0, 0.0, 0.0, 60.0, 40.0, 6.0, "asserted")], DET)
    tracked = track.track(d, blocks=True)
    kept = tracked.collect()
    got = {r.detection_id: r.event_id for r in kept if r.roll_id == 1}
    assert got == chosen([(r[2], r[3], r[4:8]) for r in rows]) and len(kept) == n + 1
    assert {r.event_id for r in kept if r.roll_id == 2} == {1}
    own = lambda f: f - f % 16
    assert any(r._block != own(r.frame_index) for r in kept)  # some events go over a border
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    assert as_rows(track.summarise(tracked, ("_block",))) == as_rows(track.summarise(track.track(d)))
    plan = track.summarise(tracked, ("_block",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the sums need no other


def test_a_roll_without_gaps_is_tracked_in_parts(spark):
    rng = np.random.default_rng(6)
    n = 700
    rows = [(1, 1, int(f), i, float(a) * 40, float(c) * 90, 60.0, 40.0, 6.0, "asserted") for i, (f, a, c) in enumerate(zip(np.sort(rng.integers(0, 350, n)), rng.integers(0, 60, n), rng.integers(0, 12, n)))]
    d = spark.createDataFrame(rows, DET)
    got = {r.detection_id: r.event_id for r in track.track(d).collect()}
    assert got == chosen([(r[2], r[3], r[4:8]) for r in rows])
    ids = d.withColumn("_id", F.col("detection_id"))
    groups = graph.connected(track.partners(ids, 0.3, 50.0, 2))
    assert groups.select("component").distinct().count() > 20
    segments = track.segments(d).select("segment").distinct().count()
    assert segments < 5
