"""Positions, tiles, components, tracking."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rollscan.operators import components, positions, raster, scan, tiles, track


def test_marker_scale_and_position(spark):
    square = [(50.0, 50.0), (250.0, 50.0), (250.0, 250.0), (50.0, 250.0)]
    df = spark.createDataFrame([(1, 0, 7, [Row(x=x, y=y) for x, y in square], 0.0)], "roll_id int, frame_index int, marker_id int, corners array<struct<x: double, y: double>>, top_y_px double")
    r = positions.marker_geometry(df).first()
    assert (r.mm_per_px, r.along_mm, r.marker_ids) == (0.2, 700.0, [7])


def test_drop_outs(spark):
    rows = [(1, 0, 0.0, 700.0, 0.2), (1, 1, 0.05, None, None), (1, 2, 60.0, None, None), (1, 3, 61.0, 900.0, 0.2)]
    df = spark.createDataFrame(rows, "roll_id int, frame_index long, ts_s double, measured_mm double, mm_per_px double")
    got = positions.frame_geometry(df, fallback_speed=None).orderBy("frame_index").collect()
    assert [r.gap_warning for r in got] == [False, False, True, False]
    assert [r.interpolated for r in got] == [False, True, True, False]
    none = positions.frame_geometry(df.filter("frame_index = 1"), fallback_speed=None).first()
    assert not none.placed and none.along_mm is None


def test_tile_grid(spark):
    frame = spark.createDataFrame([(1, 1080, 1920), (2, 512, 1856), (3, 100, 100)], "roll_id int, h int, w int")
    got = tiles.tile_grid(frame, 512, 64).collect()
    one = [(r.x, r.y) for r in sorted(got, key=lambda r: r.tile_index) if r.roll_id == 1]
    assert one == [(x, y) for y in (0, 448, 568) for x in (0, 448, 896, 1344, 1408)]
    assert len([r for r in got if r.roll_id == 2]) == 4
    assert not [r for r in got if r.roll_id == 3]
    with pytest.raises(Exception, match="not valid"):
        tiles.tile_grid(frame, 64, 64).collect()


def flooded(hot):
    """First cell of the component of every hot cell, by flooding."""
    out = {}
    for start in sorted(hot):
        if start not in out:
            todo = [start]
            while todo:
                y, x = todo.pop()
                if (y, x) in hot and (y, x) not in out:
                    out[y, x] = start
                    todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


@pytest.mark.parametrize("band", [256, 8, 1])
def test_component_labels_are_those_of_flooding(spark, band):
    rng = np.random.default_rng(3)
    values = {(f, y, x): float(v) for f in (0, 1) for (y, x), v in np.ndenumerate(rng.random((40, 70)))}
    cells = spark.createDataFrame([(1, *k, v) for k, v in values.items()], "roll_id int, frame_index int, y int, x int, score double")
    got = {(r.frame_index, r.y, x): tuple(r.component) for r in components.label_runs(components.runs(cells, 0.55), band).collect() for x in range(r.x0, r.x1 + 1)}
    want = {(f, *at): c for f in (0, 1) for at, c in flooded({(y, x) for (g, y, x), v in values.items() if g == f and v > 0.55}).items()}
    assert got == want


def test_touching_runs_are_found_once(spark):
    rng = np.random.default_rng(8)
    rows = [(1, 0, y, int(x), int(x + w)) for y in range(6) for x, w in zip(np.arange(20) * 45 + rng.integers(0, 15, 20), rng.integers(0, 28, 20))]
    r = spark.createDataFrame(rows, "roll_id int, frame_index int, y int, x0 int, x1 int").withColumn("run", F.struct("y", "x0"))
    got = sorted((tuple(p.a), tuple(p.b)) for p in components.adjacent(r, 16).collect())
    assert got == sorted(((a[2], a[3]), (b[2], b[3])) for a in rows for b in rows if b[2] == a[2] + 1 and a[3] <= b[4] + 1 and b[3] <= a[4] + 1)


def test_blob_becomes_a_detection(spark):
    rows = [(1, 0, y, x, 6.0 if 100 <= y < 200 and 50 <= x < 80 else 0.0) for y in range(90, 210) for x in range(40, 90)]
    cells = spark.createDataFrame(rows, "roll_id int, frame_index int, y int, x int, score double")
    lab = components.label_runs(components.runs(cells, 3.0))
    stats = components.component_stats(cells, lab, min_area=2)
    geometry = spark.createDataFrame([(1, 0, 1000.0, 0.1)], "roll_id int, frame_index int, along_mm double, mm_per_px double")
    d = components.detections(components.extents(cells, lab, stats), stats, geometry).collect()
    assert len(d) == 1
    whole = components.detections(components.extents(cells, lab, stats, rule="threshold"), stats, geometry).first()
    assert (whole.length_mm, whole.width_mm, whole.mean_score) == (d[0].length_mm, d[0].width_mm, 6.0)
    assert (d[0].length_mm, d[0].width_mm, d[0].along_mm) == (pytest.approx(10), pytest.approx(3), pytest.approx(1010))


DET = "sku long, roll_id long, frame_index long, detection_id long, along_mm double, across_mm double, length_mm double, width_mm double, max_score double, assertion string"


def detections(spark, rows):
    return spark.createDataFrame([(1, 1, f, i, a, c, 40.0, 10.0, 6.0, "asserted") for i, (f, a, c) in enumerate(rows)], DET)


def test_fragments_join(spark):
    d = detections(spark, [(i, 1000.0 + 35 * i, 50.0) for i in range(8)])
    e = track.summarise(track.track(d)).collect()
    assert len(e) == 1 and e[0].n_frames == 8 and e[0].along_end_mm - e[0].along_start_mm == 285
    assert track.track(d, iou_threshold=0).select("event_id").distinct().count() == 8


def test_far_and_dropped_out(spark):
    assert track.track(detections(spark, [(0, 1000.0, 50.0), (1, 1000.0, 900.0)])).select("event_id").distinct().count() == 2
    assert track.track(detections(spark, [(0, 1000.0, 50.0), (2, 1070.0, 50.0)])).select("event_id").distinct().count() == 1


def test_tracking_components_apart_changes_nothing(spark):
    rng = np.random.default_rng(5)
    rows = sorted((int(f), float(rng.integers(0, 4000)), float(rng.integers(0, 200))) for f in rng.integers(0, 300, 150))
    d = detections(spark, rows)
    groups = lambda df: {frozenset(g) for g in df.toPandas().groupby("event_id")["detection_id"].apply(list)}
    assert groups(track.track(d)) == groups(track.track(d, apart=False))


def chosen(rows, iou_threshold=0.3, join_mm=50.0, max_gap=2):
    """Event of each detection of one roll, found pair by pair."""

    def worth(a, b):
        along = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        across = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        both = max(0.0, along) * across
        iou = both / (a[2] * a[3] + b[2] * b[3] - both)
        return max(iou, 1e-6) if iou >= iou_threshold or (across / min(a[3], b[3]) >= iou_threshold and -along <= join_mm) else 0

    out, made, tracks = {}, 0, {}
    for frame in sorted({f for f, *_ in rows}):
        late = {}
        for _, i, box in sorted(r for r in rows if r[0] == frame):
            fits = [(worth(b, box), -e) for e, (f, b) in tracks.items() if 0 < frame - f <= max_gap + 1 and worth(b, box)]
            if fits:
                out[i] = -max(fits)[1]
                tracks[out[i]] = (frame, box)
            else:
                out[i] = made = made + 1
                late[made] = (frame, box)
        tracks |= late
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tracking_equals_every_pair_compared(spark, seed):
    rng = np.random.default_rng(seed)
    n = 260
    rows = [(1, int(r), int(f), i, float(a), float(c), float(h), float(w), 6.0, "asserted") for i, (r, f, a, c, h, w) in enumerate(zip(rng.integers(0, 2, n), rng.integers(0, 60, n), rng.integers(0, 12, n) * 30, rng.integers(0, 8, n) * 10, rng.integers(1, 7, n) * 20, rng.integers(1, 4, n) * 15))]
    rows += [(None, 1, 3, n, 0.0, 0.0, 1.0, 1.0, 6.0, "asserted")]
    got = {(r.roll_id, r.detection_id): r.event_id for r in track.track(spark.createDataFrame(rows, DET)).collect()}
    want = {(roll, i): e for roll in (0, 1) for i, e in chosen([(r[2], r[3], r[4:8]) for r in rows if r[1] == roll and r[0]]).items()}
    assert got == want and max(want.values()) < len(want) / 4


def mirrored(x, r):
    return np.pad(x, r, mode="reflect")


def blurred(x, sigma, r):
    w = np.array(raster.kernel(sigma, r))
    p = mirrored(x, r)
    p = sum(w[i] * p[:, i : i + x.shape[1]] for i in range(2 * r + 1))
    return sum(w[i] * p[i : i + x.shape[0]] for i in range(2 * r + 1))


@pytest.mark.parametrize("block", [256, 4])
def test_flat_field_and_upsampling_are_those_of_arrays(spark, monkeypatch, block):
    monkeypatch.setattr(raster, "BLOCK", block)
    x = np.random.default_rng(2).integers(20, 200, (14, 16)).astype(float)
    cells = spark.createDataFrame([(1, 0, y, c, float(v)) for (y, c), v in np.ndenumerate(x)], "roll_id int, frame_index int, y int, x int, value double")
    flat = x / np.maximum(1, blurred(x, 3.0, 1))
    want = np.clip(flat * x.mean() / max(1e-6, flat.mean()), 0, 255)
    for r in raster.flat_field(cells, 3.0).collect():
        assert abs(r.value - want[r.y, r.x]) < 1.001 and r.value <= want[r.y, r.x] + 1e-9
    at = lambda n: np.clip((np.arange(3 * n) + 0.5) / 3 - 0.5, 0, n - 1)
    rows = np.array([np.interp(at(16), np.arange(16), row) for row in x])
    big = np.array([np.interp(at(14), np.arange(14), col) for col in rows.T]).T
    got = {(r.y, r.x): r.value for r in raster.upsampled(cells, 3, 1.5).collect()}
    smooth = blurred(big, 1.5, 4)
    assert len(got) == 42 * 48 and all(v == pytest.approx(smooth[k], abs=1e-9) for k, v in got.items())


def test_tiles_of_small_frames_and_scales(spark):
    df = spark.createDataFrame([(1, 40, 100), (2, 300, 300)], "roll_id int, h int, w int")
    got = tiles.tile_grid(df, *tiles.fitted(64, 60)).groupBy("roll_id", "size").agg(F.count("*").alias("n")).collect()
    assert {(r.roll_id, r["size"], r.n) for r in got} == {(1, 40, 61), (2, 64, 60 * 60)}
    assert {r.metres_per_tile for r in tiles.metres_per_tile(df, F.lit(0.5), 64, 32, with_roi=False).collect()} == {0.016}
    with pytest.raises(Exception, match="not positive"):
        tiles.metres_per_tile(df, F.lit(0.0), 64, 32).collect()
    whole = spark.createDataFrame([(1, 0, t, 0, 0, v) for t, v in enumerate((1, 2, 2))], "roll_id int, frame_index int, tile_index int, y int, x int, score int")
    assert tiles.mosaic(whole, "mean").first().score == 1


def test_flat_field_keeps_a_flat_frame(spark):
    cells = spark.createDataFrame([(1, 0, y, x, 100.0) for y in range(12) for x in range(12)], "roll_id int, frame_index int, y int, x int, value double")
    assert {r.value for r in raster.flat_field(cells, 3.0).collect()} <= {99, 100}
    assert raster.upsampled(cells, 2, 0).agg(F.min("value"), F.max("value"), F.count("*")).first() == (pytest.approx(100), pytest.approx(100), 576)


def test_flat_field_does_not_cut_a_whole_number_for_its_last_digit(spark):
    cells = spark.createDataFrame([(1, 0, y, x, 0.29 * 100) for y in range(12) for x in range(12)], "roll_id int, frame_index int, y int, x int, value double")
    assert 0.29 * 100 < 29 and {r.value for r in raster.flat_field(cells, 5.0).collect()} == {29}


def test_first_tiles_of_frames_are_those_of_all_tiles(spark):
    df = tiles.dealt(spark.createDataFrame([(i, 100 + 7 * i, 90 + 11 * i) for i in range(9)], "roll_id int, h int, w int").coalesce(1), "roll_id")
    assert df.rdd.getNumPartitions() == 4
    rows = lambda t: sorted(map(tuple, t.collect()))
    whole = tiles.tile_grid(df, 64, 16)
    assert rows(tiles.tile_grid(df, 64, 16, most=3)) == rows(whole.filter("tile_index < 3")) != rows(whole)
    first = lambda t: tiles.first_tiles(t.withColumn("frame_index", F.lit(0)), 3)
    assert rows(first(tiles.tile_grid(df, 64, 16, most=3))) == rows(first(whole))


def test_lane_runs_need_no_numbers_and_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 1)
    assert scan.clustered(spark.range(9), ["id"]).rdd.getNumPartitions() == 9
    rows = [(1, 1, 0.0, 5.0, 40.0, 3.0), (1, 1, 0.0, 5.0, 40.0, 9.0), (1, 1, 90.0, 5.0, 10.0, 1.0), (1, 1, 151.0, 5.0, 10.0, 2.0), (1, 1, 151.0, 5.0, 10.0, 4.0)]
    d = spark.createDataFrame(rows, "sku int, roll_id int, along_mm double, across_mm double, length_mm double, max_score double")
    got = track.lane_runs(d)
    assert sorted((r.run, r.along_start_mm, r.along_end_mm, r.max_score, r.n_detections) for r in got.collect()) == [(0, 0, 100, 9, 3), (1, 151, 161, 4, 2)]
