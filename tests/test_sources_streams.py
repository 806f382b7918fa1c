"""Folders of images, stored tables and streams."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscan.functions.sql import register
from rollscan.operators import bank, components, evaluate, neighbours, params, positions, report, tiles, track
from rollscan.plans import queries, views
from rollscan.sources import frames, images, snapshots, store
from rollscan.staging import stage
from rollscan.streaming import live, teach

SF = "/root/testdata/sf0.001"


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_frames_in_natural_order(spark, tmp_path):
    for i in (1, 2, 10, 11):
        png(tmp_path / f"frame{i}.png", np.full((3, 4, 3), (i, 0, 0), np.uint8))
    got = images.read_frames(spark, str(tmp_path), stride=2, fps=10.0).orderBy("frame_index").collect()
    assert [os.path.basename(r.path) for r in got] == ["frame1.png", "frame10.png"]
    assert [(r.frame_index, r.ts_s) for r in got] == [(0, 0.0), (1, 0.2)]
    cells = images.cells(images.read_frames(spark, str(tmp_path)), ["frame_index"], channel=2)  # blue, green, red
    assert cells.filter("frame_index = 3").agg(F.min("value"), F.count("*")).first() == (11.0, 12)


def test_bad_and_missing_frames_are_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        images.read_frames(spark, str(tmp_path))
    (tmp_path / "a.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="cannot decode"):
        images.read_frames(spark, str(tmp_path)).select("frame_index", "image.height").collect()


def test_frame_source_in_batch(spark, tmp_path):
    spark.dataSource.register(frames.RollFrames)
    for i in (1, 2, 3, 9, 10, 11, 100):
        png(tmp_path / f"frame{i}.png", np.full((3, 4, 3), (i, 0, 0), np.uint8))
    (tmp_path / "notes.txt").write_text("x")
    load = lambda **o: spark.read.format("roll_frames").options(**o).load(str(tmp_path))
    want = {(os.path.basename(r.path), r.frame_index, r.ts_s, r.stride) for r in images.read_frames(spark, str(tmp_path), stride=3, fps=10.0).collect()}
    got = load(stride=3, fps=10, framesPerPartition=2)
    assert {(os.path.basename(r.path), r.frame_index, r.ts_s, r.stride) for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == 2 and got.filter("content IS NULL").count() == 0
    with pytest.raises(Exception, match="no file"):
        load(glob="*.bmp").collect()
    (tmp_path / "frame5.png").write_bytes(b"no image")
    assert load(stride=4).count() == 2  # frames that a stride leaves out are not read
    with pytest.raises(Exception, match="cannot read"):
        load().collect()


@pytest.mark.parametrize("loop", [False, True])
def test_frame_source_as_a_stream(spark, tmp_path, loop):
    spark.dataSource.register(frames.RollFrames)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        png(folder / f"f{i}.png", np.zeros((2, 2, 3), np.uint8))
    options = {"fps": 10, "maxFramesPerTrigger": 2, "progress": str(tmp_path / "progress"), "loop": str(loop).lower()}
    seen, sizes = [], []

    def run(upto):
        def take(batch, _):
            rows = [(r.frame_index, os.path.basename(r.path), round(r.ts_s, 3)) for r in batch.select("frame_index", "path", "ts_s").collect()]
            seen.extend(rows)
            sizes.append(len(rows))

        stream = spark.readStream.format("roll_frames").options(**options).load(str(folder))
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).start()
        for _ in range(60):
            q.awaitTermination(0.5)
            if len(set(seen)) >= upto:
                break
        q.stop()

    run(4)
    for i in (5, 6):
        png(folder / f"f{i}.png", np.zeros((2, 2, 3), np.uint8))
    run(16 if loop else 7)
    numbers = sorted({n for n, _, _ in seen})
    assert numbers == list(range(len(numbers))) and len(numbers) >= (16 if loop else 7) and max(sizes) == 2
    if loop:
        assert {(n, p) for n, p, _ in seen if n >= 14} >= {(14, "f0.png"), (15, "f1.png")} and (14, "f0.png", 0.0) in seen
    else:
        assert sorted(set(seen)) == [(i, f"f{i}.png", i / 10) for i in range(7)]
    with pytest.raises(Exception, match="need"):
        frames.FrameStreamReader({"path": str(folder), "loop": "true"})


def test_labelled_names_and_masks(spark):
    names = ["/d/0018_00_01.png", "/d/0020_002_03.png", "/m/0020_002_03_mask1.png", "/m/0020_002_03_mask2.png", "/d/readme.png"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.number: (r.clean, r.fabric, len(r.mask_paths)) for r in images.labelled_images(files).collect()}
    assert got == {18: (True, "01", 0), 20: (False, "03", 2)}
    split = ["/c/train/good/0.png", "/c/test/cut/1.png", "/c/ground_truth/cut/1_mask.png", "/c/test/good/2.png"]
    got = {r.stem: (r.defective, r.mask is not None) for r in images.split_folders(spark.createDataFrame([(n,) for n in split], "path string")).collect()}
    assert got == {"0": (False, False), "1": (True, True), "2": (False, False)}
    assert [r.path for r in images.clean_images(files).orderBy("raw_index").collect() if "/d/" in r.path] == ["/d/0018_00_01.png", "/d/0020_002_03.png", "/d/readme.png"]


def test_rolls_are_replaced_alone(spark, tmp_path):
    root = str(tmp_path / "rolls")
    rows = lambda *r: spark.createDataFrame(r, "sku string, roll_id int, points int")
    store.save_rolls(rows(("a", 1, 5), ("a", 2, 6)), root)
    store.save_rolls(rows(("a", 2, 9)), root)
    assert {(r.roll_id, r.points) for r in store.read_table(spark, root).collect()} == {(1, 5), (2, 9)}
    store.save_rolls(rows(*[("b", i, i) for i in range(40)]), root)
    store.save_rolls(rows(*[("b", i, -1) for i in range(10, 20)], ("c", 1, 1)), root)
    got = {(r.sku, r.roll_id): r.points for r in store.read_table(spark, root).collect()}
    assert got == {("a", 1): 5, ("a", 2): 9, ("c", 1): 1} | {("b", i): -1 if 10 <= i < 20 else i for i in range(40)}
    with pytest.raises(Exception, match="unknown status"):
        store.append_decisions(spark.createDataFrame([(1, 1, "maybe")], "roll_id int, event_id int, status string"), str(tmp_path / "d"))


def test_killed_and_rival_writes_leave_the_table_readable(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "rolls")
    rows = lambda *r: spark.createDataFrame(r, "sku string, roll_id int, points int")
    now = lambda: {(r.roll_id, r.points) for r in store.read_table(spark, root).collect()}
    store.save_rolls(rows(("a", 1, 5), (None, 2, 6)), root)
    held = store.read_table(spark, root)
    with monkeypatch.context() as m:
        m.setattr(snapshots.Snapshots, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.save_rolls(rows(("a", 1, -1)), root)
    assert now() == {(1, 5), (2, 6)}
    table = snapshots.Snapshots(spark, root)
    stale = table.manifest()
    store.save_rolls(rows((None, 2, 7)), root)
    with pytest.raises(snapshots.Conflict):
        table._publish(stale)
    assert now() == {(1, 5), (2, 7)} and {(r.roll_id, r.points) for r in held.collect()} == {(1, 5), (2, 6)}
    table.vacuum(keep=1)
    assert now() == {(1, 5), (2, 7)} and len([d for d in os.listdir(root) if d.startswith("delta")]) == 0
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, str(tmp_path / "none"))


def test_upserts_are_merged_and_written_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 2)
    root, write = str(tmp_path / "events"), store.upsert_events(str(tmp_path / "events"))
    want, most = {}, 0
    for batch in range(12):
        rows = [(1, (batch * 5 + i) % 23, batch) for i in range(6)]
        df = spark.createDataFrame(rows, "roll_id int, event_id int, score int")
        write(df, batch)
        write(df.withColumn("score", F.lit(-1)), batch)  # the batch runs again
        want |= {(r, e): s for r, e, s in rows}
        most = max(most, len(snapshots.Snapshots(spark, root).manifest().deltas))
    assert {(r.roll_id, r.event_id): r.score for r in store.read_table(spark, root).collect()} == want
    assert store.read_table(spark, root).count() == len(want) and most <= snapshots.MOST_DELTAS
    assert snapshots.Snapshots(spark, root).manifest().buckets == 16
    df = spark.createDataFrame([(2, i, 0) for i in range(60)], "roll_id int, event_id int, score int")
    for batch in range(12, 31):
        write(df, batch)
    assert snapshots.Snapshots(spark, root).manifest().buckets == 32 and store.read_table(spark, root).count() == len(want) + 60


def test_stored_documents_are_read_back(spark):
    rolls = spark.createDataFrame([(1, '{"note": "x", "n": 3}'), (2, None)], "roll_id int, meta string")
    assert [r.meta for r in store.roll_documents(rolls).orderBy("roll_id").collect()] == [{"note": "x", "n": "3"}, None]
    assert store.roll_documents(rolls, schema="note string, n int").filter("meta.n = 3").count() == 1


def test_bank_of_another_kind_is_refused(spark, tmp_path):
    meta = bank.bank_meta(spark, [("a", "net", 320, "2,3", 2)])
    points = spark.createDataFrame([("a", 0, [0.0, 1.0])], "sku string, point_id long, embedding array<float>")
    store.save_bank(points, bank.projection(spark, "a", 4, 2), meta, str(tmp_path))
    assert store.load_bank(spark, str(tmp_path), meta)[0].count() == 1
    with pytest.raises(Exception, match="input_size"):
        store.load_bank(spark, str(tmp_path), bank.bank_meta(spark, [("a", "net", 512, "2,3", 2)]))[0].collect()


def test_tables_are_stored_and_read_back(spark, tmp_path):
    cals = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 5), ("b", 3.0, 2)], "sku string, threshold double, fit_timestamp int")
    store.save_calibrations(cals, str(tmp_path / "c"))
    assert {(r.sku, r.threshold) for r in store.latest_calibrations(spark.read.parquet(str(tmp_path / "c"))).collect()} == {("a", 2.0), ("b", 3.0)}
    store.save_csv(cals.coalesce(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    rolls = spark.createDataFrame([(1, 5.0), (2, 6.0)], "roll_id int, length_m double")
    events = spark.createDataFrame([(1, 7, 20.0), (1, 8, 10.0)], "roll_id int, event_id int, along_start_mm double").withColumns({c: F.lit(1.0) for c in ("length_mm", "width_mm", "max_score")}).withColumns({c: F.lit("x") for c in ("assertion", "status")})
    store.save_documents(report.documents(rolls, events), str(tmp_path / "j"))
    got = {d["roll_id"]: [e["event_id"] for e in d.get("events", [])] for d in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "j")).collect()))}
    assert got == {1: [8, 7], 2: []}
    meta = bank.bank_meta(spark, [("a", "net", 320, "2,3", 2)])
    points = spark.createDataFrame([("a", 0, [0.0, 1.0])], "sku string, point_id long, embedding array<float>")
    skus = spark.createDataFrame([("a",)], "sku string")
    own = params.resolved(skus, spark.createDataFrame([("tiling", "size", "512")], "section string, key string, value string"), spark.createDataFrame([], "sku string, section string, key string, value string"))
    store.save_bank(points, bank.projection(spark, "a", 4, 2), meta, str(tmp_path / "bank"), own)
    assert [(r.sku, r.key, r.value) for r in store.load_parameters(spark, str(tmp_path / "bank")).collect()] == [("a", "size", "512")]


def test_masks_are_united(spark):
    cells = lambda *r: spark.createDataFrame(r, "image string, y int, x int, value double")
    got = components.union_masks(cells(("i", 0, 0, 1.0), ("i", 0, 1, 0.0)), cells(("i", 0, 1, 1.0), ("j", 2, 2, 0.0)))
    assert {(r.image, r.y, r.x): r.value for r in got.collect()} == {("i", 0, 0): 1, ("i", 0, 1): 1, ("j", 2, 2): 0}


def test_nearest_distance_forms_agree(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "sku string, id long, embedding array<float>")
    points, queries = df.filter("id < 20").withColumnRenamed("id", "point_id"), df.filter("id >= 20").withColumnRenamed("id", "query_id")
    want = {i: min(np.linalg.norm(x[i].astype(float) - x[j]) for j in range(20)) for i in range(20, 60)}
    as_dict = lambda d: {r.query_id: pytest.approx(r.distance) for r in d.collect()}
    assert as_dict(bank.nearest_distance(queries, points)) == want
    assert as_dict(bank.nearest_distance_sql(queries, points, ["sku"])) == want
    monkeypatch.setattr(bank, "BROADCAST_BYTES", 0)
    assert as_dict(bank.nearest_distance(queries, points)) == want
    q, b = (d.select("embedding", F.lit("a").alias("k"), F.monotonically_increasing_id().alias("row"), "id") for d in (df.filter("id >= 20"), df.filter("id < 20")))
    q = stage(q, "q")
    cells = bank._in_blocks(q, b, block=7).join(q.select("row", "id"), "row")  # several blocks of both sides
    assert {r.id: pytest.approx(r.distance) for r in cells.collect()} == want


def test_pivots_find_the_nearest_with_few_comparisons(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 100, (40, 8))
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 1, (4000, 8))).astype(np.float32)
    x[:1300] = x[0]  # a third of all points are one
    b = spark.createDataFrame([("ab"[i % 5 == 0], v.tolist()) for i, v in enumerate(x)] + [("c", x[5].tolist())], "k string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, k, (v + rng.normal(0, 0.5, 8)).tolist()) for i, (k, v) in enumerate(zip("abcd" * 75, x[rng.integers(0, 4000, 300)]))] + [(8, "b", x[9].tolist())], "row long, k string, embedding array<float>")
    rows = neighbours.nearest(q, b).collect()
    want = sorted((r.row, r.k, round(r.distance, 9)) for r in neighbours._in_blocks(q.filter("row <> 8"), b).collect())
    assert sorted((r.row, r.k, round(r.distance, 9)) for r in rows if r.row != 8) == want and len([r for r in rows if r.row == 8]) == 2
    assert sum(r.compared for r in rows if r.k == "a") < 76 * 3200 / 3
    assert neighbours.nearest(q, b.limit(0)).count() == 0


def test_pair_rows_are_refused_above_their_bound(spark, monkeypatch):
    v = spark.createDataFrame([("a", i, [float(i)]) for i in range(4)], "sku string, query_id long, embedding array<float>")
    monkeypatch.setattr(bank, "MOST_PAIRS", 15)
    with pytest.raises(ValueError, match="too many"):
        bank.nearest_distance_sql(v, v.drop("query_id"), ["sku"])


def test_more_pairs_than_rows_meet_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(80, 6)).astype(np.float32)
    rows = [("ab"[i % 3 == 0], i % 70, v.tolist()) for i, v in enumerate(x)] + [(None, 90, x[0].tolist()), ("c", 91, x[1].tolist()), ("a", 92, None)]
    q = spark.createDataFrame(rows, "sku string, query_id long, embedding array<float>").repartition(3)
    b = q.filter("query_id % 4 = 0 AND sku IS NOT NULL").select("sku", "embedding").union(q.filter("query_id = 92").select("sku", "embedding"))
    got = lambda df: sorted((r.sku, r.query_id, r.distance) for r in df.collect())
    want = got(bank.nearest_distance_sql(q, b, ["sku"]))
    monkeypatch.setattr(bank, "MOST_PAIRS", 15)
    monkeypatch.setattr(bank, "PAIR_ROWS", 15)
    found = bank.nearest_pairs(q, b, ["sku"])
    assert got(found) == want and {r[0] for r in want} == {"a", "b"} and ("a", 92, None) in want
    assert got(bank.nearest_pairs(q.limit(0), b, ["sku"])) == []


@pytest.mark.parametrize("held", [64 << 20, 0])
def test_every_bank_scores_every_query(spark, monkeypatch, held):
    monkeypatch.setattr(bank, "BROADCAST_BYTES", held)
    x = np.random.default_rng(1).normal(size=(90, 5)).astype(np.float32)
    df = spark.createDataFrame([(i % 3, i, v.tolist()) for i, v in enumerate(x)], "sku long, query_id long, embedding array<float>").repartition(3)
    got = {(r.bank_sku, r.query_id): (r.sku, r.own, pytest.approx(r.distance)) for r in evaluate.cross_scores(df.filter("query_id < 30").select(F.col("sku").alias("bank_sku"), "embedding"), df.filter("query_id >= 30")).collect()}
    want = {(s, i): (i % 3, i % 3 == s, min(np.linalg.norm(x[i].astype(float) - x[j]) for j in range(30) if j % 3 == s)) for s in range(3) for i in range(30, 90)}
    assert got == want


@pytest.mark.parametrize("held", [256 << 20, 0])
def test_nearest_distance_keeps_every_query_row(spark, monkeypatch, held):
    monkeypatch.setattr(bank, "BROADCAST_BYTES", held)
    points = spark.createDataFrame([("a", 0, [0.0, 0.0]), ("b", 1, [10.0, 0.0])], "sku string, point_id long, embedding array<float>")
    rows = [("a", 1, [3.0, 4.0]), ("b", 1, [10.0, 1.0]), ("a", 2, [0.0, 2.0]), ("a", 2, [0.0, 2.0]), (None, 3, [0.0, 0.0]), ("c", 4, [0.0, 0.0])]
    queries = spark.createDataFrame(rows, "sku string, query_id long, embedding array<float>").repartition(3)
    got = sorted(((r.query_id, r.distance) for r in bank.nearest_distance(queries, points).collect()), key=str)
    assert got == [(1, 1.0), (1, 5.0), (2, 2.0), (2, 2.0), (3, None), (4, None)]


def test_coreset_covers_its_points(spark):
    x = np.random.default_rng(2).normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "sku string, point_id long, embedding array<float>")
    radius = lambda picks: max(min(np.linalg.norm(p - x[j]) for j in picks) for p in x)
    exact = [r.point_id for r in bank.greedy_coreset(df, 0.1).collect()]
    composed = bank.greedy_coreset(df, 0.1, exact_limit=100).collect()
    assert len(exact) == len(composed) == 30 and {r.method for r in composed} == {"composed"}
    assert radius(exact) < radius(range(30)) and radius([r.point_id for r in composed]) < 1.5 * radius(exact)


def test_coreset_is_the_same_at_every_size(spark):
    x = np.random.default_rng(3).integers(0, 6, (400, 3)).astype(np.float32)  # many ties and equal points
    df = spark.createDataFrame([("ab"[i % 4 == 0], i, v.tolist()) for i, v in enumerate(x)], "sku string, point_id long, embedding array<float>").repartition(3)
    ids = lambda rows: sorted((r.sku, r.point_id) for r in rows.collect())
    for fraction in (0.1, 0.6):
        want = ids(bank.greedy_coreset(df, fraction))
        got = bank.greedy_coreset(df, fraction, exact_limit=150, candidates=32)
        assert {(r.sku, r.method) for r in got.collect()} == {("a", "composed"), ("b", "exact")} and ids(got) == want


def test_coreset_writes_only_the_cells_that_picks_reach(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = (rng.normal(0, 100, (12, 4))[rng.integers(0, 12, 600)] + rng.normal(0, 1, (600, 4))).astype(np.float32)
    points = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "sku string, point_id long, embedding array<float>")
    made = []
    cells = bank._Cells

    class Seen(cells):
        def __init__(self, points):
            super().__init__(points)
            made.append(self)

    monkeypatch.setattr(bank, "_Cells", Seen)
    monkeypatch.setattr(bank, "CELLS", 16)
    got = {r.point_id for r in bank._k_center_rounds(points, 40, 3, 4).collect()}
    assert got == set(bank._k_center(x, 40, 3))
    assert made[0].written and max(made[0].written) < 16 and sum(made[0].written) < 8 * len(made[0].written)


def test_unknown_parameter_is_refused(spark):
    skus = spark.createDataFrame([("a",), ("b",)], "sku string")
    defaults = spark.createDataFrame([("tiling", "size", "512")], "section string, key string, value string")
    own = spark.createDataFrame([("a", "tiling", "size", "256")], "sku string, section string, key string, value string")
    assert {(r.sku, r.value) for r in params.resolved(skus, defaults, own).collect()} == {("a", "256"), ("b", "512")}
    with pytest.raises(Exception, match="unknown key"):
        params.resolved(skus, defaults, own.withColumn("key", F.lit("sise"))).collect()


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT count(*) FROM tile_grid(1080, 1920, 512, 64)").first()[0] == 15
    found = spark.sql("SELECT id % 2 AS sku, conformal_threshold(CAST(id AS DOUBLE), 20D, 0.5D, 10) AS t FROM range(2, 2002) GROUP BY sku ORDER BY sku").collect()
    assert [r.t for r in found] == [1802, 1803]
    assert spark.sql("SELECT conformal_threshold(CAST(id AS DOUBLE), 0.1D, 0.5D, 10) FROM range(20)").first()[0] is None
    frames_of = spark.createDataFrame([(1, 600, 700, "a"), (2, None, 300, "b"), (3, 10, 10, "c"), (4, 256, 300, "d")], "roll int, h int, w int, name string")
    got = spark.sql("SELECT * FROM tiles_of(TABLE(SELECT * FROM {f}), 256, 32)", f=frames_of)
    want = tiles.tile_grid(frames_of.filter("h IS NOT NULL"), 256, 32).drop("size")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() == 11
    for bad in ("tiles_of(TABLE(SELECT 1 AS h), 256, 32)", "tiles_of(TABLE(SELECT 1 AS h, 1 AS w, 2 AS x), 256, 32)", "tiles_of(TABLE(SELECT 1 AS h, 1 AS w), 32, 32)"):
        with pytest.raises(Exception, match="columns h and w|of that name|not valid"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_table_function_lays_out_each_shape_once(spark, tmp_path):
    part = spark.range(4000).select(F.col("id").alias("p_partkey"), (F.col("id") % 3 * 10 + 1).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    laid = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "stage", lambda df, name: laid.append(stage(df, name)) or laid[-1])
        got = queries.QUERIES["tile_grid_sql"](spark, str(tmp_path))
    assert len(laid) == 1 and laid[0].select("h", "w").distinct().count() == 3 and laid[0].count() < 100
    want = queries.QUERIES["tile_grid"](spark, str(tmp_path)).select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_live_positions_equal_batch(spark, tmp_path):
    frames = views.frames(spark, SF).select("roll_id", "frame_index", "ts_s", "measured_mm", "mm_per_px")
    for part in range(3):
        frames.filter(f"frame_index div 40 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    got = []
    state = str(tmp_path / "out")
    stream = live.read_frames(spark, str(tmp_path / "in" / "*"), frames.schema, max_files=1)
    out = live.replay(live.positions_live(stream), str(tmp_path / "checkpoint"), state)
    key = lambda df: {(r.roll_id, r.frame_index): (round(r.along_mm, 6), r.interpolated, r.gap_warning) for r in df.collect()}
    batch = positions.frame_geometry(frames.filter("frame_index < 120"))
    got = key(out)
    assert got and got == key(batch)


def test_live_tracking_equals_batch(spark, tmp_path):
    d = views.detections(spark, SF).filter("roll_id < 6")
    for i, cond in enumerate(("frame_index < 300", "frame_index >= 300")):
        d.filter(cond).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = live.read_frames(spark, str(tmp_path / "in" / "*"), d.schema, max_files=1)
    out = live.replay(live.track_live(stream), str(tmp_path / "c"), str(tmp_path / "o"))
    key = lambda df: {(r.roll_id, r.detection_id): r.event_id for r in df.collect()}
    assert key(out) == key(track.track(d))


def test_live_events_close_as_in_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(1, i % 2, int(f), i, float(a) * 20, float(c) * 30, 40.0, 30.0, float(f), "asserted" if i % 7 == 0 else "uncertain", False) for i, (f, a, c) in enumerate(rng.integers(0, (120, 15, 6), (200, 3)))]
    d = spark.createDataFrame(rows, "sku long, roll_id long, frame_index long, detection_id long, along_mm double, across_mm double, length_mm double, width_mm double, max_score double, assertion string, end_of_roll boolean")
    ends = d.groupBy("sku", "roll_id").agg((F.max("frame_index") + 1).alias("frame_index")).withColumn("end_of_roll", F.lit(True))
    d = d.unionByName(ends, allowMissingColumns=True)
    for i in range(4):
        d.filter(f"frame_index div 32 = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = live.read_frames(spark, str(tmp_path / "in" / "*"), d.schema, max_files=1)
    rows = live.replay(live.events_live(stream), str(tmp_path / "c"), str(tmp_path / "o")).collect()
    closed = [r for r in rows if r.state == "closed"]
    want = track.summarise(track.track(d.filter("detection_id IS NOT NULL"))).collect()
    key = lambda r: (r.roll_id, r.event_id, r.along_start_mm, r.along_end_mm, r.across_start_mm, r.across_end_mm, r.max_score, r.assertion, r.n_frames)
    assert sorted(map(key, closed)) == sorted(map(key, want))
    assert any(r.n_frames > 1 for r in closed) and {r.state for r in rows} == {"open", "closed"}


def states(spark, stream, tmp_path):
    """Rows of a stream over all there is now, and how many rows of state it leaves."""
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "o")).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), q.recentProgress) if p["stateOperators"]]


@pytest.mark.parametrize("what", ["tracks", "positions", "phases"])
def test_nothing_is_kept_of_rolls_that_ended(spark, tmp_path, what):
    if what == "tracks":
        rows = [(1, r, f, f, 35.0 * f, 50.0 * r, 40.0, 10.0, 6.0, "asserted", False) for r in range(3) for f in range(10)] + [(1, r, 10, None, None, None, None, None, None, None, True) for r in range(3)]
        df = spark.createDataFrame(rows, "sku long, roll_id long, frame_index long, detection_id long, along_mm double, across_mm double, length_mm double, width_mm double, max_score double, assertion string, end_of_roll boolean")
        run = live.events_live
    else:
        rows = [(r, f, f / 10, 50.0 * f if f % 3 == 0 else None, 0.2, f == 10) for r in range(3) for f in range(11)]
        df = spark.createDataFrame(rows, "roll_id long, frame_index long, ts_s double, measured_mm double, mm_per_px double, end_of_roll boolean")
        run = live.positions_live if what == "positions" else lambda s: live.live_phases(s, 2, 3)
    for i in range(2):
        df.filter(f"frame_index div 6 = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    rows, kept = states(spark, run(live.read_frames(spark, str(tmp_path / "in" / "*"), df.schema, max_files=1)), tmp_path)
    assert kept[0] >= 3 and kept[-1] == 0
    if what == "tracks":
        assert sorted((r.roll_id, r.event_id, r.n_frames) for r in rows if r.state == "closed") == [(0, 1, 10), (1, 1, 10), (2, 1, 10)]
    else:
        assert len(rows) == 33


def test_live_regions_are_carried(spark, tmp_path):
    f = views.frames(spark, SF).filter("frame_index < 60").select("roll_id", "frame_index", "ts_s", "measured_mm", "mm_per_px", F.lit(1280).alias("frame_w"), F.lit(720).alias("frame_h"), *[F.when(F.col("marked") & (F.col("frame_index") > 15), c).alias(n) for n, c in {"band_x0": F.col("value"), "band_x1": F.col("value") + 40, "band_y0": F.lit(0.0), "band_y1": F.lit(700.0), "marker_px": F.lit(40.0)}.items()])
    for i in range(3):
        f.filter(f"frame_index div 20 = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    out = live.replay(live.positions_live(live.read_frames(spark, str(tmp_path / "in" / "*"), f.schema, max_files=1)), str(tmp_path / "c"), str(tmp_path / "o"))
    got = {(r.roll_id, r.frame_index): (r.x, r.y, r.w, r.h) for r in out.collect()}
    want = {(r.roll_id, r.frame_index): tuple(r.roi) for r in positions.held_roi(f).collect()}
    assert got == want and len({v[0] for v in got.values()}) > 2


def grids_of(spark, frames, roll=1, sku="a", odd=()):
    rng = np.random.default_rng(5)
    rows = [(sku, roll, f, t, y, x, (rng.normal(size=4) + 20 * ((f, t) in odd)).tolist(), False) for f in frames for t in range(3) for y in range(2) for x in range(2)]
    return spark.createDataFrame(rows, "sku string, roll_id long, frame_index long, tile long, gy int, gx int, embedding array<float>, end_of_roll boolean")


def test_taught_stream_inspects(spark, tmp_path):
    plan = teach.Plan(learn=6, calibrate=5, more=5, budget_fa=50.0, metres_per_tile=0.5, margin=4, fraction=0.5, pool=1, hold=True)
    seen = []
    step = teach.teach_calibrate_inspect(str(tmp_path), plan, lambda sku, phase: seen.append((sku, phase)))
    df = grids_of(spark, range(40), odd={(33, 1)})
    step(df.filter("frame_index < 4"), 0)
    step(df.filter("frame_index BETWEEN 4 AND 19"), 1)  # learns from 6, is refused at 5 and accepted at 10, then waits
    step(df.filter("frame_index BETWEEN 4 AND 19"), 1)  # a batch that runs again
    assert seen == [("a", "calibrate"), ("a", "ready")] * 2
    cals = spark.read.parquet(f"{tmp_path}/calibrations").orderBy("n_clean_tiles").collect()
    assert [(r.n_clean_tiles, r.status) for r in cals] == [(15, "unstable_tail"), (30, "ok")]
    step(df.filter("frame_index BETWEEN 20 AND 29"), 2)
    teach.release(spark, str(tmp_path), ["a"])
    step(df.filter("frame_index >= 30"), 3)
    out = spark.read.parquet(f"{tmp_path}/inspected").collect()
    assert {r.frame_index for r in out} == set(range(30, 40)) and len(out) == 30
    assert (33, 1) in {(r.frame_index, r.tile) for r in out if r.assertion == "asserted"}
    with pytest.raises(ValueError, match="while it was being taught"):
        teach.teach_calibrate_inspect(str(tmp_path / "short"), plan)(df.filter("frame_index < 8").withColumn("end_of_roll", F.lit(True)), 0)


def test_stream_reports(spark, tmp_path):
    rows = [(i % 2, i // 2, f"2024-01-01 00:00:{i:02d}", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "roll_id long, frame_index long, t string, score double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.unionByName(df).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.read_frames(spark, str(tmp_path / "in"), df.schema)
    seen = []
    q = live.each_batch(live.minute_scores(stream, "1 second", "5 seconds"), [lambda b, i: seen.extend(b.collect())], str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert seen and all(r.frames <= 3 for r in seen)
    phases = live.replay(live.live_phases(live.read_frames(spark, str(tmp_path / "in"), df.schema).dropDuplicates(["roll_id", "frame_index"]), 2, 3), str(tmp_path / "c2"), str(tmp_path / "o2"))
    assert {r.phase for r in phases.collect() if r.frame_index < 2} == {"learn"} and phases.filter("phase = 'inspect'").count() == 10
    assert live.newest(df.withColumnRenamed("roll_id", "source_id"), ts="ts").select(F.sum("dropped")).first()[0] == 18


def test_sessions_end_after_a_gap(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:{m:02d}:{s:02d}", float(i)) for i, (m, s) in enumerate([(0, 0), (0, 4), (0, 9), (1, 0), (1, 3), (9, 0)])]
    df = spark.createDataFrame(rows, "roll_id long, frame_index long, t string, score double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = live.replay(live.sessions(live.read_frames(spark, str(tmp_path / "in"), df.schema), "10 seconds", "1 second"), str(tmp_path / "c"), str(tmp_path / "o")).collect()
    assert sorted((r.frames, r.max_score) for r in got) == [(2, 4.0), (3, 2.0)]


def test_stalled_source_is_reported(spark, tmp_path):
    schema = "source_id string, frame_index long, end_of_roll boolean"
    spark.createDataFrame([("a", 3, False), ("b", 4, True)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    frames = live.read_frames(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema)
    seen = []
    q = live.stalls(frames, 1000).writeStream.foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    for _ in range(25):
        q.awaitTermination(1)
        if {r.state for r in seen} == {"ended", "stalled"}:
            break
    q.stop()
    assert {(r.source_id, r.state) for r in seen} == {("a", "stalled"), ("b", "ended")}
