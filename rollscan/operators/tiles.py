"""Tiles over frames, and mosaics of their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.functions.grading import refuse


def origins(length: Column, size: Column, overlap: Column, drop_partial: bool = False) -> Column:
    """Tile origins along an axis, a stride of size - overlap apart; the last one is pulled to the edge, or left out."""
    stride = refuse((overlap >= size) | (overlap < 0) | (size <= 0), "the tile size or overlap is not valid", size - overlap)
    plain = F.sequence(F.lit(0), length - size, stride)
    flush = F.array_distinct(F.concat(plain, F.array(length - size)))
    return F.when(length < size, F.array().cast("array<int>")).otherwise(plain if drop_partial else flush)


def dealt(frames: DataFrame, *keys: str) -> DataFrame:
    """frames in as many parts as a shuffle has (by keys, if any): a small file of frames is one task, their tiles are many."""
    return frames.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tile_grid(frames: DataFrame, size: int | Column = 512, overlap: int | Column = 64, drop_partial: bool = False, most: int | None = None) -> DataFrame:
    """Tiles (tile_index in reading order, x, y) of frames (keys, h, w), or the first `most` of each frame. A frame smaller
    than a tile has none."""
    size, overlap = (F.lit(v) if isinstance(v, int) else v for v in (size, overlap))
    both = F.flatten(F.transform(origins(F.col("h"), size, overlap, drop_partial), lambda y: F.transform(origins(F.col("w"), size, overlap, drop_partial), lambda x: F.struct(x.alias("x"), y.alias("y")))))
    both = F.slice(both, 1, most) if most is not None else both
    return frames.select("*", size.alias("size"), F.posexplode(both).alias("tile_index", "at")).select("*", "at.x", "at.y").drop("at")


def fitted(size: int, overlap: int) -> tuple[Column, Column]:
    """Size capped to the image and overlap to size - 1."""
    s = F.least(F.lit(size), F.col("h"), F.col("w"))
    return s, F.least(F.lit(overlap), s - 1)


def metres_per_tile(frames: DataFrame, mm_per_px: Column, size: int, overlap: int, with_roi: bool = True) -> DataFrame:
    """Metres of roll that a tile accounts for: the frame's length over its tiles (one at least), or, where the region of interest
    is not known, a tile's stride. A scale that is not positive is refused."""
    scale = refuse(mm_per_px <= 0, "the scale is not positive", mm_per_px)
    if not with_roi:
        return frames.withColumn("metres_per_tile", (size - overlap) * scale / F.lit(1000.0))
    n = F.size(origins(F.col("h"), F.lit(size), F.lit(overlap))) * F.size(origins(F.col("w"), F.lit(size), F.lit(overlap)))
    return frames.withColumn("n_tiles", n).withColumn("metres_per_tile", F.col("h") * scale / F.lit(1000.0) / F.greatest(F.lit(1), n))


def mosaic(patches: DataFrame, reduce: str = "max") -> DataFrame:
    """A1: one score per cell of a frame from overlapping tiles: the largest, the mean, or that of the last tile, in the type of
    the scores (a mean of whole numbers is cut to one). patches: roll_id, frame_index, tile_index, y, x, score."""
    kinds = {"max": F.max("score"), "mean": F.avg("score"), "last": F.max_by("score", "tile_index")}
    return patches.groupBy("roll_id", "frame_index", "y", "x").agg(kinds[reduce].cast(patches.schema["score"].dataType).alias("score"))


def filled(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """A1: every cell of the frames (roll_id, frame_index, h, w), 0 where no tile reaches. A frame is spread row by row."""
    rows = frames.select("roll_id", "frame_index", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    kinds = dict(cells.dtypes)
    full = rows.select("roll_id", "frame_index", F.col("y").cast(kinds["y"]).alias("y"), F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    full = full.withColumn("x", F.col("x").cast(kinds["x"]))
    met = full.join(cells.hint("merge"), ["roll_id", "frame_index", "y", "x"], "left")
    return met.withColumn("score", F.coalesce("score", F.lit(0).cast(kinds["score"])))


def tile_maxima(patches: DataFrame) -> DataFrame:
    """A2."""
    return patches.groupBy("roll_id", "frame_index", "tile_index").agg(F.max("score").alias("score"))


def footprint_maxima(tiles: DataFrame, cells: DataFrame, bin_px: int = 64) -> DataFrame:
    """The largest mosaic score inside each tile's footprint; single_tile marks frames of one tile, the weaker case.
    Tiles meet cells through bins of rows, so that the range join is an equi join."""
    lo, hi = F.floor(F.col("y") / bin_px), F.floor((F.col("y") + F.col("size") - 1) / bin_px)
    t = tiles.select("roll_id", "frame_index", "tile_index", F.col("x").alias("tx"), F.col("y").alias("ty"), "size", F.explode(F.sequence(lo, hi)).alias("bin"))
    c = cells.withColumn("bin", F.floor(F.col("y") / bin_px))
    inside = F.col("x").between(F.col("tx"), F.col("tx") + F.col("size") - 1) & F.col("y").between(F.col("ty"), F.col("ty") + F.col("size") - 1)
    out = c.join(t.hint("merge"), ["roll_id", "frame_index", "bin"]).filter(inside).groupBy("roll_id", "frame_index", "tile_index").agg(F.max("score").alias("score"))
    return out.withColumn("single_tile", F.count("*").over(Window.partitionBy("roll_id", "frame_index")) == 1)


def defective_tiles(tiles: DataFrame, mask: DataFrame, bin_px: int = 64) -> DataFrame:
    """Tiles whose area holds a mask cell (a semi join on binned rows). Keys: roll_id, frame_index."""
    lo, hi = F.floor(F.col("y") / bin_px), F.floor((F.col("y") + F.col("size") - 1) / bin_px)
    t = tiles.withColumn("bin", F.explode(F.sequence(lo, hi))).alias("t")
    m = mask.select("roll_id", "frame_index", F.col("y").alias("my"), F.col("x").alias("mx"), F.floor(F.col("y") / bin_px).alias("bin")).alias("m")
    same = (F.col("t.roll_id") == F.col("m.roll_id")) & (F.col("t.frame_index") == F.col("m.frame_index")) & (F.col("t.bin") == F.col("m.bin"))
    inside = F.col("mx").between(F.col("x"), F.col("x") + F.col("size") - 1) & F.col("my").between(F.col("y"), F.col("y") + F.col("size") - 1)
    return t.join(m.hint("merge"), same & inside, "left_semi").drop("bin").distinct()


def detection_hits(detections: DataFrame, mask: DataFrame) -> DataFrame:
    """Whether a detection's box holds a truth cell. Boxes expand to their rows. Keys: roll_id, frame_index, component."""
    rows = detections.select("roll_id", "frame_index", "component", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y"))
    met = mask.select("roll_id", "frame_index", "y", F.col("x").alias("mx")).join(rows.hint("merge"), ["roll_id", "frame_index", "y"]).filter("mx BETWEEN x0 AND x1")
    hits = met.select("roll_id", "frame_index", "component").distinct().withColumn("hit", F.lit(True))
    return detections.join(hits.hint("merge"), ["roll_id", "frame_index", "component"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def peak_in_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """For each frame whether the cell of its largest score (the first in reading order) is a truth cell, and the mean score on
    the truth over the mean off it (1e-6 at least). Frames without a truth cell are left out. cells: roll_id, frame_index, y, x,
    score; mask: roll_id, frame_index, y, x."""
    on = mask.select("roll_id", "frame_index", "y", "x").distinct().withColumn("on", F.lit(True))
    c = cells.join(on.hint("merge"), ["roll_id", "frame_index", "y", "x"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    place = F.struct(F.col("score"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    part = lambda which: F.avg(F.when(which, F.col("score")))
    g = c.groupBy("roll_id", "frame_index").agg(F.max_by("on", place).alias("peak_inside"), part(F.col("on")).alias("mean_on"), part(~F.col("on")).alias("mean_off"))
    return g.filter("mean_on IS NOT NULL").withColumn("separation", F.col("mean_on") / F.greatest("mean_off", F.lit(1e-6)))


def roi_cells(cells: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The cells inside a region, re-based to it."""
    inside = cells.filter((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def strided_cells(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th cell of both axes."""
    return cells.filter((F.col("x") % step == 0) & (F.col("y") % step == 0))


def first_tiles(tiles: DataFrame, n: int) -> DataFrame:
    """The first n tiles of each roll in reading order."""
    w = Window.partitionBy("roll_id").orderBy("frame_index", "tile_index")
    return tiles.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
