"""Raster operations on tables of cells (roll_id, frame_index, y, x, value): windows, joins, and blocks with copied borders."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollscan.staging import sized, stage

FRAME = ["roll_id", "frame_index"]


def display(cells: DataFrame) -> DataFrame:
    """Scores of a frame stretched to 0..1; 0 where it is flat."""
    w = Window.partitionBy(*FRAME)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return cells.withColumn("shown", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(0.0)))


def sharpness(cells: DataFrame) -> DataFrame:
    """Variance of the 4-neighbour Laplacian (borders mirrored) and mean value of each frame of a full grid."""
    row, col = Window.partitionBy(*FRAME, "y").orderBy("x"), Window.partitionBy(*FRAME, "x").orderBy("y")
    left, right, up, down = F.lag("value").over(row), F.lead("value").over(row), F.lag("value").over(col), F.lead("value").over(col)
    pair = lambda a, b: F.coalesce(a, b, F.col("value")) + F.coalesce(b, a, F.col("value"))
    lap = pair(left, right) + pair(up, down) - 4 * F.col("value")
    return cells.withColumn("lap", lap).groupBy(*FRAME).agg(F.var_pop("lap").alias("focus"), F.avg("value").alias("brightness"))


def central(cells: DataFrame) -> DataFrame:
    """The cells of the middle three fifths of both axes of each frame (h // 5 to 4 h // 5), whose mean is the brightness that
    markers at the edge do not move. cells: FRAME, y, x, value of full frames."""
    w = Window.partitionBy(*FRAME)
    inside = [F.col(a).between(F.floor((F.max(a).over(w) + 1) / 5), F.floor(4 * (F.max(a).over(w) + 1) / 5) - 1) for a in ("y", "x")]
    return cells.withColumn("_in", inside[0] & inside[1]).filter("_in").drop("_in")


def marker_sharpness(cells: DataFrame, boxes: DataFrame, pad: int = 12, least: int = 8) -> DataFrame:
    """The median over a frame's markers of the sharpness of their crops: boxes (FRAME, marker_id, x0, y0, x1, y1, the ends
    outside) grown by pad and clipped to the frame; crops of `least` pixels or fewer on a side do not count."""
    edge = cells.groupBy(*FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    b = stage(boxes, "boxes").join(edge.hint("merge"), FRAME).select(*FRAME, "marker_id", *[F.greatest(F.lit(0), F.col(c) - pad).cast("int").alias(c) for c in ("x0", "y0")], F.least("w", F.col("x1") + pad).cast("int").alias("x1"), F.least("h", F.col("y1") + pad).cast("int").alias("y1"))
    b = b.filter((F.col("x1") - F.col("x0") > least) & (F.col("y1") - F.col("y0") > least))
    rows = b.select(*FRAME, "marker_id", "x0", "x1", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    crops = cells.join(rows.hint("merge"), [*FRAME, "y"]).filter("x >= x0 AND x < x1")
    # each crop is an image of its own, mirrored at its own borders
    named = crops.select(F.col("roll_id"), F.struct("frame_index", "marker_id").alias("frame_index"), "y", "x", "value")
    focus = sharpness(named).select("roll_id", F.col("frame_index.frame_index").alias("frame_index"), "focus")
    return focus.groupBy(*FRAME).agg(F.median("focus").alias("marker_focus"), F.count("*").alias("markers"))


def fabric_extent(columns: DataFrame, bright: float = 200.0, inset: int = 24) -> DataFrame:
    """The widest run of columns whose mean is at most `bright`, the first of equal ones, drawn in by `inset`; the full width
    where there is none. columns: image, x, mean."""
    w = Window.partitionBy("image").orderBy("x")
    r = columns.filter(F.col("mean") <= bright).withColumn("island", F.col("x") - F.row_number().over(w))
    r = r.groupBy("image", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    best = r.groupBy("image").agg(F.max_by(F.struct("x0", "x1"), F.struct((F.col("x1") - F.col("x0")).alias("n"), (-F.col("x0")).alias("f"))).alias("b"))
    full = columns.groupBy("image").agg(F.min("x").alias("f0"), F.max("x").alias("f1"))
    cut = F.col("b.x1") - F.col("b.x0") > 2 * inset
    pick = lambda a, f, d: F.when(F.col("b").isNull(), F.col(f)).when(cut, F.col(a) + d).otherwise(F.col(a))
    return full.join(best, "image", "left").select("image", pick("b.x0", "f0", inset).alias("x0"), pick("b.x1", "f1", -inset).alias("x1"))


def kernel(sigma: float, radius: int) -> list[float]:
    """Weights of a one-dimensional Gaussian, adding to 1."""
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


#: Cells on a side of a block.
BLOCK = 256


def _in_blocks(cells: DataFrame, size: int, halo: int) -> DataFrame:
    """cells (FRAME, y, x and more) with the last row and column of their frame (_my, _mx) and their block (_by, _bx); cells within
    `halo` of another block go to that one too."""
    edge = stage(cells.groupBy(*FRAME).agg(F.max("y").alias("_my"), F.max("x").alias("_mx")), "frames")
    met = cells.join(sized(edge), FRAME)
    for a, last, name in (("y", "_my", "_by"), ("x", "_mx", "_bx")):
        near = F.sequence(F.floor(F.greatest(F.lit(0), F.col(a) - halo) / size), F.floor(F.least(F.col(last), F.col(a) + halo) / size))
        met = met.withColumn(name, F.explode(near))
    return met


def _mirrored(at: np.ndarray, last: int) -> np.ndarray:
    """Places beyond the ends 0 and last, mirrored as ...c b | a b c..., as often as it takes."""
    fold = at % max(1, 2 * last)
    return np.minimum(fold, 2 * last - fold)


def _dense(table: pa.Table, value: str) -> tuple[np.ndarray, int, int]:
    """A block's cells as an array, and the row and column it begins at."""
    y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
    y0, x0 = int(y.min()), int(x.min())
    out = np.full((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.nan)
    out[y - y0, x - x0] = table.column(value).to_numpy().astype(float)
    return out, y0, x0


def _smooth(block: np.ndarray, rows: list[np.ndarray], columns: list[np.ndarray], weights: list[float]) -> np.ndarray:
    """A kernel along x, then along y. rows, columns: for each weight the places in block that it falls on."""
    across = sum((w * block[:, c] for w, c in zip(weights, columns)), np.zeros(()))
    return sum((w * across[r] for w, r in zip(weights, rows)), np.zeros(()))


def gaussian(cells: DataFrame, sigma: float, radius: int, value: str = "value") -> DataFrame:
    """Separable smoothing of full grids: along x, then along y, block by block with a border of `radius` cells copied from the
    blocks around. Borders of the frame are mirrored. A task holds one block."""
    weights, kept, size = kernel(sigma, radius), cells.columns, BLOCK
    blocks = _in_blocks(cells.withColumn(value, F.col(value).cast("double")), size, radius)
    schema = StructType([f for f in blocks.schema if f.name in kept])

    def one(table: pa.Table) -> pa.Table:
        by, bx, my, mx = (table.column(c)[0].as_py() for c in ("_by", "_bx", "_my", "_mx"))
        block, y0, x0 = _dense(table, value)
        own_y, own_x = np.arange(by * size, min((by + 1) * size, my + 1)), np.arange(bx * size, min((bx + 1) * size, mx + 1))
        taps = range(-radius, radius + 1)
        out = _smooth(block, [_mirrored(own_y + k, my) - y0 for k in taps], [_mirrored(own_x + k, mx) - x0 for k in taps], weights)
        y, x = table.column("y").to_numpy() - by * size, table.column("x").to_numpy() - bx * size
        mine = (y >= 0) & (y < len(own_y)) & (x >= 0) & (x < len(own_x))
        rows = table.select(kept).filter(pa.array(mine))
        return rows.set_column(rows.schema.get_field_index(value), value, pa.array(out[y[mine], x[mine]]))

    return blocks.groupBy(*FRAME, "_by", "_bx").applyInArrow(one, schema).select(*kept)


def flat_field(cells: DataFrame, sigma: float, radius: int | None = None, reference: DataFrame | None = None) -> DataFrame:
    """Value over the local mean (a Gaussian, side int(sigma) | 1 and 3 at least; 1 at least) or over a reference of equal
    shape, scaled back to the frame's mean, cut to 0..255, rounded to 9 digits and truncated: a whole number that sums of doubles
    leave a last digit short stays itself. reference: y, x, level."""
    if reference is None:
        radius = radius or max(3, int(sigma) | 1) // 2
        c = gaussian(cells.withColumn("light", F.col("value")), sigma, radius, "light")
    else:
        c = cells.join(reference.withColumnRenamed("level", "light"), ["y", "x"], "left")
        c = c.withColumn("light", F.when(F.col("light").isNull(), F.raise_error(F.lit("the reference does not match the frame"))).otherwise(F.col("light")))
    c = stage(c.withColumn("flat", F.col("value") / F.greatest(F.lit(1.0), "light")), "flat")
    means = stage(c.groupBy(*FRAME).agg(F.avg("value").alias("_value"), F.avg("flat").alias("_flat")), "means")
    c = c.join(sized(means), FRAME)
    scaled = F.col("flat") * F.col("_value") / F.greatest(F.lit(1e-6), F.col("_flat"))
    return c.select(*FRAME, "y", "x", F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)), 9).cast("int").alias("value"))


def upsampled(grid: DataFrame, factor: int, sigma: float = 4.0) -> DataFrame:
    """A patch grid as pixels: bilinear (half-pixel centres, borders held), then a Gaussian; sigma 0 leaves it out. Blocks of
    the grid are laid out as pixels with the border that the kernel needs, so that no pixel is shuffled. grid: FRAME, y, x, value."""
    radius = max(1, int(3 * sigma)) if sigma > 0 else 0
    weights = kernel(sigma, radius) if sigma > 0 else [1.0]
    size = max(1, 2 * BLOCK // factor)
    blocks = _in_blocks(grid.select(*FRAME, "y", "x", F.col("value").cast("double").alias("value")), size, radius // factor + 2)
    schema = StructType([f for f in blocks.schema if f.name in (*FRAME, "y", "x", "value")])
    kinds = {f.name: pa.int64() if f.dataType.simpleString() == "bigint" else pa.int32() for f in schema if f.name in ("y", "x")}

    def one(table: pa.Table) -> pa.Table:
        block, y0, x0 = _dense(table, "value")

        def along(which: str, last: int, first: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
            """Own pixels of an axis; of all that the kernel reaches: cells before and after with the share of the latter, and
            where each weight falls among them."""
            n = (last + 1) * factor
            own = np.arange(which * size * factor, min((which + 1) * size * factor, n))
            at = [_mirrored(own + k, n - 1) for k in range(-radius, radius + 1)]
            held = np.unique(np.concatenate(at)) if len(own) else own
            p = np.clip((held + 0.5) / factor - 0.5, 0, last)
            low = np.floor(p).astype(np.int64)
            return own, [low - first, np.minimum(low + 1, last) - first], [np.searchsorted(held, a) for a in at], p - low

        by, bx, my, mx = (table.column(c)[0].as_py() for c in ("_by", "_bx", "_my", "_mx"))
        ys, rows, y_at, fy = along(by, my, y0)
        xs, columns, x_at, fx = along(bx, mx, x0)
        fy, fx = fy[:, None], fx[None]
        pixels = sum(abs(1 - i - fy) * abs(1 - j - fx) * block[np.ix_(rows[i], columns[j])] for i in (0, 1) for j in (0, 1))
        out = _smooth(pixels, y_at, x_at, weights) if sigma > 0 else pixels
        n = len(ys) * len(xs)
        frame = [pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in FRAME]
        return pa.table([*frame, pa.array(np.repeat(ys, len(xs)), kinds["y"]), pa.array(np.tile(xs, len(ys)), kinds["x"]), pa.array(out.reshape(-1))], names=[*FRAME, "y", "x", "value"])

    return blocks.groupBy(*FRAME, "_by", "_bx").applyInArrow(one, schema)
