"""Functions for SQL users: tiles as table functions over a table's rows, the conformal threshold as an aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import IntegerType, StructType


def origins(length: int, size: int, overlap: int) -> np.ndarray:
    """Tile origins along an axis; the last one is pulled to the edge."""
    if not 0 <= overlap < size:
        raise ValueError("the tile size or overlap is not valid")
    if length < size:
        return np.zeros(0, np.int32)
    return np.unique(np.append(np.arange(0, length - size + 1, size - overlap), length - size)).astype(np.int32)


def tiles_of(h: int, w: int, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a frame's tiles in reading order; a frame without h or w has none."""
    ys, xs = origins(h, size, overlap), origins(w, size, overlap)
    return np.tile(xs, len(ys)), np.repeat(ys, len(xs))


class TileGrid:
    """tile_grid(h, w, size, overlap): the tiles of one frame."""

    def eval(self, h: int, w: int, size: int, overlap: int):
        x, y = tiles_of(h, w, size, overlap)
        yield from zip(range(len(x)), x.tolist(), y.tolist())


class TilesOf:
    """tiles_of(TABLE(frames), size, overlap): the columns of frames (h and w among them), whatever they are, with tile_index, x
    and y of each tile. Rows go to and fro in Arrow batches; frames of one size are laid out once."""

    @staticmethod
    def analyze(frames: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not frames.isTable or not isinstance(frames.dataType, StructType) or not {"h", "w"} <= set(frames.dataType.names):
            raise ValueError("tiles_of takes a table with the columns h and w")
        taken = {"tile_index", "x", "y"} & set(frames.dataType.names)
        if taken:
            raise ValueError(f"the table has a column of that name: {', '.join(sorted(taken))}")
        origins(0, size.value, overlap.value)
        out = StructType(list(frames.dataType.fields))
        for name in ("tile_index", "x", "y"):
            out = out.add(name, IntegerType())
        return AnalyzeResult(schema=out)

    def __init__(self) -> None:
        self.held: dict[tuple, list[tuple[int, int, int]]] = {}

    def eval(self, frames: Row, size: int, overlap: int) -> Iterator[tuple]:
        shape = frames["h"], frames["w"]
        if shape not in self.held:
            x, y = tiles_of(*shape, size, overlap) if None not in shape else ((), ())
            self.held[shape] = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
        for tile in self.held[shape]:
            yield *frames, *tile


def threshold_of(scores: pd.Series, budget: pd.Series, metres_per_tile: pd.Series, margin: pd.Series) -> float | None:
    """The conformal threshold of a group's scores, null where it is refused; nulls and NaN are left out."""
    x = np.sort(scores.dropna().to_numpy(float))
    if budget.iloc[0] <= 0 or metres_per_tile.iloc[0] <= 0:
        raise ValueError("the budget and the metres per tile are positive")
    n, alpha = len(x), budget.iloc[0] * metres_per_tile.iloc[0] / 100.0
    k = int(np.ceil((n + 1) * (1 - alpha)))
    refused = k > n or (margin.iloc[0] > 0 and k > n - margin.iloc[0])
    return None if refused else float(x[max(1, k) - 1])


def register(spark: SparkSession) -> None:
    """U4: tile_grid(h, w, size, overlap) and tiles_of(TABLE(frames), size, overlap). U5: the aggregate conformal_threshold(score,
    budget, metres_per_tile, margin), null where it refuses; a task holds a group's scores, so that groups beyond a task's memory
    take operators.calibrate.conformal_threshold."""
    spark.udtf.register("tile_grid", F.udtf(TileGrid, returnType="tile_index int, x int, y int"))
    spark.udtf.register("tiles_of", F.udtf(TilesOf, useArrow=True))

    @F.pandas_udf("double")
    def conformal_threshold(scores: pd.Series, budget: pd.Series, metres_per_tile: pd.Series, margin: pd.Series) -> float:
        return threshold_of(scores, budget, metres_per_tile, margin)

    spark.udf.register("conformal_threshold", conformal_threshold)
