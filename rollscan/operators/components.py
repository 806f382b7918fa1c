"""8-connected components of cells above a threshold, and the detections they make."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollscan.staging import stage

FRAME = ["roll_id", "frame_index"]


def runs(cells: DataFrame, threshold: float) -> DataFrame:
    """Runs of neighbouring cells of a row whose score is above the threshold: FRAME, y, x0, x1."""
    w = Window.partitionBy(*FRAME, "y").orderBy("x")
    island = F.col("x") - F.row_number().over(w)
    hot = cells.filter(F.col("score") > threshold).select(*FRAME, "y", "x", island.alias("island"))
    return hot.groupBy(*FRAME, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def adjacent(r: DataFrame, bin_px: int = 64) -> DataFrame:
    """Pairs of runs of rows y and y + 1 that touch, corners included. r: FRAME, y, x0, x1, run. Runs meet through bins of
    columns, so that a row's runs are not all held against the next row's; a pair is taken in the first bin that it shares."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bin_px), F.floor(hi / bin_px))).alias("bin")
    a = r.select(*FRAME, "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("run").alias("a"), bins(F.col("x0") - 1, F.col("x1") + 1))
    b = r.select(*FRAME, (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("b"), bins(F.col("x0"), F.col("x1")))
    met = a.join(b.hint("merge"), [*FRAME, "y", "bin"]).filter("a0 <= b1 + 1 AND b0 <= a1 + 1")
    return met.filter(F.col("bin") == F.floor(F.greatest(F.col("a0") - 1, F.col("b0")) / bin_px)).select(*FRAME, "a", "b")


def _labels(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For runs in order of (y, x0) the index of the first run of each one's component."""
    n = len(y)
    width = int(max(x1.max(), 0) - min(x0.min(), 0)) + 4
    below, base = (y - y.min() + 1) * width, x0.min()
    starts, ends = (y - y.min()) * width + x0 - base, (y - y.min()) * width + x1 - base
    lo, hi = np.searchsorted(ends, below + x0 - base - 1), np.searchsorted(starts, below + x1 - base + 1, side="right")
    many = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), many)
    b = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(a))
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def label_runs(r: DataFrame, band: int = 256) -> DataFrame:
    """G1: runs with `component`, the first cell (y, x) of their component as struct.

    Frames are cut into bands of `band` rows. A band's runs are labelled together; components that touch across a border
    make a small graph, in which labels fall to the least neighbour and then jump to their label's label until a round
    changes nothing. Frames of one band need no round.
    """
    n = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(r.dtypes)
    dealt = r.withColumn("band", F.floor(F.col("y") / band)).repartition(n, *FRAME, "band").sortWithinPartitions(*FRAME, "band", "y", "x0")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            starts = _group_starts(rest)
            if len(starts) > 1:  # the last band may go on in the next batch
                yield labelled(rest.slice(0, starts[-1]), starts[:-1])
                rest = rest.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield labelled(rest, _group_starts(rest))

    def labelled(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        y, x0, x1 = (batch.column(c).to_numpy() for c in ("y", "x0", "x1"))
        first = np.concatenate([a + _labels(y[a:b], x0[a:b], x1[a:b]) for a, b in zip(starts, [*starts[1:], batch.num_rows])])
        names = [*batch.schema.names, "cy", "cx"]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(y[first], batch.column("y").type), pa.array(x0[first], batch.column("x0").type)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + f", cy {kinds['y']}, cx {kinds['x0']}"
    cell = F.struct(F.col("cy").alias("y"), F.col("cx").alias("x0"))
    out = stage(dealt.mapInArrow(run, schema).withColumn("component", cell).drop("cy", "cx"), "bands")
    at = F.pmod(F.col("y"), F.lit(band))
    border = out.filter((at == 0) | (at == band - 1)).select(*FRAME, "y", "x0", "x1", F.col("component").alias("run"))
    edges = stage(adjacent(border).filter("a <> b").distinct(), "borders")
    if edges.isEmpty():
        return out.drop("band")
    edges = edges.unionByName(edges.select(*FRAME, F.col("b").alias("a"), F.col("a").alias("b")))
    labels = edges.select(*FRAME, F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b").hint("merge"), [*FRAME, "b"]).groupBy(*FRAME, F.col("a").alias("node")).agg(F.min("label").alias("least"))
        lower = labels.join(near.hint("merge"), [*FRAME, "node"]).select(*FRAME, "node", F.least("label", "least").alias("to"), "label")
        up = lower.select(*FRAME, F.col("node").alias("to"), F.col("to").alias("further"))
        jumped = stage(lower.join(up.hint("merge"), [*FRAME, "to"]).select(*FRAME, "node", F.least("to", "further").alias("new"), "label"), "labels")
        changed = jumped.filter("new <> label").limit(1).count()
        labels = jumped.select(*FRAME, "node", F.col("new").alias("label"))
        if not changed:
            break
    found = labels.withColumnRenamed("node", "component").hint("merge")
    return out.join(found, [*FRAME, "component"], "left").select(*r.columns, F.coalesce("label", "component").alias("component"))


def _group_starts(batch: pa.RecordBatch) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in [*FRAME, "band"]:
        v = batch.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def labelled_cells(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """The cells of each component with their scores."""
    at = labelled.select(*FRAME, "y", "component", F.explode(F.sequence("x0", "x1")).alias("x"))
    return cells.join(at.hint("merge"), [*FRAME, "y", "x"])


def component_stats(cells: DataFrame, labelled: DataFrame, min_area: int = 1, min_length: int = 0) -> DataFrame:
    """Box, area, largest and mean score of each component. Areas under min_area go; components go where both length and width are under min_length."""
    s = labelled_cells(cells, labelled).groupBy(*FRAME, "component").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.count("*").alias("area"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"),
    )
    long_enough = (F.col("x1") - F.col("x0") + 1 >= min_length) | (F.col("y1") - F.col("y0") + 1 >= min_length)
    return s.filter((F.col("area") >= min_area) & long_enough)


def extents(cells: DataFrame, labelled: DataFrame, stats: DataFrame, fraction: float = 0.5, rule: str = "half_max") -> DataFrame:
    """Box of a component's cells at or above floor + fraction (peak - floor), where the floor is the least score in its whole
    box; with the rule `threshold` the box of all its cells."""
    if rule == "threshold":
        return stats.select(*FRAME, "component", F.col("x0").alias("ex0"), F.col("y0").alias("ey0"), F.col("x1").alias("ex1"), F.col("y1").alias("ey1"))
    if rule != "half_max":
        raise ValueError(f"no extent rule {rule}")
    box = stats.select(*FRAME, "component", "x0", "x1", "y0", "y1", "max_score")
    rows = box.withColumn("y", F.explode(F.sequence("y0", "y1")))
    floors = cells.join(rows.hint("merge"), [*FRAME, "y"]).filter("x BETWEEN x0 AND x1").groupBy(*FRAME, "component").agg(F.min("score").alias("floor"))
    level = box.join(floors.hint("merge"), [*FRAME, "component"]).select(*FRAME, "component", (F.col("floor") + fraction * (F.col("max_score") - F.col("floor"))).alias("level"))
    core = labelled_cells(cells, labelled).join(level.hint("merge"), [*FRAME, "component"]).filter("score >= level")
    return core.groupBy(*FRAME, "component").agg(F.min("x").alias("ex0"), F.min("y").alias("ey0"), F.max("x").alias("ex1"), F.max("y").alias("ey1"))


def detections(boxes: DataFrame, stats: DataFrame, geometry: DataFrame) -> DataFrame:
    """Extents in millimetres on the roll. geometry: FRAME, along_mm, mm_per_px."""
    d = stats.join(boxes.hint("merge"), [*FRAME, "component"]).join(geometry.hint("merge"), FRAME)
    s = F.col("mm_per_px")
    return d.select(*FRAME, "component", "area", "max_score", "mean_score", (F.col("along_mm") + F.col("ey0") * s).alias("along_mm"), (F.col("ex0") * s).alias("across_mm"), ((F.col("ey1") - F.col("ey0") + 1) * s).alias("length_mm"), ((F.col("ex1") - F.col("ex0") + 1) * s).alias("width_mm"))


def union_masks(*masks: DataFrame) -> DataFrame:
    """Mask cells of several masks of an image as one."""
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.groupBy("image", "y", "x").agg(F.max("value").alias("value"))


