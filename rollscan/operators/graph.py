"""Connected components of a graph whose edges lie near each other in some order, such as pairs of neighbouring frames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.staging import stage

#: Edges that a task contracts at a time, about, once few are left.
EDGES = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a-b, and the least node each can reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = up[x], up[y]
        if (p == q).all():
            return nodes, nodes[up]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]


def connected(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """node, component (its least node) for every node of edges (a long, b long).

    Each task contracts the edges of its partition. Nodes that several partitions know are the edges of a smaller graph, which
    is contracted in fewer partitions, and so on: edges that are dealt so that most components lie in one partition leave
    little to later rounds.
    """

    def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = roots = np.zeros(0, np.int64)
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            nodes, roots = least_reachable(np.concatenate((nodes, a)), np.concatenate((roots, b)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])

    held = stage(edges.select("a", "b").mapInArrow(contract, "node long, root long"), "contracted")
    roots = held.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    links = stage(roots.filter(F.size("roots") > 1).select(F.col("roots")[0].alias("a"), F.explode(F.slice("roots", 2, 1 << 30)).alias("b")).distinct(), "links")
    n = links.count()
    own = roots.select("node", F.col("roots")[0].alias("root"))
    if not n:
        return own.withColumnRenamed("root", "component")
    parts = min(max(1, (parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // 2), -(-n // EDGES))
    above = stage(connected(links.repartitionByRange(parts, "a"), parts), "above").withColumnsRenamed({"node": "root"})
    return own.join(above.hint("merge"), "root", "left").select("node", F.coalesce("component", "root").alias("component"))
