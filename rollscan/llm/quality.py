"""Quality classifier: a sparse rule ensemble. Paths of small trees over text statistics become conjunctive rules, a lasso
logistic fit weighs them, and the rules that keep a weight are compiled into one Spark column expression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscan.llm.common import slices, stage
from rollscan.llm.textnum import utf8, word_hashes

STATS = ("n_words", "word_len", "upper", "digit", "symbol", "pipe", "punct", "wide", "repeat_next", "distinct", "top_word", "line_words", "lines_repeat", "bangs")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars)] = 1
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_SYMBOL, _PIPE, _PUNCT, _BANG = _class(b"#$%&*+/<=>@\\^_`~{}[]"), _class(b"|"), _class(b".,;:?\"'()-"), _class(b"!")
_WIDE, _LINE, _SPACE = _class(bytes(range(128, 256))), _class(b"\n"), _class(b" \t\n\v\f\r")


def statistics(column: pa.Array) -> np.ndarray:
    """STATS of each whole text (null counts as empty), all finite."""
    data, bounds = utf8(column)
    n = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    words, counts = word_hashes(data, bounds)
    at = np.concatenate(([0], np.cumsum(counts)))

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(table[data])))
        return total[bounds[1:]] - total[bounds[:-1]]

    letters = np.maximum(size - share(_SPACE), 1)
    out = np.zeros((n, len(STATS)))
    lines = share(_LINE) + 1
    for j, table in ((2, _UPPER), (3, _DIGIT), (4, _SYMBOL), (5, _PIPE), (6, _PUNCT), (7, _WIDE), (13, _BANG)):
        out[:, j] = share(table) / letters
    out[:, 0], out[:, 1], out[:, 11] = np.log1p(counts), letters / np.maximum(counts, 1), np.log1p(counts / lines)
    text = data.tobytes()
    for i in np.flatnonzero(counts):
        w = words[at[i] : at[i + 1]]
        if len(w) > 1:
            out[i, 8] = (w[1:] == w[:-1]).mean()
        ordered = np.sort(w)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        out[i, 9], out[i, 10] = (len(edge) - 1) / len(w), np.diff(edge).max() / len(w)
        rows = [r for r in text[bounds[i] : bounds[i + 1]].split(b"\n") if len(r) > 20]
        out[i, 12] = 1 - len(set(rows)) / len(rows) if rows else 0
    return out


@dataclass
class Rules:
    """score = logistic(bias + the weights of the rules that hold); a rule is a list of (statistic, whether at most, bound)."""

    bias: float = 0.0
    rules: list[tuple[list[tuple[str, bool, float]], float]] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(self.bias)
        for tests, weight in self.rules:
            holds = F.lit(True)
            for name, most, bound in tests:
                holds &= (F.col(name) <= bound) if most else (F.col(name) > bound)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, columns: np.ndarray, depth: int, least: int = 12) -> list[list[tuple[int, bool, float]]]:
    """The paths of one small tree (Gini, quantile cuts): every path from the root, inner ones too."""
    paths: list[list[tuple[int, bool, float]]] = []

    def split(rows: np.ndarray, path: list[tuple[int, bool, float]]) -> None:
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return
        best = (1e-9, None, 0.0)
        one, all_ = (w * y)[rows], w[rows]
        base = one.sum() * (1 - one.sum() / all_.sum())
        for j in columns:
            v = x[rows, j]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 33))):
                left = v <= cut
                if least <= left.sum() <= len(rows) - least:
                    a, b = all_[left].sum(), one[left].sum()
                    c, d = all_.sum() - a, one.sum() - b
                    gain = base - b * (1 - b / a) - d * (1 - d / c)
                    if gain > best[0]:
                        best = (gain, j, float(cut))
        if best[1] is not None:
            left = x[rows, best[1]] <= best[2]
            split(rows[left], [*path, (best[1], True, best[2])])
            split(rows[~left], [*path, (best[1], False, best[2])])

    split(np.arange(len(y)), [])
    return paths


def lasso(z: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an l1 penalty (accelerated proximal gradient); the bias is free."""
    n = w.sum()
    step = 4 * n / (np.linalg.norm(np.sqrt(w)[:, None] * np.c_[np.ones(len(y)), z], 2) ** 2)
    b = c = np.zeros(z.shape[1] + 1)
    t = 1.0
    for _ in range(rounds):
        g = w * (1 / (1 + np.exp(-(c[0] + z @ c[1:]))) - y) / n
        new = c - step * np.r_[g.sum(), z.T @ g]
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        b, c = new, new + (last - 1) / t * (new - b)
    return float(b[0]), b[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> Rules:
    """Rules from x (rows of STATS) and y (0 or 1). With one class only, or nothing to learn from, the score is constant."""
    if not len(y) or y.min() == y.max():
        return Rules(4.0 if len(y) and y[0] else (-4.0 if len(y) else 0.0))
    rng = np.random.default_rng(seed)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5  # the rarer class counts more
    found: dict[tuple, None] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 2000), replace=False)
        columns = rng.choice(x.shape[1], 6, replace=False)
        for path in grow(x[rows], y[rows], w[rows], columns, depth):
            found[tuple(path)] = None
    masks = {}
    for path in found:
        holds = np.ones(len(y), bool)
        for j, most, cut in path:
            holds &= (x[:, j] <= cut) if most else (x[:, j] > cut)
        if 0 < holds.sum() < len(y):
            masks.setdefault(holds.tobytes(), (path, holds))
    rules = list(masks.values())
    if not rules:
        return Rules(float(np.log(y.mean() / (1 - y.mean()))))
    bias, weights = lasso(np.array([h for _, h in rules], float).T, y, w, penalty)
    return Rules(bias, [([(STATS[j], most, cut) for j, most, cut in path], float(v)) for (path, _), v in zip(rules, weights) if v])


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(s[:, j]) for j in range(len(STATS))]], names=["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in STATS))


def labelled_sample(stats: DataFrame, labels: DataFrame, target: str, held_out: Column, most: int) -> tuple[np.ndarray, np.ndarray]:
    """STATS and target of at most `most` labelled rows that are not held out: those with the least hashes of doc_id."""
    rows = labels.filter(~held_out & F.col(target).isNotNull()).select("doc_id", F.col(target).cast("int").alias("y")).dropDuplicates(["doc_id"])
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)
    # of texts that share a doc_id the least statistics: at most `most` rows of numbers are collected
    found = stats.join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", *STATS)).alias("s")).select("s.*").collect()
    found = np.array(sorted(tuple(r) for r in found), float).reshape(-1, len(STATS) + 1)
    return found[:, 1:], found[:, 0]


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, target: str = "quality", most: int = 8000, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text of docs, from rules learned on a sample of at most `most`
    labelled rows outside held_out (a column over doc_id). Null texts count as empty and are scored like them; repeated rows
    are scored each; without labels the score is 0.5. Further columns are ignored."""
    stats = stage(statistics_table(docs), "statistics")
    model = fit(*labelled_sample(stats, labels, target, held_out, most), **options)
    scored = stats.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
