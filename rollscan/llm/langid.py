"""Language ID: nearest of several clustered centroids per language, over normalised TF-IDF vectors of character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import sized, slices, stage
from rollscan.llm.textnum import utf8

#: Hashed n-gram dimensions.
DIMS = 4096
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def gram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of each text (A-Z lower-cased; other ASCII than letters is a space)."""
    data, bounds = utf8(column)
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros(n * DIMS, np.float32)
    if len(data) > 2:
        x = _FOLD[data].astype(np.uint32)
        two = (x[:-1] << 8) | x[1:]
        three = (two[:-1] * np.uint32(0x9E3779B1)) ^ (x[2:] * np.uint32(0x85EBCA6B))
        for grams, width in ((two * np.uint32(0xC2B2AE35), 2), (three * np.uint32(0x27D4EB2F), 3)):
            same = doc[: len(grams)] == doc[width - 1 :]
            blank = (x[: len(grams)] == 32) & (x[1 : 1 + len(grams)] == 32)
            use = same & ~blank
            out += np.bincount(doc[: len(grams)][use] * DIMS + (grams[use] >> np.uint32(20)), minlength=n * DIMS).astype(np.float32)
    return out.reshape(n, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of dampened counts times idf; zero for texts without n-grams."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray  # the cosine below which a text is rejected, for each language


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of docs each n-gram dimension occurs, counted over all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS + 1, np.int64), 0
        for batch in slices(batches, "text", 1 << 20):
            for k in range(0, batch.num_rows, 256):
                df[:DIMS] += (gram_counts(batch.column("text").slice(k, 256)) > 0).sum(0)
            n += batch.num_rows
        df[DIMS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(df)], names=["dim", "n"])

    total = np.zeros(DIMS + 1, np.int64)
    for dim, n in docs.select(F.col(text).alias("text")).mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect():
        total[dim] = n
    return total[:DIMS], int(total[DIMS])


def cluster(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit vectors; starts at points far from each other."""
    picks = [int(np.random.default_rng(seed).integers(len(points)))]
    near = points @ points[picks[0]]
    while len(picks) < min(k, len(points)):
        picks.append(int(near.argmin()))
        near = np.maximum(near, points @ points[picks[-1]])
    centres = points[picks]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(1)
        centres = np.array([points[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def sampled(rows: DataFrame, per_lang: int) -> DataFrame:
    """lang and text of per_lang of each language's rows, or all where it has fewer: those with the least hashes of (doc_id, text),
    of which repeated rows share one and count once. Rows far beyond that rank are left out before they are ranked, by the
    language's number of hashes (a sketch's, so with room for its error), so that no language is sorted whole."""
    mark = F.xxhash64("doc_id", "text", F.lit(11))
    sizes = stage(rows.groupBy("lang").agg(F.approx_count_distinct(mark, 0.02).alias("held")), "sizes")
    room = 1.2 * (per_lang + 8 * per_lang**0.5 + 16)
    place = F.pmod(mark, F.lit(1 << 30))
    few = rows.join(sized(sizes), "lang").filter(place < F.lit(float(1 << 30)) * room / F.col("held"))
    few = few.groupBy("lang", mark.alias("mark")).agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("mark", F.lit(1 << 30)), "mark")
    return few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_lang).select("lang", "text")


def fit(docs: DataFrame, train: Column, per_lang: int = 1500, clusters: int = 4, reject: float = 0.001) -> Model:
    """Learns from text and lang of the rows that `train` takes, where lang is not null. idf counts all of them; centroids
    come from a sample of at most per_lang texts a language (see sampled()), each language in a task of its own, which returns
    `clusters` vectors of DIMS numbers to the driver. A language's floor is the quantile `reject` of its sample's cosines.
    Very long texts count as others do, by dampened counts; repeated rows count each; with nothing to learn from the model
    knows no language."""
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        texts = part["text"].sort_values()  # the same texts give the same centroids, in whatever order they come
        points = np.concatenate([vectors(gram_counts(pa.array(texts.iloc[k : k + 256], pa.large_string())), idf) for k in range(0, len(texts), 256)])
        centres = cluster(points, clusters).astype(np.float32)
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "centres": [centres.tobytes()], "floor": [float(np.quantile((points @ centres.T).max(1), reject))]})

    learned = sorted(sampled(rows, per_lang).groupBy("lang").applyInPandas(learn, "lang string, centres binary, floor double").collect(), key=lambda r: r.lang)
    parts = [np.frombuffer(r.centres, np.float32).reshape(-1, DIMS) for r in learned]
    owner = np.repeat(np.arange(len(learned)), [len(p) for p in parts]) if parts else np.zeros(0, int)
    return Model([r.lang for r in learned], idf, np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32), owner, np.array([r.floor for r in learned]))


RESULT = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every whole text of docs (and held_out, where docs has it).

    score is the margin of the best language's cosine over the next one's, on a scale from 0 to 1. rejected: the best
    cosine is under the language's floor. Null texts, texts without a letter, and all texts where nothing could be
    learned get `und`, score 0. Ties go to the first language by code point. Texts are read whole, whatever their length;
    repeated rows are judged each; an empty table gives no row; further columns are ignored.
    """
    extra = [c for c in ("held_out",) if c in docs.columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                n = part.num_rows
                best = np.full((n, max(1, len(model.langs))), -1.0)
                if model.langs:
                    cos = vectors(gram_counts(part.column("text")), model.idf) @ model.centroids.T
                    for j in range(len(model.langs)):
                        best[:, j] = cos[:, model.owner == j].max(1)
                top = best.argmax(1)
                first = best[np.arange(n), top]
                best[np.arange(n), top] = -1
                margin = first - np.maximum(best.max(1), 0) if best.shape[1] > 1 else first
                score = np.clip(0.5 + 2 * margin, 0, 1) * letters
                known = letters & bool(model.langs)
                names = [model.langs[t] if ok else "und" for t, ok in zip(top, known)]
                low = ~known | (first < (model.floor[top] if model.langs else 0))
                cols = [part.column("doc_id"), pa.array(names), pa.array(np.where(known, score, 0.0)), pa.array(low)]
                yield pa.RecordBatch.from_arrays(cols + [part.column(c) for c in extra], names=["doc_id", "lang_pred", "score", "rejected", *extra])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    schema = RESULT + "".join(f", {c} boolean" for c in extra)
    return docs.select(F.col("doc_id").cast("long"), "text", letters, *extra).mapInArrow(run, schema)
