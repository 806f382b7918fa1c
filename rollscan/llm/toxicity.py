"""Toxicity: words are restored by a noisy channel before they are scored.

A token that holds a digit, a symbol or a repeated character, or a run of three or more chunks of one or two characters,
spans a lattice: each run of characters may stand for letters (leetspeak), for fewer letters (repetition), for
nothing or for a word boundary (spacing). Viterbi decoding finds the path that is likeliest under a character trigram
model of the whole corpus and the channel's costs. Any other token has a single path, itself. The restored words are
scored by a lexicon of words and word beginnings that labelled documents single out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rollscan.llm.common import slices, stage

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß"
#: Symbols of the character model: 0 is a word's edge, 1.. are LETTERS, the last is any other letter.
SYMBOLS, OTHER = 64, 63
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What leetspeak writes for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SUBSTITUTE, DROP_SYMBOL, DROP_DIGIT, SEPARATOR, COLLAPSE, DOUBLE, WILDCARD, EDGE = 1.0, 1.5, 4.0, 0.5, 1.0, 3.0, 2.0, 1.0
SHORTEST, LONGEST = 4, 8
_PLAIN = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"(.)\1")
_SPACED = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2,}(?!\S)")
_RUN = re.compile(r"(.)\1*", re.S)
_HOLDS_LETTER = re.compile(r"[^\W\d_]")
_READABLE = re.compile("[^\\W\\d_]|[" + re.escape("".join(LEET)) + "]")
#: Longest run of short chunks whose words are remembered, in characters.
REMEMBERED = 64
_table: np.ndarray | None = None


def symbols() -> np.ndarray:
    """Symbol of every code point; 0 for what is not a letter."""
    global _table
    if _table is None:
        _table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                _table[c] = INDEX.get(chr(c), OTHER)
    return _table


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of symbol trigrams; what lies before a word's edge is no context."""
    points = np.frombuffer("\n".join(["", "", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols()[points].astype(np.int32)
    a, b, c = s[:-2], s[1:-1], s[2:]
    use = (b > 0) | (c > 0)
    return np.bincount(((np.where(b > 0, a, 0) << 12) | (b << 6) | c)[use], minlength=SYMBOLS**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities log P(c | a, b) from the trigram counts of all texts of docs. At most SYMBOLS^3 numbers reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches, "text"):
            total += trigram_counts([t or "" for t in batch.column("text").to_pylist()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    counts = np.zeros(SYMBOLS**3)
    for gram, n in docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    return smoothed(counts)


def smoothed(counts: np.ndarray, mass: float = 5.0) -> np.ndarray:
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + mass * p1) / (two.sum(1, keepdims=True) + mass)
    p3 = (three + mass * p2) / (three.sum(2, keepdims=True) + mass)
    return np.log(p3).astype(np.float32)


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of equal characters what it may stand for, with the channel's cost. spaced: letters stand apart, and any
    space between them may be a word's edge. Where no character is a letter, each leetspeak symbol stands for one."""
    out: list[list[tuple[str, float]]] = []
    bare = not _HOLDS_LETTER.search(token)
    for m in _RUN.finditer(token):
        c, n = m[1], len(m[0])
        if c.isspace():
            out.append([("", 0.0), (" ", EDGE)])
        elif c in LEET:
            drop = DROP_DIGIT if c.isdigit() else DROP_SYMBOL
            out.append([(x, SUBSTITUTE) for x in LEET[c]] + ([(x * 2, SUBSTITUTE) for x in LEET[c]] if n == 2 else []) + ([] if bare else [("", drop)]))
        elif c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0 if n == 2 else COLLAPSE), (c, DOUBLE if n == 2 else COLLAPSE)])
        else:
            out.append([("", SEPARATOR)] + ([(v, WILDCARD) for v in "aeiou"] if c == "*" else []))
    return out


def decode(token: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest reading of a token: Viterbi over the last two symbols."""
    states: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(0, 0): (0.0, None, "")}
    cell = model.item
    for options in lattice(token, spaced):
        new: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
        for (a, b), held in states.items():
            for text, cost in options:
                total, x, y = held[0] - cost, a, b
                for ch in text:
                    s = 0 if ch == " " else INDEX.get(ch, OTHER)
                    if s or y:
                        total += cell(x, y, s)
                    x, y = (y, s) if s else (0, 0)
                best = new.get((x, y))
                if best is None or total > best[0]:
                    new[x, y] = (total, held, text)
        states = new
    held = max(states.items(), key=lambda k: k[1][0] + (cell(*k[0], 0) if k[0][1] else 0.0))[1]
    parts = []
    while held[1] is not None:
        parts.append(held[2])
        held = held[1]
    return "".join(reversed(parts))


def stripped(token: str) -> str:
    """The token without marks around it: any that is no leetspeak, closing punctuation, and runs of three or more of one mark."""
    n, end, start = len(token), len(token), 0
    while end:
        c = token[end - 1]
        if c.isalnum() or (c in LEET and c != "!" and not (end > 2 and token[end - 2] == c and token[end - 3] == c)):
            break
        k = end
        while k and token[k - 1] == c:
            k -= 1
        end = k
    while start < end and not (token[start].isalnum() or token[start] in LEET):
        start += 1
    return token[start:end] if end - start < n else token


def restored(token: str, model: np.ndarray) -> str:
    """The word that a lower-cased token stands for."""
    token = stripped(token)
    plain = _PLAIN.fullmatch(token)
    if not token or (plain and not _DOUBLE.search(token)) or not _READABLE.search(token):
        return token
    return decode(token, model)


def spaced_words(text: str, model: np.ndarray, cache: dict[str, list[str]]) -> Iterator[list[str]]:
    """The words of each run of short chunks in a lower-cased text. The language model decides which spaces part words."""
    for m in _SPACED.finditer(text):
        run = " ".join(m[0].split())
        words = cache.get(run)
        if words is None:
            words = decode(run, model, True).split()
            if len(run) <= REMEMBERED:
                if len(cache) > 50_000:
                    cache.clear()
                cache[run] = words
        yield words


def words_of(text: str, model: np.ndarray, cache: dict[str, str], runs: dict[str, list[str]] | None = None, worth: "Worth | None" = None) -> tuple[set[str], int]:
    """Distinct restored words of a text and its number of tokens. With `worth`, words of tokens that have none are one empty
    word."""
    text = text.lower()
    tokens = text.split()
    kinds = set(tokens)
    for t in kinds.difference(cache):
        w = "" if worth and not worth.possible(t) else restored(t, model)
        cache[t] = w if worth is None or worth(w) else ""
    out = set(map(cache.__getitem__, kinds))
    for words in spaced_words(text, model, {} if runs is None else runs):
        out.update(words)
    return out, len(tokens)


def features(word: str) -> list[str]:
    """A word whole (marked $) and its beginnings."""
    n = len(word)
    return [word + "$", *[word[:k] for k in range(SHORTEST, min(n, LONGEST + 1))]] if n >= 3 else []


@dataclass
class Model:
    chars: np.ndarray
    counts: dict[str, tuple[int, int]]
    sizes: tuple[int, int]
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray


def strength(pos: float, neg: float, sizes: tuple[int, int], least: float = 16.0) -> float:
    """Log odds of a feature for label 1, or 0 where the evidence (G statistic) is under `least`."""
    n1, n0 = sizes
    if pos < 2 or not n1 or not n0 or pos / n1 <= neg / n0:
        return 0.0
    total = n1 + n0
    g = 2 * sum(o * np.log(o * total / (r * c)) for o, r, c in ((pos, pos + neg, n1), (neg, pos + neg, n0), (n1 - pos, total - pos - neg, n1), (n0 - neg, total - pos - neg, n0)) if o > 0 and r > 0)
    return float(np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))) if g >= least else 0.0


_REPEATS = re.compile(r"(.)\1+", re.S)


class Worth:
    """The strength of a restored word: the largest of its features'. Strengths are remembered."""

    def __init__(self, model: Model) -> None:
        self.weight = {f: strength(p, q, model.sizes) for f, (p, q) in model.counts.items()}
        self.starts = {f[:SHORTEST] for f in self.weight}
        self.heads = {_REPEATS.sub(r"\1", f.rstrip("$"))[:3] for f in self.weight}
        self.firsts = {h[0] for h in self.heads if h}
        self.held: dict[str, float] = {}

    def __call__(self, word: str) -> float:
        s = self.held.get(word)
        if s is None:
            some = word[:SHORTEST] in self.starts or word + "$" in self.weight
            s = self.held[word] = max([self.weight[f] for f in features(word) if f in self.weight], default=0.0) if some else 0.0
            if len(self.held) > 200_000:
                self.held = {word: s}
        return s

    def possible(self, token: str) -> bool:
        """Whether a token can stand for a word with strength. A letter that it begins with stays; one of letters alone is read with
        fewer repeats or as it is, so without repeats it must begin as some feature does; any other may."""
        if token[0].isalpha() and token[0] not in self.firsts:
            return False
        token = stripped(token)
        if not _PLAIN.fullmatch(token):
            return True
        head = _REPEATS.sub(r"\1", token[:16])
        return len(head) < 3 or any(head[:k] in self.heads for k in (3, 2, 1))


def summary(scores: list[float], n_tokens: int) -> list[float]:
    """A document's numbers: strengths of its words added, the largest, the number and share of words that have any, its length."""
    hits = [s for s in scores if s > 0]
    total = sum(hits)
    return [np.log1p(total), max(hits, default=0.0), np.log1p(len(hits)), min(1.0, 20 * len(hits) / max(1, n_tokens)), np.log1p(total) * np.log1p(n_tokens), np.log1p(n_tokens)]


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, target: str = "toxic", per_class: int = 3000) -> Model:
    """The character model comes from all texts of docs. Labels are learned from at most per_class documents a class
    outside held_out (a column over doc_id): those with the least hashes of doc_id. Each document's own label is left out
    of the lexicon that its numbers are taken from."""
    chars = language_model(docs)
    rows = labels.filter(~held_out & F.col(target).isin(0, 1)).select("doc_id", F.col(target).cast("int").alias("y")).dropDuplicates(["doc_id"])
    share = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    picked = rows.filter("y = 1").orderBy(*order).limit(per_class).unionByName(rows.filter("y = 0").orderBy(*order).limit(per_class))
    # of texts that share a doc_id the one of the least hash, so that the sample is bounded whatever the ids
    text = F.coalesce("text", F.lit(""))
    sample = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = stage(sample, "sample")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            cache, runs, held, n = {}, {}, {}, Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                n[y] += 1
                for f in {f for w in words_of(text, chars, cache, runs)[0] for f in features(w)}:
                    held.setdefault(f, [0, 0])[1 - y] += 1
            held[""] = [n[1], n[0]]
            names, pairs = list(held), np.array(list(held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["feature", "pos", "neg"])

    table = sample.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sizes = (sample.filter("y = 1").count(), sample.filter("y = 0").count())
    # at least as frequent as the evidence asks for: a few thousand features of a bounded sample
    counts = {f: (p, q) for f, p, q in table.filter(f"feature <> '' AND pos >= 3 AND pos * {max(1, sizes[1])} > 4 * neg * {max(1, sizes[0])}").collect() if strength(p, q, sizes) > 0}

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        runs: dict[str, list[str]] = {}
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words, n = words_of(text, chars, cache, runs)
                less = (sizes[0] - y, sizes[1] - 1 + y)
                found = [max([strength(counts[f][0] - y, counts[f][1] - 1 + y, less) for f in features(w) if f in counts], default=0.0) for w in words]
                out.append([float(y), *summary(found, n)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], names=["x"])

    x = np.array(sorted(tuple(r[0]) for r in sample.mapInArrow(describe, "x array<double>").collect()), float).reshape(-1, 7)
    y, x = x[:, 0], x[:, 1:]
    if not len(y) or y.min() == y.max():
        bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Model(chars, counts, sizes, np.array([bias, *[0.0] * 6]), np.zeros(6), np.ones(6))
    centre, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(y)), (x - centre) / spread]
    w = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    w = w / w.mean()
    b = np.zeros(z.shape[1])
    for _ in range(60):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (w * (p - y)) + 0.5 * np.r_[0, b[1:]]
        b = b - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(b)), grad)
    return Model(chars, counts, sizes, b, centre, spread)


def score_documents(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs' columns and the score (0 to 1) of every whole text. Null and empty texts are scored by their lack of words;
    repeated rows are scored each; an existing column of that name is replaced."""
    docs = docs.drop(name)
    # numbered columns go to Python, whatever their names
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    whole = f"c{names.index('text')}"
    worth = Worth(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        runs: dict[str, list[str]] = {}
        for batch in slices(batches, whole):
            rows = []
            for text in batch.column(whole).to_pylist():
                words, n = words_of(text or "", model.chars, cache, runs, worth)
                rows.append(summary([worth(w) for w in words], n))
            if len(cache) > 200_000:
                cache.clear()
            z = (np.array(rows).reshape(-1, 6) - model.centre) / model.spread @ model.weights[1:] + model.weights[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())])).toDF(*names, name)
