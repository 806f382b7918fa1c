"""Runs of words with a small period: a recompression grammar of the words answers how far a period extends.

The words of a slice of documents, each document ended by a symbol of its own, are recompressed: blocks of one symbol become a
symbol (block compression), then pairs whose first symbol falls in one half of the symbols and whose second in the other (pair
compression), and so on until one symbol is left. Equal stretches are cut alike but at their ends, so that the longest common
extension of two places climbs and descends the grammar in a bounded number of steps a level.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.llm.common import slices
from rollscan.llm.textnum import U, mix64, utf8

#: A run is at least so many words long, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Candidates that are extended at a time, about.
CHUNK = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass
class Level:
    """A level of the grammar: its symbols, how many words each one holds, and the group on the next level that each falls in.
    starts: whether a symbol begins its group. left: how many symbols like it the group has from it on (1 in a pair)."""

    symbols: np.ndarray
    words: np.ndarray
    group: np.ndarray | None = None
    first: np.ndarray | None = None  # of each group, its first symbol
    starts: np.ndarray | None = None
    left: np.ndarray | None = None
    paired: bool = False

    def cut(self, starts: np.ndarray, paired: bool) -> None:
        """Groups the symbols; starts marks where groups begin, which are pairs (and single symbols) or blocks."""
        self.starts, self.first = starts, np.flatnonzero(starts).astype(np.int32)
        self.group = np.cumsum(starts, dtype=np.int32) - 1
        if paired:
            self.left = np.ones(len(starts), np.int32)
        else:
            self.left = np.append(self.first[1:], np.int32(len(starts)))[self.group] - np.arange(len(starts), dtype=np.int32)
        self.paired = paired

    def mirrored(self) -> Level:
        """The level read from its end."""
        out = Level(self.symbols[::-1], self.words[::-1])
        if self.starts is not None:
            ends = np.append(self.starts[1:], True)
            out.cut(ends[::-1], self.paired)
        return out


def numbered(symbols: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One number for each distinct pair, in the order in which they come up."""
    return pd.factorize((symbols.astype(U) << U(32)) | more.astype(U))[0].astype(np.int32)


def blocks(s: np.ndarray) -> np.ndarray:
    """Where blocks of one symbol begin."""
    return np.append(True, s[1:] != s[:-1])


def pairs(s: np.ndarray, seed: int) -> np.ndarray:
    """Where groups begin if symbols of one half pair with a next one of the other half; symbols are halved by their hash, and
    of the two orders the one with more pairs is taken. No two neighbours may be equal."""
    half = (mix64(s.astype(U) * U(0x9E3779B97F4A7C15) + U(seed)) & U(1)).astype(bool)
    up, down = half[:-1] & ~half[1:], ~half[:-1] & half[1:]
    return np.append(True, ~(up if up.sum() >= down.sum() else down))


def grammar(symbols: np.ndarray) -> list[Level]:
    """The levels over symbols, whose first and last must occur once; the top level has one symbol."""
    levels, seed = [Level(symbols, np.ones(len(symbols), np.int32))], 0
    while len(levels[-1].symbols) > 1:
        low = levels[-1]
        starts = blocks(low.symbols)
        if starts.all():
            starts, seed = pairs(low.symbols, seed), seed + 1
            if starts.all():
                continue  # no pair in these halves
            low.cut(starts, paired=True)
            more = np.zeros(len(low.first), np.int64)
            double = np.diff(np.append(low.first, len(starts))) == 2
            more[double] = low.symbols[low.first[double] + 1].astype(np.int64) + 1
        else:
            low.cut(starts, paired=False)
            more = np.diff(np.append(low.first, len(starts)))
        levels.append(Level(numbered(low.symbols[low.first], more), np.add.reduceat(low.words, low.first)))
    return levels


def extension(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from place x on equal those from place y on, for each pair of places x < y.

    A pair of places climbs while its symbols are equal: at once where both begin their groups, else after what is left of the
    group (a pair's second symbol, or what both blocks have left). Where symbols differ it descends: of two groups that differ
    a common beginning is taken on each level, and what follows differs again. The last symbol occurs once, so none runs out.
    """
    x, y = x.astype(np.int64), y.astype(np.int64)
    held, top, live = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.arange(len(x))
    for depth, level in enumerate(levels):
        live = live[level.symbols[x[live]] == level.symbols[y[live]]]
        if not len(live):
            break
        a, b = x[live], y[live]
        step = np.where(level.starts[a] & level.starts[b], 0, np.minimum(level.left[a], level.left[b]))
        held[live] += step * level.words[a].astype(np.int64)
        a, b = a + step, b + step
        x[live], y[live] = a, b
        same = level.symbols[a] == level.symbols[b]
        live, a, b = live[same], a[same], b[same]
        x[live], y[live], top[live] = level.group[a], level.group[b], depth + 1
    for depth in range(int(top.max(initial=0)) - 1, -1, -1):
        level, down = levels[depth], np.flatnonzero(top > depth)
        a, b = level.first[x[down]], level.first[y[down]]
        step = np.where(level.symbols[a] == level.symbols[b], np.minimum(level.left[a], level.left[b]), 0)
        held[down] += step * level.words[a].astype(np.int64)
        x[down], y[down] = a + step, b + step
    return held


def candidates(symbols: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods in order of period, some CHUNK at a time, one pair at least within every run: a run of LEAST_PERIODS
    periods p holds LEAST_PERIODS - 1 multiples of p in a row whose words equal those p later. counts: words of each document,
    not rising."""
    ends = 1 + np.cumsum(counts + 1)  # documents that are long enough for a period come first
    at, period, held = [], [], 0
    for p in range(1, int(counts.max(initial=0)) // LEAST_PERIODS + 1):
        upto = ends[np.searchsorted(-counts, -LEAST_PERIODS * p, "right") - 1]
        equal = symbols[: upto - p : p] == symbols[p:upto:p]
        row = equal[: len(equal) - LEAST_PERIODS + 2]
        for k in range(1, LEAST_PERIODS - 1):
            row = row & equal[k : k + len(row)]
        found = row.nonzero()[0]
        if p == 1 and len(found):
            found = found[np.append(True, found[1:] != found[:-1] + 1)]  # here places in a row are in one run
        if len(found):
            at.append(found * p)
            period.append(np.full(len(found), p))
            held += len(found)
        if held > CHUNK:
            yield np.concatenate(at), np.concatenate(period)
            at, period, held = [], [], 0
    if held:
        yield np.concatenate(at), np.concatenate(period)


def smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) of one stretch the one with the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]]


def runs_of(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows start, length, period of all runs, in order of start, then period. symbols: a symbol that occurs once, then each
    document's words and another such symbol; counts: see candidates().

    The grammar extends each candidate to both sides. A multiple of a run's smallest period finds the same stretch, of which
    the row with the smallest period stays; candidates that lie in a known long run of a divisor of their period can find no
    other and are left out.
    """
    n, levels, mirror, found = len(symbols), None, None, [np.zeros((0, 3), np.int64)]
    for at, period in candidates(symbols, counts):
        if levels is None:
            levels = grammar(symbols)
            mirror = [level.mirrored() for level in levels]
            end, own = np.zeros(n, np.int64), np.ones(n, np.int64)  # of a known run at each place
        new = (at + period >= end[at]) | (period % own[at] > 0)
        at, period = at[new], period[new]
        behind = extension(mirror, n - at - period, n - at)
        length = behind + extension(levels, at, at + period) + period
        rows = smallest(np.stack([at - behind, length, period], 1)[length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)])
        found.append(rows)
        long = rows[rows[:, 1] >= 4 * LEAST_PERIODS * rows[:, 2]]
        for start, size, p in long[np.argsort(long[:, 1])].tolist():
            end[start : start + size], own[start : start + size] = start + size, p
    rows = smallest(np.concatenate(found))
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word in reading order, the number of words of each text, and the distinct words (bytes) by number."""
    data, bounds = utf8(column)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    edge[1:-1] |= ~(solid[1:] & solid[:-1]) if len(data) else False
    starts = np.flatnonzero(solid & edge[:-1])
    letters = np.append(0, np.cumsum(solid))
    offsets = np.append(letters[starts], letters[-1]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    return found.indices.to_numpy(), np.diff(np.searchsorted(starts, bounds)), found.dictionary.to_numpy(zero_copy_only=False)


def repeating(ids: list[int | None], codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of which those of every tenth document (by its id's checksum) repeat from a place on; missing ids never do."""
    out, first = codes.copy(), 0
    for i, n in zip(ids, counts.tolist()):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[first + a : first + n] = codes[first + a + np.arange(n - a) % p]
        first += n
    return out


def runs_by_text(codes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """runs_of() for each text; starts count from the text's first word."""
    order = np.argsort(-counts, kind="stable")
    first = np.cumsum(counts) - counts
    own = int(codes.max(initial=-1)) + 1 + np.arange(len(counts) + 1)
    parts = [own[:1]]
    for k, i in enumerate(order.tolist()):
        parts += [codes[first[i] : first[i] + counts[i]], own[k + 1 : k + 2]]
    rows = runs_of(np.concatenate(parts).astype(np.int32), counts[order])
    begins = 1 + np.cumsum(counts[order] + 1) - (counts[order] + 1)
    text = np.searchsorted(begins, rows[:, 0], "right") - 1
    rows[:, 0] -= begins[text] if len(rows) else 0
    out = [rows[:0]] * len(counts)
    cut = np.searchsorted(text, np.arange(len(counts) + 1))
    for k, i in enumerate(order.tolist()):
        out[i] = rows[cut[k] : cut[k + 1]]
    return out


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) > 0


def strongest(runs: np.ndarray) -> list[int | None]:
    """start, length, period and exponent in thousandths of the run with the most periods (ties: first, then smallest period)."""
    if not len(runs):
        return [None] * 4
    start, length, period = max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return [start, length, period, 1000 * length // period]


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def document_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per row of docs: its runs, the strongest of them, and a digest of its words without what repeats.

    Words are told apart by every byte. Null and empty texts have no words, no run, and collapse to the empty text. Texts are
    read whole, a slice of documents at a time, very long ones in a slice of their own. plant: repeat words as repeating() says
    first. Rows that share a doc_id are judged each; an empty table gives no row; further columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            codes, counts, words = words_of(batch.column("text"))
            codes = repeating(ids, codes, counts) if plant else codes
            out, first = [], 0
            for i, n, runs in zip(ids, counts.tolist(), runs_by_text(codes, counts)):
                kept = words[codes[first : first + n][~dropped(runs, n)]]
                listed = "".join("%d,%d,%d\n" % tuple(r) for r in runs.tolist())
                out.append([i, len(runs), *strongest(runs), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept.tolist())).hexdigest()])
                first += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


NAMES = [c.split()[0] for c in RESULT.split(", ")]
TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]
