"""Byte-pair encoding of whole texts: texts are cut into pre-tokens with numpy, and each distinct pre-token is encoded once."""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

U = np.uint64
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15
_SLOTS = 1 << 20
#: The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Class of every code point, as the tokenizer's pattern has them: letter, number, white space, other."""
    global _kinds
    if _kinds is None:
        first = {"L": LETTER, "N": NUMBER}
        out = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in first:
                out[c] = first[kind]
        for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            out[c] = SPACE
        _kinds = out
    return _kinds


def pre_tokens(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts without apostrophes: runs of one class, with one space before; of white space before
    anything else, the last character stands alone unless it is a plain space."""
    n = len(points)
    kind = kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    edge[0] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    # the last white space before something else in the same text opens a pre-token ...
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]
    start = change | last
    # ... which goes on over what follows where it is a plain space
    joined = np.flatnonzero(last & (points == 32)) + 1
    start[joined] = False
    return np.flatnonzero(start)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The process's encoder of a tokenizer file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids of a tokenizer file, as the tokenizer itself gives them without added special tokens. Texts with an apostrophe or an
    added token go to it as they are; others are cut into pre-tokens. Keeps at most `limit` pre-tokens."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        added = self.tokenizer.get_added_tokens_decoder()
        self.whole = re.compile("|".join(["'", *(re.escape(t.content) for t in added.values())]))
        # the same merges as a tiktoken encoding, which encodes single pre-tokens several times as fast
        ranks = {bytes(_BYTES[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in added and all(c in _BYTES for c in token)}
        self.merges = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(_SLOTS, U), np.zeros(_SLOTS, np.int64)
        self.starts, self.lengths, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0
        self.powers = np.ones(1, U), np.ones(1, U)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers[0]) < n:
            out = []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                p = np.full(n, base, U)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.powers = tuple(out)
        return self.powers

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key: that which holds it, or the first free one (open addressing)."""
        at = (keys >> U(40)).astype(np.int64) & (_SLOTS - 1)
        held = self.keys[at]
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (_SLOTS - 1)
            held = self.keys[at[todo]]
            todo = todo[(held != keys[todo]) & (held != 0)]
        return at

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = list(map(self.merges.encode_ordinary, texts))
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        while self.n + len(found) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        rows = np.arange(self.n, self.n + len(found))
        self.starts[rows], self.lengths[rows] = self.used + np.cumsum(lengths) - lengths, lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(found), self.used + len(flat)
        while len(keys):  # keys that meet in one free slot: one takes it, the others go on
            at = self._place(keys)
            self.keys[at] = keys
            done = self.keys[at] == keys
            self.rows[at[done]] = rows[done]
            keys, rows = keys[~done], rows[~done]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        texts = ["" if t is None else t for t in texts]
        slow = [i for i, t in enumerate(texts) if self.whole.search(t)]
        fast = sorted({i for i, t in enumerate(texts) if t} - set(slow))
        out = [np.zeros(0, np.uint32)] * len(texts)
        for i, e in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        if not fast:
            return out
        joined = "".join(texts[i] for i in fast)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(texts[i]) for i in fast])))
        starts = pre_tokens(points, bounds)
        ends = np.append(starts[1:], len(points))
        up, down = self._powers(len(points) + 1)
        total = np.zeros(len(points) + 1, U)
        np.cumsum((points.astype(U) + U(0x5851F42D)) * U(0xD6E8FEB86659FD93) * up[: len(points)], out=total[1:])
        x = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = ((x ^ (x >> U(27))) * U(0x94D049BB133111EB)) | U(1)
        at = self._place(x)
        miss = np.flatnonzero(self.keys[at] == 0)
        if len(miss):
            new, first = np.unique(x[miss], return_index=True)
            if self.n + len(new) > self.limit:
                self._clear()
                return self.encode(texts) if len(new) <= self.limit else self._direct(texts)
            first = miss[first]
            self._learn(new, [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            at[miss] = self._place(x[miss])
        rows = self.rows[at]
        lengths = self.lengths[rows].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.repeat(self.starts[rows] - upto[:-1], lengths) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(starts, bounds)]
        for i, a, b in zip(fast, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[i] = ids[a:b]
        return out

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
