"""Token counts of a piece vocabulary with byte fallback, by rank-synchronous merging over ragged numpy arrays.

Texts are cut into pre-tokens before each run of spaces; no piece holds a space after another character, so no merge
crosses a cut. Distinct pre-tokens of a batch that aren't in the worker's bounded cache are cut further where no piece
holds the two characters side by side, and held as one flat array of symbols with the start of each sequence. In every
round each sequence finds its pair of lowest rank by a segmented minimum, all sequences merge theirs at once, and sequences
without a pair leave. A sequence merges all places of its pair in one round, leftmost first, where the new symbol can't
join a neighbour at a lower rank, so a long sequence without spaces takes a round for each distinct piece, not for each
merge. Symbols that survive are counted, unknown characters as their UTF-8 bytes.

One pass without a shuffle. Null and empty texts have no tokens, an empty table has no rows. Very long texts go the same
way. Repeated rows are counted once each. A text of exactly ``limit`` tokens isn't over it. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import utf8

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_NONE = np.int64(2**62)
_RUNS = re.compile("▁*[^▁]+|▁+")
_COUNTERS: dict[str, Pieces] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


class Pieces:
    """Merge tables of a piece model file whose normaliser is the identity and that puts a space before a text."""

    def __init__(self, path: str, most: int = 600_000):
        with open(path, "rb") as f:
            raw = f.read()
        scored = []
        for k, v in _fields(raw):
            if k == 1:
                d = dict(_fields(v))
                if d.get(3, 1) in (1, 4):  # normal and user-defined
                    scored.append((d[1].decode(), float(np.frombuffer(d.get(2, b"\0\0\0\0"), "<f4")[0])))
        scored.sort(key=lambda x: -x[1])
        self.rank = {p: k for k, (p, _) in enumerate(scored)}
        self.chars = {p: k for p, k in self.rank.items() if len(p) == 1}
        pairs = [(self.rank[p[:i]], self.rank[p[i:]], k) for p, k in self.rank.items() for i in range(1, len(p)) if p[:i] in self.rank and p[i:] in self.rank]
        self.base = len(self.rank)
        left, right, merged = np.array(pairs, np.int64).T
        order = np.argsort(left * self.base + right)
        self.keys, self.merged = (left * self.base + right)[order], merged[order]
        # Symbols that can join a neighbour at a lower rank than the one at which they are made.
        self.stirs = np.zeros(self.base, bool)
        self.stirs[left[merged < left]] = self.stirs[right[merged < right]] = True
        self.side = np.array(sorted({ord(p[i]) << 21 | ord(p[i + 1]) for p in self.rank for i in range(len(p) - 1)}), np.int64)
        self.most, self.cache = most, {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where no piece joins them or a symbol is unknown (negative)."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], _NONE)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """After which characters no piece goes on to the next one."""
        key = (points[:-1].astype(np.int64) << 21) | points[1:]
        at = np.minimum(np.searchsorted(self.side, key), len(self.side) - 1)
        return self.side[at] != key

    def count(self, words: list[str]) -> np.ndarray:
        """Symbols left in each word, in bytes where unknown."""
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        kinds, back = np.unique(points, return_inverse=True)
        symbol = np.array([self.chars.get(chr(c), -1) for c in kinds.tolist()], np.int64)[back]
        weight = np.where(symbol < 0, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 1).astype(np.int64)
        head = np.zeros(len(points), bool)
        head[1:] = self.cuts(points)
        head[np.cumsum(size) - size] = True
        starts = np.flatnonzero(head)
        total = np.add.reduceat(weight, starts) - self.merges(symbol, starts)
        return np.add.reduceat(total, np.searchsorted(starts, np.cumsum(size) - size))

    def merges(self, symbol: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many merges each sequence takes; all sequences at once. In every round each one merges its pair of lowest
        rank, leftmost first: all its places where that can't make a pair of lower rank, else the first one only."""
        out, own = np.zeros(len(starts), np.int64), np.arange(len(starts))
        size = np.diff(np.append(starts, len(symbol)))
        last = np.zeros(len(symbol), bool)
        last[starts + size - 1] = True
        rank = np.where(last, _NONE, self.lookup(symbol, np.append(symbol[1:], -1)))
        while len(own):
            best = np.minimum.reduceat(rank, starts)
            going = best < _NONE
            if not going.all():  # these sequences are done
                stay = np.repeat(going, size)
                symbol, rank = symbol[stay], rank[stay]
                best, own, size = best[going], own[going], size[going]
                starts = np.cumsum(size) - size
                if not len(own):
                    break
            of = np.repeat(np.arange(len(own)), size)
            at = np.flatnonzero(rank == best[of])
            seq = of[at]
            first = np.append(True, seq[1:] != seq[:-1])
            keep = first | ~self.stirs[best[seq]]
            at, seq, first = at[keep], seq[keep], first[keep]
            # Of neighbouring places, which share a symbol, every other one.
            run = np.append(True, (at[1:] != at[:-1] + 1) | first[1:])
            odd = (np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) & 1
            at, seq = at[odd == 0], seq[odd == 0]
            symbol[at] = best[seq]
            taken = np.bincount(seq, minlength=len(own))
            out[own] += taken
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            symbol, rank = symbol[left], rank[left]
            at = at - np.arange(len(at))
            size = size - taken
            starts = np.cumsum(size) - size
            rank[at] = np.where(at == starts[seq] + size[seq] - 1, _NONE, self.lookup(symbol[at], np.append(symbol, -1)[at + 1]))
            before = at[at > starts[seq]] - 1
            rank[before] = self.lookup(symbol[before], symbol[before + 1])
        return out

    def batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split = []
        for t in texts:
            t = f" {t}" if t else ""
            if "▁" in t or "  " in t or t[-1:] == " ":
                split.append([w[1:] if w[:2] != "▁▁" and w[0] == "▁" and len(w) > 1 else "\0" + w for w in _RUNS.findall(t.replace(" ", "▁"))])
            else:
                split.append(t.split(" ")[1:])
        get = self.cache.get
        found = [list(map(get, p)) for p in split]
        fresh = list({w for p, v in zip(split, found, strict=True) for w, x in zip(p, v, strict=True) if x is None})
        if len(self.cache) + len(fresh) > self.most:
            self.cache = dict(islice(self.cache.items(), self.most // 2))  # common pre-tokens came first
        new: dict[str, int] = {}
        for i in range(0, len(fresh), 50_000):
            some = fresh[i : i + 50_000]
            new.update(zip(some, self.count([w[1:] if w[:1] == "\0" and len(w) > 1 and w[1] == "▁" else "▁" + w for w in some]).tolist(), strict=True))
        self.cache.update(new)
        return [sum(v) if None not in v else sum(new[w] if x is None else x for w, x in zip(p, v, strict=True)) for p, v in zip(split, found, strict=True)]


def counter(path: str) -> Pieces:
    """One for each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Pieces(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether that is over the limit, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                _, offsets = utf8(part.column(1))
                n = np.array(pieces.batch([t or "" for t in part.column(1).to_pylist()]), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
