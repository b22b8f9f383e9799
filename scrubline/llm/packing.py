"""Cost-balanced packing of tokenised documents into fixed-size training sequences.

Each document becomes its byte-level BPE ids followed by one separator id. Whole multiples of the capacity fill
sequences of their own. What is left of each document is assigned in descending length to the sequence of lowest
estimated cost (linear + quadratic attention cost of its pieces) that can still hold it; where none can, the piece is
cut and fills the cheapest open sequences. The number of sequences is fixed beforehand from the tokens at hand, the last
ones having powers of two as their capacities, so nothing is padded.

It is one pass without a shuffle: a task packs its own rows, buffer by buffer, so memory is bounded by
``buffer_tokens`` and one document. Null and empty texts are one separator id. Repeated rows are packed once each.
An empty table gives an empty result. Documents of one length keep their order of rows; among sequences of one cost the
first is taken. Other columns aren't read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

# The published pre-tokenisation pattern of this family of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_ENCODERS: dict[tuple[str, int], BytePairs] = {}


class BytePairs:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    A cut before a space that a non-space character follows is always a pre-token boundary, so ids are found once per
    distinct space-separated chunk and kept in a cache of bounded size; only new chunks are merged.
    """

    def __init__(self, path: str, most: int = 600_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.special, self.most, self.cache = special, most, {}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.width = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        self.width[list(ranks.values())] = [len(p) for p in ranks]

    def learn(self, chunks: list[str]) -> None:
        """Ids of each chunk with a space before it, found in one call over all of them."""
        if not chunks:
            return
        if len(self.cache) + len(chunks) > self.most:
            self.cache = dict(islice(self.cache.items(), self.most // 2))  # common chunks came first
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(chunks)), "<u4")
        raw, ends = ids.tobytes(), np.cumsum(self.width[ids])
        upto = np.searchsorted(ends, np.cumsum([len(c.encode()) + 1 for c in chunks])) * 4 + 4
        at = 0
        for chunk, to in zip(chunks, upto.tolist(), strict=True):
            self.cache[chunk] = raw[at:to]
            at = to

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        simple = [not any(s in t for s in self.special) for t in texts]
        split = [t.split(" ") if s else [] for t, s in zip(texts, simple, strict=True)]
        get = self.cache.get
        found = [list(map(get, p)) for p in split]
        fresh = {w for p, v in zip(split, found, strict=True) for w, x in zip(p[1:], v[1:], strict=True) if x is None and w}
        self.learn([w for w in fresh if not w[0].isspace()])
        get = self.cache.get
        for text, ok, parts, ids in zip(texts, simple, split, found, strict=True):
            if ok and None in ids[1:]:
                ids = [get(w) if x is None else x for w, x in zip(parts, ids, strict=True)]
                ok = None not in ids[1:]  # else there is an empty chunk, or one that begins with white space
            if ok:
                ids[0] = np.array(self.encoding.encode_ordinary(parts[0]), "<u4").tobytes()
                yield b"".join(ids)
            else:
                yield self.whole(text)


def encoder(path: str, most: int = 600_000) -> BytePairs:
    """One for each Python worker."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = BytePairs(path, most)
    return _ENCODERS[path, most]


class _Cheapest:
    """Open sequences by what they can still hold, with the lowest cost over every range of capacities."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree = [(float("inf"), -1, -1)] * (2 * self.size)

    def _refresh(self, room: int) -> None:
        heap, tree = self.heaps[room], self.tree
        i = room + self.size
        tree[i] = (*heap[0], room) if heap else (float("inf"), -1, -1)
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a < b else b
            if tree[i] == best:
                break
            tree[i] = best

    def push(self, cost: float, sequence: int, room: int) -> None:
        if room:
            heappush(self.heaps[room], (cost, sequence))
            self._refresh(room)

    def pop(self, least: int) -> tuple[float, int, int] | None:
        """The cheapest of those that can hold least more tokens."""
        lo, hi, best = least + self.size, 2 * self.size, (float("inf"), -1, -1)
        tree = self.tree
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, tree[hi])
            lo >>= 1
            hi >>= 1
        if best[1] < 0:
            return None
        heappop(self.heaps[best[2]])
        self._refresh(best[2])
        return best


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and the number of sequences."""
    pieces, full, rest = [], 0, []
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((d, k * capacity, capacity, full, 0))
            full += 1
        if n % capacity:
            rest.append((n % capacity, d))
    total = sum(n for n, _ in rest)
    rooms = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    used, open_ = [0] * len(rooms), _Cheapest(capacity)
    for k, room in enumerate(rooms):
        open_.push(0.0, k, room)
    rest.sort(key=lambda x: -x[0])  # stable: ties keep the order of rows
    for n, d in rest:
        start = lengths[d] - n
        while n:
            cost, k, room = open_.pop(n) or open_.pop(1)
            take = min(n, room)
            pieces.append((d, start, take, full + k, used[k]))
            used[k] += take
            start, n = start + take, n - take
            open_.push(cost + linear * take + quadratic * take * take, k, room - take)
    return pieces, full + len(rooms)


def pack(docs: DataFrame, path: str, capacity: int = 1024, separator: int = 0, buffer_tokens: int = 2_000_000, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """All documents as pieces of sequences of at most capacity tokens; capacity is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("capacity: a power of two")
    end = np.array([separator], "<u4").tobytes()

    def flush(ids: list, held: list[bytes], at: int) -> tuple[pa.RecordBatch, int]:
        pieces, n = assign([len(b) // 4 for b in held], capacity, linear, quadratic)
        d, start, length, sequence, offset = np.array(pieces, np.int64).T
        crc = [zlib.crc32(memoryview(held[i])[4 * s : 4 * (s + m)]) for i, s, m, _, _ in pieces]
        tokens = np.array([len(b) // 4 for b in held], np.int64)[d]
        columns = [pa.array(ids, pa.int64()).take(pa.array(d)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens), pa.array(sequence + at), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")]), at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = encoder(path)
        at = TaskContext.get().partitionId() << 40
        ids, held, size = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, b in zip(part.column(0).to_pylist(), pairs.batch([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids.append(doc_id)
                    held.append(b + end)
                    size += len(b) // 4 + 1
                    if size >= buffer_tokens:
                        out, at = flush(ids, held, at)
                        yield out
                        ids, held, size = [], [], 0
        if held:
            yield flush(ids, held, at)[0]

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
