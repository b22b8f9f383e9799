"""Word n-grams of texts as keys of 128 bits, found for whole batches at once; distinct ones counted exactly by an exchange of
packed keys, as exact as by MD5."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 4
_FACTORS = np.frombuffer(b"".join(hashlib.md5(f"place {k}".encode()).digest() for k in range(LONGEST)), "<u8").reshape(LONGEST, 2) | np.uint64(1)


def word_keys(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit keys (md5) of all words of a list<string> column, and the words of each list. Each distinct word is digested once."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    keys = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in coded.dictionary.to_pylist()), "<u8").reshape(-1, 2)
    return keys[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty((0, 2), np.uint64), lengths


def gram_keys(keys: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams within each list and the list of each: sums of the words' keys times odd factors of their places."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(rows))
    at = np.flatnonzero(left >= n)
    return sum((keys[at + k] * _FACTORS[k] for k in range(n)), np.zeros((len(at), 2), np.uint64)), rows[at]


def _unique(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, ordered."""
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    return keys[np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]] if len(keys) else keys


def distinct_grams(rows: DataFrame, n: int, most: int = 1_000_000) -> DataFrame:
    """rows (group int, w array<string>) to one row a group: group, total and uniques, its n-grams and the distinct ones among
    them. Tasks gather up to most keys, drop those that repeat, and exchange them packed by their first twelve bits."""

    def packed(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for group, parts in held.items():
            keys = np.concatenate(parts)
            total, keys = len(keys), _unique(keys)
            ends = np.searchsorted(keys[:, 0] >> np.uint64(52), np.arange(4097, dtype=np.uint64))
            own = [b for b in range(4096) if ends[b] < ends[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([group] * (len(own) + 1), pa.int32()), pa.array([0, *own], pa.int32()), pa.array([total] + [0] * len(own), pa.int64()), pa.array([b""] + [keys[ends[b] : ends[b + 1]].tobytes() for b in own], pa.binary())], names=["group", "bucket", "total", "keys"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        count = 0
        for batch in batches:
            keys, lengths = word_keys(batch.column(1))
            grams, of = gram_keys(keys, lengths, n)
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            for group in np.unique(groups):
                held.setdefault(int(group), []).append(grams[groups[of] == group])
            count += len(grams)
            if count >= most:
                yield from packed(held)
                held, count = {}, 0
        yield from packed(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        at, parts = None, []

        def close() -> None:
            if parts:
                sums[at[0]][1] += len(_unique(np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)))
                parts.clear()

        for batch in batches:
            for group, bucket, total, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, bucket) != at:
                    close()
                    at = group, bucket
                sums.setdefault(group, [0, 0])[0] += total
                parts.append(keys)
        close()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([t for t, _ in sums.values()], pa.int64()), pa.array([u for _, u in sums.values()], pa.int64())], names=["group", "total", "uniques"])

    dealt = rows.mapInArrow(find, "group int, bucket int, total bigint, keys binary").repartition("group", "bucket").sortWithinPartitions("group", "bucket")
    counted = dealt.mapInArrow(merge, "group int, total bigint, uniques bigint")
    return counted.groupBy("group").agg(F.sum("total").alias("total"), F.sum("uniques").alias("uniques"))


def counted_grams(rows: DataFrame) -> DataFrame:
    """rows (doc_id bigint, w array<string>) to doc_id, n, a, b (the key) and c: how often a text has each of its 1- to 4-grams."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths = word_keys(batch.column(1))
            ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            for n in range(1, LONGEST + 1):
                grams, of = gram_keys(keys, lengths, n)
                order = np.lexsort((grams[:, 1], grams[:, 0], of))
                grams, of = grams[order], of[order]
                first = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]).any(axis=1) | (of[1:] != of[:-1])]) if len(of) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[of[first]], pa.int64()), pa.array(np.full(len(first), n), pa.int32()), pa.array(grams[first, 0].view(np.int64)), pa.array(grams[first, 1].view(np.int64)), pa.array(np.diff(np.r_[first, len(of)]), pa.int64())], names=["doc_id", "n", "a", "b", "c"])

    return rows.mapInArrow(find, "doc_id bigint, n int, a bigint, b bigint, c bigint")


def largest_counts(rows: DataFrame, asked: list[np.ndarray]) -> DataFrame:
    """rows (doc_id bigint, unique, w array<string>) to rows of each task: n, a, b, first (the largest count of an asked gram in
    a text), who (the text), second (the largest in another one); with n 0 how many texts (first) have a words. asked: the keys
    of the asked n-grams by n from 1, ordered."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for keys in asked:
            maybe = np.zeros(1 << 20, bool)  # most grams aren't asked for: a look at 20 bits tells
            maybe[keys[:, 0] >> np.uint64(44)] = True
            seen.append((maybe, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)))
        sizes: dict[int, int] = {}
        for batch in batches:
            words, lengths = word_keys(batch.column(1))
            ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            for size, many in zip(*np.unique(lengths, return_counts=True), strict=True):
                sizes[int(size)] = sizes.get(int(size), 0) + int(many)
            for n, (keys, (maybe, first, who, second)) in enumerate(zip(asked, seen, strict=True), 1):
                grams, of = gram_keys(words, lengths, n)
                hit = np.flatnonzero(maybe[grams[:, 0] >> np.uint64(44)])
                grams, of = grams[hit], of[hit]
                slot = np.searchsorted(keys[:, 0], grams[:, 0])
                while True:  # equal first halves of different keys: none but by chance
                    inside = np.minimum(slot, max(len(keys) - 1, 0))
                    further = (slot < len(keys)) & (keys[inside, 0] == grams[:, 0]) & (keys[inside, 1] != grams[:, 1]) if len(keys) else np.zeros(len(slot), bool)
                    if not further.any():
                        break
                    slot = slot + further
                found = np.flatnonzero((slot < len(keys)) & (keys[inside] == grams).all(axis=1)) if len(keys) else np.empty(0, np.int64)
                pairs, many = np.unique(slot[found] * len(lengths) + of[found], return_counts=True)
                slots, docs = np.divmod(pairs, max(len(lengths), 1))
                order = np.lexsort((-many, slots))
                slots, docs, many = slots[order], docs[order], many[order]
                place = np.arange(len(slots)) - np.searchsorted(slots, slots)
                for k in (0, 1):  # of a batch, the two texts with the largest counts are enough
                    s, d, m = slots[place == k], docs[place == k], many[place == k]
                    more = m > first[s]
                    second[s] = np.where(more, first[s], np.maximum(second[s], m))
                    who[s], first[s] = np.where(more, ids[d], who[s]), np.where(more, m, first[s])
        for n, (keys, (_, first, who, second)) in enumerate(zip(asked, seen, strict=True), 1):
            at = np.flatnonzero(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n), pa.int32()), *(pa.array(x) for x in (keys[at, 0].view(np.int64), keys[at, 1].view(np.int64), first[at], who[at], second[at]))], names=["n", "a", "b", "first", "who", "second"])
        none = pa.array([None] * len(sizes), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(sizes), pa.int32()), pa.array(list(sizes), pa.int64()), none, pa.array(list(sizes.values()), pa.int64()), none, none], names=["n", "a", "b", "first", "who", "second"])

    return rows.mapInArrow(find, "n int, a bigint, b bigint, first bigint, who bigint, second bigint")
