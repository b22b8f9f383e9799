"""Removal of repeated windows of words, with a count-min prefilter.

A window is ``width`` consecutive words of one document. A word is removed if a window covers it whose word sequence also
starts in a document with a smaller doc_id, judged on the input.

Windows are hashed in bulk. The smallest hash of the short grams inside a window is its anchor; equal windows have equal
anchors, and neighbouring windows mostly share one, so a document is a row of runs of windows of one anchor.

1. Anchors are dealt to shards by their hash, so many that a shard's load is the same whatever the input. A task counts the
   anchors at hand in a count-min sketch for each shard, ``depth`` rows of cells, and sends the touched cells; a shard's
   sketches are merged by adding them up. An anchor's estimate is never below the number of documents that hold any one of
   its windows. The tasks also ask the shard for the anchors they hold once; those they hold twice are known to repeat, so a
   passage in a third of all documents is a question for each task, not for each document. A shard answers with the
   documents whose anchors are estimated repeated.
2. A second pass over the documents that got an answer exactly groups only the windows estimated repeated. A task first
   groups its own: of each window it keeps the smallest document for the others to see, and knows the rest as removed. What
   it keeps is dealt out by anchor and grouped again in the order of a sort, so a task holds a few groups at a time.
3. Windows of anchors with a share of all runs of ``hot`` or more, and ``least`` at least (at most 2 / hot anchors, found in
   the first pass), are dealt out by their hashes to as many places as that share asks for, so that unlike windows around
   a common passage don't meet in one place.

Windows are told apart by two 64-bit hashes together. Estimates that are too high send more windows through the second
pass and change no result; none is lost.

Null and empty texts have no words; an empty table has no rows. Rows of one doc_id don't remove each other's words; rows
that agree in id and text have equal results. A null doc_id counts as larger than all others, and null ids as one document.
Very long texts are read whole. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, grams, i64, lists, mix, powers, slices, utf8, within, word_hashes
from .tables import keep

_WINDOW = 0xC2B2AE3D27D4EB4F
_SALTS = [U64(0x9E3779B97F4A7C15), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5), U64(0x85EBCA77C2B2AE63)]
KEY = ("doc", "none", "text_key")  # doc_id (0 where null), whether it is null, a hash of the text


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours."""
    have, step = x, 1
    while step * 2 <= n:
        have, step = np.minimum(have[:-step], have[step:]), step * 2
    rest = n - step
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class Runs:
    """Runs of windows of one anchor in a slice of rows: row, first word in it, anchor, and the hash of each window."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
        hashes, first = word_hashes(data, offsets)
        at, row = within(first, width)
        self.n_words = np.diff(first)
        if not len(at):
            self.row = self.word = self.starts = np.zeros(0, np.int64)
            self.anchor = self.window = np.zeros(0, np.uint64)
            return
        anchor = _smallest(grams(hashes, gram), width - gram + 1)[at]
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_WINDOW, len(hashes)), out=total[1:])
        self.window = mix((total[at + width] - total[at]) * powers(pow(_WINDOW, -1, 2**64), len(hashes))[at])
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        self.starts = np.flatnonzero(new)
        self.row, self.anchor = row[self.starts], anchor[self.starts]
        self.word = at[self.starts] - first[:-1][self.row]
        self.starts = np.append(self.starts, len(at))


def cells_of(anchor: np.ndarray, depth: int, cells: int) -> np.ndarray:
    """The cell of each anchor in each row of its shard's sketch, as indices into all rows together."""
    return np.stack([(mix(anchor ^ _SALTS[k]) & U64(cells - 1)).astype(np.int64) + k * cells for k in range(depth)])


def shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Anchors are minima, so they are mixed to be spread evenly."""
    return ((mix(anchor) >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _ends(sorted_: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Distinct values of a sorted array with the bounds of each."""
    value, start = np.unique(sorted_, return_index=True)
    return value, start.tolist(), [*start[1:].tolist(), len(sorted_)]


def repeated(docs: DataFrame, width: int, gram: int, depth: int, shards: int, cells: int, hot: float, buffer: int) -> DataFrame:
    """doc, none, text_key and anchor of the anchors estimated repeated; also rows with n: an anchor that a task holds often."""
    names = ["shard", "kind", "a", "doc", "none", "text_key"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            doc, none, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            for i, j in slices(offsets):
                runs = Runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, gram)
                pair = np.lexsort((runs.anchor, runs.row))
                row, anchor = runs.row[pair], runs.anchor[pair]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                row = row[new]
                held.append((anchor[new], doc[i:j][row], none[i:j][row], key[i:j][row]))
                size += len(row)
                if size >= buffer:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def rows(kind: int, shard: np.ndarray, values: np.ndarray, doc: np.ndarray | None = None, none: np.ndarray | None = None, key: np.ndarray | None = None) -> pa.RecordBatch:
        """One row for each shard, with all its values as bytes."""
        order = np.argsort(shard, kind="stable")
        of, start, stop = _ends(shard[order])
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(start, stop, strict=True)] if x is not None else [b""] * len(of), pa.binary())
        sort = lambda x: None if x is None else x[order]
        return pa.RecordBatch.from_arrays([pa.array(of.astype(np.int64)), pa.array([kind] * len(of), pa.int32()), cut(values[order]), cut(sort(doc)), cut(sort(none)), cut(sort(key))], names=names)

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, doc, none, key = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(anchor, kind="stable")
        anchor, doc, none, key = anchor[order], doc[order], none[order], key[order]
        own, start, stop = _ends(anchor)
        n = np.array(stop) - start
        # Touched cells with their counts, clipped: only one and more than one differ.
        cell = cells_of(own, depth, cells) + shard_of(own, shards) * (depth * cells)
        touched, back = np.unique(cell.ravel(), return_inverse=True)
        total = np.minimum(np.bincount(back, np.tile(np.minimum(n, 2), depth)), 2).astype(np.uint32)
        yield rows(0, touched // (depth * cells), (touched % (depth * cells)).astype(np.uint32) | total << 28)
        once = np.repeat(n == 1, n)
        if once.any():
            yield rows(1, shard_of(anchor[once], shards), anchor[once], doc[once], none[once], key[once])
        if not once.all():  # known to repeat; spread over the shards by document
            spread = shard_of(mix(doc[~once].astype(np.uint64) + key[~once].astype(np.uint64)), shards)
            yield rows(2, spread, anchor[~once], doc[~once], none[~once], key[~once])
        often = n >= max(2, hot / 2 * len(anchor))
        if often.any():
            yield rows(3, shard_of(own[often], shards), own[often], n[often].astype(np.int64))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's sketches come first, then its questions."""
        at, sketch = None, np.zeros(depth * cells, np.uint8)
        for batch in batches:
            out = []
            shard, kind, values, docs_, nones, keys = (c.to_pylist() for c in batch.columns)
            for s, k, raw, doc, none, key in zip(shard, kind, values, docs_, nones, keys, strict=True):
                if s != at:
                    at = s
                    sketch[:] = 0
                if k == 0:
                    x = np.frombuffer(raw, np.uint32)
                    cell = x & 0xFFFFFFF
                    sketch[cell] = np.minimum(sketch[cell] + (x >> 28).astype(np.uint8), 2)
                    continue
                anchor, doc = np.frombuffer(raw, np.uint64), np.frombuffer(doc, np.int64)
                if k == 3:
                    out.append((np.zeros_like(doc), np.zeros(len(doc), bool), np.zeros_like(doc), anchor, doc))
                    continue
                none, key = np.frombuffer(none, bool), np.frombuffer(key, np.int64)
                ok = (sketch[cells_of(anchor, depth, cells)] >= 2).all(axis=0) if k == 1 else np.ones(len(doc), bool)
                out.append((doc[ok], none[ok], key[ok], anchor[ok], np.zeros(int(ok.sum()), np.int64)))
            if out:
                doc, none, key, anchor, n = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(none), pa.array(key), pa.array(i64(anchor)), pa.array(n)], names=[*KEY, "anchor", "n"])

    asked = docs.select("doc", "none", "text", "text_key").mapInArrow(count, "shard bigint, kind int, a binary, doc binary, none binary, text_key binary")
    return asked.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, "doc bigint, none boolean, text_key bigint, anchor bigint, n bigint")


def _resolve(anchor: np.ndarray, window: np.ndarray, doc: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same window; null ids are larger than all others."""
    order = np.lexsort((doc, none, window, anchor))
    a, w, d, x = anchor[order], window[order], doc[order], none[order]
    head = np.ones(len(d), bool)
    head[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    least = np.flatnonzero(head)[np.cumsum(head) - 1]
    out = np.empty(len(d), bool)
    out[order] = (d != d[least]) | (x != x[least])
    return out


def removed_spans(docs: DataFrame, width: int = 50, gram: int = 8, depth: int = 3, load: int = 1 << 18, cells: int | None = None, hot: float = 1e-5, least: int = 200, buffer: int = 2_000_000) -> DataFrame:
    """The key and the spans of words (first, end) that go, for documents that lose any.

    docs: doc, none, text, text_key. buffer: runs or windows that a task holds; load: anchors a shard of the sketch is meant for; cells: of each row of its sketch."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = size / 6 / ((width - gram + 2) / 2)  # a word has some 6 bytes; an anchor serves half a window
    shards = max(int(runs / load), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = cells or 1 << max(10, int(np.ceil(np.log2(2 * runs / shards + 1))))
    many = max(hot / 2 * runs, least / 2)
    found = keep(repeated(docs, width, gram, depth, shards, cells, hot, buffer))
    often = found.where("n > 0").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= many).orderBy("anchor").collect()  # 2 / hot rows at most
    hot_anchor = np.array([r["anchor"] for r in often], np.int64)
    hot_places = np.array([1 + int(r["n"] / many) for r in often], np.int64)
    shared = spark.sparkContext.broadcast((hot_anchor, hot_places))
    answers = found.where("n = 0").groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            doc, none, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            wanted, n = i64(batch.column(4).flatten().to_numpy()).view(np.uint64), np.asarray(batch.column(4).value_lengths())
            upto = np.append(0, np.cumsum(n))
            for i, j in slices(offsets):
                runs = Runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, gram)
                if not len(runs.row):
                    continue
                of = lambda row, anchor: mix(anchor ^ mix(row.astype(np.uint64)))
                take = np.flatnonzero(np.isin(of(runs.row, runs.anchor), of(np.repeat(np.arange(j - i), n[i:j]), wanted[upto[i] : upto[j]])))
                length = np.diff(runs.starts)[take]
                where = np.repeat(runs.starts[:-1][take] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                row = runs.row[take]
                held.append((i64(runs.anchor[take]), doc[i:j][row], none[i:j][row], key[i:j][row], runs.word[take], length, i64(runs.window[where])))
                size += len(where)
                if size >= buffer:
                    yield from local(held)
                    held, size = [], 0
        if held:
            yield from local(held)

    def local(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Neighbouring windows of a run with one fate as a row: those that a smaller document here has, only their number;
        open ones with their hashes. Open windows of hot anchors are dealt out by their hashes, with their words."""
        anchor, doc, none, key, word, n, window = map(np.concatenate, zip(*held, strict=True))
        run = np.repeat(np.arange(len(n)), n)
        at_word = word[run] + np.arange(len(run)) - (np.cumsum(n) - n)[run]
        gone = _resolve(anchor[run], window, doc[run], none[run])
        hot_anchors, hot_places = shared.value
        at = np.minimum(np.searchsorted(hot_anchors, anchor), max(len(hot_anchors) - 1, 0))
        places = np.where(hot_anchors[at] == anchor, hot_places[at], 1) if len(hot_anchors) else np.ones(len(anchor), np.int64)
        state = gone + 2 * (~gone & (places[run] > 1))  # 0 open, 1 known, 2 open and hot
        cut = np.ones(len(run), bool)
        cut[1:] = (run[1:] != run[:-1]) | (state[1:] != state[:-1])
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(run))
        plain = state[start] < 2
        start, stop = start[plain], stop[plain]
        of, known = run[start], gone[start]
        size = np.where(known, 1, stop - start)  # a known piece holds its length as its one element
        values = np.empty(size.sum(), np.int64)
        values[(np.cumsum(size) - size)[known]] = (stop - start)[known]
        values[np.repeat(~known, size)] = window[state == 0]
        own = np.where(known, i64(mix(doc[of].astype(np.uint64) + start.astype(np.uint64))), anchor[of])  # known ones are spread
        none_ = np.zeros(0, np.int32)
        yield told(own, np.zeros(len(of), np.int64), doc[of], none[of], key[of], at_word[start], known, values, size, none_, np.zeros(len(of), np.int64))
        hot_ = np.flatnonzero(state == 2)
        if len(hot_):
            sub = (mix(window[hot_].view(np.uint64)) >> U64(8)).astype(np.int64) % places[run[hot_]]
            order = np.lexsort((sub, run[hot_]))
            hot_, sub = hot_[order], sub[order]
            head = np.ones(len(hot_), bool)
            head[1:] = (sub[1:] != sub[:-1]) | (run[hot_][1:] != run[hot_][:-1])
            start = np.flatnonzero(head)
            size, of = np.diff(np.append(start, len(hot_))), run[hot_[start]]
            yield told(anchor[of], sub[start], doc[of], none[of], key[of], at_word[hot_[start]], np.zeros(len(of), bool), window[hot_], size, at_word[hot_], size)

    def told(anchor, sub, doc, none, key, word, known, windows, size, words, sizes) -> pa.RecordBatch:
        ends = lambda n: np.append(0, np.cumsum(n))
        return pa.RecordBatch.from_arrays([*map(pa.array, (anchor, sub, doc, none, key, word.astype(np.int32), known)), lists(windows, ends(size), pa.int64()), lists(words.astype(np.int32), ends(sizes), pa.int32())], names=["anchor", "sub", *KEY, "word", "known", "windows", "words"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Open pieces of an anchor and place come together; groups are settled when the next one has begun."""
        held: list[tuple] = []
        size = 0

        def spans(doc, none, key, first, end) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, (doc, none, key, first, end))], names=[*KEY, "first", "end"])

        def done(rows: tuple) -> pa.RecordBatch:
            anchor, _, doc, none, key, n, window, word = rows
            of = np.repeat(np.arange(len(n)), n)
            gone = _resolve(anchor[of], window, doc[of], none[of])
            cut = np.ones(len(of), bool)
            cut[1:] = (of[1:] != of[:-1]) | (gone[1:] != gone[:-1]) | (word[1:] != word[:-1] + 1)
            start = np.flatnonzero(cut)
            stop = np.append(start[1:], len(of))
            start, stop = start[gone[start]], stop[gone[start]]
            own = of[start]
            return spans(doc[own], none[own], key[own], word[start], word[stop - 1] + width)

        for batch in batches:
            anchor, sub, doc, none, key, word, known = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            n, flat = np.asarray(batch.column(7).value_lengths()), np.asarray(batch.column(7).flatten())
            dealt, words = np.asarray(batch.column(8).value_lengths()), np.asarray(batch.column(8).flatten())
            at = np.cumsum(n) - n
            if known.any():
                w = word[known].astype(np.int64)
                yield spans(doc[known], none[known], key[known], w, w + flat[at[known]] + width - 1)
            o = ~known
            if not o.any():
                continue
            place = np.repeat(word.astype(np.int64) - at, n) + np.arange(len(flat))
            place[np.repeat(dealt > 0, n)] = words
            take = np.repeat(o, n)
            held.append((anchor[o], sub[o], doc[o], none[o], key[o], n[o], flat[take], place[take]))
            size += len(held[-1][-1])
            if size >= buffer:
                rows = tuple(map(np.concatenate, zip(*held, strict=True)))
                others = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
                end = int(others[-1]) + 1 if len(others) else 0  # the last group may go on
                windows = int(rows[5][:end].sum())
                if end:
                    yield done((*(x[:end] for x in rows[:6]), *(x[:windows] for x in rows[6:])))
                held = [(*(x[end:] for x in rows[:6]), *(x[windows:] for x in rows[6:]))]
                size = len(held[0][-1])
        if held:
            yield done(tuple(map(np.concatenate, zip(*held, strict=True))))

    # Inner side of both joins are the same shuffled texts, which Spark reuses.
    texts = docs.join(answers.hint("shuffle_hash"), list(KEY)).select("doc", "none", "text", "text_key", "anchors")
    pieces = texts.mapInArrow(candidates, "anchor bigint, sub bigint, doc bigint, none boolean, text_key bigint, word int, known boolean, windows array<bigint>, words array<int>")
    spans = pieces.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub").mapInArrow(settle, "doc bigint, none boolean, text_key bigint, first bigint, end bigint")
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def dedup_substrings(docs: DataFrame, width: int = 50, texts: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with texts also the kept words joined by spaces."""
    doc_id, text = docs["doc_id"].cast("bigint"), docs["text"].cast("string")
    docs = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc"), doc_id.isNull().alias("none"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    spans = removed_spans(docs, width, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, none, text, gone in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = (text or "").encode().split()  # the six ASCII white-space bytes
                n, kept = len(own), own
                if gone:
                    kept, at = [], 0
                    for first, end in sorted((g["first"], g["end"]) for g in gone):
                        if first > at:
                            kept += own[at:first]
                        at = max(at, end)
                    kept += own[at:]
                joined = b" ".join(kept)
                out.append((None if none else doc, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if texts else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 5 if texts else 4], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if texts else 4])

    joined = docs.join(spans.hint("shuffle_hash"), list(KEY), "left").select("doc", "none", "text", "spans")
    return joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if texts else ""))
