"""Quality classifier by co-training of two views.

The content view sees which words a text holds (lower-cased, without punctuation, hashed). The page view sees no word: it
has the metadata source and language, each hashed whole into 256 places, and the layout: length, lines, shares of capitals,
digits, signs and white space, mean word length, share of distinct words. A document is good if it is labelled of quality 1
and not toxic.

Both views are logistic models fitted on the driver to a bounded sample of at most ``labelled`` labelled documents, chosen
by a hash of their ids. In each round both views judge all documents outside that sample in one pass, whatever their
number, and those of which a view is most confident join the training rows of the other: up to a tenth of them in each
round and class, ``handed`` at most, as they are held on the driver. The content view weighs the ``features`` words that
tell the labelled sample's classes apart best. Both are then calibrated on labelled documents held out, their
log odds are combined by a third small model fitted there, and all documents are scored in one pass.

Null texts, languages and sources count as empty; long texts are read whole, in slices of rows. An empty table has no rows.
Without labels of both classes every score is 0.5 and everything stays. Equal rows have equal scores; a score at the
threshold stays. Of labelled documents with one id the row with the least hash stands for all, and an id labelled twice is
good if one of its labels says so; labels without an id or a quality aren't used. Other columns aren't read, whatever
their names. All bounds (``labelled``, ``handed``, ``rounds``, ``features``) are parameters.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import TABLE, U64, bare_words, lists, mix, slices, span_sums, utf8
from .tables import keep

WORD_BITS, PLACE_BITS = 18, 8
PLACES = 1 << PLACE_BITS
DENSE = 8
SCORES = "doc_id bigint, content_score double, page_score double, score double, keep boolean"


def _classes() -> np.ndarray:
    """Byte classes: capital, digit, other ASCII sign, line feed, white space."""
    out = np.zeros((5, 256), bool)
    out[0, 65:91] = out[1, 48:58] = True
    letters = np.r_[65:91, 97:123, 48:58, 128:256, 9:14, 32]
    out[2] = True
    out[2, letters] = False
    out[3, 10] = True
    out[4, [9, 10, 11, 12, 13, 32]] = True
    return out


CLASSES = _classes()


def views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i:j of (text, lang, source) with the page view (dense), and row and bucket of each distinct word."""
    data, offsets = utf8(batch.column("text"))
    for i, j in ((k, min(k + 4096, j)) for i, j in slices(offsets) for k in range(i, j, 4096)):  # the page view is dense
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        hashes, first = bare_words(own, at)
        n = np.maximum(np.diff(at), 1).astype(np.float64)
        share = []
        for kind in CLASSES:
            total = np.append(0, np.cumsum(kind[own], dtype=np.int64))
            share.append((total[at[1:]] - total[at[:-1]]) / n)
        count = np.maximum(np.diff(first), 1)
        row = np.repeat(np.arange(j - i), np.diff(first))
        bucket = (hashes >> U64(64 - WORD_BITS)).astype(np.int64)
        pairs = np.unique((row << WORD_BITS) | bucket)
        row, bucket = pairs >> WORD_BITS, pairs & ((1 << WORD_BITS) - 1)
        distinct = np.bincount(row, minlength=j - i) / count
        page = np.zeros((j - i, DENSE + 2 * PLACES), np.float64)
        page[:, :DENSE] = np.stack([np.log1p(np.diff(at)) / 10, np.minimum(share[3] * 50, 2), share[0] * 3, share[1] * 5, share[2] * 3, share[4] * 3, distinct, np.minimum(n / count / 10, 3)], 1)
        for k, name in enumerate(("lang", "source")):
            raw, ends = utf8(batch.column(name).slice(i, j - i))
            place = (mix(span_sums(TABLE[raw], ends[:-1], ends[1:])) >> U64(64 - PLACE_BITS)).astype(np.int64)
            page[np.arange(j - i), DENSE + k * PLACES + place] = 1
        yield i, j, page, row, bucket


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 200) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    total = weight.sum()
    scale = 0.25 * float((weight[:, None] * x * x).sum() / total) + penalty
    w = v = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        g = x.T @ (weight * (_sigmoid(x @ v) - y)) / total + penalty * np.append(v[:-1], 0)
        new = v - g / scale
        v = new + k / (k + 3) * (new - w)
        w = new
    return w.astype(np.float64)


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def train(page: np.ndarray, words: list[np.ndarray], label: np.ndarray, judge: Callable[[dict, list[set[int]]], list[tuple]], rounds: int = 3, features: int = 800) -> dict | None:
    """The model. label: 1 good, 0 bad. judge gives what a round's model is most confident of, but for the keys that a
    view has handed on before: (view, answer, key, page, columns of the words) each."""
    known = np.arange(len(label))
    if len(set(label[known].tolist())) < 2:
        return None
    held = known[::4] if len(known) >= 40 and len(set(label[known[::4]].tolist())) == 2 else known
    fit = np.setdiff1d(known, held) if len(held) < len(known) else known
    if len(set(label[fit].tolist())) < 2:
        fit = known
    size = 1 << WORD_BITS
    good, bad = ([words[k] for k in fit if label[k] == c] for c in (1, 0))
    has = [np.bincount(np.concatenate(g), minlength=size).astype(np.float64) for g in (good, bad)]
    rate = [(h + 0.5) / (len(g) + 1) for h, g in zip(has, (good, bad), strict=True)]
    spread = np.sqrt(rate[0] * (1 - rate[0]) / len(good) + rate[1] * (1 - rate[1]) / len(bad))
    z = np.where(has[0] + has[1] >= 3, np.abs(rate[0] - rate[1]) / spread, 0)
    chosen = np.sort(np.argsort(-z, kind="stable")[:features])
    chosen = chosen[z[chosen] > 0]
    column = np.full(size, -1)
    column[chosen] = np.arange(len(chosen))
    content = np.zeros((len(words), len(chosen)), np.float32)
    for k, b in enumerate(words):
        c = column[b]
        content[k, c[c >= 0]] = 1
    mean, dev = page[fit].mean(0), page[fit].std(0) + 1e-3
    dev[DENSE:] = np.maximum(dev[DENSE:], 0.1)  # rare places don't outweigh the rest
    scaled = ((page - mean) / dev).astype(np.float32)
    # Layout matters away from the mean on either side.
    scaled = np.hstack([scaled, np.minimum(scaled[:, :DENSE] ** 2, 25) / 5])
    both, penalty = (content, scaled), (3e-4, 1e-3)
    rows = [both[v][fit] for v in (0, 1)]
    answer = [label[fit].astype(np.float32), label[fit].astype(np.float32)]
    trust = [np.ones(len(fit), np.float32), np.ones(len(fit), np.float32)]
    handed: list[set[int]] = [set(), set()]
    for turn in range(rounds + 1):
        w = [_fit(rows[v], answer[v], trust[v], penalty[v]) for v in (0, 1)]
        scale = [_fit(_odds(both[v][held], w[v])[:, None], label[held].astype(np.float64), np.ones(len(held)), 1e-3) for v in (0, 1)]
        table = np.zeros(size)
        table[chosen] = w[0][:-1]
        model = {"words": table, "bias": w[0][-1], "page": w[1], "mean": mean, "dev": dev, "scale": scale, "joint": np.zeros(3), "column": column}
        if turn == rounds:
            break
        more: list[list[np.ndarray]] = [[], []]
        for view, value, key, p, found in judge(model, handed):  # what a view is confident of teaches the other
            if key in handed[view]:
                continue
            handed[view].add(key)
            if view == 0:
                x = ((p - mean) / dev).astype(np.float32)
                new = np.append(x, np.minimum(x[:DENSE] ** 2, 25) / 5)
            else:
                new = np.zeros(len(chosen), np.float32)
                new[found] = 1
            more[1 - view].append(new.astype(np.float32))
            answer[1 - view] = np.append(answer[1 - view], np.float32(value))
            trust[1 - view] = np.append(trust[1 - view], np.float32(0.3))
        rows = [np.vstack([rows[v], *more[v]]) for v in (0, 1)]
    odds = np.stack([_odds(_odds(both[v][held], w[v])[:, None], scale[v]) for v in (0, 1)], 1)
    del model["column"]
    return model | {"joint": _fit(odds, label[held].astype(np.float64), np.ones(len(held)), 1e-3)}


def score(model: dict, page: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scaled = (page - model["mean"]) / model["dev"]
    scaled = np.hstack([scaled, np.minimum(scaled[:, :DENSE] ** 2, 25) / 5])
    content = np.bincount(row, weights=model["words"][bucket], minlength=len(page)) + model["bias"]
    calibrated = np.stack([_odds(o[:, None], s) for o, s in zip((content, _odds(scaled, model["page"])), model["scale"], strict=True)], 1)
    return _sigmoid(calibrated[:, 0]), _sigmoid(calibrated[:, 1]), _sigmoid(_odds(calibrated, model["joint"]))


def sample(docs: DataFrame, labels: DataFrame, labelled: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Both views of the labelled sample, its labels, and its ids."""
    labels = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("label"))
    some = labels.orderBy(F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")).limit(labelled)
    # At most labelled rows.
    chosen = F.broadcast(some.groupBy("doc_id").agg(F.max("label").alias("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, page, row, bucket in views(batch):
                ends = np.searchsorted(row, np.arange(j - i + 1))
                small = np.hstack([page[:, :DENSE], np.stack([page[:, DENSE : DENSE + PLACES].argmax(1), page[:, DENSE + PLACES :].argmax(1)], 1)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), lists(small.ravel(), np.arange(j - i + 1) * (DENSE + 2), pa.float64()), lists(bucket.astype(np.int32), ends, pa.int32())], names=["doc_id", "label", "page", "words"])

    rest = ("text", "lang", "source")
    one = docs.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("row")).select("doc_id", "label", "row.*")
    got = one.mapInArrow(run, "doc_id bigint, label int, page array<double>, words array<int>").toArrow()
    if not got.num_rows:
        return np.zeros((0, DENSE + 2 * PLACES)), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = got.sort_by("doc_id").combine_chunks()
    small = got["page"].combine_chunks().flatten().to_numpy().reshape(-1, DENSE + 2)
    page = np.zeros((len(small), DENSE + 2 * PLACES))
    page[:, :DENSE] = small[:, :DENSE]
    for k in (0, 1):
        page[np.arange(len(small)), DENSE + k * PLACES + small[:, DENSE + k].astype(np.int64)] = 1
    own = got["words"].combine_chunks()
    words = np.split(own.flatten().to_numpy().astype(np.int64), np.cumsum(np.asarray(own.value_lengths()))[:-1])
    return page, words, got["label"].to_numpy().astype(np.int64), np.unique(got["doc_id"].to_numpy())


# Of the page only the dense part and the two places, and only what the other view learns from.
SURE = "view int, side int, odds double, key bigint, page array<double>, words array<int>"


def most_confident(docs: DataFrame, own: np.ndarray, model: dict, handed: list[set[int]], most: int, sure: float = 0.97) -> list[tuple]:
    """Of all documents but those with the ids own, up to most for each view and answer: (view, answer, key, page, columns of the words)."""
    gone = [np.array(sorted(h), np.int64) for h in handed]
    shared = docs.sparkSession.sparkContext.broadcast((model, own, gone))
    least = float(np.log(sure / (1 - sure)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own, gone = shared.value
        best: dict[tuple[int, int], list[tuple]] = {(v, side): [] for v in (0, 1) for side in (0, 1)}
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key").to_numpy()
            free = ids.is_null().to_numpy(zero_copy_only=False) | ~np.isin(ids.fill_null(0).to_numpy(), own)
            for i, j, page, row, bucket in views(batch):
                first = np.searchsorted(row, np.arange(j - i + 1))
                for v, p in enumerate(score(model, page, row, bucket)[:2]):
                    p = np.clip(p, 1e-13, 1 - 1e-13)
                    odds = np.log(p / (1 - p))
                    open_ = free[i:j] & ~np.isin(keys[i:j], gone[v])
                    for side in (0, 1):
                        o = odds if side else -odds
                        at = np.flatnonzero(open_ & (o >= least))
                        at = at[np.lexsort((keys[i:j][at], -o[at]))]
                        top = best[v, side]
                        have = {t[1] for t in top}
                        for k in at.tolist():
                            entry = (-float(o[k]), int(keys[i + k]))
                            if len(have) >= most and entry >= top[-1][:2]:
                                break
                            if entry[1] in have:
                                continue
                            column = model["column"][bucket[first[k] : first[k + 1]]] if v else np.zeros(0, np.int64)
                            insort(top, (*entry, [] if v else [*page[k, :DENSE], *np.flatnonzero(page[k, DENSE:])], column[column >= 0]), key=lambda t: t[:2])
                            have.add(entry[1])
                            if len(top) > most:
                                have.discard(top.pop()[1])
        rows = [(v, side, -o, key, page, words) for (v, side), top in best.items() for o, key, page, words in top]
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SURE.split(", ")])

    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text", "lang", "source"))
    found = keep(keyed.mapInArrow(run, SURE))
    out = []
    for view in (0, 1):
        for side in (0, 1):
            # Equal rows of several tasks have one key; the driver takes it once.
            top = found.where((F.col("view") == view) & (F.col("side") == side)).dropDuplicates(["key"]).orderBy(F.desc("odds"), "key").limit(most)
            for r in top.collect():
                page = np.zeros(DENSE + 2 * PLACES)
                if view == 0:
                    page[:DENSE] = r["page"][:DENSE]
                    page[DENSE + np.array(r["page"][DENSE:], np.int64)] = 1
                out.append((view, side, r["key"], page, np.array(r["words"], np.int64)))
    shared.unpersist()
    return out


def fitted(docs: DataFrame, labels: DataFrame, labelled: int, handed: int, rounds: int, features: int, grow: float = 0.1) -> dict | None:
    page, words, label, own = sample(docs, labels, labelled)
    most = min(int(grow * max(docs.count() - len(label), 0)) + 1, handed) if len(set(label.tolist())) > 1 else 0
    return train(page, words, label, lambda model, before: most_confident(docs, own, model, before, most), rounds, features)


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), *[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def classify(docs: DataFrame, labels: DataFrame, labelled: int = 5000, handed: int = 400, rounds: int = 3, threshold: float = 0.5, features: int = 800) -> DataFrame:
    """Scores of both views and of their combination for every document, and whether it stays."""
    docs = plain(docs)
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, labelled, handed, rounds, features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, page, row, bucket in views(batch):
                got = score(model.value, page, row, bucket) if model.value else [np.full(j - i, 0.5)] * 3
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, got), pa.array(got[2] >= threshold)], names=["doc_id", "content_score", "page_score", "score", "keep"])

    return docs.mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, labelled: int = 5000, handed: int = 400, rounds: int = 3, threshold: float = 0.5, features: int = 800) -> DataFrame:
    """docs, all columns, without the rows that the classifier rejects. docs: doc_id, text, lang, source (strings) and more."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(plain(docs), labels, labelled, handed, rounds, features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, page, row, bucket in views(batch):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(score(model.value, page, row, bucket)[2] >= threshold)) if model.value else part

    return docs.mapInArrow(run, docs.schema)
