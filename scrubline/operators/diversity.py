"""Diversity of a corpus: near duplicates by MinHash bands, self-BLEU, distinct-2 by length, spread of embeddings, gates."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.functions.arrays import let
from scrubline.functions.digests import cut_rows, distinct_rows, row_heads
from scrubline.functions.grams import counted_grams, distinct_grams, largest_counts

WORD = r"(?U)\w+"


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def signatures(docs: DataFrame, hashes: int = 64, size: int = 3, own: Callable[[Column], Column] = words, most: int = 65_536, deal: bool = True) -> DataFrame:
    """doc_id and signature (hashes unsigned 64-bit numbers as one binary, big-endian): of each salt the least of the first
    eight bytes of md5(salt:shingle) over the shingles of size words; texts without words have null. own: the words of a text,
    none of which holds a NUL. Texts go together until they have most shingles; of those each distinct one is digested once,
    salt after salt. deal: texts are dealt to all tasks first, which those that were just exchanged don't need."""
    salts = [f"{k}:".encode() for k in range(hashes)]

    def signed(data: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
        """data: the words of all texts with a NUL between them; bounds: where the texts begin and end; counts: of their words."""
        data, ends_of, full = data[bounds[0] : bounds[-1]].copy(), bounds[1:] - bounds[0], np.flatnonzero(counts)
        found: list[bytes | None] = [None] * len(counts)
        if not len(full):
            return found
        gaps, n = np.flatnonzero(data == 0), counts[full]
        if len(gaps) != n.sum() - len(n):
            raise ValueError("a word holds a NUL")
        data[gaps] = 32
        # Words: the first of a text begins with it and the last one ends with it, all others lie between two gaps.
        first = np.cumsum(n) - n
        starts, ends, inner = np.empty(n.sum(), np.int64), np.empty(n.sum(), np.int64), np.ones(n.sum(), bool)
        inner[first] = False
        starts[first], starts[inner] = bounds[full] - bounds[0], gaps + 1
        inner[:] = True
        inner[first + n - 1] = False
        ends[first + n - 1], ends[inner] = ends_of[full], gaps
        # Shingles: from each word on as many as there are, the whole text where it has fewer words.
        span = np.minimum(n, size)
        many = n - span + 1
        upto = np.cumsum(many) - many
        word = np.repeat(first - upto, many) + np.arange(many.sum())
        at, end = starts[word], ends[word + np.repeat(span, many) - 1]
        rows = cut_rows(data, at, end - at)
        chosen, place = distinct_rows(rows, end - at)
        at, end = at[chosen], end[chosen]
        table = np.empty((len(full), hashes), ">u8")
        for h, heads in enumerate(row_heads(salts, rows[chosen], end - at, lambda k: data[at[k] : end[k]].tobytes())):
            table[:, h] = np.minimum.reduceat(heads[place], upto)
        for k, row in zip(full, table, strict=True):
            found[k] = row.tobytes()
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            joined = pa.concat_arrays(texts)
            _, offsets, data = joined.buffers()
            bounds = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
            found = signed(np.frombuffer(data or b"", np.uint8), bounds, np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(found, pa.binary())], names=["doc_id", "signature"])

        waiting = 0
        for batch in batches:
            n = batch.column(1).field("n").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            joined = batch.column(1).field("joined").cast(pa.large_string()).fill_null("")
            upto, k = np.cumsum(n), 0
            while k < len(n):
                # Texts up to the one with which there are enough words.
                to = min(len(n), int(np.searchsorted(upto, (upto[k - 1] if k else 0) + most - waiting)) + 1)
                ids.append(batch.column(0).slice(k, to - k))
                texts.append(joined.slice(k, to - k))
                counts.append(n[k:to])
                waiting, k = waiting + int(n[k:to].sum()), to
                if waiting >= most or sum(map(len, ids)) >= most:
                    yield flush()
                    ids, texts, counts, waiting = [], [], [], 0
        if ids:
            yield flush()

    asked = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    if deal:  # digests cost far more than moving the texts, which may lie in a single row group
        asked = asked.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = let(own(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.array_join(w, "\0").alias("joined")))
    return asked.select("doc_id", both.alias("words")).mapInArrow(run, "doc_id bigint, signature binary")


def may_pair(docs: DataFrame, hashes: int = 64, threshold: float = 0.8, first: int = 20, few: int = 1_000_000) -> DataFrame:
    """The documents that near_duplicates may name, and some others: of equal texts that of the smallest doc_id, unless by its
    first hashes alone it is near nobody. A pair differs in few hashes (12 of 64), so of the first 20 it shares 8 at least: a
    text that shares fewer of them with any texts at all has no pair, and the many other hashes are never found for it. Up to
    few of those that may have one go along with every task; more are met by an exchange of the texts."""
    differ = hashes - math.ceil(threshold * hashes - 1e-9)
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    head = signatures(own.groupBy("text").agg(F.min("doc_id").alias("doc_id")), first, deal=False).where("signature is not null")
    keys = head.select("doc_id", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 8 * k + 1, 8)) for k in range(first)])).alias("key"))
    shared = keys.select("doc_id", F.count("*").over(W.partitionBy("key")).alias("n")).where("n > 1")
    near = shared.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= first - differ).select("doc_id").persist()
    return own.join(F.broadcast(near) if near.count() <= few else near, "doc_id", "left_semi")


def near_duplicates(signed: DataFrame, hashes: int = 64, threshold: float = 0.8, hot: int = 4096, levels: int = 3) -> DataFrame:
    """Pairs (a, b, estimate) of different signatures that agree in a share of their hashes, each named by the smallest
    document that has it. No pair is lost: hashes that may differ are fewer than the bands, so one band at least agrees.
    signed: doc_id, signature. ``signature_classes`` gives the documents of each.

    A band that more than hot signatures share is split: what two of them have besides it is cut into as many bands again, and
    for the same reason they agree in one of those too, so they meet only there. Where that would spare less than half of the
    comparisons, as with copies of one text, and after so many levels, the band's signatures are dealt into tiles of hot
    instead, and each two tiles meet. Signatures that meet are compared in arrays, block by block; a pair may meet in many bands
    and is made in the first one only."""
    differ = hashes - math.ceil(threshold * hashes - 1e-9)
    bands, least = differ + 1, math.ceil(threshold * hashes - 1e-9)
    reps = signed.where("signature is not null").groupBy("signature").agg(F.min("doc_id").alias("rep")).persist()

    def edges(left: int) -> list[int]:
        return [left * k // bands for k in range(bands + 1)]

    def cut(rows: DataFrame, left: int) -> DataFrame:
        """Rows by band of the rest (left hashes), and what is left besides it. parent: the key so far; path: the bands so far, as
        digits from 1."""
        at = [8 * e for e in edges(left)]
        parts = [F.struct(F.xxhash64("key", F.lit(k), F.substring("rest", x + 1, y - x)).alias("key"), F.concat(F.substring("rest", 1, x), F.substring("rest", y + 1, 8 * left - y)).alias("rest"), (F.col("path") * (bands + 1) + k + 1).alias("path")) for k, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]
        return rows.select("rep", "signature", F.col("key").alias("parent"), F.explode(F.array(*parts)).alias("p")).select("rep", "signature", "parent", "p.*").withColumn("left", F.octet_length("rest") / 8)

    def tiled(rows: DataFrame) -> DataFrame:
        """Rows with n (of their key) as often as there are tiles to meet. one and other: the two tiles, mine: the row's own."""
        tiles = F.ceil(F.col("n") / hot).cast("int")
        every = rows.withColumn("tiles", tiles).withColumn("mine", F.pmod(F.xxhash64("signature"), F.col("tiles")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return every.select("key", "path", F.least("mine", "with").alias("one"), F.greatest("mine", "with").alias("other"), "mine", "rep", "signature")

    rows, found = reps.select("rep", "signature", F.lit(0).cast("bigint").alias("key"), F.col("signature").alias("rest"), F.lit(0).cast("bigint").alias("path")), []
    rows = cut(rows, hashes)
    for level in range(levels):
        crowd = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).persist()
        crowded = crowd.where(F.col("n") > hot)
        if level + 1 == levels or crowded.isEmpty():
            found.append(tiled(rows.join(crowd, "key")))
            break
        many = rows.join(crowded, "key").persist()
        sizes = sorted({int(r["left"]) for r in many.select("left").distinct().collect()})  # two at most: bands differ by one hash
        smaller = functools.reduce(DataFrame.unionByName, [cut(many.where(F.col("left") == n), n) for n in sizes])
        work = smaller.groupBy("parent", "key").agg(F.count("*").alias("m")).groupBy("parent").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
        split = crowded.join(work, F.col("key") == F.col("parent")).where(F.col("work") * 2 < F.col("n") * F.col("n")).select("parent").persist()
        found.append(tiled(rows.join(crowd.join(split, F.col("key") == F.col("parent"), "left_anti"), "key")))
        rows = smaller.join(split, "parent", "left_semi")

    def first(equal: np.ndarray, path: int) -> np.ndarray:
        """Whether pairs meet by this path first. equal: a row for each pair, which of its hashes agree."""
        digits = []
        while path:
            path, digit = divmod(path, bands + 1)
            digits.append(digit - 1)
        ok, columns = np.ones(len(equal), bool), np.arange(hashes)
        for band in reversed(digits):
            at = edges(len(columns))
            for k in range(band + 1):
                if at[k + 1] > at[k]:
                    ok &= equal[:, columns[at[k] : at[k + 1]]].all(axis=1) == (k == band)
            columns = np.delete(columns, np.s_[at[band] : at[band + 1]])
        return ok

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for *own, mine, rep, signature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block:
                    yield from pairs(block, held)
                    block, held = own, []
                held.append((mine, rep, signature))
        yield from pairs(block, held)

    def pairs(block: list[int] | None, held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        _, path, one, other = block
        tile, own = np.array([h[0] for h in held]), np.array([h[1] for h in held], np.int64)
        table = np.ascontiguousarray(np.frombuffer(b"".join(h[2] for h in held), ">u8").reshape(len(held), hashes).T.astype(np.uint64))
        left, right = np.flatnonzero(tile == one), np.flatnonzero(tile == other)
        for i in range(0, len(left), 128):
            for j in range(i if one == other else 0, len(right), 128):
                a, b = left[i : i + 128], right[j : j + 128]
                x_, y_ = table[:, a], table[:, b]
                same = np.zeros((len(a), len(b)), np.int32)
                for h in range(hashes):
                    same += x_[h, :, None] == y_[h, None, :]
                near = same >= least
                if one == other and i == j:
                    near &= np.arange(len(a))[:, None] < np.arange(len(b))
                x, y = np.nonzero(near)
                if len(x):
                    keep = first((x_[:, x] == y_[:, y]).T, path)
                    x, y = x[keep], y[keep]
                if len(x):
                    low, high = np.minimum(own[a[x]], own[b[y]]), np.maximum(own[a[x]], own[b[y]])
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(same[x, y].astype(np.int32))], names=["a", "b", "same"])

    met = functools.reduce(DataFrame.unionByName, found).select("key", "path", "one", "other", "mine", "rep", "signature")
    made = met.repartition("key", "path", "one", "other").sortWithinPartitions("key", "path", "one", "other").mapInArrow(compare, "a bigint, b bigint, same int")
    # Signatures of one doc_id may repeat a pair, and don't make one.
    return made.where("a < b").distinct().select("a", "b", F.bround(F.col("same") / hashes, 4).alias("estimate"))


def signature_classes(signed: DataFrame) -> DataFrame:
    """doc_id and the smallest document of the same signature (its own id where it has none)."""
    signed = signed.persist()  # used twice; signatures cost far more than reading them back
    reps = signed.where("signature is not null").groupBy("signature").agg(F.min("doc_id").alias("rep"))
    return signed.join(reps, "signature", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))


def self_bleu(docs: DataFrame, sample: int = 200, seed: int = 17, few: int = 1_000_000) -> DataFrame:
    """doc_id and BLEU-4 of sampled documents against all others: clipped counts with one added, and the brevity penalty of
    the closest length. The sample is those with the least md5 of seed and doc_id; a doc_id is one document's.

    Of each gram that the sample has, the two largest counts over all documents and who has the largest are enough. Up to few of
    the sample's grams go along with every task, which then hands on a row for each; more are met by an exchange."""
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    chosen = texts.select("doc_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), "doc_id").limit(sample)
    worded = lambda df: df.select("doc_id", words(F.col("text")).alias("w"))
    mine = worded(texts.join(F.broadcast(chosen), "doc_id")).persist()  # a row for each of the sample
    d, own = worded(texts), counted_grams(mine).persist()
    keys = own.select("n", "a", "b").distinct().persist()
    one = keys.count() <= few
    asked = [np.empty((0, 2), np.uint64)] * 4
    if one:
        table = keys.toArrow()  # few at most
        of, both = table["n"].to_numpy(), np.stack([table[c].to_numpy().view(np.uint64) for c in "ab"], axis=1)
        asked = [both[of == n][np.lexsort((both[of == n][:, 1], both[of == n][:, 0]))] for n in range(1, 5)]
    parts = largest_counts(d, asked).persist()
    met = parts.where("n > 0").groupBy("n", "a", "b").agg(F.max(F.struct("first", "who")).alias("first"), F.sort_array(F.flatten(F.collect_list(F.array("first", "second"))), False)[1].alias("second"))  # two counts a task
    if not one:
        counts = counted_grams(d).join(keys, ["n", "a", "b"], "left_semi")
        most = counts.groupBy("n", "a", "b").agg(F.max(F.struct(F.col("c").alias("first"), F.col("doc_id").alias("who"))).alias("first"))
        rest = counts.join(most, ["n", "a", "b"]).where("doc_id <> first.who").groupBy("n", "a", "b").agg(F.max("c").alias("second"))
        met = most.join(rest, ["n", "a", "b"], "left")
    other = F.when(F.col("first.who") == F.col("doc_id"), F.coalesce("second", F.lit(0))).otherwise(F.col("first.first"))
    hits = own.join(met, ["n", "a", "b"]).groupBy("doc_id", "n").agg(F.sum(F.least("c", other)).alias("hit"), F.sum("c").alias("total"))
    precision = hits.groupBy("doc_id").agg(F.sum(F.ln((F.col("hit") + 1) / (F.col("total") + 1))).alias("log"), F.count("*").alias("orders"))
    # Lengths of the others, by how many have them.
    lengths = parts.where("n = 0").groupBy(F.col("a").alias("len")).agg(F.sum("first").alias("many"))
    near = mine.select("doc_id", F.size("w").alias("own")).join(lengths).where((F.col("len") != F.col("own")) | (F.col("many") > 1))
    closest = near.groupBy("doc_id", "own").agg(F.min(F.struct(F.abs(F.col("len") - F.col("own")).alias("far"), "len"))["len"].alias("ref"))
    brevity = F.when(F.col("own") > F.col("ref"), 1.0).otherwise(F.exp(1 - F.col("ref") / F.greatest("own", F.lit(1))))
    scored = closest.join(precision, "doc_id", "left")
    return scored.select("doc_id", F.when(F.coalesce("orders", F.lit(0)) == 4, brevity * F.exp(F.col("log") / 4)).otherwise(0.0).alias("bleu"))


def distinct(docs: DataFrame, n: int = 2) -> DataFrame:
    """One row, distinct_n: the share of different word n-grams among all of the texts; 0 where there are none."""
    counted = distinct_grams(docs.select(F.lit(0).alias("group"), words(docs["text"]).alias("w")), n)
    return counted.agg(F.coalesce(F.try_divide(F.sum("uniques"), F.sum("total")), F.lit(0.0)).alias(f"distinct_{n}"))


def length_controlled(docs: DataFrame) -> DataFrame:
    """bin (q1 .. q4 by the length in words) and distinct-2 of the texts in it. The bounds are the lengths at the places
    n*q/4 - 1 of the ordered lengths, found from the counts of each length."""
    d = docs.select(words(docs["text"]).alias("w")).withColumn("n", F.size("w"))
    counts = d.groupBy("n").agg(F.count("*").alias("c"))
    upto = counts.select("n", F.sum("c").over(W.orderBy("n")).alias("upto"), F.sum("c").over(W.partitionBy()).alias("all"))  # one row a length
    bound = lambda q: F.min(F.when(F.col("upto") > F.greatest(F.lit(0), F.floor(F.col("all") * q / 4) - 1), F.col("n"))).alias(f"b{q}")
    bounds = upto.agg(*[bound(q) for q in (1, 2, 3)])
    binned = d.crossJoin(F.broadcast(bounds)).select(F.when(F.col("n") <= F.col("b1"), 1).when(F.col("n") <= F.col("b2"), 2).when(F.col("n") <= F.col("b3"), 3).otherwise(4).alias("group"), "w")  # one row of bounds
    return distinct_grams(binned, 2).select(F.concat(F.lit("q"), F.col("group").cast("string")).alias("bin"), F.coalesce(F.try_divide("uniques", "total"), F.lit(0.0)).alias("distinct_2"))


def vendi(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row, vendi_score: the exponential of the entropy of the eigenvalues of the cosine matrix over n. They are those of
    the much smaller matrix of dimensions, whose entries are sums over all vectors: one partial aggregation by rows of it."""
    dims = vectors.select(F.size(column).alias("d")).where("d > 0").first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([(0.0,)], "vendi_score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims["d"], dims["d"])), 0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64)
            if len(x):
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                total, n = total + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims["d"]), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary()), pa.array([n] * dims["d"], pa.int64())], names=["row", "values", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for row, raw, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = sums.get(row, (0.0, 0))
                sums[row] = have[0] + np.frombuffer(raw, np.float64), have[1] + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], names=["row", "values", "n"])

    kind = "row int, values binary, n bigint"
    parts = vectors.select(F.col(column).cast("array<double>")).where(F.size(column) == dims["d"]).mapInArrow(run, kind)
    added = parts.repartition("row").mapInArrow(add, kind).collect()  # one row for each dimension
    gram = np.zeros((dims["d"], dims["d"]))
    for r in added:
        gram[r["row"]] = np.frombuffer(r["values"], np.float64) / r["n"]
    values = np.clip(np.linalg.eigvalsh(gram), 1e-12, None)
    values /= values.sum()
    return vectors.sparkSession.createDataFrame([(float(np.exp(-(values * np.log(values)).sum())),)], "vendi_score double")


# What a corpus must reach.
GATES = {"self_bleu": ("max", 0.90), "distinct_2": ("min", 0.15), "duplicate_rate": ("max", 0.02), "cell_coverage": ("min", 0.60)}


def gates(measures: DataFrame, limits: dict[str, tuple[str, float]] = GATES) -> DataFrame:
    """measures (one row, a column a measure) with failures, an array of the measures beyond their limits, and passed."""
    failed = [F.when(F.col(m) > limit if side == "max" else F.col(m) < limit, F.lit(m)) for m, (side, limit) in limits.items()]
    return measures.withColumn("failures", F.array_compact(F.array(*failed))).withColumn("passed", F.size("failures") == 0)
