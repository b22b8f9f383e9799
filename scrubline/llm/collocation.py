"""Phrase collocation mining by growth of contiguous patterns from projected occurrence pointers.

Texts are lower-cased (A-Z), split into pieces at sentence and clause marks and line ends, pieces into words. All counts are
by language. A phrase of 2 to ``longest`` words with ``least`` occurrences or more is a candidate; its score is that of its
lowest-scoring cut in two, scale * a * a // (l * r), exact. Candidates inside a longer one that has at least ``share``
percent of their occurrences go, and each language's ``top`` best are returned.

1. Words are counted by language in each task and summed. A word is known by a 64-bit hash of it and its language; if one
   that is frequent shares its hash with another word, all is hashed anew with the next salt, so results are exact.
2. Only frequent words start or go on in a frequent phrase. A bitmap of them, of a bounded size, picks occurrence pointers:
   a frequent word with the frequent words after it in its piece, ``longest`` in all. A pointer is projected onto its first
   word, the prefix. Tasks group equal pointers, so a phrase or line in a third of all documents is a few pointers for each
   task, and deal them by prefix. Prefixes with a share of all words of ``hot`` or more (1 / hot at most) are dealt to as
   many places as that share asks for, by what follows.
3. A task takes one group of prefixes at a time. Each prefix grows to the right, depth first: its pointers are cut into
   runs by the next word, and runs with enough occurrences grow on. A prefix dealt to several places can't be pruned there
   before its last word; the counts of its phrases are summed over the places afterwards.
4. Scores are equi-joins of phrases with the counts of their parts, by hashes. The best are taken in each partition first.

Null and empty texts have no words; a null language is ``und``. Repeated rows count each. Texts of any length are read
whole. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import LOWER, U64, i64, mix, slices, utf8, words
from .tables import keep, stored

_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_APART = _MARK.copy()
_APART[[9, 32]] = True
MOST_BITS = 27  # of the bitmap: 16 MB
_SUFFIX = U64(0x9E3779B97F4A7C15)


class Words:
    """Words of the texts of one language: which distinct word each is, its hash, and whether it goes on from the word before."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: str, salt: int):
        starts, ends, first = words(data, offsets, _APART)
        low = LOWER[data]
        cuts = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(low[~_APART[data]])]).dictionary_encode()
        self.code, self.names = found.indices.to_numpy(), found.dictionary
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), salt)
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) or 1 for w in self.names.to_pylist()), np.uint64, len(self.names))
        marks = np.cumsum(_MARK[data])
        self.on = np.zeros(len(starts), bool)
        if len(starts):
            piece = marks[starts]
            self.on[1:] = piece[1:] == piece[:-1]
            self.on[first[:-1][first[:-1] < len(starts)]] = False


def by_language(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[tuple[str, Words]]:
    """lang and text, some 4 MB of one language's texts at a time."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            data, offsets = utf8(batch.column(1).take(pa.array(np.flatnonzero(langs.indices.to_numpy() == k))))
            for i, j in slices(offsets, 1 << 22):
                yield lang, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lang, salt)


def count_words(docs: DataFrame, salt: int) -> DataFrame:
    """hash, lang, word and n: words in parts, to be summed; and with a null word all occurrences of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in by_language(batches, salt):
            n = np.bincount(own.code, minlength=len(own.names))
            yield pa.RecordBatch.from_arrays([pa.array(i64(own.hash)), pa.array([lang] * len(n), pa.string()), own.names.cast(pa.string()), pa.array(n, pa.int64())], names=["h", "lang", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([lang]), pa.array([None], pa.string()), pa.array([len(own.code)])], names=["h", "lang", "word", "n"])

    return docs.mapInArrow(run, "h bigint, lang string, word string, n bigint")


def told_apart(summed: DataFrame, least: int) -> DataFrame:
    """Of words (h, lang, word, n) the frequent ones and those of a frequent one's hash, with how many have the hash; and rows
    without a word."""
    same = Window.partitionBy("h")
    return summed.withColumns({"most": F.max("n").over(same), "others": F.count("word").over(same)}).where(F.col("word").isNull() | (F.col("most") >= least))


def frequent_words(docs: DataFrame, least: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """(h, lang, word, n) of frequent words, also of words that share a hash with one, and (lang, n) of all words together."""
    summed = count_words(docs, salt).repartition("h").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
    found = stored(told_apart(summed, least))
    return found.where("word is not null"), found.where("word is null").select("lang", "n")


def bitmap(words_: DataFrame, bits: int) -> np.ndarray:
    """One bit for each of 2**bits slots, set where a word has its hash."""
    slot = F.col("h").bitwiseAND((1 << bits) - 1) + 1  # buckets hold 1 to 32768, and so on
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in words_.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect():  # as many bytes as out
        at = (r["bucket"] - 1) * 4096
        got = np.frombuffer(bytes(r["map"]), np.uint8)[: len(out) - at]
        out[at : at + len(got)] = got
    return out


def merged(columns: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns, sorted from the first row on, with their summed counts (1 each where none are given); columns: small
    numbers, a pointer in each."""
    width = max(1, int(columns.max(initial=0)).bit_length())
    if width * len(columns) < 63:
        key = reduce(lambda a, c: a << width | c, columns.astype(np.int64))
        if count is None:
            key, count = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key)
            key = key[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            key, count = key[new], np.add.reduceat(count[order], new) if len(new) else count[:0]
        return np.array([key >> width * k & (1 << width) - 1 for k in range(len(columns) - 1, -1, -1)]), count
    order = np.lexsort(columns[::-1])
    own = columns[:, order]
    new = np.flatnonzero(np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0)))
    return own[:, new], np.add.reduceat(np.ones(len(order), np.int64) if count is None else count[order], new)


def grow(code: np.ndarray, count: np.ndarray, least: int, whole: bool, depth: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phrases that go on from a prefix of depth words: depth, first pointer and count of each. code: the prefix's pointers, sorted."""
    word = code[depth]
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    total = np.add.reduceat(count, start)
    ends = np.append(start[1:], len(word))
    last = depth + 1 == len(code)
    keep_ = (word[start] > 0) & ((total >= least) | (not (whole or last)))
    start, ends, total = start[keep_], ends[keep_], total[keep_]
    if len(start):
        yield depth + 1, start, total
        if not last:
            for a, b in zip(start.tolist(), ends.tolist(), strict=True):
                for size, at, n in grow(code[:, a:b], count[a:b], least, whole, depth + 1):
                    yield size, at + a, n


def phrases(docs: DataFrame, words_: DataFrame, all_words: int, longest: int, least: int, salt: int, load: int, hot: float, buffer: int) -> DataFrame:
    """h1 .. hN (null after a phrase's end), size and a of every phrase of 2 words or more with at least so many occurrences."""
    spark = docs.sparkSession
    bits = max(15, min(MOST_BITS, (16 * words_.count()).bit_length()))
    share = max(load, int(hot * all_words))
    often = words_.where(F.col("n") >= share).select("h", "n").orderBy("h").collect()  # 1 / hot rows at most
    parts = max(all_words // load, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast((bitmap(words_, bits), np.array([r["h"] for r in often], np.int64), np.array([1 + r["n"] // share for r in often], np.int64)))
    names = [f"h{k + 1}" for k in range(longest)]

    def places(first: np.ndarray) -> np.ndarray:
        _, hashes, many = shared.value
        if not len(hashes):
            return np.ones(len(first), np.int64)
        at = np.minimum(np.searchsorted(hashes, i64(first)), len(hashes) - 1)
        return np.where(hashes[at] == i64(first), many[at], 1)

    def pointers(own: Words) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pointers' words, and how often each occurs."""
        slot = (own.hash & U64((1 << bits) - 1)).astype(np.int64)
        known = (shared.value[0][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        local = np.zeros(len(known), np.int64)
        local[known] = np.arange(1, known.sum() + 1)
        code = local[own.code]
        follows = np.append(own.on[1:], False)
        at = np.flatnonzero((code > 0) & follows & (np.append(code[1:], 0) > 0))
        rows, going = [code[at]], np.ones(len(at), bool)
        for k in range(1, longest):
            going = going & follows[np.minimum(at + k - 1, len(code) - 1)]
            nxt = np.where(going, code[np.minimum(at + k, len(code) - 1)], 0)
            going = nxt > 0
            rows.append(nxt)
        columns, count = merged(np.array(rows))
        return np.append(U64(0), own.hash[known])[columns], count

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, own in by_language(batches, salt):
            hashes, count = pointers(own)
            if len(count):
                held.append((hashes, count))
                size += len(count)
            if size >= buffer:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashes, count = np.concatenate([h for h, _ in held], axis=1), np.concatenate([c for _, c in held])
        known, code = np.unique(hashes, return_inverse=True)
        code, count = merged(code.reshape(hashes.shape), count)
        rest = reduce(lambda a, c: mix(a + c * _SUFFIX), known[code[1:]])
        many = places(known)[code[0]]
        place = (rest % many.astype(np.uint64)).astype(np.int64)
        part = (mix(mix(known[code[0]]) + place.astype(np.uint64)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, code, count = part[order], code[:, order], count[order]
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        small = zstandard.ZstdCompressor(level=1)
        blobs = [small.compress(pack(known, code[:, a:b], count[a:b])) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=True)]
        for k in range(0, len(blobs), 500):
            yield pa.RecordBatch.from_arrays([pa.array(part[start[k : k + 500]]), pa.array(blobs[k : k + 500], pa.binary())], names=["part", "pointers"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != at and held:
                    yield from extend(held)
                    held = []
                at = part
                held.append(unpack(zstandard.ZstdDecompressor().decompress(raw.as_py()), longest))
        if held:
            yield from extend(held)

    def extend(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashes, count = np.concatenate([h for h, _ in held], axis=1), np.concatenate([c for _, c in held])
        known, code = np.unique(np.append(hashes.ravel(), U64(0)), return_inverse=True)  # no word is code 0
        code, count = merged(code[:-1].reshape(hashes.shape), count)
        start = np.flatnonzero(np.append(True, code[0, 1:] != code[0, :-1]))
        ends, alone = np.append(start[1:], code.shape[1]), places(known[code[0, start]]) == 1
        out: list[tuple[np.ndarray, int, np.ndarray, bool]] = []
        for a, b, whole in zip(start.tolist(), ends.tolist(), alone.tolist(), strict=True):
            out += [(code[:, first + a], size, n, whole) for size, first, n in grow(code[:, a:b], count[a:b], least, whole)]
        if out:
            found = known[np.concatenate([c for c, *_ in out], axis=1)]
            each = np.array([c.shape[1] for c, *_ in out])
            sizes = np.repeat([s for _, s, *_ in out], each)
            columns = [pa.array(i64(found[k]), mask=sizes <= k) for k in range(longest)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes.astype(np.int32)), pa.array(np.concatenate([n for _, _, n, _ in out])), pa.array(np.repeat([w for *_, w in out], each))], names=[*names, "size", "a", "whole"])

    dealt = docs.mapInArrow(project, "part bigint, pointers binary").repartition("part").sortWithinPartitions("part")
    kind = ", ".join(f"{h} bigint" for h in names) + ", size int, a bigint, whole boolean"
    found = stored(dealt.mapInArrow(grown, kind))
    split = found.where("not whole").groupBy(*names, "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return found.where("whole").drop("whole").unionByName(split)


def pack(known: np.ndarray, code: np.ndarray, count: np.ndarray) -> bytes:
    """Pointers as codes of their own words."""
    own, back = np.unique(code, return_inverse=True)
    wide = "<u2" if len(own) <= 65536 else "<u4"
    deep = "<u1" if count.max() < 256 else "<u8"
    head = np.array([len(own), code.shape[1], int(wide[2]), int(deep[2])], "<u8")
    return head.tobytes() + known[own].astype("<u8").tobytes() + back.reshape(code.shape).astype(wide).tobytes() + count.astype(deep).tobytes()


def unpack(raw: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    words_, n, wide, deep = np.frombuffer(raw, "<u8", 4).tolist()
    known = np.frombuffer(raw, "<u8", words_, 32)
    code = np.frombuffer(raw, f"<u{wide}", longest * n, 32 + 8 * words_).reshape(longest, n)
    return known[code], np.frombuffer(raw, f"<u{deep}", n, 32 + 8 * words_ + wide * longest * n).astype(np.int64)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, scale: int = 10**6, load: int = 500_000, hot: float = 1e-5, buffer: int = 500_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score. load: pointers that a group of prefixes is meant for; buffer: those that a task
    holds before it sends them."""
    plain = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    salt = 0
    while True:
        words_, sizes = frequent_words(plain, least, salt)
        if words_.where("others > 1").isEmpty():
            break
        salt += 1
    sizes = keep(sizes.groupBy("lang").agg(F.sum("n").alias("n")))
    all_words = sizes.agg(F.sum("n")).first()[0] or 0
    found = stored(phrases(plain, words_, all_words, longest, least, salt, load, hot, buffer))
    exact = "decimal(19,0)"
    level = {1: words_.select(F.col("h").alias("h1"), "lang", F.col("word").alias("phrase"), F.col("n").alias("a"))}
    scored = []
    for m in range(2, longest + 1):
        own = [f"h{k + 1}" for k in range(m)]
        here, best = found.where(F.col("size") == m).select(*own, "a"), None
        for k in range(1, m):
            left = level[k].select(*[f"h{i + 1}" for i in range(k)], "lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
            right = level[m - k].select(*[F.col(f"h{i + 1}").alias(f"h{i + 1 + k}") for i in range(m - k)], F.col("phrase").alias("tail"), F.col("a").alias("r"))
            here = here.join(left, own[:k]).join(right, own[k:])
            score = F.call_function("div", F.lit(scale).cast("decimal(10,0)") * (F.col("a").cast(exact) * F.col("a").cast(exact)).cast("decimal(28,0)"), F.col("l").cast(exact) * F.col("r").cast(exact))
            cut = F.struct(score.alias("score"), F.lit(k).alias("k"), "l", "r")
            best = cut if best is None else F.when(cut["score"] < F.col("best.score"), cut).otherwise(F.col("best"))
            here = here.select(*own, "a", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), best.alias("best")) if k == m - 1 else here.select(*own, "a", best.alias("best"))
        level[m] = here = stored(here) if m < longest else here
        scored.append((own, here))
    kept = []
    for own, here in scored:
        m = len(own)
        inner = [found.where(F.col("size") == s).select(*[F.col(f"h{i + k + 1}").alias(f"h{i + 1}") for i in range(m)], "a") for s in range(m + 1, longest + 1) for k in range(s - m + 1)]
        if inner:
            longer = reduce(DataFrame.unionByName, inner).groupBy(*own).agg(F.max("a").alias("longer"))
            here = here.join(longer, own, "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        kept.append(here.select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    # The best of each slice of a language first, about as many slices as tasks meet in one of them.
    slices_ = max(1, int(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    ranked = best(best(reduce(DataFrame.unionByName, kept).withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices_))), "lang", "slice"), "lang")
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
