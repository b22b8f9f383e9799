"""Exact n-gram Jaccard join up to connectivity, by set-relation skipping.

A text's set is its distinct shingles of ``n`` lower-cased words (the whole sequence if it has fewer). Two texts link when
100 * intersection >= percent * union; the result gives each document the smallest document it reaches by links.

1. All shingles are counted in buckets, some LOAD shingles to each but 2**MOST_BITS buckets at most; rare buckets come
   first in the order of shingles. The order only decides how much work is skipped, not the result.
2. Equal sets become one set. Of each, only the shortest prefix that every linked pair must share enters the index.
3. Index lists are split into blocks of sizes within one step of the threshold, and by position: an entry is skipped when
   no other lies at a position that the allowed difference permits. Blocks split further where tallies of the sets (how
   many shingles have each of 16 remainders) show that no link crosses. Each block names a leader, the set with the most
   common prefix, and sends only (leader, member) pairs, not all pairs. Lists of more than ``hot`` entries don't meet in one
   place: their blocks are pairs of neighbouring bands, whose leaders and pairs are found by aggregation and a join.
4. A member's answer is computed against its leader's and kept as the difference of the two sets. All other answers of
   the block follow from those differences alone (|x ^ y| = |dx ^ dy|), and only for members that don't already link to
   the leader. So no link between different texts is lost, and a group of near copies never meets pair by pair. Members of
   a large block work in several places; those that don't link to the leader visit all of them.
5. Links go through a distributed connected-components step; equal sets rejoin.

The table of bucket ranks (16 MB at most) and the bitmap of ids (16 MB at most) only save work: where more shingles or rows
share them they save less, and the result is the same.

Null and blank texts have an empty set and link with nothing; an empty table has no rows. Very long texts are read whole, one
slice of rows at a time. Rows of one doc_id are one document: what any of them links to is linked. Rows with a null doc_id
take no part and get a null component. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, grams, i64, lists, mix, slices, utf8, within, word_hashes
from .components import components
from .tables import keep

LEAST_BITS, MOST_BITS, LOAD = 20, 24, 32


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, and each row's first."""
    hashes, first = word_hashes(data, offsets, lower=True)
    at, row = within(first, n)
    out = grams(hashes, n)[at] if len(at) else np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=len(offsets) - 1) if len(at) else np.zeros(len(offsets) - 1, np.int64)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    if len(short):
        ends = np.append(0, np.cumsum(count))
        own = np.array([grams(hashes[first[r] : first[r + 1]], int(first[r + 1] - first[r]), 1)[0] for r in short.tolist()], np.uint64)
        out = np.insert(out, ends[short], own)
        count[short] = 1
    return out, np.append(0, np.cumsum(count))


def bucket_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """For each of 2**bits buckets of shingles, eight times the logarithm of its count, as a byte."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.log2(chars / 6 / LOAD + 1))))
    size, block = 1 << bits, 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets):
                own, _ = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                np.add.at(total, (own >> U64(64 - bits)).astype(np.int64), np.uint32(1))
        if total.any():
            parts = np.minimum(total, 255).astype(np.uint8)  # for the order alone; the others of a hot bucket add up
            yield pa.RecordBatch.from_arrays([pa.array(range(size // block), pa.int32()), pa.array([zlib.compress(parts[k : k + block].tobytes(), 1) for k in range(0, size, block)], pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = sums.setdefault(k, np.zeros(block, np.uint64))
                total += np.frombuffer(zlib.decompress(raw), np.uint8)
        ranks = [np.minimum(255, 8 * np.log2(s + 1)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["block", "counts"])

    out = np.zeros(size, np.uint8)
    for r in docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(merge, "block int, counts binary").collect():
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.uint8)
    return out


PREFIXES = "doc_id bigint, n int, d1 bigint, d2 bigint, heft int, tally binary, prefix array<bigint>"
TALLY = 16
_D1, _D2 = U64(0x1234567890ABCDEF), U64(0xFEDCBA9876543211)


def _digest(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums over a set, which don't depend on its order."""
    return mix(s ^ _D1).sum(dtype=np.uint64), mix(s ^ _D2).sum(dtype=np.uint64)


def prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    found = bucket_ranks(docs, n)
    bits = len(found).bit_length() - 1
    ranks = docs.sparkSession.sparkContext.broadcast(found)  # 2**MOST_BITS bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value.astype(np.uint64) << U64(56)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 1 << 21):
                own, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                sizes, digests, hefts, tallies, parts = [], [], [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    s = np.unique(own[a:b])
                    m = len(s)
                    p = m - -(-percent * m // 100) + 1 if m else 0
                    key = np.sort(rank[(s >> U64(64 - bits)).astype(np.int64)] | (s >> U64(8)))[:p]
                    sizes.append(m)
                    digests.append(_digest(s))
                    tallies.append(np.minimum(np.bincount((s & U64(TALLY - 1)).astype(np.int64), minlength=TALLY), 255).astype(np.uint8).tobytes())
                    hefts.append(int((key >> U64(48)).sum() // U64(max(p, 1))))
                    parts.append(key)
                digests = np.array(digests, np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int32()), pa.array(i64(digests[:, 0])), pa.array(i64(digests[:, 1])), pa.array(hefts, pa.int32()), pa.array(tallies, pa.binary()), lists(i64(np.concatenate(parts)), np.append(0, np.cumsum([len(p) for p in parts])), pa.int64())],
                    names=["doc_id", "n", "d1", "d2", "heft", "tally", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PREFIXES)


def _shared(token: np.ndarray) -> np.ndarray:
    """Which of the sorted tokens have an equal neighbour."""
    same = np.zeros(len(token) + 1, bool)
    same[1:-1] = token[1:] == token[:-1]
    return same[1:] | same[:-1]


def hot_tokens(rows: DataFrame, hot: int) -> tuple[DataFrame, int]:
    """Tokens in the prefixes of more than hot rows, and the least rank that such a token can have. Ranks stand in a token's
    first byte and grow with the counts, which are clipped at 255 for each task."""
    rank = int(8 * math.log2(min(hot, 255) + 1))
    tokens = rows.select(F.explode(F.filter("prefix", lambda t: F.shiftrightunsigned(t, 56) >= rank)).alias("token"))
    return keep(tokens.groupBy("token").agg(F.count("*").alias("entries")).where(F.col("entries") > hot).select("token")), rank


def leader_pairs(postings: DataFrame, percent: int, often: DataFrame, rank: int) -> DataFrame:
    """(leader, member) for every block of every index list. postings: token, rep, n, heft, pos, tally."""
    step = math.log(100 / percent)
    maybe = F.shiftrightunsigned("token", 56) >= rank
    # A band's entries are in the blocks of two bands that begin with it and with the one below.
    band = F.floor(F.ln(F.greatest("n", F.lit(1))) / step)
    blocks = postings.where(maybe).join(often, "token", "left_semi").select("token", "rep", F.struct("heft", (-F.col("rep")).alias("least")).alias("key"), F.explode(F.array(band, band - 1)).alias("block"))
    leaders = blocks.groupBy("token", "block").agg(F.max("key").alias("key")).select("token", "block", (-F.col("key.least")).alias("leader"))
    large = blocks.select("token", "block", F.col("rep").alias("member")).join(leaders, ["token", "block"]).where("leader <> member").select("leader", "member")

    def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Sets differ by the differences of their tallies at least, and linked ones by a share of their sizes at most."""
        apart = np.abs(a.astype(np.int16) - b).sum(-1, dtype=np.int64)
        return apart * (100 + percent) <= (na.astype(np.int64) + nb) * (100 - percent)

    def classes(tally: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Entries that may link, also through others, have one class; hot entries at most."""
        m = len(n)
        out = np.arange(m)
        for k in range(m - 1):
            near = out[k + 1 :][may_link(tally[k + 1 :], tally[k], n[k + 1 :], n[k])]
            if len(near):
                own = min(int(near.min()), int(out[k]))
                out[np.isin(out, np.append(near, out[k]))] = own
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[*[c.to_numpy(zero_copy_only=False) for c in b.columns[:5]], utf8(b.column(5))[0].reshape(-1, TALLY)] for b in batches]
        if not held:
            return
        token, rep, n, heft, pos, tally = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((rep, n, token))
        order = order[_shared(token[order])]  # most tokens are in one set only
        head = np.ones(len(order), bool)
        head[1:] = token[order][1:] != token[order][:-1]
        start = np.flatnonzero(head)
        count = np.diff(np.append(start, len(order)))
        rep, n, heft, pos, tally = rep[order], n[order], heft[order], pos[order], tally[order]
        leaders, members = [], []
        two = start[count == 2]  # most lists
        a, b = two, two + 1
        ok = (100 * n[a].astype(np.int64) >= percent * n[b].astype(np.int64)) & (rep[a] != rep[b]) & may_link(tally[a], tally[b], n[a], n[b])
        first = (heft[a] > heft[b]) | ((heft[a] == heft[b]) & (rep[a] < rep[b]))
        leaders.append(np.where(first, rep[a], rep[b])[ok])
        members.append(np.where(first, rep[b], rep[a])[ok])
        for s, m in zip(start[count > 2].tolist(), count[count > 2].tolist(), strict=True):
            band = np.floor(np.log(np.maximum(n[s : s + m], 1)) / step).astype(np.int64)  # sizes ascend
            at = dict(zip(*[x.tolist() for x in np.unique(band, return_index=True)], strict=True))
            bands = sorted(at)
            ends = dict(zip(bands, [*[at[k] for k in bands[1:]], m], strict=True))
            for k in bands:
                if k + 1 not in at and k - 1 in at:
                    continue  # within the block of the band below
                lo, hi = s + at[k], s + ends.get(k + 1, ends[k])
                allowed = 2 * int(n[hi - 1]) * (100 - percent) // (100 + percent)
                p = np.argsort(pos[lo:hi], kind="stable")
                gap = np.diff(pos[lo:hi][p]) <= allowed
                near = np.append(gap, False) | np.append(False, gap)
                block = lo + p[near]
                if len(block) < 2:
                    continue
                kind = classes(tally[block], n[block])
                for c in np.unique(kind).tolist():
                    own = block[kind == c]
                    best = own[np.lexsort((rep[own], -heft[own]))[0]]
                    others = rep[own][rep[own] != rep[best]]
                    members.append(others)
                    leaders.append(np.full(len(others), rep[best]))
        both = np.unique(np.stack([np.concatenate(leaders), np.concatenate(members)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["leader", "member"])

    small = postings.where(~maybe).unionByName(postings.where(maybe).join(often, "token", "left_anti").select(*postings.columns))
    return small.repartition("token").mapInArrow(run, "leader bigint, member bigint").unionByName(large).dropDuplicates(["leader", "member"])


def _links(n_leader: int, n: np.ndarray, deltas: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links of a leader (-1) and its members that join what wasn't joined before, from the members' differences to it."""
    m = len(n)
    size = np.array([len(d) for d in deltas], np.int64)
    linked = 100 * (n + n_leader - size) >= percent * (n + n_leader + size)
    root = np.arange(m)
    root[linked] = -1
    for x in np.flatnonzero(linked).tolist():
        yield -1, x
    rest = np.flatnonzero(~linked)
    if not len(rest) or m < 2:
        return
    flat, owner = np.concatenate(deltas), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    head = np.ones(len(flat), bool)
    head[1:] = flat[order][1:] != flat[order][:-1]
    start = np.append(np.flatnonzero(head), len(flat))
    run = np.empty(len(flat), np.int64)
    run[order] = np.cumsum(head) - 1
    owners, first = owner[order], np.cumsum(size) - size
    for x in rest.tolist():
        runs = run[first[x] : first[x] + size[x]]
        length = start[runs + 1] - start[runs]
        where = np.repeat(start[runs] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        apart = size[x] + size - 2 * np.bincount(owners[where], minlength=m)
        close = 100 * (n[x] + n - apart) >= percent * (n[x] + n + apart)
        close[x] = False
        for y in np.flatnonzero(close & (root != root[x])).tolist():
            if root[y] != root[x]:
                yield x, y
                root[root == root[x]] = root[y]


def maybe_in(docs: DataFrame, rows: DataFrame, most_bits: int = 27) -> DataFrame:
    """docs without most of those whose doc_id isn't in rows, before their texts are shuffled. A bitmap of hashes of the
    ids, 2**most_bits bits (16 MB) at most whatever the input, is broadcast; it keeps every id of rows."""
    word = 1 << 15
    ids = rows.select("doc_id")
    bits = min(1 << most_bits, max(word, 1 << (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    bitmap = ids.groupBy((at / word).cast("bigint").alias("part")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(word))).alias("bitmap"))
    hit = docs.withColumn("bit", at).withColumn("part", (F.col("bit") / word).cast("bigint")).join(F.broadcast(bitmap), "part")
    byte = F.conv(F.hex(F.substring("bitmap", (F.pmod("bit", F.lit(word)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return hit.where(F.getbit(byte.cast("bigint"), F.pmod("bit", F.lit(8)).cast("int")) == 1).select(*docs.columns)


def links(docs: DataFrame, pairs: DataFrame, n: int, percent: int, members_in_place: int = 400) -> DataFrame:
    """Edges (a, b) that connect what the pairs' blocks connect."""

    def found(leader: int, n_leader: int, ids: list[int], sizes: list[int], parts: list[np.ndarray]) -> list[tuple[int, int]]:
        name = [*ids, leader]  # index -1 is the leader
        return [(name[a], name[b]) for a, b in _links(n_leader, np.array(sizes, np.int64), parts, percent)]

    def deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a (leader, salt) come together, the leader's own first. Leaders in one place are settled here: their
        links go on with a null delta. Of leaders in several places all differences go on, with what links to the leader."""
        key, places, heads, held = None, 1, [], []

        def told(rows: list[tuple], parts: list[np.ndarray | None]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            flat = [p for p in parts if p is not None]
            values = lists(i64(np.concatenate(flat)), np.append(0, np.cumsum([len(p) for p in flat], dtype=np.int64)), pa.int64()) if flat else pa.nulls(len(rows), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*columns, values], names=["leader", "digest", "place", "places", "linked", "member", "n_leader", "n", "delta"])

        def close() -> Iterator[pa.RecordBatch]:
            rows = [(a, 0, 0, 1, True, b, 0, 0) for k, (_, head) in enumerate(heads) if held[k][0] for a, b in found(key[0], len(head), *held[k])]
            if rows:
                yield told(rows, [None] * len(rows))

        for batch in batches:
            leader, salt, many, kind, member = (batch.column(k).to_pylist() for k in range(5))
            data, offsets = utf8(batch.column(5))
            for i, j in slices(offsets):
                own, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                rows, parts = [], []
                for k in range(i, j):
                    s = np.unique(own[first[k - i] : first[k - i + 1]])
                    if (leader[k], salt[k]) != key:
                        yield from close()
                        key, places, heads, held = (leader[k], salt[k]), many[k], [], []
                    if kind[k] == 0:
                        digest = int(i64(np.array([_digest(s)[0]]))[0])
                        if digest not in {h[0] for h in heads}:
                            heads.append((digest, s))
                            held.append(([], [], []))
                        continue
                    for (digest, head), (ids, sizes, diffs) in zip(heads, held, strict=True):
                        delta = np.setxor1d(head, s, assume_unique=True)
                        if places == 1:
                            ids.append(member[k])
                            sizes.append(len(s))
                            diffs.append(delta)
                        else:
                            linked = 100 * (len(head) + len(s) - len(delta)) >= percent * (len(head) + len(s) + len(delta))
                            parts.append(delta)
                            rows.append((leader[k], digest, salt[k], places, linked, member[k], len(head), len(s)))
                if rows:
                    yield told(rows, parts)
        yield from close()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a leader's place: its own members, and all members that don't link to the leader."""
        key, ids, sizes, parts = None, [], [], []

        def edges() -> pa.RecordBatch:
            pairs = found(key[0], key[3], ids, sizes, parts)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            leader, dig, place, n_leader, member, size = (c.to_pylist() for c in batch.columns[:6])
            for k in range(batch.num_rows):
                if key is None or (leader[k], dig[k], place[k]) != key[:3]:
                    if key is not None:
                        yield edges()
                    key, ids, sizes, parts = (leader[k], dig[k], place[k], n_leader[k]), [], [], []
                ids.append(member[k])
                sizes.append(size[k])
                parts.append(batch.column(6)[k].values.to_numpy())
        if key is not None:
            yield edges()

    pairs = keep(pairs)
    # A leader of many members works in several places, with a copy of its text for each.
    spread = pairs.groupBy("leader").agg(F.ceil(F.count("*") / members_in_place).cast("int").alias("places"))
    heads = spread.select("leader", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("salt"), "places", F.lit(0).alias("kind"), F.col("leader").alias("member"))
    members = pairs.join(spread, "leader").select("leader", F.pmod(F.xxhash64("member"), "places").cast("int").alias("salt"), "places", F.lit(1).alias("kind"), "member")
    rows = keep(heads.unionByName(members).withColumnRenamed("member", "doc_id"))
    texts = maybe_in(docs.select("doc_id", "text"), rows).join(rows.hint("shuffle_hash"), "doc_id").select("leader", "salt", "places", "kind", "doc_id", "text")
    told = texts.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind").mapInArrow(deltas, "leader bigint, digest bigint, place int, places int, linked boolean, member bigint, n_leader int, n int, delta array<bigint>")
    told = keep(told)
    linked = told.where("linked").select(F.col("leader").alias("a"), F.col("member").alias("b"))
    own = ["leader", "digest", "place", "n_leader", "member", "n", "delta"]
    asking = told.where("not linked").select(*[F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias(c) if c == "place" else c for c in own])
    asked = told.where("linked and delta is not null").select(*own).join(told.where("not linked").select("leader").distinct(), "leader", "left_semi").select(*own)
    met = asking.unionByName(asked).repartition("leader", "digest", "place").sortWithinPartitions("leader", "digest", "place").mapInArrow(settle, "a bigint, b bigint")
    return linked.unionByName(met)


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, members_in_place: int = 400, hot: int = 1500) -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = keep(prefixes(docs, n, percent))
    real = rows.where("doc_id is not null and n > 0")
    reps = real.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("heft").alias("heft"), F.first("tally").alias("tally"), F.first("prefix").alias("prefix"))
    postings = reps.select("rep", "n", "heft", "tally", F.posexplode("prefix").alias("pos", "token")).select("token", "rep", "n", "heft", "pos", "tally")
    edges = links(docs.where("doc_id is not null"), leader_pairs(postings, percent, *hot_tokens(real, hot)), n, percent, members_in_place)
    # Two plain shuffled sides, so that adaptive execution splits a large group of equal sets.
    names = keep(real.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    classes = keep(real.select("doc_id", "n", "d1", "d2").join(names, ["n", "d1", "d2"]).select("doc_id", "n", "rep"))
    several = classes.groupBy("doc_id").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1).select(F.col("doc_id").alias("a"), F.explode("reps").alias("b"))
    labels = components(edges.unionByName(several))
    found = classes.join(labels, classes["rep"] == labels["node"], "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
