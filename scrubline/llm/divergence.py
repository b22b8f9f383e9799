"""Audit of how sources differ in their terms: divergences between sources of a language, and each source's most raised terms.

A term is a run of letters (ASCII or any other character above 127), A-Z lower-cased. A language keeps the ``V`` terms in at
least ``least`` of its documents. A group is (lang, source). A group, and each language, gives each kept term
``p = 1 + scale * (count + add) // (N + add * V)``. Part ``pair`` has, for every other source of the language, the sum of
|p - q| over all kept terms; part ``term`` the terms a group holds with p above the language's, by that difference, down
to rank ``top``. All numbers are exact.

1. Tasks count terms of their rows, one row for each (lang, term) with counts by group packed in bytes, so a common term
   or a hot source is one entry for each task. They are dealt by (lang, term), sorted, and summed as a stream.
2. Pairs are sparse: a term that neither source holds adds the difference of the sources' baselines (their p at count 0),
   so all terms together are V times that, and only held terms correct it. A term held by one source corrects by a sum of
   its p against the other's baseline, which needs only the source's sums and its few values below that baseline. Terms
   held by both are summed over runs of rows of one term, in arrays, in the task that has them.
3. Terms are selected by radix: histograms of a few bits of the values, highest first, by group, give each group's top-th
   value exactly; ties at it are refined by histograms of the next bytes of the terms after their common prefix, until what
   lies at the border is no more than ``few`` rows or all of it is taken. Only the chosen rows are ranked in a window.

Nulls in text, lang and source count as ''. Documents without terms have part in their group and nothing else; a group
without kept terms has its baseline. Repeated rows are documents of their own. Very long texts are read whole. An empty
table gives an empty result. A language of one source has no pairs. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import LOWER, i64, lists, slices, utf8, words
from .tables import keep, stored

_APART = np.ones(256, bool)
_APART[65:91] = _APART[97:123] = _APART[128:] = False
_PACKED = np.dtype([("gid", "<i8"), ("n", "<i8")])
SMALL = 200_000  # rows of groups or languages that may be broadcast; more are joined by a shuffle
COUNTED = "lang string, term string, docs bigint, packed binary"
SUMMED = "lang string, term string, n bigint, gid array<bigint>, count array<bigint>"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all rows, and each row's first (one more entry than rows)."""
    starts, ends, first = words(data, offsets, _APART)
    ends_ = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    kept = LOWER[data[~_APART[data]]]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends_), pa.py_buffer(kept)).dictionary_encode(), first


def _totals(keys: dict, sums: list[str], more: tuple = ()) -> pa.Table:
    return pa.table(keys).group_by([k for k in keys if k not in sums], use_threads=False).aggregate([*((s, "sum") for s in sums), *more])


def counts(docs: DataFrame) -> DataFrame:
    """A row for each (lang, term) of about 16 MB of texts: documents, and occurrences by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            langs = batch.column(0).dictionary_encode()
            lang, names, gid = langs.indices.to_numpy().astype(np.int64), langs.dictionary, batch.column(1).to_numpy()
            for i, j in slices(offsets, 1 << 24):
                found, first = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = len(found.dictionary)
                if not size:
                    continue
                key, n = np.unique(np.repeat(np.arange(j - i), np.diff(first)) * size + found.indices.to_numpy(), return_counts=True)
                row, term = key // size + i, key % size
                own = _totals({"key": lang[row] * size + term, "gid": gid[row], "n": n}, ["n"], (("n", "count"),))
                own = own.sort_by("key")
                at, gids, count, docs_ = (own[c].combine_chunks().to_numpy() for c in ("key", "gid", "n_sum", "n_count"))
                start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                packed = np.empty(len(at), _PACKED)
                packed["gid"], packed["n"] = gids, count
                cuts = np.append(start, len(at)).astype(np.int32) * _PACKED.itemsize
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(at[start] // size)), found.dictionary.take(pa.array(at[start] % size)), pa.array(np.add.reduceat(docs_, start)), pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(packed)])],
                    names=["lang", "term", "docs", "packed"],
                )

    return docs.select("lang", "gid", "text").mapInArrow(run, COUNTED)


def kept_terms(counted: DataFrame, least: int) -> DataFrame:
    """The terms in at least this many documents of their language: all occurrences, and those by group. counted: a
    language's term may have any number of rows; they are dealt and sorted, and one term is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # lang, term, docs, gid, n of the last term so far
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, docs_ = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            new = np.append(True, pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False))
            start = np.flatnonzero(new)
            total, of = np.add.reduceat(docs_, start), np.cumsum(new) - 1
            head = open_ is not None and (lang[0].as_py(), term[0].as_py()) == open_[:2]
            if head:
                total[0] += open_[2]
            done = total >= least
            done[-1] = True  # it may go on in the next batch
            raw, cuts = utf8(batch.column(3))
            here = np.frombuffer(raw.tobytes(), _PACKED)
            run_ = np.repeat(of, np.diff(cuts) // _PACKED.itemsize)
            wanted = done[run_]
            run_, gid, n = run_[wanted], here["gid"][wanted], here["n"][wanted]
            if head and done[0]:
                run_, gid, n = np.append(np.zeros(len(open_[3]), np.int64), run_), np.append(open_[3], gid), np.append(open_[4], n)
            elif open_ is not None and not head and open_[2] >= least:
                yield _summed(pa.array([open_[0]]), pa.array([open_[1]]), np.zeros(len(open_[3]), np.int64), open_[3], open_[4])
            sums = _totals({"run": run_, "gid": gid, "n": n}, ["n"]).sort_by([("run", "ascending"), ("gid", "ascending")])
            run_, gid, n = (sums[c].combine_chunks().to_numpy() for c in ("run", "gid", "n_sum"))
            last = run_ == len(start) - 1
            open_ = (lang[-1].as_py(), term[-1].as_py(), int(total[-1]), gid[last], n[last])
            whole = np.unique(run_[~last])
            if len(whole):
                rows = pa.array(start[whole])
                yield _summed(lang.take(rows), term.take(rows), np.searchsorted(whole, run_[~last]), gid[~last], n[~last])
        if open_ is not None and open_[2] >= least:
            yield _summed(pa.array([open_[0]]), pa.array([open_[1]]), np.zeros(len(open_[3]), np.int64), open_[3], open_[4])

    return counted.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, SUMMED)


def _summed(lang: pa.Array, term: pa.Array, run: np.ndarray, gid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    cuts = np.append(start, len(run))
    return pa.RecordBatch.from_arrays([lang, term, pa.array(np.add.reduceat(n, start)), lists(gid, cuts, pa.int64()), lists(n, cuts, pa.int64())], names=["lang", "term", "n", "gid", "count"])


def _beside(df: DataFrame, small: DataFrame, rows: int, on: str) -> DataFrame:
    """Join with a table of so many rows, broadcast only if they are few."""
    return df.join(F.broadcast(small) if rows <= SMALL else small, on)


def _share(count: Column, total: Column, scale: int) -> Column:
    """1 + scale * count // total, exact."""
    return F.expr("1L") + F.call_function("div", F.lit(scale).cast("decimal(12,0)") * count.cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def _both(rows: DataFrame) -> DataFrame:
    """For two groups a < b, over the terms that both hold: what the sums of the terms held by one of them don't have right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, open_ = 0, None

        def merge() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, v = map(np.concatenate, zip(*held, strict=True))
            t = _totals({"a": a, "b": b, "v": v}, ["v"])
            return tuple(t[c].combine_chunks().to_numpy() for c in ("a", "b", "v_sum"))

        def pairs(gid: np.ndarray, p: np.ndarray, z: np.ndarray, run_: np.ndarray) -> None:
            nonlocal size
            codes, names = np.unique(gid, return_inverse=True)[::-1]
            step = 1
            while step < len(run_):
                i = np.flatnonzero(run_[step:] == run_[:-step])
                if not len(i):
                    break
                j = i + step
                fix = np.abs(p[i] - p[j]) - np.abs(p[i] - z[j]) - np.abs(p[j] - z[i]) + np.abs(z[i] - z[j])
                t = _totals({"k": np.minimum(codes[i], codes[j]) * len(names) + np.maximum(codes[i], codes[j]), "v": fix}, ["v"])
                k = t["k"].combine_chunks().to_numpy()
                held.append((names[k // len(names)], names[k % len(names)], t["v_sum"].combine_chunks().to_numpy()))
                size += len(k)
                step += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term = batch.column(0), batch.column(1)
            new = np.append(True, pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False))
            gid, p, z = (batch.column(k).to_numpy() for k in (2, 3, 4))
            run_ = np.cumsum(new)
            if open_ is not None:
                run_ = np.append(np.full(len(open_[2]), int((lang[0].as_py(), term[0].as_py()) == open_[:2])), run_)
                gid, p, z = np.append(open_[2], gid), np.append(open_[3], p), np.append(open_[4], z)
            last = run_ == run_[-1]
            open_ = (lang[-1].as_py(), term[-1].as_py(), gid[last], p[last], z[last])
            pairs(gid[~last], p[~last], z[~last], run_[~last])
            if size > 1_000_000:
                held = [merge()]
                size = len(held[0][0])
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b", "value"])
                    held, size = [], 0
        if open_ is not None:
            pairs(*open_[2:], np.zeros(len(open_[2]), np.int64))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merge()], names=["a", "b", "value"])

    dealt = rows.select("lang", "term", "gid", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "a bigint, b bigint, value bigint")


def divergences(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """gid, other and value for every ordered pair of a language's groups. rows: lang, term, gid, p, z of all counts above 0; groups: gid, lang, z, terms."""
    sums = rows.groupBy("gid").agg(F.count("*").alias("held"), F.sum("p").alias("p"))
    a = groups.join(sums, "gid", "left").select("lang", "gid", "z", "terms", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("p", F.lit(0)).alias("p"))
    b = a.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("gid", "z", "held", "p")])
    apart = F.abs(F.col("z") - F.col("z_b"))
    base = (F.col("terms") - F.col("held") - F.col("held_b")) * apart + (F.col("p") - F.col("held") * F.col("z_b")) + (F.col("p_b") - F.col("held_b") * F.col("z"))
    every = _beside(a, b, n_groups, "lang").where("gid <> gid_b").select("gid", F.col("gid_b").alias("other"), F.coalesce(base, F.lit(0)).alias("value"))
    steps = rows.groupBy("lang", "gid", "p").agg(F.count("*").alias("many"))
    low = _beside(steps, groups.select("lang", F.col("gid").alias("other"), F.col("z").alias("z_b")), n_groups, "lang").where("gid <> other and p < z_b")
    low = low.groupBy("gid", "other").agg(F.sum(F.col("many") * (F.col("z_b") - F.col("p")) * 2).alias("value"))
    both = _both(rows).groupBy("a", "b").agg(F.sum("value").alias("value"))
    mirrored = lambda df, x, y: df.select(F.explode(F.array(F.struct(F.col(x).alias("gid"), F.col(y).alias("other"), "value"), F.struct(F.col(y).alias("gid"), F.col(x).alias("other"), "value"))).alias("r")).select("r.*")
    return every.unionByName(mirrored(low, "gid", "other")).unionByName(mirrored(both, "a", "b")).groupBy("gid", "other").agg(F.sum("value").alias("value"))


def common(low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([os.path.commonprefix([bytes(a), bytes(b)]) for a, b in zip(low, high, strict=True)], dtype=object)


def select_top(rows: DataFrame, groups: int, top: int, bits: int = 11, high: int = 33, few: int = 1000) -> DataFrame:
    """gid, term, value of at least the first top rows of each group by descending value and ascending term: no more than top
    rows and few ties. rows: gid, term (without byte 0) and value (0 to 2**high - 1), a term at most once in a group."""
    # A byte 0 ends each term, so that none is the beginning of another.
    rows = rows.select("gid", F.col("value"), F.concat(F.col("term").cast("binary"), F.lit(b"\0")).alias("term"))
    border = None  # gid, bits known of the top-th value, and how many are to be taken there
    for shift in range(high - bits, -1, -bits):
        own = F.shiftright("value", shift)
        part = rows.select("gid", own.alias("digit")) if border is None else _beside(rows.select("gid", own.alias("digit")), border, groups, "gid").where(F.shiftright("digit", bits) == F.col("known")).select("gid", "digit", "rest")
        if border is None:
            part = part.withColumn("rest", F.lit(top).cast("bigint"))
        bars = part.groupBy("gid", "digit").agg(F.count("*").alias("many"), F.first("rest").alias("rest"))
        above = F.sum("many").over(Window.partitionBy("gid").orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, 0))
        border = keep(bars.withColumn("upto", above).where("upto >= rest and upto - many < rest").select("gid", F.col("digit").alias("known"), (F.col("rest") - F.col("upto") + F.col("many")).alias("rest")))
    # Groups with fewer rows than top have no border: all of theirs are taken.
    border = border.withColumn("head", F.lit(b""))
    short = F.left("term", F.length("head"))
    lcp = F.pandas_udf(common, "binary")
    while True:
        ties = _beside(rows, border, groups, "gid").where((F.col("value") == F.col("known")) & (short == F.col("head")))
        seen = keep(ties.groupBy("gid").agg(F.count("*").alias("many"), F.min("term").alias("low"), F.max("term").alias("top"), F.first("rest").alias("rest")))
        open_ = seen.where((F.col("many") > F.col("rest")) & (F.col("many") > few)).select("gid", "rest", lcp("low", "top").alias("head"))
        open_ = keep(open_)
        if open_.isEmpty():
            break
        step = _beside(rows, border.select("gid", "known"), groups, "gid").where(F.col("value") == F.col("known"))
        step = _beside(step, open_, groups, "gid").where(F.left("term", F.length("head")) == F.col("head"))
        bars = step.groupBy("gid", F.left("term", F.length("head") + 1).alias("digit")).agg(F.count("*").alias("many"), F.first("rest").alias("rest"))
        upto = F.sum("many").over(Window.partitionBy("gid").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        cut = bars.withColumn("upto", upto).where("upto >= rest and upto - many < rest").select("gid", F.col("digit").alias("head_"), (F.col("rest") - F.col("upto") + F.col("many")).alias("rest_"))
        border = keep(border.join(cut, "gid", "left").select("gid", "known", F.coalesce("rest_", "rest").alias("rest"), F.coalesce("head_", "head").alias("head")))
    whole = rows.join(F.broadcast(border) if groups <= SMALL else border, "gid", "left")
    taken = whole.where(F.col("known").isNull() | (F.col("value") > F.col("known")) | ((F.col("value") == F.col("known")) & (short <= F.col("head"))))
    return taken.select("gid", F.left("term", F.length("term") - 1).cast("string").alias("term"), "value")


def audit(docs: DataFrame, least: int = 30, add: int = 5, scale: int = 10**9, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank."""
    named = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    salt = 0
    while True:
        plain = docs.select(*named, docs["text"].cast("string").alias("text")).withColumn("gid", F.xxhash64(F.lit(salt), "lang", "source"))
        groups = keep(plain.groupBy("lang", "source", "gid").agg(F.count("*").alias("docs")))
        n_groups, n_ids = groups.agg(F.count("*"), F.count_distinct("gid")).first()
        if n_groups == n_ids:  # else two groups share an id
            break
        salt += 1
    found = stored(kept_terms(counts(plain), least))
    langs = keep(found.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("n_lang")))
    n_langs = langs.count()
    flat = found.select("lang", "term", F.col("n").alias("of_lang"), F.explode(F.arrays_zip("gid", "count")).alias("x")).select("lang", "term", "of_lang", "x.gid", "x.count")
    own = groups.join(flat.groupBy("gid").agg(F.sum("count").alias("n")), "gid", "left").join(langs, "lang", "left")
    own = own.select("gid", "lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), (F.coalesce("n", F.lit(0)) + add * F.coalesce("terms", F.lit(0))).alias("all"))
    own = keep(own.withColumn("z", F.when(F.col("terms") > 0, _share(F.lit(add), F.col("all"), scale))))
    beside = _beside(_beside(flat, own.where("terms > 0").select("gid", "all", "z"), n_groups, "gid"), langs, n_langs, "lang")
    rows = stored(beside.select("lang", "term", "gid", "z", _share(F.col("count") + add, F.col("all"), scale).alias("p"), _share(F.col("of_lang") + add, F.col("n_lang") + add * F.col("terms"), scale).alias("q")))
    names = own.select("gid", "lang", "source")
    rank = lambda item: F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), item)).alias("rank")
    pair = _beside(divergences(rows, own, n_groups), names.select(F.col("gid").alias("other"), F.col("source").alias("item")), n_groups, "other").select("gid", F.lit("pair").alias("part"), "item", "value", rank("item"))
    term = select_top(rows.where("p > q").select("gid", "term", (F.col("p") - F.col("q")).alias("value")), n_groups, top, high=-(-scale.bit_length() // 11) * 11)
    term = term.select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank("term")).where(F.col("rank") <= top)
    return _beside(pair.unionByName(term), names, n_groups, "gid").select("lang", "source", "part", "item", "value", "rank")
