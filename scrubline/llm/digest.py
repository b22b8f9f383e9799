"""Quartile bucket digests of texts, and their bounded difference score.

Each byte with two of its next four bytes gives three triplets, hashed into 128 buckets. A digest is the length on a
logarithmic scale and, for each bucket, the quartile of the bucket counts it lies in (two bits). The difference of two
digests adds the differences of the quartiles and a capped difference of the lengths; it is at most ``WORST``, and the
likeness is 1 - (difference / WORST), stretched so that independent texts come near 0.

``with_next`` compares each text with an edited copy and with its neighbour in descending doc_id. Rows are dealt to
ranges of doc_id found from quantiles of the ids; the first row of a range is also sent to the range before it, so no
task sees more than its range and one row more. Nulls count as empty texts and null ids come last. Equal ids follow each
other in the order of their texts; repeated rows are neighbours of each other. A single row is its own neighbour, an empty
table has no rows. Texts are read whole, one at a time with its neighbour. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 128
LENGTH_WEIGHT, LENGTH_MOST = 2, 24
WORST = 3 * BUCKETS + LENGTH_MOST
_A, _B, _C = (np.random.RandomState(7).permutation(256).astype(np.uint8) for _ in range(3))


def digest(text: bytes) -> bytes:
    """Length code (2 bytes), then BUCKETS quartile codes of two bits."""
    x = np.frombuffer(text, np.uint8)
    if len(x) < 5:
        x = np.concatenate([x, np.zeros(5 - len(x), np.uint8)])
    a, b, c = _A[x], _B[x], _C[x]
    first = _B[a[:-4] ^ b[1:-3]]
    counts = np.bincount(np.concatenate([first ^ c[2:-2], _C[first ^ c[3:-1]], _A[_B[a[:-4] ^ b[2:-2]] ^ c[4:]]]) >> 1, minlength=BUCKETS)
    order = np.sort(counts)
    cuts = order[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.searchsorted(cuts, counts).astype(np.uint8)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return int(16 * np.log2(len(text) + 1)).to_bytes(2, "big") + packed.tobytes()


def difference(one: bytes, two: bytes) -> int:
    """0 for equal digests, WORST at most."""
    spread = lambda d: np.frombuffer(d[2:], np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    quartiles = int(np.abs(spread(one).astype(np.int16) - spread(two)).sum())
    length = abs(int.from_bytes(one[:2], "big") - int.from_bytes(two[:2], "big"))
    return quartiles + min(LENGTH_MOST, LENGTH_WEIGHT * length // 16)


def likeness(one: bytes, two: bytes) -> float:
    """1 for equal digests. Quartiles of independent texts differ by 1.25 on average, which counts as 0."""
    return max(0.0, 1 - difference(one, two) / (1.25 * BUCKETS + LENGTH_MOST))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the first of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 10_000).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or ()))  # at most ranges - 1 values

    # Range 0 holds the largest ids and range len(cuts) the smallest and the null ids.
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [len(cuts) if v is None else len(cuts) - bisect_left(cuts, v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["doc_id", "text", "part"])

    heads = docs.select("doc_id").withColumn("text", F.lit("")).mapInArrow(deal, "doc_id bigint, text string, part int").groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    filled = [r["part"] for r in heads]  # one row for each range
    before = {r["head"]: filled[k - 1] for k, r in enumerate(heads)}

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their range; those that may be the first of a range go to the range before as well, marked ahead."""
        for batch in deal(batches):
            ids = batch.column("doc_id").to_pylist()
            again = pa.array([k for k, v in enumerate(ids) if v in before], pa.int32())
            extra = batch.take(again)
            there = pa.array([before[ids[k]] for k in again.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([False] * len(ids))], names=["doc_id", "text", "part", "ahead"])
            yield pa.RecordBatch.from_arrays([extra.column(0), extra.column(1), there, pa.array([True] * len(again), pa.bool_())], names=["doc_id", "text", "part", "ahead"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, doc_id, text, its digest)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out = []
            for doc_id, text, part, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                mark = digest(raw)
                if last is not None and last[0] == part:
                    own = last[3]
                    other = edited(last[2], text).encode("utf-8", "surrogatepass")
                    changed = digest(other)
                    out.append((last[1], len(last[2]), hashlib.sha256(other).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, mark)))
                last = None if ahead else (part, doc_id, text, mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    rows = docs.mapInArrow(copies, "doc_id bigint, text string, part int, ahead boolean")
    dealt = rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
