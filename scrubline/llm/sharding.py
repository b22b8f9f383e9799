"""Shards by jump consistent hashing, in DataFrame functions only.

Every key walks a fixed pseudo-random sequence of jumps (the published 64-bit linear congruential generator) and stays in
the last bucket below the number of shards, so one more shard takes keys only into itself. Products modulo 2**64 are put
together from halves of 32 bits, which can't overflow under ANSI arithmetic.

``place`` also numbers the rows of each shard from 0 without gaps: rows are counted in buckets of each shard, offsets are
sums over the small table of counts, and only rows of one bucket are ordered together (by the columns asked for). The
number of buckets follows the number of rows, which is counted beforehand without reading a column but the key.

A null key counts as key 0. Repeated rows get slots of their own, in any order among themselves. An empty table has no
rows. Texts aren't read by ``place``; long ones only count in what the caller derives from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_MULTIPLIER = 2862933555777941757  # fixed value of the published algorithm
_LOW, _HIGH = _MULTIPLIER & 0xFFFFFFFF, _MULTIPLIER >> 32


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """State * multiplier + 1 modulo 2**64 on unsigned halves."""
    mask, half = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    by_low, by_high = low * F.lit(_LOW & 0xFFFF), low * F.lit(_LOW >> 16)
    bottom = by_low + F.shiftleft(by_high.bitwiseAND(half), 16) + F.lit(1)
    cross = lambda a, b: (a.bitwiseAND(half) * F.lit(b)) + F.shiftleft((F.shiftright(a, 16) * F.lit(b & 0xFFFF)).bitwiseAND(half), 16)
    top = F.shiftright(bottom, 32) + F.shiftright(by_high, 16) + cross(high, _LOW) + cross(low, _HIGH)
    return top.bitwiseAND(mask), bottom.bitwiseAND(mask)


def jump_hash(key: Column, shards: int) -> Column:
    """Bucket of 0 .. shards-1 for a 64-bit integer key."""
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    mask = F.lit(0xFFFFFFFF)
    start = F.struct(F.shiftrightunsigned(key, 32).bitwiseAND(mask).alias("h"), key.bitwiseAND(mask).alias("l"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(s: Column, _: Column) -> Column:
        h, low = _next(s["h"], s["l"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + 1).cast("double")))
        return F.when(s["j"] < shards, F.struct(h.alias("h"), low.alias("l"), s["j"].alias("b"), jump.alias("j"))).otherwise(s)

    # Each jump goes up by one at least, so no key needs more steps than shards.
    return F.aggregate(F.array_repeat(F.lit(0), shards + 1), start, step, lambda s: s["b"].cast("int"))


def place(rows: DataFrame, key: str, shards: int, columns: list[str], rows_in_bucket: int = 20_000) -> DataFrame:
    """columns with shard, slot (0 .. in each shard) and grown_shard (with one shard more); columns of these names are refused."""
    if taken := {"shard", "slot", "grown_shard"} & {c.lower() for c in columns}:
        raise ValueError(f"columns {sorted(taken)} are this operator's own")
    n = rows.select(key).count()
    buckets = max(1, n // (shards * rows_in_bucket) + 1)
    row = F.struct(*[rows[f"`{c}`"] for c in columns]).alias("row")
    # Buckets are dealt by the whole row, so that many rows of one key, or without a key, don't share one.
    rows = rows.select(row, jump_hash(rows[key], shards).alias("shard"), jump_hash(rows[key], shards + 1).alias("grown_shard"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("row")) - 1
    return rows.withColumn("own", own).join(before, ["shard", "bucket"]).select("row.*", "shard", (F.col("before") + F.col("own")).cast("bigint").alias("slot"), "grown_shard")
