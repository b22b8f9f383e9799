"""Seeded draws: every one is a hash of seed, purpose and index, so that rows are made in parallel, in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, purpose: str, *index: Column) -> Column:
    """Uniform in [0, 1): 32 bits of a digest of seed, purpose and index."""
    name = F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[i.cast("string") for i in index])
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)


def choose(at: Column, shares: dict[str, float]) -> Column:
    """The value whose share of the total the draw falls in."""
    total, upto, out = sum(shares.values()), 0.0, None
    for value, share in list(shares.items())[:-1]:
        upto += share
        test = at < upto / total
        out = F.when(test, value) if out is None else out.when(test, value)
    last = F.lit(list(shares)[-1])
    return last if out is None else out.otherwise(last)
