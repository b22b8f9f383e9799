"""Likeness of short strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: str, b: str) -> float:
    """Jaro likeness: characters that agree within half the longer length, less half the share that is out of order; an odd one counts half as well."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, unused in zip(b, free, strict=True) if not unused]
    m = len(left)
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@F.pandas_udf(DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of a batch once."""
    known: dict[tuple[str, str], float | None] = {}
    return pd.Series([known[p] if p in known else known.setdefault(p, None if p[0] is None or p[1] is None else jaro(*p)) for p in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler(a, b, weight: float = 0.1, longest: int = 4):
    """Jaro likeness raised by the common prefix, at any likeness."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), F.lit(0), lambda n, k: n + ((F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))).cast("int"))
    j = jaro_udf(a, b)
    return j + same * weight * (1 - j)
