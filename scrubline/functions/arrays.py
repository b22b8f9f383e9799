"""Column helpers for arrays: one evaluation for several uses, and running sums and maxima in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: it is the element of a one-element array."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each place of an array<int>, what join makes of the values up to and with it (a sum, a maximum).

    Arrays are copied when they grow, so values are joined within blocks of BLOCK and the blocks' results then carried
    over: the work grows with the length, and only the small number of blocks counts twice."""
    none = F.array().cast("array<int>")

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(join(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero)), x))))

    def blocks(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))).otherwise(none)
        return F.transform(starts, lambda i: scan(F.slice(xs, i, BLOCK)))

    def carried(inner: Column) -> Column:
        before = F.concat(F.array(F.lit(zero)), scan(F.transform(inner, lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda b, a: F.transform(b, lambda x: join(a, x))))

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, scan(v)).otherwise(let(blocks(v), carried)))


def sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def maxima(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), -(2**31))
