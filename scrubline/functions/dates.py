"""Dates and numbers in the forms that texts write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAMES = "|".join(MONTHS)


def birth_date(s: Column) -> Column:
    """struct<day, month, year> of strings, from "2 October 1994", "October 2, 1994" or "1994-10-02" at the beginning; null
    for other forms. The day has no leading zeros, the month is a lower-case name."""
    first, second, third = (rf"(?i)^(\d{{1,2}})\s+({_NAMES})\s+(\d{{4}})", rf"(?i)^({_NAMES})\s+(\d{{1,2}}),?\s+(\d{{4}})", r"^(\d{4})-(\d{1,2})-(\d{1,2})")
    part = lambda p, k: F.regexp_extract(s, p, k)
    day = lambda d: F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0"))
    of = lambda d, m, y: F.struct(d.alias("day"), F.lower(m).alias("month"), y.alias("year"))
    name = F.coalesce(F.try_element_at(F.array(*[F.lit(m) for m in MONTHS]), F.nullif(part(third, 2).try_cast("int"), F.lit(0))), part(third, 2))
    return (
        F.when(F.regexp_like(s, F.lit(first)), of(day(part(first, 1)), part(first, 2), part(first, 3)))
        .when(F.regexp_like(s, F.lit(second)), of(day(part(second, 2)), part(second, 1), part(second, 3)))
        .when(F.regexp_like(s, F.lit(third)), of(day(part(third, 3)), name, part(third, 1)))
    )
