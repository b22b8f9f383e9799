"""Line patches in diff's normal format, applied to a table of numbered lines, and the merge with annotation lines.

The patch is parsed on the driver (it is a small file beside the text); the lines stay a table. A patch becomes two
tables: which old lines go, and which new lines come after which old line. Both are joined by line number.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HEADER = re.compile(r"(\d+)(?:,(\d+))?([acd])(\d+)(?:,(\d+))?")


class Change(NamedTuple):
    op: str
    first: int
    last: int
    old: tuple[str, ...]
    new: tuple[str, ...]


def parse_patch(text: str) -> list[Change]:
    """Changes in order. Anything that isn't a header, a payload line or the separator is an error."""
    out: list[Change] = []
    lines, at = text.split("\n"), 0

    def payload(mark: str) -> tuple[str, ...]:
        nonlocal at
        begin = at
        while at < len(lines) and lines[at][:1] == mark:
            at += 1
        return tuple(re.sub(r"^. ?", "", x) for x in lines[begin:at])

    while at < len(lines):
        head = lines[at].strip()
        at += 1
        if not head:
            continue
        m = _HEADER.fullmatch(head)
        if m is None:
            raise ValueError(f"not a patch header: {head!r}")
        op = m[3]
        old = payload("<") if op != "a" else ()
        if op == "c":
            if at == len(lines) or lines[at].strip() != "---":
                raise ValueError(f"no separator in change {head!r}")
            at += 1
        out.append(Change(op, int(m[1]), int(m[2] or m[1]), old, payload(">") if op != "d" else ()))
    return out


def apply_patch(lines: DataFrame, changes: list[Change]) -> DataFrame:
    """line_no (from 1, gapless) and line after the changes. lines: line_no (from 1), line. A change whose old lines
    aren't those found raises when the result is computed."""
    spark = lines.sparkSession
    gone = [(n, c.old[n - c.first] if n - c.first < len(c.old) else None, bool(c.old), len(c.old) != c.last - c.first + 1) for c in changes if c.op != "a" for n in range(c.first, c.last + 1)]
    come = [(c.first if c.op == "a" else c.last, k, x) for c in changes for k, x in enumerate(c.new)]
    old = spark.createDataFrame(gone, "line_no bigint, expected string, told boolean, uneven boolean")
    new = spark.createDataFrame(come, "line_no bigint, k int, line string")
    wrong = F.col("told") & (F.col("uneven") | F.col("line").isNull() | (F.col("expected") != F.col("line")))
    checked = old.join(lines.select(F.col("line_no").cast("bigint"), "line"), "line_no", "left")
    checked = checked.select("line_no", F.when(wrong, F.raise_error(F.concat(F.lit("the patch doesn't fit line "), F.col("line_no").cast("string")))).otherwise(F.lit(True)).cast("boolean").alias("gone"))
    stay = lines.select(F.col("line_no").cast("bigint"), "line").join(checked, "line_no", "left").where(F.coalesce("gone", F.lit(False)) == F.lit(False)).select("line_no", F.lit(-1).alias("k"), "line")
    return numbered(stay.unionByName(new), ["line_no", "k"])


def numbered(rows: DataFrame, order: list[str], lines_in_range: int = 1 << 20) -> DataFrame:
    """line_no and line in order: counted within ranges of old line numbers, so no task holds all lines."""
    rows = rows.withColumn("_range", (F.col("line_no") / lines_in_range).cast("bigint"))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row a range
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_own", own).join(before, "_range").select((F.col("_before") + F.col("_own")).alias("line_no"), "line")


def merge_annotations(tokens: DataFrame, annotations: DataFrame) -> DataFrame:
    """line_no and line: the token in place of the first of the annotation's tab-separated columns (five at least). Lines
    without annotation keep the token. Different numbers of lines, or too few columns, are an error."""
    t = tokens.select("line_no", F.col("line").alias("token"), F.lit(True).alias("_t"))
    a = annotations.select("line_no", F.col("line").alias("note"), F.lit(True).alias("_a"))
    both = t.join(a, "line_no", "full_outer")
    parts = F.split("note", "\t")
    joined = F.concat_ws("\t", F.col("token"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    line = (
        F.when(F.col("_t").isNull() | F.col("_a").isNull(), F.raise_error("token and annotation lines differ in number"))
        .when(F.coalesce("note", F.lit("")) == "", F.coalesce("token", F.lit("")))
        .when(F.size(parts) < 5, F.raise_error(F.concat(F.lit("not an annotation line: "), F.col("note"))))
        .otherwise(joined)
    )
    return both.select("line_no", line.cast("string").alias("line"))
