"""Person records of a census sample: pruned CSV scan, decoding, and the cached Parquet table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.operators.incremental import read_or_none

# The columns read, and the names they get.
COLUMNS = {
    "SERIALNO": "SERIALNO",
    "PWGTP": "PWGTP",
    "SEX": "sex",
    "RAC2P": "race",
    "CIT": "citizenship status",
    "SCHL": "educational attainment",
    "ESR": "employment status",
    "ST": "state of residence",
    "MAR": "marital status",
    "OCCP": "occupation",
}
KEPT = ("SERIALNO", "PWGTP")


def process_population(spark: SparkSession, pattern: str, to: str, codes: Mapping[str, Mapping[int, str]]) -> DataFrame:
    """Decode the CSV files that match the pattern and write them as Parquet, once; what is there already is read.

    Only needed columns are scanned, and files may lack some. codes has a mapping for each coded column; a code that isn't
    in it becomes null. A column without mapping keeps its text."""
    there = read_or_none(spark, to)
    if there is not None:
        return there
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(pattern)
    out = []
    for name in (c for c in COLUMNS if c in raw.columns):
        c = F.col(name)
        if name == "PWGTP":
            c = F.try_to_number(c, F.lit("999999999")).cast("int")
        elif name not in KEPT and codes.get(name):
            # Codes may be written as 1, 01 or 1.0; the lookup is a literal map, so the scan needs no join.
            table = F.create_map(*[F.lit(x) for kv in codes[name].items() for x in (int(kv[0]), kv[1])])
            c = F.try_element_at(table, F.expr(f"try_cast(try_cast(`{name}` as double) as int)"))
        out.append(c.alias(COLUMNS[name]))
    raw.select(*out).write.mode("errorifexists").parquet(to)
    return spark.read.parquet(to)


def load_population(spark: SparkSession, to: str, pattern: str | None = None, codes: Mapping[str, Mapping[int, str]] | None = None) -> DataFrame | None:
    """The cached table; else made from CSV files where a pattern is given; else None."""
    there = read_or_none(spark, to)
    if there is None and pattern:
        return process_population(spark, pattern, to, codes or {})
    return there
