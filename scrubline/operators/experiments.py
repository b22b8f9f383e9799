"""Variants of settings over data sets: one result for each pair, failures beside the others; coverage of a run's tables."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.operators.settings import for_dataset

RESULT = "dataset string, variant string, at int, path string, seconds double, error string"


def run_variants(spark: SparkSession, datasets: Mapping[str, DataFrame], variants: Mapping[str, Mapping[str, Any]], evaluate: Callable[[DataFrame, Mapping[str, Any]], DataFrame], folder: str) -> DataFrame:
    """dataset, variant, at (order given), path, seconds and error of each pair. evaluate gets documents and the data set's
    settings with the variant's, its result goes to folder/dataset/variant as Parquet. A pair that fails has an error and
    no path; the others go on. Documents that stand for several variants are best given as a written table."""
    rows = []
    for name, docs in datasets.items():
        for at, (variant, own) in enumerate(variants.items()):
            to, began, error = f"{folder}/{name}/{variant}", time.time(), None
            try:
                evaluate(docs, for_dataset(own, name)).write.mode("overwrite").parquet(to)
            except Exception as e:  # noqa: BLE001 - a failing pair is this row's result
                error = f"{type(e).__name__}: {str(e)[:500]}"
            rows.append((name, variant, at, None if error else to, round(time.time() - began, 3), error))
    return spark.createDataFrame(rows, RESULT)


def collected(spark: SparkSession, results: DataFrame) -> DataFrame:
    """The rows of all results that didn't fail, with data set and variant. One row a pair is read on the driver."""
    parts = [spark.read.parquet(r["path"]).withColumns({"dataset": F.lit(r["dataset"]), "variant": F.lit(r["variant"])}) for r in results.where("path is not null").orderBy("dataset", "at").collect()]
    if not parts:
        raise ValueError("no pair of data set and variant has a result")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coverage(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """name, rows and duplicates (rows beyond the first of each key) of a run's tables. A key with a null is a key too; a
    table without key columns has no duplicates."""

    def one(name: str, df: DataFrame, key: Sequence[str]) -> DataFrame:
        if not key:
            return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(0).cast("bigint").alias("duplicates"))
        each = df.groupBy(*key).agg(F.count("*").alias("n"))
        return each.agg(F.lit(name).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))

    return functools.reduce(DataFrame.unionByName, [one(name, df, key) for name, (df, key) in tables.items()])


def flags(measures: DataFrame) -> DataFrame:
    """Warnings of a corpus from its one row of self_bleu, distinct_2 and cell_coverage; missing measures count as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return measures.select((zero("self_bleu") > 0.90).alias("self_bleu_collapse"), (zero("distinct_2") < 0.15).alias("distinct_2_low"), (zero("cell_coverage") < 0.60).alias("cell_coverage_low"))
