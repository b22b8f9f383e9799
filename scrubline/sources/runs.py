"""Evaluation runs as tables: naming, saving, listing, summaries and rankings.

A run's documents are written by Spark; its small records (metadata, summaries) go through Spark's writers too, so that
a run can live in any store Spark reaches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slug(text: str) -> str:
    """Lower-case letters and digits, other runs of characters become one dash."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def run_id(created_at: str, pipeline: str, dataset: str, run_name: str | None = None) -> str:
    """The time's first 14 digits, pipeline and dataset; a run's name goes before."""
    parts = [re.sub(r"\D", "", created_at)[:14], slug(pipeline), slug(dataset)]
    return "_".join([slug(run_name), *parts] if run_name else parts)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_run(documents: DataFrame, folder: str, meta: Mapping, run_name: str | None = None, overwrite: bool = False) -> str:
    """Documents and metadata under folder/<run id>. An id that is taken gets _2, _3 and so on unless overwrite is set.
    Returns the run's folder."""
    spark = documents.sparkSession
    base = f"{folder}/{run_id(str(meta['created_at']), str(meta.get('pipeline') or 'pipeline'), str((meta.get('dataset') or {}).get('name') or 'dataset'), run_name)}"
    to, k = base, 2
    while not overwrite and _there(spark, to):
        to, k = f"{base}_{k}", k + 1
    documents.write.mode("overwrite").json(f"{to}/documents")
    write_text(spark, json.dumps(dict(meta), ensure_ascii=False, sort_keys=True), f"{to}/meta")
    return to


def write_text(spark: SparkSession, text: str, path: str) -> str:
    """A small text as one file below path."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def list_runs(spark: SparkSession, folder: str) -> list[str]:
    """Names of the runs in a folder, last first; none where the folder is missing."""
    if not _there(spark, folder):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted((s.getPath().getName() for s in found if s.isDirectory()), reverse=True)


def summarise(documents: DataFrame, by: list[str], metrics: list[str], digits: int = 6) -> DataFrame:
    """Counts and means in all, for each single column of ``by``, and nothing else. Documents with an error are counted
    apart and don't enter the means. axis names the column, value its value (null: all documents)."""
    ok = F.col("error").isNull()
    axes = F.array(F.struct(F.lit("all").alias("axis"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("axis"), F.col(c).cast("string").alias("value")) for c in by])
    rows = documents.select("*", F.explode(axes).alias("_axis")).groupBy("_axis.axis", "_axis.value")
    return rows.agg(F.count_if(ok).alias("documents"), F.count_if(~ok).alias("errors"), *[F.round(F.avg(F.when(ok, F.col(m))), digits).alias(m) for m in metrics])


def rank_variants(results: DataFrame, metric: str = "primary_metric") -> DataFrame:
    """Variants by the metric (missing counts as 0), then in their order; the difference to the first variant, rounded to
    6. results: variant, at (order given) and the metric; one row a variant."""
    first = F.first(metric).over(W.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    place = F.row_number().over(W.orderBy(F.coalesce(metric, F.lit(0.0)).desc(), "at"))
    return results.withColumn("delta_vs_first", F.round(F.col(metric) - first, 6)).withColumn("place", place)


def markdown_table(rows: DataFrame, columns: list[str], order: list[str], right: tuple[str, ...] = (), most: int = 10_000) -> str:
    """A small table as Markdown, an error beyond most rows; numbers with a fraction have four places, missing ones are n/a."""

    def cell(x) -> str:
        return "n/a" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)

    found = rows.orderBy(*order).select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a table of more than {most} rows is to be written, not shown")
    lines = [f"| {' | '.join(columns)} |", f"| {' | '.join('---:' if c in right else '---' for c in columns)} |"]
    lines += [f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in found]
    return "\n".join(lines) + "\n"
