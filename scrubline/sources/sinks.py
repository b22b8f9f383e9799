"""Writers: JSON lines, flattened Parquet, mentions, review tasks, run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_jsonl(df: DataFrame, path: str, sort_keys: bool = False, mode: str = "overwrite") -> str:
    """One object a line, nulls kept; with sort_keys, keys in order. mode "append" adds to what is there."""
    out = df.select(*sorted(df.columns)) if sort_keys else df
    out.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs become dotted columns; arrays and maps become JSON text."""

    def leaves(kind: StructType, prefix: str, at: Column | None) -> list[Column]:
        out = []
        for f in kind:
            own = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            name = f"{prefix}.{f.name}" if prefix else f.name
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, name, own)
            else:
                out.append((F.to_json(own, {"ignoreNullFields": "false"}) if isinstance(f.dataType, (ArrayType, MapType)) else own).alias(name))
        return out

    return df.select(*leaves(df.schema, "", None))


def export_parquet(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Flattened tables under a folder; empty ones are left out. Returns name -> path."""
    out = {}
    for name, df in tables.items():
        if not df.isEmpty():
            out[name] = f"{folder}/{name}.parquet"
            flatten(df).write.mode("overwrite").parquet(out[name])
    return out


def mentions(docs: DataFrame) -> DataFrame:
    """One row for each span of each document."""
    return docs.select("doc_id", F.posexplode("spans").alias("mention", "s"), "text").select("doc_id", "mention", "s.start", "s.end", "s.label", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("snippet"))


def review_tasks(docs: DataFrame) -> DataFrame:
    """Tasks for reviewers: doc_id, task (JSON with the text and its spans), mean score rounded to 4."""
    mean = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["score"], lambda a: F.round(F.try_divide(a, F.size("spans")), 4))
    data = F.struct(F.struct("doc_id", "text").alias("data"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(s["label"]).alias("labels"), s["score"].alias("score"))).alias("result"))
    return docs.select("doc_id", F.to_json(data).alias("task"), mean.alias("score"))


def apply_reviews(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """The last review of each document replaces its spans. reviews: doc_id, at (order), spans."""
    last = reviews.groupBy("doc_id").agg(F.max_by("spans", "at").alias("reviewed"))
    return docs.join(last, "doc_id", "left").withColumn("spans", F.coalesce("reviewed", "spans")).drop("reviewed")


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Both runs' metrics side by side (missing: 0) and their difference, rounded to 6."""
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    both = left.join(right, keys, "full").fillna(0.0, [f"{m}_{k}" for m in metrics for k in "ab"])
    return both.withColumns({f"{m}_delta": F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 6) for m in metrics})
