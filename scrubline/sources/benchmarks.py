"""Benchmarks by name: aliases, readers and paths, label scopes, and what annotation a file really has."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import loaders

# Other names, and the labels that a benchmark annotates (those not named here: all labels).
ALIASES = {"db-bio": "dbbio", "json": "anonymization", "rat-bench": "ratbench", "cleanconll2003": "conll2003", "personal-reddit": "personalreddit", "reddit": "personalreddit"}
SCOPES = {"conll2003": frozenset({"PER", "ORG", "LOC", "MISC"}), "dbbio": frozenset({"PER", "PERSON"})}
CONLL_TAG = {"original": 3, "clean": 4}


def canonical(name: str) -> str:
    key = name.strip().lower()
    return ALIASES.get(key, key)


@dataclass(frozen=True)
class Benchmark:
    """path(split) is below the root; fixed_split reads that split whatever is asked; fallback is read where a split's
    file is missing."""

    title: str
    path: Callable[[str], str]
    read: Callable[..., DataFrame]
    fixed_split: str | None = None
    fallback: str | None = None


REGISTRY: dict[str, Benchmark] = {}


def register(name: str, benchmark: Benchmark) -> None:
    """Add a benchmark of one's own; a name that is taken is an error."""
    if canonical(name) in REGISTRY:
        raise ValueError(f"benchmark {name!r} is registered already")
    REGISTRY[canonical(name)] = benchmark


register("tab", Benchmark("TAB", lambda s: f"TAB/{s}.jsonl", loaders.load_masked_entities))
register("dbbio", Benchmark("DB-bio", lambda s: f"DB-bio/{s}.jsonl", loaders.load_biographies, fixed_split="test"))
register("anonymization", Benchmark("anonymization_dataset", lambda s: "data/anonymization_dataset.json", loaders.load_examples))
register("ratbench", Benchmark("RAT-Bench", lambda s: "RAT-Bench/english.json", loaders.load_levelled_profiles))
register("conll2003", Benchmark("CoNLL2003", lambda s: f"CoNLL2003/{s}.txt", lambda spark, path, limit=None, variant="clean": loaders.load_columns(spark, path, CONLL_TAG[variant], limit)))
register("personalreddit", Benchmark("PersonalReddit", lambda s: f"PersonalReddit/Reddit_synthetic/{s}.jsonl", loaders.load_profiles, fallback="test"))


def load(spark: SparkSession, name: str, root: str, split: str = "test", limit: int | None = None, **options) -> tuple[DataFrame, str]:
    """Documents (doc_id, text, spans and more) and the title title/split. An unknown name is an error."""
    b = REGISTRY.get(canonical(name))
    if b is None:
        raise ValueError(f"unknown benchmark {name!r}; there are {', '.join(sorted(REGISTRY))}")
    path = f"{root}/{b.path(b.fixed_split or split)}"
    if b.fallback and not loaders.exists(spark, path):
        path = f"{root}/{b.path(b.fallback)}"
    return b.read(spark, path, limit=limit, **options), f"{b.title}/{b.fixed_split or split}"


def in_scope(spans: DataFrame, name: str) -> DataFrame:
    """Predicted spans whose label the benchmark annotates; gold spans aren't to be filtered."""
    labels = SCOPES.get(canonical(name))
    return spans if labels is None else spans.where(F.upper("label").isin(*sorted(labels)))


def split_of(path: str) -> str:
    """train, dev or test by a file's name; test where it says nothing."""
    last = os.path.splitext(os.path.basename(path).lower())
    part = last[0] if last[1] in ("", ".txt") else last[1][1:]
    return {"train": "train", "dev": "dev", "valid": "dev"}.get(part, "test")


def annotation_status(spark: SparkSession, path: str, sample: int = 25) -> str:
    """official_offsets, converted_no_offsets or unknown_schema, by the first records of a file."""
    kind = "annotations array<struct<start:int,end:int,type:string,label:string>>, entities array<struct<start:int,end:int,type:string,label:string>>, meta struct<masked_entities:array<string>>"
    rows = loaders.read_sample(spark, path, kind, sample)
    notes = F.when(F.size("annotations") > 0, F.col("annotations")).otherwise(F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,type:string,label:string>>")))
    placed = F.exists(notes, lambda a: a["start"].isNotNull() & a["end"].isNotNull())
    typed = F.exists(notes, lambda a: (F.coalesce(a["type"], F.lit("")) != "") | (F.coalesce(a["label"], F.lit("")) != ""))
    found = rows.agg(F.bool_or(placed).alias("placed"), F.bool_or(typed).alias("typed"), F.bool_or(F.size("meta.masked_entities") > 0).alias("masked")).first()
    if found["placed"] and found["typed"]:
        return "official_offsets"
    return "converted_no_offsets" if found["masked"] else "unknown_schema"


def mask_files(spark: SparkSession, path: str, to: str, mask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Whole text files under path, masked, one row a file as JSON lines at to (doc_id: the file's path, text). mask gets
    doc_id and text and gives doc_id and masked. Returns what was written."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    mask(docs).select("doc_id", F.col("masked").alias("text")).write.mode("overwrite").json(to)
    return spark.read.schema("doc_id string, text string").json(to)
