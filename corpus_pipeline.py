"""From raw documents to packed sequences: classify, deduplicate, mask secrets, mix sources, pack.

Each stage takes the documents its predecessor kept and works on all of them. Null texts count as empty and blank ones are
near copies of nothing; texts of any length are read whole; an empty table gives an empty table. All but the last stage
return the columns they were given, also ones of other names, with their values (the secret scan changes text and n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import credentials, jaccard, mixing, packing, quality
from scrubline.llm.tables import shared_folder, table
from scrubline.plans.ship import ship


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Equal rows have one fate; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays; documents without an id all stay. Rows of one
    id are one document: its different texts stay together, and of rows alike in id and text one stays, the one with the
    least hash of the other columns."""
    found = jaccard.jaccard_components(docs, n=5, percent=80)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    if rest:
        hashed = F.xxhash64(*[F.to_json(F.struct(*rest))])
        kept = kept.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), hashed).alias("row")).select("doc_id", "text", "row.*").select(*[F.col(f"`{c}`") for c in docs.columns])
    else:
        kept = kept.distinct()
    return kept.unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported secrets are replaced by a mark in the texts; n_chars follows. No row goes; null texts stay null."""
    masked = credentials.redact(docs, reach=200)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Repeated rows are drawn each for itself; reruns agree."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 1024 tokens; repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

# Trained models, random rounding and subword ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and read again."""
    docs, folder = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
