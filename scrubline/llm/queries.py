"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocation, credentials, digest, divergence, jaccard, media, mixing, oracles, packing, quality, sharding, substring, tokencount, tokenfile
from .tables import shared_folder, table

BYTE_BPE, PIECE_BPE, WORD_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=1024)


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), width=50)


def media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"), block=192)


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def digest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_next(table(spark, sf_dir, "documents"))


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = sharding.place(docs, "doc_id", 24, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), limit=4096)


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan_secrets(table(spark, sf_dir, "documents"), reach=200)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, add=5, scale=10**9, top=50)


def collocation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, share=50, top=2000)


def tokenfile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    tokenfile.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), folder, end=2)
    ids = tokenfile.read_ids(spark, folder)
    return ids.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing_query,
    "op2_substring_dedup": substring_query,
    "op3_media": media_query,
    "op4_jaccard_join": jaccard_query,
    "op5_fingerprints": digest_query,
    "op6_sharding": sharding_query,
    "op7_token_counts": token_query,
    "op8_secret_scans": secrets_query,
    "op9_mixing": mixing_query,
    "op10_quality": quality_query,
    "op11_divergence": divergence_query,
    "op12_collocations": collocation_query,
    "op13_token_files": tokenfile_query,
}

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": oracles.SUBSTRING, "op4_jaccard_join": oracles.JACCARD, "op11_divergence": oracles.DIVERGENCE, "op12_collocations": oracles.COLLOCATIONS}
