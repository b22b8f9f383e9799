"""Scalar functions over pages, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.plans.registry import query


@query("SELECT page_id, trim(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)) AS slug FROM pages")
def slugs(t):
    return t("pages").select("page_id", F.trim(F.substring(F.regexp_replace(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)).alias("slug"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_text, len(regexp_extract_all(html, '<[^>]*>')) AS n_tags FROM pages")
def html_strip(t):
    return t("pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("bigint").alias("n_text"), F.regexp_count("html", F.lit("<[^>]*>")).cast("bigint").alias("n_tags"))


@query(r"SELECT conv_id, turn, regexp_matches(lower(text), '\b(tu|toi|ton|tes)\b') AS informal, regexp_matches(lower(text), '\b(vous|votre|vos)\b') AS formal FROM conversations")
def register_flags(t):
    flag = lambda p: F.regexp_like(F.lower("text"), F.lit(p))
    return t("conversations").select("conv_id", "turn", flag(r"\b(tu|toi|ton|tes)\b").alias("informal"), flag(r"\b(vous|votre|vos)\b").alias("formal"))
