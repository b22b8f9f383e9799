"""Rewriting by a model, chunk by chunk: only chunks that hold a leak are asked for, the others stay as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.operators.detection import context_chunks

# Confidence of a leak that counts, shares of its length that a chunk and a text must keep.
CONFIDENCE, LEAST_OF_CHUNK, LEAST_OF_TEXT = 0.5, 0.3, 0.4
_BLANK = r"^\s+|\s+$"


def relevant(chunk: Column, leaks: Column, confidence: float = CONFIDENCE) -> Column:
    """Of an array of leaks (attribute, evidence, confidence) those sure enough whose evidence stands in a chunk, in any case."""
    evidence = lambda x: F.regexp_replace(F.coalesce(x["evidence"], F.lit("")), _BLANK, "")
    return F.filter(F.coalesce(leaks, F.array().cast("array<struct<attribute:string,evidence:string,confidence:double>>")), lambda x: (F.coalesce(x["confidence"], F.lit(0.0)) >= confidence) & (evidence(x) != "") & F.contains(F.lower(chunk), F.lower(evidence(x))))


def rewrite_leaks(docs: DataFrame, answer: Callable[[DataFrame], DataFrame], most: int = 4000, confidence: float = CONFIDENCE, of_chunk: float = LEAST_OF_CHUNK, of_text: float = LEAST_OF_TEXT) -> DataFrame:
    """docs with new texts, asked and rewritten (numbers of chunks). docs: text, leaks (array of attribute, evidence,
    confidence), and any other columns but row, asked, rewritten.

    Texts are cut between sentences into chunks of at most most characters. answer is given row, chunk, text and issues of
    the chunks that hold leaks, and gives row, chunk and response. A response that is blank or shorter than of_chunk of its
    chunk is not taken; a text that would be shorter than of_text of itself stays whole. What lies between the chunks and
    around them is kept. Rows are numbered in a checkpoint first, so null and repeated ids are rows of their own; texts
    without leaks are neither asked for nor exchanged. Null and blank texts stay."""
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    chunks = context_chunks(F.coalesce("text", F.lit("")), most)
    wanted = F.size(F.filter(F.coalesce("leaks", F.array().cast(docs.schema["leaks"].dataType)), lambda x: F.coalesce(x["confidence"], F.lit(0.0)) >= confidence)) > 0
    cut = numbered.where(wanted).select("row", F.col("leaks"), F.posexplode(chunks).alias("chunk", "c"))
    asked = cut.select("row", "chunk", F.col("c.text").alias("text"), relevant(F.col("c.text"), F.col("leaks"), confidence).alias("issues")).where(F.size("issues") > 0).checkpoint()
    told = answer(asked).select("row", "chunk", F.regexp_replace("response", _BLANK, "").alias("response"))
    taken = asked.select("row", "chunk", F.length("text").alias("_n")).join(told, ["row", "chunk"], "left")
    good = F.when((F.col("response") != "") & (F.length("response") >= F.col("_n") * of_chunk), F.col("response"))
    by_row = taken.select("row", "chunk", good.alias("new")).groupBy("row").agg(F.count("*").alias("asked"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("chunk", "new"))))).alias("_new"))
    open_ = numbered.join(by_row, "row")
    said = F.transform("_c", lambda c, i: F.concat(F.coalesce(F.try_element_at("_new", i), c["text"]), c["separator"]))
    last = F.element_at("_c", -1)
    around = F.concat(F.substring("text", F.lit(1), F.col("_c")[0]["offset"]), F.array_join(said, ""), F.substring(F.col("text"), last["offset"] + F.length(last["text"]) + 1, F.length("text")))
    made = open_.withColumn("_c", chunks).withColumn("_text", around)
    fits = F.length("_text") >= F.length("text") * of_text
    changed = made.select(*[F.when(fits, F.col("_text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "asked", F.when(fits, F.size("_new")).otherwise(0).cast("bigint").alias("rewritten"))
    rest = numbered.join(by_row.select("row"), "row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("bigint").alias("asked"), F.lit(0).cast("bigint").alias("rewritten"))
    return changed.unionByName(rest)
