"""Attacks by a model, with what tables say in its place where its answer is unusable: attributes one after another, candidates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN = "array<struct<attribute:string,value:string,source:string>>"
_BLANK = r"^\s+|\s+$"


def prompt(attribute: str, text: Column, known: Column) -> Column:
    """What a model is asked: the attribute, what it has found so far in order, the text."""
    told = F.array_join(F.transform(known, lambda k: F.concat_ws("=", k["attribute"], F.coalesce(k["value"], F.lit("?")))), "; ")
    return F.concat(F.lit(f"Attribute: {attribute}\nKnown: "), told, F.lit("\nText: "), F.coalesce(text, F.lit("")))


def attack_attributes(docs: DataFrame, attributes: Sequence[str], ask: Callable[[DataFrame], DataFrame], fallback: Mapping[str, Column]) -> DataFrame:
    """docs with known: for each attribute in order its value and where it is from (model, structured, none).

    A fold over the attributes: each step's answers are part of the next step's prompts. ask is given row, attribute and
    prompt and gives row and response, a JSON object with value; where there is none, or it is blank or no such object, the
    attribute's fallback, an expression on docs, stands in. Each step is a checkpoint, so no model is asked twice; rows are
    numbered in the first one, so null and repeated ids are rows of their own."""
    state = docs.withColumns({"row": F.monotonically_increasing_id(), "known": F.array().cast(KNOWN)}).checkpoint()
    for name in attributes:
        asked = state.select("row", F.lit(name).alias("attribute"), prompt(name, F.col("text"), F.col("known")).alias("prompt"))
        told = ask(asked).groupBy("row").agg(F.min("response").alias("_response"))
        value = F.regexp_replace(F.get_json_object("_response", "$.value"), _BLANK, "")
        good = F.coalesce(value != "", F.lit(False))
        other = fallback.get(name, F.lit(None)).cast("string")
        entry = F.struct(F.lit(name).alias("attribute"), F.when(good, value).otherwise(other).alias("value"), F.when(good, "model").when(other.isNotNull(), "structured").otherwise("none").alias("source"))
        state = state.join(told, "row", "left").withColumn("known", F.array_append("known", entry).cast(KNOWN)).drop("_response").checkpoint()
    return state.drop("row")


def model_ranking(response: Column, structured: Column, most: int = 5) -> Column:
    """struct<ranking, source>: a model's ranking (JSON with ranking, a list of candidates) of those there are, each once,
    followed by the others in the structured order; that order alone where the answer names none of them."""
    named = F.array_distinct(F.coalesce(F.from_json(F.get_json_object(response, "$.ranking"), "array<string>"), F.array().cast("array<string>")))
    known = F.filter(named, lambda c: F.array_contains(structured, c))
    whole = F.concat(known, F.filter(structured, lambda c: ~F.array_contains(known, c)))
    return F.struct(F.slice(whole, 1, most).alias("ranking"), F.when(F.size(known) > 0, "model").otherwise("structured").alias("source"))
