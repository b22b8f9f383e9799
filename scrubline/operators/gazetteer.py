"""All places of the values of a lexicon that all documents share, in one pass over the texts for each part of the lexicon.

A part is a multi-pattern automaton of a bounded number of characters, built once in each Python worker from a broadcast of its
values, so a text is read once whatever the number of values. A larger lexicon is cut into parts, and the texts are read once
for each: nothing of the documents is exchanged, and no value is left out."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES = "doc_id bigint, start int, end int, value string"
_BUILT: dict[tuple, object] = {}


def _automaton(values: list[str], key: tuple):
    """One for each worker and part; that of another lexicon goes."""
    if key not in _BUILT:
        import ahocorasick

        own = ahocorasick.Automaton()
        for v in values:
            own.add_word(v, v)
        own.make_automaton()
        _BUILT.clear()
        _BUILT[key] = own
    return _BUILT[key]


def folded(text: str) -> str:
    """Lower case, but for characters whose lower case has another length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def parts_of(lexicon: DataFrame, most_chars: int) -> list[DataFrame]:
    """Distinct values in parts of some most_chars characters each; null and empty values go."""
    values = lexicon.select(lexicon["value"].cast("string").alias("value")).where("value <> ''").distinct()
    chars = values.agg(F.sum(F.length("value"))).first()[0] or 0
    parts = -(-chars // most_chars)
    return [values.where(F.pmod(F.xxhash64("value"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [values] if parts else []


def find(docs: DataFrame, lexicon: DataFrame, any_case: bool = False, most_chars: int = 2_000_000, longest: bool = False) -> DataFrame:
    """Rows (doc_id, start, end, value) of all places of all values, overlapping ones too; with longest only places that lie
    inside no longer one of the document. docs: doc_id, text; lexicon: value. any_case tells of the value in lower case."""
    spark = docs.sparkSession
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    if any_case:
        lexicon = lexicon.select(F.lower("value").alias("value"))
    found = []
    for part in parts_of(lexicon, most_chars):
        values = sorted(r["value"] for r in part.collect())  # most_chars characters or so
        found.append(_scan(plain, spark.sparkContext.broadcast(values), any_case))
    places = functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], PLACES)
    return _outermost(places) if longest else places


def _scan(docs: DataFrame, shared, any_case: bool) -> DataFrame:
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(shared.value, (number, any_case))
        for batch in batches:
            doc_id, start, end, value = [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for last, v in own.iter(folded(text) if any_case else text):
                    doc_id.append(d)
                    start.append(last + 1 - len(v))
                    end.append(last + 1)
                    value.append(v)
                if len(value) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.string())], names=["doc_id", "start", "end", "value"])
                    doc_id, start, end, value = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.string())], names=["doc_id", "start", "end", "value"])

    return docs.mapInArrow(run, PLACES)


def _outermost(places: DataFrame) -> DataFrame:
    """A place lies inside another if one that starts no later, longer first, ends no earlier."""
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return places.distinct().withColumn("_upto", F.max("end").over(before)).where(F.col("_upto").isNull() | (F.col("end") > F.col("_upto"))).drop("_upto")
