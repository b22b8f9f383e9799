"""Readers of record files and benchmark formats as DataFrames.

Benchmarks become (doc_id string, text string, spans array<struct<start,end,label>>): offsets in code points, end
exclusive, ordered by start and end, each range once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from scrubline.operators.matching import profile_values, value_spans

SPANS = "array<struct<start:int,end:int,label:string>>"
SPAN_TYPE = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("label", StringType()))

# Labels of the attributes of personal profiles.
ATTRIBUTE_LABELS = {
    "age": "AGE",
    "sex": "DEMOGRAPHIC",
    "city_country": "LOCATION",
    "birth_city_country": "LOCATION",
    "education": "OCCUPATION",
    "occupation": "OCCUPATION",
    "income": "AMOUNT",
    "income_level": "DEMOGRAPHIC",
    "relationship_status": "DEMOGRAPHIC",
}
NOT_STATED = ("unknown", "none", "n/a")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, mode: str = "FAILFAST") -> DataFrame:
    """One object a line; a missing path gives an empty table; blank lines are skipped. mode as in spark.read.json."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_sample(spark: SparkSession, path: str, schema: StructType | str, limit: int = 25) -> DataFrame:
    """The first objects of a file, without malformed lines."""
    return read_jsonl(spark, path, schema, "DROPMALFORMED").limit(limit)


def numbered_lines(spark: SparkSession, path: str, flag: Column | None = None) -> DataFrame:
    """file, k (from 0 within the file), line, and before: the flag (of line) of the line before, null for a file's first.

    Files are split as Spark likes: lines are numbered within their blocks and the blocks' counts added up, so one large file
    is many tasks. A line belongs to the block that it begins in, whose start is part of the file's metadata."""
    flag = F.lit(False) if flag is None else flag
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    own = W.partitionBy("file", "block").orderBy("at")
    lines = raw.select("*", flag.alias("flag")).withColumns({"k": F.row_number().over(own) - 1, "before": F.lag("flag").over(own)})
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.max_by("flag", "k").alias("last"))  # one row a block
    order = W.partitionBy("file").orderBy("block")
    offsets = blocks.select("file", "block", (F.sum("n").over(order) - F.col("n")).alias("upto"), F.lag("last").over(order).alias("last"))
    return lines.join(offsets, ["file", "block"]).select("file", (F.col("upto") + F.col("k")).alias("k"), "line", F.coalesce("before", "last").alias("before"), "block", "at")


def _ranges(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """All places of a pattern, overlapping ones too."""
    out, at = [], 0
    while (m := pattern.search(text, at)) is not None and m.end() > m.start():
        out.append(m.span())
        at = m.start() + 1
    return out


def occurrences(text: str, value: str, any_case: bool = False) -> list[tuple[int, int]]:
    return _ranges(re.compile(re.escape(value), re.IGNORECASE if any_case else 0), text) if value else []


def _person(text: str, name: str) -> list[tuple[int, int]]:
    """As written, else in any case, else the first and last part with up to 80 characters between them."""
    parts = name.split()
    return occurrences(text, name) or occurrences(text, name, True) or ([m.span() for m in re.finditer(rf"(?<!\w){re.escape(parts[0])}(?!\w).{{0,80}}?(?<!\w){re.escape(parts[-1])}(?!\w)", text, re.IGNORECASE)] if len(parts) > 1 else [])


def _spans(found: Callable[[str, str, str], list[tuple[int, int]]]) -> Callable:
    """A column of spans from the text and an array of (label, value)."""

    @F.pandas_udf(SPAN_TYPE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            out = []
            for text, values in zip(texts, wanted, strict=True):
                own: dict[tuple[int, int], str] = {}
                for v in values if text is not None and values is not None else []:
                    for at in found(text, v["value"], v["label"]):
                        own.setdefault(at, v["label"])
                out.append([{"start": s, "end": e, "label": k} for (s, e), k in sorted(own.items())])
            yield pd.Series(out)

    return run


exact_spans = _spans(lambda text, value, _: occurrences(text, value))
person_spans = _spans(lambda text, value, _: _person(text, value))
profile_spans = _spans(lambda text, value, _: occurrences(text, value, True))


def _named(values, label):
    return F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))


def _docs(df: DataFrame, doc_id, text, spans, limit: int | None) -> DataFrame:
    out = df.select(doc_id.cast("string").alias("doc_id"), text.alias("text"), spans.alias("spans"))
    return out if limit is None else out.limit(limit)


def load_masked_entities(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """doc_id, text, meta.masked_entities: each value marks all its places as SENSITIVE. Malformed lines raise."""
    df = read_jsonl(spark, path, "doc_id string, text string, meta struct<masked_entities:array<string>>")
    text = F.coalesce("text", F.lit(""))
    return _docs(df, F.col("doc_id"), text, exact_spans(text, _named(F.col("meta.masked_entities"), "SENSITIVE")), limit)


def load_biographies(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """wiki_name, people (a name or a list of names), text: the people's places as PERSON; wiki_name where none is given."""
    df = read_jsonl(spark, path, "text string, people string, wiki_name string")
    listed = F.from_json("people", "array<string>")
    given = F.when(F.col("people").startswith("["), F.filter(listed, lambda v: F.trim(v) != "")).when(F.col("people").isNotNull(), F.array(F.trim("people")))
    names = F.when(F.size(given) > 0, given).otherwise(F.array(F.replace(F.coalesce("wiki_name", F.lit("")), F.lit("_"), F.lit(" "))))
    names = F.filter(names, lambda v: F.trim(v) != "")
    text = F.coalesce("text", F.lit(""))
    return _docs(df, F.coalesce("wiki_name", "people"), text, person_spans(text, _named(names, "PERSON")), limit)


def load_profiles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """response and personality (a map of attributes): doc_id is personalreddit_<line>; malformed and empty rows are left out.

    Lines are numbered from 0 within the file."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    df = lines.withColumn("r", F.from_json("line", "response string, personality map<string,string>")).where("r.response <> ''")
    label = F.create_map(*[F.lit(x) for kv in ATTRIBUTE_LABELS.items() for x in kv])
    stated = F.filter(F.map_entries("r.personality"), lambda e: (F.trim(e["value"]) != "") & ~F.lower(F.trim(e["value"])).isin(*NOT_STATED))
    values = F.transform(stated, lambda e: F.struct(F.coalesce(F.try_element_at(label, e["key"]), F.lit("SENSITIVE_ATTR")).alias("label"), F.trim(e["value"]).alias("value")))
    return _docs(df, F.concat(F.lit("personalreddit_"), "k"), F.col("r.response"), profile_spans(F.col("r.response"), values), limit)


def load_examples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON object whose key examples lists texts with annotations."""
    kind = "examples array<struct<id:string,original_text:string,annotations:array<struct<type:string,start:int,end:int>>>>"
    df = spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("examples").alias("e"))
    spans = F.array_sort(F.array_distinct(F.transform("e.annotations", lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["type"].alias("label")))))
    return _docs(df, F.col("e.id"), F.col("e.original_text"), F.coalesce(spans, F.array().cast(SPANS)), limit)


def load_levelled_profiles(spark: SparkSession, path: str, level: int | None = None, limit: int | None = None) -> DataFrame:
    """A JSON array of profiles: those of a difficulty, the first limit of them, then without blank texts. spans are the places
    of the profile's stated values, direct and indirect, found by the cascade of ``matching``."""
    df = spark.read.schema("id int, difficulty int, scenario string, text string, features array<string>, direct_identifiers map<string,string>, indirect_identifiers map<string,string>").option("multiLine", True).json(path)
    df = df if level is None else df.where(F.col("difficulty") == level)
    df = df if limit is None else df.limit(limit)
    found = value_spans(F.col("text"), profile_values(F.col("direct_identifiers"), F.col("indirect_identifiers")))
    return df.where(F.trim("text") != "").withColumns({"doc_id": F.concat(F.lit("ratbench_"), "id", F.lit("_L"), "difficulty"), "spans": found})


def load_columns(spark: SparkSession, path: str, tag_column: int = 3, limit: int | None = None) -> DataFrame:
    """Token columns with BIO tags; a blank line or -DOCSTART- ends a sentence. Rows: doc_id (number of the sentence in its file),
    text (tokens joined by a space), spans. A line with too few columns raises.

    A sentence begins at a token's line behind an end; the beginnings of a file's lines are counted block by block and the
    blocks' counts added up, so one large file is many tasks."""
    parts = F.when(F.contains("line", F.lit("\t")), F.split("line", "\t")).otherwise(F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+"))
    ends = F.regexp_like("line", F.lit(r"^\s*$")) | (F.get(parts, F.lit(0)) == "-DOCSTART-")
    lines = numbered_lines(spark, path, ends).withColumn("parts", parts).withColumn("ends", ends)
    begins = ~F.col("ends") & F.coalesce("before", F.lit(True))
    own = W.partitionBy("file", "block")
    counted = lines.withColumn("own", F.sum(begins.cast("int")).over(own.orderBy("k")))
    blocks = lines.groupBy("file", "block").agg(F.sum(begins.cast("int")).alias("n"))  # one row a block
    offsets = blocks.select("file", "block", (F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")).alias("upto"))
    wide = F.when(F.size("parts") > tag_column, F.struct("k", F.col("parts")[0].alias("token"), F.regexp_replace(F.get("parts", F.lit(tag_column)), r"^\s+|\s+$", "").alias("tag")))
    told = F.coalesce(wide, F.raise_error(F.concat(F.lit(f"expected at least {tag_column + 1} columns: "), "line")).cast("struct<k:bigint,token:string,tag:string>"))
    tokens = counted.where(~F.col("ends")).join(offsets, ["file", "block"]).select("file", (F.col("upto") + F.col("own") - 1).alias("sentence"), told.alias("t"))
    rows = tokens.groupBy("file", "sentence").agg(F.array_sort(F.collect_list("t")).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["token"]), " ")
    out = rows.select(F.col("sentence").cast("string").alias("doc_id"), text.alias("text"), _islands(F.transform("t", lambda x: x["token"]), F.transform("t", lambda x: x["tag"])).alias("spans"))
    return out if limit is None else out.orderBy(F.col("doc_id").cast("bigint")).limit(limit)


@F.pandas_udf(SPAN_TYPE)
def _islands(tokens: pd.Series, tags: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b, "label": k} for a, b, k in islands(list(x), list(y))] for x, y in zip(tokens, tags, strict=True)])


def islands(tokens: list[str], tags: list[str]) -> list[tuple[int, int, str]]:
    """B- starts a span, so does I- of another type; O ends it. Offsets in the tokens joined by a space."""
    out: list[list] = []
    at, last = 0, None
    for token, tag in zip(tokens, tags, strict=True):
        kind = tag[2:] if tag[:2] in ("B-", "I-") else None
        if kind and (tag[0] == "B" or kind != last):
            out.append([at, at + len(token), kind])
        elif kind:
            out[-1][1] = at + len(token)
        last, at = kind, at + len(token) + 1
    return [tuple(x) for x in out]


def hydrate(df: DataFrame, schema: StructType) -> DataFrame:
    """Fields of a schema, missing ones null; unknown fields go as JSON to metadata_unknown."""
    have, want = set(df.columns), {f.name for f in schema}
    unknown = [F.col(c) for c in df.columns if c not in want]
    known = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*known, (F.to_json(F.struct(*unknown)) if unknown else F.lit(None).cast("string")).alias("metadata_unknown"))
