"""Spans of text as rows or arrays: detection, normalisation, deduplication and overlap resolution.

A span is (start, end, label, value, source, score) in code points of the original text, end exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.functions import labels, validators
from scrubline.functions.arrays import let, sums
from scrubline.functions.patterns import FORBIDDEN, RULES, Rule, java

SPAN = "struct<start:int,end:int,label:string,value:string,source:string,score:double>"
SPAN_ARRAY = f"array<{SPAN}>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,value>> of the matches of a JVM pattern, from the pieces between them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(z: Column) -> Column:
        real = F.filter(z, lambda x: x["m"].isNotNull())  # behind the last match is one more piece
        ends = sums(F.transform(real, lambda x: F.length(x["p"]) + F.length(x["m"])))
        return F.zip_with(real, ends, lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("value")))

    found = let(F.arrays_zip(whole.alias("m"), F.split(text, pattern, -1).alias("p")), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def held(text: Column, needs: str) -> Column:
    """Whether a text holds what each match of a rule does: a search for a plain string or a character costs a small part of
    what a rule's pattern does."""
    return F.regexp_like(text, F.lit("(?U)" + needs)) if re.search(r"[\\\[]", needs) else F.contains(text, F.lit(needs))


def found(text: Column, rules: Sequence[Rule], whitelist: Sequence[str] = (), holds: Mapping[str, Column] | None = None) -> Column:
    """array<struct<start,end,label,value,rule,priority>> of the valid matches of rules that report whole matches. holds: what
    held gives for the rules' needs, where it is known."""
    skip = [w.strip().lower() for w in whitelist]
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def searched(r: Rule) -> Column:
        if not r.needs:
            return matches(text, java(r.pattern))
        return F.when(holds[r.needs] if holds else held(text, r.needs), matches(text, java(r.pattern))).otherwise(none)

    def one(r: Rule) -> Column:
        check = r.validator or validators.BY_LABEL.get(r.label)

        def ok(m: Column) -> Column:
            test = ~m["value"].isin(*FORBIDDEN)
            test = test & validators.VALIDATORS[check](m["value"]) if check else test
            return test & ~F.lower(F.trim(m["value"])).isin(*skip) if skip else test

        fixed = {"label": r.label, "value": None, "rule": r.name, "priority": r.priority}
        return F.transform(F.filter(searched(r), ok), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), *[(m["value"] if v is None else F.lit(v)).alias(k) for k, v in fixed.items()]))

    return F.concat(*[one(r) for r in rules])


def as_spans(matched: Column, source: str = "regex", score: float = 1.0) -> Column:
    """array<SPAN> of what found gives."""
    return F.transform(matched, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label"), m["value"].alias("value"), F.lit(source).alias("source"), F.lit(score).alias("score"))).cast(f"array<{SPAN}>")


def rows(docs: DataFrame, spans: Column, *keys: str) -> DataFrame:
    """keys and the fields of each span. An outer explode is not preceded by a filter on the spans, which would find them
    again."""
    return docs.select(*keys, F.explode_outer(spans).alias("s")).where("s is not null").select(*keys, "s.*")


def rule_spans(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (doc_id, start, end, label, value, rule, priority) by JVM expressions; for rules that report whole matches."""
    return rows(docs, found(F.col("text"), rules), "doc_id")


def detect(docs: DataFrame, rules: Sequence[Rule] = RULES, whitelist: Sequence[str] = ()) -> DataFrame:
    """The same rows for all enabled rules. Rules that report a group of a match go through Python's re in Arrow batches,
    and only for texts that have a match; the others stay in the JVM."""
    active = sorted((r for r in rules if r.enabled), key=lambda r: r.priority)
    whole, grouped = [r for r in active if not r.group], [r for r in active if r.group]
    parts = []
    if whole:
        some, holds = _holding(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), whole)
        parts.append(rows(some, found(F.col("text"), whole, whitelist, holds), "doc_id"))
    if grouped:
        parts.append(_grouped(docs, grouped, whitelist))
    return functools.reduce(DataFrame.unionByName, parts)


def _holding(docs: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, dict[str, Column]]:
    """The texts that some rule may match, with what they hold: found once for all rules that need the same."""
    names = {needs: f"_holds_{k}" for k, needs in enumerate(dict.fromkeys(r.needs for r in rules if r.needs))}
    kept = docs.withColumns({c: held(F.col("text"), needs) for needs, c in names.items()})
    if all(r.needs for r in rules):
        kept = kept.where(functools.reduce(Column.__or__, [F.col(c) for c in names.values()]))
    return kept, {needs: F.col(c) for needs, c in names.items()}


def _grouped(docs: DataFrame, rules: Sequence[Rule], whitelist: Sequence[str]) -> DataFrame:
    skip = {w.strip().lower() for w in whitelist}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern)) for r in rules]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r, p in compiled:
                    for m in p.finditer(text or ""):
                        value = m[r.group]
                        if value and value not in FORBIDDEN and value.strip().lower() not in skip:
                            out.append((doc_id, m.start(r.group), m.end(r.group), r.label, value, r.name, r.priority, r.validator or validators.BY_LABEL.get(r.label, "")))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "label", "value", "rule", "priority", "validator"])

    docs, holds = _holding(docs, rules)
    some = functools.reduce(Column.__or__, [holds.get(r.needs, F.lit(True)) & F.regexp_like("text", F.lit(java(r.pattern))) for r in rules])
    rows = docs.where(some).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, start int, end int, label string, value string, rule string, priority int, validator string")
    ok = F.lit(True)
    for name in ("luhn", "iban", "bic", "nir", "ssn", "phone"):
        ok = F.when(F.col("validator") == name, validators.VALIDATORS[name](F.col("value"))).otherwise(ok)
    return rows.where(ok).drop("validator")


def grouped_spans(rules: Sequence[Rule], source: str = "regex", score: float = 1.0) -> Callable[[Column], Column]:
    """array<SPAN> of rules that report a group, on a column of texts: no rows are made, so nothing is joined back.
    Values are trimmed and have two characters at least."""

    @F.pandas_udf(SPAN_ARRAY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(r, re.compile(r.pattern)) for r in rules]
        for texts in batches:
            yield pd.Series([[{"start": m.start(r.group), "end": m.end(r.group), "label": r.label, "value": v, "source": source, "score": score} for r, p in compiled for m in p.finditer(t or "") if len(v := (m[r.group] or "").strip()) > 1 and v not in FORBIDDEN] for t in texts])

    return run


def gather(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document with ``spans``, an array ordered by start, longer first, then higher score and label."""
    full = spans.select(key, F.struct(F.col("start").cast("int"), F.col("end").cast("int"), "label", "value", (F.col("source") if "source" in spans.columns else F.lit("regex")).alias("source"), (F.col("score").cast("double") if "score" in spans.columns else F.lit(1.0)).alias("score")).cast(SPAN).alias("s"))
    return full.groupBy(key).agg(F.collect_list("s").alias("spans")).withColumn("spans", ordered(F.col("spans")))


def ordered(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), (-s["score"]).alias("c"), s["label"].alias("d"), s["value"].alias("e"), s["source"].alias("f"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def sweep(spans: Column) -> Column:
    """Ordered spans without those that begin before the last kept one ends."""
    start = F.array().cast(f"array<{SPAN}>")
    return F.aggregate(spans, start, lambda acc, x: F.when((F.size(acc) == 0) | (x["start"] >= F.element_at(acc, -1)["end"]), F.concat(acc, F.array(x))).otherwise(acc))


def resolve(spans: Column, strategy: str = "priority_longest", priority: dict[str, int] | None = None) -> Column:
    """Ordered spans, each compared with the last kept one only: longest, highest_score, first, priority_longest, priority_score.

    Spans of one label (not of none) are compared without the priority of their sources, which count in lower case; an
    unknown strategy is longest."""
    ranks = priority or labels.SOURCE_PRIORITY
    rank = lambda s: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), F.lower(s["source"])), F.lit(1))
    longer = lambda x, y: (x["end"] - x["start"]) > (y["end"] - y["start"])
    better = lambda x, y: x["score"] > y["score"]

    def replaces(x: Column, y: Column) -> Column:
        if strategy == "first":
            return F.lit(False)
        if strategy == "highest_score":
            return better(x, y)
        if strategy in ("priority_longest", "priority_score"):
            by = longer if strategy == "priority_longest" else better
            same = (F.upper(x["label"]) == F.upper(y["label"])) & (x["label"] != "")
            return F.when(same, by(x, y)).when(rank(x) != rank(y), rank(x) > rank(y)).otherwise(by(x, y))
        return longer(x, y)

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return (
            F.when(x["end"] <= x["start"], acc)
            .when((F.size(acc) == 0) | (x["start"] >= last["end"]), F.concat(acc, F.array(x)))
            .when(replaces(x, last), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x)))
            .otherwise(acc)
        )

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step)


def deduplicated(spans: Column) -> Column:
    """The first span of each start, end and upper-cased label, in the order given."""
    key = lambda s: F.struct(s["start"], s["end"], F.upper(s["label"]))
    return let(F.transform(spans, key), lambda keys: F.filter(spans, lambda s, i: F.array_position(keys, key(s)) == i + 1))


def merged(*lists: Column, strategy: str | None = "priority_longest") -> Column:
    """Lists of spans together: exact duplicates go, then overlaps by a strategy; without one, ordered by start and end."""
    one = deduplicated(F.concat(*[F.coalesce(x, F.array().cast(f"array<{SPAN}>")) for x in lists]))
    if strategy is None:
        return F.transform(F.array_sort(F.transform(one, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")))), lambda k: k["s"])
    return let(ordered(one), lambda spans: resolve(spans, strategy))


def first_of_duplicates(spans: DataFrame, order: str = "priority") -> DataFrame:
    """One row for each (doc_id, start, end, upper-cased label): the first by order, then rule and value."""
    rest = [c for c in ("rule", "value") if c in spans.columns]
    w = W.partitionBy("doc_id", "start", "end", F.upper("label")).orderBy(order, *rest)
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_of_duplicates(spans: DataFrame, order: str = "ord") -> DataFrame:
    """Later rows overwrite earlier ones of the same start, end and label."""
    return spans.groupBy("doc_id", "start", "end", "label").agg(F.max_by(F.struct(*[c for c in spans.columns if c not in ("doc_id", "start", "end", "label")]), order).alias("_s")).select("doc_id", "start", "end", "label", "_s.*")


def vote(spans: DataFrame, weights: dict[str, float], least: float = 1.0, shortest: int = 3) -> DataFrame:
    """Sum of model weights by span; kept with least votes and shortest characters, or two for an acronym."""
    weight = F.coalesce(labels.lookup({k: str(v) for k, v in weights.items()}, F.col("source")).cast("double"), F.lit(1.0))
    total = spans.groupBy("doc_id", "start", "end", F.upper("label").alias("label")).agg(F.sum(weight).alias("score"), F.min("value").alias("value"))
    long = F.length(F.trim("value"))
    return total.where((F.col("score") >= least) & ((long >= shortest) | ((long >= 2) & F.regexp_like("value", F.lit("^[A-Z]{2,}$")))))


def occurrences(text: Column, needle: Column, overlapping: bool = True, fold: bool = False) -> Column:
    """0-based starts of a needle; fold compares lower-cased texts. The text is split once at the needle, or before each of its
    places where they may overlap, and the pieces' lengths added up, so the work grows with the text's length alone."""
    t, n = (F.lower(text), F.lower(needle)) if fold else (text, needle)
    quoted = F.concat(F.lit(r"\Q"), F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    none = F.array().cast("array<int>")

    def apart(pieces: Column) -> Column:
        ends = sums(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p)))
        return F.transform(ends, lambda x, i: x + i * F.length(n))

    def before(pieces: Column) -> Column:
        ends = sums(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p)))
        return F.concat(F.when(F.startswith(t, n), F.array(F.lit(0))).otherwise(none), ends)

    found = let(F.split(t, F.concat(F.lit("(?="), quoted, F.lit(")")), -1), before) if overlapping else let(F.split(t, quoted, -1), apart)
    return F.when(F.contains(t, n) & (F.length(n) > 0), found).when(t.isNotNull() & n.isNotNull(), none)


def resolve_mention(text: Column, snippet: Column, hint: Column) -> Column:
    """Span of the n-th occurrence of a snippet, or null."""
    start = F.try_element_at(occurrences(text, snippet, overlapping=False), hint.cast("int"))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), (start + F.length(snippet)).alias("end")))


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ])|\n\s*\n")


def chunks(spans: Column, most: int = 400) -> Column:
    """Neighbouring (start, end) spans merged while a chunk has at most ``most`` characters."""
    return F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["end"] - F.element_at(acc, -1)["start"] <= most), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), x["end"].alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
