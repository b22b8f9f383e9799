"""Detection from end to end: deterministic rules and models' spans merged, reviews and verifications by language models,
sentences and chunks. Everything happens beside the text of a document, in one projection."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions import labels
from scrubline.functions.arrays import let
from scrubline.functions.patterns import NEWS_RULES, RULES, Rule
from scrubline.operators import spans
from scrubline.operators.spans import SPAN

# Words that a full stop belongs to.
ABBREVIATIONS = frozenset(
    "m. mme. mlle. dr. pr. art. n° cf. etc. mr. mrs. ms. prof. no. nos. vol. inc. jr. sr. co. vs. st. e.g. i.e. u.s. u.k. "
    "jan. feb. mar. apr. jun. jul. aug. sep. sept. oct. nov. dec. janv. févr. avr. juil. déc.".split()
)


def deterministic(text: Column, rules: Sequence[Rule] = RULES, news: bool = True, whitelist: Sequence[str] = ()) -> Column:
    """array<SPAN> of all enabled rules and of the heuristics for news, without overlaps."""
    active = [r for r in sorted(rules, key=lambda r: r.priority) if r.enabled]
    whole, grouped = [r for r in active if not r.group], [r for r in active if r.group]
    parts = [spans.as_spans(spans.found(text, whole, whitelist))] if whole else []
    parts += [spans.grouped_spans(grouped)(text)] if grouped else []
    parts += [spans.grouped_spans(NEWS_RULES, "heuristic", 0.92)(text)] if news else []
    return spans.sweep(spans.ordered(F.concat(*parts)))


def merge_model_lists(*lists: Column) -> Column:
    """Spans of several models: valid ones, the first of each start, end and upper-cased label, ordered by start and end."""
    all_ = F.concat(*[F.coalesce(x, F.array().cast(f"array<{SPAN}>")) for x in lists])
    valid = F.transform(F.filter(all_, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (F.coalesce(s["label"], F.lit("")) != "")), lambda s: s.withField("label", F.upper(s["label"])))
    return spans.merged(valid, strategy=None)


Model = Callable[[DataFrame], DataFrame]  # documents -> doc_id, spans


def run_model(docs: DataFrame, models: Mapping[str, Model], name: str) -> DataFrame:
    """docs with ``model_spans`` of the named model; a name that isn't there, or documents it says nothing of, have none."""
    none = F.array().cast(f"array<{SPAN}>")
    if name not in models:
        return docs.withColumn("model_spans", none)
    found = models[name](docs).select("doc_id", F.col("spans").alias("model_spans"))
    return docs.join(found, "doc_id", "left").withColumn("model_spans", F.coalesce("model_spans", none))


def long_enough(s: Column, least: int = 3) -> Column:
    """Length of a model's span: least characters, or two for an acronym."""
    n = s["end"] - s["start"]
    return (n >= least) | ((n >= 2) & F.regexp_like(F.trim(s["value"]), F.lit("^[A-Z]{2,}$")))


def hybrid(rules_found: Column, model_found: Column, profile: str | None = None, least_vote: float = 1.0, least: int = 3) -> Column:
    """Rules' and models' spans with normalised labels, the models' of enough votes and length, merged: exact duplicates go,
    then overlaps by source priority and length."""
    named = lambda c: F.transform(c, lambda s: s.withField("label", labels.normalise(s["label"], profile)))
    model = F.filter(named(model_found), lambda s: (F.coalesce(s["score"], F.lit(0.0)) >= least_vote) & long_enough(s, least))
    return spans.merged(named(rules_found), model)


def verified(entities: Column, decisions: Column, text: Column, offset: Column | int = 0, profile: str | None = None) -> Column:
    """Spans after decisions (id: place in the array, action, new_type, new_text, new_start, new_end; the last for an id
    counts). retype gives a label, extend a longer span if its text stands at the offsets given (from a chunk's offset on)
    or within 50 characters of the span; keep, remove and anything else leave a span as it is."""
    shift = F.lit(offset) if isinstance(offset, int) else offset

    def one(s: Column, i: Column) -> Column:
        d = F.try_element_at(F.filter(decisions, lambda x: x["id"] == i), F.lit(-1))
        action = F.lower(F.trim(F.coalesce(d["action"], F.lit("keep"))))
        new = d["new_text"]
        a, b = d["new_start"] + shift, d["new_end"] + shift
        there = (b <= F.length(text)) & (F.lower(F.substring(text, a + 1, b - a)) == F.lower(new))
        low = F.greatest(F.lit(0), s["start"] - 50)
        region = F.substring(text, low + 1, F.least(F.length(text), s["end"] + 50) - low)
        at = F.coalesce(F.nullif(F.position(new, region), F.lit(0)), F.nullif(F.position(F.lower(new), F.lower(region)), F.lit(0)))
        start = F.when(F.coalesce(there, F.lit(False)), a).otherwise(low + at - 1)
        end = F.when(F.coalesce(there, F.lit(False)), b).otherwise(start + F.length(new))
        longer = s.withField("start", start).withField("end", end).withField("value", F.substring(text, start + 1, end - start)).withField("source", F.lit("llm_verified"))
        retyped = s.withField("label", labels.normalise(d["new_type"], profile)).withField("source", F.lit("llm_verified"))
        return F.when((action == "retype") & (F.coalesce(d["new_type"], F.lit("")) != ""), retyped).when((action == "extend") & (F.length(new) >= 2) & start.isNotNull(), longer).otherwise(s).cast(SPAN)

    return F.transform(entities, one)


# The least likeness of what a model quotes, and the characters of its evidence that are looked for.
LEAST_ALIKE, EVIDENCE = 0.86, 120


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def fuzzy_place(text: str, needle: str, least: float = LEAST_ALIKE, longest: int | None = None) -> tuple[int, int, float] | None:
    """The most alike window about as long as the needle, the shortest and then the first of equals; nothing for short needles,
    and for texts beyond longest characters where that is given.

    How many characters a window shares with the needle, in any order, bounds their likeness. It comes from running counts
    of the needle's characters, for all windows of a length at once, so only windows that can be alike enough are compared."""
    needle = needle.strip()
    n = len(needle)
    if n < 4 or (longest is not None and len(text) > longest):
        return None
    low, wanted = text.lower(), Counter(needle.lower())
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = [(np.append(0, np.cumsum(points == ord(c), dtype=np.int32)), k) for c, k in wanted.items()]
    delta, best, matcher = max(3, min(12, n // 4)), None, SequenceMatcher(None, b=needle.lower())
    for size in range(max(2, n - delta), min(len(points), n + delta) + 1):
        shared = np.zeros(len(points) - size + 1, np.int32)
        for upto, k in counts:
            shared += np.minimum(upto[size:] - upto[:-size], k)
        most = 2.0 * shared / (n + size)
        for start in np.flatnonzero(most >= least).tolist():
            if best and most[start] < best[2]:
                continue
            matcher.set_seq1(low[start : start + size])
            ratio = matcher.ratio()
            if ratio >= least and (best is None or ratio > best[2]):
                best = (start, start + size, ratio)
    return best


def proposed_places(text: str, value: str, evidence: str = "", start: int | None = None, end: int | None = None, evidence_chars: int | None = EVIDENCE) -> list[tuple[int, int, str]]:
    """Where a proposed entity stands: at its offsets (exact, any case, alike), else all places as written, in any case, the
    most alike window, or the first evidence_chars characters of its evidence (None: all of them)."""
    value, evidence = value.strip(), evidence.strip()
    wanted = value or evidence[:evidence_chars].strip()
    if len(wanted) < 2:
        return []
    if start is not None and end is not None and 0 <= start < end <= len(text):
        seen = text[start:end]
        for ok, how in ((seen == wanted, "llm_offsets"), (seen.lower() == wanted.lower(), "llm_offsets_case_insensitive"), (_ratio(seen, wanted) >= LEAST_ALIKE, "llm_offsets_fuzzy")):
            if ok:
                return [(start, end, how)]
    every = lambda needle, flags, how: [(m.start(), m.start() + len(needle), how) for m in re.finditer(re.escape(needle), text, flags)]
    found = every(wanted, 0, "exact") or every(wanted, re.IGNORECASE, "case_insensitive")
    if not found and (best := fuzzy_place(text, wanted)):
        found = [(best[0], best[1], "fuzzy")]
    if not found and evidence and evidence != wanted:
        found = every(evidence[:evidence_chars], re.IGNORECASE, "evidence_context")
    return found


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("label", T.StringType()).add("method", T.StringType())))
def review_spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Spans of an array of proposals (type, text, evidence, start, end) that are found in the text, all their places."""
    for texts, proposals in batches:
        out = []
        for text, wanted in zip(texts, proposals, strict=True):
            rows = []
            for p in wanted if text and wanted is not None else []:
                rows += [{"start": s, "end": e, "label": p["type"], "method": how} for s, e, how in proposed_places(text, p["text"] or "", p["evidence"] or "", *(None if pd.isna(p[k]) else int(p[k]) for k in ("start", "end")))]
            out.append(rows)
        yield pd.Series(out)


_BREAKS = re.compile(r"[.!?]|\n{2,}")
_OPENING = "\"'(['')"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences end after . ! or ? where white space and a capital or an opening quote follow, or the text ends, but not
    after an abbreviation; and before two or more line feeds, which belong to no sentence."""
    out, start, at = [], 0, 0
    while m := _BREAKS.search(text, at):
        i = m.start()
        if text[i] == "\n":
            if start < i:
                out.append((start, i))
            start = at = m.end()
            continue
        at, j = i + 1, i
        while j > start and text[j - 1].isalpha():
            j -= 1
        if text[j : i + 1].lower() in ABBREVIATIONS:
            continue
        end = i + 1
        while end < len(text) and text[end].isspace():
            end += 1
        if end >= len(text) or text[end].isupper() or text[end] in _OPENING:
            out.append((start, end))
            start = at = end
    return [s for s in [*out, (start, len(text))] if s[0] < s[1]]


def _spans_of(f: Callable[[str], list[tuple[int, int]]]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in f(t)] if t else [] for t in texts])

    return run


sentences = _spans_of(sentence_spans)
CHUNK = "struct<text:string,offset:int,separator:string>"


def context_chunks(text: Column, most: int) -> Column:
    """array<struct<text, offset, separator>>: neighbouring sentences packed into chunks of at most ``most`` characters (a
    longer sentence stands alone), with the text between a chunk and the next. Blank texts have none."""
    breaks = spans.matches(text, r"(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ])|(?:\n\s*\n)")
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    edge = F.struct(F.length(text).alias("start"), F.length(text).alias("end"))

    def cut(found: Column) -> Column:
        ends = F.concat(F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))), F.array(edge))
        starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda m: m["end"]))
        parts = F.zip_with(starts, ends, lambda a, e: F.struct(a.alias("start"), e["start"].alias("end")))
        return F.filter(parts, lambda p: F.trim(piece(p["start"], p["end"]), F.lit(" \n\t\r\f\x0b")) != "")

    def packed(parts: Column) -> Column:
        kind = "array<struct<start:int,end:int>>"

        def step(acc: Column, p: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            fits = (last["end"] - last["start"]) + (p["end"] - p["start"]) + 1 <= most
            joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), p["end"].alias("end"))))
            return F.when((F.size(acc) > 0) & fits, joined).otherwise(F.concat(acc, F.array(p))).cast(kind)

        return F.aggregate(parts, F.array().cast(kind), step)

    def shown(chunks: Column) -> Column:
        return F.transform(chunks, lambda c, i: F.struct(piece(c["start"], c["end"]).alias("text"), c["start"].alias("offset"), F.coalesce(piece(c["end"], F.try_element_at(chunks, i + 2)["start"]), F.lit("")).alias("separator")))

    return let(let(breaks, cut), lambda parts: let(packed(parts), shown)).cast(f"array<{CHUNK}>")
