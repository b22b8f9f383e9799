"""Finding known values in texts: as written, in any case, by kind (names, numbers, dates), in singular or plural.

Each finder is a small function on one text and one value; ``value_spans`` runs their cascade for a column of values in
Arrow-batched pandas UDFs, since patterns come from the rows. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from scrubline.functions.arrays import let
from scrubline.functions.dates import MONTHS

SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("label", StringType()))
NOT_STATED = ("none", "n/a", "")
Ranges = list[tuple[int, int]]


def places(text: str, value: str, any_case: bool = False) -> Ranges:
    """All places of a value, overlapping ones too."""
    if any_case:
        text, value = text.lower(), value.lower()
    out, at = [], text.find(value) if value else -1
    while at >= 0:
        out.append((at, at + len(value)))
        at = text.find(value, at + 1)
    return out


def name_places(text: str, name: str, gap: int = 80) -> Ranges:
    """First and last part of a name with at most gap characters between them; a single part in any case."""
    parts = name.split()
    if len(parts) < 2:
        return places(text, name, True)
    low = text.lower()
    if parts[0].lower() not in low or parts[-1].lower() not in low:
        return []
    first, last = (rf"(?<!\w){re.escape(p)}(?!\w)" for p in (parts[0], parts[-1]))
    return [m.span() for m in re.finditer(rf"{first}.{{0,{gap}}}?{last}", text, re.IGNORECASE)]


_DIGITS = re.compile(r"\d(?:[\s\-]?\d)*")


def number_places(text: str, value: str, least: int = 6) -> Ranges:
    """The digits of a value with one space or dash, or none, between them."""
    digits = re.sub(r"\D", "", value)
    if len(digits) < least or digits not in re.sub(r"[\s\-]", "", text):
        return []
    # Runs of digits with such a sign or none between them, by one pattern for all values: places of the digits are looked up in them.
    out = []
    for run in _DIGITS.finditer(text):
        at = [run.start() + k for k, c in enumerate(run[0]) if c.isdecimal()]
        plain = "".join(text[k] for k in at)
        found = plain.find(digits)
        while found >= 0:
            out.append((at[found], at[found + len(digits) - 1] + 1))
            found = plain.find(digits, found + len(digits))
    return out


_NAMES = "|".join(MONTHS)
_VALUE = re.compile(rf"(?P<d>\d{{1,2}})\s+(?P<m>{_NAMES})\s+(?P<y>\d{{4}})|(?P<m2>{_NAMES})\s+(?P<d2>\d{{1,2}}),?\s+(?P<y2>\d{{4}})", re.IGNORECASE)
_FORMS = [re.compile(f, re.IGNORECASE) for f in (rf"(?<!\w)(?P<m>{_NAMES})\s+(?P<d>\d{{1,2}})\s*,?\s*(?P<y>\d{{4}})(?!\w)", rf"(?<!\w)(?P<d>\d{{1,2}})(?:st|nd|rd|th)?\s+(?P<m>{_NAMES})\s+(?P<y>\d{{4}})(?!\w)")]
_FIGURES = re.compile(r"(?<!\d)(\d{2})/(\d{2})/(\d{4})(?!\d)")


def date_places(text: str, value: str) -> Ranges:
    """A date of day, month name and year, in its two orders, with an ordinal, and in figures."""
    m = _VALUE.match(value.strip())
    if not m:
        return []
    day, month, year = str(int(m["d"] or m["d2"])), (m["m"] or m["m2"]).lower(), m["y"] or m["y2"]
    out = [x.span() for form in _FORMS for x in form.finditer(text) if (x["d"], x["m"].lower(), x["y"]) == (day, month, year)]
    two = {f"{MONTHS.index(month) + 1:02d}", f"{int(day):02d}"}
    return out + [x.span() for x in _FIGURES.finditer(text) if {x[1], x[2]} == two and x[3] == year]


def plural_places(text: str, value: str) -> Ranges:
    """A value of four or more characters, in any case, with or without its ending s or es."""
    v = value.strip().lower()
    if len(v) < 4:
        return []
    forms = {v, v[:-1] if v.endswith("s") else v + "s", *([v[:-2]] if v.endswith("es") else [])}
    return [at for form in sorted(forms) for at in places(text.lower(), form)]


BY_LABEL: dict[str, Callable[[str, str], Ranges]] = {"PERSON": name_places, "CREDIT_CARD": number_places, "SSN": number_places, "PHONE": number_places, "DATE": date_places}


def cascade(text: str, value: str, label: str) -> Ranges:
    """The first finder that finds something: exact, any case, the label's own, plural."""
    v = value.strip()
    if v.lower() in NOT_STATED:
        return []
    return places(text, v) or places(text, v, True) or (BY_LABEL[label](text, v) if label in BY_LABEL else []) or plural_places(text, v)


def _finder(find: Callable[[str, str, str], Ranges]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(SPANS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            out = []
            for text, values in zip(texts, wanted, strict=True):
                found = {(s, e, v["label"]) for v in (values if text is not None and values is not None else []) for s, e in find(text, v["value"] or "", v["label"])}
                out.append([{"start": s, "end": e, "label": k} for s, e, k in sorted(found)])
            yield pd.Series(out)

    return run


value_spans = _finder(cascade)
date_spans = _finder(lambda text, value, _: date_places(text, value))
number_spans = _finder(lambda text, value, _: number_places(text, value))
name_spans = _finder(lambda text, value, _: name_places(text, value))
plural_spans = _finder(lambda text, value, _: plural_places(text, value))


def described(value: Column) -> Column:
    """The part behind DESCRIPTION and its sign of a coded value, without closing brackets; other values as they are."""
    tail = F.regexp_replace(F.trim(F.substring(value, F.locate("DESCRIPTION", value) + 13, F.length(value))), r"\)+$", "")
    return F.when(F.contains(value, F.lit("DESCRIPTION")), tail).otherwise(value)


def profile_values(direct: Column, indirect: Column) -> Column:
    """array<struct<label, value>> of a profile's attributes (two maps), for value_spans."""
    from scrubline.functions.labels import DIRECT_ATTRIBUTES, INDIRECT_ATTRIBUTES, lookup

    stated = lambda e: ~F.lower(F.trim(e["value"])).isin(*NOT_STATED)
    entries = lambda c: F.filter(F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.coalesce(stated(e), F.lit(False)))
    named = lambda e, table: F.coalesce(lookup(table, e["key"]), F.lit("SENSITIVE"))
    job = lambda e: e["key"].isin("occupation", "OCCP") & F.contains(e["value"], F.lit("DESCRIPTION"))
    first = F.transform(entries(direct), lambda e: F.struct(named(e, DIRECT_ATTRIBUTES).alias("label"), F.trim(e["value"]).alias("value")))
    second = F.transform(entries(indirect), lambda e: F.struct(F.when(job(e), "OCCUPATION").otherwise(named(e, INDIRECT_ATTRIBUTES)).alias("label"), F.when(job(e), described(e["value"])).otherwise(F.trim(e["value"])).alias("value")))
    return F.concat(first, second)


def repaired(text: Column, notes: Column) -> Column:
    """Annotations (start, end, type, text) whose offsets don't hold their text move to its nearest place, exact before any
    case; those without a text keep their offsets, and impossible ones go. Distinct and ordered: array<start, end, label>."""
    from scrubline.operators.spans import occurrences

    def one(a: Column) -> Column:
        given = a["text"].isNotNull() & (a["text"] != "")
        holds = (a["start"] >= 0) & (a["start"] <= a["end"]) & (a["end"] <= F.length(text)) & (F.substring(text, a["start"] + 1, a["end"] - a["start"]) == a["text"])
        nearest = lambda found: F.when(F.size(found) > 0, F.when(a["start"].isNull(), F.get(found, F.lit(0))).otherwise(F.array_min(F.transform(found, lambda s: F.struct(F.abs(s - a["start"]).alias("far"), s.alias("s"))))["s"]))
        # Places are searched once, and in any case only where there is no exact one.
        searched = let(occurrences(text, a["text"]), lambda exact: F.when(F.size(exact) > 0, nearest(exact)).otherwise(let(occurrences(text, a["text"], fold=True), nearest)))
        moved = F.when(given & ~F.coalesce(holds, F.lit(False)), searched)
        return let(moved, lambda start: F.struct(F.coalesce(start, a["start"]).alias("start"), F.coalesce(start + F.length(a["text"]), a["end"]).alias("end"), F.coalesce(a["type"], F.lit("SENSITIVE")).alias("label")))

    ok = lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)), F.lit(False))
    return F.array_sort(F.array_distinct(F.filter(F.transform(notes, one), ok)))


def leaks(masked: Column, direct: Column, indirect: Column) -> Column:
    """array<struct<attribute, category, leaked>>: whether a profile's values stand in a masked text, in any case. Of a name
    also one part of three or more characters counts; indirect values below three characters aren't looked for."""
    low = F.lower(masked)
    entries = lambda c: F.filter(F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~F.lower(F.trim(F.coalesce(e["value"], F.lit("")))).isin(*NOT_STATED))
    there = lambda v: F.contains(low, F.lower(v))
    parts = lambda v: F.exists(F.filter(F.split(v, r"\s+"), lambda p: F.length(p) > 2), there)
    told = lambda e, kind, hit: F.struct(e["key"].alias("attribute"), F.lit(kind).alias("category"), hit.alias("leaked"))
    one = F.transform(entries(direct), lambda e: told(e, "direct", there(F.trim(e["value"])) | ((e["key"] == "name") & parts(F.trim(e["value"])))))
    two = F.transform(F.filter(entries(indirect), lambda e: F.length(described(F.trim(e["value"]))) >= 3), lambda e: told(e, "indirect", there(described(F.trim(e["value"])))))
    return F.concat(one, two)


def leak_rates(found: Column) -> Column:
    """struct of shares of leaked attributes, in all and by category, rounded to 4, and counts."""
    n = lambda test: F.size(F.filter(found, test))
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    of = lambda kind: rate(n(lambda x: (x["category"] == kind) & x["leaked"]), n(lambda x: x["category"] == kind))
    return F.struct(rate(n(lambda x: x["leaked"]), F.size(found)).alias("leak_rate"), of("direct").alias("direct_leak_rate"), of("indirect").alias("indirect_leak_rate"), F.size(found).alias("n_attributes"), n(lambda x: x["leaked"]).alias("n_leaked"))
