"""Synthetic documents: scenarios with plans of mentions, texts composed from parts, model answers as drafts and their checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scrubline.functions.arrays import let, sums
from scrubline.functions.draws import choose, draw
from scrubline.operators.spans import occurrences

# Domains, goals, recipients, labels by what can be said of them, and the shares of draws.
SUPPORT, EMAIL = "support_ticket", "email"
GOALS = {
    SUPPORT: ("request_help", "incident_report", "access_issue", "integration_issue", "billing_mismatch", "permission_review", "data_gap", "sync_delay"),
    EMAIL: ("coordination", "project_followup", "urgent_incident", "context_share", "handover", "vendor_followup", "capacity_alert", "delivery_risk"),
}
INTERNAL = {SUPPORT: ("service_desk", "identity_support", "data_ops"), EMAIL: ("project_team", "ops_manager", "platform_team")}
EXTERNAL = {SUPPORT: ("customer_support", "billing_support", "partner_support"), EMAIL: ("client_success", "vendor_contact")}
EXTERNAL_SHARE = {SUPPORT: 0.40, EMAIL: 0.20}
MODES = ("explicit_easy", "explicit_hard", "implicit")
MIX = {"easy": (0.80, 0.15, 0.05), "medium": (0.45, 0.35, 0.20), "hard": (0.10, 0.45, 0.45)}
DIRECT = ("PERSON_NAME", "EMAIL", "PHONE", "USERNAME", "ACCOUNT_ID")
HARD_CAPABLE = ("PERSON_NAME", "EMAIL", "PHONE", "ACCOUNT_ID", "AGE_RANGE", "TENURE", "DEGREE")
IMPLICIT_CAPABLE = ("AGE_RANGE", "LOCATION", "NATIONALITY", "FAMILY_STATUS")
DIFFICULTY = {"easy": 0.40, "medium": 0.35, "hard": 0.25}
DIRECT_SHARE = {"easy": 0.75, "medium": 0.35, "hard": 0.10}
SENSITIVE_SHARE, IMPLICIT_SENSITIVE, THREAD_SHARE = 0.60, 0.7, 0.35


def _of(key: Column, values: Mapping[str, object]) -> Column:
    """The value of a key, null for others."""
    return F.element_at(F.create_map(*[F.lit(x) if not isinstance(x, (list, tuple)) else F.array(*[F.lit(y) for y in x]) for kv in values.items() for x in kv]), key)


def _pick(at: Column, values: Column) -> Column:
    return F.element_at(values, (F.floor(at * F.size(values)) + 1).cast("int"))


def effective_register(register: Column, address: Column, recipient: Column) -> tuple[Column, Column]:
    """Register and form of address: familiar speech becomes common before outsiders, formal speech always says vous."""
    register, address = F.coalesce(F.nullif(register, F.lit("")), F.lit("courant")), F.coalesce(F.nullif(address, F.lit("")), F.lit("vous"))
    outside = (register == "familier") & recipient.isin(*[r for v in EXTERNAL.values() for r in v])
    return F.when(outside, "courant").otherwise(register), F.when(outside | (register == "soutenu"), "vous").otherwise(address)


def mention_plan(seed: int, index: Column, difficulty: Column, required: Column, implicit: Column, direct: Column, sensitive: Column, cues: Column) -> Column:
    """array<struct<label, mode>>: required labels, style signals, direct identifiers and sensitive labels in this order.

    A mode is drawn by the difficulty's mix among those a label can have: hard where an obfuscated form exists, implicit
    where the author has a cue for it, never for direct identifiers. Sensitive labels with a cue are mostly implicit.
    direct is a boolean; the others are arrays of labels."""
    mix = F.coalesce(_of(difficulty, MIX), F.array(*[F.lit(x) for x in MIX["medium"]]))

    def mode(label: Column, cued: Column) -> Column:
        hard = F.when(label.isin(*HARD_CAPABLE), mix[1]).otherwise(0.0)
        unsaid = F.when(label.isin(*IMPLICIT_CAPABLE) & cued, mix[2]).otherwise(0.0)
        at = draw(seed, "mode", index, label) * (mix[0] + hard + unsaid)
        return F.when(at < mix[0], MODES[0]).when(at < mix[0] + hard, MODES[1]).otherwise(MODES[2])

    entry = lambda label, m: F.struct(label.alias("label"), m.alias("mode"))
    private = lambda label: label.isin(*IMPLICIT_CAPABLE) & F.array_contains(cues, label) & (draw(seed, "sensitive_mode", index, label) < IMPLICIT_SENSITIVE)
    none = F.array().cast("array<string>")
    return F.concat(
        F.transform(required, lambda x: entry(x, mode(x, F.array_contains(cues, x)))),
        F.transform(implicit, lambda x: entry(x, F.lit(MODES[0]))),
        F.transform(F.when(direct, F.array(*[F.lit(d) for d in DIRECT])).otherwise(none), lambda x: entry(x, mode(x, F.lit(False)))),
        F.transform(sensitive, lambda x: entry(x, F.when(private(x), MODES[2]).otherwise(MODES[0]))),
    )


def scenarios(authors: DataFrame, count: int, seed: int = 41) -> DataFrame:
    """So many scenarios, their authors taken in turn. authors: place (gapless from 0), person_id, register, address_form,
    degree, certificate, rare (booleans), sensitive and cues (arrays of labels); nulls count as none. The first 60 % of the
    authors write for training, the next 20 % for development, the rest for tests. Without authors there are no rows."""
    people = authors.count()
    i, none = F.col("index"), F.array().cast("array<string>")
    at = lambda purpose: draw(seed, purpose, i)
    split = F.when(F.col("place") < int(people * 0.60), "train").when(F.col("place") < int(people * 0.80), "dev").otherwise("test")
    rows = authors.sparkSession.range(count).select(F.col("id").alias("index"), (F.col("id") % max(people, 1)).alias("place"))
    rows = rows.join(authors.withColumn("place", F.col("place").cast("bigint")), "place")
    rows = rows.withColumns({
        "domain": F.when(i % 2 == 0, SUPPORT).otherwise(EMAIL),
        "difficulty": choose(at("difficulty"), DIFFICULTY),
        "split": split,
        "sensitive": F.coalesce("sensitive", none),
        "cues": F.coalesce("cues", none),
    })
    rows = rows.withColumns({
        "split": F.when((F.col("split") == "test") & (F.col("difficulty") == "hard"), "test_hard").when(F.col("split") == "test", "test_standard").otherwise(F.col("split")),
        "recipient_role": _pick(at("recipient"), F.when(at("outside") < _of(F.col("domain"), EXTERNAL_SHARE), _of(F.col("domain"), EXTERNAL)).otherwise(_of(F.col("domain"), INTERNAL))),
        "goal": _pick(at("goal"), _of(F.col("domain"), GOALS)),
        "direct": at("direct") < _of(F.col("difficulty"), DIRECT_SHARE),
        "private": (F.size("sensitive") > 0) & (at("private") < SENSITIVE_SHARE),
    })
    hard = F.col("difficulty") == "hard"
    also = lambda test, *labels: F.when(F.coalesce(test, F.lit(False)), F.array(*[F.lit(x) for x in labels])).otherwise(none)
    required = F.concat(also(F.lit(True), "ROLE", "TEAM"), also(F.col("difficulty") != "easy", "AGE_RANGE", "TENURE"), also(hard & F.col("degree"), "DEGREE"), also(hard & F.col("certificate"), "CERTIFICATION"), also(F.col("rare"), "RARE_RESPONSIBILITY"))
    style = F.array(F.when(F.col("domain") == EMAIL, "SIGNATURE_PATTERN").otherwise("JARGON_PATTERN"))
    register, address = effective_register(F.col("register"), F.col("address_form"), F.col("recipient_role"))
    plan = mention_plan(seed, i, F.col("difficulty"), F.col("required_signals"), style, F.col("direct"), F.when(F.col("private"), F.col("sensitive")).otherwise(none), F.col("cues"))
    level = lambda purpose: _pick(at(purpose), F.array(F.lit("low"), F.lit("medium"), F.lit("high")))
    unit = F.when((F.col("domain") == EMAIL) & (at("unit") < THREAD_SHARE), "thread_short").otherwise("single_message")
    return rows.withColumn("required_signals", required).select(
        F.concat(F.lit("scenario_"), F.format_string("%06d", i + 1)).alias("scenario_id"), F.col("person_id").alias("author_id"), "domain", unit.alias("unit_type"), "difficulty", "split", "recipient_role", "goal",
        "required_signals", style.alias("implicit_signals"), plan.alias("mention_plan"), F.col("direct").alias("include_direct"), F.col("private").alias("include_sensitive"), level("urgency").alias("urgency"), level("noise").alias("noise_level"), register.alias("register"), address.alias("address_form"),
    )


def persona(values: Column, fields: Mapping[str, tuple[str, ...]], allowed: Column, always: tuple[str, ...] = ()) -> Column:
    """Of a map of fields to values: those always shown, and those that an allowed label covers and that aren't empty.
    fields: label to names of fields."""
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(n).alias("field")) for k, names in fields.items() for n in names])
    inside = lambda f: F.exists(pairs, lambda x: (x["field"] == f) & F.array_contains(allowed, x["label"]))
    return F.map_filter(values, lambda f, v: f.isin(*always) | (inside(f) & (F.coalesce(v, F.lit("")) != "")))


def compose(parts: Column, plan: Column, forms: Column) -> Column:
    """struct<text, grounding, spans> of ordered parts. parts: array<struct<text, label, canonical_value>>, a null label for plain
    text; plan: array<struct<label, mode>>; forms: array<struct<label, mode, snippet, cue_type>>, other ways to say a label.

    A mention that is planned hard or implicit takes its form; where there is none it stays as it is, and easy. grounding
    numbers equal snippets from 1; spans (start, end, label) are the mentions' places in the text. Empty parts say nothing; the
    text is without white space at its ends."""
    told = F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != "")

    def mention(p: Column, snippet: Column, mode: Column, cue: Column) -> Column:
        return F.struct(p["label"].alias("label"), p["canonical_value"].alias("canonical_value"), snippet.alias("snippet"), mode.alias("difficulty_mode"), cue.alias("cue_type"))

    def said(p: Column) -> Column:
        # Plan and forms are searched once, and for mentions only.
        plain = mention(p, p["text"], F.lit(MODES[0]), F.lit(""))
        planned = F.get(F.filter(plan, lambda e: e["label"] == p["label"]), F.lit(0))["mode"]
        form = lambda mode: F.get(F.filter(forms, lambda f: (f["label"] == p["label"]) & (f["mode"] == mode)), F.lit(0))
        told_as = lambda mode: let(form(mode), lambda f: F.when(f["snippet"].isNotNull(), mention(p, f["snippet"], mode, f["cue_type"])).otherwise(plain))
        return F.when(p["label"].isNull(), plain).otherwise(let(planned, lambda mode: F.when(mode != MODES[0], told_as(mode)).otherwise(plain)))

    def whole(all_: Column) -> Column:
        raw = F.array_join(F.transform(all_, lambda x: x["snippet"]), "")
        number = lambda m: F.transform(m, lambda x, i: F.struct(x["label"].alias("label"), x["canonical_value"].alias("canonical_value"), x["snippet"].alias("snippet"), F.size(F.filter(F.slice(m, 1, i + 1), lambda y: y["snippet"] == x["snippet"])).alias("occurrence_hint"), x["difficulty_mode"].alias("difficulty_mode"), x["cue_type"].alias("cue_type")))

        def placed(t: Column) -> Column:
            # What a place needs of the text is found once, not for each place.
            return let(F.regexp_replace(t, r"^\s+", ""), lambda left: let(F.struct(F.regexp_replace(left, r"\s+$", "").alias("text"), (F.length(t) - F.length(left)).alias("cut")), lambda x: let(x.withField("most", F.length(x["text"])), spanned)))

        def spanned(found: Column) -> Column:
            text = found["text"]
            inside = lambda at: F.least(F.greatest(at - found["cut"], F.lit(0)), found["most"])
            ends = F.zip_with(all_, sums(F.transform(all_, lambda x: F.length(x["snippet"]))), lambda x, end: F.struct(inside(end - F.length(x["snippet"])).alias("start"), inside(end).alias("end"), x["label"].alias("label")))
            return F.struct(text.alias("text"), let(F.filter(all_, lambda x: x["label"].isNotNull()), number).alias("grounding"), F.filter(ends, lambda x: x["label"].isNotNull()).alias("spans"))

        return let(raw, placed)

    return let(F.transform(told, said), whole)


_DRAFT = "text: string, notes: array<string>, grounding: array<struct<label: string, snippet: string, canonical_value: string, occurrence_hint: int, difficulty_mode: string, cue_type: string>>"


def drafts(answers: DataFrame, key: str = "doc_id", response: str = "response") -> DataFrame:
    """One row for each usable draft of a model's answer, a single one or a list under ``variants``: key, variant (from 0),
    text, notes, grounding, error. An answer without any text has one row with an error. Mentions without label or snippet
    go; a missing occurrence follows the last one of the same snippet."""
    read = F.from_json(response, f"struct<{_DRAFT}, variants: array<struct<{_DRAFT}>>>")
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    alone = F.array(F.struct("a.text", "a.notes", "a.grounding"))
    all_ = answers.select(key, read.alias("a")).select(key, F.when(F.col("a.variants").isNotNull(), F.col("a.variants")).otherwise(alone).alias("v"))
    usable = all_.select(key, F.filter("v", lambda d: strip(d["text"]) != "").alias("v"))

    def numbered(found: Column) -> Column:
        empty = F.array().cast("array<struct<label: string, snippet: string, canonical_value: string, occurrence_hint: int, difficulty_mode: string, cue_type: string>>")
        last = lambda acc, x: F.coalesce(F.try_element_at(F.filter(acc, lambda y: y["snippet"] == x["snippet"]), F.lit(-1))["occurrence_hint"], F.lit(0))
        one = lambda acc, x: F.struct(strip(x["label"]).alias("label"), strip(x["snippet"]).alias("snippet"), x["canonical_value"].alias("canonical_value"), F.when(F.coalesce(x["occurrence_hint"], F.lit(0)) != 0, x["occurrence_hint"]).otherwise(last(acc, x) + 1).alias("occurrence_hint"), F.coalesce(F.nullif(x["difficulty_mode"], F.lit("")), F.lit(MODES[0])).alias("difficulty_mode"), F.coalesce(x["cue_type"], F.lit("")).alias("cue_type"))
        stripped = F.transform(F.filter(F.coalesce(found, empty), lambda x: (strip(x["label"]) != "") & (strip(x["snippet"]) != "")), lambda x: x.withField("snippet", strip(x["snippet"])))
        return F.aggregate(stripped, empty, lambda acc, x: F.concat(acc, F.array(one(acc, x))))

    rows = usable.select(key, F.posexplode_outer("v").alias("variant", "d"))
    return rows.select(key, F.coalesce("variant", F.lit(0)).alias("variant"), strip(F.col("d.text")).alias("text"), F.coalesce("d.notes", F.array().cast("array<string>")).alias("notes"), numbered(F.col("d.grounding")).alias("grounding"), F.when(F.col("d").isNull(), "no draft with a text").cast(StringType()).alias("error"))


def draft_issues(text: Column, grounding: Column, planned: Column, own: Column, allowed: Column) -> Column:
    """What is wrong with a draft, as strings: planned snippets that it lacks, mentions without their occurrence, canonical
    values of hard or implicit mentions in the text, implicit ones without a cue, values of the author under labels that are
    neither planned nor allowed. planned: array<struct<label, snippet>>; own: array<struct<label, value>>."""
    name = lambda prefix, c, *rest: F.transform(c, lambda m: F.concat(F.lit(prefix), m["label"], *[F.concat(F.lit(":"), m[r]) for r in rest]))
    has = lambda v: (F.coalesce(v, F.lit("")) != "") & F.contains(text, v)
    place = lambda m: F.try_element_at(occurrences(text, m["snippet"], overlapping=False), m["occurrence_hint"].cast("int"))
    known = F.concat(F.transform(planned, lambda m: m["label"]), allowed)
    return F.concat(
        name("missing_planned_snippet:", F.filter(planned, lambda m: ~has(m["snippet"])), "snippet"),
        name("unresolved_grounding:", F.filter(grounding, lambda m: place(m).isNull()), "snippet"),
        name("difficulty_canonical_leak:", F.filter(grounding, lambda m: m["difficulty_mode"].isin(MODES[1], MODES[2]) & has(m["canonical_value"]))),
        name("implicit_missing_cue_type:", F.filter(grounding, lambda m: (m["difficulty_mode"] == MODES[2]) & (F.coalesce(m["cue_type"], F.lit("")) == ""))),
        F.array_distinct(name("unintended_leak:", F.filter(own, lambda v: ~F.array_contains(known, v["label"]) & has(v["value"])))),
    )
