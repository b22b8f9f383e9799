"""Scenarios, composed documents, drafts of models and their checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.operators import generation as G
from scrubline.plans.generator_queries import choose_sql, draw_sql
from scrubline.plans.registry import query, spread

EACH = 10  # scenarios for each author


def _d(purpose: str) -> str:
    return draw_sql(41, purpose, "i")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick_sql(at: str, values: str) -> str:
    return f"list_element({values}, (floor({at} * len({values})) + 1)::INT)"


def _by_domain(values: dict) -> str:
    return f"(CASE WHEN i % 2 = 0 THEN {_list(values[G.SUPPORT])} ELSE {_list(values[G.EMAIL])} END)"


def _mode_sql(label: str, cued: str) -> str:
    w = [f"(CASE difficulty {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v[n]!r}::DOUBLE' for k, v in G.MIX.items())} END)" for n in range(3)]
    hard, unsaid = f"(CASE WHEN {label} IN {tuple(G.HARD_CAPABLE)} THEN {w[1]} ELSE 0 END)", f"(CASE WHEN {label} IN {tuple(G.IMPLICIT_CAPABLE)} AND {cued} THEN {w[2]} ELSE 0 END)"
    at = f"{draw_sql(41, 'mode', 'i', label)} * ({w[0]} + {hard} + {unsaid})"
    return f"{label} || ':' || CASE WHEN {at} < {w[0]} THEN 'explicit_easy' WHEN {at} < {w[0]} + {hard} THEN 'explicit_hard' ELSE 'implicit' END"


_PRIVATE = f"x || ':' || CASE WHEN x IN {tuple(G.IMPLICIT_CAPABLE)} AND list_contains(cues, x) AND {draw_sql(41, 'sensitive_mode', 'i', 'x')} < 0.7::DOUBLE THEN 'implicit' ELSE 'explicit_easy' END"
SCENARIOS_SQL = f"""
WITH a AS (SELECT c_custkey AS place, c_custkey AS person_id, c_mktsegment AS s, c_nationkey % 2 = 0 AS degree, c_nationkey % 3 = 0 AS cert, c_nationkey % 5 = 0 AS rare, CASE WHEN c_nationkey % 2 = 1 THEN ['FAMILY_STATUS', 'HEALTH'] ELSE [] END AS sensitive, ['AGE_RANGE', 'FAMILY_STATUS'] AS cues, count(*) OVER () AS n FROM customer),
r AS (SELECT i, a.*, CASE WHEN i % 2 = 0 THEN '{G.SUPPORT}' ELSE '{G.EMAIL}' END AS domain, {choose_sql(_d('difficulty'), G.DIFFICULTY)} AS difficulty,
  CASE WHEN place < floor(n * 0.6::DOUBLE) THEN 'train' WHEN place < floor(n * 0.8::DOUBLE) THEN 'dev' ELSE 'test' END AS part,
  CASE s WHEN 'BUILDING' THEN 'familier' WHEN 'MACHINERY' THEN 'soutenu' ELSE 'courant' END AS own, CASE WHEN s IN ('BUILDING', 'MACHINERY') THEN 'tu' ELSE '' END AS form
  FROM range((SELECT {EACH} * count(*) FROM customer)) t(i), (SELECT count(*) AS c FROM customer), a WHERE place = i % c),
u AS (SELECT *, CASE WHEN {_d('outside')} < CASE WHEN i % 2 = 0 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END THEN {_pick_sql(_d('recipient'), _by_domain(G.EXTERNAL))} ELSE {_pick_sql(_d('recipient'), _by_domain(G.INTERNAL))} END AS recipient_role,
  {_d('direct')} < CASE difficulty WHEN 'easy' THEN 0.75::DOUBLE WHEN 'medium' THEN 0.35::DOUBLE ELSE 0.1::DOUBLE END AS direct, len(sensitive) > 0 AND {_d('private')} < 0.6::DOUBLE AS private,
  list_concat(['ROLE', 'TEAM'], list_concat(CASE WHEN difficulty <> 'easy' THEN ['AGE_RANGE', 'TENURE'] ELSE [] END, list_concat(CASE WHEN difficulty = 'hard' AND degree THEN ['DEGREE'] ELSE [] END, list_concat(CASE WHEN difficulty = 'hard' AND cert THEN ['CERTIFICATION'] ELSE [] END, CASE WHEN rare THEN ['RARE_RESPONSIBILITY'] ELSE [] END)))) AS required FROM r),
v AS (SELECT *, own = 'familier' AND recipient_role IN {tuple(x for y in G.EXTERNAL.values() for x in y)} AS outside FROM u)
SELECT format('scenario_{{:06d}}', i + 1) AS scenario_id, person_id AS author_id, domain, CASE WHEN domain = 'email' AND {_d('unit')} < 0.35::DOUBLE THEN 'thread_short' ELSE 'single_message' END AS unit_type, difficulty,
  CASE WHEN part <> 'test' THEN part WHEN difficulty = 'hard' THEN 'test_hard' ELSE 'test_standard' END AS split, recipient_role, {_pick_sql(_d('goal'), _by_domain(G.GOALS))} AS goal,
  array_to_string(list_concat([{_mode_sql('x', 'list_contains(cues, x)')} FOR x IN required], list_concat([CASE WHEN domain = 'email' THEN 'SIGNATURE_PATTERN' ELSE 'JARGON_PATTERN' END || ':explicit_easy'],
    list_concat([{_mode_sql('x', 'false')} FOR x IN CASE WHEN direct THEN {_list(G.DIRECT)} ELSE [] END], [{_PRIVATE} FOR x IN CASE WHEN private THEN sensitive ELSE [] END]))), ',') AS plan,
  {_pick_sql(_d('urgency'), "['low', 'medium', 'high']")} AS urgency, {_pick_sql(_d('noise'), "['low', 'medium', 'high']")} AS noise_level,
  CASE WHEN outside THEN 'courant' ELSE own END AS register, CASE WHEN outside OR own = 'soutenu' OR form = '' THEN 'vous' ELSE form END AS address_form FROM v"""


def authors(t):
    """Customers as authors, their nations and segments saying what they are like."""
    nation, segment, none = F.col("c_nationkey"), F.col("c_mktsegment"), F.array().cast("array<string>")
    labels = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return t("customer").select(
        F.col("c_custkey").alias("place"), F.col("c_custkey").alias("person_id"), F.when(segment == "BUILDING", "familier").when(segment == "MACHINERY", "soutenu").otherwise("courant").alias("register"), F.when(segment.isin("BUILDING", "MACHINERY"), "tu").otherwise("").alias("address_form"),
        (nation % 2 == 0).alias("degree"), (nation % 3 == 0).alias("certificate"), (nation % 5 == 0).alias("rare"), F.when(nation % 2 == 1, labels("FAMILY_STATUS", "HEALTH")).otherwise(none).alias("sensitive"), labels("AGE_RANGE", "FAMILY_STATUS").alias("cues"),
    )


@query(SCENARIOS_SQL)
def generate_scenarios(t):
    rows = G.scenarios(authors(t), EACH * t("customer").count())
    return rows.select("scenario_id", "author_id", "domain", "unit_type", "difficulty", "split", "recipient_role", "goal", F.array_join(F.transform("mention_plan", lambda m: F.concat_ws(":", m["label"], m["mode"])), ",").alias("plan"), "urgency", "noise_level", "register", "address_form")


def _composed(t):
    """Short documents of customers: the segment twice, the name hidden for those of even nations, who have a form for it."""
    part = lambda text, label=None, canonical=None: F.struct(F.lit(text).alias("text") if isinstance(text, str) else text.alias("text"), F.lit(label).cast("string").alias("label"), (F.lit(None) if canonical is None else canonical).cast("string").alias("canonical_value"))
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    parts = F.array(part(" Bonjour, "), part(name, "PERSON_NAME", name), part(" du service "), part(segment, "TEAM", segment), part(""), part(", encore "), part(segment, "TEAM", segment), part(".\n"))
    plan = F.array(F.struct(F.lit("PERSON_NAME").alias("label"), F.lit("explicit_hard").alias("mode")), F.struct(F.lit("TEAM").alias("label"), F.lit("implicit").alias("mode")))
    form = F.struct(F.lit("PERSON_NAME").alias("label"), F.lit("explicit_hard").alias("mode"), F.concat(F.lit("client n°"), F.col("c_custkey").cast("string")).alias("snippet"), F.lit("").alias("cue_type"))
    forms = F.filter(F.array(form), lambda f: F.col("c_nationkey") % 2 == 0)
    return spread(t("customer")).withColumn("d", G.compose(parts, plan, forms))


_SHOWN = "CASE WHEN c_nationkey % 2 = 0 THEN 'client n°' || c_custkey ELSE c_name END"
_TEXT = f"'Bonjour, ' || {_SHOWN} || ' du service ' || c_mktsegment || ', encore ' || c_mktsegment || '.'"


@query(f"SELECT c_custkey, {_TEXT} AS text, {_SHOWN} || '#1:' || CASE WHEN c_nationkey % 2 = 0 THEN 'explicit_hard' ELSE 'explicit_easy' END || ',' || c_mktsegment || '#1:explicit_easy,' || c_mktsegment || '#2:explicit_easy' AS mentions FROM customer")
def compose_documents(t):
    said = F.transform("d.grounding", lambda m: F.concat(m["snippet"], F.lit("#"), m["occurrence_hint"].cast("string"), F.lit(":"), m["difficulty_mode"]))
    return _composed(t).select("c_custkey", "d.text", F.array_join(said, ",").alias("mentions"))


@query(f"""SELECT c_custkey, array_to_string(list_concat(['missing_planned_snippet:ROLE:chef'], list_concat(CASE WHEN c_nationkey % 2 = 0 AND contains({_TEXT}, c_name) THEN ['difficulty_canonical_leak:PERSON_NAME'] ELSE [] END, CASE WHEN contains({_TEXT}, c_custkey::VARCHAR) THEN ['unintended_leak:ACCOUNT_ID'] ELSE [] END)), ';') AS issues FROM customer""")
def draft_issues(t):
    planned = F.array(F.struct(F.lit("ROLE").alias("label"), F.lit("chef").alias("snippet")), F.struct(F.lit("TEAM").alias("label"), F.col("c_mktsegment").alias("snippet")))
    own = F.array(F.struct(F.lit("ACCOUNT_ID").alias("label"), F.col("c_custkey").cast("string").alias("value")), F.struct(F.lit("TEAM").alias("label"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("PERSON_NAME").alias("label"), F.col("c_name").alias("value")))
    allowed = F.array(F.lit("PERSON_NAME"))
    return _composed(t).select("c_custkey", F.array_join(G.draft_issues(F.col("d.text"), F.col("d.grounding"), planned, own, allowed), ";").alias("issues"))


_BARE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"""SELECT doc_id, v::INT AS variant, CASE v WHEN 0 THEN {_BARE} ELSE lang END AS text, 0::BIGINT AS mentions, NULL::VARCHAR AS error FROM documents, (VALUES (0), (1)) t(v)
  WHERE {_BARE} <> '' AND coalesce(lang, '') <> ''""")
def model_drafts(t):
    d = t("documents")
    one = lambda c: F.struct(c.alias("text"))
    answers = d.where((F.regexp_replace("text", r"^\s+|\s+$", "") != "") & (F.coalesce("lang", F.lit("")) != "")).select("doc_id", F.to_json(F.struct(F.array(one(F.col("text")), one(F.lit(" ")), one(F.col("lang"))).alias("variants"))).alias("response"))
    return G.drafts(answers).select("doc_id", "variant", "text", F.size("grounding").cast("bigint").alias("mentions"), "error")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'name=' || c_name || ';' ELSE '' END || 'segment=' || c_mktsegment AS persona FROM customer")
def persona_fields(t):
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("phone"), F.col("c_acctbal").cast("string"), F.lit("segment"), F.col("c_mktsegment"), F.lit("none"), F.lit(""))
    allowed = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("PERSON_NAME"), F.lit("NONE"))).otherwise(F.array(F.lit("NONE")))
    shown = G.persona(values, {"PERSON_NAME": ("name",), "PHONE": ("phone",), "NONE": ("none",)}, allowed, always=("segment",))
    return t("customer").select("c_custkey", F.array_join(F.transform(F.map_entries(shown), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("persona"))
