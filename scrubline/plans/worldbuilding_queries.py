"""Draws from measured distributions, people who stay apart, documents from the phrase library, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.operators import catalogues as C
from scrubline.operators import generation as G
from scrubline.operators import templates as T
from scrubline.plans.generation_queries import SCENARIOS_SQL, authors
from scrubline.plans.registry import checkpoints, query


def _dist(t):
    """Nations by their customers, segments by nation, suppliers of a nation as its cues, each as likely."""
    homes = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    near = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return C.measured(homes, "nation", F.col("n_name")).unionByName(C.measured(homes, "segment", F.col("c_mktsegment"), F.col("n_name"))).unionByName(C.measured(near, "cue", F.col("s_name"), F.col("n_name")))


def _drawn_sql(attribute: str, given: str, rows: str) -> str:
    return f"(SELECT r.*, u.v AS {attribute} FROM (SELECT *, ('0x' || substr(md5('61:{attribute}:' || o_orderkey), 1, 8))::BIGINT AS pt FROM {rows}) r LEFT JOIN upto u ON u.a = '{attribute}' AND u.g = {given} AND (pt::HUGEINT * total) // 4294967296 < u.upto AND (pt::HUGEINT * total) // 4294967296 >= u.upto - u.w)"


@query(f"""WITH dist AS (SELECT 'nation' AS a, '' AS g, n_name AS v, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT 'segment', n_name, c_mktsegment, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
  UNION ALL SELECT 'cue', n_name, s_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
upto AS (SELECT *, sum(w) OVER (PARTITION BY a, g ORDER BY substr(md5(v), 1, 2), v) AS upto, sum(w) OVER (PARTITION BY a, g) AS total FROM dist),
one AS {_drawn_sql('nation', "''", '(SELECT o_orderkey FROM orders)')}, two AS {_drawn_sql('segment', 'nation', '(SELECT o_orderkey, nation FROM one)')}, three AS {_drawn_sql('cue', 'nation', '(SELECT o_orderkey, nation, segment FROM two)')}
SELECT o_orderkey, nation, segment, cue FROM three""")
def catalogue_draws(t):
    table, rows, k = _dist(t), t("orders").select("o_orderkey"), F.col("o_orderkey")
    for name, given in (("nation", None), ("segment", F.col("nation")), ("cue", F.col("nation"))):
        rows = C.draw_from(rows, table, name, C.point(61, name, k), given)
    return rows


@query()
def unique_people(t):
    """Twelve people for each supplier, who agree in no two of what the tables of parts and customers say."""
    checkpoints(t("supplier").sparkSession)
    p = t("part")
    table = C.measured(p, "brand", F.col("p_brand")).unionByName(C.measured(p, "kind", F.col("p_type"), F.col("p_brand"))).unionByName(C.measured(p, "size", F.col("p_size"))).unionByName(C.measured(t("customer"), "segment", F.col("c_mktsegment")))
    fields = {"segment": None, "brand": None, "kind": "brand", "size": None}
    return C.people(t("supplier").select(F.col("s_suppkey").alias("world_id")), 12, table, fields, ["segment", "brand", "size"], fixed=("segment",))


# What is said of an author, and the harder forms of it.
_VALUES = {
    "PERSON_NAME": "c_name", "EMAIL": "'c' || c_custkey || '@exemple.fr'", "PHONE": "'01 ' || c_custkey", "USERNAME": "'u' || c_custkey", "ACCOUNT_ID": "'C-' || c_custkey", "ROLE": "'rôle ' || (c_custkey % 17)", "TEAM": "c_mktsegment", "TENURE": "(c_custkey % 23) || ' ans de maison'",
    "AGE_RANGE": "'plus de ' || (20 + c_custkey % 40) || ' ans'", "DEGREE": "'master ' || (c_custkey % 9)", "CERTIFICATION": "'certificat ' || (c_custkey % 7)", "RARE_RESPONSIBILITY": "'la clé ' || c_custkey", "LOCATION": "'ville ' || c_nationkey", "ORG_NAME_STRONG": "'maison ' || c_nationkey",
    "PRODUCT_CONTEXT": "'produit ' || (c_custkey % 11)", "PROJECT_NAME_STRONG": "'projet ' || (c_custkey % 13)", "HEALTH": "'je reprends après un arrêt'", "FAMILY_STATUS": "'j''ai une urgence à la maison'", "JARGON_PATTERN": "'cf. ticket ' || c_custkey", "SIGNATURE_PATTERN": "'-- ' || c_mktsegment", "when": "'depuis hier'",
}
_FORMS = (("PERSON_NAME", "explicit_hard", "'le client n°' || c_custkey", ""), ("EMAIL", "explicit_hard", "'c' || c_custkey || ' arobase exemple point fr'", ""), ("AGE_RANGE", "implicit", "'d''avant le minitel'", "education_era"))
_GRAMMAR = [(d, k, s, n, *T.read_phrase(p)) for d, slots in T.PHRASES.items() for k, (s, ps) in enumerate(slots.items()) for n, p in enumerate(ps)]
_q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_strings = lambda xs: "[" + ", ".join(map(_q, xs)) + "]::VARCHAR[]"
_rows = ",\n".join(f"({_q(d)}, {k}, {sum(map(ord, s))}, {n}, {_strings(needs)}, {_strings(unless)}, [{', '.join('{' + f'txt: {_q(a)}, label: {_q(b)}, field: {_q(c)}' + '}' for a, b, c in parts)}])" for d, k, s, n, needs, unless, parts in _GRAMMAR)
_DOCUMENTS = f"""
WITH sc AS ({SCENARIOS_SQL}), grammar(domain, slot, add_, opt, needs, unless, parts) AS (VALUES {_rows}),
vals AS (SELECT c_custkey AS author_id, name, value FROM (SELECT c_custkey, unnest([{', '.join('{name: ' + _q(k) + ', value: ' + v + '}' for k, v in _VALUES.items())}], recursive := true) FROM customer)),
forms AS (SELECT c_custkey AS author_id, unnest([{', '.join('{label: ' + _q(a) + ', mode: ' + _q(b) + ', snippet: ' + c + ', cue: ' + _q(d) + '}' for a, b, c, d in _FORMS)}], recursive := true) FROM customer WHERE c_nationkey % 2 = 0),
planned AS (SELECT scenario_id, split_part(x, ':', 1) AS label, split_part(x, ':', 2) AS mode FROM (SELECT scenario_id, unnest(string_split(plan, ',')) AS x FROM sc)),
labels AS (SELECT scenario_id, list(label) AS said, bool_or(label = 'PHONE') AS direct, bool_or(label IN ('HEALTH', 'FAMILY_STATUS')) AS private FROM planned GROUP BY scenario_id),
known AS (SELECT sc.scenario_id, name, value FROM sc JOIN labels USING (scenario_id) JOIN vals USING (author_id) WHERE name NOT IN ('PERSON_NAME', 'EMAIL', 'PHONE', 'USERNAME', 'ACCOUNT_ID') OR list_contains(said, name) UNION ALL SELECT scenario_id, 'recipient', recipient_role FROM sc),
flags AS (SELECT sc.*, list_concat(list_concat(['goal=' || goal, 'urgency=' || urgency, 'noise=' || noise_level, 'unit=' || unit_type, 'difficulty=' || difficulty, 'register=' || register, 'address=' || address_form],
  list_concat(CASE WHEN direct THEN ['direct'] ELSE [] END, CASE WHEN private THEN ['private'] ELSE [] END)), list_concat(['plan:' || x FOR x IN said], v)) AS flags,
  list_sum(list_transform(string_split(concat_ws('|', sc.scenario_id, recipient_role, goal, urgency, noise_level), ''), lambda c: unicode(c)))::BIGINT AS seed
  FROM sc JOIN labels USING (scenario_id) JOIN (SELECT scenario_id, list('value:' || name) AS v FROM known GROUP BY scenario_id) USING (scenario_id)),
fits AS (SELECT scenario_id, slot, parts, row_number() OVER (PARTITION BY scenario_id, slot ORDER BY opt) - 1 AS k, count(*) OVER (PARTITION BY scenario_id, slot) AS n, seed + add_ AS pt FROM flags JOIN grammar USING (domain) WHERE len(list_filter(needs, lambda x: NOT list_contains(flags, x))) = 0 AND NOT list_has_any(unless, flags)),
parts AS (SELECT scenario_id, slot, i, parts[i] AS p FROM fits, UNNEST(range(1, len(parts) + 1)) u(i) WHERE k = pt % n),
said AS (SELECT a.scenario_id, slot, i, p.label AS label, value, CASE WHEN p.label IS NOT NULL AND m.mode <> 'explicit_easy' AND f.snippet IS NOT NULL THEN m.mode WHEN p.label IS NOT NULL THEN 'explicit_easy' END AS mode, CASE WHEN p.label IS NOT NULL AND m.mode <> 'explicit_easy' AND f.snippet IS NOT NULL THEN f.snippet ELSE coalesce(p.txt, value) END AS snippet
  FROM parts a JOIN sc USING (scenario_id) LEFT JOIN known n ON n.scenario_id = a.scenario_id AND n.name = coalesce(p.label, p.field) LEFT JOIN planned m ON m.scenario_id = a.scenario_id AND m.label = p.label LEFT JOIN forms f ON f.author_id = sc.author_id AND f.label = p.label AND f.mode = m.mode),
placed AS (SELECT *, sum(length(snippet)) OVER (PARTITION BY scenario_id ORDER BY slot, i)::INT AS upto FROM said)
SELECT scenario_id, regexp_replace(string_agg(snippet, '' ORDER BY slot, i), '\\s+$', '') AS text, coalesce(string_agg(label || ':' || (upto - length(snippet)) || ':' || upto || ':' || mode, ',' ORDER BY slot, i) FILTER (label IS NOT NULL), '') AS mentions FROM placed GROUP BY scenario_id"""


@query(_DOCUMENTS)
def phrase_documents(t):
    """The texts of all scenarios of customers, with the places of what they say of their authors."""
    customers = t("customer")
    values = F.create_map(*[x for k, v in _VALUES.items() for x in (F.lit(k), F.expr(v.replace("''", "\\'")).cast("string"))])
    forms = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("mode"), F.expr(c.replace("''", "\\'")).alias("snippet"), F.lit(d).alias("cue_type")) for a, b, c, d in _FORMS])
    own = customers.select(F.col("c_custkey").alias("author_id"), values.alias("values"), F.filter(forms, lambda f: F.col("c_nationkey") % 2 == 0).alias("forms"))
    scenarios = G.scenarios(authors(t), customers.count() * 10).join(own, "author_id")
    told = T.documents(scenarios, T.library(customers.sparkSession), F.col("values"), F.col("forms"))
    return told.select("scenario_id", "text", F.array_join(F.zip_with("spans", "grounding", lambda s, g: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), g["difficulty_mode"])), ",").alias("mentions"))
