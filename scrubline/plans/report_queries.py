"""De-identification profiles, annotations and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.functions import labels
from scrubline.functions.patterns import BY_NAME
from scrubline.operators import annotation, deidentify, reports, spans
from scrubline.plans import span_queries as sq
from scrubline.plans.registry import query


def _spanned(t):
    named = F.transform(spans.as_spans(spans.found(F.coalesce("text", F.lit("")), [BY_NAME["email_strict"], BY_NAME["phone_us"]])), lambda s: s.withField("label", labels.normalise(s["label"])))
    return t("documents").select("doc_id", "text", named.alias("spans")).withColumn("spans", spans.resolve(spans.ordered(F.col("spans"))))


_MASK = sq._MASKED_SQL
_LOSS = "round(least(1.0, abs(length(text) - length(masked)) / greatest(1, length(text))), 4)"


def _swap(mail: str, phone: str) -> str:
    return _MASK.replace("[EMAIL]", mail).replace("[PHONE]", phone)


@query(f"SELECT doc_id, masked AS masking, g.masked_g AS generalization FROM ({_swap('<EMAIL>', '<PHONE>')}) JOIN (SELECT doc_id, masked AS masked_g FROM ({_swap('une adresse email interne', 'un numero professionnel')})) g USING (doc_id)")
def baselines(t):
    return _spanned(t).select("doc_id", *[deidentify.baseline(F.col("text"), F.col("spans"), s).alias(s) for s in ("masking", "generalization")])


@query(f"""SELECT doc_id, 'batch_redact' AS strategy, masked AS anonymized_text, array_to_string(list_filter([CASE WHEN contains(masked, '[PHONE]') THEN 'batch:generalize:PHONE' END, CASE WHEN contains(masked, '[EMAIL_REDACTED]') THEN 'batch:redact:EMAIL' END], lambda x: x IS NOT NULL), ',') AS actions, {_LOSS} AS utility_loss FROM ({_swap('[EMAIL_REDACTED]', '[PHONE]')})""")
def batch_profile(t):
    d = deidentify.run_profile(_spanned(t), "redact", {"phone": "generalize"})
    return d.select("doc_id", "strategy", "anonymized_text", F.array_join("actions_performed", ",").alias("actions"), "utility_loss")


@query("""SELECT o_custkey AS doc_id, greatest(0, least(100, max(s)))::INT AS privacy_score, array_to_string(list(a ORDER BY o_orderkey), ' | ') AS assessment, count(DISTINCT o_orderpriority) AS n_leaked FROM (SELECT *, (o_orderkey % 300 - 100)::INT AS s, 'seen ' || o_orderkey AS a FROM orders) GROUP BY 1""")
def audit_scores(t):
    answers = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk"), (F.col("o_orderkey") % 300 - 100).cast("int").alias("score"), F.array(F.struct(F.lit("t").alias("type"), F.col("o_orderpriority").alias("evidence"))).alias("leaked"), F.concat(F.lit(" seen "), F.col("o_orderkey").cast("string")).alias("assessment"))
    d = deidentify.audited(answers)
    return d.select("doc_id", "privacy_score", "assessment", F.size("leaked").cast("bigint").alias("n_leaked"))


@query("""SELECT c_custkey, v.form FROM customer, LATERAL (VALUES ('USERNAME', c_name), ('USERNAME', 'login ' || c_name), ('PROJECT_NAME_STRONG', 'p_' || c_custkey), ('PROJECT_NAME_STRONG', 'p ' || c_custkey), ('AGE_RANGE', 'tranche d''age 30-34'), ('AGE_RANGE', 'j''ai entre 30 et 34 ans'), ('TENURE', '1 an'), ('TENURE', 'je suis en poste depuis 1 an'), ('TENURE', '7 ans'), ('TENURE', 'je suis en poste depuis 7 ans'), ('ROLE', 'lead')) v(label, form)""")
def surface_variants(t):
    of = lambda label, value: annotation.variants(F.lit(label), value)
    forms = F.concat(of("USERNAME", F.col("c_name")), of("PROJECT_NAME_STRONG", F.concat(F.lit("p_"), F.col("c_custkey").cast("string"))), of("AGE_RANGE", F.lit("tranche d'age 30-34")), of("TENURE", F.lit("1 an")), of("TENURE", F.lit("7 ans")), of("ROLE", F.lit("lead")))
    return t("customer").select("c_custkey", F.explode(forms).alias("form"))


def _described(t):
    """Suppliers with a text and what it is known to mention; every other one by signals instead of places."""
    name = F.col("s_name")
    text = F.concat(name, F.lit(" of Team Red met Team Red as lead: "), F.concat(F.lit("login "), name))
    mention = "array<struct<label:string,snippet:string,occurrence_hint:int>>"
    value = "array<struct<label:string,value:string>>"
    of = lambda *x: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(x)])
    grounding = F.array(of(F.lit("TEAM"), F.lit("Team Red"), F.lit(1)), of(F.lit("ROLE"), F.lit("lead"), F.lit(1)), of(F.lit("PERSON_NAME"), name, F.lit(2)), of(F.lit("EMAIL"), F.lit("nowhere"), F.lit(1))).cast(mention)
    signals, lexicon = F.array(of(F.lit("USERNAME"), name)).cast(value), F.array(of(F.lit("TEAM"), F.lit("Team Red"))).cast(value)
    planned = F.col("s_suppkey") % 2 == 0
    return t("supplier").select("s_suppkey", text.alias("text"), F.when(planned, grounding).alias("grounding"), signals.alias("signals"), lexicon.alias("lexicon"))


_GOLD = """SELECT s_suppkey, start::INT AS start, "end"::INT AS "end", label, confidence::DOUBLE AS confidence, source FROM (SELECT s_suppkey, length(s_name) AS n FROM supplier) s, LATERAL (VALUES
 (0, n + 4, n + 12, 'TEAM', 1.0, 'gold'), (0, n + 17, n + 25, 'TEAM', 1.0, 'gold'), (0, n + 29, n + 33, 'ROLE', 1.0, 'gold'), (0, n + 41, n + n + 41, 'PERSON_NAME', 1.0, 'gold'),
 (1, n + 4, n + 12, 'TEAM', 0.97, 'gold_lexical'), (1, n + 17, n + 25, 'TEAM', 0.97, 'gold_lexical'), (1, 0, n, 'USERNAME', 1.0, 'gold'), (1, n + 41, n + n + 41, 'USERNAME', 1.0, 'gold'), (1, n + 35, n + n + 41, 'USERNAME', 1.0, 'gold')) v(odd, start, "end", label, confidence, source) WHERE v.odd = s_suppkey % 2"""


@query(_GOLD)
def gold_annotations(t):
    d = _described(t).select("s_suppkey", F.explode(annotation.gold(F.col("text"), F.col("grounding"), F.col("signals"), F.col("lexicon"))).alias("s"))
    return d.select("s_suppkey", "s.start", "s.end", "s.label", "s.confidence", "s.source")


@query(f"""SELECT s_suppkey, start, "end", label, CASE source WHEN 'gold' THEN 0.98 ELSE 0.90 END::DOUBLE AS confidence, 'seed' AS source FROM ({_GOLD}) UNION ALL SELECT s_suppkey, (length(s_name) * 2 + 42)::INT, (length(s_name) * 2 + 53)::INT, 'ACCOUNT_ID', 0.95, 'regex' FROM supplier""")
def predicted_annotations(t):
    d = _described(t).select("s_suppkey", "text", annotation.gold(F.col("text"), F.col("grounding"), F.col("signals"), F.col("lexicon")).alias("g"))
    d = d.select("s_suppkey", F.explode(annotation.predicted(F.concat("text", F.lit(" ACC-12-3456")), F.col("g"))).alias("s"))
    return d.select("s_suppkey", "s.start", "s.end", "s.label", "s.confidence", "s.source")


@query("""SELECT s_suppkey, CASE WHEN odd THEN 0 ELSE 1 END AS n_relations, CASE WHEN odd THEN 'high' ELSE 'medium' END AS direct_risk_level, CASE WHEN odd THEN 'medium' ELSE 'medium' END AS qid_risk_level, CASE WHEN odd THEN 'medium' ELSE 'high' END AS compositional_risk_level, s_suppkey % 3 = 0 AS human_review_required
 FROM (SELECT s_suppkey, s_suppkey % 2 = 1 AS odd FROM supplier)""")
def reviewed_bundle(t):
    found = annotation.gold(F.col("text"), F.col("grounding"), F.col("signals"), F.col("lexicon"))
    d = _described(t).select("s_suppkey", annotation.reviewed(found, F.when(F.col("s_suppkey") % 3 == 0, "hard"), F.lit("email")).alias("r"))
    return d.select("s_suppkey", F.size("r.relations").alias("n_relations"), "r.labels.direct_risk_level", "r.labels.qid_risk_level", "r.labels.compositional_risk_level", "r.labels.human_review_required")


@query("""SELECT s_suppkey, v.issue FROM supplier, LATERAL (VALUES ('missing_surface_label:PHONE'), ('missing_surface:EMAIL'), ('span_boundary:DEPARTMENT'), ('span_overlap:TEAM:AGE_RANGE'), ('difficulty_violation:AGE_RANGE'), ('unintended_leak:NIR')) v(issue)""")
def document_audit(t):
    mention = "array<struct<label:string,snippet:string,occurrence_hint:int,canonical_value:string,difficulty_mode:string,cue_type:string>>"
    of = lambda *x: F.struct(*[F.lit(v) for v in x])
    grounding = F.array(of("TEAM", "Team Red", 1, "Team Red", "explicit_easy", None), of("AGE_RANGE", "Red one", 1, "one", "implicit", None), of("EMAIL", "a@b", 1, "", "explicit_easy", None), of("DEPARTMENT", "par", 1, "", "explicit_easy", None)).cast(mention)
    text = F.concat(F.col("s_name"), F.lit(" Team Red one apart 123"))
    forbidden = F.array(of("NIR", "123"), of("TEAM", "Team"), of("PHONE", "")).cast("array<struct<label:string,value:string>>")
    return t("supplier").select("s_suppkey", F.explode(annotation.audit(text, grounding, F.array(F.lit("TEAM"), F.lit("PHONE")), forbidden)).alias("issue"))


@query("""SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND x.c_custkey < y.c_custkey WHERE (x.c_mktsegment = y.c_mktsegment)::INT + (x.c_custkey % 50 = y.c_custkey % 50)::INT + (x.c_acctbal::INT % 20 = y.c_acctbal::INT % 20)::INT >= 2""")
def uniqueness_conflicts(t):
    p = t("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("world_id"), F.col("c_mktsegment").alias("role"), (F.col("c_custkey") % 50).alias("age"), (F.bround("c_acctbal", 0).cast("int") % 20).alias("tenure"))
    return annotation.uniqueness_conflicts(p, ["role", "age", "tenure"])


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey AS world_id, c_mktsegment AS role, (c_custkey % 50)::VARCHAR AS age, (c_acctbal::INT % 20)::VARCHAR AS tenure FROM customer),
 e AS (SELECT id, world_id, 'role,age' AS fields, role || '|' || age AS v FROM p UNION ALL SELECT id, world_id, 'role,tenure', role || '|' || tenure FROM p UNION ALL SELECT id, world_id, 'age,tenure', age || '|' || tenure FROM p)
 SELECT world_id, fields, id, min(id) OVER w AS first, count(*) OVER w AS people FROM e WINDOW w AS (PARTITION BY world_id, fields, v) QUALIFY count(*) OVER w > 1""")
def conflict_groups(t):
    p = t("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("world_id"), F.col("c_mktsegment").alias("role"), (F.col("c_custkey") % 50).alias("age"), (F.bround("c_acctbal", 0).cast("int") % 20).alias("tenure"))
    return annotation.conflict_groups(p, ["role", "age", "tenure"])


_ERR = "CASE o_orderkey % 7 WHEN 0 THEN 'Timeout: 300 s' WHEN 1 THEN 'bad' WHEN 2 THEN '' END"


@query(f"SELECT CASE WHEN count(*) FILTER (e <> '') = 0 THEN 'ok' ELSE 'partial' END AS status, 12.5::DOUBLE AS elapsed_s, count(*) AS n_documents, round(12.5 / count(*), 4) AS seconds_per_doc, count(*) FILTER (e <> '') AS error_count, round(count(*) FILTER (e <> '') / count(*), 4) AS error_rate, count(*) FILTER (contains(lower(e), 'timeout')) AS timeout_count FROM (SELECT {_ERR} AS e FROM orders)")
def runtime_metrics(t):
    k = F.col("o_orderkey") % 7
    return reports.runtime(t("orders").select(F.when(k == 0, "Timeout: 300 s").when(k == 1, "bad").when(k == 2, "").alias("error")), 12.5)


@query("SELECT event_type AS step_name, count(*) AS n, round(avg(coalesce(user_id, 0)), 1) AS avg_ms, max(coalesce(user_id, 0)) AS max_ms, count(*) FILTER (event_id % 2 = 0) AS n_llm_used, count(*) FILTER (event_id % 3 = 0) AS n_fallback_used, count(*) FILTER (event_id % 5 = 0) AS n_cache_hit, round(avg(event_id % 4), 2) AS avg_retry FROM events GROUP BY 1")
def model_run_statistics(t):
    k = F.col("event_id")
    return reports.model_runs(t("events").select(F.col("event_type").alias("step_name"), F.col("user_id").alias("latency_ms"), (k % 2 == 0).alias("llm_used"), (k % 3 == 0).alias("fallback_used"), (k % 5 == 0).alias("cache_hit"), (k % 4).alias("retry_count")))


@query("SELECT l_orderkey AS doc_id, round(avg(l_quantity) FILTER (l_linenumber % 5 > 0), 3) AS avg_overall, round(max(l_quantity) FILTER (l_linenumber % 5 > 0) - min(l_quantity) FILTER (l_linenumber % 5 > 0), 3) AS judge_range, count(*) FILTER (l_linenumber % 5 > 0) AS judges, count(*) FILTER (l_linenumber % 5 = 0) AS errors FROM lineitem GROUP BY 1")
def realism_judges(t):
    return reports.judged(t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("judge"), F.col("l_quantity").alias("overall"), F.when(F.col("l_linenumber") % 5 == 0, "failed").alias("error")))


@query("SELECT doc_id FROM documents ORDER BY md5('53:' || doc_id), doc_id LIMIT (SELECT floor(count(*) * 0.05)::BIGINT FROM documents)")
def review_sample(t):
    return reports.sampled(t("documents")).select("doc_id")


@query("""WITH a AS (SELECT o_custkey AS doc_id, o_orderkey AS pair_id, 'structured' AS source, o_orderkey % 11 AS best FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'llm', o_orderkey % 7 FROM orders WHERE o_orderkey % 3 = 0),
 p AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (source = 'llm') DESC, pair_id DESC) = 1)
SELECT p.doc_id, p.pair_id, p.source, p.best, coalesce(p.best = CASE WHEN p.pair_id % 2 = 0 THEN p.pair_id % 5 END, false) AS success FROM p""")
def preferred_attack(t):
    o = t("orders")
    one = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pair_id"), (F.col("o_orderkey") % 11).alias("best"))
    two = o.where(F.col("o_orderkey") % 3 == 0).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pair_id"), (F.col("o_orderkey") % 7).alias("best"))
    pairs = o.where(F.col("o_orderkey") % 2 == 0).select(F.col("o_orderkey").alias("pair_id"), (F.col("o_orderkey") % 5).alias("target_person_id"))
    return reports.attack_success(reports.preferred_attacks(reports.attack_sources(one, two)), pairs).select("doc_id", "pair_id", "source", "best", "success")


@query("""SELECT d.doc_id, coalesce('by id ' || CASE WHEN d.doc_id % 2 = 0 THEN d.doc_id END, 'by text ' || max(CASE WHEN x.doc_id % 3 = 0 THEN x.doc_id END)) AS masked FROM documents d LEFT JOIN documents x ON x.text = d.text GROUP BY d.doc_id""")
def text_keyed_join(t):
    d = t("documents")
    ids = d.where(F.col("doc_id") % 2 == 0).select("doc_id", F.lit(None).cast("string").alias("text"), F.concat(F.lit("by id "), F.col("doc_id").cast("string")).alias("masked"), F.col("doc_id").alias("at"))
    texts = d.where(F.col("doc_id") % 3 == 0).select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.concat(F.lit("by text "), F.col("doc_id").cast("string")).alias("masked"), F.col("doc_id").alias("at"))
    return reports.with_texts(d.select("doc_id", "text"), ids.unionByName(texts)).select("doc_id", "masked")


@query("SELECT c_custkey, 'b' AS x, CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE 'a' END AS y, printf('%.1f%%', c_custkey / 7.0 * 100) AS percent, CASE WHEN c_custkey % 2 = 0 THEN 'n/a' ELSE printf('%.4f', c_custkey / 7.0) END AS number FROM customer")
def overlays_and_formats(t):
    k = F.col("c_custkey")
    m = reports.overlay(F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("a")), F.create_map(F.lit("x"), F.lit("b")), F.when(k % 2 == 0, F.create_map(F.lit("y"), F.lit("c"))).otherwise(F.create_map().cast("map<string,string>")))
    return t("customer").select("c_custkey", m["x"].alias("x"), m["y"].alias("y"), reports.shown_value(k / 7.0, True).alias("percent"), reports.shown_value(F.when(k % 2 == 0, F.lit("none")).otherwise((k / 7.0).cast("string"))).alias("number"))


_TAG = """'<span style="background-color: ' || '{0}' || '; border: 1px solid ' || '{1}' || '; border-radius: 3px; padding: 0 2px;" title="{2}: {3}">' || {4} || ' <span style="font-size: 0.7em; font-weight: bold; opacity: 0.7;">{3}</span></span>'"""


@query(f"""SELECT s_suppkey, 'ab ' || {_TAG.format('#d4edda', '#28a745', 'TP', 'PER', 's_name')} || ' ' || {_TAG.format('#f8d7da', '#dc3545', 'FN', 'LOC', "'here'")} || ' and ' || {_TAG.format('#fff3cd', '#ffc107', 'FP', 'ORG', "'now'")} || '.' AS html FROM supplier""")
def rendered_spans(t):
    n = F.length("s_name").cast("int")
    kind = "array<struct<start:int,end:int,label:string>>"
    gold = F.array(F.struct(F.lit(3), n + 3, F.lit("PER")), F.struct(n + 4, n + 8, F.lit("LOC"))).cast(kind)
    pred = F.array(F.struct(F.lit(4), n + 2, F.lit("X")), F.struct(n + 13, n + 16, F.lit("ORG"))).cast(kind)
    text = F.concat(F.lit("ab "), F.col("s_name"), F.lit(" here and now."))
    return t("supplier").select("s_suppkey", reports.rendered(text, reports.span_categories(gold, pred)).alias("html"))


_KEYS = {"documents": ("doc_id",), "labels": ("doc_id",), "lineitem": ("l_orderkey",), "nation": ("n_regionkey",), "region": ()}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, " + (f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(k)} FROM {n}))" if k else "0::BIGINT") + f" AS duplicates FROM {n}" for n, k in _KEYS.items()))
def table_coverage(t):
    from scrubline.operators.experiments import coverage

    return coverage({n: (t(n), k) for n, k in _KEYS.items()})
