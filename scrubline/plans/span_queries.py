"""Span detection, masking and agreement on the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.functions import labels
from scrubline.functions.patterns import BY_NAME, Rule
from scrubline.operators import masking, metrics, spans
from scrubline.plans.registry import query

# The rules that the tables hold matches of, and rougher ones to compare with.
NAMES = ("email_strict", "ipv4", "phone_us", "credit_card")
TRUE_RULES = [BY_NAME[n] for n in NAMES]
ROUGH_RULES = [
    Rule("mail_rough", "MAIL", 1, r"[a-zA-Z0-9._]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,3}"),
    Rule("ip_rough", "IP", 1, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    Rule("number_rough", "TICKET", 1, r"[0-9]{3}-[0-9]{4}"),
    Rule("card_rough", "ID", 1, r"[0-9]{13,16}"),
]

# The same patterns without lookaround, and what must not stand before or after a match instead.
_SQL = {
    "email_strict": (r"[a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}", r"[\w@\x{80}-\x{10FFFF}]", None, "MAIL", 3),
    "ipv4": (r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "[0-9]", "[0-9]", "IP", 2),
    "phone_us": (r"\([0-9]{3}\)\s?[0-9]{3}[-\s.][0-9]{4}\b", "[0-9]", None, "TELEPHONE", 3),
    "credit_card": (r"\b(?:[0-9][ -]?){13,19}\b", None, None, "CARD", 2),
}
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN CAST(d[i] AS INT) * 2 > 9 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END)) % 10 = 0"


def spans_sql(pattern: str, before: str | None = None, after: str | None = None, label: str = "", priority: int = 0, rule: str = "") -> str:
    """SELECT of doc_id, start, end, label, value, rule, priority."""
    q = pattern.replace("'", "''")
    guard = (f" AND NOT regexp_matches(coalesce(substr(text, s, 1), ''), '{before}')" if before else "") + (f" AND NOT regexp_matches(coalesce(substr(text, s + length(v) + 1, 1), ''), '{after}')" if after else "")
    guard += f" AND {_LUHN}" if rule == "credit_card" else ""
    # Word boundaries are Unicode's in the rule and ASCII's here: before a letter that ASCII lacks, a space belongs to the match.
    more = r"CASE WHEN right(v, 1) BETWEEN '0' AND '9' AND regexp_matches(substr(text, s + length(v) + 1, 2), '^[ -][\p{L}]') THEN v || substr(text, s + length(v) + 1, 1) ELSE v END"
    value = more if rule == "credit_card" else "v"
    return f"""SELECT doc_id, CAST(s AS INTEGER) AS "start", CAST(s + length(v) AS INTEGER) AS "end", '{label}' AS label, v AS value, '{rule}' AS rule, CAST({priority} AS INTEGER) AS priority FROM (
      SELECT doc_id, text, s, {value} AS v, regexp_replace(x.v, '[^0-9]', '', 'g') AS d FROM (
        SELECT doc_id, text, m[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
          SELECT doc_id, text, regexp_extract_all(text, '{q}') AS m, string_split_regex(text, '{q}') AS p FROM documents) t, UNNEST(range(1, len(m) + 1)) u(i)) x) w WHERE true{guard}"""


def rule_sql(name: str) -> str:
    pattern, before, after, label, priority = _SQL[name]
    return spans_sql(pattern, before, after, label, priority, name)


TRUE_SQL = " UNION ALL ".join(rule_sql(n) for n in NAMES)
ROUGH_SQL = " UNION ALL ".join(spans_sql(r.pattern, None, None, r.label, r.priority, r.name) for r in ROUGH_RULES)


def true_spans(t) -> DataFrame:
    return spans.rule_spans(t("documents"), TRUE_RULES)


def rough_spans(t) -> DataFrame:
    return spans.rule_spans(t("documents"), ROUGH_RULES)


for _name, _key in zip(NAMES, ("email_spans", "ipv4_spans", "phone_us_spans", "card_spans_luhn"), strict=True):
    query(rule_sql(_name), _key)(lambda t, r=BY_NAME[_name]: spans.rule_spans(t("documents"), [r]))

_KEYS = "SELECT c_custkey AS doc_id, 'key: ' || CASE c_custkey % 3 WHEN 0 THEN 'sk_' || sha256(c_name) WHEN 1 THEN 'sk_' || substr(sha256(c_name), 1, 16) || ' and sk_short' ELSE 'none' END || ' end' AS text FROM customer"


def with_keys(t) -> DataFrame:
    """A table that holds keys: long, short and none."""
    digest = F.sha2("c_name", 256)
    key = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("sk_"), digest)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("sk_"), F.substring(digest, 1, 16), F.lit(" and sk_short"))).otherwise("none")
    return t("customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("key: "), key, F.lit(" end")).alias("text"))


query(spans_sql(BY_NAME["generic_secret"].pattern, None, None, "SECRET", 1, "generic_secret").replace("FROM documents)", f"FROM ({_KEYS}))"), "api_key_spans")(lambda t: spans.rule_spans(with_keys(t), [BY_NAME["generic_secret"]]))


@query()
def detect_all_rules(t):
    return spans.detect(t("documents"))


@query(f"SELECT label, rule, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(\"end\" - \"start\")::BIGINT AS chars FROM ({TRUE_SQL}) GROUP BY ALL")
def spans_by_type(t):
    return true_spans(t).groupBy("label", "rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query(f"SELECT max(n) AS most, avg(n) AS mean, count(*) AS n_docs FROM (SELECT doc_id, count(*) AS n FROM ({TRUE_SQL}) GROUP BY 1)")
def spans_per_doc_stats(t):
    return true_spans(t).groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.avg("n").alias("mean"), F.count("*").alias("n_docs"))


def _case(mapping: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{a.replace(chr(39), chr(39) * 2)}' THEN '{b}'" for a, b in mapping.items()) + f" ELSE {key} END"


@query(f"SELECT doc_id, \"start\", label, {_case(labels.NORMALISED, 'label')} AS normalised, {_case(labels.RATBENCH, _case(labels.CANONICAL, 'label'))} AS projected, CASE WHEN label = 'IP' THEN 'unknown' ELSE 'direct' END AS class FROM ({TRUE_SQL})")
def normalise_labels(t):
    n = labels.normalise(F.col("label"))
    return true_spans(t).select("doc_id", "start", "label", n.alias("normalised"), labels.project(F.col("label"), labels.RATBENCH).alias("projected"), labels.identifier_class(n).alias("class"))


def spanned(t) -> DataFrame:
    """Documents with true and rough matches as arrays beside their texts."""
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", "text", "lang", spans.found(text, TRUE_RULES).alias("g"), spans.found(text, ROUGH_RULES).alias("p"))


def mixed(t) -> DataFrame:
    """True and rough spans with sources and scores, for overlaps."""
    return spanned(t).select("doc_id", spans.ordered(F.concat(spans.as_spans(F.col("g"), "regex", 1.0), spans.as_spans(F.col("p"), "ai", 0.9))).alias("spans"))


def _exploded(df: DataFrame) -> DataFrame:
    return spans.rows(df, F.col("spans"), "doc_id").select("doc_id", "start", "end", "label", "value", "source")


_MIXED_SQL = f"""SELECT doc_id, "start", "end", label, value, 'regex' AS source, 1.0 AS score FROM ({TRUE_SQL}) UNION ALL SELECT doc_id, "start", "end", label, value, 'ai', 0.9 FROM ({ROUGH_SQL})"""


def _fold_sql(replaces: str) -> str:
    """Ordered spans walked by a recursive query; replaces compares s (new) with the last kept span."""
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, score DESC, label, value, source) AS k FROM ({_MIXED_SQL})),
    f AS (SELECT doc_id, k, k AS kept, NULL::BIGINT AS gone FROM o WHERE k = 1
      UNION ALL SELECT s.doc_id, s.k, CASE WHEN s."start" >= l."end" OR ({replaces}) THEN s.k ELSE f.kept END, CASE WHEN s."start" >= l."end" THEN NULL WHEN ({replaces}) THEN f.kept END
      FROM f JOIN o s ON s.doc_id = f.doc_id AND s.k = f.k + 1 JOIN o l ON l.doc_id = f.doc_id AND l.k = f.kept)
    SELECT doc_id, "start", "end", label, value, source FROM o WHERE (doc_id, k) IN (SELECT doc_id, kept FROM f) AND (doc_id, k) NOT IN (SELECT doc_id, gone FROM f WHERE gone IS NOT NULL)"""


_LONGER = '(s."end" - s."start") > (l."end" - l."start")'
for _strategy, _sql in {
    "first": "false",
    "longest": _LONGER,
    "highest_score": "s.score > l.score",
    "priority_longest": f"CASE WHEN s.label = l.label THEN {_LONGER} WHEN s.source <> l.source THEN s.source = 'regex' ELSE {_LONGER} END",
    "priority_score": "CASE WHEN s.label = l.label THEN s.score > l.score WHEN s.source <> l.source THEN s.source = 'regex' ELSE s.score > l.score END",
}.items():
    query(_fold_sql(_sql), f"resolve_{_strategy}")(lambda t, s=_strategy: _exploded(mixed(t).withColumn("spans", spans.resolve(F.col("spans"), s))))
query(_fold_sql("false"), "sweep_dedupe")(lambda t: _exploded(mixed(t).withColumn("spans", spans.sweep(F.col("spans")))))

_NORM = _case(labels.NORMALISED, "label")
_HMAC = "sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('dev-salt|default|' || norm || '|' || value))))".format(
    outer=bytes(b ^ 0x5C for b in b"dev-secret".ljust(64, b"\0")).hex(), inner=bytes(b ^ 0x36 for b in b"dev-secret".ljust(64, b"\0")).hex()
)
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_MASK = f"CASE norm WHEN 'EMAIL' THEN substr(value, 1, 1) || repeat('*', greatest(1, position('@' IN value) - 2)) || substr(value, position('@' IN value)) WHEN 'PHONE' THEN substr({_DIGITS}, 1, 2) || ' ** ** ** ' || right({_DIGITS}, 2) ELSE substr(value, 1, 2) || repeat('*', length(value) - 2) END"


@query(f"""SELECT doc_id, "start", norm, {_MASK} AS masked, '[' || norm || ']' AS generalised, '[' || norm || '_REDACTED]' AS redacted, '[' || norm || '_' || upper(substr({_HMAC}, 1, 8)) || ']' AS pseudonym FROM (SELECT *, {_NORM} AS norm FROM ({TRUE_SQL}))""")
def mask_values(t):
    n, v = F.col("norm"), F.col("value")
    act = lambda a: masking.replacement(n, v, F.lit(a))
    return true_spans(t).withColumn("norm", labels.normalise(F.col("label"))).select("doc_id", "start", "norm", act("mask").alias("masked"), act("generalize").alias("generalised"), act("redact").alias("redacted"), act("pseudo").alias("pseudonym"))


def masked_documents(t) -> DataFrame:
    """Detected, normalised, ordered, resolved and masked in one projection."""
    named = F.transform(spans.as_spans(spans.found(F.coalesce("text", F.lit("")), [BY_NAME["email_strict"], BY_NAME["phone_us"]])), lambda s: s.withField("label", labels.normalise(s["label"])))
    docs = t("documents").select("doc_id", "text", "lang", named.alias("spans")).withColumn("spans", spans.resolve(spans.ordered(F.col("spans"))))
    return masking.mask_documents(docs, {}, "generalize")


_MASKED_SQL = r"""SELECT doc_id, text, lang, regexp_replace(regexp_replace(text, '(^|[^\w@])[a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}', '\1[EMAIL]', 'g'), '(^|[^0-9])\([0-9]{3}\)\s?[0-9]{3}[-\s.][0-9]{4}\b', '\1[PHONE]', 'g') AS masked FROM documents"""


@query(f"SELECT doc_id, masked FROM ({_MASKED_SQL})")
def apply_masks(t):
    return masked_documents(t).select("doc_id", "masked")


@query(f"""SELECT label, count(*) AS gold, count(*) FILTER (contains(lower(m.masked), lower(s.value))) AS leaked, round(1 - count(*) FILTER (contains(lower(m.masked), lower(s.value))) / count(*), 4) AS protection FROM ({TRUE_SQL}) s JOIN ({_MASKED_SQL}) m USING (doc_id) GROUP BY label""")
def gold_leakage(t):
    docs = masked_documents(t).select("doc_id", "masked", F.explode(spans.found(F.coalesce("text", F.lit("")), TRUE_RULES)).alias("s"))
    hit = F.contains(F.lower("masked"), F.lower("s.value")).cast("bigint")
    return docs.groupBy("s.label").agg(F.count("*").alias("gold"), F.sum(hit).alias("leaked"), F.round(1 - F.sum(hit) / F.count("*"), 4).alias("protection"))


_FLAGS = f"""g AS (SELECT DISTINCT doc_id, "start" AS s, "end" AS e, label FROM ({TRUE_SQL})), p AS (SELECT DISTINCT doc_id, "start" AS s, "end" AS e, label FROM ({ROUGH_SQL})),
 gf AS (SELECT g.doc_id, g.label, bool_or(p.s IS NOT NULL) AS cov, coalesce(bool_or(p.label = g.label), false) AS typ, coalesce(bool_or(p.label = g.label AND p.s = g.s AND p.e = g.e), false) AS strict FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e GROUP BY g.doc_id, g.s, g.e, g.label),
 pf AS (SELECT p.doc_id, p.label, bool_or(g.s IS NOT NULL) AS cov, coalesce(bool_or(p.label = g.label AND p.s = g.s AND p.e = g.e), false) AS strict, coalesce(bool_or(p.s = g.s AND p.e = g.e), false) AS bounds FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e GROUP BY p.doc_id, p.s, p.e, p.label)"""


def _scores_sql(by: str) -> str:
    group, join = (f"GROUP BY {by}", f"FULL JOIN pa USING ({by})") if by else ("", "CROSS JOIN pa")
    head = f"{by}, " if by else ""
    f = lambda p, r, b: f"CASE WHEN {p} <= 0 AND {r} <= 0 THEN 0 ELSE (1 + {b}) * {p} * {r} / ({b} * {p} + {r}) END"
    return f"""WITH {_FLAGS}, ga AS (SELECT {head}count(*) FILTER (cov) AS recall_tp, count(*) FILTER (NOT cov) AS recall_fn, count(*) FILTER (typ) AS exact_recall_tp, count(*) FILTER (strict) AS strict_recall_tp, count(*) AS truth_count FROM gf {group}),
    pa AS (SELECT {head}count(*) FILTER (cov) AS precision_tp, count(*) FILTER (NOT cov) AS precision_fp, count(*) FILTER (strict) AS strict_precision_tp, count(*) FILTER (cov AND NOT strict AND bounds) AS type_error, count(*) FILTER (cov AND NOT strict AND NOT bounds) AS boundary_error, count(*) AS pred_count FROM pf {group}),
    j AS (SELECT {head}{', '.join(f'coalesce({c}, 0) AS {c}' for c in 'recall_tp recall_fn exact_recall_tp strict_recall_tp truth_count precision_tp precision_fp strict_precision_tp type_error boundary_error pred_count'.split())} FROM ga {join}),
    r AS (SELECT *, CASE WHEN pred_count > 0 THEN precision_tp / pred_count ELSE 0 END AS pr, CASE WHEN truth_count > 0 THEN recall_tp / truth_count ELSE 0 END AS re, CASE WHEN pred_count > 0 THEN strict_precision_tp / pred_count ELSE 0 END AS sp, CASE WHEN truth_count > 0 THEN strict_recall_tp / truth_count ELSE 0 END AS sr FROM j)
    SELECT * EXCLUDE (pr, re, sp, sr), round(pr, 4)::DOUBLE AS precision, round(re, 4)::DOUBLE AS recall, round({f('pr', 're', 4)}, 4)::DOUBLE AS f2, round(sp, 4)::DOUBLE AS strict_precision, round(sr, 4)::DOUBLE AS strict_recall, round({f('sp', 'sr', 1)}, 4)::DOUBLE AS strict_f1 FROM r"""


def flags(t) -> tuple[DataFrame, DataFrame]:
    """Flags of true and rough spans, found where the texts are."""
    docs = spanned(t)
    g, p = metrics.flagged(F.col("g"), F.col("p"))
    return spans.rows(docs, g, "doc_id"), spans.rows(docs, p, "doc_id")


for _key, _by in {"eval_spans_micro": [], "label_metrics": ["label"], "eval_spans_by_doc": ["doc_id"]}.items():
    query(_scores_sql(", ".join(_by)), _key)(lambda t, by=_by: metrics.span_scores(*flags(t), by))


@query(f"""WITH s AS ({_scores_sql('doc_id')}) SELECT round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(sum(precision_tp) / sum(pred_count), 4) AS micro_precision, round(sum(recall_tp) / sum(truth_count), 4) AS micro_recall, count(*) AS n_docs FROM s""")
def macro_micro(t):
    s = metrics.span_scores(*flags(t), ["doc_id"])
    return s.agg(F.round(F.avg("precision"), 4).alias("macro_precision"), F.round(F.avg("recall"), 4).alias("macro_recall"), F.round(F.sum("precision_tp") / F.sum("pred_count"), 4).alias("micro_precision"), F.round(F.sum("recall_tp") / F.sum("truth_count"), 4).alias("micro_recall"), F.count("*").alias("n_docs"))


_GREEDY = f"""WITH RECURSIVE g AS (SELECT doc_id, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", label) AS k FROM (SELECT DISTINCT doc_id, "start", "end", label FROM ({TRUE_SQL}))),
 p AS (SELECT doc_id, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", label) AS k FROM (SELECT DISTINCT doc_id, "start", "end", label FROM ({ROUGH_SQL}))),
 m AS (SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS used FROM (SELECT DISTINCT doc_id FROM g)
   UNION ALL SELECT m.doc_id, g.k, CASE WHEN (SELECT min(p.k) FROM p WHERE p.doc_id = g.doc_id AND g.s < p.e AND p.s < g.e AND NOT list_contains(m.used, p.k)) IS NULL THEN m.used
     ELSE list_append(m.used, (SELECT min(p.k) FROM p WHERE p.doc_id = g.doc_id AND g.s < p.e AND p.s < g.e AND NOT list_contains(m.used, p.k))) END FROM m JOIN g ON g.doc_id = m.doc_id AND g.k = m.k + 1),
 last AS (SELECT doc_id, max(len(used)) AS tp, max(k) AS n FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(tp, 0)::INT AS tp, (coalesce(np, 0) - coalesce(tp, 0))::INT AS fp, (coalesce(n, 0) - coalesce(tp, 0))::INT AS fn FROM documents d LEFT JOIN last USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS np FROM p GROUP BY 1) USING (doc_id)"""


@query(_GREEDY)
def greedy_match(t):
    return spanned(t).select("doc_id", metrics.greedy_match(F.col("g"), F.col("p")).alias("m")).select("doc_id", "m.*")


@query(f"SELECT lang, count(*) AS n, round(avg(length(masked) / length(text)), 4) AS kept_length, count(*) FILTER (masked <> text) AS n_changed FROM ({_MASKED_SQL}) GROUP BY lang")
def length_change(t):
    d = masked_documents(t)
    # An empty text has no share: NaN as in SQL, where ANSI division is an error.
    kept = F.when(F.length("text") == 0, float("nan")).otherwise(F.length("masked") / F.length("text"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(kept), 4).alias("kept_length"), F.count_if(F.col("masked") != F.col("text")).alias("n_changed"))


_W = "list_filter(string_split_regex({}, '[\\s\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '')"
_BLEU = f"""WITH w AS (SELECT doc_id, text, masked, {_W.format('text')} AS r, {_W.format('masked')} AS h FROM ({_MASKED_SQL})),
 grams AS (SELECT doc_id, 'r' AS side, unnest(list_concat(r, list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]))) AS g FROM w UNION ALL SELECT doc_id, 'h', unnest(list_concat(h, list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1]))) FROM w),
 hits AS (SELECT doc_id, sum(least(a, b)) AS k FROM (SELECT doc_id, g, count(*) FILTER (side = 'r') AS a, count(*) FILTER (side = 'h') AS b FROM grams GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR coalesce(masked, '') = '' THEN 0.0 WHEN text = masked THEN 1.0 WHEN len(h) = 0 THEN 0.0 ELSE round(CASE WHEN len(h) < len(r) THEN exp(1 - len(r) / len(h)) ELSE 1 END * k / (len(h) + len(h) - 1), 4) END AS bleu FROM w LEFT JOIN hits USING (doc_id)"""


@query(_BLEU)
def bleu_masked(t):
    return masked_documents(t).select("doc_id", metrics.bleu(F.col("text"), F.col("masked")).alias("bleu"))


@query("SELECT doc_id, round(len(list_intersect(a, b)) / len(a), 4) AS retention FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(masked), '\\s+'), lambda x: x <> '')) AS b FROM (" + _MASKED_SQL + "))")
def token_retention(t):
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    d = masked_documents(t).select("doc_id", words("text").alias("a"), words("masked").alias("b"))
    return d.select("doc_id", F.round(metrics.share(F.size(F.array_intersect("a", "b")), F.size("a")), 4).alias("retention"))
