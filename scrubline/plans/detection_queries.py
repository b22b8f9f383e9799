"""Hybrid detection, heuristics, reviews, verification, sentences and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.functions.patterns import NEWS_RULES
from scrubline.operators import detection, spans
from scrubline.plans import span_queries as sq
from scrubline.plans.registry import query

_HYBRID = f"""WITH RECURSIVE m AS (SELECT doc_id, "start", "end", {sq._NORM} AS label, value, 'regex' AS source, 1.0 AS score FROM ({sq.TRUE_SQL}) UNION ALL SELECT doc_id, "start", "end", {sq._NORM}, value, 'ai', 1.0 FROM ({sq.ROUGH_SQL}) WHERE "end" - "start" >= 9),
 d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, "start", "end", label ORDER BY source DESC) = 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, score DESC, label, value, source) AS k FROM d),
 f AS (SELECT doc_id, k, k AS kept, NULL::BIGINT AS gone FROM o WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.k, CASE WHEN s."start" >= l."end" OR (CASE WHEN s.label = l.label THEN {sq._LONGER} WHEN s.source <> l.source THEN s.source = 'regex' ELSE {sq._LONGER} END) THEN s.k ELSE f.kept END,
   CASE WHEN s."start" >= l."end" THEN NULL WHEN (CASE WHEN s.label = l.label THEN {sq._LONGER} WHEN s.source <> l.source THEN s.source = 'regex' ELSE {sq._LONGER} END) THEN f.kept END
  FROM f JOIN o s ON s.doc_id = f.doc_id AND s.k = f.k + 1 JOIN o l ON l.doc_id = f.doc_id AND l.k = f.kept)
SELECT doc_id, "start", "end", label, value, source FROM o WHERE (doc_id, k) IN (SELECT doc_id, kept FROM f) AND (doc_id, k) NOT IN (SELECT doc_id, gone FROM f WHERE gone IS NOT NULL)"""


@query(_HYBRID)
def hybrid_detection(t):
    d = sq.spanned(t).withColumn("spans", detection.hybrid(spans.as_spans(F.col("g")), spans.as_spans(F.col("p"), "ai", 1.0), least=9))
    return sq._exploded(d)


@query(f"""SELECT doc_id, "start", "end", upper(label) AS label, source FROM ({sq._MIXED_SQL}) QUALIFY row_number() OVER (PARTITION BY doc_id, "start", "end", upper(label) ORDER BY source DESC) = 1""")
def merge_lists(t):
    d = sq.spanned(t).select("doc_id", detection.merge_model_lists(spans.as_spans(F.col("g"), "regex"), spans.as_spans(F.col("p"), "ai")).alias("spans"))
    return d.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.source")


_NEWS_TEXT = "Alpha Team v Beta Club of Rome ( 1 )\nGamma United 10 2 3 4\nDelta City 2 Epsilon 3 .\nthe Green Party met. World Bank ( WB ) told Reuters so"
_NEWS = {v: _NEWS_TEXT.index(v) for v in ("Alpha Team", "Beta Club of Rome", "Gamma United", "Delta City", "Epsilon", "Green Party", "World Bank", "WB", "Reuters")}


@query(" UNION ALL ".join(f"SELECT s_suppkey, ({at} + length(s_suppkey::VARCHAR) + 2)::INT AS start, '{v}' AS value FROM supplier" for v, at in _NEWS.items()))
def news_heuristics(t):
    found = spans.grouped_spans(NEWS_RULES, "heuristic", 0.92)(F.concat(F.lit("#"), F.col("s_suppkey").cast("string"), F.lit("\n"), F.lit(_NEWS_TEXT)))
    return t("supplier").select("s_suppkey", F.explode(found).alias("s")).select("s_suppkey", "s.start", "s.value")


@query("""SELECT s_suppkey, start::INT AS start, "end"::INT AS "end" FROM (SELECT s_suppkey, length(s_name) AS n FROM supplier) s, LATERAL (VALUES (0, n + 13), (n + 13, n + 26), (n + 26, n + 34), (n + 36, n + 44)) v(start, "end")""")
def scanned_sentences(t):
    """An abbreviation, a capital, a small letter behind a question mark, a quote, two line feeds."""
    text = F.concat(F.lit("Mr. "), F.col("s_name"), F.lit(" saw it. He left? ok.\n"), F.lit("\"He said\n\nnothing."))
    return t("supplier").select("s_suppkey", F.explode(detection.sentences(text)).alias("s")).select("s_suppkey", "s.*")


@query("""SELECT s_suppkey, v.text, v.off::INT AS "offset", v.sep AS separator FROM (SELECT s_suppkey, s_name, length(s_name) AS n FROM supplier) s, LATERAL (VALUES (s_name || ' came. He saw.', 0, ' '), ('A much longer sentence that stands alone here.', n + 15, chr(10) || chr(10)), ('End.', n + 63, '')) v(text, off, sep)""")
def chunked_context(t):
    text = F.concat("s_name", F.lit(" came. He saw. A much longer sentence that stands alone here.\n\nEnd."))
    return t("supplier").select("s_suppkey", F.explode(detection.context_chunks(text, 40)).alias("c")).select("s_suppkey", "c.*")


@query("""SELECT s_suppkey, start::INT AS start, "end"::INT AS "end", label, value, source FROM (SELECT s_suppkey, s_name, length(s_name) AS n FROM supplier) s, LATERAL (VALUES
 (5, n + 5, 'PER', s_name, 'llm_verified'), (n + 6, n + 8, 'MISC', 'of', 'ai'), (n + 9, n + 17, 'LOC', 'New York', 'llm_verified'), (n + 18, n + 20, 'MISC', 'in', 'ai'), (n + 21, n + 24, 'ORG', 'abc', 'ai')) v(start, "end", label, value, source)""")
def verified_entities(t):
    """Retyped, removed (ignored), extended by a search, extended by wrong text (kept), without a decision."""
    n = F.length("s_name")
    of = lambda a, b, label, value: F.struct((n + a).cast("int").alias("start"), (n + b).cast("int").alias("end"), F.lit(label).alias("label"), value.alias("value"), F.lit("ai").alias("source"), F.lit(0.9).alias("score"))
    first = F.struct(F.lit(5).alias("start"), (n + 5).cast("int").alias("end"), F.lit("ORG").alias("label"), F.col("s_name").alias("value"), F.lit("ai").alias("source"), F.lit(0.9).alias("score"))
    entities = F.array(first, of(6, 8, "MISC", F.lit("of")), of(9, 12, "LOC", F.lit("New")), of(18, 20, "MISC", F.lit("in")), of(21, 24, "ORG", F.lit("abc"))).cast(f"array<{spans.SPAN}>")
    kind = "struct<id:int,action:string,new_type:string,new_text:string,new_start:int,new_end:int>"
    told = lambda i, action, new_type=None, new_text=None, a=None, b=None: F.struct(F.lit(i).alias("id"), F.lit(action).alias("action"), F.lit(new_type).alias("new_type"), F.lit(new_text).alias("new_text"), F.lit(a).alias("new_start"), F.lit(b).alias("new_end")).cast(kind)
    decisions = F.array(told(0, "keep"), told(0, " Retype ", "person"), told(1, "remove"), told(2, "extend", None, "New York", 0, 8), told(3, "extend", None, "nowhere", 1, 8))
    text = F.concat(F.lit("from "), F.col("s_name"), F.lit(" of New York in abc"))
    return t("supplier").select("s_suppkey", F.explode(detection.verified(entities, decisions, text)).alias("s")).select("s_suppkey", "s.start", "s.end", "s.label", "s.value", "s.source")


@query("""SELECT s_suppkey, start::INT AS start, "end"::INT AS "end", label, method FROM (SELECT s_suppkey, length(s_name) AS n FROM supplier) s, LATERAL (VALUES
 (4, 4 + n, 'PER', 'llm_offsets'), (n + 14, n + 20, 'LOC', 'exact'), (n + 30, n + 36, 'LOC', 'exact'), (n + 22, n + 29, 'ORG', 'case_insensitive'), (n + 5, n + 13, 'MISC', 'fuzzy'), (n + 37, n + 42, 'DATE', 'evidence_context')) v(start, "end", label, method)""")
def reviewed_entities(t):
    n = F.length("s_name").cast("int")
    kind = "struct<type:string,text:string,evidence:string,start:int,end:int>"
    of = lambda k, v, e, a, b: F.struct(F.lit(k).alias("type"), v.alias("text"), F.lit(e).alias("evidence"), a.alias("start"), b.alias("end")).cast(kind)
    no = F.lit(None)
    proposals = F.array(of("PER", F.col("s_name"), "", F.lit(4), 4 + n), of("LOC", F.lit("London"), "", F.lit(0), F.lit(3)), of("ORG", F.lit("acme ag"), None, no, no), of("MISC", F.lit("brillant"), "", no, no), of("DATE", F.lit("the year"), "today", no, no), of("X", F.lit("a"), "", no, no), of("Y", F.lit("zzzzzzzz"), "", no, no))
    text = F.concat(F.lit("Ms  "), F.col("s_name"), F.lit(" briliant London, Acme AG London today"))
    return t("supplier").select("s_suppkey", F.explode(detection.review_spans(text, proposals)).alias("s")).select("s_suppkey", "s.*")
