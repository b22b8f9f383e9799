"""Attacks by models, whose answers are a digest of their prompts here, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.operators import attackers, rewriting
from scrubline.plans.registry import checkpoints, query


def _ask(asked):
    """A digest of the prompt as the value; blank for some, no JSON for others, no answer for others."""
    d = F.md5("prompt")
    digit = F.substring(d, 1, 1)
    value = F.concat(F.lit('{"value": " '), F.substring(d, 2, 6), F.lit(' "}'))
    return asked.select("row", F.when(digit == "0", '{"value": " "}').when(digit == "1", "no").otherwise(value).alias("response")).where(digit != "2")


_D = "md5('Attribute: {a}' || chr(10) || 'Known: ' || {known} || chr(10) || 'Text: ' || coalesce(text, ''))"
_V = "CASE WHEN {d}[1] IN ('0', '1', '2') THEN {other} ELSE {d}[2:7] END"


@query(f"""WITH a AS (SELECT doc_id, text, lang, source, {_D.format(a='lang', known="''")} AS d FROM documents), b AS (SELECT *, {_V.format(d='d', other='lang')} AS v, {_D.format(a='source', known="'lang=' || coalesce(" + _V.format(d='d', other='lang') + ", '?')")} AS e FROM a),
c AS (SELECT *, {_V.format(d='e', other='source')} AS w FROM b), z AS (SELECT *, {_D.format(a='age', known="'lang=' || coalesce(v, '?') || '; source=' || coalesce(w, '?')")} AS f FROM c)
SELECT doc_id, v AS lang, w AS source, {_V.format(d='f', other='NULL')} AS age, CASE WHEN f[1] IN ('0', '1', '2') THEN 'none' ELSE 'model' END AS age_source FROM z""")
def attribute_attack(t):
    d = t("documents").select("doc_id", "text", "lang", "source")
    checkpoints(d.sparkSession)
    found = attackers.attack_attributes(d, ["lang", "source", "age"], _ask, {"lang": F.col("lang"), "source": F.col("source")})
    value = lambda k: F.col("known")[k]["value"]
    return found.select("doc_id", value(0).alias("lang"), value(1).alias("source"), value(2).alias("age"), F.col("known")[2]["source"].alias("age_source"))


@query("""SELECT o_orderkey, array_to_string((CASE o_orderkey % 3 WHEN 0 THEN ['c', o_orderpriority, 'a', 'b', 'd', 'e'] ELSE [o_orderpriority, 'a', 'b', 'c', 'd', 'e'] END)[1:5], ',') AS ranking, CASE o_orderkey % 3 WHEN 0 THEN 'model' ELSE 'structured' END AS source FROM orders""")
def model_rankings(t):
    k = F.col("o_orderkey") % 3
    response = F.when(k == 0, '{"ranking": ["c", "unknown", "c"]}').when(k == 1, "not json").otherwise('{"ranking": ["x"]}')
    r = attackers.model_ranking(response, F.array(F.col("o_orderpriority"), *[F.lit(x) for x in "abcde"]))
    return t("orders").select("o_orderkey", r.alias("r")).select("o_orderkey", F.array_join("r.ranking", ",").alias("ranking"), "r.source")


@query()
def chunk_rewrites(t):
    """Documents whose chunks hold two given words, rewritten without them; a rewrite of every third chunk is too short."""
    d = t("documents").select("doc_id", "text")
    checkpoints(d.sparkSession)
    leak = lambda word, sure: F.struct(F.lit("word").alias("attribute"), F.lit(word).alias("evidence"), F.lit(sure).alias("confidence"))
    answer = lambda asked: asked.select("row", "chunk", F.when(F.col("chunk") % 3 == 2, "x").otherwise(F.regexp_replace("text", "(?i)tionen|nenti", "[...]")).alias("response"))
    return rewriting.rewrite_leaks(d.withColumn("leaks", F.array(leak("tionen", 0.9), leak("nenti", 0.7), leak("the", 0.2))), answer, most=2000).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "asked", "rewritten")
