"""Near duplicates, self-BLEU, distinct-2 by length, Vendi score and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.operators import diversity
from scrubline.plans.registry import ORACLE_SQL, query

_W = "list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+'), lambda w: lower(w))"
_SIGNED = f"""SELECT doc_id, list_transform(range(64), lambda k: list_min(list_transform(sh, lambda s: substr(md5(k || ':' || s), 1, 16)))) AS sig
 FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS sh FROM (SELECT doc_id, {_W} AS w FROM documents))"""


@query(f"""WITH s AS (SELECT sig, min(doc_id) AS rep FROM ({_SIGNED}) WHERE sig[1] IS NOT NULL GROUP BY sig)
SELECT x.rep AS a, y.rep AS b, round_even(list_sum(list_transform(range(1, 65), lambda k: (x.sig[k] = y.sig[k])::INT)) / 64, 4) AS estimate FROM s x JOIN s y ON x.rep < y.rep WHERE list_sum(list_transform(range(1, 65), lambda k: (x.sig[k] = y.sig[k])::INT)) >= 52""")
def near_duplicate_pairs(t):
    return diversity.near_duplicates(diversity.signatures(diversity.may_pair(t("documents"))))


@query(f"SELECT doc_id, CASE WHEN sig[1] IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY sig) END AS rep FROM ({_SIGNED})")
def near_duplicate_classes(t):
    return diversity.signature_classes(diversity.signatures(t("documents")))


@query(f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents), s AS (SELECT doc_id FROM documents ORDER BY md5('17:' || doc_id), doc_id LIMIT 200),
 g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, (VALUES (1), (2), (3), (4)) o(n) WHERE len(w) >= n),
 c AS (SELECT doc_id, n, g, count(*) AS c FROM g GROUP BY ALL),
 r AS (SELECT n, g, max(c) AS c1, arg_max(doc_id, c) AS who, list(c ORDER BY c DESC)[2] AS c2 FROM c GROUP BY ALL),
 h AS (SELECT doc_id, n, sum(least(c, CASE WHEN c = c1 THEN CASE WHEN c2 = c1 THEN c1 ELSE coalesce(c2, 0) END ELSE c1 END)) AS hit, sum(c) AS total FROM c JOIN s USING (doc_id) JOIN r USING (n, g) GROUP BY ALL),
 p AS (SELECT doc_id, sum(ln((hit + 1) / (total + 1))) AS log, count(*) AS orders FROM h GROUP BY 1),
 l AS (SELECT x.doc_id, len(x.w) AS own, arg_min(len(y.w), struct_pack(far := abs(len(y.w) - len(x.w)), l := len(y.w))) AS ref FROM d x JOIN s USING (doc_id) JOIN d y ON y.doc_id <> x.doc_id GROUP BY ALL)
SELECT doc_id, round(CASE WHEN orders = 4 THEN CASE WHEN own > ref THEN 1 ELSE exp(1 - ref / greatest(own, 1)) END * exp(log / 4) ELSE 0 END, 6) AS bleu FROM l LEFT JOIN p USING (doc_id)""")
def self_bleu(t):
    return diversity.self_bleu(t("documents")).withColumn("bleu", F.round("bleu", 6))


@query(f"""WITH d AS (SELECT {_W} AS w FROM documents), b AS (SELECT list_sort(list(len(w))) AS l FROM d),
 q AS (SELECT w, CASE WHEN len(w) <= l[greatest(1, len(l) // 4)] THEN 'q1' WHEN len(w) <= l[greatest(1, len(l) * 2 // 4)] THEN 'q2' WHEN len(w) <= l[greatest(1, len(l) * 3 // 4)] THEN 'q3' ELSE 'q4' END AS bin FROM d, b),
 g AS (SELECT bin, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM q)
SELECT bin, round(count(DISTINCT g) / count(*), 6) AS distinct_2 FROM g GROUP BY bin""")
def length_controlled_distinct(t):
    return diversity.length_controlled(t("documents")).withColumn("distinct_2", F.round("distinct_2", 6))


@query()
def vendi_score(t):
    return diversity.vendi(t("embeddings"))


@query(f"""SELECT *, len(failures) = 0 AS passed FROM (SELECT *, array_to_string(list_filter([CASE WHEN self_bleu > 0.9 THEN 'self_bleu' END, CASE WHEN distinct_2 < 0.15 THEN 'distinct_2' END, CASE WHEN duplicate_rate > 0.02 THEN 'duplicate_rate' END, CASE WHEN cell_coverage < 0.6 THEN 'cell_coverage' END], lambda x: x IS NOT NULL), ',') AS failures FROM (
 SELECT (SELECT round(avg(bleu), 4) FROM ({ORACLE_SQL['self_bleu']})) AS self_bleu, (SELECT round(count(DISTINCT g) / count(*), 4) FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT {_W} AS w FROM documents))) AS distinct_2, round(1 - count(DISTINCT text) / count(*), 4) AS duplicate_rate, round(count(DISTINCT lang || source) / (count(DISTINCT lang) * count(DISTINCT source)), 4) AS cell_coverage FROM documents))""")
def diversity_gates(t):
    docs = t("documents")
    counted = docs.agg(F.round(1 - F.countDistinct(F.sha2("text", 256)) / F.count("*"), 4).alias("duplicate_rate"), F.round(F.countDistinct(F.concat("lang", "source")) / (F.countDistinct("lang") * F.countDistinct("source")), 4).alias("cell_coverage"))
    bleu = diversity.self_bleu(docs).agg(F.round(F.avg(F.round("bleu", 6)), 4).alias("self_bleu"))
    measured = bleu.crossJoin(diversity.distinct(docs, 2).select(F.round("distinct_2", 4).alias("distinct_2"))).crossJoin(counted)  # one row each
    return diversity.gates(measured).withColumn("failures", F.array_join("failures", ","))
