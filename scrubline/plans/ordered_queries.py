"""Ordered and set operators: offsets, islands, numbering, resume, comparison."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.plans.registry import query

_TOK = r"SELECT conv_id, turn, w[i] AS token, i AS k FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations), UNNEST(range(1, len(w) + 1)) u(i)"


def tok(t):
    return t("conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("k", "token")).withColumn("k", (F.col("k") + 1).cast("bigint"))


@query(f"SELECT conv_id, turn, k, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM ({_TOK})")
def running_offset(t):
    w = W.partitionBy("conv_id", "turn").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    return tok(t).select("conv_id", "turn", "k", "token", F.coalesce(F.sum(F.length("token") + 1).over(w), F.lit(0)).alias("at"))


_TAG = "CASE WHEN token[1] BETWEEN 'A' AND 'Z' THEN 'CAP' ELSE 'O' END"


@query(f"SELECT conv_id, turn, min(k) AS first, max(k) AS last, count(*) AS n FROM (SELECT *, sum(flag) OVER (PARTITION BY conv_id, turn ORDER BY k) AS island FROM (SELECT conv_id, turn, k, {_TAG} AS tag, CASE WHEN {_TAG} IS DISTINCT FROM lag({_TAG}) OVER (PARTITION BY conv_id, turn ORDER BY k) THEN 1 ELSE 0 END AS flag FROM ({_TOK}))) WHERE tag = 'CAP' GROUP BY conv_id, turn, island")
def bio_islands(t):
    w = W.partitionBy("conv_id", "turn").orderBy("k")
    d = tok(t).withColumn("tag", F.when(F.substring("token", 1, 1).between("A", "Z"), "CAP").otherwise("O"))
    d = d.withColumn("flag", F.when(F.col("tag").eqNullSafe(F.lag("tag").over(w)), 0).otherwise(1)).withColumn("island", F.sum("flag").over(w))
    return d.where("tag = 'CAP'").groupBy("conv_id", "turn", "island").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n")).drop("island")


@query(f"SELECT conv_id, turn, k, token, row_number() OVER (PARTITION BY conv_id, turn, token ORDER BY k) AS nth FROM ({_TOK})")
def occurrence_number(t):
    return tok(t).withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "turn", "token").orderBy("k")))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def resume_anti_join(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(t):
    return t("documents").join(t("labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def union_dedupe(t):
    return t("documents").select("doc_id").union(t("labels").select("doc_id")).distinct()


@query("SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS good, coalesce(b.n, 0) AS bad FROM (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1) b USING (lang)")
def full_outer_label_compare(t):
    d = t("documents").join(t("labels"), "doc_id")
    a, b = (d.where(f"quality = {q}").groupBy("lang").agg(F.count("*").alias(n)) for q, n in ((1, "good"), (0, "bad")))
    return a.join(b, "lang", "full_outer").fillna(0, ["good", "bad"])


@query("SELECT n_name, round(total, 2) AS total, round(total - first_value(total) OVER (ORDER BY total DESC, n_name), 2) AS delta FROM (SELECT n_name, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def run_delta(t):
    d = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("c_acctbal").alias("total"))
    return d.select("n_name", F.round("total", 2).alias("total"), F.round(F.col("total") - F.first("total").over(W.orderBy(F.desc("total"), "n_name")), 2).alias("delta"))  # one row a run
