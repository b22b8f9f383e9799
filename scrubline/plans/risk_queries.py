"""Re-identification risk, candidate ranking and calibration on the star tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.plans.registry import query


@query("SELECT c_custkey, k, round(1 / k, 4) AS risk, 1 / k > 0.2 AS high FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer)")
def k_anonymity_risk(t):
    d = t("customer").withColumn("k", F.count("*").over(W.partitionBy("c_nationkey", "c_mktsegment")))
    return d.select("c_custkey", "k", F.round(1 / F.col("k"), 4).alias("risk"), (1 / F.col("k") > 0.2).alias("high"))


@query("SELECT k, count(*) AS classes, sum(k)::BIGINT AS people FROM (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY k")
def equivalence_classes(t):
    return t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("classes"), F.sum("k").alias("people"))


@query("SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderpriority), (c_mktsegment))")
def risk_by_segment(t):
    d = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return d.groupingSets([[F.col("o_orderpriority")], [F.col("c_mktsegment")]], "o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


_RANKED = "SELECT c_nationkey, o_custkey, total, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, o_custkey) AS rank, total / sum(total) OVER (PARTITION BY c_nationkey) AS confidence FROM (SELECT c_nationkey, o_custkey, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def ranked(t):
    d = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("total"), "o_custkey"))).withColumn("confidence", F.col("total") / F.sum("total").over(W.partitionBy("c_nationkey")))


@query(f"SELECT c_nationkey, o_custkey, rank, round(confidence, 4) AS confidence FROM ({_RANKED}) WHERE rank <= 5")
def candidate_top5(t):
    return ranked(t).where("rank <= 5").select("c_nationkey", "o_custkey", "rank", F.round("confidence", 4).alias("confidence"))


@query(f"SELECT round(avg(1 / r), 4) AS mrr, round(avg(CASE WHEN r <= 1 THEN 1 ELSE 0 END), 4) AS top1, round(avg(CASE WHEN r <= 3 THEN 1 ELSE 0 END), 4) AS top3, round(avg(CASE WHEN r <= 5 THEN 1 ELSE 0 END), 4) AS top5 FROM (SELECT c_nationkey, min(rank) AS r FROM ({_RANKED}) JOIN customer USING (c_nationkey) WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' GROUP BY 1)")
def mrr_topk(t):
    target = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.col("c_nationkey").alias("n"))
    r = ranked(t).join(target, (F.col("c_nationkey") == F.col("n")) & (F.col("c_custkey") == F.col("o_custkey"))).groupBy("c_nationkey").agg(F.min("rank").alias("r"))
    hit = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1).otherwise(0)), 4).alias(f"top{k}")
    return r.agg(F.round(F.avg(1 / F.col("r")), 4).alias("mrr"), hit(1), hit(3), hit(5))


_GATE = "SELECT o_orderpriority AS grade, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS top1 FROM orders GROUP BY 1"


@query(f"SELECT grade, round(top1, 4) AS top1, round(top1 - lag(top1) OVER (ORDER BY grade), 4) AS gap, coalesce(top1 - lag(top1) OVER (ORDER BY grade) >= 0.05, true) AS passed FROM ({_GATE})")
def calibration_gate(t):
    d = t("orders").groupBy(F.col("o_orderpriority").alias("grade")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("top1"))
    gap = F.col("top1") - F.lag("top1").over(W.orderBy("grade"))  # a handful of grades
    return d.select("grade", F.round("top1", 4).alias("top1"), F.round(gap, 4).alias("gap"), F.coalesce(gap >= 0.05, F.lit(True)).alias("passed"))
