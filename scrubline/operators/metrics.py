"""Agreement of predicted with true spans, leakage, and scores."""

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.arrays import let


def fbeta(p: Column, r: Column, beta: float = 2.0) -> Column:
    b = beta * beta
    return F.when((p <= 0) & (r <= 0), 0.0).otherwise(F.least(F.lit(1.0), (1 + b) * p * r / (b * p + r)))


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def overlaps(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of a document whose half-open spans meet."""
    g = gold.select("doc_id", *[F.col(c).alias(f"g_{c}") for c in ("start", "end", "label")])
    p = pred.select("doc_id", *[F.col(c).alias(f"p_{c}") for c in ("start", "end", "label")])
    return g.join(p, "doc_id").where("g_start < p_end and p_start < g_end")


def evaluate_spans(gold: DataFrame, pred: DataFrame, allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Flags of every gold span (recall, against all predictions) and of every prediction in scope (precision)."""
    keys = ["doc_id", "start", "end", "label"]
    gold, pred = gold.select(*keys).distinct(), pred.select(*keys).distinct()
    pairs = overlaps(gold, pred)
    same = (F.col("g_start") == F.col("p_start")) & (F.col("g_end") == F.col("p_end"))
    typed = F.col("g_label") == F.col("p_label")
    by_gold = pairs.groupBy("doc_id", F.col("g_start").alias("start"), F.col("g_end").alias("end"), F.col("g_label").alias("label")).agg(F.lit(True).alias("covered"), F.max(typed).alias("typed"), F.max(same & typed).alias("strict"))
    by_pred = pairs.groupBy("doc_id", F.col("p_start").alias("start"), F.col("p_end").alias("end"), F.col("p_label").alias("label")).agg(F.lit(True).alias("covered"), F.max(same & typed).alias("strict"), F.max(same).alias("bounds"))
    scoped = pred.where(F.col("label").isin(allowed)) if allowed is not None else pred
    fill = lambda d, cols: d.fillna(False, cols)
    return fill(gold.join(by_gold, keys, "left"), ["covered", "typed", "strict"]), fill(scoped.join(by_pred, keys, "left"), ["covered", "strict", "bounds"])


def span_scores(gold_flags: DataFrame, pred_flags: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates by document or label (or nothing at all)."""
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    g = gold_flags.groupBy(*by).agg(n("covered").alias("recall_tp"), (F.count("*") - n("covered")).alias("recall_fn"), n("typed").alias("exact_recall_tp"), n("strict").alias("strict_recall_tp"), F.count("*").alias("truth_count"))
    p = pred_flags.groupBy(*by).agg(n("covered").alias("precision_tp"), (F.count("*") - n("covered")).alias("precision_fp"), n("strict").alias("strict_precision_tp"), F.sum((F.col("covered") & ~F.col("strict") & F.col("bounds")).cast("bigint")).alias("type_error"), F.sum((F.col("covered") & ~F.col("strict") & ~F.col("bounds")).cast("bigint")).alias("boundary_error"), F.count("*").alias("pred_count"))
    out = (g.join(p, by, "full_outer") if by else g.crossJoin(p)).fillna(0)  # without keys both sides are one row
    precision, recall = share(F.col("precision_tp"), F.col("pred_count")), share(F.col("recall_tp"), F.col("truth_count"))
    sp, sr = share(F.col("strict_precision_tp"), F.col("pred_count")), share(F.col("strict_recall_tp"), F.col("truth_count"))
    return out.withColumns({"precision": F.round(precision, 4), "recall": F.round(recall, 4), "f2": F.round(fbeta(precision, recall), 4), "strict_precision": F.round(sp, 4), "strict_recall": F.round(sr, 4), "strict_f1": F.round(fbeta(sp, sr, 1.0), 4)})


def distinct_spans(spans: Column) -> Column:
    """start, end and label of each span once, ordered."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))))


def greedy_match(gold: Column, pred: Column, typed: bool = False) -> Column:
    """struct<tp, fp, fn> of one-to-one matches: distinct gold spans in order take the first free prediction they meet, with
    typed only of their label."""

    def step(s: Column, g: Column) -> Column:
        hits = F.transform(s["free"], lambda p: (g["start"] < p["end"]) & (p["start"] < g["end"]) & ((g["label"] == p["label"]) if typed else F.lit(True)))
        at = F.array_position(hits, True)
        rest = F.filter(s["free"], lambda p, i: i != (at - 1).cast("int"))
        return F.when(at > 0, F.struct((s["n"] + 1).alias("n"), rest.alias("free"))).otherwise(s)

    def counted(both: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), both["p"].alias("free"))
        return F.aggregate(both["g"], start, step, lambda s: F.struct(s["n"].alias("tp"), F.size(s["free"]).alias("fp"), (F.size(both["g"]) - s["n"]).alias("fn")))

    return let(F.struct(distinct_spans(gold).alias("g"), distinct_spans(pred).alias("p")), counted)


def flagged(gold: Column, pred: Column, allowed: list[str] | None = None) -> tuple[Column, Column]:
    """The flags of evaluate_spans for spans held in arrays beside each other: nothing is shuffled."""
    meet = lambda g, p: (g["start"] < p["end"]) & (p["start"] < g["end"])
    same = lambda g, p: (g["start"] == p["start"]) & (g["end"] == p["end"])
    named = lambda s: [s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")]
    g, p = distinct_spans(gold), distinct_spans(pred)
    scoped = F.filter(p, lambda x: x["label"].isin(allowed)) if allowed is not None else p

    def golds(near: Column, s: Column) -> Column:
        return F.struct(*named(s), (F.size(near) > 0).alias("covered"), F.exists(near, lambda x: x["label"] == s["label"]).alias("typed"), F.exists(near, lambda x: same(s, x) & (x["label"] == s["label"])).alias("strict"))

    def preds(near: Column, s: Column) -> Column:
        return F.struct(*named(s), (F.size(near) > 0).alias("covered"), F.exists(near, lambda x: same(s, x) & (x["label"] == s["label"])).alias("strict"), F.exists(near, lambda x: same(s, x)).alias("bounds"))

    flags = lambda own, others, made: let(others, lambda o: F.transform(own, lambda s: let(F.filter(o, lambda x: meet(s, x)), lambda near: made(near, s))))
    return flags(g, p, golds), flags(scoped, g, preds)


def axis_score(span: Column, leak: Column, seconds: Column, risk: Column | None = None, utility: Column | None = None) -> Column:
    """Weighted mean of the axes there are; runtime is 1 / (1 + seconds / 12)."""
    parts = [(span, 0.35 if risk is not None else 0.5), (leak, 0.3 if risk is not None else 0.4), (1 / (1 + seconds / 12), 0.1)]
    parts += [(risk, 0.25)] if risk is not None else []
    parts += [(utility, 0.1)] if utility is not None else []
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.round(sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0)) / total, 6)


def _bleu(original: str | None, changed: str | None) -> float:
    if not original or not changed:
        return 0.0
    if original == changed:
        return 1.0
    if not changed.split():
        return 0.0
    ref, hyp = original.split(), changed.split()
    hits = total = 0
    for n in (1, 2):
        a, b = (Counter(zip(*[w[k:] for k in range(n)], strict=False)) for w in (ref, hyp))
        hits += (a & b).total()
        total += max(0, len(hyp) - n + 1)
    penalty = math.exp(1 - len(ref) / len(hyp)) if len(hyp) < len(ref) else 1.0
    return round(penalty * hits / total, 4)


def _bleu_all(original: pd.Series, changed: pd.Series) -> pd.Series:
    return pd.Series([_bleu(a, b) for a, b in zip(original, changed, strict=True)], dtype="float64")


def bleu(original: Column, changed: Column) -> Column:
    """Clipped precision of words and word pairs together, with a brevity penalty. Counting is linear in the text."""
    return F.pandas_udf(_bleu_all, T.DoubleType())(original, changed)
