"""Corpus statistics: diversity, lengths, coverage, duplicates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.functions.grams import distinct_grams
from scrubline.plans.registry import query

_TOKENS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"


def tokens(c):
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def ngrams(words, n):
    def own(t):
        at = F.sequence(F.lit(1), F.size(t) - n + 1)
        return F.when(F.size(t) >= n, F.transform(at, lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), own)[0]  # the words are found once for a text, not for each place


for _n in (1, 2, 3):
    query(f"""SELECT {_n} AS n, count(*) AS total, count(DISTINCT g) AS uniques, round(count(DISTINCT g) / count(*), 4) AS ratio FROM (SELECT unnest(list_transform(range(1, len(t) - {_n} + 2), lambda i: array_to_string(t[i:i+{_n - 1}], ' '))) AS g FROM (SELECT {_TOKENS} AS t FROM documents))""", f"distinct_{_n}")(
        lambda t, n=_n: distinct_grams(t("documents").select(F.lit(0).alias("group"), tokens(F.col("text")).alias("w")), n).agg(F.lit(n).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("uniques"), F.lit(0)).alias("uniques")).withColumn("ratio", F.round(F.try_divide("uniques", "total"), 4))
    )


@query(f"SELECT lang, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS sd, min(n) AS least, max(n) AS most, round(quantile_cont(n, 0.5), 4) AS median FROM (SELECT lang, len({_TOKENS}) AS n FROM documents) GROUP BY lang")
def length_stats(t):
    d = t("documents").select("lang", F.size(tokens(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_pop("n"), 4).alias("sd"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.percentile("n", 0.5), 4).alias("median"))


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT sum(n) AS total, count(*) AS filled FROM c) SELECT (SELECT filled FROM s) AS filled, (SELECT count(DISTINCT lang) * count(DISTINCT source) FROM documents) AS cells, round((SELECT filled FROM s) / (SELECT count(DISTINCT lang) * count(DISTINCT source) FROM documents), 4) AS coverage, round(-sum(n / total * ln(n / total)) / ln(max(filled)), 4) AS evenness FROM c, s")
def cell_coverage(t):
    d = t("documents")
    c = d.groupBy("lang", "source").agg(F.count("*").alias("n"))
    # One row on either side.
    s = c.agg(F.sum("n").alias("total"), F.count("*").alias("filled"), F.countDistinct("lang").alias("a"), F.countDistinct("source").alias("b"))
    return c.crossJoin(s).agg(F.max("filled").alias("filled"), F.max(F.col("a") * F.col("b")).alias("cells"), F.round(F.max(F.col("filled") / (F.col("a") * F.col("b"))), 4).alias("coverage"), F.round(-F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") / F.col("total"))) / F.ln(F.max("filled")), 4).alias("evenness"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 5")
def top_cells(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source").limit(5)


@query("SELECT count(*) AS n, count(DISTINCT text) AS uniques, count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (text IS NULL OR text = '') AS missing FROM documents")
def duplicates(t):
    d = t("documents")
    own = F.countDistinct(F.sha2("text", 256))  # digests are dealt out, not whole texts
    return d.agg(F.count("*").alias("n"), own.alias("uniques"), (F.count("*") - own).alias("duplicates"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("missing"))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY event_type")
def freq_share(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))


@query("SELECT round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem")
def pearson(t):
    return t("lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 4).alias("r"))



@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), l AS (SELECT vec_id, sqrt(sum(x * x)) AS len FROM v GROUP BY 1), s AS (SELECT k, sum(x / len) AS x FROM v JOIN l USING (vec_id) GROUP BY k), n AS (SELECT count(*) AS n FROM embeddings) SELECT round(1 - (sum(x * x) - max(n)) / (max(n) * (max(n) - 1)), 4) AS dispersion FROM s, n")
def embedding_dispersion(t):
    """One partial aggregation over positions; lengths are found in the row."""
    unit = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x))
    v = t("embeddings").select(unit.alias("u"), length.alias("len")).select(F.posexplode(F.transform("u", lambda x: x / F.col("len"))).alias("k", "x"))
    s = v.groupBy("k").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return s.agg(F.round(1 - (F.sum(F.col("x") * F.col("x")) - F.max("n")) / (F.max("n") * (F.max("n") - 1)), 4).alias("dispersion"))
