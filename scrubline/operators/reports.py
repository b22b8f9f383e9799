"""Tables of evaluation reports: runtime, runs of language models, judges, actions, filters, joins of artefacts, rendering."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.arrays import let


def runtime(report: DataFrame, elapsed: float) -> DataFrame:
    """Seconds a document, errors and timeouts (errors that say so) of a report with a column error (null or empty: none)."""
    failed = F.coalesce("error", F.lit("")) != ""
    n, errors = F.count("*"), F.count_if(failed)
    per = F.when(n > 0, F.lit(float(elapsed)) / n).otherwise(0.0)
    return report.agg(F.when(errors == 0, "ok").otherwise("partial").alias("status"), F.round(F.lit(float(elapsed)), 3).alias("elapsed_s"), n.alias("n_documents"), F.round(per, 4).alias("seconds_per_doc"), errors.alias("error_count"), F.when(n > 0, F.round(errors / n, 4)).otherwise(0.0).alias("error_rate"), F.count_if(failed & F.contains(F.lower("error"), F.lit("timeout"))).alias("timeout_count"))


def utility_proxy(dataset: str, n_labelled: int = 0, fields: Sequence[str] = ()) -> dict:
    """What is known of utility without a scorer: for biographies whether labels are there, nothing for others."""
    if dataset != "dbbio":
        return {"status": "not_applicable", "protocol": "not_applicable", "score": None}
    return {"status": "proxy" if n_labelled else "not_available", "protocol": "dbbio_label_metadata_proxy", "score": None, "n_labeled_documents": n_labelled, "label_fields": list(fields)}


def primary_metric(scores: DataFrame) -> DataFrame:
    """The plain mean of the data sets' scores; missing ones don't count."""
    return scores.agg(F.avg("score").alias("primary_metric"), F.count("score").alias("datasets"))


def model_runs(runs: DataFrame) -> DataFrame:
    """Count, mean and greatest latency, uses, fallbacks, cache hits and mean retries of each step."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{c}")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return runs.groupBy(F.coalesce("step_name", F.lit("unknown")).alias("step_name")).agg(F.count("*").alias("n"), F.round(F.avg(zero("latency_ms")), 1).alias("avg_ms"), F.max(zero("latency_ms")).alias("max_ms"), n("llm_used"), n("fallback_used"), n("cache_hit"), F.round(F.avg(zero("retry_count")), 2).alias("avg_retry"))


def judged(judgements: DataFrame) -> DataFrame:
    """Mean over a document's judges and the range between them, of those without an error. judgements: doc_id, judge,
    overall, error."""
    ok = F.when(F.coalesce("error", F.lit("")) == "", F.col("overall"))
    return judgements.groupBy("doc_id").agg(F.round(F.avg(ok), 3).alias("avg_overall"), F.round(F.max(ok) - F.min(ok), 3).alias("judge_range"), F.count(ok).alias("judges"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))


def sampled(docs: DataFrame, rate: float = 0.05, seed: int = 53, key: str = "doc_id") -> DataFrame:
    """floor(rate * n) documents, those with the least digest of seed and id: the same ones at every run and in any order."""
    n = int(docs.count() * rate)
    return docs.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(max(n, 0))


def actions_table(results: DataFrame) -> DataFrame:
    """How often each action was performed, and the mean gain and loss of the documents it was performed in."""
    return results.select(F.explode("actions_performed").alias("action"), "estimated_privacy_gain", "estimated_utility_loss").groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("estimated_privacy_gain"), 4).alias("avg_gain"), F.round(F.avg("estimated_utility_loss"), 4).alias("avg_loss"))


def filtered(report: DataFrame, recall: tuple[float, float] = (0.0, 1.0), leaking: bool = False, equals: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Documents with a recall in a range, only leaking ones on demand, and with one of the values chosen for each column."""
    out = report.where(F.coalesce("recall", F.lit(0.0)).between(*recall))
    out = out.where(F.coalesce("leaks_count", F.lit(0)) > 0) if leaking else out
    for c, values in (equals or {}).items():
        out = out.where(F.col(c).isin(*values)) if values else out
    return out


def with_texts(records: DataFrame, masked: DataFrame) -> DataFrame:
    """records (doc_id, text) with the masked text of their id, else of their text: of several the last by ``at``. Texts are
    joined by their digests."""
    last = lambda d, k: d.groupBy(k).agg(F.max_by("masked", "at").alias("_m"))
    digest = F.sha2("text", 256)
    by_id = last(masked.where("doc_id is not null"), "doc_id").withColumnRenamed("_m", "_by_id")
    by_text = last(masked.where("text is not null").withColumn("_d", digest), "_d").withColumnRenamed("_m", "_by_text")
    both = records.withColumn("_d", digest).join(by_id, "doc_id", "left").join(by_text, "_d", "left")
    return both.withColumn("masked", F.coalesce("_by_id", "_by_text")).drop("_d", "_by_id", "_by_text")


def attack_sources(structured: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """All attacks with where they are from."""
    out = structured.withColumn("source", F.lit("structured"))
    return out if model is None else out.unionByName(model.withColumn("source", F.lit("llm")), allowMissingColumns=True)


def preferred_attacks(attacks: DataFrame) -> DataFrame:
    """One attack a document: a model's before a structured one, of several the last pair."""
    return attacks.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in attacks.columns if c != "doc_id"]), F.struct((F.col("source") == "llm").cast("int"), "pair_id")).alias("a")).select("doc_id", "a.*")


def attack_success(attacks: DataFrame, pairs: DataFrame) -> DataFrame:
    """attacks with the target of their pair and whether it was named; a pair that isn't known, or has no target, never was."""
    targets = pairs.select("pair_id", F.col("target_person_id").alias("target"))
    return attacks.join(targets, "pair_id", "left").withColumn("success", F.coalesce(F.col("best") == F.col("target"), F.lit(False)))


def overlay(*maps: Column) -> Column:
    """Maps laid over each other; the later one's value counts."""
    out = maps[0]
    for above in maps[1:]:
        out = F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(above, k)), above)
    return out


def shown_value(value: Column, percent: bool = False) -> Column:
    """0.0 % with a decimal, or four places; n/a for what isn't a number."""
    number = value.try_cast("double")
    return F.when(number.isNull(), "n/a").otherwise(F.format_string("%.1f%%", number * 100) if percent else F.format_string("%.4f", number))


def span_categories(gold: Column, pred: Column) -> Column:
    """array<struct<start, end, label, category>> ordered by start: TP and FN true spans, FP predictions that meet none."""
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    of = lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), c.alias("category"))
    truth = F.transform(gold, lambda g: of(g, F.when(F.exists(pred, lambda p: meet(g, p)), "TP").otherwise("FN")))
    wrong = F.transform(F.filter(pred, lambda p: ~F.exists(gold, lambda g: meet(g, p))), lambda p: of(p, F.lit("FP")))
    return F.array_sort(F.concat(truth, wrong))


# Colours of the categories.
COLOURS = {"TP": ("#d4edda", "#28a745"), "FN": ("#f8d7da", "#dc3545"), "FP": ("#fff3cd", "#ffc107")}


def rendered(text: Column, spans: Column) -> Column:
    """HTML of a text with its categorised spans as coloured marks; where spans overlap, a missed one shows, else the later."""

    def drawn(s: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(F.array(F.lit(0), F.length(text)), F.transform(s, lambda x: x["start"]), F.transform(s, lambda x: x["end"]))), lambda e: (e >= 0) & (e <= F.length(text)))))

        def top(a: Column) -> Column:
            over = F.filter(s, lambda x: (x["start"] <= a) & (a < x["end"]))
            missed = F.filter(over, lambda x: x["category"] == "FN")
            return F.when(F.size(missed) > 0, F.try_element_at(missed, F.lit(1))).otherwise(F.try_element_at(over, F.lit(-1)))

        def pieces(e: Column) -> Column:
            return F.zip_with(F.slice(e, 1, F.size(e) - 1), F.slice(e, 2, F.size(e)), lambda a, b: F.struct(top(a).alias("s"), F.substring(text, a + 1, b - a).alias("t"), a.alias("a")))

        def joined(p: Column) -> Column:
            """Neighbouring pieces of one span are one mark."""
            same = lambda x, y: x["s"].eqNullSafe(y["s"])
            kind = "array<struct<s:struct<start:int,end:int,label:string,category:string>,t:string>>"
            return F.aggregate(p, F.array().cast(kind), lambda acc, x: F.when((F.size(acc) > 0) & same(F.try_element_at(acc, F.lit(-1)), x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x["s"].alias("s"), F.concat(F.try_element_at(acc, F.lit(-1))["t"], x["t"]).alias("t"))))).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["t"].alias("t"))))).cast(kind))

        def mark(x: Column) -> Column:
            out = x["t"]
            for c, (fill, border) in COLOURS.items():
                head = F.concat(F.lit(f'<span style="background-color: {fill}; border: 1px solid {border}; border-radius: 3px; padding: 0 2px;" title="{c}: '), x["s"]["label"], F.lit('">'))
                tail = F.concat(F.lit(' <span style="font-size: 0.7em; font-weight: bold; opacity: 0.7;">'), x["s"]["label"], F.lit("</span></span>"))
                out = F.when(x["s"]["category"] == c, F.concat(head, x["t"], tail)).otherwise(out)
            return out

        return F.array_join(F.transform(let(let(edges, pieces), joined), mark), "")

    return let(spans.cast("array<struct<start:int,end:int,label:string,category:string>>"), drawn)


def report_page(title: str, sections: Mapping[str, Mapping[str, object]]) -> tuple[str, str]:
    """HTML and Markdown of a report's sections, each a small mapping of measures."""
    e = lambda x: html.escape("n/a" if x is None else str(x))
    page = "".join(f"<h2>{e(s)}</h2><table>{''.join(f'<tr><td>{e(k)}</td><td>{e(v)}</td></tr>' for k, v in m.items())}</table>" for s, m in sections.items())
    lines = [f"# {title}", *(line for s, m in sections.items() for line in ("", f"## {s}", "", *(f"- {k}: {'n/a' if v is None else v}" for k, v in m.items())))]
    return f"<html><head><title>{e(title)}</title></head><body><h1>{e(title)}</h1>{page}</body></html>", "\n".join(lines) + "\n"


def read_report(spark: SparkSession, path: str, documents: str) -> DataFrame:
    """Documents of a JSON report in any of its three forms: {meta, data}, {..., details} or a bare list. documents: their
    DDL schema. Anything else is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    bare = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{documents}>>"))
    named = F.from_json("v", f"data array<struct<{documents}>>, details array<struct<{documents}>>")
    rows = F.coalesce(bare, named["data"], named["details"])
    return whole.select(F.explode(F.when(rows.isNull(), F.raise_error(F.lit("not an evaluation report"))).otherwise(rows)).alias("d")).select("d.*")


def inventory(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """name, path and whether it is there, of a run's expected artefacts."""
    from scrubline.sources.loaders import exists

    return spark.createDataFrame([(n, f"{folder}/{n}", exists(spark, f"{folder}/{n}")) for n in names], "name string, path string, present boolean")
