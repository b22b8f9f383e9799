"""Variants over data sets, coverage and flags, commands."""

from pyspark.sql import functions as F

from scrubline import __main__ as commands
from scrubline.operators import experiments
from scrubline.sources.runs import rank_variants


def test_variants_fail_alone_and_are_ranked(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id int, text string")

    def evaluate(d, settings):
        if settings.get("broken"):
            return d.select(F.raise_error(F.lit("this one fails")).cast("string").alias("x"))
        return d.agg((F.count("*") * settings["weight"]).cast("double").alias("primary_metric"), F.lit(settings["dataset_key"]).alias("key"))

    got = experiments.run_variants(spark, {"tab": docs, "dbbio": docs.limit(0)}, {"base": {"weight": 1}, "more": {"weight": 3}, "bad": {"broken": True}}, evaluate, str(tmp_path))
    rows = {(r["dataset"], r["variant"]): r for r in got.collect()}
    assert len(rows) == 6 and "this one fails" in rows["tab", "bad"]["error"] and rows["tab", "bad"]["path"] is None
    assert rows["tab", "base"]["error"] is None
    all_ = experiments.collected(spark, got)
    assert sorted((r["dataset"], r["variant"], r["primary_metric"], r["key"]) for r in all_.where("variant != 'bad'").collect()) == [("dbbio", "base", 0.0, "dbbio"), ("dbbio", "more", 0.0, "dbbio"), ("tab", "base", 2.0, "tab"), ("tab", "more", 6.0, "tab")]
    ranked = rank_variants(all_.where("dataset = 'tab'").join(got.select("dataset", "variant", "at"), ["dataset", "variant"]))
    assert [(r["variant"], r["delta_vs_first"]) for r in ranked.orderBy("place").collect()] == [("more", 4.0), ("base", 0.0)]


def test_coverage_counts_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k int")
    got = {r["name"]: (r["rows"], r["duplicates"]) for r in experiments.coverage({"a": (df, ["k"]), "none": (df.limit(0), ["k"]), "keyless": (df, [])}).collect()}
    assert got == {"a": (5, 2), "none": (0, 0), "keyless": (5, 0)}


def test_flags(spark):
    df = spark.createDataFrame([(0.95, 0.5, 0.7), (None, None, None)], "self_bleu double, distinct_2 double, cell_coverage double")
    assert [tuple(r) for r in experiments.flags(df).collect()] == [(True, False, False), (False, True, True)]


def test_commands(spark, tmp_path, capsys):
    assert commands.main(["queries"]) == 0 and "apply_masks" in capsys.readouterr().out.split()
    commands.main(["query", "generate_worlds", "/root/testdata/sf0.001", str(tmp_path / "w")], spark)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 100
    spark.createDataFrame([(1, "write to eva@example.org now"), (2, None)], "doc_id int, text string").write.parquet(str(tmp_path / "d"))
    commands.main(["mask", str(tmp_path / "d"), str(tmp_path / "m")], spark)
    rows = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert "eva@example.org" not in rows[1]["masked"] and rows[1]["n_masked"] == 1 and rows[2]["masked"] is None
