"""Every query with SQL against DuckDB on the smallest tables, and operators that have none."""

import glob
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from scrubline.functions import patterns
from scrubline.operators import deidentify, detection, diversity, providers, reports, settings
from scrubline.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "none"
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.6g}"
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want


def test_json_of_answers(spark):
    answers = ['{"a": 1}', 'Sure: ```json\n{"a": [1, 2]}\n``` ok', '```json\n{"a": "cut', "text [1, {\"b\": 2", '{"a": 1,', "none", None, '{"a": "x\\\\"}']
    got = [r[0] for r in spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string").orderBy("k").select(providers.json_of("a")).collect()]
    assert [g and json.loads(g) for g in got] == [{"a": 1}, {"a": [1, 2]}, {"a": "cut"}, [1, {"b": 2}], {"a": 1}, None, None, {"a": "x\\"}]


def test_user_rules(tmp_path, spark):
    spec = {"patterns": {"b": {"regex": "x(\\d+)", "priority": 2, "group_index": 1}, "a": {"regex": "yy", "entity_type": "Y", "priority": 1}, "bad": {"regex": "("}, "off": {"regex": "z", "enabled": False}}}
    (tmp_path / "rules.json").write_text(json.dumps(spec))
    rules = patterns.read_rules(str(tmp_path / "rules.json"))
    assert [(r.name, r.label, r.group, r.enabled) for r in rules] == [("a", "Y", 0, True), ("b", "B", 1, True), ("off", "OFF", 0, False)]
    row = spark.createDataFrame([("x12 yy z",)], "t string").select(detection.deterministic(F.col("t"), rules).alias("s")).first()
    assert [(s["start"], s["end"], s["label"]) for s in row["s"]] == [(1, 3, "B"), (4, 6, "Y")]


def test_models_by_name(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    one = lambda d: d.where("doc_id = 1").select("doc_id", F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("per").alias("label"), F.col("text").alias("value"), F.lit("m").alias("source"), F.lit(1.0).alias("score"))).cast("array<struct<start:int,end:int,label:string,value:string,source:string,score:double>>").alias("spans"))
    assert {r["doc_id"]: len(r["model_spans"]) for r in detection.run_model(docs, {"m": one}, "m").collect()} == {1: 1, 2: 0}
    assert {len(r["model_spans"]) for r in detection.run_model(docs, {}, "m").collect()} == {0}


def test_settings():
    assert settings.profile("auto", "RAT-Bench").name == "ratbench_privacy" and settings.profile(None, "nothing").name == "production_pii"
    with pytest.raises(ValueError):
        settings.profile("none")
    off = settings.normalised({"enable_llm_audit": 1, "rupta_enabled": True, "disable_llm": True, "eval_mode": "BOTH"})
    assert off["llm_audit"] is False and off["rupta_enabled"] is False and off["eval_mode"] == "both"
    run = settings.for_dataset({"masking_mode": "production"}, "tab")
    assert run["profile"] == "tab_legal" and run["masking_profile"] == "production_pii" and run["anon_policy"]["EMAIL"] == "mask"
    assert settings.for_dataset({"anon_policy": {"X": "mask"}}, "conll2003")["anon_policy"] == {"X": "mask"} and settings.for_dataset({}, "conll2003")["entity_profile"] == "news_ner"


def test_adversarial_loop(spark, tmp_path):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    docs = spark.createDataFrame([(1, "xxxx"), (2, "x"), (3, ""), (None, "xx"), (None, "xxx"), (4, "xx"), (4, "xx"), (2**60 + 1, None)], "doc_id bigint, text string")
    audit = lambda d: d.withColumn("privacy_score", F.length("text") * 10)
    rewrite = lambda d: d.select("row", F.substring("text", F.lit(2), F.length("text")).alias("text"))
    got = sorted(((r["doc_id"], r["text"], r["iteration"]) for r in deidentify.adversarial_loop(docs, audit, rewrite).collect()), key=str)
    assert got == sorted([(1, "x", 3), (2, "x", 0), (3, "", 0), (None, "x", 1), (None, "x", 2), (4, "x", 1), (4, "x", 1), (2**60 + 1, None, 0)], key=str)
    assert {r["doc_id"]: r["iteration"] for r in deidentify.adversarial_loop(docs, audit, rewrite, most=1).collect()}[1] == 1


def test_vendi_of_known_vectors(spark):
    same = spark.createDataFrame([([1.0, 0.0],)] * 5, "embedding array<double>")
    apart = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 2.0, 0.0],), ([0.0, 0.0, 3.0],)], "embedding array<double>")
    assert diversity.vendi(same).first()[0] == pytest.approx(1, abs=1e-6) and diversity.vendi(apart).first()[0] == pytest.approx(3, abs=1e-6)
    assert diversity.vendi(same.limit(0)).first()[0] == 0


def test_reports_in_three_forms(spark, tmp_path):
    for k, payload in enumerate(({"meta": {}, "data": [{"doc_id": "a"}]}, {"x": 1, "details": [{"doc_id": "a"}]}, [{"doc_id": "a"}])):
        (tmp_path / f"{k}.json").write_text(json.dumps(payload))
        assert [r["doc_id"] for r in reports.read_report(spark, str(tmp_path / f"{k}.json"), "doc_id string").collect()] == ["a"]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="not an evaluation report"):
        reports.read_report(spark, str(tmp_path / "bad.json"), "doc_id string").collect()
    got = reports.inventory(spark, str(tmp_path), ["0.json", "none.json"]).collect()
    assert [r["present"] for r in got] == [True, False]
    page, text = reports.report_page("R", {"Spans": {"f1": 0.5, "risk": None, "<b>": 1}})
    assert "&lt;b&gt;" in page and "- risk: n/a" in text
    assert reports.utility_proxy("tab")["status"] == "not_applicable" and reports.utility_proxy("dbbio", 3)["status"] == "proxy"
