"""Attribute attacks and candidate rankings of models with what tables say in their place."""

import json

from pyspark.sql import functions as F

from scrubline.operators import attackers


def test_answers_go_into_the_next_prompts(spark, tmp_path):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    docs = spark.createDataFrame([(1, "a", "x"), (None, None, None), (1, "a", "y"), (2, "", "z")], "doc_id bigint, text string, own string")
    prompts = []

    def ask(asked):
        rows = asked.collect()
        prompts.append(sorted(r["prompt"] for r in rows))
        say = {"city": '{"value": " Lyon\\n"}', "job": "broken {", "age": '{"value": "  "}'}
        return spark.createDataFrame([(r["row"], say[r["attribute"]]) for r in rows if "Text: \n" not in r["prompt"]], "row bigint, response string")

    got = attackers.attack_attributes(docs, ["city", "job", "age"], ask, {"job": F.col("own"), "city": F.lit("Nice")}).collect()
    assert sorted((r["doc_id"] or 0, r["own"] or "") for r in got) == [(0, ""), (1, "x"), (1, "y"), (2, "z")]
    for r in got:
        assert [(k["attribute"], k["value"], k["source"]) for k in r["known"]] == [("city", "Lyon", "model"), ("job", r["own"], "structured" if r["own"] else "none"), ("age", None, "none")]
    assert len(prompts) == 3 and prompts[2][0].startswith("Attribute: age\nKnown: city=Lyon; job=")
    assert attackers.attack_attributes(docs.limit(0), ["city"], ask, {}).count() == 0


def test_rankings_are_completed(spark):
    cases = [(json.dumps({"ranking": ["c", "a", "c", "zz"]}), ["c", "a", "b", "d"], "model"), ("no", ["a", "b", "c", "d"], "structured"), (None, ["a", "b", "c", "d"], "structured"), (json.dumps({"ranking": []}), ["a", "b", "c", "d"], "structured"), (json.dumps({"ranking": "a"}), ["a", "b", "c", "d"], "structured")]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, r string")
    got = {r["k"]: r["m"] for r in df.select("k", attackers.model_ranking(F.col("r"), F.array(*[F.lit(x) for x in "abcd"])).alias("m")).collect()}
    for k, (_, ranking, source) in enumerate(cases):
        assert got[k]["ranking"] == ranking and got[k]["source"] == source
    assert attackers.model_ranking(F.lit("x"), F.array(*[F.lit(x) for x in "abcdefg"])) is not None
