"""Readers, writers and profiles on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrubline.functions.similarity import jaro
from scrubline.plans.profile_queries import minhash
from scrubline.sources import loaders, sinks


def _lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def _found(df):
    return {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in df.collect()}


def test_masked_entities(spark, tmp_path):
    path = _lines(tmp_path / "a.jsonl", [{"doc_id": "x", "text": "aaa é aa", "meta": {"masked_entities": ["aa"]}}, "", {"doc_id": "y", "text": None, "meta": None}])
    assert _found(loaders.load_masked_entities(spark, path)) == {"x": [(0, 2, "SENSITIVE"), (1, 3, "SENSITIVE"), (6, 8, "SENSITIVE")], "y": []}
    assert loaders.load_masked_entities(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(Exception):
        loaders.load_masked_entities(spark, _lines(tmp_path / "bad.jsonl", ["{bad"])).collect()
    assert loaders.read_sample(spark, _lines(tmp_path / "s.jsonl", ["{bad", *[{"a": k} for k in range(30)]]), "a int").count() == 25


def test_biographies(spark, tmp_path):
    rows = [{"wiki_name": "Ann_Lee", "people": None, "text": "ann lee met Ann Lee"}, {"wiki_name": "B", "people": ["Bo Fox", "Cy"], "text": "Bo the old Fox and cy"}]
    assert _found(loaders.load_biographies(spark, _lines(tmp_path / "b.jsonl", rows))) == {"Ann_Lee": [(12, 19, "PERSON")], "B": [(0, 14, "PERSON"), (19, 21, "PERSON")]}


def test_profiles(spark, tmp_path):
    rows = [{"response": "I am 31 in Oslo, oslo", "personality": {"age": "31", "city_country": "Oslo", "sex": "unknown", "pet": "I"}}, "{bad", "", {"response": "", "personality": {}}, {"response": "x", "personality": None}]
    got = _found(loaders.load_profiles(spark, _lines(tmp_path / "p.jsonl", rows)))
    assert (5, 7, "AGE") in got["personalreddit_0"] and (17, 21, "LOCATION") in got["personalreddit_0"] and (0, 1, "SENSITIVE_ATTR") in got["personalreddit_0"]
    assert got["personalreddit_4"] == [] and len(got) == 2


def test_examples_and_levels(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"examples": [{"id": "1", "original_text": "ab", "annotations": [{"type": "T", "start": 1, "end": 2}, {"type": "S", "start": 0, "end": 1}]}, {"id": "2", "original_text": "", "annotations": None}]}, indent=1))
    assert _found(loaders.load_examples(spark, str(tmp_path / "e.json"))) == {"1": [(0, 1, "S"), (1, 2, "T")], "2": []}
    (tmp_path / "r.json").write_text(json.dumps([{"id": k, "difficulty": k % 2, "text": " " if k == 3 else "t"} for k in range(6)]))
    assert sorted(r["doc_id"] for r in loaders.load_levelled_profiles(spark, str(tmp_path / "r.json"), 1).collect()) == ["ratbench_1_L1", "ratbench_5_L1"]


def test_columns(spark, tmp_path):
    rows = ["-DOCSTART- -X- -X- O", "", "EU NNP B-NP B-ORG", "rejects V O O", "Ann N N B-PER", "Lee N N I-PER", "Oslo N N I-LOC", "", "", "Bo N N B-PER", "Cy N N B-PER"]
    got = _found(loaders.load_columns(spark, _lines(tmp_path / "c.txt", rows)))
    assert got == {"0": [(0, 2, "ORG"), (11, 18, "PER"), (19, 23, "LOC")], "1": [(0, 2, "PER"), (3, 5, "PER")]}
    with pytest.raises(Exception):
        loaders.load_columns(spark, _lines(tmp_path / "d.txt", ["a b"])).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", "héllo", [(0, 2, "A", 0.5), (3, 5, "B", 1.0)], {"k": 1})], "doc_id string, text string, spans array<struct<start:int,end:int,label:string,score:double>>, m map<string,int>")
    nested = df.withColumn("o", F.struct(F.struct(F.lit(1).alias("y")).alias("x"), F.lit(None).cast("string").alias("z")))
    flat = sinks.flatten(nested)
    assert flat.columns == ["doc_id", "text", "spans", "m", "o.x.y", "o.z"] and json.loads(flat.first()["spans"])[1]["label"] == "B"
    assert list(sinks.export_parquet({"a": nested, "b": nested.limit(0)}, str(tmp_path / "out"))) == ["a"]
    sinks.write_jsonl(nested.select("text", "doc_id"), str(tmp_path / "j"), sort_keys=True)
    sinks.write_jsonl(nested.select("text", "doc_id"), str(tmp_path / "j"), mode="append")
    assert spark.read.text(str(tmp_path / "j")).count() == 2
    assert [r["snippet"] for r in sinks.mentions(df).orderBy("mention").collect()] == ["hé", "lo"]
    assert sinks.review_tasks(df).first()["score"] == 0.75
    reviews = spark.createDataFrame([("d", 1, []), ("d", 2, [(1, 2, "C", 1.0)])], "doc_id string, at int, spans array<struct<start:int,end:int,label:string,score:double>>")
    assert [s["label"] for s in sinks.apply_reviews(df, reviews).first()["spans"]] == ["C"]
    a, b = spark.createDataFrame([("x", 0.5)], "k string, f double"), spark.createDataFrame([("x", 0.7), ("y", 0.1)], "k string, f double")
    assert {r["k"]: r["f_delta"] for r in sinks.compare_runs(a, b, ["k"], ["f"]).collect()} == {"x": 0.2, "y": 0.1}


def test_hydrate(spark):
    out = loaders.hydrate(spark.createDataFrame([("a", 1)], "name string, extra int"), StructType.fromDDL("name string, age int")).first()
    assert out["name"] == "a" and out["age"] is None and json.loads(out["metadata_unknown"]) == {"extra": 1}


def test_jaro_and_minhash(spark):
    assert round(jaro("martha", "marhta"), 4) == 0.9444 and round(jaro("dixon", "dicksonx"), 4) == 0.7667 and jaro("", "a") == 0 and jaro("", "") == 1
    assert round(jaro("abcdefgh", "bcadefgh"), 4) == 0.9375  # three characters out of order: one and a half transpositions
    got = [r["s"] for r in spark.createDataFrame([("a b c d",), ("a b",), ("",)], "t string").select(minhash(F.col("t"), 4).alias("s")).collect()]
    assert len(got[0]) == 4 and got[2] == ["1" + "0" * 16] * 4 and got[0] != got[1]


@pytest.mark.parametrize("size", ["128m", "200"])
def test_one_file_in_many_splits(spark, tmp_path, size):
    """Numbers of lines, sentences across the bounds of splits and empty lines are those of the whole file."""
    rnd = random.Random(8)
    lines = []
    for _ in range(120):
        lines += ["" if rnd.random() < 0.1 else " "] * rnd.randint(1, 3) + [rnd.choice(["-DOCSTART- -X- O O", ""])] if rnd.random() < 0.5 else [""]
        lines += [f"{rnd.choice(['Anna', 'é', 'x' * rnd.randint(1, 90)])} NN I-NP {rnd.choice(['O', 'B-PER', 'I-PER', 'I-LOC'])}" for _ in range(rnd.randint(0, 6))]
    (tmp_path / "c.txt").write_text("\n".join(lines))
    want, tokens, tags = [], [], []
    for line in [*lines, ""]:
        parts = line.split()
        if parts and parts[0] != "-DOCSTART-":
            tokens.append(parts[0])
            tags.append(parts[3])
        elif tokens:
            want.append((str(len(want)), " ".join(tokens), loaders.islands(tokens, tags)))
            tokens, tags = [], []
    records = [json.dumps({"response": f"I am {k}, a nurse", "personality": {"age": str(k), "occupation": "nurse"}}) if k % 7 else rnd.choice(["", "broken", "{}"]) for k in range(60)]
    (tmp_path / "p.jsonl").write_text("\n".join(records))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert (spark.read.text(str(tmp_path / "c.txt")).rdd.getNumPartitions() > 8) == (size == "200")
        got = loaders.load_columns(spark, str(tmp_path / "c.txt")).collect()
        people = loaders.load_profiles(spark, str(tmp_path / "p.jsonl")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["doc_id"], r["text"], [tuple(x) for x in r["spans"]]) for r in got) == sorted(want)
    assert sorted(r["doc_id"] for r in people) == sorted(f"personalreddit_{k}" for k in range(60) if k % 7)


def test_levelled_profiles_have_their_spans(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"id": 1, "difficulty": 2, "scenario": "s", "text": "Anna Lee, a Nurse in Ohio.", "features": [], "direct_identifiers": {"name": "Anna Lee", "email": "none"}, "indirect_identifiers": {"occupation": "nurse", "state of residence": "Ohio"}}]))
    got = loaders.load_levelled_profiles(spark, str(tmp_path / "r.json")).first()
    assert [tuple(s) for s in got["spans"]] == [(0, 8, "PERSON"), (12, 17, "DEMOGRAPHIC"), (21, 25, "LOCATION")]
