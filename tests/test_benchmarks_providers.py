"""Benchmark registry, file masking and model hooks."""

import json

import pytest
from pyspark.sql import functions as F

from scrubline.operators import providers
from scrubline.sources import benchmarks


def _write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_names_and_splits(spark, tmp_path):
    assert [benchmarks.canonical(x) for x in (" DB-bio", "json", "Reddit", "tab", "other")] == ["dbbio", "anonymization", "personalreddit", "tab", "other"]
    assert [benchmarks.split_of(x) for x in ("a/train.txt", "cleanconll.dev", "valid.txt", "x.test", "what", "train")] == ["train", "dev", "dev", "test", "test", "train"]
    with pytest.raises(ValueError, match="unknown"):
        benchmarks.load(spark, "nope", str(tmp_path))
    with pytest.raises(ValueError, match="already"):
        benchmarks.register("db-bio", benchmarks.REGISTRY["tab"])


def test_loading_by_name(spark, tmp_path):
    _write(tmp_path / "DB-bio/test.jsonl", [{"wiki_name": "Ann_Lee", "people": None, "text": "Ann Lee"}])
    docs, title = benchmarks.load(spark, "db-bio", str(tmp_path), split="train")
    assert title == "DB-bio/test" and [tuple(s) for s in docs.first()["spans"]] == [(0, 7, "PERSON")]
    _write(tmp_path / "PersonalReddit/Reddit_synthetic/test.jsonl", [{"response": "x 31", "personality": {"age": "31"}}])
    docs, title = benchmarks.load(spark, "reddit", str(tmp_path), split="dev")
    assert title == "PersonalReddit/dev" and docs.count() == 1


def test_scope_and_status(spark, tmp_path):
    spans = spark.createDataFrame([("PER",), ("person",), ("EMAIL",)], "label string")
    assert [benchmarks.in_scope(spans, n).count() for n in ("dbbio", "cleanconll2003", "tab")] == [2, 1, 3]
    cases = {"official_offsets": {"entities": [{"start": 0, "end": 1, "label": "X"}]}, "converted_no_offsets": {"meta": {"masked_entities": ["a"]}}, "unknown_schema": {"text": "a"}}
    for k, (status, row) in enumerate(cases.items()):
        assert benchmarks.annotation_status(spark, _write(tmp_path / f"{k}.jsonl", [row])) == status


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("secret\ntext")
    out = benchmarks.mask_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda d: d.withColumn("masked", F.replace("text", F.lit("secret"), F.lit("***"))))
    assert [(r["doc_id"].rsplit("/", 1)[1], r["text"]) for r in out.collect()] == [("a.txt", "***\ntext")]


def test_chat_repairs_falls_back_and_isolates(spark):
    class Stubborn:  # here, so that it is sent by value: workers don't have this module
        """Broken JSON at first, then what is asked for."""

        def chat(self, prompt):
            if prompt == "boom":
                raise OSError("down")
            return '{"n": 1}' if "not valid" in prompt else "{"

    rows = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "id int, prompt string")
    found = {r["id"]: (r["response"], r["attempts"], r["error"]) for r in providers.chat(rows, Stubborn(), lambda x: x["n"], fallback=0).collect()}
    assert found == {1: ("1", 2, None), 2: ("0", 1, "OSError: down"), 3: (None, 0, None)}
    mock = {r["id"]: (r["response"], r["error"]) for r in providers.chat(rows, providers.Mock({"a": "[1]"})).collect()}
    assert mock == {1: ("[1]", None), 2: (None, "no answer"), 3: (None, None)}


def test_budget_and_secrets():
    assert providers.prompt_budget(None) == int((8192 - 4096 - 500) * 3.5)
    assert providers.prompt_budget(8192, reasoning=3.0) == 3500
    assert providers.secrets({}, False) == ("dev-secret", "dev-salt")
    with pytest.raises(ValueError):
        providers.secrets({"secret": "s"}, True)
    assert providers.secrets({"secret": "s", "salt": "t"}, True) == ("s", "t")
