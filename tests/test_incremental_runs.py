"""Resume, cache, isolation, patches, runs and census files, against results written out by hand."""

import difflib
import os
import re
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scrubline.operators import incremental
from scrubline.sources import census, linediff, runs


def test_stage_resumes_by_version_and_model(spark, tmp_path):
    path, seen = str(tmp_path / "stage"), []

    def work(todo):
        seen.append(sorted(r[0] for r in todo.select("item_id").collect()))
        return todo.withColumn("result", F.upper("item_id"))

    items = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "item_id string")
    assert incremental.run_stage(items, work, path, "v1", "m").count() == 2
    more = items.union(spark.createDataFrame([("c",)], "item_id string"))
    done = incremental.run_stage(more, work, path, "v1", "m")
    assert sorted(r["result"] for r in done.collect()) == ["A", "B", "C"]
    incremental.run_stage(items, work, path, "v2", "m")
    assert seen == [["a", "b"], ["c"], ["a", "b"]]


def test_cache_asks_equal_requests_once_and_no_failures(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def answer(todo):
        asked.append(sorted(r[0] for r in todo.select("prompt").collect()))
        return todo.select("cache_key", F.when(F.col("prompt") != "bad", F.upper("prompt")).alias("response"))

    rows = spark.createDataFrame([(1, "s", "m", "v", 0.1, "x"), (2, "s", "m", "v", 0.1, "x"), (3, "s", "m", "v", 0.1, "bad")], "id int, step string, model string, version string, temperature double, prompt string")
    first = {r["id"]: (r["response"], r["cache_hit"]) for r in incremental.through_cache(rows, answer, path).collect()}
    again = {r["id"]: (r["response"], r["cache_hit"]) for r in incremental.through_cache(rows, answer, path).collect()}
    assert first == {1: ("X", False), 2: ("X", False), 3: (None, False)}
    assert again == {1: ("X", True), 2: ("X", True), 3: (None, False)}
    assert asked == [["bad", "x"], ["bad"]]


def test_one_failing_row_leaves_the_others(spark):
    docs = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "doc_id int, text string")
    out = incremental.map_isolated(docs, lambda r: {"n": int(r["text"])}, StructType([StructField("n", IntegerType())]))
    found = {r["doc_id"]: r for r in out.collect()}
    assert found[1]["n"] == 4 and found[1]["error"] is None
    assert found[2]["n"] is None and found[2]["error"].startswith("ValueError")
    assert found[3]["error"].startswith("TypeError")


def test_slow_rows_time_out_and_kept_columns_stay(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a", [1]), (None, "sleep", None), (big + 2, "b", []), (1, "leave", [3]), (2, "bad", [4]), (3, "c", [5])], "doc_id bigint, text string, more array<int>").coalesce(1)

    def work(row):
        if row["text"] == "sleep":
            time.sleep(60)
        if row["text"] == "leave":
            os._exit(3)
        return {"n": "x" if row["text"] == "bad" else len(row["text"])}

    told = Observation()
    began = time.time()
    out = incremental.map_isolated(docs, work, StructType([StructField("n", IntegerType())]), limit=1.5, progress=told)
    assert out.drop("error").schema[:3] == docs.schema[:3]
    found = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert time.time() - began < 40
    assert {k: r["n"] for k, r in found.items()} == {(big, "a"): 1, (None, "sleep"): None, (big + 2, "b"): 1, (1, "leave"): None, (2, "bad"): None, (3, "c"): 1}
    assert found[None, "sleep"]["error"].startswith("timeout:") and "process ended" in found[1, "leave"]["error"] and found[2, "bad"]["error"].startswith("Arrow")
    assert [found[k]["more"] for k in ((big, "a"), (None, "sleep"), (big + 2, "b"))] == [[1], None, []]
    assert told.get == {"rows": 6, "failed": 3, "timeouts": 1}


def normal_diff(a, b):
    """A patch in normal format, by difflib."""
    span = lambda i, j: str(i + 1) if j - i == 1 else f"{i + 1},{j}"
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "insert":
            out += [f"{i}a{span(k, m)}", *[f"> {x}" for x in b[k:m]]]
        elif op == "delete":
            out += [f"{span(i, j)}d{k}", *[f"< {x}" for x in a[i:j]]]
        elif op == "replace":
            out += [f"{span(i, j)}c{span(k, m)}", *[f"< {x}" for x in a[i:j]], "---", *[f"> {x}" for x in b[k:m]]]
    return "\n".join(out)


def table(spark, lines):
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no bigint, line string")


@pytest.mark.parametrize("a, b", [("a b c d e", "a x c e f"), ("a b c", "n m a b c"), ("a b c d", "d"), ("", "p q"), ("p p p", "p q p p")])
def test_patch_gives_the_new_lines(spark, a, b):
    a, b = a.split(), b.split()
    out = linediff.apply_patch(table(spark, a), linediff.parse_patch(normal_diff(a, b))).orderBy("line_no").collect()
    assert [r["line"] for r in out] == b and [r["line_no"] for r in out] == list(range(1, len(b) + 1))


def test_patch_must_fit(spark):
    with pytest.raises(ValueError):
        linediff.parse_patch("nonsense")
    with pytest.raises(ValueError):
        linediff.parse_patch("1c1\n< a\n> b")
    with pytest.raises(Exception, match="doesn't fit line 1"):
        linediff.apply_patch(table(spark, ["z"]), linediff.parse_patch("1c1\n< a\n---\n> b")).collect()


def test_annotations_take_the_tokens(spark):
    out = linediff.merge_annotations(table(spark, ["Ann", "", "x"]), table(spark, ["_\tP\tQ\tR\tB-PER", "", ""])).orderBy("line_no").collect()
    assert [r["line"] for r in out] == ["Ann\tP\tQ\tR\tB-PER", "", "x"]
    with pytest.raises(Exception, match="differ in number"):
        linediff.merge_annotations(table(spark, ["a"]), table(spark, ["", ""])).collect()
    with pytest.raises(Exception, match="not an annotation line"):
        linediff.merge_annotations(table(spark, ["a"]), table(spark, ["a\tb"])).collect()


def test_runs_keep_earlier_ones(spark, tmp_path):
    docs = spark.createDataFrame([("d", 0.5)], "doc_id string, score double")
    meta = {"created_at": "2025-12-12T10:11:12+00:00", "pipeline": "My Pipe", "dataset": {"name": "A/B"}}
    names = [runs.save_run(docs, str(tmp_path), meta, "Try 1").rsplit("/", 1)[1] for _ in range(3)]
    assert names == ["try-1_20251212101112_my-pipe_a-b" + s for s in ("", "_2", "_3")]
    assert runs.list_runs(spark, str(tmp_path)) == sorted(names, reverse=True)
    assert runs.list_runs(spark, str(tmp_path / "none")) == []


def test_variants_and_summary(spark):
    rows = spark.createDataFrame([("a", 0, 0.5), ("b", 1, None), ("c", 2, 0.75)], "variant string, at int, primary_metric double")
    ranked = {r["variant"]: (r["place"], r["delta_vs_first"]) for r in runs.rank_variants(rows).collect()}
    assert ranked == {"a": (2, 0.0), "b": (3, None), "c": (1, 0.25)}
    text = runs.markdown_table(runs.rank_variants(rows), ["variant", "primary_metric"], ["place"], ("primary_metric",))
    assert re.split("\n", text)[:3] == ["| variant | primary_metric |", "| --- | ---: |", "| c | 0.7500 |"]
    docs = spark.createDataFrame([("x", 1.0, None), ("x", 0.0, None), ("y", 9.0, "boom")], "level string, score double, error string")
    found = {(r["axis"], r["value"]): (r["documents"], r["errors"], r["score"]) for r in runs.summarise(docs, ["level"], ["score"]).collect()}
    assert found == {("all", None): (2, 1, 0.5), ("level", "x"): (2, 0, 0.5), ("level", "y"): (0, 1, None)}


def test_census_decodes_once(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "psam_pa.csv").write_text("EXTRA,SERIALNO,PWGTP,SEX,OCCP\n1,0001,12,1,10\n2,0002,x,9,\n")
    got = census.load_population(spark, str(tmp_path / "pop"), f"{folder}/psam_p*.csv", {"SEX": {1: "Male", 2: "Female"}})
    assert got.columns == ["SERIALNO", "PWGTP", "sex", "occupation"]
    assert sorted(map(tuple, got.collect())) == [("0001", 12, "Male", "10"), ("0002", None, None, None)]
    (folder / "psam_pa.csv").unlink()
    assert census.load_population(spark, str(tmp_path / "pop")).count() == 2
    assert census.load_population(spark, str(tmp_path / "other")) is None
