"""Composed texts, drafts of model answers, their checks and splits on rows with gaps."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from scrubline.operators import generation as G
from scrubline.plans import catalogue
from scrubline.plans.generator_queries import neighbours, split_of_group

PART = "array<struct<text: string, label: string, canonical_value: string>>"
PLAN = "array<struct<label: string, mode: string>>"
FORM = "array<struct<label: string, mode: string, snippet: string, cue_type: string>>"


def test_compose_takes_planned_forms_and_numbers_equal_snippets(spark):
    parts = [("  Je suis ", None, None), ("Eva", "PERSON_NAME", "Eva"), (None, None, None), (" et ", None, None), ("38 ans", "AGE_RANGE", "35-39"), (", ", None, None), ("Eva", "PERSON_NAME", "Eva"), ("\n\n", None, None)]
    rows = [(1, parts, [("PERSON_NAME", "explicit_hard"), ("AGE_RANGE", "implicit")], [("AGE_RANGE", "implicit", "bientôt quarante", "age")]), (2, [], [], []), (3, parts, [], [])]
    df = spark.createDataFrame(rows, f"k int, parts {PART}, plan {PLAN}, forms {FORM}")
    got = {r["k"]: r["d"] for r in df.select("k", G.compose(F.col("parts"), F.col("plan"), F.col("forms")).alias("d")).collect()}
    assert got[1]["text"] == "Je suis Eva et bientôt quarante, Eva"
    assert [(m["label"], m["snippet"], m["occurrence_hint"], m["difficulty_mode"], m["cue_type"]) for m in got[1]["grounding"]] == [("PERSON_NAME", "Eva", 1, "explicit_easy", ""), ("AGE_RANGE", "bientôt quarante", 1, "implicit", "age"), ("PERSON_NAME", "Eva", 2, "explicit_easy", "")]
    assert (got[2]["text"], got[2]["grounding"]) == ("", [])
    assert got[3]["text"] == "Je suis Eva et 38 ans, Eva"


def test_drafts_of_answers(spark):
    mention = lambda s, **more: {"label": "X", "snippet": s} | more
    answers = [
        (1, json.dumps({"text": " a b a a ", "grounding": [mention("a"), mention("b"), mention(" a ", occurrence_hint=3), mention("a"), {"label": "", "snippet": "a"}, {"label": "Y"}]})),
        (2, json.dumps({"variants": [{"text": ""}, {"text": "u", "notes": ["n"]}, {"text": "v"}]})),
        (3, "no json"),
        (4, None),
        (5, json.dumps({"variants": []})),
    ]
    rows = G.drafts(spark.createDataFrame(answers, "doc_id int, response string")).orderBy("doc_id", "variant").collect()
    assert [(r["doc_id"], r["variant"], r["text"], r["error"] is None) for r in rows] == [(1, 0, "a b a a", True), (2, 0, "u", True), (2, 1, "v", True), (3, 0, "", False), (4, 0, "", False), (5, 0, "", False)]
    assert [(m["snippet"], m["occurrence_hint"]) for m in rows[0]["grounding"]] == [("a", 1), ("b", 1), ("a", 3), ("a", 4)]
    assert rows[1]["notes"] == ["n"]


def test_issues_of_a_draft(spark):
    g = "array<struct<label: string, snippet: string, canonical_value: string, occurrence_hint: int, difficulty_mode: string, cue_type: string>>"
    df = spark.createDataFrame([("Eva a 38 ans à Lyon", [("AGE_RANGE", "38 ans", "38", 1, "implicit", ""), ("PERSON_NAME", "Eva", "Eva", 2, "explicit_easy", "")], [("TEAM", "support")], [("LOCATION", "Lyon"), ("LOCATION", "Lyo"), ("EMAIL", ""), ("TEAM", "Eva")])], f"t string, g {g}, p array<struct<label: string, snippet: string>>, o array<struct<label: string, value: string>>")
    got = df.select(G.draft_issues(F.col("t"), F.col("g"), F.col("p"), F.col("o"), F.array(F.lit("ROLE")))).first()[0]
    assert got == ["missing_planned_snippet:TEAM:support", "unresolved_grounding:PERSON_NAME:Eva", "difficulty_canonical_leak:AGE_RANGE", "implicit_missing_cue_type:AGE_RANGE", "unintended_leak:LOCATION"]


def test_register_before_outsiders(spark):
    df = spark.createDataFrame([("familier", "tu", "vendor_contact"), ("familier", "tu", "data_ops"), ("soutenu", "tu", "data_ops"), (None, "", "data_ops")], "r string, a string, who string")
    r, a = G.effective_register(F.col("r"), F.col("a"), F.col("who"))
    assert [tuple(x) for x in df.select(r, a).collect()] == [("courant", "vous"), ("familier", "tu"), ("soutenu", "vous"), ("courant", "vous")]


def test_no_authors_no_scenarios(spark):
    none = spark.createDataFrame([], "place long, person_id long, register string, address_form string, degree boolean, certificate boolean, rare boolean, sensitive array<string>, cues array<string>")
    assert G.scenarios(none, 5).count() == 0
    one = spark.createDataFrame([(0, 7, None, None, None, None, None, None, None)], none.schema)
    rows = G.scenarios(one, 50).collect()
    assert {r["author_id"] for r in rows} == {7} and not any(r["include_sensitive"] for r in rows)
    assert all(m["mode"] != "implicit" for r in rows for m in r["mention_plan"])


def test_split_of_group_over_many_ranges(spark):
    rows = [(k, k % 3 if k % 7 else None) for k in range(100, 400)]
    got = {r["person_id"]: r["split"] for r in split_of_group(spark.createDataFrame(rows, "person_id long, g int"), "g", in_range=16).collect()}
    for g in (0, 1, 2, None):
        mine = [k for k, x in rows if x == g]
        n = len(mine)
        assert [got[k] for k in mine] == ["train"] * int(n * 0.6) + ["dev"] * (int(n * 0.8) - int(n * 0.6)) + ["test"] * (n - int(n * 0.8))


def test_rings_in_arcs_equal_whole_rings(spark):
    people = spark.createDataFrame([(k, k % 2 if k % 11 else None) for k in range(3000)], "person_id long, g int")
    rows = lambda arc: sorted((r["person_id"], tuple(r["following"]), tuple(r["before"])) for r in neighbours(people, "g", 53, 9, arc).collect())
    assert rows(100) == rows(10**6) and len(rows(100)) == 3000


@pytest.mark.parametrize("name", ["structured_attack", "attack_metrics"])
@pytest.mark.parametrize("repeated", [False, True])
def test_attacks_make_no_rows_of_candidates(spark, tmp_path, name, repeated):
    data = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{data}/orders.parquet")
    if repeated:  # keys of two customers and of one, whole rows twice
        orders = orders.unionByName(orders.where("o_orderkey % 7 = 0").withColumn("o_custkey", F.col("o_custkey") + 1)).unionByName(orders.where("o_orderkey % 5 = 0"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    (tmp_path / "customer.parquet").symlink_to(f"{data}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'; CREATE VIEW customer AS SELECT * FROM '{data}/customer.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    found = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(found.fetchall())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Join") == 2  # of groups' sizes and of orders with what was found
