"""Catalogues, people who stay apart and the phrase library, against brute force."""

import hashlib
import json
import time
from bisect import bisect_right
from itertools import accumulate, combinations

import pytest
from pyspark.sql import functions as F

from scrubline.operators import annotation, catalogues, generation, templates

TABLE = [("city", None, "Lyon", 6), ("city", None, "Nice", 3), ("city", None, "Brest", 1), ("role", "Lyon", "chef", 5), ("role", "Lyon", "aide", 5), ("role", "Nice", "guide", 7), *[("years", None, str(k), 1 + k % 3) for k in range(40)], ("grade", None, "A", 1), ("grade", None, "B", 1)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(TABLE, catalogues.KIND)


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def point(seed, purpose, *index):
    return int(hashlib.md5(":".join([f"{seed}:{purpose}", *map(str, index)]).encode()).hexdigest()[:8], 16)


def picked(attribute, given, at):
    own = sorted((hashlib.md5(v.encode()).hexdigest()[:2], v, w) for a, g, v, w in TABLE if a == attribute and g == given)
    upto = list(accumulate(w for *_, w in own))
    return own[bisect_right(upto, at * upto[-1] >> 32)][1] if own else None


def test_catalogues_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": "1", "city": {"Lyon": 0.6, "Nice": 0.4, "None": 0}, "role": {"Lyon": {"chef": 1, "aide": 2}}}))
    (tmp_path / "b.csv").write_text("attribute,given,value,weight\ncity,,Lyon,0.6\nrole,Lyon,chef,1\n")
    got = {(r["attribute"], r["given"], r["value"]): r["weight"] for r in catalogues.load_catalogue(spark, str(tmp_path / "a.json")).collect()}
    assert got == {("city", None, "Lyon"): 600_000, ("city", None, "Nice"): 400_000, ("role", "Lyon", "chef"): 1_000_000, ("role", "Lyon", "aide"): 2_000_000}
    assert {tuple(r) for r in catalogues.load_catalogue(spark, str(tmp_path / "b.csv"), 10).collect()} == {("city", None, "Lyon", 6), ("role", "Lyon", "chef", 10)}
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("city:\n  Lyon: 0.6\n  Nice: 0.4\nnames: [x, y]\n")
    assert {tuple(r) for r in catalogues.load_catalogue(spark, str(tmp_path / "c.yaml"), 10).collect()} == {("city", None, "Lyon", 6), ("city", None, "Nice", 4)}


@pytest.mark.parametrize("small", [1000, 0])
def test_draws_by_both_ways_equal_bisection(spark, table, small):
    rows = spark.range(2000).select("id")
    rows = catalogues.draw_from(rows, table, "city", catalogues.point(5, "city", F.col("id")), small=small)
    rows = catalogues.draw_from(rows, table, "role", catalogues.point(5, "role", F.col("id")), F.col("city"), small=small)
    rows = catalogues.draw_from(rows, table, "years", catalogues.point(5, "years", F.col("id")), name="since", small=small)
    got = {r["id"]: (r["city"], r["role"], r["since"]) for r in rows.collect()}
    want = {k: (c := picked("city", None, point(5, "city", k)), picked("role", c, point(5, "role", k)), picked("years", None, point(5, "years", k))) for k in range(2000)}
    assert got == want and any(v[1] is None for v in got.values())  # a city without roles
    share = {r["value"]: r["share"] for r in catalogues.marginals(rows, ["city"]).collect()}
    assert all(abs(share[c] - w) < 0.04 for c, w in (("Lyon", 0.6), ("Nice", 0.3), ("Brest", 0.1)))


def brute_people(worlds, per_world, fields, apart, seed):
    """The same rounds, one person after another."""
    out = {}
    for w in worlds:
        settled, open_ = {}, {k: 0 for k in range(per_world)}
        while open_:
            new = {}
            for k, attempt in open_.items():
                own = {}
                for name, given in fields.items():
                    own[name] = picked(name, None if given is None else own[given], point(seed, name, w, k, attempt))
                new[k] = own
            shares = lambda a, b: sum(a[f] == b[f] for f in apart) > 1
            lost = {k for k in new if any(shares(new[k], new[j]) for j in new if j < k) or any(shares(new[k], s) for s, _ in settled.values())}
            settled |= {k: (new[k], open_[k]) for k in new if k not in lost}
            open_ = {k: open_[k] + 1 for k in sorted(lost)}
        out |= {(w, k): v for k, v in settled.items()}
    return out


def test_people_of_repeated_and_null_worlds(spark, table):
    worlds = spark.createDataFrame([("w1",), ("w2",), ("w2",), (None,)], "world_id string")
    fields = {"city": None, "role": "city", "years": None}
    made = catalogues.people(worlds, 4, table, fields, ["city", "years"], seed=3, small=0).collect()
    assert {(r["world_id"], r["k"]): ({n: r[n] for n in fields}, r["attempt"]) for r in made} == brute_people(["w1", "w2"], 4, fields, ["city", "years"], 3)
    assert len({r["person_id"] for r in made}) == 8


def test_people_of_a_tight_world_equal_brute_force(spark, table):
    fields, apart = {"city": None, "years": None, "grade": None}, ["city", "years", "grade"]
    worlds = spark.createDataFrame([("a",), ("b",)], "world_id string")
    made = catalogues.people(worlds, 5, table, fields, apart, seed=8)
    got = {(r["world_id"], r["k"]): ({n: r[n] for n in fields}, r["attempt"]) for r in made.collect()}
    assert got == brute_people(["a", "b"], 5, fields, apart, 8)
    assert annotation.uniqueness_conflicts(made, apart).count() == 0
    with pytest.raises(ValueError, match="after 4 rounds"):
        catalogues.people(worlds, 9, table, fields, ["city", "grade"], most=4).count()  # six pairs at most


def test_rounds_of_people_take_few_jobs(spark, table):
    fields, apart, worlds = {"years": None, "city": None, "role": "city", "grade": None}, ["city", "years", "grade"], [f"w{k}" for k in range(40)]
    context = spark.sparkContext
    context.setJobGroup("people", "people")
    try:
        made = catalogues.people(spark.createDataFrame([(w,) for w in worlds], "world_id string"), 5, table, fields, apart, seed=8)
        jobs = len(context.statusTracker().getJobIdsForGroup("people"))
    finally:
        context._jsc.clearJobGroup()
    got = {(r["world_id"], r["k"]): ({n: r[n] for n in fields}, r["attempt"]) for r in made.collect()}
    rounds = 1 + max(attempt for _, attempt in got.values())
    assert got == brute_people(worlds, 5, fields, apart, 8) and rounds > 2
    assert jobs < 30 + 16 * rounds, (jobs, rounds)
    one = catalogues.people(spark.createDataFrame([("a",)], "world_id string"), 3, table, {"city": None, "years": None}, ["city"], seed=8)
    assert {r["k"]: r["city"] for r in one.collect()} == {k: picked("city", None, point(8, "city", "a", k, 0)) for k in range(3)}


def test_phrases_are_read():
    assert templates.read_phrase("[goal=x !direct] Oui {TEAM}, {when}.\n") == (["goal=x", "value:TEAM", "value:when"], ["direct"], [("Oui ", None, None), (None, "TEAM", None), (", ", None, None), (None, None, "when"), (".\n", None, None)])
    assert templates.read_phrase("Non.") == ([], [], [("Non.", None, None)])


def test_documents_of_the_library(spark):
    authors = spark.createDataFrame([(k, k, ["courant", "familier", "soutenu"][k % 3], ["tu", "vous"][k % 2], k % 2 == 0, True, k % 4 == 0, ["HEALTH"], ["AGE_RANGE"]) for k in range(8)], "place bigint, person_id int, register string, address_form string, degree boolean, certificate boolean, rare boolean, sensitive array<string>, cues array<string>")
    scenarios = generation.scenarios(authors, 300)
    names = ["PERSON_NAME", "EMAIL", "PHONE", "ACCOUNT_ID", "USERNAME", "ROLE", "TEAM", "TENURE", "AGE_RANGE", "HEALTH", "PRODUCT_CONTEXT", "JARGON_PATTERN", "SIGNATURE_PATTERN"]
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(f"<{n.lower()}>"))])
    forms = F.array(F.struct(F.lit("PERSON_NAME").alias("label"), F.lit("explicit_hard").alias("mode"), F.lit("une personne").alias("snippet"), F.lit("").alias("cue_type")))
    docs = templates.documents(scenarios, templates.library(spark), values, forms).join(scenarios.select("scenario_id", "include_direct", "mention_plan", "address_form"), "scenario_id").collect()
    assert len(docs) == 300 and len({d["text"] for d in docs}) > 100
    for d in docs:
        assert d["text"] == d["text"].strip() and "{" not in d["text"] and "None" not in d["text"]
        assert [(s["label"], d["text"][s["start"] : s["end"]]) for s in d["spans"]] == [(g["label"], g["snippet"]) for g in d["grounding"]]
        planned = {m["label"] for m in d["mention_plan"]}
        for label in ("PERSON_NAME", "EMAIL", "PHONE"):
            assert label in planned or f"<{label.lower()}>" not in d["text"]
        assert ("Bien à vous" in d["text"] or "Cordialement" in d["text"] or "distinguées" in d["text"]) == (d["address_form"] == "vous")
    with pytest.raises(ValueError, match="phrases"):
        templates.expand(scenarios, templates.library(spark).crossJoin(spark.range(1000)), F.array(), values, F.lit(1))


def test_long_texts_are_composed_in_linear_time(spark):
    def took(size):
        part = lambda text, label: F.struct(text.alias("text"), F.lit(label).cast("string").alias("label"), text.alias("canonical_value"))
        rows = spark.range(2).coalesce(1).select(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.array(part(F.concat(F.lit("  word "), k.cast("string")), None), part(F.when(k % 50 == 0, " x "), "X")))).alias("parts"))
        plan, forms = F.array(F.struct(F.lit("X").alias("label"), F.lit("implicit").alias("mode"))), F.array(F.struct(F.lit("X").alias("label"), F.lit("implicit").alias("mode"), F.lit("the y ").alias("snippet"), F.lit("cue").alias("cue_type")))
        began = time.time()
        for r in rows.select(generation.compose(F.col("parts"), plan, forms).alias("d")).collect():
            assert len(r["d"]["spans"]) == size // 50 and all(r["d"]["text"][s["start"] : s["end"]] in ("the y ", "the y") for s in r["d"]["spans"])
            assert [(g["snippet"], g["difficulty_mode"], g["cue_type"], g["occurrence_hint"]) for g in r["d"]["grounding"]] == [("the y ", "implicit", "cue", k + 1) for k in range(size // 50)]
        return time.time() - began

    took(50)
    assert took(2000) < 10


@pytest.mark.parametrize("crowd", [2, 5000])
def test_pairs_who_agree_are_made_once_and_not_exchanged(spark, crowd):
    rows = [(k, None if k % 11 == 0 else k % 3, None if k % 7 == 0 else f"r{k % 2}", k % 5, float(k % 4)) for k in range(90)]
    people = spark.createDataFrame(rows, "person_id bigint, world_id int, role string, age int, tenure double")
    agree = lambda a, b: sum(x == y and x is not None for x, y in zip(a[2:], b[2:], strict=True))
    for least in (2, 3):
        found = annotation.uniqueness_conflicts(people, ["role", "age", "tenure"], least=least, crowd=crowd)
        want = [(a[0], b[0]) for a, b in combinations(rows, 2) if a[1] is not None and a[1] == b[1] and agree(a, b) >= least]
        assert sorted((r["a"], r["b"]) for r in found.collect()) == want and len(want) > 10
        above = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
        assert "Aggregate" not in above and "Repartition" not in above
