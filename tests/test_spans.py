import re

import duckdb
import pytest
from pyspark.sql import functions as F

from scrubline.functions import labels, validators
from scrubline.functions.patterns import BY_NAME, RULES
from scrubline.operators import masking, metrics, spans
from scrubline.plans import catalogue

SPANS = "doc_id bigint, start int, end int, label string, value string, source string, score double"


def resolved(spark, rows, strategy):
    df = spans.gather(spark.createDataFrame([(1, *r) for r in rows], SPANS)).withColumn("spans", spans.resolve(F.col("spans"), strategy))
    return [(s["start"], s["end"], s["label"]) for s in df.first()["spans"]]


@pytest.mark.parametrize(
    ("strategy", "kept"),
    [("longest", [(0, 10, "PER")]), ("highest_score", [(4, 12, "ORG")]), ("first", [(0, 10, "PER")]), ("priority_longest", [(4, 12, "ORG")]), ("priority_score", [(4, 12, "ORG")]), ("unheard of", [(0, 10, "PER")])],
)
def test_overlap_strategies(spark, strategy, kept):
    assert resolved(spark, [(0, 10, "PER", "x", "ai", 0.5), (4, 12, "ORG", "y", "regex", 0.9)], strategy) == kept


def test_neighbours_dont_overlap(spark):
    assert resolved(spark, [(0, 5, "PER", "x", "ai", 1.0), (5, 9, "ORG", "y", "ai", 1.0)], "longest") == [(0, 5, "PER"), (5, 9, "ORG")]


def test_offsets_are_code_points(spark):
    text = "😀 école bob@example.com é 10.0.0.1"
    rows = spans.rule_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), [BY_NAME["email_strict"], BY_NAME["ipv4"]]).collect()
    assert {(r["start"], r["end"]) for r in rows} == {m.span() for n in ("email_strict", "ipv4") for m in re.finditer(BY_NAME[n].pattern, text)}


def test_detect_is_python_re(spark):
    text = "AOÛT tel: 555 1234567 le 12 août 2020, user: alice 123-45-6789 000-45-6789 4111 1111 1111 1111 x"
    got = {(r["rule"], r["value"]) for r in spans.detect(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).collect()}
    assert {("date_fr_full", "12 août 2020"), ("username_keyval", "alice"), ("ssn_us", "123-45-6789")} <= got
    assert ("ssn_us", "000-45-6789") not in got


@pytest.mark.parametrize(("name", "value", "ok"), [("nir", "1 84 12 76 451 089", True), ("nir", "9999999999999", False), ("nir", "1841376451089", False), ("nir", "2 84 12 2A 451 089", True), ("nir", "1 84 12 76 451 089 46", True), ("nir", "1 84 12 76 451 089 47", False), ("ssn", "123-45-6789", True), ("ssn", "000-45-6789", False), ("luhn", "4111111111111111", True), ("luhn", "4111111111111112", False), ("iban", "FR14 2004 1010 0505 0001 3M02 606", True), ("iban", "FR14 2004 1010 0505 0001 3M02 607", False), ("phone", "12345", False), ("bic", "DEUTDEFF", True)])
def test_validators(spark, name, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(validators.get_validator(name.upper())(F.col("v")).alias("ok")).first()["ok"] is ok


def test_masks_and_pseudonym(spark):
    import hashlib
    import hmac

    row = spark.createDataFrame([("bob@x.org", "06 12 34 56 78", "FR7612345")], "m string, p string, i string").select(masking.mask_email(F.col("m")), masking.mask_phone(F.col("p")), masking.mask_iban(F.col("i")), masking.pseudonym(F.lit("PER"), F.col("m"), "key", "salt")).first()
    want = hmac.new(b"key", b"salt|default|PER|bob@x.org", hashlib.sha256).hexdigest()[:8].upper()
    assert tuple(row) == ("b**@x.org", "06 ** ** ** 78", "FR76 **** ****", f"[PER_{want}]")


def test_masked_text_holds_no_value(spark):
    docs = spark.createDataFrame([(1, "é bob@example.com and (555) 555-1234."), (2, None), (3, "")], "doc_id bigint, text string")
    found = F.transform(spans.as_spans(spans.found(F.col("text"), [BY_NAME["email_strict"], BY_NAME["phone_us"]])), lambda s: s.withField("label", F.lower(labels.normalise(s["label"]))))
    out = {r["doc_id"]: r for r in masking.mask_documents(docs.withColumn("spans", spans.ordered(found)), {"Email": "redact"}, "generalize").collect()}
    assert out[1]["masked"] == "é [EMAIL_REDACTED] and [PHONE]." and out[2]["masked"] is None and out[3]["n_masked"] == 0


def test_labels(spark):
    row = spark.createDataFrame([(" telephone ", "e-mail")], "a string, b string").select(labels.normalise(F.col("a")), labels.canonical(F.col("b")), labels.canonical(F.lit(" ")), labels.normalise(F.lit("gpe"), "news_ner")).first()
    assert tuple(row) == ("PHONE", "EMAIL", "SENSITIVE", "LOC")


def test_scores_and_counts(spark):
    kind = "doc_id bigint, start int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 5, "PER"), (1, 10, 15, "ORG"), (2, 0, 5, "PER")], kind)
    pred = spark.createDataFrame([(1, 0, 5, "PER"), (1, 11, 15, "ORG"), (2, 7, 9, "LOC")], kind)
    r = metrics.span_scores(*metrics.evaluate_spans(gold, pred), []).first()
    assert (r["recall_tp"], r["recall_fn"], r["strict_recall_tp"], r["boundary_error"], r["precision_fp"]) == (2, 1, 1, 1, 1)
    scoped = metrics.span_scores(*metrics.evaluate_spans(gold, pred, ["PER"]), []).first()
    assert (scoped["pred_count"], scoped["recall_tp"]) == (1, 2)


def test_occurrences(spark):
    r = spark.createDataFrame([("aaa Aa",)], "t string").select(spans.occurrences(F.col("t"), F.lit("aa")), spans.occurrences(F.col("t"), F.lit("aa"), overlapping=False, fold=True), spans.resolve_mention(F.col("t"), F.lit("a"), F.lit(9))).first()
    assert (list(r[0]), list(r[1]), r[2]) == ([0, 1], [0, 4], None)


def test_misses_and_unmasked_documents_have_rows(spark):
    from scrubline.plans import span_queries

    texts = ["call (555) 555.1234", "mail bob@example.com", "nothing here", None, " \n"]
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id bigint, text string, lang string")
    matched = {r["doc_id"]: (r["tp"], r["fp"], r["fn"]) for r in span_queries.greedy_match(lambda _: docs).collect()}
    bleu = {r["doc_id"]: r["bleu"] for r in span_queries.bleu_masked(lambda _: docs).collect()}
    assert set(bleu) == {0, 1, 2, 3, 4} and bleu[2] == bleu[4] == 1 and bleu[0] < 1 and bleu[3] == 0
    assert matched == {0: (0, 0, 1), 1: (1, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}


def test_labels_and_sources_count_in_any_case(spark):
    a = lambda s, e, label, source, score=1.0: {"start": s, "end": e, "label": label, "value": "x", "source": source, "score": score}
    rows = [(1, [a(0, 9, "per", "AI"), a(0, 5, "PER", "Regex")]), (2, [a(0, 9, "", "AI"), a(0, 5, "", "Regex")]), (3, [a(0, 9, "loc", "ai"), a(2, 5, "PER", "REGEX")])]
    df = spark.createDataFrame(rows, f"doc_id int, spans array<{spans.SPAN}>")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in df.select("doc_id", spans.resolve(spans.ordered(F.col("spans"))).alias("spans")).collect()}
    assert got == {1: [(0, 9)], 2: [(0, 5)], 3: [(2, 5)]}
    r = df.where("doc_id = 1").select(masking.replacement(F.lit("nom"), F.lit("Li"), F.lit("mask")), masking.policy_action(F.lit("email"), {"EMAIL": "mask"}), masking.mask_iban(F.lit("FR76")), masking.mask_iban(F.lit("FR7")), masking.mask_iban(F.lit("FR76 3000 6000 0112 3456 7890 189"))).first()
    assert tuple(r) == ("[NOM]", "mask", "FR76 ", "[IBAN]", "FR76 **** **** **** **** **** ****")


def test_merged_lists(spark):
    a = lambda s, e, label, source: {"start": s, "end": e, "label": label, "value": "x", "source": source, "score": 1.0}
    df = spark.createDataFrame([([a(0, 4, "ORG", "regex"), a(6, 8, "PER", "regex")], [a(0, 4, "org", "ai"), a(2, 9, "PER", "ai")], None)], f"x array<{spans.SPAN}>, y array<{spans.SPAN}>, z array<{spans.SPAN}>")
    r = df.select(spans.merged(F.col("x"), F.col("y"), F.col("z")).alias("a"), spans.merged(F.col("x"), F.col("y"), strategy=None).alias("b")).first()
    assert [(s["start"], s["end"], s["source"]) for s in r["a"]] == [(0, 4, "regex"), (6, 8, "regex")]
    assert [(s["start"], s["end"]) for s in r["b"]] == [(0, 4), (2, 9), (6, 8)]


def test_long_texts_are_located_in_linear_time(spark):
    from scrubline.functions import arrays

    text = "a@b.co x " * 5000
    row = spark.createDataFrame([(1, text)], "doc_id bigint, text string").select(spans.found(F.col("text"), [BY_NAME["email_strict"]]).alias("s")).first()
    assert [(s["start"], s["end"]) for s in row["s"]] == [(9 * k, 9 * k + 6) for k in range(5000)]
    r = spark.range(1).select(arrays.sums(F.sequence(F.lit(1), F.lit(200))), arrays.maxima(F.array(F.lit(3), F.lit(1), F.lit(4))), arrays.sums(F.array().cast("array<int>"))).first()
    assert r[0] == [k * (k + 1) // 2 for k in range(1, 201)] and r[1] == [3, 3, 4] and r[2] == []


def test_texts_without_what_a_rule_needs_are_not_searched(spark):
    samples = [
        "sk_live_" + "a" * 24, "sk_" + "b" * 20, "AKIA" + "A" * 16, "AIza" + "z" * 35, "FR14 2004 1010 0505 0001 3M02 606", "1 84 12 76 451 089", "4111 1111 1111 1111", "abcdefab-cdef-1abc-abcd-abcdefabcdef", "ab:cd:ef:ab:cd:ef", "AB-١",
        "10.0.0.1", "fe80::1 a:b:c:d", "HTTPſ://x.y", "https://x", "git+ssh://h", "é bob@example.com", "0612345678", "06 12 34 56 78", "Téléphone: 555 123 4567", "a /usr/bin", "C:\\\\dir\\\\f", "123-45-6789", "(555) 555-1234", "2020-01-02", "12 march ٢٠٢٠", "May 3, 2020",
        "Auguſt 2020", "1er août 2020", "déc. 2020", "1/2/20", "q4 2020", "user = alice", "uid=0(root)", "EUR 5", "$5", "5 euros", "5 €", "nothing here", "", None,
    ]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(samples)] + [(100, "\n".join(x or "" for x in samples))], "doc_id bigint, text string")
    every = lambda rules: spans.detect(docs, rules, ["root"])
    got = every(RULES)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(tuple(r) for r in every([r._replace(needs="") for r in RULES]).collect())
    assert {r.name for r in RULES if r.enabled} - {r[5] for r in rows} == {"username_linux"}
    assert all(r.needs for r in RULES if r.enabled) and "Filter" in got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]
    kept = spans._holding(docs, [r for r in RULES if r.enabled])[0]
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(samples) - 3)) | {100}


def test_length_change_of_empty_texts(spark, tmp_path):
    rows = [(1, "", "en"), (2, "a bob@example.com", "en"), (3, "(555) 555-1234 x", "fr"), (4, None, "fr"), (5, None, "de"), (6, "", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["length_change"]).fetchall()
    assert sorted(map(str, map(tuple, catalogue.QUERIES["length_change"](spark, str(tmp_path)).collect()))) == sorted(map(str, want))
