"""Occurrences, approximate places, lexicons, near duplicates in crowded bands and self-BLEU, against brute force."""

import hashlib
import random
import re
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.functions import digests
from scrubline.functions import grams as grams_
from scrubline.functions.digests import md5_heads
from scrubline.operators import detection, diversity, gazetteer, matching, spans
from scrubline.plans import catalogue


def test_occurrences_equal_search(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aA\\E.é😀 ") for _ in range(rnd.randint(0, 30))) for _ in range(150)] + ["aaaa", "", None, r"a\Qb\E\E", "a" * 200]
    needles = ["a", "aa", r"\E", ".", "é", "😀 ", "aA", r"\Q", "", None]
    rows = [(k, t, n) for k, (t, n) in enumerate((t, n) for t in texts for n in needles)]
    df = spark.createDataFrame(rows, "id int, t string, n string")
    t, n = F.col("t"), F.col("n")
    got = {r["id"]: r for r in df.select("id", spans.occurrences(t, n).alias("all"), spans.occurrences(t, n, False).alias("apart"), spans.occurrences(t, n, True, True).alias("folded")).collect()}

    def apart(t, n):
        out, at = [], t.find(n) if n else -1
        while at >= 0:
            out.append(at)
            at = t.find(n, at + len(n))
        return out

    for k, t, n in rows:
        if t is None or n is None:
            assert got[k]["all"] is None and got[k]["apart"] is None
        else:
            assert got[k]["all"] == [a for a, _ in matching.places(t, n)] and got[k]["apart"] == apart(t, n), (t, n)
            assert got[k]["folded"] == [a for a, _ in matching.places(t, n, True)]


def test_occurrences_are_linear(spark):
    def took(size):
        df = spark.createDataFrame([("ab" * (size // 2) + "xyz",)] * 4, "t string").coalesce(1).select(F.size(spans.occurrences(F.col("t"), F.lit("xyz"))).alias("a"), F.size(spans.occurrences(F.col("t"), F.lit("ab"), False)).alias("b"))
        began = time.time()
        assert {tuple(r) for r in df.collect()} == {(1, size // 2)}
        return time.time() - began

    took(10_000)
    assert took(160_000) < 10 * max(took(10_000), 0.5)


def all_windows(text, needle, least=0.86):
    n, best = len(needle), None
    delta = max(3, min(12, n // 4))
    for size in range(max(2, n - delta), min(len(text), n + delta) + 1):
        for start in range(len(text) - size + 1):
            ratio = SequenceMatcher(None, text[start : start + size].lower(), needle.lower()).ratio()
            if ratio >= least and (best is None or ratio > best[2]):
                best = (start, start + size, ratio)
    return best


def test_approximate_places_equal_all_windows():
    rnd = random.Random(5)
    for _ in range(60):
        text = "".join(rnd.choice("abcde é") for _ in range(rnd.randint(0, 90)))
        at = rnd.randint(0, max(0, len(text) - 9))
        needle = list(text[at : at + 9])
        if needle and rnd.random() < 0.7:
            needle[rnd.randrange(len(needle))] = rnd.choice("abxÉ")
        needle = "".join(needle).strip()
        assert detection.fuzzy_place(text, needle) == (all_windows(text, needle) if len(needle) >= 4 else None)


def test_approximate_places_of_long_texts():
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(24_000)) + " Montmirail-sur-Seine"
    began = time.time()
    start, end, ratio = detection.fuzzy_place(text, "Montmirial-sur-Seine")
    assert text[start:end] == "Montmirail-sur-Seine" and ratio > 0.9 and time.time() - began < 10
    assert detection.fuzzy_place(text, "Montmirial-sur-Seine", longest=12_000) is None


@pytest.mark.parametrize("any_case, most_chars", [(False, 10**6), (True, 40)])
def test_gazetteer_equals_search(spark, any_case, most_chars):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abAé İx") for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, "", "x" * 20_000 + "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("value", F.lit(1))
    values = ["a", "ab", "Ab", "aba", "é ", "İx", "", None, "ab", "none of it"]
    got = gazetteer.find(docs, spark.createDataFrame([(v,) for v in values], "value string"), any_case, most_chars)
    fold = gazetteer.folded if any_case else str
    wanted = {(v.lower() if any_case else v) for v in values if v}
    want = sorted((k, a, b, v) for k, t in enumerate(texts) for v in wanted for a, b in matching.places(fold(t or ""), v))
    assert sorted(tuple(r) for r in got.collect()) == want
    outer = gazetteer.find(docs, spark.createDataFrame([(v,) for v in values], "value string"), any_case, most_chars, longest=True)
    inside = lambda p, q: p != q and p[0] == q[0] and q[1] <= p[1] and p[2] <= q[2]
    assert sorted(tuple(r) for r in outer.collect()) == sorted(p for p in want if not any(inside(p, q) for q in want))


def test_gazetteer_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a")], "doc_id int, text string"), spark.createDataFrame([], "value string")
    assert gazetteer.find(docs, none).count() == 0 and gazetteer.find(docs.limit(0), spark.createDataFrame([("a",)], "value string")).count() == 0


def signature_rows(rnd, count, shared):
    """Signatures that agree in their first hashes only, and some near copies of them."""
    base = [[7] * shared + [rnd.getrandbits(64) for _ in range(64 - shared)] for _ in range(count)]
    for k in range(0, count, 40):
        near = list(base[k])
        for _ in range(rnd.randint(1, 14)):
            near[rnd.randrange(64)] = rnd.getrandbits(64)
        base.append(near)
    return [(k, np.array(s, ">u8").tobytes()) for k, s in enumerate(base)]


def brute_pairs(rows):
    first = {}
    for k, s in rows:
        first.setdefault(s, k)
    ids, table = list(first.values()), np.array([np.frombuffer(s, ">u8") for s in first])
    out = set()
    for i in range(len(ids)):
        same = (table[i + 1 :] == table[i]).sum(axis=1)
        out |= {(ids[i], ids[i + 1 + j], round(int(same[j]) / 64, 4)) for j in np.flatnonzero(same >= 52)}
    return out


def test_heads_of_md5():
    rnd = random.Random(2)
    texts = [bytes(rnd.randrange(1, 256) for _ in range(n)) for n in [*range(60), 64, 119, 120, 500]] + [b"one two three", b""]
    salts = [b"", b"0:", b"9:", b"10:", b"63:", b"999:", b"10000:"]
    for salt, heads in zip(salts, md5_heads(salts, texts, block=7), strict=True):
        assert heads.tolist() == [int.from_bytes(hashlib.md5(salt + t).digest()[:8], "big") for t in texts]
    assert [len(h) for h in md5_heads(salts, [])] == [0] * len(salts)


def test_signatures_cost_less_than_a_digest_each():
    texts = [f"word{k} of words{k % 977}".encode() for k in range(20_000)]
    salts = [f"{k}:".encode() for k in range(10, 42)]
    began = time.process_time()
    one = [hashlib.md5(salt + t).digest()[:8] for salt in salts[:8] for t in texts]
    middle = time.process_time()
    many = [h for h in md5_heads(salts, texts)]
    assert len(one) == 8 * len(texts) and len(many) == 32 and time.process_time() - middle < 0.7 * 4 * (middle - began)


@pytest.mark.parametrize("most", [1, 5, 65_536])
def test_signatures_in_parts(spark, most):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["à", "b", "longer-word", "x" * 60]) for _ in range(rnd.randint(0, 12))) for _ in range(40)] + [None, "", "?!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = diversity.signatures(docs, 12, 3, lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), " "), lambda w: w != ""), most).collect()
    for r in rows:
        w = [x for x in (texts[r["doc_id"]] or "").split(" ") if x]
        shingles = {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
        want = [min(int(hashlib.md5(f"{h}:{s}".encode()).hexdigest()[:16], 16) for s in shingles) for h in range(12)] if shingles else None
        assert (r["signature"] and np.frombuffer(r["signature"], ">u8").tolist()) == want
    assert len(rows) == len(texts)


@pytest.mark.parametrize("count, shared, hot, levels", [(400, 5, 8, 3), (300, 20, 4, 3), (200, 5, 8, 1)])
def test_near_duplicates_of_crowded_bands(spark, count, shared, hot, levels):
    rows = signature_rows(random.Random(count), count, shared)
    rows += [(9000, rows[0][1]), (9001, None)]
    got = diversity.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, signature binary"), hot=hot, levels=levels)
    assert {tuple(r) for r in got.collect()} == brute_pairs([r for r in rows if r[1]])


@pytest.mark.parametrize("hot, levels", [(4096, 3), (16, 3), (16, 1)])
def test_a_pair_is_made_once(spark, monkeypatch, hot, levels):
    rnd = random.Random(9)
    one = [rnd.getrandbits(64) for _ in range(64)]
    rows = signature_rows(rnd, 80, 20)
    for k in range(90):  # near copies of one text, and others that share a band with them
        rows.append((1000 + k, np.array([rnd.getrandbits(64) if rnd.random() < (0.1 if k < 60 else 0.6) else x for x in one], ">u8").tobytes()))
    df = spark.createDataFrame(rows, "doc_id bigint, signature binary").persist()
    monkeypatch.setattr(type(df), "distinct", lambda self: self)
    got = [tuple(r) for r in diversity.near_duplicates(df, hot=hot, levels=levels).collect()]
    assert len(got) > 500 and len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_one_band_of_3000_signatures(spark):
    rows = signature_rows(random.Random(1), 3000, 5)
    df = spark.createDataFrame(rows, "doc_id bigint, signature binary").persist()
    df.count()
    began = time.time()
    assert diversity.near_duplicates(df).count() == len(brute_pairs(rows))
    assert time.time() - began < 60


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_texts_without_a_pair_are_ruled_out(spark, few):
    rnd = random.Random(8)
    lone = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(50, 90))) for _ in range(200)]
    near = []
    for t in lone[:60]:
        w = t.split()
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    texts = lone + near + lone[20:40] + [lone[50].upper() + "!", None, "", "?!", ""]
    docs = spark.createDataFrame([(1000 - k, t) for k, t in enumerate(texts)] + [(None, lone[3])], "doc_id bigint, text string").repartition(3)
    kept = diversity.may_pair(docs, few=few)
    want = brute_pairs(sorted((r["doc_id"], r["signature"]) for r in diversity.signatures(docs.where("doc_id is not null")).collect() if r["signature"]))
    assert len(want) > 20 and {tuple(r) for r in diversity.near_duplicates(diversity.signatures(kept)).collect()} == want
    ids = [r["doc_id"] for r in kept.collect()]
    assert {x for a, b, _ in want for x in (a, b)} <= set(ids) and len(ids) < 150 and not set(range(1000 - 199, 1000 - 60)) & set(ids)


def test_rows_of_equal_texts():
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([0, 1, 2, 3, 63, 64, 65]))) for _ in range(300)] + [b"a" * 64, b"a" * 65, b"a" * 66] * 2
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    rows = digests.cut_rows(data, np.cumsum(lengths) - lengths, lengths)
    assert [r.tobytes() for r in rows] == [t[:64].ljust(64, b"\0") for t in texts]
    chosen, place = digests.distinct_rows(rows, lengths)
    assert [texts[k] for k in chosen[place]] == texts and len({texts[k] for k in chosen if lengths[k] <= 64}) == (lengths[chosen] <= 64).sum()


def test_words_of_texts_go_as_one_string(spark):
    plan = diversity.signatures(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))._jdf.queryExecution().analyzed().toString()
    assert "array_join" in plan
    with pytest.raises(Exception, match="NUL"):
        diversity.signatures(spark.createDataFrame([(1, "a\0b c")], "doc_id bigint, text string"), own=lambda t: F.split(t, " ")).collect()


def test_self_bleu_by_both_ways(spark):
    rnd = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 30)))) for k in range(60)], "doc_id bigint, text string")
    score = lambda few: {r["doc_id"]: round(r["bleu"], 9) for r in diversity.self_bleu(docs, 20, few=few).collect()}
    assert score(10**6) == score(0) and len(score(0)) == 20


@pytest.mark.parametrize("most", [1, 50, 1_000_000])
def test_distinct_grams_by_group(spark, most):
    rnd = random.Random(5)
    rows = [(rnd.randrange(3), [rnd.choice(["a", "b", "é c", ""]) for _ in range(rnd.randint(0, 6))]) for _ in range(300)] + [(7, []), (8, None), (9, ["a"])]
    df = spark.createDataFrame(rows, "group int, w array<string>").repartition(3)
    for n in (1, 2, 3):
        grams = {g: [tuple(w[k : k + n]) for h, w in rows if h == g and w for k in range(len(w) - n + 1)] for g, _ in rows}
        assert {r["group"]: (r["total"], r["uniques"]) for r in grams_.distinct_grams(df, n, most).collect()} == {g: (len(x), len(set(x))) for g, x in grams.items()}


def test_distinct_grams_move_few_bytes(spark):
    df = spark.range(40).selectExpr("0 AS group", "transform(sequence(1, 3000), k -> cast(k % 97 * (id + 1) AS string)) AS w").repartition(4)
    got = grams_.distinct_grams(df, 3)
    assert got.first()["total"] == 40 * 2998
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower() and "md5" not in plan.lower()  # keys go packed, not a row for each gram


def test_largest_counts(spark):
    rnd = random.Random(9)
    docs = [(k, [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, w array<string>").repartition(4)
    rows = grams_.counted_grams(df).collect()
    asked = [np.array(sorted({(r["a"] % 2**64, r["b"] % 2**64) for r in rows if r["n"] == n and r["doc_id"] < 9}), np.uint64).reshape(-1, 2) for n in range(1, 5)]
    got: dict[tuple, list[tuple[int, int]]] = {}
    for r in grams_.largest_counts(df, asked).where("n > 0").collect():
        got.setdefault((r["n"], r["a"], r["b"]), []).extend([(r["first"], r["who"]), (r["second"], -1)])
    want: dict[tuple, list[tuple[int, int]]] = {}
    for r in rows:
        want.setdefault((r["n"], r["a"], r["b"]), []).append((r["c"], r["doc_id"]))
    of = {r["doc_id"] for r in rows}
    assert len(of) and len(got) == sum(map(len, asked))
    for key, pairs in got.items():
        counts = sorted((c for c, _ in want[key]), reverse=True) + [0]
        assert sorted((c for c, _ in pairs), reverse=True)[:2] == counts[:2] and max(pairs)[:2] in want[key]


def test_vendi_equals_the_whole_matrix(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 7))
    x[5] = 0
    df = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>").repartition(4)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    values = np.clip(np.linalg.eigvalsh(unit @ unit.T / len(x)), 1e-12, None)
    values /= values.sum()
    assert diversity.vendi(df).first()[0] == pytest.approx(float(np.exp(-(values * np.log(values)).sum())), rel=1e-6)


def test_number_places_equal_a_pattern_of_the_value():
    rnd = random.Random(11)
    for _ in range(3000):
        text = "".join(rnd.choice("1112 -\n٣x") for _ in range(rnd.randint(0, 40)))
        value = "".join(rnd.choice("112-٣ ") for _ in range(rnd.randint(0, 6)))
        digits = re.sub(r"\D", "", value)
        want = [m.span() for m in re.finditer(r"[\s\-]?".join(digits), text)] if len(digits) >= 2 else []
        assert matching.number_places(text, value, least=2) == want, (text, value)


def test_number_places_compile_nothing_for_a_value(monkeypatch):
    matching.number_places("1 2", "99", least=2)
    monkeypatch.setattr(re._compiler, "compile", lambda *_: pytest.fail("compiled"))
    assert matching.number_places("a 12 34-56 b", "123456") == [(2, 10)]


@pytest.mark.parametrize("name", ["number_matches", "name_matches", "offset_repair", "profile_leaks", "draft_issues", "attack_pairs"])
def test_small_tables_are_dealt_to_all_cores(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
