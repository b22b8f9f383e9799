"""Source divergences, collocations and token files, against brute force, SQL and exact round trips."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from scrubline.llm import collocation, divergence, tokenfile

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_rows():
    rnd = random.Random(11)
    vocabulary = [a + b for a in "abcdé" for b in ("", "a", "bc", "É", "zz", "日")]
    rows = []
    for i in range(160):
        words = [rnd.choice(vocabulary[: 6 + 8 * (i % 4)]) for _ in range(rnd.choice([0, 3, 20, 60]))]
        for _ in range(3):
            if len(words) > 5:
                words[rnd.randrange(len(words) - 3) :][:3] = ["The", "big", "cat"]
                words.insert(rnd.randrange(len(words)), rnd.choice([".", "big cat!", "the big", ",", "x;y", "\n", "The BIG cat"]))
        rows.append((i, " ".join(words), ["en", "fr"][i % 2], f"src{i % 5}", 1))
    rows += [(200, None, None, None, None), (201, "", "en", "src9", 0), (202, " \n\t.,", "fr", None, 3), (None, "big cat é 😀", "und", "src2", 9), (None, "big cat", None, "src2", 9), (150, rows[0][1], "en", "src2", 1), (150, rows[0][1], "en", "src2", 1), (151, "alone", "xx", "", 1)]
    return [*rows, (300, " ".join(rnd.choice(vocabulary) for _ in range(30_000)), "en", "src3", 1), (301, "z" * 100_000, "en", "src3", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns with the names that the operators use inside.
    return spark.createDataFrame(odd_rows(), KIND).withColumns({c: F.lit(7) for c in ("gid", "key", "n", "h", "term", "ids", "part")}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_audit(rows, least, add, scale, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = [g for g in groups if g[0] == lang]
        p = {}
        for g in [*own, None]:
            c = {t: counts[g][t] if g else sum(counts[x][t] for x in own) for t in kept}
            p[g] = {t: 1 + scale * (c[t] + add) // (sum(c.values()) + add * len(kept)) for t in kept}
        for g in own:
            pairs = sorted(((-sum(abs(p[g][t] - p[h][t]) for t in kept), h[1].encode()) for h in own if h != g))
            terms = sorted((p[None][t] - p[g][t], t.encode()) for t in kept if counts[g][t] and p[g][t] > p[None][t])[:top]
            out += [(*g, part, item.decode(), -value, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(5, 4), (1, 50)])
def test_audit_brute_force(docs, least, top):
    got = sorted(tuple(r) for r in divergence.audit(docs, least=least, add=3, scale=10**9, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(odd_rows(), least, 3, 10**9, top)


def test_audit_beyond_broadcasts_and_batches(docs, spark, monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in divergence.audit(docs, least=3, add=5, scale=10**9, top=6).select("lang", "source", "part", "item", "value", "rank").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_audit(odd_rows(), 3, 5, 10**9, 6)


def test_audit_of_nothing(docs, empty):
    assert divergence.audit(empty).count() == 0
    got = sorted(tuple(r) for r in divergence.audit(docs, least=10**6).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(odd_rows(), 10**6, 5, 10**9, 50)


def test_radix_selection_refines_ties_by_bytes(spark):
    rnd = random.Random(2)
    rows = [(g, "a" * 300 + rnd.choice("xyzé") * rnd.randint(0, 4) + str(k), rnd.choice([5, 5, 5, 9, 2**32])) for g in (1, 2) for k in range(60)] + [(3, "one", 0), (4, "", 1), (4, "b", 1)]
    made = spark.createDataFrame(rows, "gid bigint, term string, value bigint")
    for top in (1, 50):
        got = defaultdict(list)
        for r in divergence.select_top(made, 10**9, top, few=1).collect():
            got[r["gid"]].append((-r["value"], r["term"].encode()))
        for g in (1, 2, 3, 4):
            want = sorted((-v, t.encode()) for h, t, v in rows if h == g)[:top]
            assert sorted(got[g]) == want


def brute_collocations(rows, longest, least, share, top, scale):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _, _ in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", ascii_lower(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in good.items():
            if 100 * inside[p] >= share * a and inside[p]:
                continue
            score, k = min((scale * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("longest, least, top, load, hot, buffer", [(3, 4, 2000, 500_000, 1e-5, 10**6), (3, 2, 9, 50, 1e-3, 40), (4, 3, 2000, 300, 1e-2, 500)])
def test_collocations_brute_force(docs, longest, least, top, load, hot, buffer):
    got = collocation.collocations(docs, longest, least, 50, top, 10**6, load, hot, buffer)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_collocations(odd_rows(), longest, least, 50, top, 10**6)


def test_collocations_of_colliding_words(docs, monkeypatch):
    """Two words of one hash are told apart by the next salt."""
    monkeypatch.setattr(collocation, "MOST_BITS", 15)
    seen = []
    found = collocation.frequent_words

    def again(plain, least, salt):
        words_, sizes = found(plain, least, salt)
        seen.append(salt)
        return (words_.withColumn("others", F.lit(2)) if salt == 0 else words_), sizes

    monkeypatch.setattr(collocation, "frequent_words", again)
    got = collocation.collocations(docs, 3, 4)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(odd_rows(), 3, 4, 50, 2000, 10**6) and seen == [0, 1]


def test_frequent_words_tell_shared_hashes(spark):
    rows = [(1, "en", "a", 9), (1, "fr", "b", 1), (2, "en", "c", 2), (2, "en", "d", 2), (3, "en", "e", 9), (0, "en", None, 1)]
    got = collocation.told_apart(spark.createDataFrame(rows, "h bigint, lang string, word string, n bigint"), 9).collect()
    assert {r["word"]: r["others"] for r in got} == {"a": 2, "b": 2, "e": 1, None: 0}


def test_collocations_of_nothing(empty):
    assert collocation.collocations(empty).count() == 0


def library_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    return lambda text: np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("most", [600_000, 60])
def test_chunks_equal_the_library(most):
    ids_of, rnd = library_ids(), random.Random(1)
    letters = "aAbZ éÉßÀÖ×÷øØÿ'sStrevlmd09.,<|>-_ \n\t\x0b\x0c\r\x1c\x85\xa0œŒΣσİ😀é日本ﬁ\x00\x7f"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", "  ", " \n", "<|endoftext|> x", "a<|startoftext|>b", "don't we'll I'M l'd d'Accord", "'s", "1234 12.5", "É", "Ø'T", "x" * 5000, *[r[1] or "" for r in odd_rows()]]
    own = tokenfile.Chunks(WORDS, most)
    for part in (texts, texts[::-1], ["plain text only, É"], ["日"]):
        ids, lengths = own.batch(pa.array(part), 2)
        for t, got in zip(part, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            assert np.array_equal(got, ids_of(t)), t


def test_token_files_round_trip(docs, spark, tmp_path):
    folder, ids_of = str(tmp_path / "ids"), library_ids()
    tokenfile.write_ids(docs, WORDS, folder, frame=1000)
    got = sorted(((r["start"], r["doc_id"], bytes(r["ids"])) for r in tokenfile.read_ids(spark, folder).collect()))
    want = defaultdict(list)
    for r in odd_rows():
        want[r[0]].append(ids_of(r[1]).tobytes())
    at, order = 0, []
    for start, doc_id, ids in got:
        assert start == at
        want[doc_id].remove(ids)
        order.append((doc_id is not None, doc_id or 0))
        at += len(ids) // 4
    assert not any(want.values()) and order == sorted(order)
    # Any zstandard reader sees one stream of ids; ranges of a file in several tasks give the same rows.
    files = tokenfile.listing(folder)
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f"{folder}/{f['name']}", "rb"), read_across_frames=True).read() for f in files)
    assert np.array_equal(np.frombuffer(whole, "<u2"), np.frombuffer(b"".join(x[2] for x in got), "<u4"))
    spark.dataSource.register(tokenfile.SeekableIds)
    split = spark.read.format(tokenfile.FORMAT).option("split", 5000).load(folder)
    assert sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in split.collect()) == got


def test_requested_documents_alone_are_decompressed(docs, spark, tmp_path):
    folder = str(tmp_path / "ids")
    tokenfile.write_ids(docs, WORDS, folder, frame=500)
    every = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in tokenfile.read_ids(spark, folder).collect()}
    wanted = spark.createDataFrame([(3,), (150,), (150,), (301,), (None,), (999,), (200,)], "doc_id bigint")
    got = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in tokenfile.pick(wanted, folder).collect()}
    assert got == {k: v for k, v in every.items() if k[0] in (3, 150, 301, 200)}
    with open(f"{folder}/{max(tokenfile.listing(folder), key=lambda f: f['frames'])['name']}", "rb") as f:
        own = tokenfile.Seekable(pa.PythonFile(f))
        frames = len(own.table) - 1
        own.batch(np.array([0]), 0)
        assert frames > 10 and own.read <= 1 + own.length[0] // 500 + 1


def test_damaged_frames_and_second_writes_are_refused(docs, spark, tmp_path):
    folder = str(tmp_path / "ids")
    tokenfile.write_ids(docs, WORDS, folder, frame=500)
    tokenfile.write_ids(docs, WORDS, folder, frame=500)  # overwrites
    assert tokenfile.read_ids(spark, folder).count() == len(odd_rows()) and len([p for p in (tmp_path / "ids").iterdir() if p.suffix == ".zst"]) == len(tokenfile.listing(folder))
    with pytest.raises(Exception, match="holds files"):
        tokenfile.encode(docs, WORDS, 2).write.format(tokenfile.FORMAT).option("width", 2).mode("append").save(folder)
    with pytest.raises(Exception, match="larger than 2 bytes"):
        docs.select("doc_id", F.lit(1).cast("bigint").alias("key"), F.lit(b"\1\0\1\0").alias("ids")).coalesce(1).write.format(tokenfile.FORMAT).option("width", 2).mode("overwrite").save(str(tmp_path / "wide"))
    with pytest.raises(Exception, match="dealt by ranges"):
        spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).cast("bigint").alias("key"), F.lit(b"\1\0\0\0").alias("ids")).repartition(3).write.format(tokenfile.FORMAT).mode("overwrite").save(str(tmp_path / "mixed"))
    path = tmp_path / "ids" / tokenfile.listing(folder)[0]["name"]
    raw = bytearray(path.read_bytes())
    raw[40] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception, match="checksum|Zstd|zstd|decompress"):
        tokenfile.read_ids(spark, folder).collect()


def test_token_files_of_nothing(empty, spark, tmp_path):
    tokenfile.write_ids(empty, WORDS, str(tmp_path / "none"))
    assert tokenfile.read_ids(spark, str(tmp_path / "none")).count() == 0 and tokenfile.pick(empty, str(tmp_path / "none")).count() == 0


def test_token_file_query(spark):
    from scrubline.llm.queries import tokenfile_query

    ids_of, at = library_ids(), 0
    rows = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r) for r in tokenfile_query(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    for doc_id, text in rows:
        ids = ids_of(text)
        assert got[doc_id] == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
