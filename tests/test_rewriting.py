"""Chunk-wise rewriting against the same on single texts."""

import re

from pyspark.sql import functions as F

from scrubline.operators import rewriting

KIND = "doc_id bigint, text string, leaks array<struct<attribute:string,evidence:string,confidence:double>>, kept int"
BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ])|(?:\n\s*\n)")


def chunks_of(text, most):
    parts, at = [], 0
    for m in [*BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            parts.append((at, end))
        at = m.end() if m else end
    out = []
    for a, b in parts:
        if out and out[-1][1] - out[-1][0] + b - a + 1 <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def respond(k, chunk):
    return [chunk.replace("Zoe", "someone").replace("zoe", "someone"), "x", None, "  a wholly new sentence that is long enough for this chunk to be taken.  "][k % 4]


def by_hand(text, leaks, most):
    sure = [x for x in leaks or [] if x[2] is not None and x[2] >= 0.5]
    out, asked, taken, at = "", 0, 0, 0
    for k, (a, b) in enumerate(chunks_of(text or "", most)):
        out += text[at:a]
        chunk, at = text[a:b], b
        if any((x[1] or "").strip() and x[1].strip().lower() in chunk.lower() for x in sure):
            asked += 1
            new = (respond(k, chunk) or "").strip()
            if new and len(new) >= 0.3 * len(chunk):
                chunk, taken = new, taken + 1
        out += chunk
    out += (text or "")[at:]
    return (out, asked, taken) if asked and len(out) >= 0.4 * len(text) else (text, asked, 0)


def test_only_chunks_with_leaks_are_rewritten(spark, tmp_path):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    leak = [("name", " Zoe ", 0.9), ("age", "forty", 0.4), ("x", None, 0.9), ("y", "", 0.8), ("z", "none", None)]
    text = "  Zoe came here. Nothing to see at all.\n\nHe said no. And ZOE went away. The end of it is near. Zoe!\n\n \n Last words, zoe. "
    long = "Short. " + "Zoe is " * 60 + ". Then nothing more."
    rows = [(1, text, leak, 7), (None, text, leak, 8), (1, text, leak, 9), (2, text, [("age", "Zoe", 0.4)], 1), (3, text, None, 1), (4, None, leak, 1), (5, " \n", leak, 1), (6, "no name here", leak, 1), (2**60 + 1, long, leak, 1), (8, "Zoe", leak, 1), (9, "forty Zoes. Zoe. " * 30, leak, None)]
    docs = spark.createDataFrame(rows, KIND)
    seen = []

    def answer(asked):
        seen.append(asked.select("row", "chunk", "text", F.size("issues").alias("n")).collect())
        k = F.col("chunk") % 4
        new = F.when(k == 0, F.replace(F.replace("text", F.lit("Zoe"), F.lit("someone")), F.lit("zoe"), F.lit("someone"))).when(k == 1, "x").when(k == 3, F.lit("  a wholly new sentence that is long enough for this chunk to be taken.  "))
        return asked.select("row", "chunk", new.alias("response"))

    for most in (30, 60, 10_000):
        got = rewriting.rewrite_leaks(docs, answer, most).collect()
        want = [(r[0], r[3], *by_hand(r[1], r[2], most)) for r in rows]
        assert sorted(((r["doc_id"], r["kept"], r["text"], r["asked"], r["rewritten"]) for r in got), key=str) == sorted(want, key=str)
        assert all("zoe" in r["text"].lower() and r["n"] == 1 for r in seen[-1])
    assert rewriting.rewrite_leaks(docs.limit(0), answer).count() == 0
