"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are strong by themselves: ``assign`` (keyword, sign and a value of 8 or more characters), ``access`` (access
identifiers) and ``hex`` (32 or more hexadecimal digits), each leftmost and non-overlapping. Weak candidates are account
names (``link_id``), long mixed strings (``link_secret``) and service addresses (``link_endpoint``); a weak candidate
wholly inside a base span is that span's own text and is left out. Parts have roles: identifier (access, link_id), secret
(assign, hex, link_secret) and endpoint (link_endpoint). Complementary parts are a secret for an identifier, an identifier
for a secret, and both for an endpoint.

An interval join within each row meets every weak candidate with the parts of its complementary roles whose scopes
(``reach`` code points around them) meet it; only candidates whose complementary parts are there are reported. The join is
a sweep over the spans in the order of their starts: of the parts before, the furthest end decides, of those after, the
nearest start. So its time grows with the spans of a text, not with their pairs.

All offsets are code points, found from the pieces between matches, so nothing leaves the JVM and nothing is shuffled.
Nulls and empty texts have no spans, an empty table has no rows. Spans of one start are ordered by kind as listed above.
Very long texts are scanned whole; a text's spans are held in one row. Repeated rows have equal results. Other columns
aren't read and come back as they are, whatever their names; only ``doc_id`` and ``text`` have a meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.arrays import let, maxima, sums

KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
ROLES = {"identifier": ("access", "link_id"), "secret": ("assign", "hex", "link_secret"), "endpoint": ("link_endpoint",)}
NEEDS = {"link_id": ("secret",), "link_secret": ("identifier",), "link_endpoint": ("identifier", "secret")}
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The runs of these two end where the class ends, so a least length keeps just the matches that pass.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LINK_ID = r"""(?i)(?:user(?:_?name|_?id)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
LINK_SECRET = r"[A-Za-z0-9+/]{40,}={0,2}"
LINK_ENDPOINT = r"(?i)(?:https?|ftp|ssh|amqps?|redis|mysql|mongodb|postgres(?:ql)?|jdbc:[a-z]+)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
NONE = 2**31 - 1


def located(text: Column, pattern: str, kind: str, group: int | None = None, passes: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the matches of a pattern; passes may drop some by the text of a group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    columns = [whole.alias("whole"), F.split(text, pattern, -1).alias("between")]
    columns += [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("checked")] if group else []

    def spans(z: Column) -> Column:
        """Of pairs (match, text before it); the last text between has no match."""
        real = F.filter(z, lambda x: x["whole"].isNotNull())
        ends = sums(F.transform(real, lambda x: F.length(x["between"]) + F.length(x["whole"])))
        both = F.zip_with(real, ends, lambda x, end: F.struct((end - F.length(x["whole"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), (passes(x["checked"]) if passes else F.lit(True)).alias("ok")))
        return F.transform(F.filter(both, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.arrays_zip(*columns), spans).cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def _is(span: Column, kinds: tuple[str, ...]) -> Column:
    return span["rank"].isin(*[KINDS.index(k) for k in kinds])


def _linked(spans: Column, reach: int) -> Column:
    """The weak ones of all spans, ordered by start, that meet a part of each role they need."""
    base = maxima(F.transform(spans, lambda s: F.when(_is(s, KINDS[:3]), s["end"]).otherwise(-NONE)))
    # At one start the base spans come first; a base span that begins earlier and ends later holds the candidate too.
    own = F.transform(F.filter(F.zip_with(spans, base, lambda s, b: F.struct(s.alias("s"), (_is(s, KINDS[:3]) | (b < s["end"])).alias("ok"))), lambda x: x["ok"]), lambda x: x["s"])

    def joined(kept: Column) -> Column:
        def before(role: str) -> Column:
            return maxima(F.transform(kept, lambda s: F.when(_is(s, ROLES[role]), s["end"]).otherwise(-NONE)))

        def after(role: str) -> Column:
            """Of each place, the nearest start at or behind it, negated."""
            return F.reverse(maxima(F.transform(F.reverse(kept), lambda s: F.when(_is(s, ROLES[role]), -s["start"]).otherwise(-NONE))))

        zipped = F.arrays_zip(kept.alias("s"), *[side(role).alias(f"{name}_{role}") for role in ("identifier", "secret") for name, side in (("before", before), ("after", after))])

        def meets(x: Column, role: str) -> Column:
            return (x[f"before_{role}"] >= x["s"]["start"] - reach) | (x[f"after_{role}"] >= -(x["s"]["end"] + reach))

        def found(x: Column) -> Column:
            test = F.lit(False)
            for kind, roles in NEEDS.items():
                needs = meets(x, roles[0])
                for role in roles[1:]:
                    needs = needs & meets(x, role)
                test = test | (_is(x["s"], (kind,)) & needs)
            return test

        return F.transform(F.filter(zipped, found), lambda x: x["s"])

    return let(own, joined)


def secret_spans(text: Column, reach: int = 200) -> Column:
    """struct<base, linked> of arrays of spans, each ordered by start and kind."""

    def all_of(t: Column) -> Column:
        base = F.array_sort(F.concat(located(t, ASSIGN, "assign", 2, lambda g: F.length(g) >= 8), located(t, ACCESS, "access"), located(t, HEX, "hex")))
        weak = F.concat(located(t, LINK_ID, "link_id"), located(t, LINK_SECRET, "link_secret"), located(t, LINK_ENDPOINT, "link_endpoint"))
        none = F.array().cast(f"array<{SPAN}>")
        return let(F.struct(base.alias("base"), weak.alias("weak")), lambda f: F.struct(f["base"].alias("base"), F.when(F.size(f["weak"]) > 0, let(F.array_sort(F.concat(f["base"], f["weak"])), lambda s: _linked(s, reach))).otherwise(none).alias("linked")))

    return let(F.coalesce(text.cast("string"), F.lit("")), all_of)


def shown(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans as text, for every row."""
    found = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), secret_spans(docs["text"], reach).alias("found"))
    count = lambda kind: F.size(F.filter("found.base", lambda s: _is(s, (kind,)))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(F.col("found.base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("found.base", "found.linked"))).alias("spans"))


def replaced(text: Column, spans: Column, mark: str, block: int = 4096) -> Column:
    """The text with each island of overlapping spans as one mark. spans: ordered by start, at least one.

    Substrings are counted from the text's beginning, so they are taken from blocks of the text instead."""

    def built(x: Column) -> Column:
        chunks, ends = x["chunks"], x["ends"]

        def piece(a: Column, b: Column) -> Column:
            """Code points a to b."""
            i, j = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
            chunk = lambda k: F.coalesce(F.try_element_at(chunks, k + 1), F.lit(""))
            first = F.substring(chunk(i), (a % block + 1).cast("int"), F.lit(block))
            inside = F.substring(chunk(i), (a % block + 1).cast("int"), (b - a).cast("int"))
            return F.when(i == j, inside).otherwise(F.concat(first, F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(chunk(j), F.lit(1), (b % block).cast("int"))))

        before = F.concat(F.array(F.lit(0)), ends)
        zipped = F.zip_with(spans, F.slice(before, 1, F.size(ends)), lambda s, a: F.struct(s["start"].alias("start"), a.alias("a")))
        parts = F.transform(F.filter(zipped, lambda z: z["start"] >= z["a"]), lambda z: F.concat(piece(z["a"], z["start"]), F.lit(mark)))
        return F.concat(F.array_join(parts, ""), piece(F.element_at(ends, -1), x["n"]))

    ends = maxima(F.transform(spans, lambda s: s["end"]))
    return let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("chunks"), ends.alias("ends"), F.length(text).alias("n")), built)


def redact(docs: DataFrame, reach: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of their texts replaced by a mark; rows without spans keep their texts."""
    text = docs["text"].cast("string")
    masked = let(secret_spans(text, reach), lambda f: let(F.array_sort(F.concat(f["base"], f["linked"])), lambda s: F.when(F.size(s) > 0, replaced(text, s, mark)).otherwise(text)))
    return docs.select(*[masked.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])
