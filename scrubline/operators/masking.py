"""Masking of values by label and policy, and replacement of spans in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.validators import digits


def mask_email(v: Column) -> Column:
    at = F.locate("@", v)
    local = F.substring_index(v, "@", 1)
    return F.when(at > 0, F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(local) - 1)), F.lit("@"), F.substring(v, at + 1, F.length(v)))).otherwise("[EMAIL]")


def mask_phone(v: Column) -> Column:
    d = digits(v)
    return F.when(F.length(d) < 6, "[PHONE]").otherwise(F.concat(F.substring(d, 1, 2), F.lit(" ** ** ** "), F.right(d, F.lit(2))))


def mask_iban(v: Column) -> Column:
    """The first four characters, a space, and a group of stars for each four more, with spaces between."""
    c = F.replace(v, F.lit(" "), F.lit(""))
    groups = F.array_join(F.array_repeat(F.lit("****"), F.ceil((F.length(c) - 4) / 4).cast("int")), " ")
    return F.when(F.length(c) < 4, "[IBAN]").otherwise(F.concat(F.substring(c, 1, 4), F.lit(" "), groups))


def mask_generic(v: Column, label: Column) -> Column:
    return F.when(F.length(v) <= 3, F.concat(F.lit("["), label, F.lit("]"))).otherwise(F.concat(F.substring(v, 1, 2), F.repeat(F.lit("*"), F.length(v) - 2)))


def pseudonym(label: Column, value: Column, secret: str, salt: str, scope: Column | str = "default") -> Column:
    """[LABEL_XXXXXXXX] with the first hex digits of an HMAC-SHA256, built from two digests and literal key blocks."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    message = F.concat_ws("|", F.lit(salt), F.lit(scope) if isinstance(scope, str) else scope, label, value)
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
    return F.concat(F.lit("["), label, F.lit("_"), F.upper(F.substring(mac, 1, 8)), F.lit("]"))


def replacement(label: Column, value: Column, action: Column, secret: str = "dev-secret", salt: str = "dev-salt", scope: Column | str = "default") -> Column:
    """What a span becomes; an action that isn't known is a pseudonym. Labels count in upper case."""
    upper = label = F.upper(label)
    masked = F.when(upper == "EMAIL", mask_email(value)).when(upper.isin("PHONE", "TELEPHONE", "MOBILE", "TEL"), mask_phone(value)).when(upper.isin("IBAN", "BANK_ACCOUNT"), mask_iban(value)).otherwise(mask_generic(value, label))
    box = lambda tail: F.concat(F.lit("["), upper, F.lit(tail))
    return F.when(action == "mask", masked).when(action == "generalize", box("]")).when(action == "redact", box("_REDACTED]")).when(action == "sensitive", "[SENSITIVE]").otherwise(pseudonym(label, value, secret, salt, scope))


def policy_action(label: Column, policy: dict[str, str], default: str = "pseudo") -> Column:
    from scrubline.functions.labels import lookup

    return F.coalesce(lookup({k.upper(): v for k, v in policy.items()}, F.upper(label)), F.lit(default)) if policy else F.lit(default)


def apply_spans(text: Column, spans: Column) -> Column:
    """Text with disjoint ordered spans (start, end, replacement) replaced; spans outside the text are left out."""
    ok = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["end"] > s["start"]))

    def step(state: Column, x: Column) -> Column:
        return F.struct(x["end"].alias("at"), F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), x["replacement"]).alias("out"))

    done = F.aggregate(ok, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(ok) > 0, done).otherwise(text)


def replaced(text: Column, spans: Column, policy: dict[str, str], default: str = "pseudo", **secrets: str) -> Column:
    """Text with its resolved spans (start, end, label, value) masked by the policy."""
    return apply_spans(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), replacement(s["label"], s["value"], policy_action(s["label"], policy, default), **secrets).alias("replacement"))))


def mask_documents(docs: DataFrame, policy: dict[str, str], default: str = "pseudo", spans: str = "spans", **secrets: str) -> DataFrame:
    """docs, which hold their resolved spans, with ``masked`` and ``n_masked``; nothing is shuffled."""
    return docs.withColumns({"masked": replaced(F.col("text"), F.col(spans), policy, default, **secrets), "n_masked": F.coalesce(F.size(spans), F.lit(0)).cast("bigint")})
