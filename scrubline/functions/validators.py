"""Value checks as column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def clean_identifier(v: Column) -> Column:
    return F.translate(v, " -", "")


def luhn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) > 0) & F.call_function("luhn_check", d)


def iban(v: Column, checksum: bool = True) -> Column:
    """Modulo 97 over letters as numbers; without checksum only length and country letters."""
    c = F.upper(clean_identifier(v))
    shape = F.length(c).between(15, 34) & F.regexp_like(c, F.lit("^[A-Z]{2}"))
    if not checksum:
        return shape
    moved = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
    value = lambda ch: F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    left = F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise((acc * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97))
    return shape & F.regexp_like(c, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")) & (left == 1)


def bic(v: Column) -> Column:
    return F.regexp_like(F.upper(clean_identifier(v)), F.lit("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"))


def french_ssn(v: Column) -> Column:
    """Sex, year, month, department (also Corsican), commune and order; with a key, it is 97 minus the number modulo 97,
    where 2A and 2B count as 19 and 18."""
    c = F.upper(clean_identifier(v))
    ok = F.regexp_like(c, F.lit("^[12][0-9]{2}(0[1-9]|1[0-2])(2A|2B|[0-9]{2})[0-9]{6}([0-9]{2})?$"))
    number = F.replace(F.replace(F.substring(c, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18")).try_cast("bigint")
    return ok & ((F.length(c) == 13) | F.coalesce(97 - number % 97 == F.substring(c, 14, 2).try_cast("bigint"), F.lit(False)))


def us_ssn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def phone(v: Column) -> Column:
    return F.length(digits(v)).between(7, 15)


VALIDATORS = {"luhn": luhn, "iban": iban, "bic": bic, "nir": french_ssn, "french_ssn": french_ssn, "ssn": us_ssn, "us_ssn": us_ssn, "phone": phone}
BY_LABEL = {"IBAN": "iban", "TELEPHONE": "phone", "BIC": "bic"}


def get_validator(name: str | None):
    """By name in any case; None for none or an unknown one."""
    return VALIDATORS.get((name or "").lower())
