"""Detection rules: name, label, priority, pattern, group, validator and what each match holds."""

from __future__ import annotations

import json
import re
from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    pattern: str
    validator: str | None = None
    group: int = 0
    enabled: bool = True
    needs: str = ""  # a plain string or short pattern that lies in each match: texts without it aren't searched


# The patterns that detection must agree on.
_EN = "January|February|March|April|May|June|July|August|September|October|November|December"
_FR = r"janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre"
_NUMBER = r"(?:\d{1,3}(?:[.,\s ]\d{3})+|\d{1,9})(?:[.,]\d{2})?"
RULES = (
    Rule("stripe_secret", "API_KEY", 1, r"sk_(?:live|test|adm)_[0-9a-zA-Z]{24,}", needs="sk_"),
    Rule("aws_key_id", "AWS_KEY", 1, r"AKIA[0-9A-Z]{16}", needs="AKIA"),
    Rule("google_api", "API_KEY", 1, r"AIza[0-9A-Za-z\-_]{35}", needs="AIza"),
    Rule("generic_secret", "SECRET", 1, r"sk_[0-9A-Za-z]{16,64}", needs="sk_"),
    Rule("iban", "IBAN", 2, r"(?i)\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}\b", "iban", needs=r"\d"),
    Rule("bic", "BIC", 2, r"(?i)\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", "bic", enabled=False),
    Rule("nir_ssn", "NIR", 2, r"(?i)\b[12](?:[ -]?)[0-9]{2}(?:[ -]?)(0[1-9]|1[0-2])(?:[ -]?)(2[AB]|[0-9]{2})(?:[ -]?)[0-9]{3}(?:[ -]?)[0-9]{3}(?:(?:[ -]?)([0-9]{2}))?\b", "nir", needs=r"\d"),
    Rule("credit_card", "CARD", 2, r"\b(?:\d[ -]?){13,19}\b", "luhn", needs=r"\d"),
    Rule("uuid", "UUID", 3, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", needs=r"\d"),
    Rule("mac_address", "MAC", 3, r"\b[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}\b", needs=":"),
    Rule("ticket_id", "TICKET", 3, r"\b[A-Z][A-Z0-9]{1,9}-\d+\b", needs=r"\d"),
    Rule("ipv4", "IP", 2, r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)", needs=r"\d"),
    Rule("ipv6", "IP", 2, r"(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}", needs=":"),
    Rule("url_http", "URL", 2, r"(?i)\bhttps?://[\w\-._~:/?#\[\]@!$&'()*+,;=%]+", needs="://"),
    Rule("url_nonhttp", "URL", 2, r"(?i)(?:sftp|ssh|s3|gs|git\+ssh|scp)://\S+", needs="://"),
    Rule("hostname", "HOST", 3, r"\b(?:[a-zA-Z0-9-]{1,63}\.)+[a-zA-Z]{2,63}\b", enabled=False),
    Rule("email_strict", "MAIL", 3, r"(?<![\w@])[a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}", needs="@"),
    Rule("phone_international", "TELEPHONE", 3, r"(?:\+|00)[1-9]\d{1,14}|(?:\+33|0)[1-9]\d{8}", "phone", needs=r"\d"),
    Rule("phone_fr_loose", "TELEPHONE", 3, r"(?i)(?<!\w)(?:\+\d{1,3}|0{1,2}\s?-?\d{1,3}|0)[\s.-]?\d(?:[\s.-]?\d{2}){4}(?!\w)", "phone", needs=r"\d"),
    Rule("phone_context_short", "TELEPHONE", 3, r"(?i)(?:\b(?:tel|tél|téléphone|telephone|phone|mobile|portable)\b\s*(?:is|=|:)?\s*)(\d{1,4}[\s.-]?\d{3}[\s.-]?\d{4})\b", "phone", 1, needs=r"\d"),
    Rule("path_unix", "PATH", 4, r"(?<!\w)/(?!/)[^\s]+", needs="/"),
    Rule("path_windows", "PATH", 4, r"\b[A-Za-z]:\\\\(?:[^\\\\\s]+\\\\)*[^\\\\\s]*", needs=":"),
    Rule("ssn_us", "SSN", 2, r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", "ssn", needs=r"\d"),
    Rule("phone_us", "TELEPHONE", 3, r"(?<!\d)\(\d{3}\)\s?\d{3}[-\s.]\d{4}\b", "phone", needs=r"\d"),
    Rule("date_iso", "DATE", 3, r"\b\d{4}-\d{2}-\d{2}\b", needs=r"\d{4}"),
    Rule("date_en_full", "DATE", 3, rf"(?i)\b\d{{1,2}}\s+({_EN})\s+\d{{4}}\b", needs=r"\d{4}"),
    Rule("date_en_comma", "DATE", 3, rf"(?i)\b({_EN})\s+\d{{1,2}},\s*\d{{4}}\b", needs=r"\d{4}"),
    Rule("date_en_month_year", "DATE", 3, rf"(?i)\b({_EN})\s+\d{{4}}\b", needs=r"\d{4}"),
    Rule("date_fr_full", "DATE", 3, rf"(?i)\b(\d{{1,2}}|1er)\s+({_FR}|janv\.?,?|févr\.?,?|fevr\.?,?|avr\.?,?|juil\.?,?|sept\.?,?|oct\.?,?|nov\.?,?|déc\.?,?|dec\.?)\s+\d{{4}}\b", needs=r"\d{4}"),
    Rule("date_fr_month_year", "DATE", 3, rf"(?i)\b({_FR}|janv\.?|févr\.?|fevr\.?|avr\.?|juil\.?|sept\.?|oct\.?|nov\.?|déc\.?|dec\.?)\s+\d{{4}}\b", needs=r"\d{4}"),
    Rule("date_numeric", "DATE", 3, r"\b\d{1,2}[\/\-.]\d{1,2}[\/\-.]\d{2,4}\b", needs=r"\d"),
    Rule("date_quarter_year", "DATE", 3, r"(?i)\bQ[1-4]\s*\d{4}\b", needs=r"\d{4}"),
    Rule("username_keyval", "USERNAME", 3, r"(?i)\b(?:user|username|login|utilisateur)\s*[:=]\s*([A-Za-z0-9._-]{3,64})", None, 1, needs="[:=]"),
    Rule("username_linux", "USERNAME", 3, r"\buid=\d+\(([^)]+)\)", None, 1, needs="uid="),
    Rule("amount_currency_prefix", "MONTANT", 3, rf"(?i)\b(?:EUR|USD|NOK|SEK|GBP|CHF|CAD|AUD|JPY|CNY)\s*{_NUMBER}\b", needs=r"\d"),
    Rule("amount_symbol_prefix", "MONTANT", 3, rf"(?i)(?<![\w<])(?:€|\$|£)\s?{_NUMBER}\b", needs=r"\d"),
    Rule("amount_suffix", "MONTANT", 3, rf"(?i)\b{_NUMBER}\s?(?:euros?|EUR|USD|NOK|dollars?|SEK|GBP|pounds?|livres|CHF|CAD|AUD|JPY|CNY)\b", needs=r"\d"),
    Rule("amount_symbol_suffix", "MONTANT", 3, rf"(?i)\b{_NUMBER}\s?(?:€|\$|£)(?!\w)", needs=r"\d"),
    Rule("code_legal", "CODE", 3, r"(?i)\b(?:Article|Art\.?)\s+\d+[A-Za-z]?\b", enabled=False, needs=r"\d"),
    Rule("code_law", "CODE", 3, r"(?i)\b(?:Law|Decree|Act)\s+no\.?\s*\d+[A-Za-z]?\b", enabled=False, needs=r"\d"),
)
FORBIDDEN = ("@", "sk_", "AKIA", "+33")
BY_NAME = {r.name: r for r in RULES}

# Names in news and sports texts, and the lines that they stand in.
_TITLE = r"(?:[A-Z][A-Za-z]+(?:[-'][A-Za-z]+)*|[A-Z]{2,}(?:[.-][A-Z]{1,})*)"
_CONNECTOR = r"(?:of|and|the|for|de|del|della|dello|des|du|da|van|von|la|le|los|las)"
_NAME = rf"{_TITLE}(?:\s+(?:{_TITLE}|{_CONNECTOR})){{0,5}}"
_FIXTURE = rf"(?m)({_NAME})(?:\s+\(\s*\d+\s*\))?\s+[vV]\s+({_NAME})(?:\s+\(\s*\d+\s*\))?(?=\s|$)"
_SCORE = rf"(?m)^({_NAME})\s+\d+\s+({_NAME})\s+\d+(?:\s*\.)?\s*$"
_ALIAS = rf"({_NAME})\s+\(\s*([A-Z](?:[A-Z.]{{1,}}))\s*\)"
NEWS_RULES = (
    Rule("fixture_left", "ORG", 5, _FIXTURE, None, 1),
    Rule("fixture_right", "ORG", 5, _FIXTURE, None, 2),
    Rule("standings_row", "ORG", 5, rf"(?m)^({_NAME})\s+\d+(?:\s+\d+){{3,}}\s*$", None, 1),
    Rule("score_first", "ORG", 5, _SCORE, None, 1),
    Rule("score_second", "ORG", 5, _SCORE, None, 2),
    Rule("organisation_context", "ORG", 5, rf"({_NAME}\s+(?:news agency|newspaper|Party|Council|Union|Administration))", None, 1),
    Rule("alias_long", "ORG", 5, _ALIAS, None, 1),
    Rule("alias_short", "ORG", 5, _ALIAS, None, 2),
    Rule("bare_agency", "ORG", 5, r"\b(?:told|quoted|according to)\s+(Reuters|Interfax|Itar-Tass|TASR)\b", None, 1),
)


def user_rules(spec: dict) -> tuple[Rule, ...]:
    """Rules of a mapping as users keep it in a file: name -> regex, entity_type, priority, validate_with, group_index and
    enabled; by priority. A pattern that doesn't compile, or is missing, is left out."""
    out = []
    for name, r in spec.items():
        try:
            re.compile(r["regex"])
        except (KeyError, TypeError, re.error):
            continue
        out.append(Rule(name, r.get("entity_type") or name.upper(), int(r.get("priority", 999)), r["regex"], r.get("validate_with"), int(r.get("group_index") or 0), bool(r.get("enabled", True))))
    return tuple(sorted(out, key=lambda r: r.priority))


def read_rules(path: str) -> tuple[Rule, ...]:
    """User rules from a JSON or YAML file with a key patterns."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return user_rules(json.loads(text).get("patterns", {}))
    import yaml

    return user_rules((yaml.safe_load(text) or {}).get("patterns", {}))


def java(pattern: str) -> str:
    """The same pattern for the JVM, with Unicode classes and case folding."""
    return "(?U)" + pattern.replace("(?i)", "(?iu)")
