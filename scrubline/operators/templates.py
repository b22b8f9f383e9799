"""Texts from a phrase library: a grammar of phrases as a table, expanded for each scenario without an exchange.

A grammar has rows of domain, slot (its place), scope (its name), option, needs and unless (flags that a scenario must and
must not have) and parts (text, or a label or field whose value is said). Of a slot's options those that fit are counted and
one is taken by the scenario's seed modulo their number; a slot without any says nothing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.arrays import let
from scrubline.operators.generation import EMAIL, SUPPORT, compose

GRAMMAR = "domain string, slot int, scope string, option int, needs array<string>, unless array<string>, parts array<struct<text: string, label: string, field: string>>"
MOST = 20_000  # phrases of a grammar: it goes along with every task

# The library: for each domain its slots in order, for each slot its phrases. "[a b !c]" before a phrase: flags that it needs
# or must not meet; {LABEL} is a mention, {field} a value that is no mention.
PHRASES: dict[str, dict[str, tuple[str, ...]]] = {
    SUPPORT: {
        "subject": ("[goal=billing_mismatch] Objet : écart de facturation sur {PRODUCT_CONTEXT}\n\n", "[goal=access_issue] Objet : accès refusé à {PRODUCT_CONTEXT}\n\n", "[urgency=high] Objet : urgent, {PRODUCT_CONTEXT} à l'arrêt\n\n", "[!urgency=high] Objet : question sur {PRODUCT_CONTEXT}\n\n", "[!urgency=high] Objet : souci avec {PRODUCT_CONTEXT}\n\n"),
        "greeting": ("[address=vous] Bonjour,\n", "[address=vous register=soutenu] Madame, Monsieur,\n", "[address=tu] Salut,\n", "[address=tu] Hello,\n"),
        "who": ("Ici {PERSON_NAME}, {ROLE} dans l'équipe {TEAM}.\n", "[!value:PERSON_NAME] Je suis {ROLE} au sein de {TEAM}.\n", "[!value:PERSON_NAME] J'écris pour l'équipe {TEAM}, où je suis {ROLE}.\n"),
        "background": ("[plan:TENURE] J'ai {TENURE} chez {ORG_NAME_STRONG} et je n'avais jamais vu cela.\n", "[plan:AGE_RANGE] Pour situer : {AGE_RANGE}, poste tenu à {LOCATION}.\n", "[plan:DEGREE] Avec mon {DEGREE}, je lis les journaux sans trop de mal.\n"),
        "problem": ("[goal=access_issue] La connexion est rejetée {when}.\n", "[goal=sync_delay] La synchronisation prend du retard {when}.\n", "[goal=data_gap] Il manque des lignes {when}.\n", "[goal=billing_mismatch] Les montants ne collent plus {when}.\n", "[!goal=access_issue !goal=sync_delay !goal=data_gap !goal=billing_mismatch] Le service répond mal {when}.\n", "[!goal=access_issue !goal=sync_delay !goal=data_gap !goal=billing_mismatch] Rien ne passe {when}.\n"),
        "tried": ("[!noise=low] Une relance n'a rien changé.\n", "[!noise=low] Les traces ne disent rien de clair.\n", "[noise=high] Tout a été rejoué deux fois, sans effet, pour {PROJECT_NAME_STRONG}.\n"),
        "private": ("[private value:HEALTH] Par ailleurs {HEALTH}.\n", "[private value:FAMILY_STATUS] De plus {FAMILY_STATUS}.\n"),
        "contact": ("[direct] On me joint au {PHONE} ou par {EMAIL}.\n", "[direct] Mon adresse est {EMAIL}, mon compte {ACCOUNT_ID}.\n", "[direct] Compte {ACCOUNT_ID}, identifiant {USERNAME}, téléphone {PHONE}.\n"),
        "ask": ("[address=vous urgency=high] Pouvez-vous regarder aujourd'hui ?\n", "[address=vous !urgency=high] Pourriez-vous y jeter un œil ?\n", "[address=tu urgency=high] Tu peux regarder tout de suite ?\n", "[address=tu !urgency=high] Tu peux y jeter un œil ?\n"),
        "jargon": ("{JARGON_PATTERN}\n",),
        "closing": ("[address=vous] Cordialement,\n", "[address=vous register=soutenu] Avec mes salutations distinguées,\n", "[address=tu] À plus,\n"),
        "signature": ("{PERSON_NAME}\n", "[!value:PERSON_NAME] L'équipe {TEAM}\n"),
    },
    EMAIL: {
        "subject": ("[urgency=high] Objet : à traiter ce jour, {PRODUCT_CONTEXT}\n\n", "[goal=handover] Objet : passation de {PROJECT_NAME_STRONG}\n\n", "[!goal=handover !urgency=high] Objet : point sur {PROJECT_NAME_STRONG}\n\n", "[!goal=handover !urgency=high] Objet : suite de notre échange\n\n"),
        "greeting": ("[address=vous] Bonjour {recipient},\n", "[address=vous] Bonjour,\n", "[address=tu] Salut {recipient},\n"),
        "thread": ("[unit=thread_short] > Merci pour le retour d'hier, on en reparle.\n", "[unit=thread_short] > Bien reçu, je reviens vers vous.\n"),
        "who": ("Je reprends le sujet pour {TEAM}, en tant que {ROLE}.\n", "Comme {ROLE} de {TEAM}, je fais le lien.\n"),
        "background": ("[plan:TENURE] Avec {TENURE}, je connais ce dossier.\n", "[plan:AGE_RANGE] Je fais partie des {AGE_RANGE} de l'étage.\n", "[plan:DEGREE] Mon {DEGREE} sert enfin.\n", "[plan:CERTIFICATION] J'ai passé {CERTIFICATION} pour cela.\n"),
        "body": ("[goal=coordination] Il faut caler nos dates avec {ORG_NAME_STRONG}.\n", "[goal=project_followup] {PROJECT_NAME_STRONG} avance, deux points restent ouverts.\n", "[goal=urgent_incident] {PRODUCT_CONTEXT} est tombé {when}.\n", "[goal=capacity_alert] La charge monte {when}.\n", "[goal=delivery_risk] La livraison de {PROJECT_NAME_STRONG} glisse.\n", "[!goal=coordination !goal=project_followup !goal=urgent_incident !goal=capacity_alert !goal=delivery_risk] Voici où nous en sommes {when}.\n"),
        "rare": ("[plan:RARE_RESPONSIBILITY] Je reste la seule personne à suivre {RARE_RESPONSIBILITY}.\n",),
        "private": ("[private value:HEALTH] Je dois aussi dire que {HEALTH}.\n", "[private value:FAMILY_STATUS] À côté, {FAMILY_STATUS}.\n"),
        "contact": ("[direct] Mon numéro : {PHONE}.\n", "[direct] Écrivez à {EMAIL} (compte {ACCOUNT_ID}).\n"),
        "ask": ("[address=vous] Qu'en pensez-vous ?\n", "[address=vous] Merci de me confirmer.\n", "[address=tu] Tu me confirmes ?\n"),
        "closing": ("[address=vous] Bien à vous,\n", "[address=tu] Merci,\n"),
        "signature": ("{PERSON_NAME}\n{SIGNATURE_PATTERN}", "[!value:PERSON_NAME] {SIGNATURE_PATTERN}"),
    },
}


def read_phrase(phrase: str) -> tuple[list[str], list[str], list[tuple[str | None, str | None, str | None]]]:
    """Flags that it needs, flags that it must not meet, and its parts. Every value it says is needed as well."""
    flags, rest = re.fullmatch(r"(?:\[([^\]]*)\] )?(.*)", phrase, re.S).groups()
    needs = [f for f in (flags or "").split() if f[0] != "!"]
    unless = [f[1:] for f in (flags or "").split() if f[0] == "!"]
    parts: list[tuple[str | None, str | None, str | None]] = []
    for text, name in re.findall(r"([^{}]+)|\{(\w+)\}", rest):
        parts.append((text, None, None) if text else (None, name, None) if name.isupper() else (None, None, name))
        if name:
            needs.append(f"value:{name}")
    return list(dict.fromkeys(needs)), unless, parts


def library(spark: SparkSession, phrases: dict[str, dict[str, tuple[str, ...]]] = PHRASES) -> DataFrame:
    """The grammar table of a phrase library."""
    rows = [(domain, k, scope, n, *read_phrase(p)) for domain, slots in phrases.items() for k, (scope, options) in enumerate(slots.items()) for n, p in enumerate(options)]
    return spark.createDataFrame(rows, GRAMMAR)


def code_sum(text: Column) -> Column:
    """Sum of the code points of a string."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda acc, c: acc + F.ascii(c))


def flags_of(scenario: dict[str, Column], plan: Column, values: Column, direct: Column, private: Column) -> Column:
    """The flags of a scenario: name=value for its fields, plan:LABEL for what it plans, value:NAME for what can be said."""
    named = F.array(*[F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit(""))) for k, c in scenario.items()])
    also = F.array_compact(F.array(F.when(direct, F.lit("direct")), F.when(private, F.lit("private"))))
    return F.concat(named, also, F.transform(plan, lambda m: F.concat(F.lit("plan:"), m["label"])), F.transform(F.map_keys(values), lambda k: F.concat(F.lit("value:"), k)))


def expand(scenarios: DataFrame, grammar: DataFrame, flags: Column, values: Column, seed: Column, name: str = "parts") -> DataFrame:
    """scenarios (with domain) with a column of parts (text, label, canonical_value) for ``compose``; none for a domain without
    phrases. flags: array of strings; values: map of strings, null values can't be said; seed: a whole number, to which a slot
    adds the sum of the code points of its scope."""
    if grammar.count() > MOST:
        raise ValueError(f"a grammar of more than {MOST} phrases can't go along with every task")
    slots = grammar.groupBy("domain", "slot", "scope").agg(F.array_sort(F.collect_list(F.struct("option", "needs", "unless", "parts"))).alias("options"), code_sum(F.col("scope")).alias("add"))
    own = slots.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("slot", "add", "options"))).alias("_slots"))
    none = F.array().cast("array<struct<text: string, label: string, canonical_value: string>>")

    def said(p: Column) -> Column:
        value = F.try_element_at(values, F.coalesce(p["label"], p["field"], F.lit("")))
        return F.struct(F.coalesce(p["text"], value).alias("text"), p["label"].alias("label"), F.when(p["label"].isNotNull(), value).alias("canonical_value"))

    def chosen(slot: Column) -> Column:
        # Few flags are asked of each phrase: looking these up costs far less than a set of all flags for each.
        met = lambda f: F.array_contains(flags, f)
        fits = F.filter(slot["options"], lambda o: F.forall(o["needs"], met) & ~F.exists(o["unless"], met))
        return let(fits, lambda ok: F.when(F.size(ok) > 0, F.transform(F.get(ok, ((seed + slot["add"]) % F.size(ok)).cast("int"))["parts"], said)).otherwise(none))

    joined = scenarios.join(F.broadcast(own), "domain", "left")
    return joined.withColumn(name, F.coalesce(F.flatten(F.transform("_slots", chosen)), none)).drop("_slots")


def documents(scenarios: DataFrame, grammar: DataFrame, values: Column, forms: Column) -> DataFrame:
    """scenario_id, author_id, domain, split, text, grounding and spans of each scenario (see ``generation.scenarios``), told by
    the grammar. values: map of labels and fields to what is said of the author; forms: other ways to say a label."""
    known = F.map_filter(F.map_concat(values, F.create_map(F.lit("recipient"), F.col("recipient_role"))), lambda _, v: F.coalesce(v, F.lit("")) != "")
    fields = {"goal": F.col("goal"), "urgency": F.col("urgency"), "noise": F.col("noise_level"), "unit": F.col("unit_type"), "difficulty": F.col("difficulty"), "register": F.col("register"), "address": F.col("address_form")}
    seed = code_sum(F.concat_ws("|", "scenario_id", "recipient_role", "goal", "urgency", "noise_level"))
    # Direct identifiers are said only where the scenario plans them.
    direct = F.transform(F.filter("mention_plan", lambda m: m["label"].isNotNull()), lambda m: m["label"])
    told = let(direct, lambda d: F.map_filter(known, lambda k, _: ~k.isin("PERSON_NAME", "EMAIL", "PHONE", "USERNAME", "ACCOUNT_ID") | F.array_contains(d, k)))
    rows = scenarios.withColumns({"_values": told, "_seed": seed, "_forms": forms})
    rows = rows.withColumn("_flags", flags_of(fields, F.col("mention_plan"), F.col("_values"), F.col("include_direct"), F.col("include_sensitive")))
    rows = expand(rows, grammar, F.col("_flags"), F.col("_values"), F.col("_seed"), "_parts")
    return rows.withColumn("_d", compose(F.col("_parts"), F.col("mention_plan"), F.col("_forms"))).select("scenario_id", "author_id", "domain", "split", "_d.text", "_d.grounding", "_d.spans")
