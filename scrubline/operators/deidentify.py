"""Baselines, profiles and loops of de-identification over documents that hold their spans."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.labels import lookup
from scrubline.operators import masking

# What a label is generalised to.
GENERAL = {
    "PERSON_NAME": "une collaboratrice",
    "EMAIL": "une adresse email interne",
    "PHONE": "un numero professionnel",
    "USERNAME": "un identifiant interne",
    "ACCOUNT_ID": "un compte client",
    "ROLE": "une fonction technique",
    "DEGREE": "un diplome avance",
    "AGE_RANGE": "une tranche d'age jeune",
    "TENURE": "une anciennete moyenne",
    "TEAM": "une equipe technique",
    "DEPARTMENT": "un departement interne",
    "LOCATION": "un site regional",
    "NATIONALITY": "une nationalite",
    "CERTIFICATION": "une certification cloud",
    "SKILL_RARE": "une competence rare",
    "EVENT_DATE": "un incident recent",
    "PRODUCT_CONTEXT": "un produit interne",
    "RARE_RESPONSIBILITY": "une responsabilite specialisee",
    "HEALTH": "une contrainte medicale",
    "ETHNICITY": "un contexte personnel sensible",
    "RELIGION": "une contrainte personnelle sensible",
    "DISABILITY": "un besoin d'accessibilite",
    "FAMILY_STATUS": "une contrainte familiale",
    "SEXUAL_ORIENTATION": "un element personnel sensible",
    "LEGAL": "un sujet juridique",
    "FINANCIAL": "un sujet financier",
}
PROFILES = ("pseudo", "mask", "generalize", "redact")


def baseline(text: Column, spans: Column, strategy: str) -> Column:
    """masking: <LABEL>; generalization: the general term of a label; rewrite_balanced: the same with white space collapsed."""
    general = lambda s: F.coalesce(lookup(GENERAL, s["label"]), F.concat(F.lit("information_"), F.lower(s["label"])))
    new = (lambda s: F.concat(F.lit("<"), s["label"], F.lit(">"))) if strategy == "masking" else general
    done = masking.apply_spans(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), new(s).alias("replacement"))))
    if strategy != "rewrite_balanced":
        return done
    flat = F.trim(F.replace(F.replace(F.regexp_replace(done, r"(?U)\s+", " "), F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(",")))
    return F.replace(flat, F.lit("Bonjour support_manager,"), F.lit("Bonjour,"))


def estimates(text: Column, masked: Column, spans: Column, empty: float = 0.0) -> Column:
    """struct<privacy_gain, utility_loss>: the share of spans whose value is gone (empty where there is none), and the change
    in length as a share, 1 at most."""
    gone = F.size(F.filter(spans, lambda s: ~F.contains(masked, s["value"])))
    loss = F.least(F.lit(1.0), F.abs(F.length(text) - F.length(masked)) / F.greatest(F.lit(1), F.length(text)))
    return F.struct(F.when(F.size(spans) > 0, F.round(gone / F.size(spans), 4)).otherwise(empty).alias("privacy_gain"), F.round(loss, 4).alias("utility_loss"))


def run_profile(docs: DataFrame, profile: str, policy: Mapping[str, str] | None = None, default: str = "pseudo", scope: str = "doc", fixed: str = "default", prefix: str = "batch") -> DataFrame:
    """doc_id, strategy, anonymized_text, actions_performed and both estimates. docs: doc_id, text, spans (resolved), and
    author_id for that scope. A pure profile has one action for all labels that the policy doesn't name; mixed goes by the
    policy alone. scope names what pseudonyms are the same within: doc, author or fixed."""
    if profile not in (*PROFILES, "mixed"):
        raise ValueError(f"unknown profile {profile!r}; there are {', '.join((*PROFILES, 'mixed'))}")
    action = profile if profile in PROFILES else default
    own = {k.upper(): v for k, v in (policy or {}).items()}
    of = {"doc": lambda: F.col("doc_id").cast("string"), "author": lambda: F.coalesce(F.col("author_id").cast("string"), F.col("doc_id").cast("string")), "fixed": lambda: F.lit(fixed)}[scope]()
    masked = docs.withColumn("_masked", masking.replaced(F.col("text"), F.col("spans"), own, action, scope=of))
    done = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.concat(F.lit(f"{prefix}:"), masking.policy_action(s["label"], own, action), F.lit(":"), F.upper(s["label"])))))
    return masked.select("doc_id", F.lit(f"{prefix}_{profile}").alias("strategy"), F.col("_masked").alias("anonymized_text"), done.alias("actions_performed"), estimates(F.col("text"), F.col("_masked"), F.array_distinct(F.col("spans"))).alias("e")).select("*", "e.*").drop("e")


def audited(answers: DataFrame) -> DataFrame:
    """doc_id, privacy_score, leaked and assessment of a document's audited chunks: the greatest score (0 to 100), leaks once
    for each evidence (the first chunk's), assessments joined. answers: doc_id, chunk, score, leaked
    array<struct<type, evidence>>, assessment; unanswered chunks are null throughout."""
    scores = answers.groupBy("doc_id").agg(F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.max("score"), F.lit(0)))).alias("privacy_score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("assessment") != "", F.struct("chunk", F.trim("assessment").alias("a"))))), lambda x: x["a"]), " | ").alias("assessment"))
    leaks = answers.select("doc_id", "chunk", F.posexplode("leaked").alias("place", "l")).where("l.evidence <> ''")
    first = leaks.groupBy("doc_id", "l.evidence").agg(F.min(F.struct("chunk", "place", F.col("l.type").alias("type"))).alias("f"))
    listed = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f.chunk", "f.place", "f.type", "evidence"))), lambda x: F.struct(x["type"].alias("type"), x["evidence"].alias("evidence"))).alias("leaked"))
    return scores.join(listed, "doc_id", "left").withColumn("leaked", F.coalesce("leaked", F.array().cast("array<struct<type:string,evidence:string>>")))


def again(score: Column, iteration: Column, threshold: int = 15, most: int = 3) -> Column:
    """Whether a document goes round once more."""
    return (score > threshold) & (iteration < (most or 3))


def adversarial_loop(docs: DataFrame, audit: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], threshold: int = 15, most: int = 3) -> DataFrame:
    """docs (doc_id, text) with privacy_score and iteration: audited, and rewritten while the score is above the threshold, at
    most ``most`` times. audit adds privacy_score to what it is given, rewrite gives new texts; both are given doc_id, text and
    row, a number of each row, and keep row. So null and repeated ids are rows of their own, and rows that a model leaves out
    stay as they are. Each round writes its documents to the checkpoint folder, so that models aren't asked again for the
    rounds before."""
    once = F.coalesce(again(F.col("privacy_score"), F.col("iteration"), threshold, most), F.lit(False))
    given = ["doc_id", "text", "row"]

    def judged(rows: DataFrame) -> DataFrame:
        score = audit(rows.select(*given)).select("row", "privacy_score")
        return rows.join(score, "row", "left").select(*given, "privacy_score", "iteration")

    start = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.lit(0).alias("iteration")).checkpoint()
    state = judged(start).checkpoint()
    for _ in range(most or 3):
        open_ = state.where(once)
        if open_.isEmpty():
            break
        new = rewrite(open_.select(*given)).select("row", F.col("text").alias("_new"))
        changed = open_.join(new, "row", "left").select("doc_id", F.coalesce("_new", "text").alias("text"), "row", (F.col("iteration") + 1).alias("iteration")).checkpoint()
        state = state.where(~once).unionByName(judged(changed)).checkpoint()
    return state.drop("row")


def acceptable(original: Column, rewritten: Column, least: float = 0.4) -> Column:
    """A rewritten text, or the original where the new one is missing or too short for it."""
    return F.when(F.length(F.trim(F.coalesce(rewritten, F.lit("")))) >= F.length(original) * least, rewritten).otherwise(original)
