"""Values, dates, numbers and names found in texts, repaired offsets, leaks of profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline.functions.dates import birth_date
from scrubline.operators import matching
from scrubline.plans.registry import query, spread

_DAY, _MONTH_DAY, _FIGURES = "strftime(o_orderdate, '%-d %B %Y')", "strftime(o_orderdate, '%B %-d, %Y')", "strftime(o_orderdate, '%m/%d/%Y')"
_FORM = f"CASE o_orderkey % 4 WHEN 0 THEN {_MONTH_DAY} WHEN 1 THEN {_DAY} WHEN 2 THEN {_FIGURES} ELSE 'never' END"


def dated(t):
    """Orders with the date as a value and one of its forms in a text."""
    form = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, form("MMMM d, yyyy")).when(k == 1, form("d MMMM yyyy")).when(k == 2, form("MM/dd/yyyy")).otherwise("never")
    return spread(t("orders")).select("o_orderkey", F.concat(F.lit("Paid on "), written, F.lit(" twice")).alias("text"), form("d MMMM yyyy").alias("value"), written.alias("written"))


def _values(*pairs):
    return F.array(*[F.struct(F.lit(label).alias("label"), value.alias("value")) for label, value in pairs])


def _rows(d, key):
    # An inner explode would first ask for spans that aren't empty, and so find them all once more before rows are dealt.
    return d.select(key, F.explode_outer("spans").alias("s")).where("s is not null").select(key, "s.*")


@query(f"SELECT o_orderkey, 8::INT AS start, (8 + length({_FORM}))::INT AS \"end\", 'DATE' AS label FROM orders WHERE o_orderkey % 4 <> 3")
def date_matches(t):
    return _rows(dated(t).withColumn("spans", matching.date_spans(F.col("text"), _values(("DATE", F.col("value"))))), "o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%-d') END AS day, CASE WHEN o_orderkey % 4 < 2 THEN lower(strftime(o_orderdate, '%B')) END AS month, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y') END AS year, strftime(o_orderdate, '%-d') AS iso_day, lower(strftime(o_orderdate, '%B')) AS iso_month FROM orders")
def birth_date_parts(t):
    d = dated(t).join(t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso")), "o_orderkey")
    return d.select("o_orderkey", birth_date(F.col("written")).alias("b"), birth_date(F.col("iso")).alias("c")).select("o_orderkey", "b.*", F.col("c.day").alias("iso_day"), F.col("c.month").alias("iso_month"))


@query("SELECT o_orderkey, 5::INT AS start, (5 + length(lpad(o_orderkey::VARCHAR, 8, '0')) + 2)::INT AS \"end\", 'SSN' AS label FROM orders WHERE o_orderkey % 2 = 0")
def number_matches(t):
    digits = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    spaced = F.concat(F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 2), F.lit("-"), F.substring(digits, 7, 2))
    text = F.concat(F.lit("code "), F.when(F.col("o_orderkey") % 2 == 0, spaced).otherwise(F.concat_ws("  ", F.split(digits, ""))), F.lit(" end"))
    return _rows(spread(t("orders")).select("o_orderkey", matching.number_spans(text, _values(("SSN", digits))).alias("spans")), "o_orderkey")


@query("SELECT c_custkey, 5::INT AS start, (5 + 11 + length(c_name))::INT AS \"end\", 'PERSON' AS label FROM customer WHERE c_custkey % 2 = 1")
def name_matches(t):
    text = F.concat(F.lit("then ANNA "), F.when(F.col("c_custkey") % 2 == 1, "maria").otherwise(F.repeat(F.lit("x"), F.lit(90))), F.lit(" "), F.col("c_name"), F.lit(" left"))
    return _rows(spread(t("customer")).select("c_custkey", matching.name_spans(text, _values(("PERSON", F.concat(F.lit("Anna "), F.col("c_name"))))).alias("spans")), "c_custkey")


@query("SELECT p_partkey, 4::INT AS start, (4 + length(p_type))::INT AS \"end\", 'OCCUPATION' AS label FROM part WHERE length(p_type) >= 3 UNION ALL SELECT p_partkey, 4::INT, (4 + length(p_type) + 1)::INT, 'OCCUPATION' FROM part WHERE p_partkey % 2 = 0 AND length(p_type) >= 3 UNION ALL SELECT p_partkey, 4::INT, (4 + length(p_type) - 1)::INT, 'OCCUPATION' FROM part WHERE p_type ILIKE '%e' AND length(p_type) >= 3")
def plural_matches(t):
    text = F.concat(F.lit("two "), F.lower("p_type"), F.when(F.col("p_partkey") % 2 == 0, "s").otherwise(""), F.lit(" only"))
    return _rows(t("part").select("p_partkey", matching.plural_spans(text, _values(("OCCUPATION", F.concat("p_type", F.lit("S"))))).alias("spans")), "p_partkey")


@query(f"""SELECT o_orderkey, start::INT AS start, "end"::INT AS "end", label FROM (
 SELECT o_orderkey, 8 AS start, 8 + length({_FORM}) AS "end", 'DATE' AS label FROM orders WHERE o_orderkey % 4 <> 3
 UNION ALL SELECT o_orderkey, 8 + length({_FORM}) + 1, 8 + length({_FORM}) + 6, 'MISC' FROM orders)""")
def value_cascade(t):
    """A date by its own rule, a word that is there in any case, one that isn't, one that isn't stated."""
    values = _values(("DATE", F.col("value")), ("MISC", F.lit("TWICE")), ("PHONE", F.lit("123456")), ("PERSON", F.lit("n/a")))
    return _rows(dated(t).withColumn("spans", matching.value_spans(F.col("text"), values)), "o_orderkey")


@query("""SELECT c_custkey, start::INT AS start, "end"::INT AS "end", label FROM (
 SELECT c_custkey, 8 + length(c_name) AS start, 8 + 2 * length(c_name) AS "end", 'PER' AS label FROM customer
 UNION ALL SELECT c_custkey, 3, 3 + length(c_name), 'SENSITIVE' FROM customer UNION ALL SELECT c_custkey, 0, 2, 'X' FROM customer)""")
def offset_repair(t):
    note = "struct<start:int,end:int,type:string,text:string>"
    of = lambda s, e, k, v: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(k).alias("type"), v.alias("text")).cast(note)
    notes = F.array(of(20, 25, "PER", F.col("c_name")), of(None, None, None, F.upper("c_name")), of(0, 2, "X", F.lit(None)), of(5, 3, "Y", F.lit(None)), of(0, 4, "Z", F.lit("id C")), of(1, 99999, "W", F.lit(None)))
    text = F.concat(F.lit("id "), F.col("c_name"), F.lit(" and "), F.col("c_name"))
    fixed = F.filter(matching.repaired(text, notes), lambda s: s["label"] != "Z")
    return _rows(spread(t("customer")).select("c_custkey", fixed.alias("spans")), "c_custkey")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 ELSE 0.25 END AS leak_rate, CASE c_custkey % 3 WHEN 2 THEN 0.0 ELSE 0.5 END AS direct_leak_rate,
 CASE c_custkey % 3 WHEN 1 THEN 1.0 ELSE 0.5 END AS indirect_leak_rate, 4 AS n_attributes, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS n_leaked FROM customer""")
def profile_leaks(t):
    k = F.col("c_custkey") % 3
    direct = F.create_map(F.lit("name"), F.concat(F.lit("Bo "), F.col("c_name")), F.lit("email"), F.lit("a@b.c"), F.lit("SSN"), F.lit("none"))
    indirect = F.create_map(F.lit("occupation"), F.lit("TYPE: X DESCRIPTION: nurse)"), F.lit("race"), F.lit("Elf"), F.lit("sex"), F.lit("M"))
    masked = F.concat(F.lit("the NURSE "), F.when(k == 0, F.lower("c_name")).when(k == 1, F.concat(F.upper("c_name"), F.lit(" of elfs"))).otherwise(""))
    found = matching.leaks(masked, direct, indirect)
    return spread(t("customer")).select("c_custkey", matching.leak_rates(found).alias("r")).select("c_custkey", "r.*")


_OPENINGS = r"regexp_extract(text, '^[A-Za-zÀ-ÿ]+ [a-zß-ÿ]+ [a-zß-ÿ]+')"


@query(f"""WITH lexicon AS (SELECT DISTINCT {_OPENINGS} AS value FROM documents WHERE {_OPENINGS} <> ''),
places AS (SELECT doc_id, value, unnest(list_filter(range(0, length(text) - length(value) + 1), lambda i: text[i + 1:i + length(value)] = value)) AS start FROM documents JOIN lexicon ON contains(text, value))
SELECT doc_id, start::INT AS start, (start + length(value))::INT AS "end", value FROM places""")
def gazetteer_places(t):
    """All places of all openings of documents, three words each, in all documents."""
    from scrubline.operators import gazetteer

    opening = F.regexp_extract("text", "^[A-Za-zÀ-ÿ]+ [a-zß-ÿ]+ [a-zß-ÿ]+", 0)
    return gazetteer.find(t("documents"), t("documents").select(opening.alias("value")))


# Needles that can't overlap themselves: both ways give the same places, which are summed up from the pieces between them.
_SUM = "list_sum(list_transform(range(1, len({p})), lambda j: length({p}[j]) * (len({p}) - j))) + length(n) * (len({p}) - 1) * (len({p}) - 2) // 2"


@query(f"""SELECT doc_id, n AS needle, (len(p) - 1)::BIGINT AS places, coalesce({_SUM.format(p='p')}, 0)::BIGINT AS sum_of_starts, (len(p) - 1)::BIGINT AS apart, coalesce({_SUM.format(p='q')}, 0)::BIGINT AS any_case
 FROM (SELECT doc_id, n, string_split(text, n) AS p, string_split(lower(text), n) AS q FROM documents, (VALUES ('tion'), ('en'), ('.'), ('é')) v(n))""")
def needle_places(t):
    """Overlapping and other places of short needles in all texts."""
    from scrubline.operators.spans import occurrences

    n, text = F.col("needle"), F.col("text")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    d = t("documents").select("doc_id", "text", F.explode(F.array(*[F.lit(x) for x in ("tion", "en", ".", "é")])).alias("needle")).withColumn("a", occurrences(text, n))
    return d.select("doc_id", "needle", F.size("a").cast("bigint").alias("places"), total(F.col("a")).alias("sum_of_starts"), F.size(occurrences(text, n, overlapping=False)).cast("bigint").alias("apart"), total(occurrences(text, n, fold=True)).alias("any_case"))
