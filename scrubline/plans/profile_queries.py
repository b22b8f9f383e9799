"""Profiles of tables and texts: signatures, name likeness, ranks, modes, gaps in columns, surface forms, seeds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.functions.similarity import jaro_winkler
from scrubline.operators import diversity
from scrubline.plans.corpus_queries import _TOKENS, ngrams, tokens
from scrubline.plans.registry import query

HASHES, SIZE = 64, 3


def minhash(text, hashes: int = HASHES, size: int = SIZE):
    """Of each salt, the least of the first 16 hex digits of md5(salt:shingle); 2**64 in hex where a text has no words."""

    def own(words):
        shingles = F.when(F.size(words) < size, F.filter(F.array(F.array_join(words, " ")), lambda s: s != "")).otherwise(F.array_distinct(ngrams(words, size)))
        least = lambda salt: lambda s: F.substring(F.md5(F.concat(salt.cast("string"), F.lit(":"), s)), 1, 16)
        return F.transform(F.array(shingles), lambda sh: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda salt: F.coalesce(F.array_min(F.transform(sh, least(salt))), F.lit("1" + "0" * 16))))[0]

    return F.transform(F.array(tokens(text)), own)[0]


@query(f"""SELECT doc_id, array_to_string(list_transform(range({HASHES}), lambda k: coalesce(list_min(list_transform(sh, lambda s: substr(md5(k || ':' || s), 1, 16))), '1{"0" * 16}')), ',') AS signature
FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {SIZE} + 2), lambda i: array_to_string(w[i:i+{SIZE - 1}], ' '))) END AS sh
      FROM (SELECT doc_id, {_TOKENS.replace("lower(text)", "lower(coalesce(text, ''))")} AS w FROM documents))""")
def minhash_signature(t):
    signed = diversity.signatures(t("documents"), HASHES, SIZE, lambda text: tokens(F.coalesce(text, F.lit(""))))
    none = ",".join(["1" + "0" * 16] * HASHES)
    return signed.select("doc_id", F.coalesce(F.regexp_replace(F.lower(F.hex("signature")), "(.{16})(?=.)", "$1,"), F.lit(none)).alias("signature"))


_PREFIX = " + ".join(f"CASE WHEN length(a) >= {k} AND length(b) >= {k} AND a[:{k}] = b[:{k}] THEN 1 ELSE 0 END" for k in range(1, 5))


def jaro_sql(pairs: str, key: str) -> str:
    """key, a, b and j, the Jaro likeness, of a table with key, a and b: each character of a takes the first free one in reach."""
    return f"""(WITH RECURSIVE _m AS (SELECT {key}, a, b, 0 AS i, []::BIGINT[] AS ii, []::BIGINT[] AS jj, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach FROM ({pairs})
 UNION ALL SELECT {key}, a, b, i + 1, CASE WHEN j IS NULL THEN ii ELSE list_append(ii, i + 1) END, CASE WHEN j IS NULL THEN jj ELSE list_append(jj, j) END, reach
  FROM (SELECT *, list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda x: b[x] = a[i + 1] AND NOT list_contains(jj, x))[1] AS j FROM _m WHERE i < length(a))),
 _t AS (SELECT {key}, a, b, len(ii) AS m, len(list_filter(range(1, len(ii) + 1), lambda k: a[ii[k]] <> b[list_sort(jj)[k]])) AS t FROM _m WHERE i = length(a))
 SELECT {key}, a, b, CASE WHEN a = b THEN 1.0 WHEN m = 0 THEN 0.0 ELSE (m::DOUBLE / length(a) + m::DOUBLE / length(b) + (m - t::DOUBLE / 2) / m) / 3 END AS j FROM _t)"""


@query(f"SELECT p_partkey, round(j + ({_PREFIX}) * 0.1 * (1 - j), 6) AS likeness FROM {jaro_sql('SELECT p.p_partkey, lower(p.p_name) AS a, lower(q.p_name) AS b FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1', 'p_partkey')}", "jaro_winkler")
def name_likeness(t):
    p = t("part").select("p_partkey", F.lower("p_name").alias("a"))
    q = t("part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower("p_name").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(jaro_winkler(F.col("a"), F.col("b")), 6).alias("likeness"))


@query("SELECT lang, n_chars AS p95 FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL) WHERE k = round_even((n - 1) * 0.95, 0)")
def p95_rank(t):
    """Nearest rank, halves to even. Equal lengths are counted first, so the window holds distinct lengths only."""
    counts = t("documents").where("n_chars is not null").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(W.partitionBy("lang").orderBy("n_chars"))).withColumn("n", F.sum("c").over(W.partitionBy("lang")))
    at = F.bround((F.col("n") - 1) * 0.95, 0)
    return upto.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select("lang", F.col("n_chars").alias("p95"))


@query("SELECT source, lang AS mode, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def dominant_mode(t):
    counts = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "lang", "n")).alias("b")).select("source", F.col("b.lang").alias("mode"), F.col("b.n").alias("n"))


_REQUIRED = ("doc_id", "text", "lang", "source")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') AS missing FROM documents" for c in _REQUIRED))
def missing_required(t):
    one = t("documents").agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in _REQUIRED])
    return one.unpivot([], list(_REQUIRED), "field", "missing")


# Spoken forms of digits and marks.
SPOKEN = {"0": "zero", "1": "un", "2": "deux", "3": "trois", "4": "quatre", "5": "cinq", "6": "six", "7": "sept", "8": "huit", "9": "neuf"}
MARKS = {"@": " arobase ", ".": " point "}


def _spoken_sql(c: str) -> str:
    for k, v in (SPOKEN | MARKS).items():
        c = f"replace({c}, '{k}', '{v + ' ' if k in SPOKEN else v}')"
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"


def spoken(c):
    for k, v in (SPOKEN | MARKS).items():
        c = F.replace(c, F.lit(k), F.lit(v + " " if k in SPOKEN else v))
    return F.trim(F.regexp_replace(c, " +", " "))


@query(f"SELECT c_custkey, {_spoken_sql('c_name')} AS spoken FROM customer")
def obfuscate_surface(t):
    return t("customer").select("c_custkey", spoken(F.col("c_name")).alias("spoken"))


@query("SELECT doc_id, substr(sha256(doc_id::VARCHAR), 1, 12) AS seed FROM documents")
def hash_seeds(t):
    return t("documents").select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12).alias("seed"))


@query("SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean, min(length(text)) AS least, max(length(text)) AS most FROM conversations GROUP BY GROUPING SETS ((role), ())")
def lengths_by_role(t):
    n = F.length("text")
    return t("conversations").rollup("role").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean"), F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"))


@query("SELECT l_returnflag, l_linestatus, round(2 * p * r / (p + r), 4) AS f1, round(5 * p * r / (4 * p + r), 4) AS f2 FROM (SELECT l_returnflag, l_linestatus, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) / nullif(count(*) FILTER (l_quantity > 25), 0) AS p, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) / nullif(count(*) FILTER (l_discount > 0.05), 0) AS r FROM lineitem GROUP BY ALL)")
def fbeta(t):
    a, b = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    p, r = F.col("p"), F.col("r")
    rates = t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.try_divide(F.count_if(a & b), F.count_if(a)).alias("p"), F.try_divide(F.count_if(a & b), F.count_if(b)).alias("r"))
    return rates.select("l_returnflag", "l_linestatus", F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"), F.round(F.try_divide(5 * p * r, 4 * p + r), 4).alias("f2"))
