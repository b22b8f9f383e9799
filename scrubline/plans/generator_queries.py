"""Seeded generators: worlds, people, schedules, candidate pools. Every draw is a hash of seed, purpose and index, so rows
are made in parallel, in any order, and come out the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.functions.draws import choose, draw
from scrubline.plans.registry import query

# Shares of difficulties, sizes of candidate pools, levels of what an attacker knows.
DIFFICULTY = {"easy": 0.40, "medium": 0.35, "hard": 0.25}
POOLS = {"easy": 30, "medium": 15, "hard": 8}
LEVELS = ("low", "medium", "high")


def draw_sql(seed: int, purpose: str, *index: str) -> str:
    name = " || ':' || ".join([f"'{seed}:{purpose}'", *index])
    return f"(('0x' || substr(md5({name}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def choose_sql(at: str, shares: dict[str, float]) -> str:
    total, upto, out = sum(shares.values()), 0.0, ""
    for value, share in list(shares.items())[:-1]:
        upto += share
        out += f" WHEN {at} < {upto / total!r}::DOUBLE THEN '{value}'"
    return f"CASE{out} ELSE '{list(shares)[-1]}' END"


def worlds(spark: SparkSession, count: int, kinds: tuple[str, ...], seed: int = 13) -> DataFrame:
    """world_id, kind and size of so many worlds."""
    at = F.col("id")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.floor(draw(seed, "kind", at) * len(kinds)) + 1).cast("int"))
    return spark.range(count).select(F.format_string("world_%03d", at + 1).alias("world_id"), kind.alias("kind"), (F.floor(draw(seed, "size", at) * 900) + 100).cast("bigint").alias("size"))


def people(worlds: DataFrame, per_world: int, marginals: dict[str, dict[str, float]], seed: int = 27) -> DataFrame:
    """person_id, world_id and one column for each marginal; so many people for each world."""
    rows = worlds.select("world_id", F.explode(F.sequence(F.lit(0), F.lit(per_world - 1))).alias("k"))
    own = {name: choose(draw(seed, name, F.col("world_id"), F.col("k")), shares) for name, shares in marginals.items()}
    return rows.select(F.concat_ws("_", "world_id", F.format_string("p%03d", F.col("k") + 1)).alias("person_id"), "world_id", *[c.alias(n) for n, c in own.items()])


def neighbours(people: DataFrame, group: str, seed: int, most: int, in_arc: int = 100_000, kept: tuple[str, ...] = ()) -> DataFrame:
    """person_id with the people before and following it on its group's ring, most at each side. kept: more columns of people;
    then those before and following are structs of person_id and them.

    A ring is cut into arcs of in_arc people or so, each with copies of those next to it, so that no task orders a whole
    group. Points are hashes: an arc with fewer than most people is out of the question while in_arc is many times most."""
    counts = people.groupBy(group).agg(F.count("*").alias("_n"))
    ring = people.select("person_id", group, *kept).withColumn("point", draw(seed, "ring", F.col("person_id"))).alias("a").join(counts.alias("b"), F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}")))
    arcs = F.greatest(F.floor(F.col("_n") / in_arc), F.lit(1))
    own = W.partitionBy("g", "_arc")
    ring = ring.select("person_id", *kept, F.col(f"a.{group}").alias("g"), "point", arcs.alias("_arcs"), F.floor(F.col("point") * arcs).alias("_arc"))
    ring = ring.select("*", F.row_number().over(own.orderBy("point", "person_id")).alias("_r"), F.count("*").over(own).alias("_in"))
    copies = F.array_compact(F.array(F.col("_arc"), F.when((F.col("_r") <= most) & (F.col("_arc") > 0), F.col("_arc") - 1), F.when((F.col("_r") > F.col("_in") - most) & (F.col("_arc") < F.col("_arcs") - 1), F.col("_arc") + 1)))
    w = W.partitionBy("g", "_to").orderBy("point", "person_id")
    one = F.when(F.col("person_id").isNotNull(), F.struct("person_id", *kept)) if kept else F.col("person_id")
    after, before = F.collect_list(one).over(w.rowsBetween(1, most)), F.collect_list(one).over(w.rowsBetween(-most, -1))
    return ring.withColumn("_to", F.explode(copies)).select("person_id", *kept, "_arc", "_to", after.alias("following"), before.alias("before")).where("_arc = _to").drop("_arc", "_to")


def pool_size(difficulty: Column, limits: dict[str, int] = POOLS) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), difficulty), F.lit(limits["medium"]))


def pools(targets: DataFrame, people: DataFrame, group: str, seed: int = 53, limits: dict[str, int] = POOLS, in_arc: int = 100_000) -> DataFrame:
    """candidate pools: pair_id, target, place (0: the target) and candidate.

    A target's pool is drawn from the people of its own group in the order of a hash ring: those that follow the target's
    point on the ring. So a pool needs the pool's size of people, never all pairs of a group. targets: doc_id, person_id,
    difficulty."""
    after = neighbours(people, group, seed, max(limits.values()) - 1, in_arc)
    size, levels = pool_size(F.col("difficulty"), limits), F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level")
    # A target becomes up to 90 rows: targets are dealt to a fixed number of tasks, which adaptive execution leaves as they are.
    known = targets.join(after, "person_id").repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = known.select("doc_id", "person_id", "difficulty", size.alias("size"), "following", "before", levels)
    # At the ring's end a pool goes on with those just before the target.
    others = F.array_distinct(F.concat("following", F.reverse("before")))
    chosen = F.concat(F.array("person_id"), F.slice(others, 1, F.col("size") - 1))
    return every.select(F.concat_ws("_", F.col("doc_id").cast("string"), "level").alias("pair_id"), F.col("person_id").alias("target"), F.posexplode(chosen).alias("place", "candidate"))


def split_of_group(people: DataFrame, group: str, in_range: int = 1 << 20) -> DataFrame:
    """person_id and split: of each group the first 60 % by person_id train, up to 80 % dev, the rest test.

    People are counted within ranges of their (integer) ids and the counts of a group's ranges added up, so that no task
    orders a whole group."""
    rows = people.select("person_id", group, F.floor(F.col("person_id") / in_range).alias("_range"))
    counts = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    w = W.partitionBy(group)
    before = counts.select(group, "_range", (F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    own = F.row_number().over(W.partitionBy(group, "_range").orderBy("person_id"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (group, "_range")]
    placed = rows.withColumn("_own", own).alias("a").join(before.alias("b"), same).withColumn("_r", F.col("_before") + F.col("_own"))
    return placed.select("person_id", F.when(F.col("_r") <= F.floor(F.col("_all") * 0.6), "train").when(F.col("_r") <= F.floor(F.col("_all") * 0.8), "dev").otherwise("test").alias("split"))


KINDS = ("office", "clinic", "school")
_KIND = f"list_element(['{KINDS[0]}', '{KINDS[1]}', '{KINDS[2]}'], (floor({draw_sql(13, 'kind', 'id')} * 3) + 1)::INT)"


@query(f"SELECT format('world_{{:03d}}', id + 1) AS world_id, {_KIND} AS kind, (floor({draw_sql(13, 'size', 'id')} * 900) + 100)::BIGINT AS size FROM range(100) t(id)")
def generate_worlds(t):
    return worlds(t("region").sparkSession, 100, KINDS)


MARGINALS = {"sex": {"f": 0.52, "m": 0.48}, "age": {"18-29": 0.2, "30-49": 0.35, "50-69": 0.3, "70+": 0.15}}


@query("SELECT format('world_{:03d}_p{:03d}', w + 1, k + 1) AS person_id, format('world_{:03d}', w + 1) AS world_id, " + ", ".join(f"""{choose_sql(draw_sql(27, n, "format('world_{:03d}', w + 1)", 'k'), m)} AS {n}""" for n, m in MARGINALS.items()) + " FROM range(100) a(w), range(50) b(k)")
def generate_people(t):
    return people(worlds(t("region").sparkSession, 100, KINDS), 50, MARGINALS)


@query(f"SELECT doc_id, {choose_sql(draw_sql(41, 'difficulty', 'doc_id'), DIFFICULTY)} AS difficulty FROM documents")
def difficulty_schedule(t):
    return t("documents").select("doc_id", choose(draw(41, "difficulty", F.col("doc_id")), DIFFICULTY).alias("difficulty"))


@query("SELECT person_id, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'dev' ELSE 'test' END AS split FROM (SELECT c_custkey AS person_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)")
def author_split_by_group(t):
    return split_of_group(t("customer").select(F.col("c_custkey").alias("person_id"), "c_nationkey"), "c_nationkey")


_POINT = draw_sql(53, "ring", "c_custkey")
_RING = f"""SELECT c_custkey, list(c_custkey) OVER (w ROWS BETWEEN 1 FOLLOWING AND 29 FOLLOWING) AS f, list(c_custkey) OVER (w ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING) AS b FROM (SELECT c_custkey, c_nationkey, {_POINT} AS point FROM customer) WINDOW w AS (PARTITION BY c_nationkey ORDER BY point, c_custkey)"""


@query(f"""SELECT pair_id, target, (place - 1)::INT AS place, c[place] AS candidate FROM (
  SELECT o_orderkey || '_' || level AS pair_id, o_custkey AS target, list_concat([o_custkey], list_concat(coalesce(f, []), list_reverse(coalesce(b, [])))[1:CASE o_orderstatus WHEN 'O' THEN 29 WHEN 'F' THEN 14 ELSE 7 END]) AS c
  FROM orders JOIN ({_RING}) ON o_custkey = c_custkey, (VALUES ('low'), ('medium'), ('high')) l(level)), UNNEST(range(1, len(c) + 1)) u(place)""")
def attack_pairs(t):
    people_ = t("customer").select(F.col("c_custkey").alias("person_id"), "c_nationkey")
    return pools(attack_targets(t), people_, "c_nationkey")


def attack_targets(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("person_id"), F.when(F.col("o_orderstatus") == "O", "easy").when(F.col("o_orderstatus") == "F", "medium").otherwise("hard").alias("difficulty"))


@query("SELECT doc_id, sha256('detect' || chr(10) || 'm' || chr(10) || 'v1' || chr(10) || '0.100' || chr(10) || coalesce(text, '')) AS cache_key FROM documents")
def response_keys(t):
    from scrubline.operators.incremental import response_key

    return t("documents").select("doc_id", response_key(F.lit("detect"), F.lit("m"), F.lit("v1"), F.lit(0.1), F.coalesce("text", F.lit(""))).alias("cache_key"))


@query("""SELECT axis, value, count(*) AS documents, round(avg(n_chars), 6) AS n_chars FROM (SELECT n_chars, unnest([{'axis': 'all', 'value': NULL}, {'axis': 'lang', 'value': lang}, {'axis': 'source', 'value': source}], recursive := true) FROM documents) GROUP BY ALL""")
def run_summary(t):
    from scrubline.sources.runs import summarise

    return summarise(t("documents").withColumn("error", F.lit(None).cast("string")), ["lang", "source"], ["n_chars"]).drop("errors")
