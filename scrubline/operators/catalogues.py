"""Catalogues of what people are like: distributions as tables, draws from them, cues by attribute, people who stay apart.

A distribution is a table: attribute, given (what it depends on, null for nothing), value, weight (whole numbers). Draws are
inverse lookups of a hashed point in the running sums of weights, so rows are drawn in parallel and reruns agree."""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL = 200_000  # rows of a table that may be broadcast; larger ones are joined by a shuffle
KIND = "attribute string, given string, value string, weight bigint"


def load_catalogue(spark: SparkSession, path: str, scale: int = 1_000_000) -> DataFrame:
    """A distribution table from CSV (attribute, given, value, weight), or from JSON or YAML files of nested maps: attribute
    to value to weight, or attribute to given to value to weight; attributes that hold anything else are left out. Weights
    are multiplied by scale and rounded, as shares are fractions; weights that are nothing then, or negative, go."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path).select("attribute", "given", "value", F.col("weight").cast("double").alias("weight"))
    else:
        text = spark.read.text(path, wholetext=True).select("value")
        rows = text.mapInPandas(lambda batches: _flattened(batches, yaml_=path.endswith((".yaml", ".yml"))), KIND.replace("bigint", "double"))
    return rows.withColumn("weight", F.round(F.col("weight") * scale).cast("bigint")).where("weight > 0")


def _flattened(batches, yaml_: bool):
    import pandas as pd

    for batch in batches:
        out = []
        for raw in batch["value"]:
            if yaml_:
                import yaml

                whole = yaml.safe_load(raw)
            else:
                whole = json.loads(raw)
            for attribute, values in whole.items() if isinstance(whole, dict) else ():
                flat = isinstance(values, dict) and all(isinstance(w, (int, float)) for w in values.values())
                for given, own in [(None, values)] if flat else values.items() if isinstance(values, dict) else ():
                    if isinstance(own, dict):
                        out += [(attribute, given, str(v), float(w)) for v, w in own.items() if isinstance(w, (int, float))]
        yield pd.DataFrame(out, columns=["attribute", "given", "value", "weight"])


def measured(rows: DataFrame, attribute: str, value: Column, given: Column | None = None) -> DataFrame:
    """The distribution of a value in a table, by what it depends on."""
    own = rows.select((F.lit(None) if given is None else given).cast("string").alias("given"), value.cast("string").alias("value"))
    return own.where("value is not null").groupBy("given", "value").agg(F.count("*").alias("weight")).select(F.lit(attribute).alias("attribute"), "given", "value", "weight")


def point(seed: int, purpose: str, *index: Column) -> Column:
    """A whole number below 2**32: part of a digest of seed, purpose and index."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[i.cast("string") for i in index])), 1, 8), 16, 10).cast("bigint")


def _place(at: Column, total: Column) -> Column:
    """point * total // 2**32 without products beyond 64 bits, for totals below 2**47."""
    high, low = F.shiftright(at, 16), at.bitwiseAND(65535)
    return F.shiftright(high * total + F.shiftright(low * total, 16), 16)


def _found(upto: Column, at: Column) -> Column:
    """The first index (from 0) whose running sum is above at, by bisection: some forty steps serve any array."""
    half = lambda s: F.shiftright(s["low"] + s["high"], 1)
    step = lambda s, _: F.when(s["low"] >= s["high"], s).when(F.get(upto, half(s)) > at, F.struct(s["low"].alias("low"), half(s).alias("high"))).otherwise(F.struct((half(s) + 1).alias("low"), s["high"].alias("high")))
    start = F.struct(F.lit(0).alias("low"), (F.size(upto) - 1).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(upto) + 1)).cast("int")), start, step)["low"]


class Prepared(NamedTuple):
    """One attribute's distribution as draws need it: its rows by _given, and these as arrays of running sums if they are few."""

    rows: DataFrame
    arrays: DataFrame | None


def prepared(table: DataFrame, attribute: str, given: bool, small: int = SMALL) -> Prepared:
    # Values go by two digits of a digest, then by themselves: so their running sums never need one task for them all.
    part = F.substring(F.md5("value"), 1, 2).alias("_part")
    own = table.where(F.col("attribute") == attribute).select(F.col("given").alias("_given") if given else F.coalesce("given", F.lit("")).alias("_given"), "value", part, "weight").groupBy("_given", "_part", "value").agg(F.sum("weight").alias("weight"))
    if own.count() > small:
        return Prepared(own, None)
    sorted_ = F.array_sort(F.collect_list(F.struct("_part", "value", "weight")))
    sums = F.aggregate("_v", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x["weight"])))
    return Prepared(own, own.groupBy("_given").agg(sorted_.alias("_v")).select("_given", F.transform("_v", lambda x: x["value"]).alias("_values"), sums.alias("_upto")))


def draw_from(rows: DataFrame, table: DataFrame | Prepared, attribute: str, at: Column, given: Column | None = None, name: str | None = None, small: int = SMALL) -> DataFrame:
    """rows with a column (named as the attribute, or name) drawn from the table's distribution for what it is given; null
    where the table has none. at: a point below 2**32.

    A distribution of small rows or fewer is sent along as arrays that are bisected. A larger one is dealt over as many equal
    buckets of its sum as it has values, each value to the buckets it touches, and met by given and bucket."""
    name = name or attribute
    keyed = rows.withColumns({"_at": at, "_given": F.lit("") if given is None else given.cast("string")})
    own, arrays = table if isinstance(table, Prepared) else prepared(table, attribute, given is not None, small)
    if arrays is not None:
        place = _place(F.col("_at"), F.element_at("_upto", -1))
        return keyed.join(F.broadcast(arrays), "_given", "left").withColumn(name, F.get("_values", _found(F.col("_upto"), place))).drop("_at", "_given", "_values", "_upto")
    parts = own.groupBy("_given", "_part").agg(F.sum("weight").alias("_in"))
    before = parts.select("_given", "_part", (F.sum("_in").over(Window.partitionBy("_given").orderBy("_part")) - F.col("_in")).alias("_before"))
    upto = F.col("_before") + F.sum("weight").over(Window.partitionBy("_given", "_part").orderBy("value"))
    sums = own.join(before, ["_given", "_part"]).withColumn("_upto", upto)
    totals = own.groupBy("_given").agg(F.sum("weight").alias("_total"), F.count("*").alias("_many"))
    bucket = lambda place: F.floor(place * F.col("_many") / F.col("_total"))
    met = sums.join(totals, "_given").select("_given", "value", (F.col("_upto") - F.col("weight")).alias("_low"), "_upto", F.explode(F.sequence(bucket(F.col("_upto") - F.col("weight")), bucket(F.col("_upto") - 1))).alias("_bucket"))
    placed = keyed.join(totals, "_given", "left").withColumn("_place", _place(F.col("_at"), F.col("_total"))).withColumn("_bucket", bucket(F.col("_place"))).alias("a")
    on = (F.col("a._given") == F.col("b._given")) & (F.col("a._bucket") == F.col("b._bucket")) & (F.col("a._place") >= F.col("b._low")) & (F.col("a._place") < F.col("b._upto"))
    return placed.join(met.alias("b"), on, "left").select("a.*", F.col("b.value").alias(name)).drop("_at", "_given", "_total", "_many", "_place", "_bucket")


def keys(fields: list[str], group: str) -> Column:
    """What two people may not share: the group with the values of any two fields, as arrays of digests."""
    return F.array(*[F.unhex(F.md5(F.to_json(F.array(F.lit(f"{x},{y}"), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (group, x, y)])))) for x, y in combinations(fields, 2)])


def people(worlds: DataFrame, per_world: int, table: DataFrame, fields: dict[str, str | None], apart: list[str], seed: int = 27, most: int = 60, fixed: tuple[str, ...] = (), small: int = SMALL) -> DataFrame:
    """person_id, world_id, k, attempt and the fields of per_world people for each world, of whom no two of a world agree in
    more than one of the fields in apart.

    worlds: world_id. fields: what each is drawn from in the table and given which other field, in order. Round by round, of
    people who agree in two fields all but the first (by k) are drawn anew with the next derived seed, but for the fields in
    fixed; whoever is settled stays so. A round looks only at those drawn anew and at the settled people of their worlds; it
    ends when none is left, or with an error after most rounds, where a world has no room for its people. Distributions are
    prepared once, and fields that neither are in apart nor lead to one that is are drawn at the end. Worlds are dealt to as many
    tasks as there are shuffle partitions, or cores if these are more: a few ids become all the people."""
    spark = worlds.sparkSession
    table = table.where(F.col("attribute").isin(*fields)).groupBy("attribute", "given", "value").agg(F.sum("weight").alias("weight")).checkpoint()
    known = {}
    for name, given in fields.items():
        own = prepared(table, name, given is not None, small)
        known[name] = Prepared(own.rows.checkpoint(), None) if own.arrays is None else Prepared(own.rows, own.arrays.checkpoint())

    def drawn(todo: DataFrame, names: list[str]) -> DataFrame:
        for name in names:
            index = [F.col("world_id"), F.col("k"), *([] if name in fixed else [F.col("attempt")])]
            todo = draw_from(todo, known[name], name, point(seed, name, *index), None if fields[name] is None else F.col(fields[name]))
        return todo

    def finished(rows: DataFrame) -> DataFrame:
        rows = drawn(rows, [f for f in fields if f not in compared])
        return rows.select(F.concat_ws("_", F.col("world_id").cast("string"), F.format_string("p%03d", F.col("k") + 1)).alias("person_id"), "world_id", "k", "attempt", *fields)

    compared: list[str] = []  # fields in apart and what they are drawn by
    for name in reversed(fields):
        if name in apart or any(fields[f] == name for f in compared):
            compared.insert(0, name)
    kept: list[str] = []  # of these, what another attempt doesn't change
    for name in compared:
        if name in fixed and (fields[name] is None or fields[name] in kept):
            kept.append(name)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = worlds.where("world_id is not null").select("world_id").repartition(parts, "world_id").distinct()
    open_ = drawn(rows.select("world_id", F.explode(F.sequence(F.lit(0), F.lit(per_world - 1))).alias("k"), F.lit(0).alias("attempt")), kept)
    if len(apart) < 2:
        return finished(drawn(open_, [f for f in compared if f not in kept]))
    settled, many = None, None
    for _ in range(most):
        new = drawn(open_, [f for f in compared if f not in kept])
        each = new.select("world_id", "k", "attempt", *compared, F.explode(keys(apart, "world_id")).alias("_key"))
        if settled is not None:
            again = open_.select("world_id").distinct()
            again = F.broadcast(again) if many <= small else again
            old = settled.join(again, "world_id", "left_semi").select("world_id", F.lit(-1).alias("k"), F.explode(keys(apart, "world_id")).alias("_key"))
            each = each.unionByName(old, allowMissingColumns=True)
        met = each.withColumn("_lost", F.min("k").over(Window.partitionBy("_key")) < F.col("k")).where("k >= 0")
        judged = met.groupBy("world_id", "k").agg(F.max("_lost").alias("_lost"), *[F.first(c).alias(c) for c in ("attempt", *compared)]).checkpoint()
        good = judged.where("not _lost").drop("_lost")
        settled = good if settled is None else settled.unionByName(good)
        open_ = judged.where("_lost").select("world_id", "k", (F.col("attempt") + 1).alias("attempt"), *kept)
        many = open_.count()
        if not many:
            return finished(settled)
    raise ValueError(f"after {most} rounds {many} people still agree with others of their worlds in more than one of {apart}; the first of them: {open_.first()}")


def marginals(rows: DataFrame, names: list[str]) -> DataFrame:
    """attribute, value and share of each value in a table: what draws are held against."""
    long = reduce(DataFrame.unionByName, [rows.select(F.lit(n).alias("attribute"), F.col(n).cast("string").alias("value")) for n in names])
    counts = long.groupBy("attribute", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("attribute"))).drop("n")
