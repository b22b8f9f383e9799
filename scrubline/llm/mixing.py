"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's weight is 1, 2 or 3 in the order of sources by code point, null last. Weights share the words of all sources;
no target is above ``most`` times its source, and what is cut off is shared again by weight (water filling). A document
is to be taken target / source_size times: the whole part for certain, the fraction as a probability.

Fractions are rounded by a reduction tree. In a group of some ``group`` documents of one source, pairs exchange mass
(probability times size) at random, one or the other way with the odds that keep every expectation, until one of the two
is 0 or 1; the other goes on to the next document. Large documents come first, so that the small ones settle them. Each group leaves one undecided document at most, and these form the
groups of the next level. The mass of a source is kept but for the rounding of its last document, so what is taken comes
within one document of the target. Groups come from hashes of the rows, so reruns agree, no group is larger for a larger
source, and only a few hundred rows meet in one place.

Null texts have size 0; an empty table has no rows. Texts of any length count whole, by their words alone. Rows alike in id, source and
size are ordered by a hash of the whole row, repeated ones are numbered, and each is drawn for itself. Other columns aren't
read but for that hash, whatever their names. The table of sources, one small row each, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import keep

WORD = r"[^\x20\x09-\x0D]+"
ITEM = "struct<least:bigint,h:bigint,doc_id:bigint,tie:bigint,dup:int,size:bigint,p:double>"  # least: the size negated, for the order
SNAP = 1e-9


def targets(sizes: DataFrame, most: float = 3.0, weights: int = 3) -> DataFrame:
    """source, source_size and target. sizes: source, source_size - one row for each source."""
    ranked = sizes.withColumn("_w", (1 + (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % weights).cast("double"))
    ranked = ranked.withColumn("_cap", F.lit(most) * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - (F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_cap"))) / (F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)))
    ranked = ranked.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(W.partitionBy())["level"]
    return ranked.select("source", "source_size", F.least("_cap", F.coalesce(first, F.lit(0.0)) * F.col("_w")).alias("target"))


def _uniform(*columns: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def _fold(items: Column, seed: int) -> Column:
    """struct(done: items with p 0 or 1, rest: the undecided one or null)."""
    none = F.lit(None).cast(ITEM)
    moved = lambda x, p: F.struct(x["least"].alias("least"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["tie"].alias("tie"), x["dup"].alias("dup"), x["size"].alias("size"), F.when(p < SNAP, 0.0).when(p > 1 - SNAP, 1.0).otherwise(p).alias("p")).cast(ITEM)

    def pair(state: Column, x: Column) -> Column:
        a = state["rest"]
        up = F.least(a["size"] * (1 - a["p"]), x["size"] * x["p"])  # mass that a can take from x
        down = F.least(a["size"] * a["p"], x["size"] * (1 - x["p"]))
        gain = F.when(_uniform(a["h"], x["h"], F.lit(seed)) * (up + down) < down, up).otherwise(-down)
        return F.struct(moved(a, a["p"] + gain / a["size"]).alias("a"), moved(x, x["p"] - gain / x["size"]).alias("x"))

    def settle(done: Column, both: Column) -> Column:
        a_done, x_done = both["a"]["p"].isin(0.0, 1.0), both["x"]["p"].isin(0.0, 1.0)
        return F.struct(
            F.concat(done, F.when(a_done & x_done, F.array(both["a"], both["x"])).when(a_done, F.array(both["a"])).otherwise(F.array(both["x"]))).alias("done"),
            F.when(a_done & x_done, none).when(a_done, both["x"]).otherwise(both["a"]).alias("rest"),
        )

    def step(state: Column, x: Column) -> Column:
        # One evaluation of the pair serves all its uses: it is the element of a one-element array.
        met = F.transform(F.array(pair(state, x)), lambda both: settle(state["done"], both))[0]
        return F.when(state["rest"].isNull(), F.struct(state["done"].alias("done"), x.alias("rest"))).otherwise(met)

    return F.aggregate(F.array_sort(items), F.struct(F.array().cast(f"array<{ITEM}>").alias("done"), none.alias("rest")), step)


def numbered(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, source, size, tie (a hash of the whole row) and dup (a number among rows alike in all of these); with whole
    also the row itself, as a struct. The same for every plan: rows alike in all of these differ in nothing."""
    plain = [docs[f"`{f.name}`"] if f.dataType.typeName() not in ("map", "variant") else docs[f"`{f.name}`"].cast("string") for f in docs.schema]
    size = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    own = [docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), F.xxhash64(*plain).alias("tie")]
    rows = docs.select(*own, *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if whole else []))
    return rows.withColumn("dup", F.row_number().over(W.partitionBy("doc_id", "source", "size", "tie").orderBy(F.lit(0))))


def mix(docs: DataFrame, most: float = 3.0, weights: int = 3, group: int = 256, seed: int = 17) -> DataFrame:
    """doc_id, source, tie and dup (as numbered gives them), size, source_size, target, copies and taken of every row."""
    rows = keep(numbered(docs, False))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    per = keep(per.join(targets(per.select("source", "source_size"), most, weights).withColumnRenamed("source", "_s").drop("source_size"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("_base", F.floor(share + SNAP)).withColumn("_p", F.greatest(F.lit(0.0), share - F.col("_base"))).withColumn("_p", F.when(F.col("_p") < SNAP, 0.0).otherwise(F.col("_p")))
    rows = rows.join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "source", "size", "tie", "dup", F.lit(seed)))
    head = ["source", "source_size", "target", "_base"]
    sure = rows.where((F.col("size") == 0) | (F.col("_p") == 0)).select(*head, "doc_id", "tie", "dup", "size", F.lit(0.0).alias("p"))
    item = F.struct((-F.col("size")).alias("least"), "h", "doc_id", "tie", "dup", "size", F.col("_p").alias("p")).cast(ITEM).alias("item")
    open_ = rows.where((F.col("size") > 0) & (F.col("_p") > 0)).withColumn("bucket", F.floor(_uniform(F.col("h"), F.lit(1)) * F.ceil(F.col("_n") / group))).select(*head, "bucket", item)
    largest = per.agg(F.max("_n")).first()[0] or 1
    buckets, level, decided = -(-largest // group), 0, [sure]
    while True:
        folded = open_.groupBy(*head, "bucket").agg(F.collect_list("item").alias("items")).select(*head, "bucket", _fold(F.col("items"), seed + level).alias("f"))
        folded = keep(folded.select(*head, "bucket", "f.done", "f.rest"))
        decided.append(folded.select(*head, F.explode("done").alias("d")).select(*head, "d.doc_id", "d.tie", "d.dup", "d.size", "d.p"))
        open_ = folded.where("rest is not null").select(*head, F.floor(F.col("bucket") / group).alias("bucket"), F.col("rest").alias("item"))
        if buckets == 1:
            break
        buckets, level = -(-buckets // group), level + 1
    last = F.when(_uniform(F.col("item.h"), F.lit(seed + 1000)) < F.col("item.p"), 1.0).otherwise(0.0)
    decided.append(open_.select(*head, "item.doc_id", "item.tie", "item.dup", "item.size", last.alias("p")))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    copies = (F.col("_base") + F.col("p")).cast("bigint")
    return out.select("doc_id", "source", "tie", "dup", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it."""
    by = ["doc_id", "source", "size", "tie", "dup"]
    rows = numbered(docs, True)
    taken = mix(docs, **options).where("copies > 0").select(*[F.col(c).alias(f"taken_{c}") for c in by], "copies")
    # Equality of hashes and numbers joins; ids and sources may be null.
    test = (rows["tie"] == taken["taken_tie"]) & (rows["dup"] == taken["taken_dup"]) & (rows["size"] == taken["taken_size"]) & rows["doc_id"].eqNullSafe(taken["taken_doc_id"]) & rows["source"].eqNullSafe(taken["taken_source"])
    return rows.join(taken, test).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("again")).select("row.*")
