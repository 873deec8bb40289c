"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents, in doc_id order, are cut into blocks of BLOCK_BYTES of text. Slots go in
periods of SLOTS. By the end of period p a source of weight w has been given the whole part of its
share of all slots so far, so a remainder is carried over to later periods and no error adds up. In a
period in which it gets n blocks, its block number a (from 0) is released at floor(a * SLOTS / n) and
wanted by ceil((a + 1) * SLOTS / n); at every slot the released block of earliest deadline goes. So
at any slot a source has been given its period's share to within less than one block, and its exact
weight's to within less than two, however long the mix is. A period is folded over a sequence in a
row of its own; periods of equal shares are folded once. Nothing is drawn at random.

No rows are dropped: after a source's last block its later slots are passed over and the others go
on in their own order. A source of null is a source of its own; sources without a given weight above
0 get the smallest that is given; weights below 1 / LONGEST of the whole count as that; null texts
count no bytes and keep their place in doc_id order; very long texts are in the block in which they
begin; repeated rows and ids stay, one after another; rows without an id come first; an empty table
gives an empty result. Extra columns are not looked at. Block numbers come from prefix sums over
ranges of rows, so neither a hot source nor a repeated id meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import common

BLOCK_BYTES = 1 << 16
SLOTS = 1000
#: Slots of a period at most, unless there are more sources.
LONGEST = 4000


def before(rows: DataFrame, part: str, key: str, ties: list[str], value: str, out: str) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows of the same `part` that come before, by key and then ties.

    Rows are range-partitioned (equal ones by their place in the input), summed up within each range, and
    the totals of the ranges before are added: as many rows as there are ranges and parts.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first(c) for c in (key, *ties, "tie_")]
    dealt = rows.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(n, F.asc_nulls_first(part), *order)
    dealt = common.stored(dealt.withColumn("range_", F.spark_partition_id()))
    totals = dealt.groupBy("range_", part).agg(F.sum(value).alias("own_"))
    earlier = Window.partitionBy(part).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("range_").alias("at_"), F.col(part).alias("of_"), F.coalesce(F.sum("own_").over(earlier), F.lit(0)).alias("base_"))
    fine = Window.partitionBy("range_", part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn(out, F.coalesce(F.sum(value).over(fine), F.lit(0)))
    joined = summed.join(base, (F.col("range_") == F.col("at_")) & F.col(part).eqNullSafe(F.col("of_")))
    return joined.withColumn(out, F.col(out) + F.col("base_")).drop("tie_", "range_", "at_", "of_", "base_")


def shares(volumes: DataFrame, weights: DataFrame | None) -> DataFrame:
    """source, weight (they add up to 1), upto (sum of the weights of the sources before), place (of the source, from 0), slots (of a period).

    Without weights a source's is the square root of its volume.
    """
    if weights is None:
        known = volumes.withColumn("weight", F.sqrt(F.greatest(F.col("volume").cast("double"), F.lit(1.0))))
    else:
        given = weights.groupBy(F.col("source").alias("of")).agg(F.max(F.col("weight").cast("double")).alias("weight")).where("weight > 0")
        known = volumes.join(given, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    one = Window.partitionBy(F.lit(0))  # a row a source
    known = known.withColumn("weight", F.coalesce("weight", F.min("weight").over(one), F.lit(1.0)))
    known = known.withColumn("weight", F.greatest(F.col("weight") / F.sum("weight").over(one), 1 / F.greatest(F.lit(LONGEST), F.count("*").over(one))))
    known = known.withColumn("weight", F.col("weight") / F.sum("weight").over(one))
    order = one.orderBy(F.asc_nulls_first("source"))
    slots = F.greatest(F.lit(SLOTS), F.ceil(1 / F.min("weight").over(one))).cast("long")
    return known.select("source", "weight", F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("upto"), (F.row_number().over(order) - 1).alias("place"), slots.alias("slots"))


def given(period: Column, slots: Column, upto: Column, weight: Column) -> Column:
    """Blocks that a source has been given before a period: whole parts of the running sums of weights, so that all sources' add up to its slots."""
    whole = lambda x: F.floor(period * slots * F.round(x, 12) + 0.5)
    return whole(upto + weight) - whole(upto)


def pattern(counts: Column, slots: Column) -> Column:
    """Place of the source of each slot of a period in which each source gets counts[place] blocks, earliest deadline first."""

    def chosen(done: Column, slot: Column) -> Column:
        """Place of the released block with the earliest deadline."""
        each = F.transform(F.arrays_zip(counts.alias("n"), done.alias("a")), lambda x, i: F.when((x["a"] < x["n"]) & (F.floor(x["a"] * slots / x["n"]) <= slot), F.struct(F.ceil((x["a"] + 1) * slots / x["n"]).alias("deadline"), i.alias("i"))))
        return F.array_min(each)["i"]

    def step(state: Column, slot: Column) -> Column:
        # what the last step chose is counted and noted now, so that each choice is evaluated once
        done = F.transform(state["done"], lambda n, i: n + F.when(i == state["last"], 1).otherwise(0))
        return F.struct(done.alias("done"), chosen(done, slot).alias("last"), F.concat(state["order"], F.array(state["last"])).alias("order"))

    start = F.struct(F.transform(counts, lambda n: F.lit(0)).alias("done"), F.lit(-1).alias("last"), F.array().cast("array<int>").alias("order"))
    whole = lambda state: F.concat(F.slice(state["order"], F.lit(2), F.size(state["order"])), F.array(state["last"]))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), start, step, whole)


def slotted(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """source, block, slot of each of blocks (source, block), by the weights of shares()."""
    shared = common.stored(shared)
    own = shared.select(F.col("source").alias("of"), "weight", "upto", "place", "slots")
    found = blocks.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    about = F.floor(F.col("block") / (F.col("weight") * F.col("slots")))
    fits = lambda p: (given(p, F.col("slots"), F.col("upto"), F.col("weight")) <= F.col("block")) & (F.col("block") < given(p + 1, F.col("slots"), F.col("upto"), F.col("weight")))
    period = reduce(lambda rest, d: F.when(fits(about + d), about + d).otherwise(rest), (2, -2, 1, -1, 0), F.lit(None).cast("long"))
    found = common.stored(found.withColumn("period", period))
    found = found.withColumn("turn", F.col("block") - given(F.col("period"), F.col("slots"), F.col("upto"), F.col("weight")))
    sources = shared.agg(F.array_sort(F.collect_list(F.struct("place", "upto", "weight"))).alias("all"))  # a row a source
    periods = found.select("period", "slots").distinct().withColumn("one", F.lit(0)).join(F.broadcast(sources.withColumn("one", F.lit(0))), "one")
    counts = F.transform("all", lambda x: given(F.col("period") + 1, F.col("slots"), x["upto"], x["weight"]) - given(F.col("period"), F.col("slots"), x["upto"], x["weight"]))
    periods = common.stored(periods.select("period", "slots", counts.alias("counts")))
    kinds = periods.select("counts", "slots").distinct().select("counts", F.posexplode(pattern(F.col("counts"), F.col("slots"))).alias("at", "place"))
    kinds = common.stored(kinds.withColumn("turn", F.row_number().over(Window.partitionBy("counts", "place").orderBy("at")) - 1))
    placed = found.join(periods.select("period", "counts"), "period").join(kinds, ["counts", "place", "turn"])
    return placed.select("source", "block", (F.col("period") * F.col("slots") + F.col("at")).alias("slot"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, source, n_bytes, block (of its source, from 0), slot (place of the block in the mix) of every row of docs.

    docs: doc_id, text, source; weights: source, weight.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    blocks = common.stored(before(rows, "source", "doc_id", ["n_bytes"], "n_bytes", "past").withColumn("block", F.floor(F.col("past") / block_bytes)))  # no texts: a row of some 30 bytes a document
    volumes = blocks.groupBy("source").agg(F.sum("n_bytes").alias("volume"))
    slots = slotted(blocks.select("source", "block").distinct(), shares(volumes, weights)).select(F.col("source").alias("of"), F.col("block").alias("number"), "slot")
    found = blocks.join(slots, blocks["source"].eqNullSafe(slots["of"]) & (blocks["block"] == slots["number"]))
    return found.select("doc_id", "source", "n_bytes", "block", "slot")
