"""Evidence promotion and votes (E-*, G-08, G-25..G-28, R-08, R-09)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import config
from tallyforge.functions import normalize as N


def promote(field: Column, condition: Column, tag: str) -> Column:
    """E-01: struct(value, ok, null_reason, evidence) with ok set and a tag added where the condition holds."""
    confirmed = F.struct(field["value"].alias("value"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("null_reason"), F.array_append(field["evidence"], F.lit(tag)).alias("evidence"))
    return F.when(condition & ~field["ok"], confirmed).otherwise(field)


def promote_arithmetic(lines: DataFrame) -> DataFrame:
    """E-02 over lines (doc_id, line_no, qty, price_c, amount_c, confirmed): a line whose quantity times price gives its amount confirms an amount that readers didn't."""
    read = F.coalesce("confirmed", F.lit(False))
    cell = F.struct(F.col("amount_c").alias("value"), read.alias("ok"), F.when(~read, "LOW_CONFIDENCE").alias("null_reason"), F.array().cast("array<string>").alias("evidence"))
    closes = F.abs(F.col("qty") * F.col("price_c") - F.col("amount_c")) <= config.LINE_TOLERANCE_C
    x = lines.select("doc_id", "line_no", promote(cell, closes, "qty_x_price").alias("x"))
    return x.select("doc_id", "line_no", F.col("x.ok").alias("ok"), F.col("x.null_reason").alias("null_reason"), F.array_join("x.evidence", ",").alias("evidence"))


def promote_by_receipt(compared: DataFrame) -> DataFrame:
    """E-03, E-04: what a matched receipt line says too (compared, with unit_read: the unit as it was read): price, quantity, unit; an empty unit is inherited."""
    unit = F.col("unit_read")
    same = N.v66_uom_group(unit) == N.v66_uom_group(F.col("rcv_uom"))
    tags = F.array_compact(F.array(F.when(F.col("price_c") == F.col("rcv_price_c"), "price"), F.when(F.col("qty") == F.col("rcv_qty"), "qty"), F.when(unit.isNull() & F.col("rcv_uom").isNotNull(), "uom_inherited").when(same, "uom")))
    return compared.select("doc_id", "line_no", F.coalesce(unit, F.col("rcv_uom")).alias("uom"), F.array_join(tags, ",").alias("evidence"))


def derived_quantity(compared: DataFrame) -> DataFrame:
    """E-05: a quantity that wasn't read is amount / price if that is the receipt's, within a thousandth."""
    fits = F.abs(F.col("amount_c") * 1000 - F.col("rcv_qty") * F.col("price_c") * 1000) <= F.col("price_c")
    return compared.where("price_c > 0").select("doc_id", "line_no", F.when(fits, F.col("rcv_qty")).alias("derived_qty"))


def weighted_price(active: DataFrame) -> DataFrame:
    """G-08: the price that all lots share, or their amount over their quantity, in hundredths of a cent, ties to even."""
    g = active.groupBy("doc_id", "item").agg(F.count_distinct("rcv_price_c").alias("prices"), F.max("rcv_price_c").alias("one"), F.sum("rcv_amount_c").alias("amount"), F.sum("rcv_qty").alias("qty"))
    n = F.col("amount") * 100
    q, r = F.floor(n / F.col("qty")).cast("long"), n % F.col("qty")
    even = q + F.when((r * 2 > F.col("qty")) | ((r * 2 == F.col("qty")) & (q % 2 != 0)), 1).otherwise(0)
    return g.select("doc_id", "item", F.when(F.col("prices") == 1, F.col("one") * 100).otherwise(even).cast("long").alias("price_e4"))


def vote(answers: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """G-26, G-27: the answer that more than half of a subject's votes give, or manual_review; and its share."""
    n = answers.groupBy(*keys, answer).agg(F.count("*").alias("n"))
    of = Window.partitionBy(*keys)
    best = F.row_number().over(of.orderBy(F.desc("n"), F.asc_nulls_last(answer)))
    top = n.withColumn("votes", F.sum("n").over(of)).withColumn("place", best).where("place = 1")
    return top.select(*keys, F.when(F.col("n") * 2 > F.col("votes"), F.col(answer)).otherwise("manual_review").alias("verdict"), F.col("n").alias("agreeing"), "votes")


def guard(expected: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """R-08: an answer that is missing or other than what arithmetic expects is for a person."""
    return expected.join(answers, keys, "left").select(*keys, F.when(F.col("answer").eqNullSafe(F.col("expected")), F.col("expected")).otherwise("manual_review").alias("verdict"))


def likeness(a: Column, b: Column) -> Column:
    """G-28: the sequence ratio (twice the matching blocks' length over both lengths); no edit distance equals it."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return ratio(a, b)


def consensus(readings: DataFrame, fuzzy: bool = False) -> DataFrame:
    """G-25: id, page, layer, crop (three readings), confidence -> raw, conf, agreement, null_reason.

    Three equal readings give .98 and two .96; else, if `fuzzy`, the two most alike at .85 or more
    give .85; one reading alone is kept at .70 at most, and different ones are a conflict at .55 at most.
    """
    names = ("page", "layer", "crop")
    r = readings.select("*", *(F.when(F.trim(n) != "", F.col(n)).alias(f"v_{n}") for n in names)).select("*", *(N.reading_key(F.col(f"v_{n}")).alias(f"k_{n}") for n in names))
    eq = lambda a, b: F.coalesce(F.col(f"k_{a}") == F.col(f"k_{b}"), F.lit(False))
    pl, pc, lc = eq("page", "layer"), eq("page", "crop"), eq("layer", "crop")
    n = F.size(F.array_compact(F.array(*(F.col(f"v_{x}") for x in names))))
    any_read = F.coalesce(*(F.col(f"v_{x}") for x in names))
    raw = F.when(n == 0, None).when(pl | pc, F.col("v_page")).when(lc, F.col("v_layer"))
    conf = F.when(n == 0, 0.0).when(pl & pc, 0.98).when(pl | pc | lc, 0.96)
    agree = pl | pc | lc
    if fuzzy:
        both = lambda a, b: F.when(F.col(f"k_{a}").isNotNull() & F.col(f"k_{b}").isNotNull(), likeness(F.col(f"k_{a}"), F.col(f"k_{b}"))).otherwise(-1.0)
        r = r.withColumn("r_pl", both("page", "layer")).withColumn("r_pc", both("page", "crop")).withColumn("r_lc", both("layer", "crop"))
        most = F.greatest("r_pl", "r_pc", "r_lc")
        close = ~agree & (most >= 0.85)
        raw = raw.when(close & ((F.col("r_pl") == most) | (F.col("r_pc") == most)), F.col("v_page")).when(close, F.col("v_layer"))
        conf, agree = conf.when(close, 0.85), agree | close
    alone = F.coalesce(F.col("confidence"), F.when(n == 1, 0.6).otherwise(0.5))
    conf = conf.when(n == 1, F.least(alone, F.lit(0.70))).otherwise(F.least(alone, F.lit(0.55)))
    reason = F.when(n == 0, "NOT_PRESENT").when(~agree & (n > 1), "CONFLICT_BETWEEN_SOURCES")
    return r.select("id", raw.otherwise(any_read).alias("raw"), conf.alias("conf"), agree.alias("agreement"), reason.alias("null_reason"))
