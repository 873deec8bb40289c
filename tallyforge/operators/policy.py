"""Versioned policies (C-21): documents of several versions are judged in one run, each under the one in force on its date.

Policies are rows: policy, valid_from (date), and the numbers that rules need. A version holds until the next
one of its policy begins. A document from before the first version, without a date, or of an unknown policy has no
version, and its rules aren't evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "policy string, valid_from date, version string, line_tolerance_c long, total_tolerance_c long, vat_tolerance_c long, vat_percent long"


def periods(policies: DataFrame) -> DataFrame:
    """policies with valid_to, the day on which the next version begins (null: none yet)."""
    return policies.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("policy").orderBy("valid_from")))


def in_force(documents: DataFrame, policies: DataFrame, date: str) -> DataFrame:
    """documents (with a column policy) and the columns of the version in force on `date`; an as-of join on (policy, year), so that one policy's documents spread over its years."""
    years = F.sequence(F.year("valid_from"), F.coalesce(F.year("valid_to"), F.lit(9999)))
    open_ended = F.col("valid_to").isNull()
    p = periods(policies)
    # the version without an end stands under year 0 for all years after its first
    by_year = p.withColumn("year", F.explode(F.when(open_ended, F.array(F.year("valid_from"), F.lit(0))).otherwise(years)))
    last = p.where(open_ended).select("policy", F.year("valid_from").alias("last_year"))
    dated = documents.join(last, "policy", "left").withColumn("year", F.when(F.year(date) > F.col("last_year"), 0).otherwise(F.year(date))).drop("last_year")
    own = [c for c in by_year.columns if c not in ("policy", "year")]
    joined = dated.alias("d").join(by_year.alias("p"), (F.col("d.policy") == F.col("p.policy")) & (F.col("d.year") == F.col("p.year")) & (F.col(f"d.{date}") >= F.col("p.valid_from")) & (F.col("p.valid_to").isNull() | (F.col(f"d.{date}") < F.col("p.valid_to"))), "left")
    return joined.select("d.*", *(F.col(f"p.{c}") for c in own)).drop("year")


def half_even_percent(cents: Column, percent: Column) -> Column:
    return F.bround(cents.cast("decimal(20,4)") * percent / 100, 0).cast("long")


def judged(header: DataFrame, lines: DataFrame, policies: DataFrame, date: str) -> DataFrame:
    """doc_id, version, bad_lines, v02, v03 of each header (doc_id, policy, a date, lines_c, sub_total_c, vat_c, grand_c), by its own version's tolerances and tax rate."""
    h = in_force(header, policies, date)
    gaps = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.abs(F.col("qty") * F.col("price_c") - F.col("amount_c")))).alias("gaps"))  # a document's lines
    j = h.join(gaps, "doc_id", "left")
    bad = F.size(F.filter(F.coalesce("gaps", F.array().cast("array<long>")), lambda g: g > F.col("line_tolerance_c")))
    over = (F.abs(F.col("lines_c") - F.col("sub_total_c")) > F.col("total_tolerance_c")) | (F.abs(half_even_percent(F.col("sub_total_c"), F.col("vat_percent")) - F.col("vat_c")) > F.col("vat_tolerance_c")) | (F.abs(F.col("sub_total_c") + F.col("vat_c") - F.col("grand_c")) > F.col("total_tolerance_c"))
    none = F.col("version").isNull()
    v02 = F.when(none | F.col("gaps").isNull(), "not_evaluated").when(bad > 0, "fail").otherwise("pass")
    v03 = F.when(none | over.isNull(), "not_evaluated").when(over, "fail").otherwise("pass")
    return j.select("doc_id", "version", F.when(~none, bad).cast("long").alias("bad_lines"), v02.alias("v02"), v03.alias("v03"))
