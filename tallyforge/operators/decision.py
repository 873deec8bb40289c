"""Decisions, routing, fills and frequencies over rule results (G-09..G-21, T-02, T-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import config


def recommend(results: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """G-10: SYSTEM_ERROR, MANUAL_REVIEW, HOLD, REVIEW or AUTO_PASS; low findings pass, and what wasn't evaluated without a cause is no pass."""
    sev = F.when(F.col("severity") == "High", 3).when(F.col("severity") == "Medium", 2).when(F.col("severity") == "Low", 1).otherwise(0)
    agg = results.groupBy("doc_id").agg(F.bool_or(F.col("result") == "manual_review").alias("manual"), F.max(sev).alias("sev"), F.bool_or((F.col("result") == "not_evaluated") & F.col("halted_by").isNull()).alias("open"), F.array_sort(F.collect_set("code")).alias("codes"))
    if errors is not None:
        agg = agg.join(errors.select("doc_id").distinct().withColumn("error", F.lit(True)), "doc_id", "left")
    else:
        agg = agg.withColumn("error", F.lit(None).cast("boolean"))
    value = F.when(F.col("error"), "SYSTEM_ERROR").when(F.col("manual"), "MANUAL_REVIEW").when(F.col("sev") == 3, "HOLD").when(F.col("sev") == 2, "REVIEW").when(F.col("open"), "MANUAL_REVIEW").otherwise("AUTO_PASS")
    return agg.select("doc_id", value.alias("recommendation"), F.get(F.array(*map(F.lit, ("None", "Low", "Medium", "High"))), F.col("sev")).alias("max_severity"), F.array_join("codes", ",").alias("codes"))


def route(recommended: DataFrame, user_codes: tuple[str, ...] = config.USER_CODES_V66) -> DataFrame:
    """G-09, T-06: to the user if one of their codes is there, to accounting otherwise, to no one on a pass."""
    user = F.arrays_overlap(F.split("codes", ","), F.array(*map(F.lit, user_codes)))
    return recommended.select("doc_id", "recommendation", F.when(F.col("recommendation") == "AUTO_PASS", "none").when(user, "user").otherwise("accounting").alias("assigned_to"))


def fill(results: DataFrame, docs: DataFrame) -> DataFrame:
    """T-02: a row for every document and rule; those that weren't run are not_evaluated."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, config.RULES))).alias("rule_id"))
    return wanted.join(results.select("doc_id", "rule_id", "result"), ["doc_id", "rule_id"], "left").select("doc_id", "rule_id", F.coalesce("result", F.lit("not_evaluated")).alias("result"))


def matrix(results: DataFrame) -> DataFrame:
    """G-18."""
    kinds = ["pass", "fail", "manual_review", "not_evaluated"]
    return results.groupBy("rule_id").pivot("result", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds).select("rule_id", *(F.col(k).cast("long").alias(f"n_{k}") for k in kinds))


def frequency(results: DataFrame) -> DataFrame:
    """G-20, L-07: how often each code comes, most frequent first."""
    return results.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def step_status(results: DataFrame) -> DataFrame:
    """G-21: passed if all rules of a step did, failed if any did."""
    step = F.when(F.col("rule_id").isin("V-01", "V-02", "V-03", "V-06"), 1).when(F.col("rule_id").isin("V-04", "V-05"), 2).otherwise(3)
    return results.groupBy("doc_id", step.cast("long").alias("step")).agg(F.when(F.every(F.col("result") == "pass"), "passed").when(F.some(F.col("result") == "fail"), "failed").otherwise("open").alias("status"))
