"""Results and stores (K-*): nested documents, content-addressed files, idempotent tags, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge import config


def assembled(results: DataFrame, recommended: DataFrame) -> DataFrame:
    """K-01, K-02: one nested document a bill: nine rules in order, findings, summary, and the digest of all that."""
    rule = F.struct("rule_id", "result", "code", "severity")
    docs = results.groupBy("doc_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    docs = docs.join(recommended, "doc_id").withColumn("summary", F.struct("recommendation", "max_severity", F.size(F.filter("rules", lambda r: r["code"].isNotNull())).alias("n_findings")))
    body = F.struct("doc_id", "rules", "summary")
    return docs.select("doc_id", "rules", "summary", F.sha2(F.to_json(body), 256).alias("integrity"))


def violations(documents: DataFrame) -> DataFrame:
    """P-18, P-19: documents that break the result's contract, with the reason."""
    ids = F.transform("rules", lambda r: r["rule_id"])
    reason = F.when(F.size("rules") != len(config.RULES), "not_nine_rules").when(~F.coalesce(ids == F.array(*map(F.lit, config.RULES)), F.lit(False)), "unknown_rule").when(~F.col("summary.recommendation").isin("AUTO_PASS", "REVIEW", "HOLD", "MANUAL_REVIEW", "SYSTEM_ERROR"), "unknown_status")
    return documents.withColumn("violation", reason).where("violation is not null").select("doc_id", "violation")


def write_results(documents: DataFrame, path: str) -> None:
    """K-05: JSON by recommendation; a second run replaces only the partitions that it writes."""
    documents.withColumn("recommendation", F.col("summary.recommendation")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recommendation").json(path)


def new_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """K-08: files (sha256, length, is_pdf) to be stored: PDFs up to 20 MB whose content isn't there yet, once each."""
    fine = files.where(F.col("is_pdf") & (F.col("length") <= 20_000_000))
    return fine.dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti")


def with_tag(tags: Column, tag: int) -> Column:
    """K-04, T-08: a tag set with one more, however often it is added."""
    return F.array_union(F.coalesce(tags, F.array().cast("array<int>")), F.array(F.lit(tag)))


def cached(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """K-09: cache entries by key whose file is still the same; any other is a miss (null)."""
    c = cache.select("cache_key", F.col("file_sha256").alias("cached_sha"), "value")
    hit = keys.join(c, "cache_key", "left")
    return hit.select("cache_key", F.when(F.col("cached_sha") == F.col("file_sha256"), F.col("value")).alias("value"))


def rule_rows(results: DataFrame, exceptions: DataFrame) -> DataFrame:
    """K-10: a row for each rule and exception of it; the exception's code wins over the rule's."""
    e = exceptions.select("doc_id", "rule_id", F.col("code").alias("own"))
    return results.join(e, ["doc_id", "rule_id"], "left").select("doc_id", "rule_id", "result", F.coalesce("own", "code").alias("code"))
