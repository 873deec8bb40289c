"""Queries that drain a stream; SQL can't express their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.catalogue import ACTS
from tallyforge.streaming import store


def stream_ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = store.events(spark, sf_dir)
    return store.drained(store.deduplicated(e.unionByName(e.where("event_id % 10 = 0"))), "stream-dedupe").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = store.events(spark, sf_dir).select(F.col("user_id").alias("external_id"), "event_id", F.col("event_id").alias("revision"))
    return store.drained(store.monotone(e), "stream-latest").groupBy("external_id").agg(F.max("revision").alias("revision"))


def actions_of(events: DataFrame) -> DataFrame:
    """Events as actions on documents, some of them sent again."""
    kind = F.get(F.array(*map(F.lit, (*ACTS, "accepted", "revision"))), (F.col("event_id") * 7 + F.col("user_id")) % 9)
    return events.select(F.col("user_id").alias("external_id"), F.col("event_id").alias("arrival"), F.concat(F.lit("r"), (F.col("event_id") - F.when(F.col("event_id") % 11 == 0, 11).otherwise(0)).cast("string")).alias("request_id"), kind.alias("action"), (F.col("user_id") % 2 == 0).alias("receiver"), F.lit(None).cast("long").alias("expected_version"))


def stream_workflow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.drained(store.workflow(actions_of(store.events(spark, sf_dir))), "stream-workflow", latest="external_id")


def stream_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.drained(store.workflow(actions_of(store.events(spark, sf_dir)), ttl_ms=86_400_000), "stream-ttl", latest="external_id")


QUERIES = {f.__name__: f for f in (stream_ingest_dedupe, stream_latest_revision, stream_workflow_state, stream_ttl)}
