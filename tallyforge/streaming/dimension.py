"""A dimension inside a stream, read again by age (S-15, C-22)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.storage import scratch

TTL_SECONDS = 3600


class AgedTable:
    """What load() gives, as a copy in the shared folder that is made anew once it is older than its time to live.

    A copy stays what it is however often it is read, so all of a micro-batch sees one version. If loading fails, the copy at
    hand goes on being used, and loading is tried again at the next batch; without a copy the error is raised.
    """

    def __init__(self, load: Callable[[], DataFrame], ttl_seconds: float = TTL_SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.ttl_seconds, self.clock = load, ttl_seconds, clock
        self.copy: DataFrame | None = None
        self.made_at = 0.0
        self.error: Exception | None = None

    def get(self) -> DataFrame:
        now = self.clock()
        if self.copy is None or now - self.made_at >= self.ttl_seconds:
            try:
                fresh = self.load()
                at = scratch(fresh.sparkSession, "dimension")
                fresh.write.parquet(at)
                self.copy, self.made_at, self.error = fresh.sparkSession.read.schema(fresh.schema).parquet(at), now, None
            except Exception as e:
                if self.copy is None:
                    raise
                self.error = e
        return self.copy


def enriched(stream: DataFrame, table: AgedTable, on: str, path: str, checkpoint: str):
    """Appends each micro-batch with the dimension's columns by key, as of the batch; a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.join(table.get(), on, "left").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entity_keys(entities: DataFrame) -> DataFrame:
    """C-22: entities (org_id, unit_id, tax_id, legal_name, postals array) by inventory organisation and by operating unit, a row a key (an organisation's own id wins), with all branches' postal codes and whether the tax id is one (ten digits or more)."""
    valid = F.length(F.regexp_replace(F.coalesce("tax_id", F.lit("")), r"\D", "")) >= 10
    by = lambda key, rank: entities.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(rank).alias("rank"), "org_id", "tax_id", "legal_name", F.array_distinct("postals").alias("postals"), valid.alias("is_group_tax_id"))
    both = by("org_id", 0).unionByName(by("unit_id", 1))
    first = both.groupBy("key").agg(F.min_by(F.struct(*(c for c in both.columns if c not in ("key", "rank"))), F.struct("rank", "org_id")).alias("x"))
    return first.select("key", "x.*")
