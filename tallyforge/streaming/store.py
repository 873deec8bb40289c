"""The document store as streams (S-01..S-06, S-09): Structured Streaming over event files or topics.

Duplicate events are remembered within a watermark. A document's workflow is one row in the state store
and a map of the request ids that had an effect; both expire if a time to live is set, and the document
then begins anew. Without one the map grows with the document's actions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tallyforge.operators import store
from tallyforge.storage import scratch


def events(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """Events as they arrive; the time is cast, since a watermark takes no timestamps without zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """S-01: each event id once within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


#: The only state store that keeps typed state variables.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def keyed(stream: DataFrame, processor: StatefulProcessor, schema: str, mode: str, time: str) -> DataFrame:
    for name, value in STATE_STORE.items():
        stream.sparkSession.conf.set(name, value)
    return stream.groupBy("external_id").transformWithStateInPandas(processor, schema, mode, time)


class Latest(StatefulProcessor):
    """S-02: passes on revisions above all before of their document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("revision", StructType([StructField("revision", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top = self.seen.get()[0] if self.seen.exists() else -1
        every = pd.concat(list(rows)).sort_values("revision")
        fresh = every[every["revision"] > top]
        if len(fresh):
            self.seen.update((int(fresh["revision"].max()),))
            yield fresh[["event_id", "revision"]].assign(external_id=key[0])[["external_id", "event_id", "revision"]]

    def close(self) -> None:
        pass


def monotone(stream: DataFrame) -> DataFrame:
    """S-02 for a stream of (external_id, event_id, revision)."""
    return keyed(stream, Latest(), "external_id long, event_id long, revision long", "Append", "None")


class Requests:
    """The request ids in a map state, as operators.store.apply_action() wants them. Each look at the state is a call to the JVM,
    so a document without a state asks for none, and ids that a batch adds are held until its end()."""

    def __init__(self, state) -> None:
        self.state = state
        self.begin(known=True)

    def begin(self, known: bool) -> None:
        self.known, self.added = known, {}

    def __contains__(self, request: str) -> bool:
        return request in self.added or (self.known and self.state.containsKey((request,)))

    def add(self, request: str) -> None:
        self.added[request] = True

    def end(self) -> None:
        for request in self.added:
            self.state.updateValue((request,), (True,))


class Workflow(StatefulProcessor):
    """S-04..S-06: a document's workflow state; S-09: it is forgotten after the time to live."""

    NAMES = ("version", "state", "assignee", "pending", "applied", "refused")

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        types = dict(zip(self.NAMES, (LongType(), StringType(), StringType(), BooleanType(), LongType(), LongType()), strict=True))
        self.value = handle.getValueState("workflow", StructType([StructField(n, t) for n, t in types.items()]), self.ttl_ms)
        self.requests = Requests(handle.getMapState("requests", StructType([StructField("request", StringType())]), StructType([StructField("done", BooleanType())]), self.ttl_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.value.exists()  # it is updated after the request ids, so they expire before it does
        now = dict(zip(self.NAMES, self.value.get(), strict=True)) if known else dict(store.FRESH)
        self.requests.begin(known)
        for a in pd.concat(list(rows)).sort_values("arrival").to_dict("records"):  # a document's actions in one micro-batch
            a["expected_version"] = None if pd.isna(a["expected_version"]) else a["expected_version"]
            now = store.stepped(now, a, self.requests)
        self.requests.end()
        self.value.update(tuple(now[n] for n in self.NAMES))
        yield pd.DataFrame([(key[0], *(now[n] for n in self.NAMES))], columns=["external_id", *self.NAMES])

    def close(self) -> None:
        pass


def workflow(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A document's state after each batch that has actions of it."""
    mode = "ProcessingTime" if ttl_ms else "None"
    return keyed(stream, Workflow(ttl_ms), store.STATE_SCHEMA, "Update" if not ttl_ms else "Append", mode)


def upserted(stream: DataFrame, path: str, checkpoint: str):
    """S-03: the event log is appended by batch number, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, name: str, latest: str | None = None) -> DataFrame:
    """All that a stream gives for what is there now, as a table; with `latest`, the last batch's row for each value of that column.

    Batches without data are off meanwhile: state with a time to live would ask for them for ever.
    """
    spark, quiet = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    out, before = scratch(spark, name), stream.sparkSession.conf.get(quiet)
    spark.conf.set(quiet, "false")
    try:
        upserted(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(quiet, before)
    found = spark.read.parquet(f"{out}/table")
    if latest:
        newest = F.max("batch").over(Window.partitionBy(latest))
        found = found.withColumn("newest", newest).where("batch = newest").drop("newest")
    return found.drop("batch")
