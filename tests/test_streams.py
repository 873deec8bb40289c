"""Streams over several micro-batches: state is carried over, or expires."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import store as batch
from tallyforge.plans import streams
from tallyforge.streaming import dimension, store

SF = "/root/testdata/sf0.001"


def in_files(spark, df, order, n, folder):
    """A stream of df's rows in n files, one a micro-batch, in order."""
    table = df.orderBy(order).toArrow()
    size = -(-table.num_rows // n)
    for i in range(n):
        at = f"{folder}/{i}.parquet"
        pq.write_table(table.slice(i * size, size), at)
        os.utime(at, (1_700_000_000 + i, 1_700_000_000 + i))
    found = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return found.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else found


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_workflow_over_three_batches_equals_the_batch_form(spark, events, tmp_path):
    actions = streams.actions_of(events)
    stream = in_files(spark, actions, "arrival", 3, tmp_path)
    every = store.drained(store.workflow(stream), "test-workflow")
    last = store.drained(store.workflow(stream), "test-workflow", latest="external_id")
    key = lambda r: r["external_id"]
    assert every.count() > last.count() == actions.select("external_id").distinct().count()
    assert [r.asDict() for r in sorted(last.collect(), key=key)] == [r.asDict() for r in sorted(batch.workflow(actions).collect(), key=key)]


def test_requests_sent_again_in_a_later_batch_have_no_effect(spark, tmp_path):
    rows = [(1, 1, "a", "hold", False), (1, 2, "b", "confirm", False), (1, 3, "a", "hold", False), (1, 4, "c", "hold", False)]
    df = spark.createDataFrame([(*r, None) for r in rows], "external_id long, arrival long, request_id string, action string, receiver boolean, expected_version long")
    last = store.drained(store.workflow(in_files(spark, df, "arrival", 4, tmp_path)), "test-again", latest="external_id").first()
    assert (last["version"], last["state"], last["applied"], last["refused"]) == (3, "on_hold", 3, 0)


@pytest.mark.parametrize(("ttl", "want"), [(None, (1, 1, 2)), (86_400_000, (1, 1, 2)), (1, (1, 1, 0))])
def test_state_expires(spark, tmp_path, ttl, want):
    df = spark.createDataFrame([(7, i, f"r{i}", "hold", False, None) for i in range(3)], "external_id long, arrival long, request_id string, action string, receiver boolean, expected_version long")
    last = store.drained(store.workflow(in_files(spark, df, "arrival", 3, tmp_path), ttl_ms=ttl), "test-ttl", latest="external_id").first()
    assert (last["version"], last["applied"], last["refused"]) == want


def test_late_revisions_are_dropped_in_later_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (1, 3, 6), (2, 4, 1)], "external_id long, event_id long, revision long")
    found = store.drained(store.monotone(in_files(spark, df, "event_id", 4, tmp_path)), "test-revisions").collect()
    assert sorted((r["external_id"], r["revision"]) for r in found) == [(1, 5), (1, 6), (2, 1)]


def test_duplicates_in_later_batches_pass_once(spark, events, tmp_path):
    twice = events.unionByName(events.where("event_id % 5 = 0")).withColumn("at", F.monotonically_increasing_id())
    found = store.drained(store.deduplicated(in_files(spark, twice, "at", 3, tmp_path), "1000 days"), "test-dedupe")
    assert found.count() == events.count()


def test_a_dimension_is_read_again_by_age(spark, tmp_path):
    now, version = [0.0], [1]

    def load():
        if version[0] is None:
            raise OSError("down")
        return spark.createDataFrame([(1, f"v{version[0]}")], "external_id long, name string")

    table = dimension.AgedTable(load, ttl_seconds=10, clock=lambda: now[0])
    seen = lambda: table.get().first()["name"]
    assert seen() == "v1"
    version[0], now[0] = 2, 9.9
    assert seen() == "v1"
    now[0] = 10.0
    assert seen() == "v2"
    version[0], now[0] = None, 25.0
    assert seen() == "v2" and isinstance(table.error, OSError)
    version[0] = 3
    assert seen() == "v3" and table.error is None
    version[0] = None
    with pytest.raises(OSError):
        dimension.AgedTable(load).get()


def test_a_stream_sees_the_dimension_as_of_each_batch(spark, tmp_path):
    version = [0]

    def load():
        version[0] += 1
        return spark.createDataFrame([(1, f"v{version[0]}")], "external_id long, name string")

    (tmp_path / "in").mkdir()
    df = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "external_id long, event_id long")
    ticks = iter((0.0, 1.0, 20.0))
    table = dimension.AgedTable(load, ttl_seconds=10, clock=lambda: next(ticks))
    dimension.enriched(in_files(spark, df, "event_id", 3, tmp_path / "in"), table, "external_id", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted((r["event_id"], r["name"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "v1"), (2, None), (3, "v2")]


def test_entity_keys(spark):
    rows = [(1, 10, "1234567890123", "A", ["1", "2", "1"]), (2, 1, "x", "B", ["3"]), (3, 10, None, "C", [])]
    df = spark.createDataFrame(rows, "org_id long, unit_id long, tax_id string, legal_name string, postals array<string>")
    got = {r["key"]: (r["org_id"], r["postals"], r["is_group_tax_id"]) for r in dimension.entity_keys(df).collect()}
    assert got == {1: (1, ["1", "2"], True), 2: (2, ["3"], False), 3: (3, [], False), 10: (1, ["1", "2"], True)}
