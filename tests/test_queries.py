"""Every catalogue query with SQL against DuckDB on the smallest tables, and the streams against their batch forms."""

import duckdb
import pandas as pd
import pytest

from tallyforge.plans import catalogue, documents, pages, streams  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return "null"
        return str(x) if isinstance(x, (str, bool)) or not isinstance(x, (int, float)) and not hasattr(x, "dtype") else f"{float(x):.9g}"

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    found, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_stream_latest_revision_equals_batch(spark):
    got = {r[0]: r[1] for r in streams.stream_latest_revision(spark, SF).collect()}
    want = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg({"event_id": "max"}).collect()}
    assert got == want


def test_stream_workflow_equals_batch(spark):
    key = lambda r: r["external_id"]
    got = sorted(streams.stream_workflow_state(spark, SF).collect(), key=key)
    want = sorted(catalogue.QUERIES["workflow_state"](spark, SF).collect(), key=key)
    assert [r.asDict() for r in got] == [r.asDict() for r in want]


def test_stream_ingest_passes_each_event_once(spark):
    got = {r["event_type"]: r["n"] for r in streams.stream_ingest_dedupe(spark, SF).collect()}
    assert got == {r[0]: r[1] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").count().collect()}
