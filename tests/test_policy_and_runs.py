"""Versions of a policy side by side, and runs that overtake each other."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import policy
from tallyforge.sources.runs import RunStore, StaleRun

DAY = datetime.date


@pytest.fixture(scope="module")
def versions(spark):
    rows = [("a", DAY(2020, 3, 1), "a1", 50, 50, 100, 7), ("a", DAY(2020, 9, 1), "a2", 0, 50, 100, 10), ("a", DAY(2023, 1, 1), "a3", 10, 0, 0, 7), ("b", DAY(2021, 1, 1), "b1", 5, 5, 5, 7)]
    return spark.createDataFrame(rows, policy.SCHEMA)


def test_each_document_is_judged_under_its_own_version(spark, versions):
    dates = [DAY(2020, 2, 29), DAY(2020, 3, 1), DAY(2020, 8, 31), DAY(2020, 9, 1), DAY(2022, 12, 31), DAY(2023, 1, 1), DAY(2023, 6, 1), DAY(2031, 1, 1), None]
    rows = [(i, p, d) for i, (p, d) in enumerate((p, d) for p in ("a", "b", "z", None) for d in dates)]
    df = spark.createDataFrame(rows, "doc_id long, policy string, day date")
    got = {r["doc_id"]: r["version"] for r in policy.in_force(df, versions, "day").collect()}
    starts = sorted((r["policy"], r["valid_from"], r["version"]) for r in versions.collect())
    want = {i: next((v for q, f, v in reversed(starts) if q == p and d is not None and f <= d), None) for i, p, d in rows}
    assert got == want


def test_tolerances_and_rates_are_the_versions(spark, versions):
    header = spark.createDataFrame([(1, "a", DAY(2020, 4, 1)), (2, "a", DAY(2020, 10, 1)), (3, "a", DAY(2024, 1, 1)), (4, "a", DAY(2019, 1, 1)), (5, "a", DAY(2020, 4, 1))], "doc_id long, policy string, day date").withColumns({"lines_c": F.lit(10_020), "sub_total_c": F.lit(10_000), "vat_c": F.lit(700), "grand_c": F.lit(10_700)})
    lines = spark.createDataFrame([(i, 2, 5_000, 10_020) for i in (1, 2, 3, 4)], "doc_id long, qty long, price_c long, amount_c long")
    got = [tuple(r) for r in policy.judged(header, lines, versions, "day").orderBy("doc_id").collect()]
    assert got == [(1, "a1", 0, "pass", "pass"), (2, "a2", 1, "fail", "fail"), (3, "a3", 1, "fail", "fail"), (4, None, None, "not_evaluated", "not_evaluated"), (5, "a1", 0, "not_evaluated", "pass")]


def files(folder):
    return sorted(p.name for p in (folder / "data").iterdir()) if (folder / "data").exists() else []


def test_a_stale_run_is_refused_and_leaves_nothing(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}")
    assert store.read() is None
    first = store.begin()
    store.commit(first, spark.range(3))
    second = store.begin()
    third = store.begin()
    with pytest.raises(StaleRun):
        store.commit(second, spark.range(99))
    assert len(files(tmp_path)) == 1 and store.read().count() == 3  # a reader still sees the whole of the first
    store.commit(third, spark.range(5))
    assert store.read().count() == 5 and (first, second, third) == (1, 2, 3)


def test_a_run_that_is_overtaken_while_it_writes_is_refused(spark, tmp_path, monkeypatch):
    store, other = RunStore(spark, f"file://{tmp_path}"), RunStore(spark, f"file://{tmp_path}")
    run, log, calls = store.begin(), store._log, []

    def looked():
        calls.append(1)
        if len(calls) == 2:  # its data are written, its entry isn't
            other.commit(other.begin(), spark.range(7))
        return log()

    monkeypatch.setattr(store, "_log", looked)
    with pytest.raises(StaleRun):
        store.commit(run, spark.range(2))
    assert other.read().count() == 7 and len(files(tmp_path)) == 1


def test_two_writers_of_one_place(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}")
    assert store._append(0, {"run": 1}) and not store._append(0, {"run": 2})
    assert store._log() == [{"run": 1}] and store.begin() == 2
    spark.range(1).write.parquet(f"file://{tmp_path}/data/run-000001-lost")
    assert store.swept() == 1 and files(tmp_path) == []
