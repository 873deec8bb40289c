"""Plans and folds that have to hold at size."""

import pyarrow as pa

from tallyforge.functions import printed
from tallyforge.operators.ordered import whole
from tallyforge.plans import catalogue, pages  # noqa: F401  (pages adds to the catalogue)
from tallyforge.streaming.store import Requests

SMOKE = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_read_rows_are_dealt_by_page_once(spark):
    assert exchanges(catalogue.QUERIES["merged_page_rows"](spark, SMOKE)) == 1


def test_outcomes_sum_lines_once_and_are_not_made_again_by_filters(spark):
    for name in ("rule_results", "rule_fill_not_evaluated", "status_drift", "pick_candidate", "code_frequency", "decision_shares", "kpi_counts", "decision_v62"):
        plan = catalogue.QUERIES[name](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert sum("Relation" in x and "l_orderkey#" in x for x in plan) == 2, name  # bill lines and receipt lines
        assert not any("Filter" in x and "V-02" in x for x in plan), name


def test_the_ladder_reads_no_customers(spark):
    read = [f.rsplit("/", 1)[-1] for f in catalogue.QUERIES["match_ladder_8pass"](spark, SMOKE).inputFiles()]
    assert sorted(set(read)) == ["lineitem.parquet", "orders.parquet", "part.parquet"]


def test_whole_batches_hold_all_rows_of_a_key():
    keys = [None, None, 1, 1, 1, 2, 3, 3, 3, 3, 3, 4]
    for n in range(1, len(keys) + 1):
        cut = [pa.record_batch({"k": pa.array(keys[i : i + n], pa.int64())}) for i in range(0, len(keys), n)]
        got = [b.column("k").to_pylist() for b in whole(iter(cut), "k")]
        assert [k for b in got for k in b] == keys and all(set(a).isdisjoint(b) for a, b in zip(got, got[1:], strict=False))


def test_rows_are_read_as_plain_texts():
    assert printed.row_of("Bolt 3 KG 1.00 5.00 15.00 THB") == ("Bolt", "3", "KG", "5.00", "15.00")
    assert printed.row_of("Bolt  12KG 3 5.00 15.00") == ("Bolt 12", "3", "KG", "5.00", "15.00") and printed.row_of("Bolt 5.00 15.00") is None


def test_a_whole_answer_is_parsed_once(monkeypatch):
    monkeypatch.setattr(printed, "_TOKENS", None)  # which only answers that are cut off need
    assert printed.recovered('```json\n{"a": "}{"} {"b": 1}\n```') == '{"a": "}{"}'


def test_a_new_document_asks_the_state_for_no_request():
    class State(dict):
        asked = 0

        def containsKey(self, key):  # noqa: N802
            self.asked += 1
            return key in self

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

    state = State()
    seen = Requests(state)
    for known in (False, True):
        seen.begin(known)
        assert ("a" in seen) == known
        seen.add("a")
        assert "a" in seen and "b" not in seen
        seen.end()
        assert state == {("a",): (True,)} and state.asked == 2 * known
