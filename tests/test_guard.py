"""Statements that the guard passes on, word for word but for comments, and those that it refuses."""

import pytest

from tallyforge.sources import guard

READ = {
    "select 1": "select 1",
    "select '--' as a, b from t;": "select '--' as a, b from t",
    "select '/* x */' -- remark\n from t": "select '/* x */'  \n from t",
    "with x as (select 'insert; drop') select * from x /* delete */": "with x as (select 'insert; drop') select * from x",
    "select `update` from t where a = 'it''s' and b = 'c\\'d'": "select `update` from t where a = 'it''s' and b = 'c\\'d'",
    'select "set; x" from t': 'select "set; x" from t',
}
REFUSED = [
    "with x as (select '\\'') insert into t select ' a'", "select 1; drop table t", "insert into t values (1)", "select * from t for update", "with x as (select 1) merge into t using x on true when matched then delete",
    "select 'open", "select /* open", "select 1 */", "select r'\\' , 'x'", "", "-- nothing", "select 1 from `t", "explain select 1",
]


@pytest.mark.parametrize("sql", READ)
def test_reading_statements_pass(sql):
    assert guard.read_only(sql) == READ[sql]


@pytest.mark.parametrize("sql", REFUSED)
def test_others_are_refused(sql):
    with pytest.raises(guard.Refused):
        guard.read_only(sql)


def test_values_have_their_shapes():
    assert guard.checked("po", "40118928") == "40118928" and guard.checked("invoice", "INV/12-a.b_c") == "INV/12-a.b_c"
    for kind, value in (("po", "4011892"), ("tax", "12"), ("invoice", "a b"), ("invoice", ""), ("po", "40118928\n")):
        with pytest.raises(guard.Refused):
            guard.checked(kind, value)
