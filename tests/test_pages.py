"""What is read on pages against plain folds and searches."""

import difflib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import normalize as N
from tallyforge.functions import printed
from tallyforge.operators import pages


def one(spark, make, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_printed_rows(spark):
    got = one(spark, printed.row_cells, "Bolt M8 10 PCS 5.00 50.00", "Bolt กล่อง 10 5.00 50.00 บาท", "A 2 KG 1.00 5.00 10.00", "A 2 KG 5.00 1.00 10.00", "A 2 KG 5.00 0.00 9.00", "A 2 KG 5.00 3.00 9.00", "x10 PC 1.00 10.00", "no numbers", None, "", "1,000.5 PC 1.00 1,000.50", "PC 5.00 10.00 50.00", "A 5 9x 1.00 5.00")
    as_ = lambda r: None if r is None else tuple(r)
    assert [as_(r) for r in got] == [
        ("Bolt M8", "10", "PCS", "5.00", "50.00"), ("Bolt", "10", "กล่อง", "5.00", "50.00"), ("A", "2", "KG", "5.00", "10.00"), ("A", "2", "KG", "5.00", "10.00"), ("A", "2", "KG", "5.00", "9.00"), ("A", "2", "KG", "3.00", "9.00"), ("x", "10", "PC", "1.00", "10.00"),
        None, None, None, (None, "1,000.5", "PC", "1.00", "1,000.50"), (None, "5.00", "PC", "10.00", "50.00"), None,
    ]


def test_closing_order_equals_a_plain_search(spark):
    rng = random.Random(1)
    rows = [sorted((a, b, a * b), key=lambda _: rng.random()) for a, b in [(rng.randint(1, 9), rng.randint(1, 9)) for _ in range(60)]] + [[rng.randint(1, 50) for _ in range(3)] for _ in range(60)] + [[1, 1, 1], [0, 0, 5], [2, 2, 4]]
    df = spark.createDataFrame([(i, [Decimal(v) for v in r]) for i, r in enumerate(rows)], "i int, n array<decimal(18,4)>")
    got = [r[0] and tuple(int(v) for v in r[0]) for r in df.orderBy("i").select(printed.closing_order(F.col("n"))).collect()]
    want = []
    for r in rows:
        found = {(r[i], r[j], r[k]) for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 2, 0)) if r[i] * r[j] == r[k]}
        want.append(found.pop() if len(found) == 1 else None)
    assert got == want


def test_amounts_labels_and_fragments(spark):
    assert one(spark, printed.single_amount, "596.40 THB", "๕๐.๕", "1 2", "", None) == [Decimal("596.4"), Decimal("50.5"), None, None, None]
    assert one(spark, printed.without_label, "SOLD TO บริษัท ก จำกัด", "ABC CO.LTD บริษัท ก", "บริษัท ก", "nothing", None) == ["บริษัท ก จำกัด", "ABC CO.LTD บริษัท ก", "บริษัท ก", "nothing", None]
    assert one(spark, printed.unreliable, "บ ร ษั ท", "บริษัท จำกัด", "", None) == [True, False, False, False]
    assert one(spark, lambda c: printed.money_string(c.cast("decimal(18,4)")), "5", "0.125", "1234.5", None) == ["5.00", "0.125", "1234.50", None]


def members_of(text):
    """All that a prefix of JSON holds completely, by trying every cut and every way of closing it."""
    for end in range(len(text), 0, -1):
        for close in ("", "}", "]}", "}]}", "}}"):
            try:
                return json.loads(text[:end].rstrip(", ") + close)
            except ValueError:
                continue
    return None


def test_every_prefix_of_an_answer_gives_its_complete_members():
    whole = {"a": [1, {"b": 'x}"y\\'}, {"c": 2, "é": "ü"}], "d": "e,]", "f": {"g": 1}}
    text = json.dumps(whole, ensure_ascii=False)
    assert json.loads(printed.recovered("<think>{no}</think>```json\n" + text + "\n``` {}")) == whole
    objects = {}
    for n in range(len(text)):
        got = printed.recovered(text[:n])
        if text[:n].count("}") and n > text.index('"}') + 1:
            objects[n] = json.loads(got)
        rich = printed.recovered(text[:n], members=True)
        if rich is not None:
            assert all(k in whole for k in json.loads(rich))
    assert objects[text.index('"c"')] == {"a": [1, {"b": 'x}"y\\'}]}
    assert objects[text.index('"d"')] == {"a": whole["a"]} and objects[len(text) - 1] == whole
    assert json.loads(printed.recovered(text[: text.index('"f"')], members=True)) == {"a": whole["a"], "d": "e,]"}
    assert printed.recovered(text[:4]) is None and printed.recovered(None) is None and printed.recovered("none") is None


def test_recovery_over_a_column(spark):
    assert one(spark, printed.recovered_json, '{"a": [{"b": 1}, {"c"', None, "x") == ['{"a": [{"b": 1}]}', None, None]


# --- folds -----------------------------------------------------------------------------------------


def plain_merge(rows):
    kept, out = [], []
    for r in rows:
        same = lambda a, b: (lambda both: bool(both) and all(x == y for x, y in both))([(a[f"key_{n}"], b[f"key_{n}"]) for n in pages.NUMBERS if a[n] and b[n]])
        box = lambda a: (a["x"], a["y"], a["w"], a["h"])
        into = next((k for k in kept if k["w"] is not None and r["w"] is not None and same(k, r) and pages.shared_area(box(k), box(r)) >= 0.5), None)
        if into is None:
            kept.append(dict(r) | {"merged_into": None})
            continue
        out.append(r | {"merged_into": into["row_no"]})
        for n in (*pages.NUMBERS, "uom", "description"):
            if r[n] and (not into[n] or (n == "description" and len(r[n]) > len(into[n]))):
                into[n] = r[n]
                if n in pages.NUMBERS:
                    into[f"key_{n}"] = r[f"key_{n}"]
        x, y, right, below = min(into["x"], r["x"]), min(into["y"], r["y"]), max(into["x"] + into["w"], r["x"] + r["w"]), max(into["y"] + into["h"], r["y"] + r["h"])
        into |= {"x": x, "y": y, "w": right - x, "h": below - y}
    return out + kept


@pytest.mark.parametrize("n", [400, 5000])
def test_merged_rows_equal_a_plain_fold(spark, n):
    rng = random.Random(n)
    shape = "page long, row_no long, x double, y double, w double, h double, description string, uom string, qty string, unit_price string, amount string"
    rows = []
    for i in range(n):
        has = rng.random() > 0.02
        box = (rng.random() * 0.5, rng.random() * 0.95, 0.2 + rng.random() * 0.2, 0.01 + rng.random() * 0.03) if has else (None,) * 4
        rows.append((1 if n > 1000 else i % 3, i, *box, f"row {i % 7}" * rng.randint(0, 2) or None, rng.choice(["PC", None]), rng.choice(["1", "2", None]), rng.choice(["1,000.00", "1000.00", None]), rng.choice(["5.00", None])))
    df = spark.createDataFrame(rows, shape).withColumns({f"key_{c}": N.reading_key(F.col(c)) for c in pages.NUMBERS})
    names = [f.strip().split()[0] for f in pages.ROW.split(",")]
    by_page: dict = {}
    for r in df.orderBy("row_no").collect():
        by_page.setdefault(r["page"], []).append(r.asDict())
    want = sorted((tuple(r[c] for c in names) for rs in by_page.values() for r in plain_merge(rs)), key=str)
    assert sorted((tuple(r) for r in pages.merged_rows(df).select(*names).collect()), key=str) == want
    assert len(want) == n and any(r[2] is not None for r in want)


def plain_copies(rows):
    out, kept = [], []
    for d, p, kind, number, amounts in sorted(rows, key=lambda r: (r[0], r[1])):
        alike = lambda k, number=number: k[3] == number or (len(number) >= 6 and difflib.SequenceMatcher(None, number, k[3]).ratio() >= 0.85)
        first = next((k for k in kept if k[0] == d and k[4] == amounts and number and amounts and k[3] and alike(k) and (k[2] == kind or len(amounts) >= 2)), None)
        if first is None:
            kept.append((d, p, kind, number, amounts))
        out.append((d, p, first and first[1]))
    return sorted(out, key=str)


def test_copies_equal_a_plain_fold(spark):
    a, b, c = "ABCDEFGHIJ", "ABCDEFGHIX", "ABCDEFGHYX"  # a ~ b ~ c, and a is not like c
    rows = [(1, 1, "i", a, ["5"]), (1, 2, "i", b, ["5"]), (1, 3, "i", c, ["5"]), (1, 4, "i", c, ["5"]), (2, 1, "i", "N1", ["5"]), (2, 2, "d", "N1", ["5"]), (2, 3, "d", "N1", ["5", "6"]), (2, 4, "i", "N1", ["5", "6"]), (3, 1, "i", None, ["5"]), (3, 2, "i", None, ["5"]), (3, 3, "i", "N1", []), (3, 4, "i", "N1", []), (4, 1, "i", "NUM12", ["1"]), (4, 2, "i", "NUM1Z", ["1"])]
    rng = random.Random(3)
    rows += [(9, i, rng.choice("id"), "".join(rng.choice("AB") for _ in range(6)), rng.choice([["1"], ["1", "2"]])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, page long, page_type string, number string, amounts array<string>")
    assert sorted((tuple(r) for r in pages.copies(df).collect()), key=str) == plain_copies(rows)
    assert (1, 3, None) in plain_copies(rows) and (1, 4, 3) in plain_copies(rows)


def test_reading_order_does_not_depend_on_where_the_page_lies(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.randint(0, 400), 10 * (i // 8) + rng.randint(0, 4), 20, 5) for i in range(80)]
    order = lambda shift: [r[0] for r in pages.reading_order(spark.createDataFrame([(p, i, x, y + shift, w, h) for p, i, x, y, w, h in rows], "page long, word_id long, x long, y long, w long, h long")).orderBy("line_no", "place").select("word_id").collect()]
    assert order(0) == order(3) == order(7)
    assert order(0) == [r[1] for r in sorted(rows, key=lambda r: (r[1] // 8, r[2], r[3], r[1]))]
