"""Order-dependent pairing against a plain version, pair by pair."""

import random

from tallyforge.operators import matching

LINES = "doc_id long, line_no long, price_c long, uom string"
ACTIVE = "doc_id long, rcv_line long, lot long, rcv_price_c long, rcv_uom string"


def plain_m1(lines, active):
    out = set()
    for doc in {x[0] for x in lines}:
        open_lines = {x[1]: (x[2], x[3]) for x in sorted(lines) if x[0] == doc}
        free = [x[1:] for x in sorted(active) if x[0] == doc]
        for n in sorted(open_lines):
            price, unit = open_lines[n]
            mine = [f for f in free if f[2] == price and (unit is None or f[3] == unit)]
            if len(mine) == 1 and all(p != price for m, (p, _) in open_lines.items() if m != n):
                out.add((doc, n, mine[0][0], mine[0][1], 1))
                free.remove(mine[0])
                del open_lines[n]
                open_lines = dict(open_lines)
    return out


def test_ordered_m1(spark):
    rng = random.Random(3)
    lines = [(d, n, rng.choice([100, 200, 300, 400, 500]), rng.choice(["PC", "KG", None])) for d in range(40) for n in range(1, rng.randint(2, 6))]
    active = [(d, n, 0, rng.choice([100, 200, 300, 400, 500]), rng.choice(["PC", "KG"])) for d in range(40) for n in range(1, rng.randint(2, 6))]
    named = [(*x[:3], {"PC": "PCS"}.get(x[3], x[3])) for x in lines], [(*x[:4], {"PC": "PCS"}.get(x[4], x[4])) for x in active]
    found = matching.ordered_m1(spark.createDataFrame(lines, LINES), spark.createDataFrame(active, ACTIVE))
    assert {tuple(r) for r in found.collect()} == plain_m1(*named)
    assert matching.ordered_m1(spark.createDataFrame([], LINES), spark.createDataFrame([], ACTIVE)).collect() == []


def test_ladder_uses_each_receipt_line_once_and_falls_back(spark):
    bills = spark.createDataFrame([(1, 1, "bolt ITEM-7", 5, 100, 500, 900), (1, 2, "nut", 4, 100, 400, 900), (1, 3, "washer", 1, 7, 7, 900)], "doc_id long, line_no long, description string, qty long, price_c long, amount_c long, sub_total_c long")
    receipts = spark.createDataFrame([(1, 1, 0, "ITEM-7", "steel bolt", 5, 100, 500), (1, 2, 0, "ITEM-8", "steel nut", 4, 101, 404)], "doc_id long, rcv_line long, lot long, item_no string, item_text string, rcv_qty long, rcv_price_c long, rcv_amount_c long")
    found = {r["line_no"]: (r["rcv_line"], r["step"]) for r in matching.ladder(bills, receipts).collect()}
    assert found == {1: (1, 1), 2: (2, 2), 3: (1, 8)}
