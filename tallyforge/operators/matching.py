"""Pairing of bill lines with receipt lines (J-14..J-20).

Tolerance joins are always keyed by document, never across. Order-dependent assignment (a line that
is paired takes its receipt line away from later ones) folds over one document's rows at a time; a document has at most a few thousand lines, and its candidate pairs are made inside.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import config
from tallyforge.functions import normalize as N
from tallyforge.operators import ordered

PAIR_SCHEMA = "doc_id long, line_no long, rcv_line long, lot long, step int"
PAIR_NAMES = ["doc_id", "line_no", "rcv_line", "lot", "step"]
PAIR_TYPES = [pa.int64()] * 4 + [pa.int32()]
LADDER_NAMES = ["doc_id", "side", "no", "lot", "text", "qty", "price_c", "amount_c", "total_c", "number"]


def price_pairs(lines: DataFrame, active: DataFrame) -> DataFrame:
    """Candidate pairs of equal price and unit group within a document."""
    left = lines.select("doc_id", "line_no", "price_c", N.v66_uom_group(F.col("uom")).alias("unit"))
    right = active.select("doc_id", "rcv_line", "lot", F.col("rcv_price_c").alias("price_c"), N.v66_uom_group(F.col("rcv_uom")).alias("unit"))
    return left.join(right, ["doc_id", "price_c", "unit"])


def mutually_unique(lines: DataFrame, active: DataFrame) -> DataFrame:
    """J-14 in one pass: pairs whose line has no other candidate and whose receipt line has no other line of its price."""
    rival = lines.groupBy("doc_id", "price_c").agg(F.count("*").alias("n_price"))
    of_line = F.count("*").over(Window.partitionBy("doc_id", "line_no"))
    pairs = price_pairs(lines, active).withColumn("n_line", of_line)
    return pairs.where("n_line = 1").join(rival, ["doc_id", "price_c"]).where("n_price = 1").select("doc_id", "line_no", "rcv_line", "lot")


def folded(lines: DataFrame, active: DataFrame, fold: Callable[[list[dict], list[dict]], Iterable[tuple]]) -> DataFrame:
    """The pairs that fold(bill lines, receipt lines) gives for each document, both in order; a task holds one document at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PAIR_TYPES, strict=True)], names=PAIR_NAMES)

        for doc, group in groupby(rows(batches), key=lambda r: r["doc_id"]):
            sides: tuple[list[dict], list[dict]] = ([], [])
            for r in group:
                sides[r["side"]].append(r)
            out += [(doc, *pair) for pair in fold(*sides)]
            if len(out) >= 10_000:
                yield made()
                out = []
        yield made()

    both = lines.withColumn("side", F.lit(0)).unionByName(active.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition("doc_id").sortWithinPartitions("doc_id", "side", "line_no", "rcv_line", "lot").mapInArrow(run, PAIR_SCHEMA)


def ordered_m1(lines: DataFrame, active: DataFrame) -> DataFrame:
    """J-14 exactly: lines in order, each taking its one candidate away; a line isn't looked at twice."""

    def fold(bills: list[dict], receipts: list[dict]) -> Iterator[tuple]:
        waiting = Counter(b["price_c"] for b in bills)
        free: dict[int, list[dict]] = defaultdict(list)
        for r in receipts:
            free[r["rcv_price_c"]].append(r)
        for b in bills:
            mine = [r for r in free[b["price_c"]] if b["unit"] is None or r["unit"] == b["unit"]]
            if len(mine) == 1 and waiting[b["price_c"]] == 1:
                yield b["line_no"], mine[0]["rcv_line"], mine[0]["lot"], 1
                free[b["price_c"]].remove(mine[0])
                waiting[b["price_c"]] -= 1

    a = lines.select("doc_id", "line_no", "price_c", N.v66_uom_group(F.col("uom")).alias("unit"))
    b = active.select("doc_id", "rcv_line", "lot", "rcv_price_c", N.v66_uom_group(F.col("rcv_uom")).alias("unit"))
    return folded(a, b, fold)


def exact_values(lines: DataFrame, active: DataFrame) -> DataFrame:
    """J-15: price, quantity, amount and unit are equal, and the pair is unique both ways, after the item code has narrowed ties."""
    right = active.select("doc_id", "rcv_line", "lot", F.col("item").alias("rcv_item"), F.col("rcv_price_c").alias("price_c"), F.col("rcv_qty").alias("qty"), F.col("rcv_amount_c").alias("amount_c"), N.v66_uom_group(F.col("rcv_uom")).alias("unit"))
    left = lines.select("doc_id", "line_no", "item", "price_c", "qty", "amount_c", N.v66_uom_group(F.col("uom")).alias("unit"))
    pairs = left.join(right, ["doc_id", "price_c", "qty", "amount_c", "unit"])
    same = (F.col("item") == F.col("rcv_item")).cast("int")
    best = pairs.withColumn("same", same).withColumn("top", F.max("same").over(Window.partitionBy("doc_id", "line_no"))).where("same = top")
    n_line, n_rcv = F.count("*").over(Window.partitionBy("doc_id", "line_no")), F.count("*").over(Window.partitionBy("doc_id", "rcv_line", "lot"))
    return best.withColumn("a", n_line).withColumn("b", n_rcv).where("a = 1 and b = 1").select("doc_id", "line_no", "rcv_line", "lot")


def unmatched_lines(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """J-17, T-05."""
    return lines.join(pairs, ["doc_id", "line_no"], "left_anti").select("doc_id", "line_no")


def unmatched_receipts(active: DataFrame, pairs: DataFrame) -> DataFrame:
    return active.join(pairs, ["doc_id", "rcv_line", "lot"], "left_anti").select("doc_id", "rcv_line", "lot")


def ladder(lines: DataFrame, active: DataFrame) -> DataFrame:
    """J-18: eight steps from strict to loose; in each, lines in order take the best free receipt line.

    lines: doc_id, line_no, description, qty, price_c, amount_c, sub_total_c; active: doc_id, rcv_line,
    lot, item_no, item_text, rcv_qty, rcv_price_c, rcv_amount_c. A step is a test of a pair and a
    score; of equal scores the first receipt line in order wins. Lines that find none free share the
    first one. J-19: a description that holds a receipt line's item number scores 20, each longer word of its text 2.
    """
    NO, LOT, TEXT, QTY, PRICE, AMOUNT, TOTAL, NUMBER = range(8)  # a row's places; of a receipt line, text holds the longer words

    def fold(bills: list[tuple], receipts: list[tuple]) -> Iterator[tuple]:
        scores: dict[tuple[int, int], int] = {}  # of pairs that a step has asked for

        def score(n: int, i: int) -> int:
            if (n, i) not in scores:
                text, r = bills[n][TEXT], receipts[i]
                scores[n, i] = (20 if r[NUMBER] and r[NUMBER] in text else 0) + 2 * sum(word in text for word in r[TEXT].split())
            return scores[n, i]

        def equal_all(b: tuple) -> list[int]:
            return [i for i in free if receipts[i][PRICE] == b[PRICE] and receipts[i][QTY] == b[QTY]]

        def near_price(b: tuple) -> list[int]:
            def near(p: int) -> bool:
                return p > 0 and abs(b[PRICE] - p) * 100 <= p and abs(b[PRICE] - p) <= config.PRICE_LIMIT_C

            return [i for i in free if receipts[i][QTY] == b[QTY] and near(receipts[i][PRICE])]

        def equal_amount(b: tuple) -> list[int]:
            total = bills[0][TOTAL]
            if total is None or total <= 0 or abs(total - received) > 100:
                return []
            mine = b[AMOUNT] if b[AMOUNT] > 0 else b[PRICE] * b[QTY]
            return [i for i in free if abs(mine - receipts[i][AMOUNT]) <= 100]

        steps: tuple[tuple[Callable, Callable], ...] = (
            (lambda n, b: equal_all(b), score),
            (lambda n, b: near_price(b), score),
            (lambda n, b: equal_amount(b), score),
            (lambda n, b: [i for i in free if receipts[i][NUMBER] and receipts[i][NUMBER] in b[TEXT]], lambda n, i: -abs(bills[n][PRICE] - receipts[i][PRICE])),
            (lambda n, b: [i for i in free if receipts[i][PRICE] == b[PRICE]], score),
            (lambda n, b: [i for i in free if score(n, i) > 0], score),
            (lambda n, b: [i for i in free if receipts[i][NO] == b[NO]], lambda n, i: 0),
            (lambda n, b: free, lambda n, i: 0),
        )
        free, open_lines, received = list(range(len(receipts))), list(range(len(bills))), None
        for number, (fitting, worth) in enumerate(steps, 1):
            if not open_lines:
                return
            if number == 3:
                received = sum(r[AMOUNT] for r in receipts)
            rest = []
            for n in open_lines:
                b = bills[n]
                fits = fitting(n, b)
                if fits:
                    best = fits[0] if len(fits) == 1 else max(fits, key=lambda i, n=n, worth=worth: (worth(n, i), -i))
                    free.remove(best)
                    yield b[NO], receipts[best][NO], receipts[best][LOT], number
                elif number == len(steps) and receipts:
                    yield b[NO], receipts[0][NO], receipts[0][LOT], number
                else:
                    rest.append(n)
            open_lines = rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ordered.whole(batches, "doc_id"):
            docs, sides, *cells = (ordered.values(batch.column(c)) for c in LADDER_NAMES)
            rows, out, at = list(zip(*cells, strict=True)), [], 0
            for doc, n in Counter(docs).items():  # rows are in order
                split = bisect(sides, 0, at, at + n)
                out += [(doc, *pair) for pair in fold(rows[at:split], rows[split : at + n])]
                at += n
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PAIR_TYPES, strict=True)], names=PAIR_NAMES)

    none = F.lit("")
    words = F.array_join(N.long_words(F.upper("item_text")), " ")
    bill = [F.lit(0), F.col("line_no"), F.lit(0).cast("long"), F.upper(F.coalesce("description", none)), F.col("qty"), F.col("price_c"), F.col("amount_c"), F.col("sub_total_c"), none]
    receipt = [F.lit(1), F.col("rcv_line"), F.col("lot"), words, F.col("rcv_qty"), F.col("rcv_price_c"), F.col("rcv_amount_c"), F.lit(0).cast("long"), F.coalesce(F.upper(F.trim("item_no")), none)]
    cells = lambda df, columns: df.select("doc_id", *(c.alias(n) for c, n in zip(columns, LADDER_NAMES[1:], strict=True)))
    both = cells(lines, bill).unionByName(cells(active, receipt))
    return both.repartition("doc_id").sortWithinPartitions("doc_id", "side", "no", "lot").mapInArrow(run, PAIR_SCHEMA)


def proposals(lines: DataFrame, receipts: DataFrame, least: float = 0.34) -> DataFrame:
    """J-20, U-06: for each line (text) the receipt item of its document with the most alike words, by Jaccard similarity of word sets."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    a = lines.select("doc_id", "line_no", words("text").alias("a"))
    b = receipts.select("doc_id", "rcv_line", words("item_text").alias("b"))
    alike = F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))), F.lit(0.0))
    best = F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy(F.desc("similarity"), "rcv_line"))
    return a.join(b, "doc_id").withColumn("similarity", alike).where(F.col("similarity") >= least).withColumn("place", best).where("place = 1").select("doc_id", "line_no", "rcv_line", "similarity")


def guarded(proposed: DataFrame, lines: DataFrame, active: DataFrame) -> DataFrame:
    """J-16: proposals (doc_id, place, line_no, rcv_line, level) with the reason for refusing each, or null: unknown lines, lines used before, levels that aren't known."""
    known = proposed.join(lines.select("doc_id", "line_no", F.lit(True).alias("has_line")).distinct(), ["doc_id", "line_no"], "left").join(active.select("doc_id", "rcv_line", F.lit(True).alias("has_rcv")).distinct(), ["doc_id", "rcv_line"], "left")
    again = (F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy("place")) > 1) | (F.row_number().over(Window.partitionBy("doc_id", "rcv_line").orderBy("place")) > 1)
    reason = F.when(F.col("line_no").isNull() | F.col("rcv_line").isNull(), "empty_group").when(F.col("has_line").isNull() | F.col("has_rcv").isNull() | again, "unknown_or_reused_line").when(~F.col("level").isin("M3", "M4", "M5"), "invalid_level")
    return known.select("doc_id", "place", "line_no", "rcv_line", "level", reason.alias("refused"))


def narrowed(header: DataFrame, active: DataFrame) -> DataFrame:
    """G-07: of a document's receipts those with its header key, else the one whose total is the sub-total, else the one with quantity that is still to be billed; else none.

    header: doc_id, sub_total_c, invoice_num; active: doc_id, receipt_num, header_key (the invoice number that the receipt carries, or null), rcv_amount_c, rcv_qty, billed_qty.
    """
    own = header.select("doc_id", "sub_total_c", N.letters_key(F.col("invoice_num")).alias("own_key"))
    per = active.join(own, "doc_id").groupBy("doc_id", "receipt_num", "sub_total_c").agg(
        F.sum("rcv_amount_c").alias("total_c"), F.bool_or(F.coalesce(F.col("billed_qty"), F.lit(0)) < F.col("rcv_qty")).alias("unbilled"), F.bool_or(F.coalesce(N.letters_key(F.col("header_key")) == F.col("own_key"), F.lit(False))).alias("keyed"))
    of = Window.partitionBy("doc_id")
    n = lambda cond: F.count_if(cond).over(of)
    total = F.coalesce(F.col("total_c") == F.col("sub_total_c"), F.lit(False))
    several = per.withColumn("receipts", F.count("*").over(of)).withColumn("n_key", n(F.col("keyed"))).withColumn("n_total", n(total)).withColumn("n_open", n(F.col("unbilled"))).where("receipts > 1")
    rule = F.when(F.col("n_key") > 0, "key").when(F.col("n_total") == 1, "total").when(F.col("n_open") == 1, "unbilled").otherwise("ambiguous")
    stays = F.when(F.col("n_key") > 0, F.col("keyed")).when(F.col("n_total") == 1, total).when(F.col("n_open") == 1, F.col("unbilled")).otherwise(False)
    return several.select("doc_id", "receipt_num", rule.alias("narrowed_by"), stays.alias("stays"))
