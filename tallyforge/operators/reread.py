"""A document's own numbers as one more reader (E-07, E-08, E-09), before it is normalised.

All work on documents of document.EXTRACTION, a row a document, without a shuffle. Agreement and
confidence are only ever raised; a text changes in two cases, for one that is printed elsewhere on the
document: a grand total that closes the sum, and a purchase order that is the only one in the item rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge import config
from tallyforge.functions import normalize as N
from tallyforge.functions import printed
from tallyforge.functions.normalize import let
from tallyforge.operators.document import with_cell

CENT = "0.01"
RAW = "struct<raw: string, confidence: double, agreement: boolean, null_reason: string>"
MONEY = "decimal(28,4)"


def text_of(cells: Column, name: str) -> Column:
    return F.nullif(F.try_element_at(cells, F.lit(name))["raw"], F.lit(""))


def number_of(cells: Column, name: str) -> Column:
    return printed.single_amount(text_of(cells, name)).cast(MONEY)


def within(a: Column, b: Column, limit: str = CENT) -> Column:
    return F.coalesce(F.abs(a - b) <= F.lit(limit).cast("decimal(10,2)"), F.lit(False))


def cell(raw: Column, confidence: Column) -> Column:
    return F.struct(raw.alias("raw"), confidence.cast("double").alias("confidence"), F.lit(True).alias("agreement"), F.lit(None).cast("string").alias("null_reason")).cast(RAW)


def raised(cells: Column, when: dict[str, tuple[Column, float]]) -> Column:
    """The map with the agreement of named cells set, and their confidence at least so much, where a condition holds and they have a text but no agreement."""

    def each(name: Column, c: Column) -> Column:
        out = F
        for n, (cond, least) in when.items():
            sure = F.greatest(F.coalesce(c["confidence"], F.lit(0.0)), F.lit(least))
            out = out.when((name == n) & cond, cell(c["raw"], sure))
        return F.when(F.coalesce(c["agreement"], F.lit(False)) | (F.coalesce(c["raw"], F.lit("")) == ""), c).otherwise(out.otherwise(c))

    return F.transform_values(cells, each)


def by_own_numbers(extracted: DataFrame) -> DataFrame:
    """E-07: a row whose quantity times price is its amount to the cent agrees with itself; so does a unit of the standard's, and totals that close with all rows."""
    known = sorted({u.upper().rstrip(".") for group, members in config.UOM_V66.items() for u in (group, *members)})

    def row(line: Column) -> Column:
        cells = line["cells"]
        numbers = F.struct(*(number_of(cells, n).alias(n) for n in ("qty", "unit_price", "amount")))

        def judged(x: Column) -> Column:
            closes = within(x["qty"] * x["unit_price"], x["amount"])
            unit = F.coalesce(F.array_contains(F.array(*map(F.lit, known)), F.regexp_replace(F.upper(F.trim(text_of(cells, "uom"))), r"\.+$", "")), F.lit(False))
            return F.struct(line["line_no"].alias("line_no"), raised(cells, {n: (closes, 0.95) for n in ("qty", "unit_price", "amount")} | {"uom": (unit, 0.9)}).alias("cells"))

        return let(numbers, judged)

    amounts = F.transform(F.coalesce("lines", F.array()), lambda line: number_of(line["cells"], "amount"))
    total = F.aggregate(amounts, F.lit(0).cast(MONEY), lambda a, b: (a + b).cast(MONEY))  # null if one can't be read
    f = F.col("fields")
    numbers = F.struct(number_of(f, "sub_total").alias("sub"), number_of(f, "vat").alias("vat"), number_of(f, "grand_total").alias("grand"), total.alias("lines"))
    taxed = lambda x: within(x["sub"] * F.lit(config.VAT_PERCENT).cast("decimal(4,0)") / 100, x["vat"], "1.00")
    # rows none of which, or not all of which, can be read say nothing against the totals
    closes = lambda x: within(x["sub"] + x["vat"], x["grand"]) & taxed(x) & ((F.size(F.coalesce("lines", F.array())) == 0) | x["lines"].isNull() | within(x["lines"], x["sub"]))
    fields = let(numbers, lambda x: raised(f, {n: (closes(x), 0.95) for n in ("sub_total", "vat", "grand_total")}))
    return extracted.withColumns({"fields": fields, "lines": F.transform("lines", row)})


def confirmed(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each cell whose agreement by_own_numbers() sets where it was false: key, line_no (0 for fields), name, confidence."""
    both = by_own_numbers(extracted.withColumns({"own_fields": F.col("fields"), "own_lines": F.col("lines")}))

    def changed(line: Column, before: Column, after: Column) -> Column:
        # cells that are as they were are left out before their line and name are put to them
        new = F.map_filter(after, lambda name, c: c["agreement"] & ~F.try_element_at(before, name)["agreement"])
        return F.transform(F.map_entries(new), lambda e: F.struct(line.alias("line_no"), e["key"].alias("name"), e["value"]["confidence"].alias("confidence")))

    of_lines = F.zip_with("own_lines", "lines", lambda a, b: F.coalesce(changed(b["line_no"], a["cells"], b["cells"]), F.array()))
    every = F.concat(F.coalesce(changed(F.lit(0), F.col("own_fields"), F.col("fields")), F.array()), F.coalesce(F.flatten(of_lines), F.array()))
    return both.select(key, F.inline(every))


def closing_total(extracted: DataFrame, candidates: str) -> DataFrame:
    """E-08: where sub-total and tax don't give the grand total, the first printed amount that they do give. candidates: column, array of struct(page, text) of what is labelled as a grand total."""
    f = F.col("fields")
    sub, vat, grand = (number_of(f, n) for n in ("sub_total", "vat", "grand_total"))
    amounts = lambda c: F.regexp_extract_all(N.arabic(c["text"]), F.lit(rf"(?<![\d.,])({printed.AMOUNT})(?!\d)"), F.lit(1))
    every = F.flatten(F.transform(F.array_sort(F.coalesce(candidates, F.array().cast("array<struct<page: int, text: string>>"))), amounts))
    open_ = (sub + vat).isNotNull() & ~within(sub + vat, grand)
    found = F.get(F.filter(every, lambda a: within(printed.plain_number(a), sub + vat)), F.lit(0))
    return extracted.withColumn("printed_total", F.when(open_, found)).withColumn("fields", F.when(F.col("printed_total").isNotNull(), with_cell(f, "grand_total", cell(F.col("printed_total"), F.lit(0.95)))).otherwise(f))


def order_from_rows(extracted: DataFrame) -> DataFrame:
    """E-09: a purchase order that hasn't the shape of one is replaced by the only one that item rows print (column derived_po), read once, so that it doesn't agree with another reading."""
    f = F.col("fields")
    shaped = F.coalesce(N.shape_ok("po_number", text_of(f, "po_number")), F.lit(False))
    of = lambda line: N.po_tokens(text_of(line["cells"], "item_code"), text_of(line["cells"], "description"))
    tokens = F.array_distinct(F.flatten(F.transform(F.coalesce("lines", F.array()), of)))
    only = let(tokens, lambda t: F.when(F.size(t) == 1, F.get(t, F.lit(0))))
    made = F.struct(F.col("derived_po").alias("raw"), F.lit(0.9).alias("confidence"), F.lit(False).alias("agreement"), F.lit(None).cast("string").alias("null_reason")).cast(RAW)
    return extracted.withColumn("derived_po", F.when(~shaped, only)).withColumn("fields", F.when(F.col("derived_po").isNotNull(), with_cell(f, "po_number", made)).otherwise(f))
