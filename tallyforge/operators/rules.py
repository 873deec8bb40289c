"""Document-local and line-level validation rules (P-*, R-*, G-03..G-06) as column expressions.

Each rule is computed for all documents at once and gives result, code and severity; a finding of low
severity leaves the result at pass. Line rules aggregate lines to documents by a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge import config


def outcome(rule: str, code: Column, severity: Column, result: Column | None = None) -> list[Column]:
    """rule_id, result, code, severity: pass unless a code of more than low severity is set."""
    failed = code.isNotNull() & (severity != "Low")
    return [F.lit(rule).alias("rule_id"), (result if result is not None else F.when(failed, "fail").otherwise("pass")).alias("result"), code.alias("code"), F.when(code.isNotNull(), severity).alias("severity")]


def v01_required(header: DataFrame, profile: str = "v66") -> DataFrame:
    """P-01, P-02: required fields of the profile, at least one line, all pages there; `missing` lists what isn't."""
    from tallyforge.operators import verdicts

    h = header.withColumn("missing", verdicts.missing_fields(profile))
    code = F.when(F.size("missing") > 0, config.CODES_V62["missing"] if profile == "v62" else config.CODES_V66["missing"])
    return h.select("doc_id", *outcome("V-01", code, F.lit("Medium")), F.array_join("missing", ",").alias("missing"))


def v02_line_math(header: DataFrame, lines: DataFrame, profile: str = "v66") -> DataFrame:
    """P-03, P-04: quantity times price is the amount, to within the tolerance, on every line (a gate)."""
    bad = lines.groupBy("doc_id").agg(F.count_if(F.abs(F.col("qty") * F.col("price_c") - F.col("amount_c")) > config.LINE_TOLERANCE_C).alias("bad"), F.count("*").alias("checked"))
    h = header.select("doc_id").join(bad, "doc_id", "left")
    code = F.when(F.col("bad") > 0, "E28" if profile == "v62" else "E02")
    result = F.when(F.col("checked").isNull(), "not_evaluated").when(F.col("bad") > 0, "fail").otherwise("pass")
    return h.select("doc_id", *outcome("V-02", code, F.lit("High"), result), F.coalesce("bad", F.lit(0)).alias("bad_lines"))


def half_even_percent(amount: Column, percent: int) -> Column:
    """percent of an amount in cents, ties to even."""
    n = amount * percent
    q, r = F.floor(n / 100), F.pmod(n, F.lit(100))
    return (q + F.when((r > 50) | ((r == 50) & (q % 2 != 0)), 1).otherwise(0)).cast("long")


def v03_totals(header: DataFrame, profile: str = "v66") -> DataFrame:
    """P-05, P-06: lines to sub-total, 7 % VAT, sub-total and VAT to grand total."""
    diffs = (
        (F.abs(F.col("lines_c") - F.col("sub_total_c")), config.TOTAL_TOLERANCE_C),
        (F.abs(half_even_percent(F.col("sub_total_c"), config.VAT_PERCENT) - F.col("vat_c")), config.VAT_TOLERANCE_C),
        (F.abs(F.col("sub_total_c") + F.col("vat_c") - F.col("grand_c")), config.TOTAL_TOLERANCE_C),
    )
    over = F.coalesce(diffs[0][0] > diffs[0][1], F.lit(False)) | F.coalesce(diffs[1][0] > diffs[1][1], F.lit(False)) | F.coalesce(diffs[2][0] > diffs[2][1], F.lit(False))
    within = F.coalesce(diffs[0][0] + diffs[1][0] + diffs[2][0] > 0, F.lit(False))
    high, low = ("E31", "E16") if profile == "v62" else ("E03", "E04")
    return header.select("doc_id", *outcome("V-03", F.when(over, high).when(within, low), F.when(over, "High").otherwise("Low")), *(d.alias(n) for (d, _), n in zip(diffs, ("diff_lines", "diff_vat", "diff_grand"), strict=True)))


def v04_receipts(header: DataFrame, active: DataFrame, profile: str = "v66", multi: bool = False) -> DataFrame:
    """G-05, G-06: exactly one receipt; none is E05/E17, several are E06/E35 unless the multi-receipt switch is on; a full page of rows is for a person."""
    n = active.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_distinct("receipt_num").alias("receipts"), F.count_distinct("supp").alias("suppliers"))
    h = header.select("doc_id").join(n, "doc_id", "left").na.fill(0, ["rows", "receipts", "suppliers"])
    none, several = ("E17", "E35") if profile == "v62" else ("E05", "E06")
    too_many = (F.col("receipts") > 1) & ~(F.lit(multi) & (F.col("suppliers") == 1))
    code = F.when(F.col("rows") == 0, none).when(too_many, several)
    result = F.when(code.isNotNull(), "fail").when(F.col("rows") >= config.ROW_CAP, "manual_review").otherwise("pass")
    return h.select("doc_id", *outcome("V-04", code, F.lit("High"), result), "rows", "receipts")


def v06_signatures(header: DataFrame, profile: str = "v66") -> DataFrame:
    """P-07, P-08."""
    code = F.when(~F.col("receiver") | ~F.col("deliverer"), "E26" if profile == "v62" else "E08")
    if profile == "v62":
        code = F.when(F.col("pages_complete"), code)
    return header.select("doc_id", *outcome("V-06", code, F.when(~F.col("receiver"), "High").otherwise("Medium")))


def price_class(bill_c: Column, receipt_c: Column) -> Column:
    """R-05: pass, within_tolerance or over_tolerance."""
    d = F.abs(bill_c - receipt_c)
    within = (receipt_c > 0) & (d * 100 <= receipt_c * config.PRICE_PERCENT) & (d <= config.PRICE_LIMIT_C)
    return F.when(d == 0, "pass").when(within, "within_tolerance").otherwise("over_tolerance")


def compared(lines: DataFrame, active: DataFrame) -> DataFrame:
    """Bill lines with the receipt lines that carry their key (J-28): quantities of several lots are summed, the first lot's price counts."""
    lots = active.groupBy("doc_id", F.col("rcv_line").alias("line_no")).agg(F.sum("rcv_qty").alias("rcv_qty"), F.min_by("rcv_price_c", "lot").alias("rcv_price_c"), F.min_by("rcv_uom", "lot").alias("rcv_uom"), F.sum("rcv_amount_c").alias("rcv_amount_c"), F.count("*").alias("lots"))
    return lines.join(lots, ["doc_id", "line_no"], "left")


def line_findings(pairs: DataFrame) -> DataFrame:
    """R-01..R-07: one row a finding of a line: no receipt E13, price E09/E12, unit E10 (then no price check), quantity E14/E15."""
    from tallyforge.functions import normalize as N

    same_unit = N.v66_uom_group(F.col("uom")) == N.v66_uom_group(F.col("rcv_uom"))
    price = price_class(F.col("price_c"), F.col("rcv_price_c"))
    there = F.col("rcv_qty").isNotNull()
    one = lambda cond, rule, code, severity: F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(
        one(~there, "V-07", "E13", "High"), one(there & ~same_unit, "V-07", "E10", "Medium"), one(there & same_unit & (price == "over_tolerance"), "V-07", "E09", "High"), one(there & same_unit & (price == "within_tolerance"), "V-07", "E12", "Medium"),
        one(there & (F.col("qty") > F.col("rcv_qty")), "V-08", "E14", "High"), one(there & (F.col("qty") < F.col("rcv_qty")), "V-08", "E15", "Medium"),
    ))
    return pairs.select("doc_id", "line_no", F.explode(found).alias("f")).select("doc_id", "line_no", "f.*")


def v09_receipt_total(header: DataFrame, active: DataFrame) -> DataFrame:
    """G-03: sub-total against the active receipts' value."""
    total = active.groupBy("doc_id").agg(F.sum("rcv_amount_c").alias("receipt_c"))
    h = header.join(total, "doc_id", "left")
    diff = F.abs(F.col("sub_total_c") - F.col("receipt_c"))
    code = F.when(diff > config.TOTAL_TOLERANCE_C, "E03")
    result = F.when(F.col("receipt_c").isNull() | F.col("sub_total_c").isNull(), "not_evaluated").when(code.isNotNull(), "fail").otherwise("pass")
    return h.select("doc_id", *outcome("V-09", code, F.lit("High"), result), diff.alias("diff_c"))
