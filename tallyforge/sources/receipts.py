"""Receipts as text tables (C-01, C-02, C-07, C-08, C-09) and framed answers (C-03, C-04).

Bad cells don't fail a job: they become null, and rows without a key go to the rejected part with a
reason. A table without any of the expected columns is a technical error, never "no rows".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOOTER = r"(?i)^\s*(\d+ rows? selected\.?|no rows selected\.?)\s*$"
COLUMNS = ("PO_NUM", "RCV_NUM", "ITM_CODE", "UOM", "RCV_QTY", "PO_UPRICE", "LINE_TOTAL", "SUPPLIER_TAX_ID")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (place in the file, from 0), value: text rows without blank ones and footers.

    Files are split as Spark likes: a row's place is its place in its split, which is read in order, plus the rows of the splits before it.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))  # a row a split
    placed = rows.withColumn("within", within).join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("within") - 1).alias("at"), F.regexp_replace("value", r"\r$", "").alias("value"))
    return placed.where((F.trim("value") != "") & ~F.col("value").rlike(FOOTER))


def parse(lines: DataFrame, expected: tuple[str, ...] = COLUMNS) -> DataFrame:
    """file, line_num (the row's place among its file's data rows) and a column for each expected name, as text (null where the file hasn't it).

    Each file's first row names its columns. A file with none of the expected ones fails the job: it is another table, not an empty one.
    """
    first = lines.groupBy("file").agg(F.min("at").alias("first"), F.min_by("value", "at").alias("header"))
    names = F.transform(F.split("header", ","), lambda n: F.upper(F.trim(F.regexp_replace(n, '"', ""))))
    known = first.withColumn("names", names)
    shown = F.concat(F.lit(f"MissingColumns: none of {', '.join(expected)} in: "), F.substring("header", 1, 200))
    checked = known.withColumn("names", F.when(F.arrays_overlap("names", F.array(*map(F.lit, expected))), F.col("names")).otherwise(F.raise_error(shown)))
    widest = 200  # columns of a row that are read at most
    data = lines.join(checked, "file").where(F.col("at") > F.col("first"))
    cells = F.array(*(F.trim(F.col("r")[f"c{i}"]) for i in range(widest)))
    row = data.withColumn("r", F.from_csv("value", ", ".join(f"c{i} string" for i in range(widest)), {"mode": "PERMISSIVE"})).withColumn("cells", cells)
    at = lambda n: F.get("cells", F.array_position("names", n).cast("int") - 1)
    return row.select("file", (F.col("at") - F.col("first")).alias("line_num"), *(F.nullif(at(n), F.lit("")).alias(n) for n in expected))


def decimal(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("decimal(18,4)")


def typed(rows: DataFrame) -> DataFrame:
    """Receipt lines with decimals, the amount from quantity and price where it isn't given, and `rejected`: why a row can't be used, or null."""
    qty, price, total = decimal(F.col("RCV_QTY")), decimal(F.col("PO_UPRICE")), decimal(F.col("LINE_TOTAL"))
    reason = F.when(F.col("PO_NUM").isNull() | F.col("RCV_NUM").isNull(), "no_key").when(qty.isNull() | price.isNull(), "not_a_number")
    amount = F.coalesce(total, (qty * price).cast("decimal(18,4)"))
    return rows.select("file", "line_num", F.col("PO_NUM").alias("po_number"), F.col("RCV_NUM").alias("receipt_num"), F.col("ITM_CODE").alias("item_code"), F.col("UOM").alias("uom"), qty.alias("qty"), price.alias("unit_price"), amount.alias("line_amount"), F.col("SUPPLIER_TAX_ID").alias("supplier_tax_id"), reason.alias("rejected"))


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """All files of a path, each with its own header."""
    return typed(parse(read_lines(spark, path)))


def framed(payload: Column) -> Column:
    """C-03: struct(text, error) of an answer, plain JSON or in `data:` frames: the first text content, or the error."""
    frame = F.try_element_at(F.regexp_extract_all(payload, F.lit(r"(?m)^data:\s*(\{.*\})\s*$"), F.lit(1)), F.lit(-1))
    x = F.coalesce(frame, payload)
    error = F.coalesce(F.get_json_object(x, "$.error.message"), F.when(F.get_json_object(x, "$.result.isError") == "true", F.coalesce(F.get_json_object(x, "$.result.content[0].text"), F.lit("error"))))
    text = F.get_json_object(x, "$.result.content[0].text")
    return F.struct(F.when(error.isNull(), text).alias("text"), F.coalesce(error, F.when(text.isNull(), "no_content")).alias("error"))


def nested(datasets: DataFrame) -> DataFrame:
    """C-09: datasets (po_number, rows array of structs) as receipt lines."""
    return datasets.select("po_number", F.posexplode("rows").alias("at", "r")).select("po_number", (F.col("at") + 1).alias("line_num"), "r.*")
