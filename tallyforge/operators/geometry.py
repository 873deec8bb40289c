"""Boxes on pages (J-21, J-22, P-14..P-17, G-23, G-24). Boxes are integers x, y, w, h in thousandths of the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRID = 100


def words_in_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """J-21: words whose centre is in a box, by a grid: a box is dealt to the cells it touches and a word to its own, so the join is an equi-join."""
    centre = words.withColumn("cx", F.col("x") * 2 + F.col("w")).withColumn("cy", F.col("y") * 2 + F.col("h"))
    word = centre.withColumn("gx", F.floor(F.col("cx") / (2 * GRID))).withColumn("gy", F.floor(F.col("cy") / (2 * GRID)))
    cells = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / GRID), F.floor((F.col(a) + F.col(n)) / GRID)))
    box = boxes.select("page", "box_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    box = box.withColumn("gx", cells("bx", "bw")).withColumn("gy", cells("by", "bh"))
    inside = (F.col("cx") >= F.col("bx") * 2) & (F.col("cx") <= (F.col("bx") + F.col("bw")) * 2) & (F.col("cy") >= F.col("by") * 2) & (F.col("cy") <= (F.col("by") + F.col("bh")) * 2)
    return word.join(box, ["page", "gx", "gy"]).where(inside).select("page", "box_id", "word_id")


def problems(elements: DataFrame, tolerance: int = 10) -> DataFrame:
    """P-17: why a box is bad: out of range, without area, or outside its parent's box."""
    parent = elements.select("page", F.col("element_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("w").alias("pw"), F.col("h").alias("ph"))
    e = elements.join(parent, ["page", "parent_id"], "left")
    outside = (F.col("x") < F.col("px") - tolerance) | (F.col("y") < F.col("py") - tolerance) | (F.col("x") + F.col("w") > F.col("px") + F.col("pw") + tolerance) | (F.col("y") + F.col("h") > F.col("py") + F.col("ph") + tolerance)
    reason = F.when((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > 1000) | (F.col("y") + F.col("h") > 1000), "out_of_range").when((F.col("w") <= 0) | (F.col("h") <= 0), "no_area").when(outside, "outside_parent")
    return e.where(reason.isNotNull()).select("page", "element_id", reason.alias("problem"))


def union_boxes(elements: DataFrame, keys: list[str]) -> DataFrame:
    """G-23, G-24: the box around all boxes of a key."""
    right, below = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return elements.groupBy(*keys).agg(F.min("x").alias("ux"), F.min("y").alias("uy"), (right - F.min("x")).alias("uw"), (below - F.min("y")).alias("uh"), F.count("*").alias("n"))


def best_row(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """J-22: the row that a cell overlaps most in height, if by half of the cell's or more."""
    r = rows.select("page", "row_id", F.col("y").alias("ry"), F.col("h").alias("rh"))
    overlap = F.least(F.col("y") + F.col("h"), F.col("ry") + F.col("rh")) - F.greatest("y", "ry")
    place = F.row_number().over(Window.partitionBy("page", "cell_id").orderBy(F.desc("overlap"), "row_id"))
    return cells.join(r, "page").withColumn("overlap", overlap).where("overlap * 2 >= h and overlap > 0").withColumn("place", place).where("place = 1").select("page", "cell_id", "row_id", "overlap")


def dropped(items: DataFrame, least_area: int = 16) -> DataFrame:
    """P-14, P-15: every item with the reason for dropping it, or null; nothing gets lost."""
    reason = F.when(F.col("w").isNull() | (F.col("w") <= 0) | (F.col("h") <= 0), "bad_bbox").when(F.col("w") * F.col("h") < least_area, "too_small").when(F.coalesce(F.trim("text"), F.lit("")) == "", "no_text").when(F.col("text").rlike(r"^[\p{P}\p{S}\s]+$"), "punctuation_only")
    return items.withColumn("drop_reason", reason)
