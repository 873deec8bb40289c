"""What readers saw on pages: frames of coordinates, reading order, repeated rows and repeated pages (A-02 .. A-05, J-22, P-16, W-05, W-06, F-43).

Boxes meet words by tiles of the page, never all with all. Rows and pages that depend on their order are
sorted within partitions and folded as a stream; what a fold holds is one page's kept rows, by tile, or
one document's kept pages of the same amounts.
"""

from __future__ import annotations

import difflib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ordered import codes, dealt, folded, whole

#: Tiles of a page in each direction.
TILES = 16
FRAMES = ("norm1000", "pixel")
# Fixed values.
SHARED_AREA = 0.5
NUMBER_LIKENESS, NUMBER_LENGTH = 0.85, 6
OVERFLOW = 1.02


# --- frames ----------------------------------------------------------------------------------------


def pixels(frame: Column, value: Column, size: Column) -> Column:
    """F-43: a coordinate of a frame in pixels."""
    return F.when(frame == "norm1000", value * size / 1000.0).when(frame == "norm1", value * size).otherwise(value)


def corners(frame: Column) -> dict[str, Column]:
    """F-43: x1, y1, x2, y2 in pixels, sorted and clipped to the page (columns x1, y1, x2, y2, img_w, img_h)."""
    at = lambda c, size: F.least(F.greatest(pixels(frame, F.col(c), F.col(size)), F.lit(0.0)), F.col(size).cast("double"))
    x, y = (at("x1", "img_w"), at("x2", "img_w")), (at("y1", "img_h"), at("y2", "img_h"))
    return {"px1": F.least(*x), "py1": F.least(*y), "px2": F.greatest(*x), "py2": F.greatest(*y)}


def on_words(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """page, frame, hits: boxes of each candidate frame that lie on the centre of a word. words: page, cx, cy (of the page's size, 0 to 1)."""
    framed = boxes.withColumn("frame", F.explode(F.array(*map(F.lit, FRAMES)))).withColumns(corners(F.col("frame")))
    tile = lambda v, size: F.least(F.greatest(F.floor(v * TILES / size), F.lit(0)), F.lit(TILES - 1))
    span = lambda a, b, size: F.explode(F.sequence(tile(F.col(a) - 1e-6, F.col(size)), tile(F.col(b) + 1e-6, F.col(size))))
    dealt = framed.withColumn("tx", span("px1", "px2", "img_w")).withColumn("ty", span("py1", "py2", "img_h"))
    word = words.select("page", "cx", "cy", tile(F.col("cx"), F.lit(1)).alias("tx"), tile(F.col("cy"), F.lit(1)).alias("ty"))
    wx, wy = F.col("cx") * F.col("img_w"), F.col("cy") * F.col("img_h")
    # a tile is that of the share of the page, so a centre and a box that holds it meet in one
    hit = dealt.join(word, ["page", "tx", "ty"]).where((wx >= F.col("px1")) & (wx <= F.col("px2")) & (wy >= F.col("py1")) & (wy <= F.col("py2")))
    return hit.select("page", "frame", "box_id").distinct().groupBy("page", "frame").agg(F.count("*").alias("hits"))


def frames(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """A-03: page, frame of the coordinates of its boxes (page, box_id, x1, y1, x2, y2, img_w, img_h).

    Coordinates up to 1.05 are shares of the page. Else the frame that puts more boxes on words wins, thousandths in a tie; where
    no frame puts any on one (as on pages without words): pixels, or, if few coordinates exceed 1000 and the page is larger than 1100 pixels, thousandths.
    """
    most = F.greatest("x1", "y1", "x2", "y2")
    over = sum((F.when(F.col(c) > 1000, 1).otherwise(0) for c in ("x1", "y1", "x2", "y2")), F.lit(0))
    sizes = boxes.groupBy("page").agg(F.max(most).alias("most"), F.sum(over).alias("over"), F.count("*").alias("n"), F.max(F.greatest("img_w", "img_h")).alias("size"))
    hits = on_words(boxes, words)
    best = hits.groupBy("page").agg(F.max_by("frame", F.struct("hits", (F.col("frame") == "norm1000").cast("int"))).alias("best"))
    bulk = F.when((F.col("most") <= 1000) | (F.col("over") * 10 <= F.col("n") * 4), F.when(F.col("size") > 1100, "norm1000").otherwise("pixel")).otherwise("pixel")
    return sizes.join(best, "page", "left").select("page", F.when(F.col("most") <= 1.05, "norm1").otherwise(F.coalesce("best", bulk)).alias("frame"))


def overflow(boxes: DataFrame, chosen: DataFrame) -> DataFrame:
    """P-16: page, items_total, items_outside, max_x, max_y (in pixels) of pages some of whose boxes end beyond the page's edge by over two per cent."""
    at = lambda c, size: pixels(F.col("frame"), F.col(c), F.col(size))
    outside = (at("x2", "img_w") > F.col("img_w") * OVERFLOW) | (at("y2", "img_h") > F.col("img_h") * OVERFLOW)
    x, y = F.max(F.greatest(at("x1", "img_w"), at("x2", "img_w"))), F.max(F.greatest(at("y1", "img_h"), at("y2", "img_h")))
    seen = boxes.join(chosen, "page").groupBy("page").agg(F.count("*").alias("items_total"), F.count_if(outside).alias("items_outside"), F.round(x, 1).alias("max_x"), F.round(y, 1).alias("max_y"))
    return seen.where("items_outside > 0")


# --- reading order ---------------------------------------------------------------------------------


def reading_order(words: DataFrame) -> DataFrame:
    """A-04: words (page, word_id, x, y, w, h) with line_no and place in the line.

    A line ends where a word begins below everything before it; nothing is rounded, so shifting a page
    doesn't change its order.
    """
    down = Window.partitionBy("page").orderBy("y", "x", "word_id")
    lowest = F.max(F.col("y") + F.col("h")).over(down.rowsBetween(Window.unboundedPreceding, -1))
    begins = words.withColumn("new", F.when(F.col("y") < lowest, 0).otherwise(1))
    lines = begins.withColumn("line_no", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.row_number().over(Window.partitionBy("page", "line_no").orderBy("x", "y", "word_id"))
    return lines.withColumn("place", place).drop("new")


def cut_rows(words: DataFrame, columns: DataFrame, least: float = 0.2) -> DataFrame:
    """J-22: page, line_no, label, text: the words of each line under each column (page, label, x, w), in order; a word belongs to every column that holds `least` of its width or more."""
    c = columns.select("page", "label", F.col("x").alias("c_x"), F.col("w").alias("c_w"))
    shared = F.least(F.col("x") + F.col("w"), F.col("c_x") + F.col("c_w")) - F.greatest("x", "c_x")
    under = words.join(c, "page").where((shared > 0) & (shared >= F.col("w") * least))  # columns: a few a page
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda t: t["text"]), " ")
    return under.groupBy("page", "line_no", "label").agg(text.alias("text"))


# --- folds -----------------------------------------------------------------------------------------


def tiles(box: tuple[float, float, float, float], size: float) -> list[tuple[int, int]]:
    x, y, w, h = box
    return [(i, j) for i in range(int(x // size), int((x + w) // size) + 1) for j in range(int(y // size), int((y + h) // size) + 1)]


def shared_area(a: tuple, b: tuple) -> float:
    """What part of the smaller box lies in the other."""
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    smaller = min(a[2] * a[3], b[2] * b[3])
    return max(w, 0) * max(h, 0) / smaller if smaller > 0 else 0.0


NUMBERS = ("qty", "unit_price", "amount")
BOX = ("x", "y", "w", "h")
TAKEN = (*NUMBERS, "uom", "description")
ROW = "page long, row_no long, merged_into long, x double, y double, w double, h double, description string, uom string, qty string, unit_price string, amount string"
#: Rows of a page that are held against one another without tiles.
FEW = 16


def _alike(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows that print a number which another row of their page prints, and codes of the rows' pages and of their printed numbers (-1: none), a row of NUMBERS each."""
    page, boxed = codes(batch.column("page")), pc.is_valid(batch.column("w")).to_numpy(zero_copy_only=False)
    alike, numbers = np.zeros(batch.num_rows, bool), np.full((len(NUMBERS), batch.num_rows), -1)
    for i, n in enumerate(NUMBERS):
        key = codes(batch.column(f"key_{n}"))
        printed = np.flatnonzero(boxed & pc.fill_null(pc.not_equal(batch.column(n), ""), False).to_numpy(zero_copy_only=False))
        numbers[i, printed] = key[printed]
        _, at, times = np.unique(page[printed] * len(key) + key[printed], return_inverse=True, return_counts=True)
        alike[printed] |= times[at] > 1
    return np.flatnonzero(alike), page, numbers


def merged_rows(rows: DataFrame, size: float = 0.05) -> DataFrame:
    """W-06, A-05: every row read from a page, in order of row_no, with merged_into: the earlier row that it repeats, or null.

    rows: page, row_no, x, y, w, h (shares of the page; null: no box), description, uom, qty, unit_price, amount, and key_qty,
    key_unit_price, key_amount, by which readings are compared (functions.normalize.reading_key). A row repeats the first kept one
    that shares half of the smaller box with it and prints the same numbers where both print any. The kept row
    takes over cells that it lacks and a longer description, and its box grows. A row none of whose numbers another row of
    its page prints stays as it is, in its Arrow batch; only others are looked at one by one, on pages with many of them by tile.
    """

    def fold(group: list[int], box: dict, printed: dict, cells: dict, taken: dict, into: np.ndarray) -> None:
        """Merges a page's alike rows, in order; group: their places in the batch."""
        kept: list[int] = []
        by_tile: dict[tuple[int, int], list[int]] = defaultdict(list)
        places = (lambda b: tiles(b, size)) if len(group) > FEW else (lambda b: [(0, 0)])

        def same_numbers(a: tuple, b: tuple) -> bool:
            both = [(p, q) for p, q in zip(a, b, strict=True) if p >= 0 and q >= 0]
            return bool(both) and all(p == q for p, q in both)

        for r in group:
            mine = box[r]
            near = sorted({i for t in places(mine) for i in by_tile[t]})
            found = next((i for i in near if same_numbers(printed[kept[i]], printed[r]) and shared_area(box[kept[i]], mine) >= SHARED_AREA), None)
            old: list[tuple[int, int]] = []
            if found is None:
                kept.append(r)
                found = len(kept) - 1
            else:
                k = kept[found]
                into[r] = k
                for n in TAKEN:
                    has, lacks = cells[n][r], not cells[n][k]
                    if has and (lacks or (n == "description" and has > cells[n][k])):
                        taken[n][k], cells[n][k] = r, has
                printed[k] = tuple(q if p < 0 else p for p, q in zip(printed[k], printed[r], strict=True))
                old, (x, y, w, h), (a, b, c, d) = places(box[k]), box[k], mine
                box[k] = (min(x, a), min(y, b), max(x + w, a + c) - min(x, a), max(y + h, b + d) - min(y, b))
            for t in set(places(box[kept[found]])).difference(old):
                by_tile[t].append(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, "page"):
            at, page, numbers = _alike(batch)
            some = batch.take(pa.array(at))
            box = dict(zip(at.tolist(), zip(*(some.column(c).to_pylist() for c in BOX), strict=True), strict=True))
            printed = dict(zip(at.tolist(), zip(*numbers[:, at].tolist(), strict=True), strict=True))
            # of a cell only its length counts, and where it is
            cells = {n: dict(zip(at.tolist(), pc.fill_null(pc.utf8_length(some.column(n)), 0).to_pylist(), strict=True)) for n in TAKEN}
            taken: dict[str, dict[int, int]] = {n: {} for n in TAKEN}
            into = np.full(batch.num_rows, -1)
            for group in np.split(at, np.flatnonzero(np.diff(page[at])) + 1):
                fold(group.tolist(), box, printed, cells, taken, into)

            def changed(column: pa.Array, cells: dict[int, int]) -> pa.Array:
                source = np.arange(len(column))
                source[list(cells)] = list(cells.values())
                return column.take(pa.array(source)) if cells else column

            out = {n: batch.column(n) for n in ("page", "row_no")} | {n: changed(batch.column(n), taken[n]) for n in TAKEN}
            out["merged_into"] = batch.column("row_no").take(pa.array(into, mask=into < 0))
            for i, c in enumerate(BOX):
                values = batch.column(c).to_numpy(zero_copy_only=False).copy()
                values[at] = [b[i] for b in box.values()]
                out[c] = pa.array(values, mask=pc.is_null(batch.column(c)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    names = [c.split()[0] for c in ROW.split(", ")]
    return dealt(rows, ["page"], ["row_no"]).mapInArrow(run, ROW)


COPY = "doc_id long, page long, copy_of long"


def copies(pages: DataFrame) -> DataFrame:
    """W-05, A-02: doc_id, page, copy_of: the earlier kept page that a page is a printed copy of, or null.

    pages: doc_id, page, page_type, number (its invoice number's key, or null), amounts (array of its rows' printed amounts, in
    order, without rows that print none). Only pages of the same amounts are compared: by number, equal or alike (six characters or
    more), and by type unless there are two rows. A page without number or rows is no copy, and none is a copy of it.
    A copy is compared with kept pages only, so of a chain a ~ b ~ c the last stays if it isn't like the first.
    """

    def fold(group: Iterator[dict]) -> Iterator[dict]:
        kept: list[dict] = []
        for p in group:
            alike = lambda k, p=p: k["number"] == p["number"] or (len(p["number"]) >= NUMBER_LENGTH and difflib.SequenceMatcher(None, p["number"], k["number"]).ratio() >= NUMBER_LIKENESS)
            usable = bool(p["number"]) and bool(p["n_rows"])
            first = next((k for k in kept if (k["page_type"] == p["page_type"] or p["n_rows"] >= 2) and alike(k)), None) if usable else None
            if first is None and usable:
                kept.append(p)
            yield {"doc_id": p["doc_id"], "page": p["page"], "copy_of": first and first["page"]}

    keyed = pages.select("doc_id", "page", "page_type", "number", F.size("amounts").alias("n_rows"), F.sha2(F.to_json("amounts"), 256).alias("block"))
    return folded(keyed, ["doc_id", "block"], ["page"], COPY, fold)
