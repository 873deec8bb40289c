"""Queries over what readers saw on pages, each with its SQL for DuckDB; folds have none and are tested against plain ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import normalize as N
from tallyforge.functions import printed
from tallyforge.operators import pages
from tallyforge.plans.catalogue import BOXES, boxes, query
from tallyforge.plans.documents import MONEY, money_text
from tallyforge.plans.landing import Landing

# --- frames and order ------------------------------------------------------------------------------


def framed(x: Landing) -> tuple[DataFrame, DataFrame]:
    """Boxes in one of three frames by page, some running past the page, and the words' centres; pages without words are there too."""
    words, found = boxes(x)
    page = F.col("page")
    sized = found.withColumn("img_w", F.when(page % 2 == 0, 1240).otherwise(800)).withColumn("img_h", F.when(page % 2 == 0, 1754).otherwise(1000))
    stretch = F.when((page % 10 == 4) & (F.col("box_id") > 5), 1.5).otherwise(1.0)
    at = lambda v, size: F.when(page % 3 == 0, v).when(page % 3 == 1, v * F.col(size) / 1000.0).otherwise(v / 1000.0) * stretch
    cx, cy = (F.col("x") * 2 + F.col("w")) / 2000.0, (F.col("y") * 2 + F.col("h")) / 2000.0
    corners = {"x1": at(F.col("x").cast("double"), "img_w"), "y1": at(F.col("y").cast("double"), "img_h"), "x2": at((F.col("x") + F.col("w")).cast("double"), "img_w"), "y2": at((F.col("y") + F.col("h")).cast("double"), "img_h")}
    return sized.withColumns(corners).select("page", "box_id", "x1", "y1", "x2", "y2", "img_w", "img_h"), words.where(page % 7 != 3).select("page", cx.alias("cx"), cy.alias("cy"))


_at = lambda v, size: f"CASE page % 3 WHEN 0 THEN ({v})::DOUBLE WHEN 1 THEN ({v})::DOUBLE * {size} / 1000::DOUBLE ELSE ({v})::DOUBLE / 1000::DOUBLE END * CASE WHEN page % 10 = 4 AND box_id > 5 THEN 1.5::DOUBLE ELSE 1::DOUBLE END"
_px = lambda c, size: f"least(greatest(CASE frame WHEN 'norm1000' THEN {c} * {size} / 1000::DOUBLE WHEN 'norm1' THEN {c} * {size} ELSE {c} END, 0), {size})"
FRAMED = BOXES + f""", fb AS (SELECT page, box_id, CASE WHEN page % 2 = 0 THEN 1240 ELSE 800 END AS img_w, CASE WHEN page % 2 = 0 THEN 1754 ELSE 1000 END AS img_h, {_at("x", "img_w")} AS x1, {_at("y", "img_h")} AS y1, {_at("x + w", "img_w")} AS x2, {_at("y + h", "img_h")} AS y2 FROM boxes),
wc AS (SELECT page, (x * 2 + w)::DOUBLE / 2000::DOUBLE AS cx, (y * 2 + h)::DOUBLE / 2000::DOUBLE AS cy FROM words WHERE page % 7 <> 3),
fr AS (SELECT *, unnest(['norm1000', 'pixel']) AS frame FROM fb),
hits AS (SELECT f.page, frame, count(DISTINCT box_id) AS hits FROM fr f JOIN wc USING (page) WHERE cx * img_w BETWEEN {_px("x1", "img_w")} AND {_px("x2", "img_w")} AND cy * img_h BETWEEN {_px("y1", "img_h")} AND {_px("y2", "img_h")} GROUP BY 1, 2),
best AS (SELECT page, frame FROM hits QUALIFY row_number() OVER (PARTITION BY page ORDER BY hits DESC, frame = 'norm1000' DESC) = 1),
sz AS (SELECT page, max(greatest(x1, y1, x2, y2)) AS most, sum((x1 > 1000)::INT + (y1 > 1000)::INT + (x2 > 1000)::INT + (y2 > 1000)::INT) AS over, count(*) AS n, max(greatest(img_w, img_h)) AS size FROM fb GROUP BY 1),
chosen AS (SELECT page, CASE WHEN most <= 1.05 THEN 'norm1' ELSE coalesce(b.frame, CASE WHEN (most <= 1000 OR over / (4.0 * n) <= 0.1) AND size > 1100 THEN 'norm1000' ELSE 'pixel' END) END AS frame FROM sz LEFT JOIN best b USING (page))"""


@query(FRAMED + "SELECT * FROM chosen")
def page_frames(x: Landing) -> DataFrame:
    """A-03."""
    return pages.frames(*framed(x))


_raw = lambda c, size: f"CASE frame WHEN 'norm1000' THEN {c} * {size} / 1000::DOUBLE WHEN 'norm1' THEN {c} * {size} ELSE {c} END"


@query(FRAMED + f"""SELECT page, count(*) AS items_total, count(*) FILTER ({_raw("x2", "img_w")} > img_w * 1.02::DOUBLE OR {_raw("y2", "img_h")} > img_h * 1.02::DOUBLE) AS items_outside,
  round(max(greatest({_raw("x1", "img_w")}, {_raw("x2", "img_w")})), 1) AS max_x, round(max(greatest({_raw("y1", "img_h")}, {_raw("y2", "img_h")})), 1) AS max_y
FROM fb JOIN chosen USING (page) GROUP BY page HAVING items_outside > 0""")
def page_overflow(x: Landing) -> DataFrame:
    """P-16."""
    found, words = framed(x)
    return pages.overflow(found, pages.frames(found, words))


ORDERED = BOXES + """, o1 AS (SELECT *, CASE WHEN y < max(y + h) OVER (PARTITION BY page ORDER BY y, x, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM words),
o2 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page ORDER BY y, x, word_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_no FROM o1),
ordered AS (SELECT *, row_number() OVER (PARTITION BY page, line_no ORDER BY x, y, word_id) AS place FROM o2)"""


@query(ORDERED + "SELECT page, word_id, line_no, CAST(place AS BIGINT) AS place FROM ordered")
def page_reading_order(x: Landing) -> DataFrame:
    """A-04."""
    return pages.reading_order(boxes(x)[0]).select("page", "word_id", F.col("line_no").cast("long").alias("line_no"), F.col("place").cast("long").alias("place"))


@query(ORDERED + """, cols AS (SELECT DISTINCT page, unnest(['left', 'middle', 'right']) AS label, unnest([0, 330, 660]) AS cx, 340 AS cw FROM words)
SELECT o.page, line_no, label, string_agg('w' || word_id, ' ' ORDER BY place) AS text FROM ordered o JOIN cols c ON c.page = o.page AND least(x + w, cx + cw) - greatest(x, cx) > 0 AND least(x + w, cx + cw) - greatest(x, cx) >= w * 0.2 GROUP BY ALL""")
def page_row_cells(x: Landing) -> DataFrame:
    """J-22."""
    ordered = pages.reading_order(boxes(x)[0]).withColumn("text", F.concat(F.lit("w"), F.col("word_id").cast("string")))
    of = F.inline(F.array(*(F.struct(F.lit(label).alias("label"), F.lit(at).cast("long").alias("x"), F.lit(340).cast("long").alias("w")) for label, at in (("left", 0), ("middle", 330), ("right", 660)))))
    columns = ordered.select("page").distinct().select("page", of)
    return pages.cut_rows(ordered, columns).withColumn("line_no", F.col("line_no").cast("long"))


# --- rows ------------------------------------------------------------------------------------------


def row_text(description: Column) -> Column:
    q, u, p, a = F.col("qty").cast("string"), F.col("uom"), money_text("price_c"), money_text("amount_c")
    k = (F.col("doc_id") + F.col("line_no")) % 6
    return (
        F.when(k == 0, F.concat_ws(" ", description, q, u, p, a)).when(k == 1, F.concat_ws(" ", description, u, q, p, F.concat(a, F.lit(" THB"))))
        .when(k == 2, F.concat_ws(" ", description, q, u, F.lit("1.00"), p, a)).when(k == 3, F.concat_ws(" ", description, q, u, p, F.lit("0.00"), a))
        .when(k == 4, F.concat_ws("  ", description, F.concat(F.lit("x"), q), u, p, F.lit("9.99"), a)).otherwise(F.concat_ws(" ", description, p, a))
    )


_money = r"\d[\d,]*\.\d{2}(?: \d[\d,]*\.\d{2}){1,2}"
_unit = r"[A-Za-z][A-Za-z0-9./-]{0,11}"
_p, _a = MONEY.format("price_c"), MONEY.format("amount_c")
PRINTED = rf""", pt AS (
  SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(CASE (doc_id + line_no) % 6 WHEN 0 THEN concat_ws(' ', 'Goods', item, qty, uom, {_p}, {_a}) WHEN 1 THEN concat_ws(' ', 'Goods', item, uom, qty, {_p}, {_a} || ' THB') WHEN 2 THEN concat_ws(' ', 'Goods', item, qty, uom, '1.00', {_p}, {_a})
    WHEN 3 THEN concat_ws(' ', 'Goods', item, qty, uom, {_p}, '0.00', {_a}) WHEN 4 THEN concat_ws('  ', 'Goods ' || item, 'x' || qty, uom, {_p}, '9.99', {_a}) ELSE concat_ws(' ', 'Goods', item, {_p}, {_a}) END, '\bTHB\b', ' '), '\s+', ' ', 'g')) AS t FROM bill_line),
pm AS (SELECT *, regexp_extract(t, '^(.*?)(\d[\d,]*(?:\.\d+)?) ({_unit}) ({_money})$', ['d', 'q', 'u', 'm']) AS a, regexp_extract(t, '^(.*?)({_unit}) (\d+(?:\.\d+)?) ({_money})$', ['d', 'u', 'q', 'm']) AS b FROM pt),
pc AS (SELECT doc_id, line_no, CASE WHEN a.q <> '' THEN a.d ELSE b.d END AS d, CASE WHEN a.q <> '' THEN a.q ELSE b.q END AS qty, CASE WHEN a.q <> '' THEN a.u ELSE b.u END AS uom, string_split(CASE WHEN a.q <> '' THEN a.m ELSE b.m END, ' ') AS m FROM pm),
pn AS (SELECT *, list_transform(m, lambda v: TRY_CAST(replace(v, ',', '') AS DECIMAL(18,4))) AS v, TRY_CAST(replace(qty, ',', '') AS DECIMAL(18,4)) AS q FROM pc WHERE qty <> '')"""


@query(PRINTED + """SELECT doc_id, line_no, nullif(trim(d), '') AS description, qty, uom, CASE WHEN len(m) = 2 THEN m[1] WHEN abs(q * v[2] - v[3]) <= 0.01 THEN m[2] WHEN abs(q * v[1] - v[3]) <= 0.01 OR v[2] = 0 THEN m[1] ELSE m[2] END AS unit_price, m[-1] AS amount FROM pn""")
def printed_rows(x: Landing) -> DataFrame:
    """F-35, over rows printed in six ways."""
    found = x.bill_line.select("doc_id", "line_no", printed.row_cells(row_text(F.concat(F.lit("Goods "), F.col("item").cast("string")))).alias("r"))
    return found.where("r is not null").select("doc_id", "line_no", "r.*")


@query("""SELECT doc_id, line_no, CASE WHEN n = 1 THEN CAST(CAST(replace(one, ',', '') AS DECIMAL(18,4)) AS VARCHAR) END AS amount FROM (
  SELECT doc_id, line_no, CASE (doc_id + line_no) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n, """ + MONEY.format("amount_c") + """ AS one FROM bill_line)""")
def single_amounts(x: Landing) -> DataFrame:
    """F-36: one amount in a text, two, or none."""
    k = (F.col("doc_id") + F.col("line_no")) % 3
    text = F.when(k == 0, F.concat(money_text("amount_c"), F.lit(" THB"))).when(k == 1, F.concat(F.lit("1 x "), money_text("amount_c"))).otherwise("none")
    return x.bill_line.select("doc_id", "line_no", printed.single_amount(text).cast("string").alias("amount"))


def read_rows(x: Landing) -> DataFrame:
    """Rows as a reader gives them: every fourth line twice, the second time with a longer description, without its unit, and in a shifted box."""
    k = F.col("doc_id") + F.col("line_no")
    times = F.explode(F.sequence(F.lit(0), F.when(k % 4 == 0, 1).otherwise(0))).alias("again")
    r = x.bill_line.select("*", times)
    key = {f"key_{n}": N.reading_key(F.col(n)) for n in pages.NUMBERS}
    out = r.select(
        F.col("doc_id").alias("page"), (F.col("line_no") * 2 + F.col("again")).alias("row_no"), F.lit(0.05).alias("x"), (F.col("line_no") * 0.04 + F.col("again") * 0.005).alias("y"), F.lit(0.9).alias("w"), F.lit(0.03).alias("h"),
        F.concat(F.lit("Goods "), F.col("item").cast("string"), F.when(F.col("again") == 1, " as ordered").otherwise("")).alias("description"), F.when(F.col("again") == 0, F.col("uom")).alias("uom"),
        F.col("qty").cast("string").alias("qty"), money_text("price_c").alias("unit_price"), F.when((F.col("again") == 0) | (k % 8 == 0), money_text("amount_c")).otherwise(F.regexp_replace(money_text("amount_c"), ",", "")).alias("amount"),
    )
    return out.withColumns(key)


@query()
def merged_page_rows(x: Landing) -> DataFrame:
    """W-06, A-05."""
    return pages.merged_rows(read_rows(x))


@query()
def printed_copies(x: Landing) -> DataFrame:
    """W-05, A-02: every third order was scanned three times, with one letter of the number misread on the last page."""
    d = F.col("doc_id")
    amounts = x.bill_line.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws("|", F.col("qty").cast("string"), money_text("price_c"), money_text("amount_c")).alias("printed")))), lambda r: r["printed"]).alias("amounts"))
    number = N.letters_key(F.concat(F.lit("INV"), F.lpad(d.cast("string"), 8, "0")))
    scans = F.explode(F.sequence(F.lit(1), F.when(d % 3 == 0, 3).otherwise(1)))
    page = amounts.select("doc_id", "amounts", scans.alias("scan")).select("doc_id", "amounts", F.col("scan").cast("long").alias("page")).withColumn("page_type", F.when((F.col("page") == 2) & (d % 2 == 0), "delivery").otherwise("invoice"))
    return pages.copies(page.withColumn("number", F.when((F.col("page") == 3) & (d % 9 == 0), F.concat(F.left(number, F.lit(10)), F.lit("X"))).otherwise(number)))


@query()
def recovered_answers(x: Landing) -> DataFrame:
    """F-39: orders as JSON answers, cut off at a place of their own, with what of them is complete."""
    line = F.to_json(F.struct(F.col("line_no"), F.concat(F.lit('a "quoted" {brace} '), F.col("item").cast("string")).alias("text"), money_text("amount_c").alias("amount")))
    whole = x.bill_line.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("line_no").cast("string"), 4, "0"), line))), "\x01").alias("lines"))
    text = F.concat(F.lit('<think>{not this}</think>```json\n{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "lines": ['), F.regexp_replace(F.regexp_replace("lines", "\x01[0-9]{4}", ", "), "^[0-9]{4}", ""), F.lit("]}\n```"))
    cut = whole.withColumn("text", text).withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.left("text", (F.length("text") * (F.col("doc_id") % 97) / 97).cast("int"))).otherwise(F.col("text")))
    return cut.select("doc_id", printed.recovered_json(F.col("text")).alias("json"))
