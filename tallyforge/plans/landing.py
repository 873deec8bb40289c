"""The driver's tables as billing documents: canonical views that all operators work on.

Amounts are integer cents, so that sums don't depend on their order. Perturbations (missing lines,
changed prices, missing signatures, ...) are modular arithmetic on keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ("printed_no", "item", "supp", "l_quantity", "l_extendedprice", "l_shipdate")
UNITS = ("PC", "KG", "BOX", "SET")
SUB_TOTAL = "lines_c + case when doc_id % 29 = 0 then 300 when doc_id % 13 = 0 then 25 else 0 end"


def entity_tax_id(n: Column) -> Column:
    """A 13-digit id with a valid check digit for the n-th entity."""
    body = F.lpad((n * 7919 + 100_000_000_000).cast("string"), 12, "0")
    weighed = sum((F.substring(body, i + 1, 1).cast("int") * (13 - i) for i in range(12)), F.lit(0))
    return F.concat(body, ((11 - weighed % 11) % 10).cast("string"))


@dataclass
class Landing:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def numbered_lines(self, rows: DataFrame, *also: str) -> DataFrame:
        """Bill lines of rows of lineitem, with columns of theirs that are taken along."""
        # numbered under the name that joins, sums and folds use, so that lines dealt by document once stay where they are
        numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy(*LINE_ORDER))
        rows = rows.select(
            F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").cast("long").alias("printed_no"), "l_quantity", "l_extendedprice", "l_shipdate", *also,
        ).withColumn("line_no", numbered.cast("long"))
        base = rows.select("doc_id", "line_no", "item", "supp", "printed_no", F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("base_c"), "l_shipdate", *also)
        unit = F.get(F.array(*map(F.lit, UNITS)), F.col("item") % 4)
        off = F.when(((F.col("doc_id") + F.col("item")) % 17 == 0) & (F.col("doc_id") % 5 == 0), 6000).otherwise(0)
        return base.select("*", F.expr("(base_c * 2 + qty) div (2 * qty)").alias("price_c"), (F.col("base_c") + off).alias("amount_c"), unit.alias("uom"))

    @cached_property
    def bill_line(self) -> DataFrame:
        return self.numbered_lines(self.table("lineitem"))

    def receipts_of(self, lines: DataFrame, *also: str) -> DataFrame:
        """The receipt lines of bill lines, with columns of theirs that are taken along."""
        k = (F.col("doc_id") * 7 + F.col("item") * 3 + F.col("supp")) % 20
        lots = F.when(F.col("k") == 6, F.array(F.floor(F.col("qty") / 2), F.col("qty") - F.floor(F.col("qty") / 2))).otherwise(F.array(F.when(F.col("k") == 1, F.col("qty") - 1).when(F.col("k") == 2, F.col("qty") + 1).when(F.col("k") == 7, F.lit(0)).otherwise(F.col("qty"))))
        price = F.expr("case when k = 3 then price_c * 1005 div 1000 when k = 4 then price_c * 105 div 100 else price_c end")
        number = F.concat(F.col("doc_id").cast("string"), F.when((F.col("doc_id") % 11 == 0) & (F.col("printed_no") > 3), "-B").otherwise(""))
        rows = lines.withColumn("k", k).where("k <> 0")
        return rows.select(
            "doc_id", F.col("line_no").alias("rcv_line"), "item", "supp", number.alias("receipt_num"), price.alias("rcv_price_c"), F.when(F.col("k") == 5, "DRUM").otherwise(F.col("uom")).alias("rcv_uom"), *also, F.posexplode(lots).alias("lot", "rcv_qty"),
        ).withColumn("rcv_qty", F.col("rcv_qty").cast("long")).withColumn("lot", F.col("lot").cast("long")).withColumn("rcv_amount_c", F.col("rcv_qty") * F.col("rcv_price_c"))

    @cached_property
    def receipt_line(self) -> DataFrame:
        return self.receipts_of(self.bill_line)

    @cached_property
    def active(self) -> DataFrame:
        """P-09."""
        return self.receipt_line.where("rcv_qty > 0")

    @cached_property
    def receipt_head(self) -> DataFrame:
        """A row a receipt: the invoice numbers that goods-in and accounts booked it under, its purchase order and its supplier's tax id. Some suppliers use a number of the document before."""
        d = F.col("doc_id")
        heads = self.active.groupBy("doc_id", "receipt_num").agg(F.count("*").alias("n_rows"), F.min("supp").alias("supp"))
        booked = F.when(d % 13 == 5, d - 1).otherwise(d).cast("string")
        tax = self.supplier.select("supp", F.coalesce("vat_reg", "other_id").alias("supplier_tax"))
        keyed = heads.select(F.concat(F.lit("INV"), booked).alias("booked_invoice"), F.when(d % 3 != 0, F.concat(F.lit("INV/"), d.cast("string"))).alias("paid_invoice"), (d + 50_000_000).cast("string").alias("booked_po"), "receipt_num", "supp", "n_rows")
        return keyed.join(tax, "supp", "left")

    @cached_property
    def bill_key(self) -> DataFrame:
        """What a document says of itself that receipts are looked up by: doc_id, invoice_num, po_number, read_tax (null where it wasn't read)."""
        d = F.col("doc_id")
        first = self.receipt_line.where("rcv_qty > 0").groupBy("doc_id").agg(F.min("supp").alias("supp")).join(self.supplier.select("supp", F.coalesce("vat_reg", "other_id").alias("tax")), "supp")
        return self.numbers.join(first, "doc_id", "left").select("doc_id", "invoice_num", "po_number", F.when(d % 6 != 0, F.col("tax")).alias("read_tax"))

    @cached_property
    def numbers(self) -> DataFrame:
        """doc_id, invoice_num, po_number: no totals, so that a lookup doesn't pay for them."""
        d = F.col("doc_id")
        text = d.cast("string")
        invoice = F.when(d % 4 == 0, F.concat(F.lit("INV/"), text)).when(d % 4 == 1, F.concat(F.lit("INV"), text)).when(d % 4 == 2, F.concat(F.lit("inv "), text)).otherwise(F.concat(F.lit("INV-"), text))
        return self.table("orders").select(F.col("o_orderkey").alias("doc_id")).select("doc_id", invoice.alias("invoice_num"), (d + 50_000_000).cast("string").alias("po_number"))

    @cached_property
    def entity(self) -> DataFrame:
        n = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("n_nationkey").cast("long")
        return n.select(key.alias("org_id"), F.concat("n_name", F.lit(" CO., LTD.")).alias("legal_name"), "r_name", entity_tax_id(key).alias("tax_id"), F.when(key % 9 == 4, "cancelled").otherwise("active").alias("status"), F.lpad((key * 37 + 10_000).cast("string"), 5, "0").alias("postal"),
            F.array(F.concat("n_name", F.lit(" CO., LTD.")), F.concat(F.lit("OLD "), "n_name")).alias("names"), F.array(*(F.concat(F.lit(street), F.lpad((key * 37 + 10_000).cast("string"), 5, "0")) for street in ("99/1 Main Road ", "7 Branch Road "))).alias("addresses"), F.concat(F.lit("BKK-"), "n_name").alias("loc_code"), (key + 20).alias("unit_id"))

    @cached_property
    def supplier(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(key.alias("supp"), "s_name", F.when(key % 10 != 3, entity_tax_id(key + 1000)).alias("vat_reg"), entity_tax_id(key + 5000).alias("other_id"))

    @cached_property
    def line_sums(self) -> DataFrame:
        return self.bill_line.groupBy("doc_id").agg(F.sum("amount_c").alias("lines_c"), F.count("*").alias("n_lines"))

    @cached_property
    def sub_totals(self) -> DataFrame:
        """doc_id, sub_total_c of all documents: no customers, so that a fold over lines doesn't pay for them."""
        return self.table("orders").select(F.col("o_orderkey").alias("doc_id")).join(self.line_sums, "doc_id", "left").select("doc_id", F.expr(SUB_TOTAL).alias("sub_total_c"))

    @cached_property
    def bill_head(self) -> DataFrame:
        """Headers without what follows from lines."""
        o = self.table("orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderdate", "o_orderstatus")
        c = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("org_id"))
        n = self.table("nation").select(F.col("n_nationkey").cast("long").alias("org_id"), "n_name")
        org, d = F.col("org_id"), F.col("doc_id")
        # what follows from the organisation is made once for each, a row an organisation
        orgs = c.select("org_id").distinct().join(F.broadcast(n), "org_id", "left").select("org_id", "n_name", entity_tax_id(org).alias("own_tax"), entity_tax_id(org + 77).alias("other_tax"), F.lpad((org * 37 + 10_000).cast("string"), 5, "0").alias("own_postal"))
        h = o.join(c, "o_custkey", "left").join(F.broadcast(orgs), "org_id", "left")
        text = d.cast("string")
        invoice = F.when(d % 4 == 0, F.concat(F.lit("INV/"), text)).when(d % 4 == 1, F.concat(F.lit("INV"), text)).when(d % 4 == 2, F.concat(F.lit("inv "), text)).otherwise(F.concat(F.lit("INV-"), text))
        return h.select(
            "doc_id", "o_orderdate", "o_orderstatus", "org_id", invoice.alias("invoice_num"), (d + 50_000_000).cast("string").alias("po_number"),
            F.when(d % 41 != 0, F.col("c_name")).alias("customer_name"), F.when(d % 19 == 0, F.col("other_tax")).otherwise(F.col("own_tax")).alias("customer_tax_id"),
            (d % 23 != 0).alias("receiver"), (d % 27 != 0).alias("deliverer"), (d % 37 != 0).alias("pages_complete"),
            F.when(d % 43 != 0, F.concat(F.lit("Supplier "), (d % 10).cast("string"))).alias("supplier_name"), F.when(d % 53 != 0, F.lpad(text, 13, "0")).alias("supplier_tax_id"), F.when(d % 47 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("invoice_date"),
            F.when(d % 34 == 0, "OTHER TRADING").when(d % 16 == 0, F.concat(F.lower("n_name"), F.lit(" head office"))).when(d % 15 == 0, F.concat("n_name", F.lit(" EXPORT"))).when(d % 61 != 0, F.concat(F.lit("The "), "n_name", F.lit(" Company Limited"))).alias("buyer_name"),
            F.when(d % 59 != 0, F.concat(F.when(d % 51 == 0, "88/1 Main Road ").when(d % 3 == 0, "7 Branch Road ").otherwise("99/1 Main Road "), F.when(d % 21 == 0, "99999").otherwise(F.col("own_postal")))).alias("customer_address"), (d % 50 == 7).alias("is_duplicate"),
        )

    @staticmethod
    def totalled(head: DataFrame) -> DataFrame:
        """Headers with their amounts, from lines_c and n_lines."""
        h = head.withColumns({"n_lines": F.coalesce("n_lines", F.lit(0)), "sub_total_c": F.expr(SUB_TOTAL)})
        h = h.withColumn("vat_c", F.expr("(sub_total_c * 7 + 50) div 100"))
        return h.withColumn("grand_c", F.col("sub_total_c") + F.col("vat_c") + F.when(F.col("doc_id") % 31 == 0, 75).otherwise(0))

    @cached_property
    def bill_header(self) -> DataFrame:
        return self.totalled(self.bill_head.join(self.line_sums, "doc_id", "left"))

    @cached_property
    def event(self) -> DataFrame:
        """Events as document snapshots: user_id is the document, revisions count up by event."""
        rev = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
        return self.table("events").select("event_id", "ts", F.col("user_id").alias("external_id"), "event_type", "value", "props", rev.alias("revision"))


#: The same views for DuckDB, as the beginning of a WITH clause.
SQL_VIEWS = """
WITH bl0 AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS line_no,
         l_partkey AS item, l_suppkey AS supp, CAST(l_linenumber AS BIGINT) AS printed_no, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS base_c, l_shipdate
  FROM lineitem),
bill_line AS (
  SELECT *, (base_c * 2 + qty) // (2 * qty) AS price_c, base_c + CASE WHEN (doc_id + item) % 17 = 0 AND doc_id % 5 = 0 THEN 6000 ELSE 0 END AS amount_c,
         CASE item % 4 WHEN 0 THEN 'PC' WHEN 1 THEN 'KG' WHEN 2 THEN 'BOX' ELSE 'SET' END AS uom FROM bl0),
rl0 AS (SELECT *, (doc_id * 7 + item * 3 + supp) % 20 AS k FROM bill_line),
rl1 AS (
  SELECT doc_id, line_no AS rcv_line, item, supp, CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 11 = 0 AND printed_no > 3 THEN '-B' ELSE '' END AS receipt_num,
         CASE WHEN k = 3 THEN price_c * 1005 // 1000 WHEN k = 4 THEN price_c * 105 // 100 ELSE price_c END AS rcv_price_c, CASE WHEN k = 5 THEN 'DRUM' ELSE uom END AS rcv_uom,
         unnest(CASE WHEN k = 6 THEN [0, 1] ELSE [0] END) AS lot, k, qty FROM rl0 WHERE k <> 0),
rl2 AS (
  SELECT doc_id, rcv_line, item, supp, receipt_num, rcv_price_c, rcv_uom, CAST(lot AS BIGINT) AS lot,
         CAST(CASE WHEN k = 6 AND lot = 0 THEN qty // 2 WHEN k = 6 THEN qty - qty // 2 WHEN k = 1 THEN qty - 1 WHEN k = 2 THEN qty + 1 WHEN k = 7 THEN 0 ELSE qty END AS BIGINT) AS rcv_qty FROM rl1),
receipt_line AS (SELECT *, rcv_qty * rcv_price_c AS rcv_amount_c FROM rl2),
active AS (SELECT * FROM receipt_line WHERE rcv_qty > 0),
ids AS (
  SELECT n, lpad(CAST(n * 7919 + 100000000000 AS VARCHAR), 12, '0') AS body FROM (
    SELECT n_nationkey AS n FROM nation UNION SELECT n_nationkey + 77 FROM nation UNION SELECT c_nationkey FROM customer UNION SELECT c_nationkey + 77 FROM customer
    UNION SELECT s_suppkey FROM supplier UNION SELECT s_suppkey + 1000 FROM supplier UNION SELECT s_suppkey + 5000 FROM supplier)),
taxes AS MATERIALIZED (
  SELECT n, body || CAST((11 - sum(CAST(substr(body, CAST(i AS INT) + 1, 1) AS BIGINT) * (13 - i)) % 11) % 10 AS VARCHAR) AS tax FROM ids CROSS JOIN range(12) d(i) GROUP BY n, body),
entity AS (
  SELECT CAST(n_nationkey AS BIGINT) AS org_id, n_name || ' CO., LTD.' AS legal_name, r_name, tax AS tax_id, CASE WHEN n_nationkey % 9 = 4 THEN 'cancelled' ELSE 'active' END AS status, lpad(CAST(n_nationkey * 37 + 10000 AS VARCHAR), 5, '0') AS postal, n_name, CAST(n_nationkey + 20 AS BIGINT) AS unit_id
  FROM nation JOIN region ON n_regionkey = r_regionkey JOIN taxes ON n = n_nationkey),
supplier_dim AS (
  SELECT s_suppkey AS supp, s_name, CASE WHEN s_suppkey % 10 <> 3 THEN a.tax END AS vat_reg, b.tax AS other_id FROM supplier JOIN taxes a ON a.n = s_suppkey + 1000 JOIN taxes b ON b.n = s_suppkey + 5000),
sums AS (SELECT doc_id, CAST(sum(amount_c) AS BIGINT) AS lines_c, count(*) AS n_lines FROM bill_line GROUP BY doc_id),
bh0 AS (
  SELECT o_orderkey AS doc_id, o_orderdate, o_orderstatus, CAST(c_nationkey AS BIGINT) AS org_id, coalesce(n_lines, 0) AS n_lines, lines_c,
         CASE o_orderkey % 4 WHEN 0 THEN 'INV/' WHEN 1 THEN 'INV' WHEN 2 THEN 'inv ' ELSE 'INV-' END || CAST(o_orderkey AS VARCHAR) AS invoice_num, CAST(o_orderkey + 50000000 AS VARCHAR) AS po_number,
         CASE WHEN o_orderkey % 41 <> 0 THEN c_name END AS customer_name, t.tax AS customer_tax_id,
         lines_c + CASE WHEN o_orderkey % 29 = 0 THEN 300 WHEN o_orderkey % 13 = 0 THEN 25 ELSE 0 END AS sub_total_c,
         o_orderkey % 23 <> 0 AS receiver, o_orderkey % 27 <> 0 AS deliverer, o_orderkey % 37 <> 0 AS pages_complete,
         CASE WHEN o_orderkey % 43 <> 0 THEN 'Supplier ' || CAST(o_orderkey % 10 AS VARCHAR) END AS supplier_name, CASE WHEN o_orderkey % 53 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 13, '0') END AS supplier_tax_id, CASE WHEN o_orderkey % 47 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date,
         CASE WHEN o_orderkey % 34 = 0 THEN 'OTHER TRADING' WHEN o_orderkey % 16 = 0 THEN lower(n_name) || ' head office' WHEN o_orderkey % 15 = 0 THEN n_name || ' EXPORT' WHEN o_orderkey % 61 <> 0 THEN 'The ' || n_name || ' Company Limited' END AS buyer_name,
         CASE WHEN o_orderkey % 59 <> 0 THEN CASE WHEN o_orderkey % 51 = 0 THEN '88/1 Main Road ' WHEN o_orderkey % 3 = 0 THEN '7 Branch Road ' ELSE '99/1 Main Road ' END || CASE WHEN o_orderkey % 21 = 0 THEN '99999' ELSE lpad(CAST(c_nationkey * 37 + 10000 AS VARCHAR), 5, '0') END END AS customer_address, o_orderkey % 50 = 7 AS is_duplicate
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN sums ON sums.doc_id = o_orderkey
       LEFT JOIN taxes t ON t.n = c_nationkey + CASE WHEN o_orderkey % 19 = 0 THEN 77 ELSE 0 END),
bh1 AS (SELECT *, (sub_total_c * 7 + 50) // 100 AS vat_c FROM bh0),
bill_header AS (SELECT *, sub_total_c + vat_c + CASE WHEN doc_id % 31 = 0 THEN 75 ELSE 0 END AS grand_c FROM bh1),
receipt_head AS (
  SELECT 'INV' || CAST(CASE WHEN doc_id % 13 = 5 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS booked_invoice, CASE WHEN doc_id % 3 <> 0 THEN 'INV/' || CAST(doc_id AS VARCHAR) END AS paid_invoice, CAST(doc_id + 50000000 AS VARCHAR) AS booked_po, receipt_num, g.supp, n_rows, coalesce(vat_reg, other_id) AS supplier_tax
  FROM (SELECT doc_id, receipt_num, min(supp) AS supp, count(*) AS n_rows FROM active GROUP BY 1, 2) g LEFT JOIN supplier_dim s ON s.supp = g.supp),
bill_key AS (SELECT b.doc_id, invoice_num, po_number, CASE WHEN b.doc_id % 6 <> 0 THEN coalesce(vat_reg, other_id) END AS read_tax FROM bill_header b LEFT JOIN (SELECT doc_id, min(supp) AS supp FROM active GROUP BY 1) f ON f.doc_id = b.doc_id LEFT JOIN supplier_dim s ON s.supp = f.supp),
event AS (SELECT event_id, ts, user_id AS external_id, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision FROM events)
"""
