"""Receipt lookups (J-01..J-13): equi-joins on keys and spellings of keys, and cascades as prioritised unions.

keys: a row a document with doc_id, invoice_num, po_number and read_tax (the supplier's tax id as it
was read, or null). heads: a row a receipt with booked_invoice, paid_invoice, booked_po,
supplier_tax, receipt_num, supp and n_rows. An invoice number alone never finds a receipt: suppliers
share numbers, so it is joined together with the purchase order or the tax id. A cascade runs every
lookup over all documents at once and keeps, for each document, the rows of the first that found
any: one window over (document, priority), no loop over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import config
from tallyforge.functions import normalize as N

FOUND = ("doc_id", "receipt_num", "n_rows", "supp")


def spelled(keys: DataFrame, policy: config.Policy = config.Policy()) -> DataFrame:
    """keys with a row for each spelling of each document's invoice number (F-26)."""
    return keys.select("*", F.posexplode(N.variants(N.invoice_number(F.regexp_replace("invoice_num", "-", "/")), policy.variants)).alias("place", "spelling"))


def _best(hits: DataFrame) -> DataFrame:
    """One row a document and receipt: EXACT if the number was booked as it is written, else NORMALIZED."""
    return hits.groupBy(*FOUND).agg(F.when(F.min("place") == 0, "EXACT").otherwise("NORMALIZED").alias("match_mode"))


def with_tax(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """J-05: keys whose read_tax, where it is missing, is that of the purchase order's supplier (of several the least)."""
    known = heads.groupBy(F.col("booked_po").alias("po_number")).agg(F.min("supplier_tax").alias("po_tax"))
    return keys.join(known, "po_number", "left").withColumn("read_tax", F.coalesce("read_tax", "po_tax")).drop("po_tax")


def by_po_invoice(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """J-02: receipts of the document's purchase order that were booked under one of its spellings."""
    return _best(spelled(keys).join(heads, (F.col("spelling") == F.col("booked_invoice")) & (F.col("po_number") == F.col("booked_po"))))


def by_tax_invoice(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """J-04: receipts of the supplier's tax id that were booked under one of the spellings."""
    return _best(spelled(keys).join(heads, (F.col("spelling") == F.col("booked_invoice")) & (F.col("read_tax") == F.col("supplier_tax"))))


def columned(heads: DataFrame, columns: tuple[str, ...] = ("booked_invoice", "paid_invoice")) -> DataFrame:
    """heads with a row for each column that holds an invoice number: number, column and its place."""
    pairs = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.col(c).alias("number")) for i, c in enumerate(columns)))
    return heads.select("*", F.explode(pairs).alias("x")).select("*", "x.*").where("number is not null")


def by_tax_columns(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """J-06, F-41: receipts of the tax id with one of the spellings in any of the columns; match_mode is the first column that has it."""
    hits = spelled(keys).join(columned(heads), (F.col("spelling") == F.col("number")) & (F.col("read_tax") == F.col("supplier_tax")))
    return hits.groupBy(*FOUND).agg(F.min_by("column", "at").alias("match_mode"))


def unified(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """J-01: receipts of the tax id as it was read, booked or paid under one of the spellings."""
    return _best(spelled(keys).join(columned(heads), (F.col("spelling") == F.col("number")) & (F.col("read_tax") == F.col("supplier_tax"))))


def by_po(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """J-07."""
    return keys.join(heads, F.col("po_number") == F.col("booked_po")).select(*FOUND, F.lit("PO").alias("match_mode"))


def by_prefix(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """J-03: receipts of the purchase order by a header that may be a composite key (column composite): the invoice number as written, another spelling of it, or a key that begins with it and holds the order; the best of these counts."""
    h = heads.where("composite is not null")
    own = h.join(spelled(keys), (F.col("spelling") == F.col("composite")) & (F.col("po_number") == F.col("booked_po"))).select(*FOUND, F.when(F.col("place") == 0, 0).otherwise(1).alias("rank"))
    keyed = h.withColumn("prefix", F.substring_index("composite", "-", 1)).where("prefix <> composite")
    begun = keys.select("doc_id", "po_number", N.letters_key(F.col("invoice_num")).alias("key")).join(keyed, (F.col("key") == F.col("prefix")) & F.col("composite").contains(F.col("po_number"))).select(*FOUND, F.lit(2).alias("rank"))
    best = own.unionByName(begun).groupBy(*FOUND).agg(F.min("rank").alias("rank"))
    return best.select(*FOUND, F.when(F.col("rank") == 0, "EXACT").when(F.col("rank") == 1, "NORMALIZED").otherwise("PREFIX").alias("match_mode"))


def cascade(*levels: DataFrame) -> DataFrame:
    """J-08..J-10, T-07: of the levels' rows those of each document's first level that has any."""
    every = None
    for i, level in enumerate(levels):
        own = level.withColumn("level", F.lit(i + 1).cast("long"))
        every = own if every is None else every.unionByName(own)
    first = F.min("level").over(Window.partitionBy("doc_id"))
    return every.withColumn("first", first).where("level = first").drop("first")


def legacy(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """J-09: by purchase order and invoice, then by the purchase order's supplier and invoice."""
    return cascade(by_po_invoice(keys, heads), by_tax_invoice(with_tax(keys.withColumn("read_tax", F.lit(None).cast("string")), heads), heads))


def by_tax_or_po(keys: DataFrame, heads: DataFrame, valid: Column | None = None) -> DataFrame:
    """J-10: by tax id and invoice (the id as read, if `valid` holds, else the purchase order's supplier's), then by purchase order; documents without any spelling aren't looked up."""
    own = keys if valid is None else keys.withColumn("read_tax", F.when(valid, F.col("read_tax")))
    asked = spelled(own).select("doc_id").distinct()
    return cascade(by_tax_columns(with_tax(own, heads), heads), by_po(keys.join(asked, "doc_id", "left_semi"), heads))


def supplier_tax(receipts: DataFrame, supplier: DataFrame) -> DataFrame:
    """J-05: a purchase order's supplier tax id: the registration if there is one, else the other id; of several suppliers the first."""
    first = receipts.groupBy("doc_id").agg(F.min("supp").alias("supp"))
    return first.join(supplier, "supp").select("doc_id", "supp", F.coalesce("vat_reg", "other_id").alias("supplier_tax"))


def intercompany(header: DataFrame, entity: DataFrame) -> DataFrame:
    """J-13: documents whose buyer's tax id is one of the group's."""
    return header.join(F.broadcast(entity.select(F.col("tax_id").alias("customer_tax_id"))), "customer_tax_id", "left_semi").select("doc_id", "customer_tax_id")


def entity_keys(entity: DataFrame) -> DataFrame:
    """C-22: entities by organisation and by operating unit, the first of equal keys."""
    units = entity.select(F.col("unit_id").alias("key"), "legal_name", "tax_id", F.lit(1).alias("prio"))
    every = entity.select(F.col("org_id").alias("key"), "legal_name", "tax_id", F.lit(0).alias("prio")).unionByName(units)
    best = F.row_number().over(Window.partitionBy("key").orderBy("prio", "legal_name"))
    return every.withColumn("place", best).where("place = 1").select("key", "legal_name", "tax_id")
