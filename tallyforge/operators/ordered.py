"""Order-dependent operators (W-*): every order is total, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def best_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """W-01, W-02, W-10, W-11: the first row of each key in the given order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def islands(df: DataFrame, keys: list[str], order: str, kind: str) -> DataFrame:
    """W-03: runs of neighbours of one kind: island number, kind, first, last, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.first(kind).alias("kind"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def wrapped(df: DataFrame, keys: list[str], order: str, starts: str, text: str) -> DataFrame:
    """W-07: rows that start nothing belong to the row before; their texts are joined."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("row_no", F.count_if(F.col(starts)).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return numbered.groupBy(*keys, "row_no").agg(joined.alias("joined"), F.count("*").alias("parts"))


def collapsed_copies(lines: DataFrame, sub_totals: DataFrame) -> DataFrame:
    """W-04, W-08: a document whose lines are k equal blocks that add up to k times its sub-total keeps the first block (the largest k).

    lines: doc_id, line_no, item, qty, amount_c; a document's lines (a few thousand at most) are held in one array.
    """
    x = F.struct("line_no", "item", "qty", "amount_c")
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(x)).alias("all")).join(sub_totals.select("doc_id", "sub_total_c"), "doc_id")
    bare = F.transform("all", lambda r: F.struct(r["item"], r["qty"], r["amount_c"]))
    n, total = F.size("all"), F.aggregate("all", F.lit(0).cast("long"), lambda a, r: a + r["amount_c"])
    docs = docs.withColumn("bare", bare).withColumn("n", n).withColumn("total", total)

    def repeats(k):
        block = F.floor(F.col("n") / k).cast("int")
        same = F.forall(F.sequence(F.lit(1), F.col("n")), lambda i: F.get("bare", i - 1).eqNullSafe(F.get("bare", (i - 1) % block)))
        return (F.col("n") % k == 0) & (F.col("total") == F.col("sub_total_c") * k) & same

    copies = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: (k > 1) & repeats(k))), F.lit(1))
    kept = docs.withColumn("copies", copies).withColumn("keep", F.slice("all", 1, F.floor(F.col("n") / F.col("copies")).cast("int")))
    return kept.select("doc_id", F.col("copies").cast("long").alias("copies"), F.posexplode("keep").alias("at", "r")).select("doc_id", "copies", (F.col("at") + 1).cast("long").alias("line_no"), "r.item", "r.qty", "r.amount_c")


def capped(df: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    """L-01, W-12: the first `cap` rows of each key, and whether there were as many or more."""
    w = Window.partitionBy(*keys)
    return df.withColumn("n_all", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= cap).withColumn("capped", F.col("n_all") >= cap)


def dealt(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows, each key's in one partition and in order; rows that are dealt by the key already are only sorted."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))  # asks for the key's dealing where repartition() would always move the rows
    return rows.withColumn("_place", place).sortWithinPartitions(*key, *order)


def codes(column: pa.Array) -> np.ndarray:
    """A number for each different value, nulls included."""
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def values(column: pa.Array) -> list:
    """The values of a column as Python's, by numpy where none is null."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, in batches that hold all rows of each of their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = codes(batch.column(key))
        last = int(np.argmax(code == code[-1]))  # where the last key begins, which may go on in the next batch
        if held and (last or held[-1].column(key)[0].as_py() != batch.column(key)[0].as_py()):
            yield pa.concat_batches([*held, batch.slice(0, last)])  # of another key, or of the rest of this one
            held, batch = [], batch.slice(last)
        elif last:
            yield batch.slice(0, last)
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def folded(rows: DataFrame, key: list[str], order: list[str], schema: str, fold: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """The rows that fold() gives for each key's rows in order, as a stream."""
    shape = to_arrow_schema(StructType.fromDDL(schema))
    names = shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in b.to_pylist())
        out: list[dict] = []
        for _, group in groupby(stream, key=lambda r: tuple(r[k] for k in key)):
            for row in fold(group):
                out.append({n: row.get(n) for n in names})
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_pylist(out, shape)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, shape)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
