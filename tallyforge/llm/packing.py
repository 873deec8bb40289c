"""Variable-capacity best-fit packing: several permitted sequence lengths, filled jointly.

Items go in order of falling length into the open bin with the least room that still holds them. If
none does, the bin size opens that costs least for what it can be expected to hold: a bin of
capacity c costs c plus a fixed overhead, and the item plus the shorter ones still to come, up to c,
are what it is spread over. At the end each bin is downsized to the smallest capacity that holds its
contents. A document longer than the largest capacity is cut into pieces; whole pieces fill a bin
each, and the rest is packed like any other. Nothing is cut off or left out.

Packing runs in groups of about GROUP_ITEMS pieces dealt by a hash of id, piece and the row's place in
the input, so a task's memory is bounded, and a hot source, a repeated or missing id or a very long
text spreads over all groups. With `ordered` the
groups are consecutive ranges of pieces in the rows' own order (that of their files and the rows in
them), numbered in that order, and so are a group's bins by the first piece in them. Lengths are words
plus an end mark. A null or empty text is one item of length 1; repeated rows are packed as often as
they come; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import common, mixing

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 32
GROUP_ITEMS = 4096
SCHEMA = "doc_id long, piece int, length int, bin_id long, capacity int, start int"


def words(text: Column) -> Column:
    """Words and an end mark."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1


def best_fit(lengths: list[int], capacities: tuple[int, ...], overhead: int = OVERHEAD) -> list[tuple[int, int, int]]:
    """Bin, its capacity and the place in it of each item; lengths must fall, and none exceed the largest capacity."""
    rest, room, used, size, placed = sum(lengths), [], [], [], []
    for n in lengths:
        rest -= n
        at = bisect_left(room, (n, -1))
        if at < len(room):
            _, b = room.pop(at)
        else:
            fits = [c for c in capacities if c >= n]
            c = min(fits, key=lambda c: ((c + overhead) / (n + min(c - n, rest)), c))
            b = len(used)
            used.append(0)
            size.append(c)
        placed.append((b, used[b]))
        used[b] += n
        if size[b] > used[b]:
            insort(room, (size[b] - used[b], b))
    final = [min(c for c in capacities if c >= u) for u in used]
    return [(b, final[b], start) for b, start in placed]


def in_order(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, n (words), past: pieces of all rows that come before, in the order of files (else of partitions) and the rows in them."""
    n = words(F.col("text"))
    pieces = F.floor((F.col("n") - 1) / most) + 1
    try:
        rows = docs.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"))
    except AnalysisException:  # not read from files
        rows = docs.select(F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("file"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"))
    rows = common.stored(rows.withColumn("pieces", pieces))  # no texts
    files = rows.groupBy("file").agg(F.count("*").alias("held"), F.min("row").alias("least"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.select("file", (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("least")).alias("base"))
    placed = rows.join(files, "file").select("doc_id", "n", "pieces", (F.col("row") + F.col("base")).alias("place"), F.lit(0).alias("all"))
    return mixing.before(placed, "all", "place", [], "pieces", "past").select("doc_id", "n", "past")


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group_items: int = GROUP_ITEMS, ordered: bool = False) -> DataFrame:
    """doc_id, piece, length, bin_id, capacity, start for each piece of each row of docs (doc_id, text)."""
    capacities = tuple(sorted(set(capacities)))
    most = capacities[-1]
    if ordered:
        items = in_order(docs, most)
    else:
        items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("n"), F.monotonically_increasing_id().alias("past"))
    pieces = items.select("doc_id", "n", "past", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("past") + F.col("piece")).alias("number"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("length"))
    if ordered:
        dealt = pieces.withColumn("part", F.floor(F.col("number") / group_items))
    else:
        pieces = common.stored(pieces)  # no texts
        groups = max(1, -(-pieces.count() // group_items))
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "number"), F.lit(groups)))
    ties = ["number"] if ordered else ["doc_id", "piece", "number"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *ties], ascending=[False, *(True for _ in ties)], kind="stable", ignore_index=True)
        found = best_fit(pdf["length"].tolist(), capacities, overhead)
        bins, size, start = (list(x) for x in zip(*found, strict=True))
        if ordered:  # bins by the first piece in them
            number = pdf["number"].groupby(bins).min().rank().astype(int) - 1
            bins = [number[b] for b in bins]
        first = int(pdf["part"].iloc[0]) << 32
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"], "length": pdf["length"], "bin_id": [first + b for b in bins], "capacity": size, "start": start})

    return dealt.groupBy("part").applyInPandas(run, SCHEMA)
