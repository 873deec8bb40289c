"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has a bit set where over half of its shingles' XXH64 values have it set.
Two 64-bit fingerprints within `distance` 3 agree to within one bit on their upper or lower half,
so each distinct fingerprint looks up the 33 members of the radius-1 Hamming ball around each of
its halves in the table of halves, and every candidate's complete distance is verified in the join.
Halves (rather than narrow segments) keep a table key selective: random matches per probe are
N / 2**32.

Only distinct fingerprints take part; equal ones are linked by the grouping itself. Nulls and
texts without words have fingerprint zero and are linked like any other; an empty table gives an
empty result; repeated rows and ties share a class whose id is the smallest doc_id in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import common

SEED = 42
HALF = 32


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    found = text.lower().split()  # on bytes: A-Z only, and exactly space and \t..\r
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[: -words].tolist()]
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, words: int) -> int:
    hashes, total, ones = shingle_hashes(text, words), 0, np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) >> 16)):  # bounded memory on very long texts
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint as a signed 64-bit integer, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "t"):
            bits = [fingerprint(t, words) for t in common.byte_texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(bits, pa.int64())], names=["doc_id", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, bits long")


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """u, v: pairs of different fingerprints (column bits) at most `distance` (3 at most) bits apart."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of radius 1 find distances up to 3")
    upper, lower = F.shiftrightunsigned("bits", HALF), F.col("bits").bitwiseAND((1 << HALF) - 1)
    tagged = lambda half, side: half * 2 + side  # noqa: E731  one key space for both tables
    table = distinct.select(F.explode(F.array(tagged(upper, 0), tagged(lower, 1))).alias("key"), F.col("bits").alias("v"))
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(HALF)))
    around = F.concat(F.transform(ball, lambda m: tagged(upper.bitwiseXOR(m), 0)), F.transform(ball, lambda m: tagged(lower.bitwiseXOR(m), 1)))
    probe = distinct.select(F.explode(around).alias("key"), F.col("bits").alias("u"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    return probe.join(table, (probe["key"] == table["key"]) & (F.col("u") > F.col("v")) & near).select("u", "v")


def classes(prints: DataFrame, distance: int = 3) -> DataFrame:
    """bits, component_id (smallest doc_id reachable), members, from one row per document (doc_id, bits)."""
    groups = common.stored(prints.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")))
    joined = common.components(links(groups.select("bits"), distance)).select(F.col("node").alias("bits"), "component")
    labelled = common.stored(groups.join(joined, "bits", "left").withColumn("component", F.coalesce("component", "bits")))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("members").alias("component_size"))
    return labelled.join(least, "component").select("bits", "component_id", "component_size")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id, component_size, for every row."""
    prints = common.stored(fingerprints(docs, words, id_col, text_col))
    named = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return prints.join(classes(prints, distance), "bits").select("doc_id", named.alias("fingerprint"), "component_id", "component_size")
