"""Exact dedup of incoming batches against immutable snapshots, screened by static binary-fuse filters.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] is replaced by one space; null
counts as empty. A snapshot's distinct digests are dealt to buckets by hash, and each bucket gets
one filter that is never changed. An incoming batch groups its own duplicates first, so that a text
that makes up a third of the batch is one digest from then on; each distinct digest is probed in
its bucket, and only positives join the snapshot's exact digests, where the texts' bytes decide: just
the texts of positives are moved, which a bitmap of their ids picks out. What is new makes a
snapshot of its own with filters of its own; the older ones never change.

An empty batch or snapshot gives an empty result or no positives; of rows with equal text and the
same least doc_id all carry that keep_id, and `kept` is true of each of them (repeated rows can't be
told apart; deduplicate on doc_id after it where ids repeat). Rows without an id never give their
group's keep_id if another row has one, and aren't kept then; in a group without any id keep_id is
null and every row is `kept`. A text that can't be found by an id is taken to be equal by its digest.
Texts of any length are compared whole. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import common, fuse

SPACES = r"[\x20\x09-\x0D]+"
#: Digests of one filter; there are LEAST_BUCKETS at least.
FILTER_KEYS = 100_000
LEAST_BUCKETS = 256
FILTER_SCHEMA = "bucket int, n long, seed long, cells binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("bucket")


def filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter a bucket of a snapshot's digests (column digest, distinct)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(_keys(pdf["digest"]))
        seed, cells = fuse.build(keys)
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "n": [len(keys)], "seed": [seed], "cells": [cells]})

    return snapshot.select(_bucket(buckets), "digest").groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(digests: DataFrame, built: DataFrame, buckets: int) -> DataFrame:
    """The rows of `digests` (column digest, distinct) that the filters can't rule out."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(left), bool)
        if len(left):
            for row in right.itertuples():
                maybe |= fuse.contains(_keys(left["digest"]), row.n, row.seed, row.cells)
        return left.loc[maybe, ["digest"]]

    return digests.select(_bucket(buckets), "digest").groupBy("bucket").cogroup(built.groupBy("bucket")).applyInPandas(probe, "digest binary")


def group(rows: DataFrame) -> DataFrame:
    """digest, keep_id, size: a batch's own duplicates, from (doc_id, digest)."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size"))


def ingest(batch: DataFrame, snapshot: DataFrame, built: DataFrame, buckets: int, texts: DataFrame) -> DataFrame:
    """digest, new_id, new_size, held_id of the batch's digests that the snapshot holds, by their texts' bytes.

    batch, snapshot: as group() returns them; built: the snapshot's filters; texts: doc_id and text of
    all their rows.
    """
    positive = screen(batch, built, buckets)
    held = snapshot.select("digest", F.col("keep_id").alias("held_id"))
    pairs = common.stored(positive.join(batch, "digest").join(held, "digest").select("digest", F.col("keep_id").alias("new_id"), F.col("size").alias("new_size"), "held_id"))
    wanted = pairs.select("digest", F.explode(F.array("new_id", "held_id")).alias("doc_id")).where("doc_id is not null")
    hashed = F.xxhash64("doc_id").alias("hash")
    some = common.screened(texts.select("doc_id", "text", hashed), "hash", wanted.select(hashed), "hash")
    found = some.join(wanted, "doc_id").select("digest", normalised(F.col("text")).alias("text")).where(F.unhex(F.sha2("text", 256)) == F.col("digest"))
    # the least and the greatest of a pair's texts are the same bytes
    unequal = found.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest")
    return pairs.join(unequal, "digest", "left_anti")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def exact_duplicates(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    The table arrives as `batches` batches in doc_id order; each is ingested against the snapshots
    of all before it, so the row with the smallest doc_id stays.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = common.stored(texts.select("doc_id", digest(F.col("text")).alias("digest")))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    number = sum((F.when(F.col("doc_id") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    snapshots: list[tuple[DataFrame, DataFrame, int]] = []
    again = []
    for i in range(len(cuts) + 1):
        batch = common.stored(group(rows.where(number == i)))
        if snapshots:
            held = common.stored(union([ingest(batch, *snapshot, texts) for snapshot in snapshots]))
            again.append(held)
            batch = batch.join(held.select("digest"), "digest", "left_anti")
        if i < len(cuts):
            batch = common.stored(batch)
            buckets = max(LEAST_BUCKETS, -(-batch.count() // FILTER_KEYS))
            snapshots.append((batch, common.stored(filters(batch, buckets)), buckets))
        else:
            last = batch
    known = union([*(s for s, _, _ in snapshots), last])
    if again:
        more = union(again).groupBy("digest").agg(F.min("new_id").alias("new_id"), F.sum("new_size").alias("new_size"))
        known = known.join(more, "digest", "left").select("digest", F.least("keep_id", "new_id").alias("keep_id"), (F.col("size") + F.coalesce("new_size", F.lit(0))).alias("size"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.join(known, "digest").select("doc_id", "keep_id", F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
