"""Near-duplicate vectors: spherical k-means cells, blocked cosine products in them, one vector kept a group.

1. Equal vectors become one point with a multiplicity, so a vector that a third of all rows share
   costs no more than any other.
2. Spherical k-means is fitted on at most SAMPLE_ROWS points (those of least digest); there are
   about as many cells as the square root of the number of points, MOST_CELLS at most.
3. Every point has a home, the cell of the nearest centroid, and visits the VISITS - 1 next ones.
   Two points are compared if one's home is among the cells that the other is in: once in all.
4. A cell's points are packed into blocks of at most BLOCK_ROWS; pairs of blocks of a cell meet in a join on
   the cell, which AQE splits where a cell is hot, and are compared by one matrix product in
   double precision. What leaves a pair of blocks is a count a linked point and a spanning forest of
   its links, never the links themselves.
5. Components of the forests' edges, by least-neighbour rounds.

Links have a cosine of at least `threshold`, all of them; points of a pair that lies across cells which
neither visits are missed (recall against brute force: see the tests and the README). A vector that is
null, empty or zero, or holds null or non-finite components, links with nothing and is its own class. A shorter vector
compares as if it ended in zeros. Rows of one vec_id, and equal vectors, are different rows that link
like any others; rows without vec_id get the class id of the others in their class (null if none has one) and aren't
kept. Very large or small components are scaled before they are squared. An empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common

THRESHOLD = 0.9
#: Cells that a point is compared in: its home and the next nearest.
VISITS = 6
#: Bounds of what is fitted on the driver: points, bytes of their components, cells.
SAMPLE_ROWS = 40_000
SAMPLE_BYTES = 48 << 20
MOST_CELLS = 8192
ROUNDS = 8
#: Points in one side of a matrix product.
BLOCK_ROWS = 1024

#: The product's input grows with the square of a partition: none is merged with others, and hot ones are split early.
JOIN_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a list column, ended by zeros (rows x longest); their lengths; whether each can be compared."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    usable = np.isfinite(out).all(axis=1) & (out != 0).any(axis=1)
    return out + 0.0, lengths, usable  # -0.0 becomes 0.0


def units(packed: list[bytes], kind: str, wide: int) -> np.ndarray:
    """Unit vectors of `wide` components from packed ones."""
    out = np.zeros((len(packed), wide))
    for i, p in enumerate(packed):
        v = np.frombuffer(p, kind)
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def digests(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """vec_id, digest (null for a vector that can't be compared), vec (packed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths, usable = rows_of(batch.column("v"))
            packed = [v[:n].astype(kind).tobytes() if u else None for v, n, u in zip(values, lengths, usable, strict=True)]
            marks = [None if p is None else blake2b(p, digest_size=16).digest() for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(marks, pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "digest", "vec"])

    as_ = "array<float>" if kind == "<f4" else "array<double>"
    return vectors.select(F.col(id_col).cast("long").alias("d"), F.col(vector_col).cast(as_).alias("v")).mapInArrow(run, "vec_id long, digest binary, vec binary")


def fit(points: DataFrame, n: int, kind: str, wide: int) -> np.ndarray:
    """Centroids of spherical k-means on a bounded sample, the points of least digest."""
    cells = max(1, min(MOST_CELLS, isqrt(n), SAMPLE_BYTES // (8 * wide) // 4))
    most = max(cells, min(SAMPLE_ROWS, 50 * cells, SAMPLE_BYTES // (8 * wide)))
    sample = units([bytes(r[0]) for r in points.orderBy("digest").select("vec").limit(most).collect()], kind, wide)
    centres = sample[:cells].copy()
    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        for i in range(0, len(sample), 4096):
            part = sample[i : i + 4096]
            np.add.at(sums, (part @ centres.T).argmax(axis=1), part)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return centres


PLACED = "cell int, home boolean, node long, many long, homes int, cells binary, vec binary"


def placed(points: DataFrame, centres: np.ndarray, kind: str, wide: int) -> DataFrame:
    """A row for each point and cell that it is in."""
    held = points.sparkSession.sparkContext.broadcast(centres)
    visits = min(VISITS, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                near = units(batch.column("vec").to_pylist(), kind, wide) @ held.value.T
                order = np.argpartition(-near, visits - 1, axis=1)[:, :visits]
                order = np.take_along_axis(order, np.argsort(-np.take_along_axis(near, order, axis=1), axis=1, kind="stable"), axis=1).astype("<i4")
                n = batch.num_rows
                takes = pa.array(np.repeat(np.arange(n), visits))
                again = lambda name, b=batch, t=takes: b.column(name).take(t)
                lists = pa.array([o.tobytes() for o in order], pa.binary()).take(takes)
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel()), pa.array(np.tile(np.arange(visits) == 0, n)), again("node"), again("many"), pa.array(np.repeat(order[:, 0], visits)), lists, again("vec")], names=["cell", "home", "node", "many", "homes", "cells", "vec"])

    return points.select("node", "many", "vec").mapInArrow(run, PLACED)


BLOCK = "cell int, home boolean, nodes binary, many binary, homes binary, cells binary, vecs array<binary>"


def blocks(rows: DataFrame, share: DataFrame, parts: int) -> DataFrame:
    """At most BLOCK_ROWS rows of one cell and kind in each block; large cells are dealt over several tasks by `share` (cell, slots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, size = None, 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            raw = lambda name, k: t.column(name).to_numpy().astype(k).tobytes()
            one = {"cell": pa.array([at[0]], pa.int32()), "home": pa.array([at[1]]), "nodes": [raw("node", "<i8")], "many": [raw("many", "<i8")], "homes": [raw("homes", "<i4")], "cells": [b"".join(t.column("cells").to_pylist())], "vecs": pa.array([t.column("vec").to_pylist()], pa.list_(pa.binary()))}
            return pa.RecordBatch.from_pydict(one)

        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(cells)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    now = (int(cells[a]), bool(kinds[a]))
                    if held and (now != at or size >= BLOCK_ROWS):
                        yield block()
                        held, size = [], 0
                    n = min(b - a, BLOCK_ROWS - size)
                    at, size = now, size + n
                    held.append(batch.slice(a, n))
                    a += n
        if held:
            yield block()

    dealt = rows.join(F.broadcast(share), "cell").withColumn("slot", F.pmod(F.hash("node"), F.col("slots")))  # share: a row a cell, MOST_CELLS at most
    return dealt.repartition(parts, "cell", "slot").sortWithinPartitions("cell", "home").drop("slots", "slot").mapInArrow(run, BLOCK)


def forest(i: np.ndarray, j: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between places i and j of nodes: each linked place's node and the node of the first place that it reaches."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    mine = np.unique(np.concatenate([i, j]))
    mine = mine[label[mine] != mine]
    return nodes[mine], nodes[label[mine]]


FOUND = "node long, n long, other long"


def compared(pairs: DataFrame, threshold: float, kind: str, wide: int, visits: int) -> DataFrame:
    """node, n for linked points (rows that each links with, in one pair of blocks); node, other for the edges of spanning forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros((0, wide)))
        for batch in batches:
            for r in batch.to_pylist():
                nodes, others = np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["o_nodes"], "<i8")
                if last[0] != r["nodes"]:
                    last = (r["nodes"], units(r["vecs"], kind, wide))
                same = r["block"] == r["o_block"]
                right = last[1] if same else units(r["o_vecs"], kind, wide)
                i, j = np.nonzero(last[1] @ right.T >= threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                elif not r["o_home"] and len(i):
                    # the right ones visit: two points that visit each other's home are compared in the lower of both
                    cells, homes = np.frombuffer(r["cells"], "<i4").reshape(-1, visits), np.frombuffer(r["o_homes"], "<i4")
                    once = ~((homes[j] < r["cell"]) & (cells[i] == homes[j][:, None]).any(axis=1))
                    i, j = i[once], j[once]
                if not len(i):
                    continue
                many, o_many = np.frombuffer(r["many"], "<i8"), np.frombuffer(r["o_many"], "<i8")
                left, over = np.zeros(len(nodes), np.int64), np.zeros(len(others), np.int64)
                np.add.at(left, i, o_many[j])
                np.add.at(over, j, many[i])
                both, counts = np.concatenate([nodes, others]), np.concatenate([left, over])
                u, v = forest(i, j + (0 if same else len(nodes)), both)
                both, counts = both[counts > 0], counts[counts > 0]
                none = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(counts), none(len(both))], names=["node", "n", "other"])
                yield pa.RecordBatch.from_arrays([pa.array(u), none(len(u)), pa.array(v)], names=["node", "n", "other"])

    return pairs.mapInArrow(run, FOUND)


def linked(points: DataFrame, n: int, wide: int, threshold: float, kind: str) -> DataFrame:
    """FOUND rows of all points."""
    spark = points.sparkSession
    centres = fit(points, n, kind, wide)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (64 * BLOCK_ROWS))
    rows = placed(points, centres, kind, wide)
    sizes = placed(points.sample(min(1.0, 400 * len(centres) / max(n, 1)), seed=1), centres, kind, wide).groupBy("cell").agg(F.count("*").alias("seen"))
    scale = max(1.0, n / (400 * len(centres)))
    cells = spark.range(len(centres)).select(F.col("id").cast("int").alias("cell")).join(sizes, "cell", "left")
    share = cells.select("cell", (F.floor(F.coalesce("seen", F.lit(0)) * scale / (4 * BLOCK_ROWS)) + 1).cast("int").alias("slots"))
    packed = common.written(blocks(rows, share, parts).withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
    right = packed.select("cell", *(F.col(c).alias(f"o_{c}") for c in packed.columns if c not in ("cell", "cells")))
    with common.settings(spark, JOIN_SETTINGS):
        pairs = packed.where("home").hint("merge").join(right, "cell").where("not o_home or o_block >= block")
        return common.written(compared(pairs, threshold, kind, wide, min(VISITS, len(centres))), "vector-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark: SparkSession = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = digests(vectors, id_col, vector_col, kind)
    distinct = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("many"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    points = common.written(distinct.withColumn("node", F.monotonically_increasing_id()), "points")
    n, wide = points.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(0))).first()
    if n:
        found = linked(points, n, wide // int(kind[2]), threshold, kind)
    else:
        found = spark.createDataFrame([], FOUND)
    counts = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    classes = common.components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    known = points.select("node", "digest", "many", "least").join(counts, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    info = known.join(least, "component").select("digest", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "digest").join(info, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
