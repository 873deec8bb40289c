"""What the corpus operators share: reading, bounded Arrow slices, shared-folder checkpoints, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at a time; one longer text stands alone.
SLICE_BYTES = 1 << 20
#: Bits of a bitmap by which rows are screened before a join; a false hit costs time, never a result.
SCREEN_BITS = 1 << 26


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    path = context._jvm.org.apache.hadoop.fs.Path(found)  # a path without a scheme is on Spark's own default file system, not on each executor's disk
    return found if ":" in found.split("/")[0] else path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI (file, hdfs, s3, ...) and the path in it."""
    if not urlparse(folder).scheme:
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(folder).path)
    return pafs.FileSystem.from_uri(folder)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once: later reads survive lost executors and don't compute it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Within it, the session has these settings; what is run later has the caller's again."""
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Python workers get batches of few rows, so that buffers outside the heap stay small."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)})


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """A query's shuffle files go when its result is written, not when the driver happens to collect garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def width(hashes: int) -> int:
    """Bits of a bitmap for so many hashes: over 32 for each, as far as SCREEN_BITS goes."""
    return min(SCREEN_BITS, max(1 << 15, 1 << (32 * hashes).bit_length()))


def bitmap(values: DataFrame, column: str, wide: int = SCREEN_BITS) -> np.ndarray:
    """`wide` bits, set at the low bits of the hashes in a column; the driver gets wide / 8 bytes at most."""
    cell = (F.col(column).bitwiseAND(wide - 1) + 1).alias("cell")
    found = values.select(cell).groupBy(F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect()
    screen = np.zeros(wide // 8, np.uint8)
    for part, bits in found:
        screen[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bits, np.uint8)
    return screen


def bit(screen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes.astype(np.uint64) & np.uint64(len(screen) * 8 - 1)
    return (screen[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def screened(df: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    """The rows of df whose hash in a column may be among values' in `name`, which are counted first; only that column goes to Python."""
    held = df.sparkSession.sparkContext.broadcast(bitmap(values, name, width(values.count())))

    @F.pandas_udf("boolean")
    def there(hashes: pd.Series) -> pd.Series:
        return pd.Series(bit(held.value, hashes.to_numpy(np.int64)))

    return df.where(there(column))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `column` each, or of one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node that it reaches) for the nodes of `edges` (u, v), by alternating large and small stars.

    A star's neighbours are never gathered: each round takes a node's least neighbour by a
    partial aggregate and hands it on by a join, which AQE splits where a node is hot.
    Each round is written to the shared folder. Self-loops and nulls are ignored; empty gives empty.
    """
    least = lambda df: df.groupBy("u").agg(F.min("v").alias("m"))
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both).withColumn("m", F.least("u", "m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = least(large)
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v"))
        edges = stored(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("v", F.col("u"))
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def written(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """df as Parquet in the shared folder: a stage's end, whose rows stay as they are; its shuffle files go."""
    at = at or scratch(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def erase(spark: SparkSession, at: str) -> None:
    """Removes a scratch folder that nothing will read again."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
