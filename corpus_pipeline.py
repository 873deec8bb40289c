"""The corpus pipeline: quality, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns
the columns of documents (the last one: the packed pieces). run() writes each stage's result and
reads it again. Rows whose texts are null or empty are scored, deduplicated and packed like others,
and so are very long ones, whole. Of equal texts, or of near ones, the row of smallest doc_id stays; rows
without an id stay if no row with one has their text; repeated rows become one in the exact stage. Extra
columns, whatever their names, pass through; an empty table passes all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common, exact_dedup, mixing, packing, quality, resemblance, simhash

#: Near duplicates: shingles of five words, of similarity 0.8 (resemblance.NUMBER / OF) or more.
NEAR_WORDS = 5


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    return name if name not in df.columns else unused(df, f"{name}_")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where(~quality.held_out())
    return quality.keep(docs, quality.train(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group of equal texts; of a group without ids, or of rows of the same id and text, any one."""
    stay = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest")).distinct()
    own = unused(docs, "digest")
    marked = docs.withColumn(own, exact_dedup.digest(F.col("text")))
    kept = marked.join(stay, docs["doc_id"].eqNullSafe(stay["id"]) & (marked[own] == stay["digest"]), "left_semi")
    return kept.dropDuplicates([own]).drop(own)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of smallest doc_id, or, where none has an id, that of least mark.

    SimHash (operator 9) proposes a link of each text to the least one of its class, an exact check follows; then
    prefixes find what SimHash misses, among texts that are in different classes still."""
    with common.freed_shuffles(spark):
        found = simhash.near_duplicates(resemblance.marked(docs), id_col="mark")
        rows = resemblance.classes(docs, NEAR_WORDS, found.select(F.col("doc_id").alias("mark"), F.col("component_id").alias("other")))
    stay = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("mark").alias("of"))).alias("least")).select("least.id", "least.of")
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["id"]) & (resemblance.mark(docs["text"]) == stay["of"]), "left_semi")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """All documents, in files ordered by their blocks' slots in the mix; weights: as mixing.mix() takes them. Rows of one id and source get the first of their slots."""
    slots = mixing.mix(docs, weights).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("from")).agg(F.min("slot").alias("at"))
    placed = docs.join(slots, docs["doc_id"].eqNullSafe(slots["id"]) & docs["source"].eqNullSafe(slots["from"]))
    own = unused(docs, "slot")
    placed = placed.select(docs["*"], slots["at"].alias(own))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, own, "doc_id").sortWithinPartitions(own, "doc_id").drop(own)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences by consecutive ranges of the mixed order, which the rows' files carry."""
    return packing.pack(docs, ordered=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: The stages train a model and follow links, which SQL can't express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        at = common.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
