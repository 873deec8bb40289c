"""Document catalogues (C-11..C-17, C-24) and binary files (C-14, C-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tagged(docs: DataFrame, tags: list[int], every: bool = False, without: list[int] | None = None) -> DataFrame:
    """C-11, C-16: documents with one (or all) of the tags and none of the others. docs: tags array<int>."""
    want = F.array(*map(F.lit, tags)).cast("array<int>")
    found = F.size(F.array_intersect("tags", want)) == len(set(tags)) if every else F.arrays_overlap("tags", want)
    if without:
        found = found & ~F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, without)).cast("array<int>")), F.lit(False))
    return docs.where(found)


def next_document(docs: DataFrame, tag: int, without: int) -> DataFrame:
    """C-15: the newest document of a work queue."""
    return tagged(docs, [tag], without=[without]).orderBy(F.desc("created"), F.desc("id")).limit(1)


def tag_ids(tags: DataFrame, names: list[str], contains: bool = False) -> DataFrame:
    """C-12."""
    low = F.lower("name")
    cond = None
    for n in names:
        one = low.contains(n.lower()) if contains else low == n.lower()
        cond = one if cond is None else cond | one
    return tags.where(cond if cond is not None else F.lit(False))


def with_tag_names(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """C-17, J-33: names for tag ids, tag-<id> for those unknown; the first 200 characters of the content."""
    flat = docs.select("id", F.posexplode_outer("tags").alias("at", "tag"))
    named = flat.join(tags.select(F.col("id").alias("tag"), "name"), "tag", "left")
    label = F.when(F.col("tag").isNotNull(), F.coalesce("name", F.concat(F.lit("tag-"), F.col("tag").cast("string"))))
    names = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", label.alias("label")))), lambda x: x["label"]).alias("tag_names"))
    return docs.join(names, "id").select("id", "tag_names", F.substring("content", 1, 200).alias("preview"))


def file_class(name: Column, mime: Column) -> Column:
    """C-13."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when((mime == "application/pdf") | n.endswith(".pdf"), "pdf").when(F.coalesce(mime, F.lit("")).startswith("image/") | n.rlike(r"\.(png|jpe?g|tiff?)$"), "image").otherwise("other")


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """C-14, C-18: path, sha256, length, is_pdf of files; the bytes stay in the column `content` and are read only where it is used."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 4) == F.lit("%PDF").cast("binary")).alias("is_pdf"), "content")
