"""How the sources of a language differ in their words, all relational and in exact integers.

A term is a run of characters other than ASCII that isn't a letter, A-Z lower-cased. A language keeps
the terms that at least `min_docs` of its documents hold (V of them). With N occurrences of kept terms,
a group (language and source), or a language, gives a term that it holds c times the share
p = 1 + floor(10^9 (c + 2) / (N + 2 V)); two shares differ by floor((p - q)^2 / (p + q)).

Steps: occurrences and documents are counted by (lang, source, term) before and after one shuffle; the
kept rows are written once. Groups meet the vocabulary of their language, dealt by salt, so that a
term which a group lacks has a row; a self-join on (lang, term) compares each two groups once (the
difference is symmetric). Per-group ranks of terms are cut to `top` before rows are shuffled.

Null lang, source and text are ''. A group without kept terms has N = 0; where V = 0, pairs have the value
0. Empty and very long texts are counted like others, repeated rows each count as a document, ties
are ranked by the item's UTF-8; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import common

#: What stands between terms: all ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP = 10
#: Parts into which a language's vocabulary is dealt when groups meet it.
SALTS = 64


def blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def groups(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, source, key of every group; and the seed with which the keys of all differ."""
    found = common.written(docs.select(blank("lang"), blank("source")).distinct(), "groups")
    for seed in range(100):
        keyed = found.withColumn("key", key(seed))
        if keyed.agg(F.count("*") == F.count_distinct("key")).first()[0]:
            return keyed, seed
    raise RuntimeError("no seed keeps the groups apart")


def key(seed: int) -> Column:
    """A number for a group: rows are counted by it instead of by two more strings."""
    return F.xxhash64(F.lit(seed), blank("lang"), blank("source")).alias("key")


def counts(docs: DataFrame, seed: int) -> DataFrame:
    """key, term, n (occurrences), docs (documents that hold it). A regular expression's matches are what a split at its complement leaves."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    terms = docs.select(key(seed), F.split(lowered, BETWEEN).alias("terms"))
    as_ = lambda what, n, d: F.struct(what.alias("terms"), F.lit(n).alias("n"), F.lit(d).alias("docs"))
    twice = terms.select("key", F.explode(F.array(as_(F.col("terms"), 1, 0), as_(F.array_distinct("terms"), 0, 1))).alias("of"))
    each = twice.select("key", F.explode("of.terms").alias("term"), F.col("of.n").alias("n"), F.col("of.docs").alias("docs"))
    return each.groupBy("key", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where("term <> ''")


def share(n: str, of: str, terms: str) -> Column:
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(19,0))) div cast({of} + 2 * {terms} as decimal(20,0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def dense(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """All groups (lang, source), and for each with each kept term of its language: lang, source, term, n, p, and the language's share q."""
    held = F.sum("docs").over(Window.partitionBy("lang", "term"))
    known, seed = groups(docs)
    kept = common.written(counts(docs, seed).join(known, "key").withColumn("held", held).where(F.col("held") >= min_docs).select("lang", "source", "term", "n"), "kept-terms")
    sized = known.select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("of")), ["lang", "source"], "left").na.fill(0, ["of"])
    words = kept.groupBy("lang", "term").agg(F.sum("n").alias("total"))
    sizes = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("of_lang"))
    salted = sized.join(sizes, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cells = salted.join(words.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")), ["lang", "salt"])
    full = cells.join(kept, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    return known.select("lang", "source"), common.written(full.select("lang", "source", "term", "n", share("n", "of", "terms").alias("p"), share("total", "of_lang", "terms").alias("q")), "dense-terms")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' has each other source of the language, part 'term' the group's `top` over-used terms."""
    known, cells = dense(docs, min_docs)
    one = cells.select("lang", "term", "source", "p")
    other = one.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_item"))
    sums = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(apart("p", "p_item")).alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = known.join(known.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    terms = cells.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    shape = lambda df, part: df.withColumn("rank", ranked).select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return shape(pairs, "pair").unionByName(shape(terms, "term").where(F.col("rank") <= top))
