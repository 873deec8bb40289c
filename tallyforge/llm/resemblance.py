"""Near duplicates by exact Jaccard similarity of word shingles, all pairs of at least NUMBER / OF found.

Two sets of similarity s share s times the larger one's members, so under any one order of all
shingles their first n - ceil(s * n) + 1 members have one in common (prefix filtering): every pair
that counts meets in a bucket of such a prefix member, and each pair that meets is verified by the
sets themselves. The order is by hash, but shingles of crowded buckets come late, those that are frequent
in a sample last, which keeps boilerplate out of prefixes: a first pass over all texts counts the buckets, so
their size doesn't grow with the table as long as texts have rarer shingles. The order changes the work only,
never the result. Pairs are held first by sketches, the parities of how many members fall on each of 64 * WORDS bits: bits that differ are at
most as many as members that differ, so no similar pair is lost, and few sets of other pairs are moved.

Guessed pairs (of SimHash, say) are verified before all others; what is in one class needs no pairs. Buckets
of at most SMALL sets pair all others. In a larger one each set is held against a hub, then those still in
another class against other hubs, and sets of a large bucket that stay in different classes after ROUNDS are
paired all with all, as far as their sketches allow. So the classes are those of all pairs. Words and equal sets are known by 64-bit hashes.

Texts without words form one class; texts of fewer words than a shingle's are one shingle; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import common, search

NUMBER, OF = 4, 5
SMALL = 8
ROUNDS = 2
#: Bits of a set's sketch, as 64-bit words.
WORDS = 16
#: Texts of the sample, how many of them must hold a frequent shingle, and frequent shingles at most.
SAMPLE = 8_000
FREQUENT = 3
MOST_FREQUENT = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and hash of each different shingle of each text, by text and hash."""
    of, h = search.terms(texts)
    step = lambda s, x: ((s ^ x) * ODD) ^ (((s ^ x) * ODD) >> U(32))
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    start = np.flatnonzero(of[: len(of) - words + 1] == of[words - 1 :]) if len(of) >= words else np.zeros(0, np.int64)
    made = np.zeros(len(start), U)
    for j in range(words):
        made = step(made, h[start + j])
    short = np.flatnonzero((n > 0) & (n < words))
    rest = np.zeros(len(short), U)
    for j in range(words - 1):
        has = n[short] > j
        rest[has] = step(rest[has], h[first[short[has]] + j])
    of, s = np.concatenate([of[start], short]), np.concatenate([made, rest])
    order = np.lexsort((s, of))
    of, s = of[order], s[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (s[1:] != s[:-1])]) if len(s) else np.zeros(0, bool)
    return of[new], s[new]


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of each shingle, first shingle of each text (and the end), and the hash of each text's set."""
    texts = common.byte_texts(batch.column("text"))
    of, s = shingles(texts, words)
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    shape = np.array([xxhash.xxh64_intdigest(s[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], U)
    return of, s, ends, shape


def sketches(of: np.ndarray, s: np.ndarray, texts: int) -> np.ndarray:
    """WORDS words of each text's sketch, one text after another; of, s: as shingles() gives them."""
    cell = of * WORDS + (s >> U(60)).astype(np.int64)  # members are in order, so their words are, too
    made = np.zeros(texts * WORDS, U)
    if len(s):
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        made[cell[first]] = np.bitwise_xor.reduceat(U(1) << ((s >> U(54)) & U(63)), first)
    return made


def marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(F.col("text")).alias("mark"), "text")


def mark(text: Column) -> Column:
    """Tells apart rows of one doc_id, or of none."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shapes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, mark, shape (of its set of shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            shape = _sets(batch, words)[3]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(shape.view(np.int64))], names=["doc_id", "mark", "shape"])

    return marked(docs).mapInArrow(run, "doc_id long, mark long, shape long")


def sets(docs: DataFrame, words: int, screen: np.ndarray | None = None) -> DataFrame:
    """mark, shape, shingles, sketch of each row; with a screen of marks, of those that it lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(screen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            of, s, ends, shape = _sets(batch, words)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(shape) + 1, dtype=np.int32) * WORDS), pa.array(sketches(of, s, len(shape)).view(np.int64)))
            held = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s.view(np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(shape.view(np.int64)), held, sketch], names=["mark", "shape", "shingles", "sketch"])
            yield out if shared.value is None else out.filter(pa.array(common.bit(shared.value, batch.column("mark").to_numpy(zero_copy_only=False))))

    return marked(docs).mapInArrow(run, "mark long, shape long, shingles array<long>, sketch array<long>")


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that FREQUENT texts of a sample hold, in order; at most MOST_FREQUENT."""
    every = max(1, docs.count() // SAMPLE)
    some = sets(docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0), words)
    counts = some.select(F.explode("shingles").alias("key")).groupBy("key").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).select("key").toArrow().column("key").to_numpy()
    return np.sort(found.view(U))


def prefixes(docs: DataFrame, words: int, late: np.ndarray, crowded: np.ndarray | None = None, screen: np.ndarray | None = None) -> DataFrame:
    """key, shape, n (size of the set), at (place in its order) of each prefix member of each row's set, or of those that a screen of keys lets pass; members in `late` come last, those in the bitmap `crowded` before them."""
    shared = docs.sparkSession.sparkContext.broadcast((late, crowded, screen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, full, some = shared.value
        for batch in common.slices(batches, "text"):
            of, s, ends, shape = _sets(batch, words)
            at = np.minimum(np.searchsorted(last, s), max(len(last) - 1, 0))
            turn = (last[at] == s if len(last) else np.zeros(len(s), bool)) * 2
            if full is not None:
                turn = np.maximum(turn, common.bit(full, s))
            order = np.lexsort((s, turn, of))
            n = np.diff(ends)[of]
            place = np.arange(len(s)) - ends[of]
            keep = place <= n - -(-NUMBER * n // OF)
            if some is not None:
                keep &= common.bit(some, s[order])
            yield pa.RecordBatch.from_arrays([pa.array(s[order][keep].view(np.int64)), pa.array(shape[of[keep]].view(np.int64)), pa.array(n[keep].astype(np.int32)), pa.array(place[keep].astype(np.int32))], names=["key", "shape", "n", "at"])

    return marked(docs).mapInArrow(run, "key long, shape long, n int, at int")


def buckets(members: DataFrame) -> DataFrame:
    """key, size of the buckets that hold different sets."""
    return members.groupBy("key").agg(F.min("shape").alias("lo"), F.max("shape").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")


def merged(members: DataFrame) -> DataFrame:
    """key, shape, n, at, size: buckets of the same sets made one, whose place for a set is the first of its places, so that no pair fails there which fits in one of them.

    Copies share hundreds of members, and would meet as often. A key is a hash of the sets; equal hashes of others add pairs, none is lost."""
    same = members.groupBy("key").agg(F.xxhash64(F.bit_xor(F.xxhash64("shape")), F.count("*")).alias("same"), F.count("*").alias("size"))
    return members.join(same, "key").groupBy(F.col("same").alias("key"), "size", "shape").agg(F.min("n").alias("n"), F.min("at").alias("at"))


def screen(rows: DataFrame, column: str) -> np.ndarray:
    """A bitmap of a column's hashes, as wide as their number asks."""
    return common.bitmap(rows, column, common.width(rows.count()))


def close(a: str, b: str, both: Column) -> Column:
    """Whether the sketches a and b, of sets that have `both` members together, allow the similarity."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return differ * (OF + NUMBER) <= both * (OF - NUMBER)


def pairs(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
    """u, v: the shapes of left (l) and right (r) that meet in a bucket and whose sizes, places of the bucket's member and, if both have them, sketches allow the similarity.

    From the first member that two sets share, the rest of each bounds what they share: a similar pair passes there."""
    a, b = left.alias("l"), right.alias("r")
    fits = (F.col("l.n") * OF >= F.col("r.n") * NUMBER) & (F.col("r.n") * OF >= F.col("l.n") * NUMBER)
    fits &= F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) * (OF + NUMBER) >= (F.col("l.n") + F.col("r.n")) * NUMBER
    if "sketch" in left.columns and "sketch" in right.columns:
        fits &= close("l.sketch", "r.sketch", F.col("l.n") + F.col("r.n"))
    met = a.join(b, (F.col("l.key") == F.col("r.key")) & (F.col("l.shape") != F.col("r.shape")) & F.expr(" AND ".join(also) or "true") & fits)
    return met.select(F.greatest("l.shape", "r.shape").alias("u"), F.least("l.shape", "r.shape").alias("v")).distinct()


def likely(met: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches (held: shape, shingles, sketch) allow the similarity."""
    side = lambda own, n, name: held.select(F.col("shape").alias(own), F.size("shingles").alias(n), F.col("sketch").alias(name))
    return met.join(side("u", "m", "a"), "u").join(side("v", "n", "b"), "v").where(close("a", "b", F.col("m") + F.col("n"))).select("u", "v").distinct()


def similar(met: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets (held: shape, shingles, sketch) are as similar as NUMBER / OF."""
    met = common.stored(likely(met, held))
    side = lambda own, name: common.screened(held, "shape", met, own).select(F.col("shape").alias(own), F.col("shingles").alias(name))  # noqa: E731  only sets of a pair are moved
    a, b = side("u", "a"), side("v", "b")
    both = F.size(F.array_intersect("a", "b"))
    return met.join(a, "u").join(b, "v").where(both * (OF + NUMBER) >= (F.size("a") + F.size("b")) * NUMBER).select("u", "v").distinct()


def links(docs: DataFrame, words: int, known: DataFrame | None = None, guessed: DataFrame | None = None) -> DataFrame:
    """u, v: pairs of similar shapes, whose classes are those of all similar pairs; known: shapes(docs, words); guessed: u, v, pairs of shapes that may be similar."""
    known = shapes(docs, words) if known is None else known
    late = frequent(docs, words)
    crowded = screen(common.stored(buckets(prefixes(docs, words, late)).where(F.col("size") > SMALL)), "key")
    several = common.stored(buckets(prefixes(docs, words, late, crowded)))
    # most members stand alone: what the bitmaps leave out is neither stored nor moved again
    rows = prefixes(docs, words, late, crowded, screen(several, "key")).distinct()
    met = common.stored(merged(rows.join(several.select("key"), "key")))
    one = known.groupBy("shape").agg(F.min("mark").alias("mark")).join(met.select("shape").distinct(), "shape", "left_semi")  # a text for each shape
    held = common.stored(sets(docs, words, common.bitmap(one, "mark", common.width(known.count()))).select("shape", "shingles", "sketch"))
    found = None if guessed is None else common.stored(similar(guessed, held))  # a similar pair meets in a bucket, so both are held
    left, tried = met, None
    for turn in range(ROUNDS + 1):
        if found is not None:
            classes = common.components(found).select(F.col("node").alias("shape"), "component")
            left = left.drop("class").join(classes, "shape", "left").withColumn("class", F.coalesce("component", "shape")).drop("component")
        else:
            left = left.withColumn("class", F.col("shape"))
        left = left.where((F.col("size") > SMALL) | F.lit(turn == 0))
        split = left.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min(F.struct(F.xxhash64("shape", F.lit(turn)), "shape", "n", "at", "class", "size")).alias("hub")).where("lo < hi")
        split = common.stored(split.select("key", "hub.shape", "hub.n", "hub.at", "hub.class", "hub.size"))
        if split.isEmpty():
            break
        left = common.stored(left.join(split.select("key"), "key", "left_semi"))
        small, large = left.where(F.col("size") <= SMALL), left.where(F.col("size") > SMALL)
        if turn < ROUNDS:
            new = pairs(large, split.where(F.col("size") > SMALL), "l.class <> r.class")
        else:  # sketches go to the buckets, so that the pairs of dissimilar sets, whose number grows with the square of a bucket, are never made
            # buckets of one hub are one, with the first of a set's places: what shares many members of long texts meets once for each hub
            large = large.join(split.select("key", F.col("shape").alias("of")), "key").groupBy(F.col("of").alias("key"), "shape").agg(F.min("n").alias("n"), F.min("at").alias("at"), F.min("class").alias("class"))
            large = common.stored(large.join(held.select("shape", "sketch").dropDuplicates(["shape"]), "shape"))
            new = pairs(large, large, "l.class <> r.class", "l.shape > r.shape")
        if turn == 0:
            new = new.unionByName(pairs(small, small, "l.class <> r.class", "l.shape > r.shape")).distinct()
        new = common.stored(new if tried is None else new.join(tried, ["u", "v"], "left_anti"))
        tried = new if tried is None else tried.unionByName(new)
        more = similar(new, held)
        found = common.stored(more if found is None else found.unionByName(more))
    return met.selectExpr("shape AS u", "shape AS v").where("false") if found is None else found


def classes(docs: DataFrame, words: int, alike: DataFrame | None = None) -> DataFrame:
    """doc_id, mark, class of each row of docs (doc_id, text); alike: mark, other, guesses at what is similar, which are verified first."""
    with common.freed_shuffles(docs.sparkSession):
        rows = common.stored(shapes(docs, words))
        guessed = None
        if alike is not None:
            of = rows.select("mark", "shape").distinct()
            both = alike.where("mark <> other").join(of.withColumnRenamed("shape", "a"), "mark").join(of.select(F.col("mark").alias("other"), F.col("shape").alias("b")), "other").where("a <> b")
            guessed = both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        joined = common.components(links(docs, words, rows, guessed)).select(F.col("node").alias("shape"), "component")
    return rows.join(joined, "shape", "left").select("doc_id", "mark", F.coalesce("component", "shape").alias("class"))
