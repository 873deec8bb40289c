"""How the tokens of two tokenizers lie over each other in the same text.

A text with a space before it is encoded by both: A, a byte-level vocabulary, and B, a vocabulary of pieces.
Where tokens of both end at the same byte, they are cut into groups; a token of A and one of B whose
bytes overlap are linked, and an id pair's count is the number of its links in the whole corpus.

Both vocabularies begin a new token where a space or line break follows something that isn't white space,
so the corpus is aligned by its distinct segments between such places, each once, and documents are
put together from them (vocabularies without that property, as cut_alike() finds them: a text is one segment):

1. Documents are cut into segments, written as numbers of a dictionary for each block of documents.
2. Distinct segments are encoded. Their tokens are exploded with positions; a window over a segment's
   tokens adds up lengths to ends; a full join on (segment, end) finds the ends that both share, and a
   running count of those numbers the groups. Links are the range join of both sides' spans, carried
   out in order of ends: each stretch between neighbouring ends belongs to one token of each, so a fill from
   the next end gives each link once, in linear time, however many tokens a group holds.
3. Links weighed by their segments' occurrences give the pairs' counts; these return to the segments.
4. A block's dictionary meets its documents again, and sums and group strings are taken over whole texts.

Rows of a text that is null, empty, or whose joined bytes by A or B differ from it, have no tokens: zeros,
and ''. A text with a segment of that kind counts nowhere, which is why occurrences in such texts
are taken off. Repeated rows count as often as they come; a very long text is one document (of a block of its own);
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import common, tokens

#: Bytes of text whose segments share a dictionary.
BLOCK_BYTES = 32 << 20
#: Entries of a dictionary in one row.
DICTIONARY_ROWS = 20_000
SPACE = "▁"

#: Entries of dictionaries that a task packs at a time.
PAGE_ROWS = 200_000
#: Rows of the table of pairs up to which it is broadcast (24 bytes each); beyond that it is joined by a shuffle.
BROADCAST_PAIRS = 1_000_000

SEGMENTS = re.compile(r"[ \n](?:[^ \n]|(?<=\s)[ \n])*").findall


def plain_segments(text: str) -> list[str]:
    """A space and the text, cut before each space or line break; right where no piece ends in white space."""
    whole = f" {text}"
    return SEGMENTS(whole) if "\0" in text else whole.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]


def segments(text: str) -> list[str]:
    """The pieces of a space and the text, cut before each space or line break that follows something else than white space."""
    found = plain_segments(text)
    return SEGMENTS(f" {text}") if any(s[-1].isspace() for s in found) else found


class Dictionary:
    """Numbers for a block's segments, in order of their first occurrence."""

    def __init__(self) -> None:
        self.held: dict[str, int] = {}
        self.loose: set[str] = set()  # those that end in white space

    def numbers(self, text: str, by_segment: bool) -> np.ndarray:
        found = plain_segments(text) if by_segment else [f" {text}"]
        fresh = [s for s in dict.fromkeys(found) if s not in self.held]
        if by_segment and (any(s[-1].isspace() for s in fresh) or not self.loose.isdisjoint(found)):
            found = SEGMENTS(f" {text}")
            fresh = [s for s in dict.fromkeys(found) if s not in self.held]
            self.loose.update(s for s in fresh if s[-1].isspace())
        for s in fresh:
            self.held[s] = len(self.held)
        return np.fromiter(map(self.held.__getitem__, found), np.int32, len(found))


@cache
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def cut_alike(a_path: str, b_path: str) -> bool:
    """Whether both cut texts as segments() does, whatever stands around."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(b_path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    kept = spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and model.trainer_spec.model_type == model.trainer_spec.BPE
    inner = any(SPACE in p.piece.lstrip(SPACE) or "\n" in p.piece for p in model.pieces)
    return kept and not inner and not tokens.word_encoder(a_path).whole


class Encoders:
    """Ids and byte lengths of a segment's tokens by both tokenizers."""

    def __init__(self, a_path: str, b_path: str, by_segment: bool) -> None:
        self.a, self.b, self.by_segment = tokens.tokenizer(a_path), pieces(b_path), by_segment
        back = {c: b for b, c in tokens.byte_letters().items()}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in map(self.a.id_to_token, range(size))]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int32) for t in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        # a line break in front is a token of its own after B's added space
        b = [i[2:] for i in self.b.encode(["\n" + t for t in texts])] if self.by_segment else self.b.encode([t[1:] for t in texts])
        same = lambda ids, table, raw: b"".join(map(table.__getitem__, ids)) == raw
        fine = [same(x, self.a_bytes, raw) and same(y, self.b_bytes, raw) for x, y, raw in zip(a, b, (t.encode() for t in texts), strict=True)]
        return [x if f else [] for x, f in zip(a, fine, strict=True)], [y if f else [] for y, f in zip(b, fine, strict=True)], fine


@cache
def encoders(a_path: str, b_path: str, by_segment: bool) -> Encoders:
    return Encoders(a_path, b_path, by_segment)


CUT = "block long, place int, doc_id long, ids array<int>, base int, segs array<string>, counts array<int>"


def cut(docs: DataFrame, by_segment: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of documents (block, place in it, doc_id, ids of segments) and of their blocks' dictionaries (base: the first one's id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("base", pa.int32()), ("segs", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])
        block, place, size = TaskContext.get().partitionId() << 32, 0, 0
        known, seen = Dictionary(), [np.zeros(0, np.int32)]

        def dictionary() -> Iterator[pa.RecordBatch]:
            counts = np.bincount(np.concatenate(seen), minlength=len(known.held))
            names = list(known.held)
            for base in range(0, len(names), DICTIONARY_ROWS):
                part = slice(base, base + DICTIONARY_ROWS)
                yield pa.RecordBatch.from_pylist([{"block": block, "base": base, "segs": names[part], "counts": counts[part].tolist()}], schema)

        for batch in common.slices(batches, "text"):
            found, places = [], []
            for text in batch.column("text").to_pylist():
                found.append(known.numbers(text, by_segment) if text else seen[0])
                places.append(place)
                place += 1
                size += len(text or "")
            seen += found
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            n = len(found)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            none = lambda f: pa.nulls(n, schema.field(f).type)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(places, pa.int32()), batch.column("doc_id"), ids, none("base"), none("segs"), none("counts")], schema=schema)
            if size >= block_bytes:
                yield from dictionary()
                block, place, size, known, seen = block + 1, 0, 0, Dictionary(), seen[:1]
        yield from dictionary()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CUT)


ENCODED = "seg string, fine boolean, a array<int>, a_len array<int>, b array<int>, b_len array<int>"


def encoded(segs: DataFrame, a_path: str, b_path: str, by_segment: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoders(a_path, b_path, by_segment)

        def lists(ids: list[list[int]], sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
            offsets = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32))
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            return pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(sizes[flat]))

        for batch in common.slices(batches, "seg"):
            a, b, fine = e.encode(batch.column("seg").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("seg"), pa.array(fine), *lists(a, e.a_sizes), *lists(b, e.b_sizes)], names=["seg", "fine", "a", "a_len", "b", "b_len"])

    return segs.select("seg").mapInArrow(run, ENCODED)


def ends(texts: DataFrame) -> DataFrame:
    """sid, n, end, grp, a, b, link_a, link_b: an end of a token of A (id a) or B (id b) or both, its group, and the ids of the tokens over the stretch before it; texts: sid, n, a, a_len, b, b_len, dealt by sid."""

    def of(side: str) -> DataFrame:
        found = texts.select("sid", "n", F.posexplode(F.arrays_zip(side, f"{side}_len")).alias("pos", "token")).select("sid", F.col("n").alias(f"n_{side}"), "pos", f"token.{side}", f"token.{side}_len")
        return found.select("sid", f"n_{side}", side, F.sum(f"{side}_len").over(Window.partitionBy("sid").orderBy("pos")).alias("end"))

    both = of("a").join(of("b"), ["sid", "end"], "full")
    before = Window.partitionBy("sid").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("sid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_here = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    filled = both.select("sid", F.coalesce("n_a", "n_b").alias("n"), "end", "a", "b", F.last("a", ignorenulls=True).over(after).alias("link_a"), F.last("b", ignorenulls=True).over(after).alias("link_b"))
    return filled.withColumn("grp", F.coalesce(F.sum(cut_here).over(before), F.lit(0)))


def grouped(texts: DataFrame) -> DataFrame:
    """sid, n, n_a, n_b, n_groups, groups ('a1,a2|b1;a3|b2,b3'), links (pairs of ids) of each text."""
    token = lambda side, at: F.collect_list(F.when(F.col(side).isNotNull(), F.struct("grp", F.lit(at).alias("side"), "end", F.col(side).alias("id")))).alias(f"of_{side}")
    found = ends(texts).groupBy("sid", "n").agg(token("a", 0), token("b", 1), F.collect_list(F.struct(F.col("link_a").alias("a"), F.col("link_b").alias("b"))).alias("links"))
    ordered = found.withColumn("tokens", F.array_sort(F.concat("of_a", "of_b")))
    mark = lambda t, last: F.when(last.isNull(), "").when(last["grp"] != t["grp"], ";").when(last["side"] != t["side"], "|").otherwise(",")
    texts_ = F.transform("tokens", lambda t, i: F.concat(mark(t, F.get("tokens", i - 1)), t["id"].cast("string")))
    groups = (F.element_at("tokens", -1)["grp"] + 1).cast("long")
    return ordered.select("sid", "n", F.size("of_a").cast("long").alias("n_a"), F.size("of_b").cast("long").alias("n_b"), groups.alias("n_groups"), F.array_join(texts_, "").alias("groups"), "links")


@dataclass
class Alignment:
    cuts: DataFrame
    #: block, local, sid: what a block's dictionary holds; sid is null for a segment that isn't the same by both.
    entries: DataFrame
    #: As grouped() has them, a row a distinct segment.
    segs: DataFrame
    #: a, b, n, best: each linked pair of ids, its links in the corpus, whether no other pair of that b has more.
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> Alignment:
    spark = docs.sparkSession
    by_segment = cut_alike(a_path, b_path)
    both = cut(docs, by_segment, block_bytes).withColumn("kind", F.col("segs").isNotNull().cast("int"))
    cut_at = common.scratch(spark, "segment-cuts")
    with common.settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "2"}):  # documents and dictionaries in folders of their own, without a sort
        both.write.partitionBy("kind").option("compression", "zstd").parquet(cut_at)
    written = spark.read.schema(both.schema).parquet(cut_at)
    cuts = written.where("kind = 0").drop("kind")
    words = written.where("kind = 1").select("block", "base", F.posexplode(F.arrays_zip("segs", "counts")).alias("pos", "of"))
    words = words.select("block", (F.col("base") + F.col("pos")).alias("local"), F.col("of.segs").alias("seg"), F.col("of.counts").alias("n"))
    at = common.scratch(spark, "segments")
    segs = common.written(encoded(words.select("seg").distinct(), a_path, b_path, by_segment).withColumn("sid", F.monotonically_increasing_id()), "segments", at)
    entries = common.written(words.join(segs.select("seg", "sid", "fine"), "seg").select("block", "local", "n", "sid", "fine"), "segment-entries")
    common.erase(spark, f"{cut_at}/kind=1")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with common.settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):  # joins and windows keep the segments' partitioning
        weighed = segs.where("fine").select("sid", "a", "a_len", "b", "b_len").join(occurrences(cuts, entries), "sid").repartition(parts, "sid")
        found = common.written(grouped(weighed), "aligned-segments")
    common.erase(spark, at)
    linked = found.select("n", F.explode("links").alias("of")).groupBy("of.a", "of.b").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy("b"))  # rows of a b: the ids of A at most
    pairs = common.written(linked.select("a", "b", "n", (F.col("n") == most).alias("best")), "token-pairs")
    return Alignment(cuts, entries.select("block", "local", F.when(F.col("fine"), F.col("sid")).alias("sid")), found, pairs)


def occurrences(cuts: DataFrame, entries: DataFrame) -> DataFrame:
    """sid, n: how often a segment stands in texts all of whose segments are fine."""
    odd = entries.where("not fine").groupBy("block").agg(F.collect_list("local").alias("odd"))  # of one block's dictionary
    texts = cuts.where("ids is not null").select("block", "ids").join(odd, "block").where(F.arrays_overlap("ids", "odd"))
    off = texts.select("block", F.explode("ids").alias("local")).groupBy("block", "local").agg((-F.count("*")).alias("n"))
    off = off.join(entries.where("fine").select("block", "local", "sid"), ["block", "local"]).select("sid", "n")
    return entries.where("fine").select("sid", F.col("n").cast("long").alias("n")).unionByName(off).groupBy("sid").agg(F.sum("n").alias("n"))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def scores(found: Alignment) -> DataFrame:
    """sid, n_best, count_sum of each segment's links."""
    pairs = F.broadcast(found.pairs) if found.pairs.count() <= BROADCAST_PAIRS else found.pairs
    linked = found.segs.select("sid", F.explode("links").alias("of")).select("sid", "of.a", "of.b").join(pairs, ["a", "b"])
    return linked.groupBy("sid").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))


RESULT = "doc_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", groups_sha256 string"


def paged(entries: DataFrame) -> DataFrame:
    """block, page: rows of entries (with a column block) of one block, as compressed Arrow streams: far fewer bytes to move than rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pages() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table.column("block"))).combine_chunks()
            blocks = table.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.slice(start, end - start))
                yield pa.RecordBatch.from_arrays([pa.array([int(blocks[start])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "page"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PAGE_ROWS:
                yield from pages()
                held = []
        if held and sum(b.num_rows for b in held):
            yield from pages()

    return entries.mapInArrow(run, "block long, page binary")


def by_document(found: Alignment) -> DataFrame:
    """doc_id, NUMBERS and groups_sha256 of every row."""
    worth = common.written(scores(found), "segment-scores")
    totals = found.segs.withColumn("n_links", F.size("links").cast("long")).join(worth, "sid").select("sid", *(F.col(n).cast("long").alias(n) for n in NUMBERS), F.col("groups").cast("binary").alias("groups"))
    pages = paged(found.entries.join(totals, "sid", "left").select("block", "local", *NUMBERS, "groups"))

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(p.as_py()).read_all() for p in words.column("page")]
        text: list[bytes] = [b""] * sum(p.num_rows for p in parts)
        sums = np.zeros((len(text), len(NUMBERS)), np.int64)
        for p in parts:  # numbers of a dictionary are those from 0 on
            at = p.column("local").to_numpy()
            sums[at] = np.stack([p.column(n).fill_null(0).to_numpy() for n in NUMBERS], axis=1)
            for i, t in zip(at.tolist(), p.column("groups").to_pylist(), strict=True):
                text[i] = t or b""
        fine = np.array([bool(t) for t in text], bool)
        out, marks = np.zeros((docs.num_rows, len(NUMBERS)), np.int64), [""] * docs.num_rows
        row = 0
        for chunk in docs.column("ids").chunks:
            offsets, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
            for start, end in zip(offsets[:-1], offsets[1:], strict=True):
                here = flat[start:end]
                if len(here) and fine[here].all():
                    out[row] = sums[here].sum(axis=0)
                    digest = hashlib.sha256(text[here[0]])
                    for i in range(1, len(here), 100_000):
                        digest.update(b"".join(b";" + text[k] for k in here[i : i + 100_000].tolist()))
                    marks[row] = digest.hexdigest()
                row += 1
        return pa.table([docs.column("doc_id"), *(pa.array(out[:, k]) for k in range(len(NUMBERS))), pa.array(marks, pa.string())], names=["doc_id", *NUMBERS, "groups_sha256"])

    texts = found.cuts.where("ids is not null").select("block", "doc_id", "ids")
    return texts.groupBy("block").cogroup(pages.groupBy("block")).applyInArrow(run, RESULT)
