"""Repeated-substring removal: every byte covered by a WIDTH-byte string that also starts anywhere else.

Sorting every suffix of a corpus would ship WIDTH bytes for each byte of text, so suffixes are first
screened without loss. A window (WIDTH bytes) is represented by its anchor, the place of the least
hash among its grams of GRAM bytes, leftmost of equal ones; neighbouring windows of one anchor are a
unit, and their bytes together its piece. Equal windows have equal anchors at equal places, so a unit
whose gram occurs once in the corpus has no repeated window.

Units of equal piece (by gram hash and the piece's own hash, 128 bits together) are a class. What of
a class is repeated is decided for two of its pieces, or for its only one, by the suffix sort, and
holds for all its units. The sort range-partitions the pieces by their leading tokens (the bytes at
the anchor, with splitters that Spark samples). Within a bucket, pieces come in order, so equal
ones are neighbours and are compared byte for byte: all their windows are repeated. The suffixes of
different pieces of one lead are sorted by multikey quicksort, eight bytes at a time: those alone
with their key leave, and what is left together after WIDTH bytes is repeated.

A lead of over HEAVY different pieces (a passage that many documents share, at its ends) would fill
a bucket. Such pieces are first split by their bytes on both sides of the anchor, into blocks of
BLOCK windows; a block whose core (the bytes that all its windows have) no other piece has is left
out, as nothing in it can be repeated, and the suffixes of the others are range-partitioned one by
one, by all their bytes and then their place, so that even equal ones spread, and are compared along
each bucket and across the boundaries between buckets.

Which texts are shipped is screened by a bitmap of fixed size: a false hit costs time,
never a result. Null is empty; texts under WIDTH bytes repeat nothing themselves; repeated rows are
each other's copies; texts of any length are cut into chunks of CHUNK windows and lose nothing by it;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import common

WIDTH = 200
GRAM = 32
HEAVY = 4096
BLOCK = 16
#: Bytes of pieces that a bucket sorts at a time (all of one lead stay together), and windows of a text whose units are found at a time.
SORT_BYTES = 1 << 20
CHUNK = 1 << 17
GRAM_BASE, PIECE_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
U = np.uint64


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _running(flat: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix hashes, and the factors that make a stretch's hash independent of its place."""
    up, down = _powers(base, 1 << max(17, len(flat).bit_length()))
    out = np.zeros(len(flat) + 1, U)
    np.cumsum((flat + U(1)) * up[: len(flat)], out=out[1:])
    return out, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor, gram and piece hash of each unit of a text; a unit ends with its chunk, which contests it but loses nothing."""
    if len(text) < WIDTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    flat, found = np.frombuffer(text, np.uint8), []
    for at in range(0, len(text) - WIDTH + 1, CHUNK):
        first, last, anchor, gram, piece = _units(flat[at : at + CHUNK + WIDTH - 1])
        found.append((first + at, last + at, anchor + at, gram, piece))
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _units(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    span = WIDTH - GRAM + 1
    total, down = _running(flat, GRAM_BASE)
    gram = _mixed((total[GRAM:] - total[:-GRAM]) * down[: len(total) - GRAM])
    m = len(gram)
    # rank of the gram above, its place below: the least is the leftmost of the least
    key = np.concatenate([gram >> U(40) << U(40) | np.arange(m, dtype=U), np.full(-m % span, np.iinfo(U).max)]).reshape(-1, span)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[: m - span + 1], ahead[span - 1 : m]) & U((1 << 40) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last, anchor = np.append(first[1:], len(at)) - 1, at[first]
    whole = flat.tobytes()
    piece = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(first.tolist(), (last + WIDTH).tolist(), strict=True)), U, len(first))
    return first, last, anchor, gram[anchor], piece


def anchors(rows: DataFrame) -> DataFrame:
    """gram, piece, key, span of every unit, from (key, text)."""
    signed = lambda x: pa.array(x.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found, keys = [units(t) for t in common.byte_texts(batch.column("text"))], batch.column("key").to_numpy(zero_copy_only=False)
            first, last, _, gram, piece = (np.concatenate(x) for x in zip(*found, strict=True))
            key = np.repeat(keys, [len(x[0]) for x in found])
            yield pa.RecordBatch.from_arrays([signed(gram), signed(piece), pa.array(key), pa.array(first << 8 | last - first)], names=["gram", "piece", "key", "span"])

    return rows.mapInArrow(run, "gram long, piece long, key long, span long")


def packed(rows: DataFrame, screen: np.ndarray, all_rows: bool) -> DataFrame:
    """doc_id, key, n_bytes, packed, sha: texts compressed where the screen of keys lets them pass, else their digest (or no row)."""
    held = rows.sparkSession.sparkContext.broadcast(screen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in common.slices(batches, "text"):
            texts = common.byte_texts(batch.column("text"))
            some = common.bit(held.value, batch.column("key").to_numpy(zero_copy_only=False))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([len(t) for t in texts], pa.int64()), pa.array([press.compress(t) if s else None for t, s in zip(texts, some, strict=True)], pa.binary()), pa.array([None if s else hashlib.sha256(t).hexdigest() for t, s in zip(texts, some, strict=True)], pa.string())], names=["doc_id", "key", "n_bytes", "packed", "sha"])
            yield out if all_rows else out.filter(pa.array(some))

    return rows.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n_bytes long, packed binary, sha string")


PIECE_SCHEMA = "gram long, piece long, lead binary, anchor int, text binary, heavy boolean"


def pieces(found: DataFrame) -> DataFrame:
    """gram, piece, lead (the anchor's gram), anchor (its place), text, heavy of chosen units, from (packed, key, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["gram", "piece", "lead", "anchor", "text", "heavy"])
        for batch in common.slices(batches, "packed", 1 << 19):
            out = []
            for blob, spans in zip(*(batch.column(c).to_pylist() for c in ("packed", "spans")), strict=True):
                text = unpress.decompress(blob)
                first, _, anchor, _, _ = units(text)
                where = dict(zip(first.tolist(), anchor.tolist(), strict=True))
                for s in spans:
                    a, n = s["span"] >> 8, s["span"] & 255
                    out += [(s["gram"], s["piece"], text[where[a] : where[a] + GRAM], where[a] - a, text[a : a + n + WIDTH], s["heavy"])] * s["times"]
                    if len(out) >= 10_000:
                        yield made(out)
                        out = []
            if out:
                yield made(out)

    return found.select("packed", "spans").mapInArrow(run, PIECE_SCHEMA)


def multikey(flat: np.ndarray, starts: np.ndarray, width: int = WIDTH, tokens: int = 4) -> np.ndarray:
    """Whether the width-byte string at each start equals that at another.

    A multikey sort: by eight-byte tokens, group by group, and those alone with their key leave. After
    the leading tokens the rest of the string is one token, its hash, and what then stands together
    is compared byte for byte. Strings whose whole hash is unique don't take part.
    """
    words = np.zeros(len(flat) + 8, U)
    padded = np.concatenate([flat, np.zeros(16, np.uint8)]).astype(U)
    for i in range(8):
        words = words << U(8) | padded[i : i + len(words)]
    total, down = _running(flat, PIECE_BASE)
    whole = (total[starts + width] - total[starts]) * down[starts]
    order = np.argsort(whole)
    same = whole[order[1:]] == whole[order[:-1]]
    alive = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])
    out, group = np.zeros(len(starts), bool), np.zeros(len(alive), np.int64)
    keys = [words[starts + d] for d in range(0, min(width - 7, 8 * tokens), 8)]
    for token in (*keys, whole):
        if not len(alive):
            return out
        key = token[alive]
        order = np.argsort(key, kind="stable")
        if group[-1]:
            order = order[np.argsort(group[order], kind="stable")]
        alive, group, key = alive[order], group[order], key[order]
        group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])) - 1
        more = np.bincount(group)[group] > 1
        alive, group = alive[more], np.unique(group[more], return_inverse=True)[1]
    at, next_to = starts[alive], group[1:] == group[:-1]
    left, right = at[:-1][next_to], at[1:][next_to]
    for d in (*range(0, width - 7, 8), width - 8):
        if width < 8 or (words[left + d] != words[right + d]).any():  # unequal strings of one hash, or short ones: compare each
            seen: dict[bytes, int] = {}
            text = flat.tobytes()
            for i in alive:
                seen[text[starts[i] : starts[i] + width]] = seen.get(text[starts[i] : starts[i] + width], 0) + 1
            out[alive] = [seen[text[starts[i] : starts[i] + width]] > 1 for i in alive]
            return out
    out[alive] = True
    return out


RANGE_SCHEMA = "gram long, piece long, lo int, hi int"


def _ranges(gram: np.ndarray, piece: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """gram, piece, lo, hi of runs of window starts, which must come in order for each piece."""
    cut = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(at)) - 1 if len(cut) else cut
    return pa.RecordBatch.from_arrays([pa.array(gram[cut], pa.int64()), pa.array(piece[cut], pa.int64()), pa.array(at[cut], pa.int32()), pa.array(at[end], pa.int32())], names=["gram", "piece", "lo", "hi"])


def sort_buckets(chosen: DataFrame) -> DataFrame:
    """gram, piece, lo, hi: ranges of repeated windows, counted from each piece's own start, among pieces (gram, piece, lead, text), by leading tokens."""

    def solve(rows: list[tuple[bytes, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        """rows: in order of lead and text."""
        again, single, alone = [], [], 0
        for i, (lead, text, gram, piece) in enumerate(rows):
            if i and rows[i - 1][:2] == (lead, text):
                if not again or again[-1][:2] != (gram, piece):
                    again.append((gram, piece, len(text) - WIDTH))
                continue
            if i and rows[i - 1][0] != lead and alone == 1:
                single.pop()  # no other piece has its lead
            alone = alone + 1 if i and rows[i - 1][0] == lead else 1
            single.append((gram, piece, text))
        if alone == 1:
            single.pop()
        if again:
            gram, piece, last = zip(*again, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(piece, pa.int64()), pa.array([0] * len(last), pa.int32()), pa.array(last, pa.int32())], names=["gram", "piece", "lo", "hi"])
        if single:
            flat = np.frombuffer(b"".join(t for _, _, t in single), np.uint8)
            size = np.array([len(t) for _, _, t in single])
            n, base = size - WIDTH + 1, np.cumsum(size) - size
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            known = {r[:2] for r in again}
            found = multikey(flat, np.repeat(base, n) + at) & np.repeat([r[:2] not in known for r in single], n)
            of = np.repeat(np.arange(len(single)), n)[found]
            gram, piece = (np.array([r[j] for r in single], np.int64)[of] for j in (0, 1))
            yield _ranges(gram, piece, at[found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lead", "text", "gram", "piece")), strict=True):
                if size >= SORT_BYTES and row[0] != rows[-1][0]:  # equal windows have equal leads
                    yield from solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
        if rows:
            yield from solve(rows)

    parts = int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.select("lead", "text", "gram", "piece").repartitionByRange(parts, "lead").sortWithinPartitions("lead", "text")
    return dealt.mapInArrow(run, RANGE_SCHEMA)


def blocks(heavy: DataFrame) -> DataFrame:
    """high, low (digest of the core), text, gram, piece, at, n: BLOCK windows at most of each piece, cut at equal places before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda b: int.from_bytes(b, "big", signed=True)
        for batch in common.slices(batches, "text", 1 << 17):
            out = []
            for text, anchor, gram, piece in zip(*(batch.column(c).to_pylist() for c in ("text", "anchor", "gram", "piece")), strict=True):
                last = len(text) - WIDTH
                for top in range((anchor - last) // BLOCK * BLOCK, anchor + 1, BLOCK):  # starts of windows that lie top to top + BLOCK - 1 before the anchor
                    lo, hi = max(0, anchor - top - BLOCK + 1), min(last, anchor - top)
                    core = xxhash.xxh3_128_digest(text[anchor - top : anchor - top - BLOCK + 1 + WIDTH] + top.to_bytes(2, "big"))
                    out.append((core, text[lo : hi + WIDTH], gram, piece, lo, hi - lo + 1))
            high, low = ([signed(r[0][i : i + 8]) for r in out] for i in (0, 8))
            _, texts, gram, piece, at, n = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((high, pa.int64()), (low, pa.int64()), (texts, pa.binary()), (gram, pa.int64()), (piece, pa.int64()), (at, pa.int32()), (n, pa.int32()))], names=["high", "low", "text", "gram", "piece", "at", "n"])

    return heavy.select("text", "anchor", "gram", "piece").mapInArrow(run, "high long, low long, text binary, gram long, piece long, at int, n int")


def sort_single(heavy: DataFrame) -> DataFrame:
    """As sort_buckets(), for pieces of heavy leads: block by block, and then suffix by suffix, compared along and across the buckets' boundaries."""
    spark = heavy.sparkSession
    cut = table(blocks(heavy), "blocks")
    text = cut.groupBy("high", "low", "text").agg(F.count("*").alias("times"), F.min(F.struct("gram", "piece", "at")).alias("of"))
    core = text.groupBy("high", "low").agg((F.count("*") > 1).alias("shared"))
    text = table(text.join(core, ["high", "low"]), "block-texts")
    whole = cut.join(text.where("times > 1").select("text"), "text").distinct().select("gram", "piece", F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1).cast("int").alias("hi"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1 << 16):
            out = [(text[i : i + WIDTH], of["gram"], of["piece"], of["at"] + i) for text, of in zip(batch.column("text").to_pylist(), batch.column("of").to_pylist(), strict=True) for i in range(len(text) - WIDTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["suffix", "gram", "piece", "at"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The suffixes that equal a neighbour in their bucket, and the first and the last of the bucket, with the bucket's number."""
        part, before, same, first, names = TaskContext.get().partitionId(), None, False, True, ["suffix", "gram", "piece", "at", "again", "part"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32()), strict=True)], names=names)
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names[:4]), strict=True):
                if before is not None:
                    equal = row[0] == before[0]
                    if same or equal or first:
                        out.append((before[0] if first else None, *before[1:], same or equal, part))
                    first, same = False, equal
                before = row
            yield made(out)
        if before is not None:
            yield made([(*before, same, part)])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = text.where("shared").select("text", "of").repartition(parts).mapInArrow(split, "suffix binary, gram long, piece long, at int")
    order = ["suffix", "gram", "piece", "at"]
    compared = table(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(compare, "suffix binary, gram long, piece long, at int, again boolean, part int"), "suffixes")
    ends = compared.where("suffix is not null").orderBy("part", "suffix", "gram", "piece", "at").collect()  # two suffixes a bucket
    across = {(r.gram, r.piece, r.at) for a, b in zip(ends, ends[1:], strict=False) if a.part != b.part and a.suffix == b.suffix for r in (a, b)}
    rows = spark.createDataFrame(sorted(across), "gram long, piece long, at int")
    found = compared.where("again").select("gram", "piece", "at").unionByName(rows)
    return whole.unionByName(found.select("gram", "piece", F.col("at").alias("lo"), F.col("at").alias("hi")))


def finish(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from (doc_id, n_bytes, packed, sha, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in common.slices(batches, "packed", 1 << 20):
            removed, spans, shas = [], [], []
            for blob, sha, ranges in zip(*(batch.column(c).to_pylist() for c in ("packed", "sha", "ranges")), strict=True):
                if blob is None:
                    removed.append(0), spans.append(0), shas.append(sha)
                    continue
                text = np.frombuffer(unpress.decompress(blob), np.uint8)
                edge = np.zeros(len(text) + 1, np.int64)
                for r in ranges or ():
                    edge[r["lo"]] += 1
                    edge[r["hi"] + WIDTH] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                shas.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed table in the shared folder."""
    at = common.scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.parquet(at)


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """key, lo, hi: ranges of starts of repeated windows, from (key, text)."""
    every = table(anchors(rows.select("key", "text")), "units")
    more = table(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")  # written, so that a hot gram's side of the join can be split
    found = table(every.join(more, "gram", "left_semi"), "repeated-grams")
    member = F.struct("key", "span")
    classes = found.groupBy("gram", "piece").agg(F.count("*").alias("c"), F.min(member).alias("a"), F.max(member).alias("b"))
    heavy = classes.groupBy("gram").agg((F.count("*") > HEAVY).alias("heavy"))
    one = lambda of, times: F.struct(F.col(f"{of}.key"), F.col(f"{of}.span"), times.alias("times"))
    two = F.when(F.col("a") == F.col("b"), F.array(one("a", F.when(F.col("c") > 1, 2).otherwise(1)))).otherwise(F.array(one("a", F.lit(1)), one("b", F.lit(1))))
    chosen = table(classes.join(heavy, "gram").select("gram", "piece", "heavy", F.explode(two).alias("x")).select("gram", "piece", "heavy", "x.*"), "chosen")
    lists = chosen.groupBy("key").agg(F.collect_list(F.struct("span", "gram", "piece", "heavy", "times")).alias("spans"))
    texts = packed(rows, common.bitmap(chosen, "key"), all_rows=False).select("key", "packed").dropDuplicates(["key"])  # repeated rows have one key
    sorted_in = table(pieces(texts.join(lists, "key")), "pieces")
    decided = sort_buckets(sorted_in.where("not heavy")).unionByName(sort_single(sorted_in.where("heavy")))
    start = F.shiftright("span", 8)
    return found.join(decided, ["gram", "piece"]).select("key", (start + F.col("lo")).alias("lo"), (start + F.col("hi")).alias("hi"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    with common.small_batches(docs.sparkSession):
        ranges = table(repeated_ranges(rows), "ranges")
        lists = ranges.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
        found = packed(rows, common.bitmap(ranges, "key"), all_rows=True).join(lists, "key", "left")
        return table(finish(found.select("doc_id", "n_bytes", "packed", "sha", "ranges")), "kept")
