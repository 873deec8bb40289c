"""Token-id output: flat unsigned integer files with 64-bit document offsets, one pair a partition.

`part-00000.bin` holds the ids of a range of documents, one after another, little-endian in the
narrowest unsigned type that holds the vocabulary (2 or 4 bytes); `part-00000.idx` is a numpy file of
n + 1 unsigned 64-bit offsets into it, counted in ids, after the n doc_ids. Files are in ascending
doc_id order, across and within. A task writes under a name of its own attempt and renames, so a
lost executor's rerun replaces whole files. A partition's base is the prefix sum of the totals of
those before it: one number a file reaches the driver.

Null is empty and gets just the end id; repeated rows are written as often as they come, ordered by
doc_id and then text (rows of one id that fill several files: by the text's first 64 characters
across files); rows with a null doc_id come first; a very long text is one document; an empty table gives no documents.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import common

PART_SCHEMA = "part int, n_docs long, n_ids long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Words whose ids a Python worker keeps at most.
CACHED_WORDS = 600_000


def byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself if printable, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """The same ids as Tokenizer.encode of a whole text, word by word with a bounded cache.

    A byte-level pre-tokenizer always begins a new token where white space follows something else,
    where a newline stands between two other characters, and where a stop or comma follows a letter
    or digit, so texts are cut there. A plain word goes straight to the model; any other piece to
    encode(). Texts in which white space comes in runs or at the end, and tokenizers of another
    kind, are encoded whole.
    """

    #: A stop or comma that follows no letter or digit: it may belong to the token before it.
    LOOSE = re.compile(r"[.,](?<![^\W_][.,])").search
    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*]*)").fullmatch

    def __init__(self, found) -> None:
        pre = repr(found.pre_tokenizer)
        self.whole = not (pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre and found.normalizer is None)
        self.full, self.model, self.letters = found, found.model, byte_letters()
        self.held: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def ids(self, text: str, kind: str) -> bytes:
        return array(kind, self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, word: str, bare: str, kind: str) -> bytes:
        """Ids of a word as it stands after a space, or as it is if it begins with one of `bare`."""
        if m := self.PLAIN(word):
            name = ("\u0120" + m[1]) if word.isascii() else ("\u0120" + m[1].encode().decode("latin-1").translate(self.letters))
            found = [t.id for t in self.model.tokenize(name)]
            if m[2]:
                found += [t.id for t in self.model.tokenize(m[2])]
            return array(kind, found).tobytes()
        return self.ids(word if word[0] in bare else f" {word}", kind)

    def encode(self, text: str, kind: str) -> bytes:
        if self.whole:
            return self.ids(text, kind)
        loose = bool(self.LOOSE(text))
        cut, bare, held = text.replace("\n", " \n"), "\n", self.held[loose]
        if not loose:
            cut, bare = cut.replace(".", " .").replace(",", " ,"), "\n.,"
        first, *words = cut.split(" ")
        if new := set(words).difference(held):
            if len(held) + len(new) > CACHED_WORDS:
                held.clear()
                new = set(words)
            for word in new:
                if not word or word[-1].isspace():
                    return self.ids(text, kind)
                held[word] = self.piece(word, bare, kind)
        return self.ids(first, kind) + b"".join(map(held.__getitem__, words))


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(tokenizer(path))


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def _store(files: pafs.FileSystem, path: str, pieces: Iterator[bytes]) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        for piece in pieces:
            out.write(piece)
    files.move(own, path)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) to `folder`; returns part, n_docs, n_ids and base of each file."""
    spark = docs.sparkSession
    wide = tokenizer(tokenizer_path).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    kind = "<u4" if wide else "<u2"
    files, path = common.place(folder)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], kind).tobytes()
        to, at = common.place(folder)
        ids, ends = [], [0]

        def pieces() -> Iterator[bytes]:
            for batch in common.slices(batches, "text"):
                ids.extend(batch.column("doc_id").to_pylist())
                for text in batch.column("text").to_pylist():
                    found = encode.encode(text or "", "I" if wide else "H") + end
                    ends.append(ends[-1] + len(found) // len(end))
                    yield found

        _store(to, f"{at}/part-{part:05}.bin", pieces())
        missing = np.iinfo(np.int64).min
        index = np.concatenate([np.array([missing if i is None else i for i in ids], "<i8").view("<u8"), np.array(ends, "<u8")])
        _store(to, f"{at}/part-{part:05}.idx", iter([index.tobytes()]))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(ids)], "n_ids": [ends[-1]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows of one id, or of none, spread by how their texts begin and by their place in the input
    dealt = rows.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.substring("text", 1, 64), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "text")
    totals = {p: (d, i) for p, d, i in dealt.mapInArrow(run, PART_SCHEMA).collect()}  # one row a file
    bases, base = [], 0
    for p in sorted(totals):
        bases.append((p, *totals[p], base))
        base += totals[p][1]
    return spark.createDataFrame(bases, f"{PART_SCHEMA}, base long")


def read(parts: DataFrame, folder: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, from the files."""
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = common.place(folder)
        local = isinstance(files, pafs.LocalFileSystem)
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{at}/part-{row['part']:05}"
                with files.open_input_stream(f"{stem}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8")
                n = row["n_docs"]
                ids, ends = index[:n].view("<i8"), index[n:].astype(np.int64)
                if local:  # mapped: only the pages in use are in memory
                    flat = np.memmap(f"{stem}.bin", kind, "r") if row["n_ids"] else np.zeros(0, kind)
                    span = lambda a, b, flat=flat: flat[a:b]
                else:
                    held = files.open_input_file(f"{stem}.bin")
                    span = lambda a, b, held=held: np.frombuffer(held.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)
                for i in range(0, n, 10_000):
                    j = min(n, i + 10_000)
                    sums = [zlib.crc32(span(ends[k], ends[k + 1]).astype("<u4").tobytes()) for k in range(i, j)]
                    missing = ids[i:j] == np.iinfo(np.int64).min
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64(), mask=missing), pa.array(ends[i:j] + row["base"]), pa.array(np.diff(ends[i : j + 1])), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.repartition(max(1, parts.count()), "part").mapInArrow(run, DOC_SCHEMA)
