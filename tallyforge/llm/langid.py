"""Language identification by rank-order profiles.

A profile lists a language's most frequent n-grams (1 to 3 letters, word ends marked) in order. A
document's own most frequent n-grams are compared with each profile by out-of-place distance: how
far each stands from its place there, or the profile's length if it isn't there. The nearest
profile wins; of equally near ones the first by name.

Profiles are counted over the whole texts of all training rows: each task sums its own counts by
language first, and each language's list is a top-k of the sums. Null texts and texts without a
letter are `und` with score 0; without training rows every text is. Repeated rows count as often as
they come; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import common

PROFILE = 300
SPACE = 32
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def grams(texts: list[str], most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text index, gram (48-bit hash) and count of each different n-gram, sorted by index and gram; at most 32,768 texts."""
    assert len(texts) <= most
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    flat, owner = np.concatenate(points), np.repeat(np.arange(len(texts), dtype=np.uint64), [len(p) for p in points])
    letter = letters()[flat]
    kept = letter | np.concatenate([[True], letter[:-1]]) | np.concatenate([[True], owner[1:] != owner[:-1]])
    c, owner = np.where(letter, flat, SPACE)[kept].astype(np.uint64), owner[kept]
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    ok1, ok2, ok3 = c != SPACE, (owner[:-1] == owner[1:]) & (two != SPACE << 21 | SPACE), owner[:-2] == owner[2:]
    ok3 &= two[:-1] != SPACE << 21 | SPACE
    gram = np.concatenate([c[ok1], two[ok2], three[ok3]])
    of = np.concatenate([owner[ok1], owner[:-1][ok2], owner[:-2][ok3]])
    keys = np.sort(of << np.uint64(48) | gram * FACTOR >> np.uint64(16))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    found = keys[first]
    return (found >> np.uint64(48)).astype(np.int64), found & np.uint64((1 << 48) - 1), np.diff(np.append(first, len(keys)))


def ranked(of: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `size` most frequent grams of each text (of equal ones the smaller hash first), and their ranks from 0."""
    order = np.argsort(of << 32 | ((1 << 32) - 1 - np.minimum(n, (1 << 32) - 1)), kind="stable")
    of, gram = of[order], gram[order]
    start = np.concatenate([[True], of[1:] != of[:-1]])
    rank = np.arange(len(of)) - np.maximum.accumulate(np.where(start, np.arange(len(of)), 0)) if len(of) else np.zeros(0, int)
    return of[rank < size], gram[rank < size], rank[rank < size]


@dataclass
class Profiles:
    names: list[str]
    grams: np.ndarray  # all profiles' grams, sorted
    ranks: np.ndarray  # of each in each profile, or `size`; the last row is that of grams in none
    size: int

    def nearest(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        of, gram, rank = ranked(*grams(texts), self.size)
        if not self.names or not len(of):
            return ["und"] * len(texts), np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        there = self.ranks[at]
        apart = np.where(there == self.size, self.size, np.abs(there - rank[:, None]))
        total = np.stack([np.bincount(of, apart[:, k], len(texts)) for k in range(len(self.names))], axis=1)
        n = np.bincount(of, minlength=len(texts))
        best = total.argmin(axis=1)
        score = np.where(n > 0, 1 - total.min(axis=1) / np.maximum(n * self.size, 1), 0.0)
        return [self.names[b] if k else "und" for b, k in zip(best, n, strict=True)], score


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        for i in range(0, batch.num_rows, 1 << 15):
            yield batch.slice(i, 1 << 15)


def counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            gram = np.concatenate([g for g, _ in held[lang]])
            found, back = np.unique(gram, return_inverse=True)
            return found, np.bincount(back, np.concatenate([n for _, n in held[lang]]), len(found)).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            gram, n = merged(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in parts(batches):
            of, gram, n = grams([t or "" for t in batch.column("text").to_pylist()])
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            for k, name in enumerate(names):
                chosen = code[of] == k
                held[name].append((gram[chosen], n[chosen]))
                if len(held[name]) >= 16:
                    held[name] = [merged(name)]
                    if len(held[name][0][0]) > 1 << 20:  # a script with very many n-grams: hand on what there is
                        yield out(name)
                        del held[name]
        for name in sorted(held):
            yield out(name)

    summed = docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return summed.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of the languages in docs (text, lang); rows without either teach nothing."""
    total = common.stored(counts(docs.where("lang is not null and text is not null")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    lists: dict[str, list[int]] = defaultdict(list)
    for lang, gram, _ in total.select("lang", "gram", place.alias("place")).where(F.col("place") <= size).orderBy("lang", "place").collect():  # `size` rows a language
        lists[lang].append(gram)
    names = sorted(lists)
    every = np.unique(np.array([g for found in lists.values() for g in found], np.uint64))
    ranks = np.full((len(every) + 1, len(names)), size, np.int64)
    for k, name in enumerate(names):
        ranks[np.searchsorted(every, np.array(lists[name], np.uint64)), k] = np.arange(len(lists[name]))
    return Profiles(names, every, ranks, size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE entries a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            lang, score = held.value.nearest([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """By the id; a row without one is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows that aren't held out."""
    return predict(docs, learn(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
