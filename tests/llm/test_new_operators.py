"""Divergence audit, vector near-duplicates and cross-tokenizer alignment against plain versions, over odd tables too."""

import hashlib
import math
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from tallyforge.llm import alignment, common, divergence, queries, tokens, vectors  # noqa: E402

SMALL = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SMALL)


# --- divergence ------------------------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (te or "").translate(lower))) for la, so, te in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for la, _, ts in docs if la == lang for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        sources = sorted({so for la, so, _ in docs if la == lang})
        n = {so: Counter(t for la, s, ts in docs if la == lang and s == so for t in ts if t in set(kept)) for so in sources}
        share = lambda c, of, v=len(kept): 1 + 10**9 * (c + 2) // (of + 2 * v)
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p = {so: {t: share(n[so][t], sum(n[so].values())) for t in kept} for so in sources}
        whole = sum(n.values(), Counter())
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for so in sources:
            pairs = [(o, sum(apart(p[so][t], p[o][t]) for t in kept)) for o in sources if o != so]
            terms = [(t, apart(p[so][t], q[t])) for t in kept if n[so][t] > 0 and p[so][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, so, part, item, v, i) for i, (item, v) in enumerate(ranked, 1)]
    return sorted(out)


def found_audit(df, **more):
    return sorted(tuple(r) for r in divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_a_plain_version(spark):
    words = "the The THE fox Éclair éclair naïve x1y 日本 a_b don't".split()
    rng = np.random.default_rng(4)
    rows = [(["en", "fr", None][i % 3], [f"s{i % 4}", None][i % 7 == 0], " ".join(rng.choice(words, 1 + i % 30))) for i in range(200)]
    rows += [("en", "s1", None), ("en", "s9", ""), ("zz", "only", "few words here"), ("zz", "two", "1234 -- 5"), ("en", "s1", "fox " * 5000), ("en", "s1", "fox"), ("en", "s1", "fox")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term int, key string")
    assert found_audit(df) == plain_audit(rows, 10, 10)
    assert found_audit(df, min_docs=1, top=3) == plain_audit(rows, 1, 3)
    assert found_audit(df.where("false")) == []


def test_audit_of_all_documents(docs):
    assert found_audit(docs) == plain_audit([(r.lang, r.source, r.text) for r in docs.collect()], 10, 10)


# --- vectors ---------------------------------------------------------------------------------------


def plain_vectors(rows, threshold=0.9):
    """n_links, component_id, kept of each row, by all pairs."""
    wide = max([len(v) for _, v in rows if v] or [1])
    units = []
    for _, v in rows:
        fine = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        u = np.zeros(wide)
        if fine:
            u[: len(v)] = np.array(v) / max(map(abs, v))
            u /= np.linalg.norm(u)
        units.append(u)
    near = np.array(units) @ np.array(units).T >= threshold if rows else np.zeros((0, 0), bool)
    np.fill_diagonal(near, False)
    label = list(range(len(rows)))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = label[i], label[j]
        if a != b:
            label = [a if x == b else x for x in label]
    members = defaultdict(list)
    for i, x in enumerate(label):
        members[x].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in members[label[i]] if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((d, int(near[i].sum()), least, d is not None and d == least))
    return sorted(out, key=str)


def found_vectors(df, **more):
    return sorted((tuple(r) for r in vectors.near_duplicates(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_odd_vectors_equal_a_plain_version(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[i % 20] + 0.1 * rng.normal(size=8)).tolist()) for i in range(200)]
    rows += [(300 + i, base[0].tolist()) for i in range(80)]  # copies
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] * 4), (404, [float("nan")] * 8), (405, [float("inf")] + [0.0] * 7), (None, base[1].tolist()), (None, [0.0] * 8), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(500, (base[2] * 1e200).tolist()), (501, (base[2] * 1e-200).tolist()), (502, base[3][:4].tolist()), (503, [*base[3][:4].tolist(), 0.0, -0.0]), (504, [5e-324] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, node int, digest string")
    assert found_vectors(df) == plain_vectors(rows)
    assert found_vectors(df.where("false")) == []
    assert found_vectors(df.where("vec_id in (400, 402)")) == plain_vectors(rows[280:281] + rows[282:283])


def test_hot_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    one = rng.normal(size=16)
    rows = [(i, (one + 0.05 * rng.normal(size=16)).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert found_vectors(df) == plain_vectors(exact)


def test_recall_of_links_near_the_threshold(spark):
    """Pairs of cosine 0.90 to 0.92 in random directions: the hardest to find."""
    rng = np.random.default_rng(2)
    n, wide = 4000, 64
    left = rng.normal(size=(n, wide))
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    off = rng.normal(size=(n, wide))
    off -= (off * left).sum(axis=1, keepdims=True) * left
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.901, 0.92, size=(n, 1))
    both = np.concatenate([left, cos * left + np.sqrt(1 - cos**2) * off])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    links = vectors.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * 2 * n <= links <= 2 * n


def test_vectors_of_a_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert found_vectors(df) == plain_vectors([(r.vec_id, list(r.embedding)) for r in df.collect()])


# --- alignment -------------------------------------------------------------------------------------


def plain_alignment(rows):
    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    back = {c: b for b, c in tokens.byte_letters().items()}

    def spans(found):
        at, out = 0, []
        for i, raw in found:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def one(text):
        if not text:
            return None
        raw, e = f" {text}".encode(), a_model.encode(f" {text}", add_special_tokens=False)
        a = [(i, bytes(back[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = [(i, bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()) for i in b_model.encode(text)]
        if any(b"".join(x for _, x in side) != raw for side in (a, b)):
            return None
        a, b = spans(a), spans(b)
        groups, links, start = [], [], 0
        for cut in sorted({x[2] for x in a} & {x[2] for x in b}):
            ga, gb = ([x for x in side if start < x[2] <= cut] for side in (a, b))
            groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            start = cut
        return len(a), len(b), groups, links

    found = [(d, one(t)) for d, t in rows]
    n = Counter(link for _, f in found if f for link in f[3])
    most: dict[int, int] = {}
    for (_, b), c in n.items():
        most[b] = max(most.get(b, 0), c)
    out = []
    for d, f in found:
        if f:
            a, b, groups, links = f
            out.append((d, a, b, len(groups), len(links), sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        else:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
    return sorted(out, key=str)


def found_alignment(df, **more):
    return sorted((tuple(r) for r in alignment.by_document(alignment.align(df, A_PATH, B_PATH, **more)).collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, "a  b \n c\n\nd\t x"), (4, "x▁y and more"), (5, "<|endoftext|> <s> </s> <0x41>"), (6, " "), (7, "\n"), (8, "a\0b c"), (9, "and more words and more"), (9, "and more words and more"), (None, "　x    y  z"),
    (11, "เก\U0001f600\U0001f468‍\U0001f469 don't we'll\r\n  ok"), (12, "  lead"), (13, "trail  "), (14, "\x1c a\x85 b"), (15, "words and ▁ more and more " * 3), (16, "word " * 20_000), (17, "x" * 3_000), (18, "日本語の文章 ünïcödé"),
]


@pytest.mark.parametrize(("block_bytes", "broadcast"), [(60, 0), (1 << 20, 1 << 20)])
def test_alignment_of_odd_texts(spark, monkeypatch, block_bytes, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    df = spark.createDataFrame([(*r, "x", 5) for r in ODD], "doc_id long, text string, seg string, sid int").repartition(3)
    assert found_alignment(df, block_bytes=block_bytes) == plain_alignment(ODD)
    assert found_alignment(df.where("false")) == []


def test_alignment_by_whole_texts_is_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(alignment, "cut_alike", lambda a, b: False)
    rows = [*ODD[:15], *((r.doc_id, r.text) for r in docs.limit(20).collect())]
    assert found_alignment(spark.createDataFrame(rows, "doc_id long, text string")) == plain_alignment(rows)


def test_alignment_of_all_documents(spark, docs):
    found = sorted((tuple(r) for r in queries.op13_alignment(spark, SMALL).collect()), key=str)
    assert found == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_segments_put_together_are_the_text():
    for _, text in ODD:
        if text:
            assert "".join(alignment.segments(text)) == f" {text}"
    assert alignment.segments("a b\nc  d") == [" a", " b", "\nc", "  d"]
    assert alignment.cut_alike(A_PATH, B_PATH)
