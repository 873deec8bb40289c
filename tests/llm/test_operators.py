"""Each operator against a plain version, an exact round trip or held-out accuracy, and over odd tables."""

import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tallyforge.llm import common, exact_dedup, fuse, langid, mixing, packing, pii, quality, queries, resemblance, search, simhash, suffixes, tokens  # noqa: E402

SMALL = "/root/testdata/sf0.001"
PASSAGE = "the quick brown fox jumps over the lazy dog and then it does so again and again " * 5
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \t\n", None, "a"),
    (4, "One two three four five six seven.", "en", "a"),
    (4, "One two three four five six seven.", "en", "a"),
    (5, "One  two three\tfour five six seven.", "en", "b"),
    (6, PASSAGE + "tail", "en", "b"),
    (7, "head " + PASSAGE, "fr", "b"),
    (8, "x" * 700, None, None),
    (9, "é" * 300 + " Ünïcode ß 日本語", "de", "a"),
    (None, "no id here 4111 1111 1111 1111", "en", "a"),
    (10, "word " * 20000, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, len(r[1] or ""), "clash", 0) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, bits int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SMALL)


OPERATORS = {
    "pii": lambda d: pii.replace(d, "k"),
    "mixing": mixing.mix,
    "packing": packing.pack,
    "langid": langid.identify,
    "suffixes": suffixes.remove_repeats,
    "exact": exact_dedup.exact_duplicates,
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(name, odd, empty):
    got = OPERATORS[name](odd).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ODD}
    if name != "packing":
        assert len(got) == len(ODD)
    assert OPERATORS[name](empty).collect() == []


def test_pii_is_a_permutation_that_keeps_formats(spark):
    cards = [f"4{i:014d}" for i in range(300)]
    cards = [c + str((10 - sum((int(d) * 2 // 10 + int(d) * 2 % 10) if i % 2 == 0 else int(d) for i, d in enumerate(c[::-1]))) % 10) for c in cards]
    dates = [f"{y}-{m:02d}-{d:02d}" for y in (1999, 2024) for m in range(1, 13) for d in range(1, 29)]
    texts = [*cards, *dates, *(f"10.0.{i}.{i % 7}" for i in range(256)), *(f"+1 (555) 010-{i:04d}" for i in range(200)), *(f"user{i}@mail.example.org" for i in range(100)), *(f"123-45-{i:04d}" for i in range(1, 100))]
    got = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert len(set(got.values())) == len(texts)
    shape = lambda t: "".join("9" if c.isdigit() else "a" if c.islower() else c for c in t)
    for i, t in enumerate(texts):
        assert got[i] != t
        if "." not in t or "@" in t:
            assert shape(got[i]) == shape(t)
    luhn = lambda c: sum((int(d) * 2 // 10 + int(d) * 2 % 10) if i % 2 else int(d) for i, d in enumerate(c[::-1])) % 10
    assert all(luhn(got[i]) == 0 for i in range(len(cards)))
    assert all(all(0 <= int(o) <= 255 for o in got[i].split(".")) for i, t in enumerate(texts) if t.startswith("10.0."))


def test_pii_equals_a_plain_feistel_network_and_its_inverse(spark):
    lower, upper, ten, sixteen = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    hexes = [("0123456789abcdef" * 4)[i : i + 32 + i] for i in range(12)] + ["ABCDEF0123456789" * 2]
    numbers = [f"{7 * 10**14 + i * 98765432123}" for i in range(40)]
    emails = [f"Ab{i}.c-d@mail{i}.Example.org" for i in range(12)]
    table = spark.createDataFrame(list(enumerate([*hexes, *numbers, *emails])), "doc_id long, text string")
    got = [r.text for r in pii.replace(table, "k").orderBy("doc_id").collect()]
    for x, y in zip(hexes, got, strict=False):
        low = brute.feistel_text(x.lower(), "k|hex", [sixteen])
        assert y == (low.upper() if x.isupper() else low) and brute.feistel_text(y.lower(), "k|hex", [sixteen], back=True) == x.lower() and y != x
    luhn = lambda c: sum((int(d) * 2 // 10 + int(d) * 2 % 10) if i % 2 else int(d) for i, d in enumerate(c[::-1])) % 10
    for x, y in zip(numbers, got[len(hexes) :], strict=False):
        if luhn(x) == 0:
            assert y[:-1] == brute.feistel_digits(x[:-1], "k|card") and luhn(y) == 0 and brute.feistel_digits(y[:-1], "k|card", back=True) == x[:-1]
        else:
            assert y == brute.feistel_digits(x, "k|digits") and brute.feistel_digits(y, "k|digits", back=True) == x
    for x, y in zip(emails, got[len(hexes) + len(numbers) :], strict=True):
        local, domain = x.split("@")
        head = domain[: domain.rindex(".") + 1]
        assert y == brute.feistel_text(local, "k|local", [lower, upper, ten]) + "@" + brute.feistel_text(head, "k|domain", [lower, upper, ten]) + "org"
        assert brute.feistel_text(y.split("@")[0], "k|local", [lower, upper, ten], back=True) == local


def test_pii_links_equal_values_and_leaves_the_rest(spark):
    rows = [(1, "call +1 (017) 555-7713 or a.b@c.example.com"), (2, "+1 (017) 555-7713!!"), (3, "1990-02-31 999.1.1.1 version 1.2.3 of 2024"), (4, "nothing")]
    got = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got[3] == rows[2][1] and got[4] == "nothing"
    assert got[2][:-2] in got[1] and "555-7713" not in got[1] and "a.b@" not in got[1]


def test_token_files_round_trip(spark, docs, odd, empty, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = tokens.tokenizer(path)
    for name, table in (("docs", docs), ("odd", odd), ("empty", empty)):
        folder = str(tmp_path / name)
        got = tokens.read(tokens.write(table, folder, path, 2), folder).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
        rows = sorted(((r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        start = 0
        assert len(got) == len(rows)
        for g, (d, t) in zip(got, rows, strict=True):
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_word_encoder_equals_the_tokenizer():
    import public_tokenizers

    words = tokens.word_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("a  b", "", "  ", " x", "x ", "a\n\nb", "it's I'll 12 a1b2\tc \n d", "<|endoftext|> x", "日本 語 x", "\nabc\ndef", "a\r\nb c", "é a", "x .y", "x. ..y", "a_. b", "!. c", "a.b.c , d", "́. x", "x\xa0y z. ", "3.14,5 a", "ﬁ ²³ a.b"):
        assert np.frombuffer(words.encode(t, "H"), "<u2").tolist() == words.full.encode(t, add_special_tokens=False).ids, t


def test_mix_is_earliest_deadline_first(spark, docs, odd):
    given = {"src0": 0.6, "src1": 0.3, "src2": 0.1}
    for table, weights in ((docs, given), (docs, None), (docs, {"src0": 3.0, "src3": 0.00001}), (odd.dropDuplicates(["doc_id"]), None)):
        frame = weights and spark.createDataFrame(list(weights.items()), "source string, weight double")
        got = mixing.mix(table, frame, block_bytes=512).collect()
        rows = [(r.doc_id, r.source, len((r.text or "").encode())) for r in table.select("doc_id", "source", "text").collect()]
        want, slots, w = brute.mix(rows, weights, 512)
        assert {(r.doc_id, r.source): (r.block, r.slot) for r in got} == want and len(got) == len(rows)
    whole = mixing.shares(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "source string, volume long"), spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "source string, weight double"))
    assert {r.source: round(r.weight, 12) for r in whole.collect()} == {"a": 0.6, "b": 0.3, "c": 0.1}


def test_mix_never_drifts_from_its_weights(spark):
    weights = [("a", 0.61803), ("b", 0.271828), ("c", 0.1), ("d", 0.010142)]
    volumes = spark.createDataFrame([(s, 1) for s, _ in weights], "source string, volume long")
    blocks = spark.createDataFrame(weights, "source string, weight double").selectExpr("source", "explode(sequence(0, cast(weight * 60000 as int))) AS block").selectExpr("source", "cast(block as long) AS block")
    rows = sorted(mixing.slotted(blocks, mixing.shares(volumes, spark.createDataFrame(weights, "source string, weight double"))).collect(), key=lambda r: r.slot)
    assert len({r.slot for r in rows}) == len(rows) == blocks.count()
    total, done = sum(w for _, w in weights), dict.fromkeys("abcd", 0)
    for t, r in enumerate(rows[:59_000]):
        assert r.slot == t
        done[r.source] += 1
        assert all(abs(done[s] - w / total * (t + 1)) < 2 for s, w in weights)


def test_mix_of_very_many_sources(spark):
    table = spark.range(700).selectExpr("id AS doc_id", "'some text' AS text", "concat('s', id % 650) AS source")
    got = mixing.mix(table, block_bytes=4).collect()
    assert len(got) == 700 and len({(r.source, r.slot) for r in got}) == 700


def test_packing_places_every_word_once(docs, odd):
    for table in (docs, odd):
        got = packing.pack(table, (64, 128, 512), group_items=50).collect()
        need = {r.doc_id: 0 for r in got}
        for r in got:
            need[r.doc_id] += r.length
        want = {}
        for r in table.select("doc_id", packing.words(F.col("text")).alias("n")).collect():
            want[r.doc_id] = want.get(r.doc_id, 0) + r.n
        assert need == want
        bins = {}
        for r in got:
            bins.setdefault(r.bin_id, []).append((r.start, r.length, r.capacity))
        for items in bins.values():
            end = 0
            for start, length, capacity in sorted(items):
                assert start == end
                end += length
            assert {c for _, _, c in items} == {min(c for c in (64, 128, 512) if c >= end)}
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = sorted(map(int, rng.integers(1, 513, rng.integers(1, 90))), reverse=True)
        assert packing.best_fit(lengths, (64, 128, 512)) == brute.best_fit(lengths, (64, 128, 512), packing.OVERHEAD)
    assert packing.best_fit([60, 50, 40, 4], (64, 128), 0) == [(0, 64, 0), (1, 64, 0), (2, 64, 0), (0, 64, 60)]
    assert packing.best_fit([60, 60, 8], (64, 128), 32) == [(0, 128, 0), (0, 128, 60), (0, 128, 120)]


def test_language_and_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in common.documents(spark, d).collect()}
    got = [r for r in queries.op5_language(spark, d).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in queries.op8_quality(spark, d).collect() if r.held_out and r.doc_id in label]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == label[r.doc_id] for r in got]) > 0.9


def test_language_and_quality_equal_plain_versions(spark, docs, odd):
    table = docs.select("doc_id", "text", "lang").unionByName(odd.where("doc_id is null or doc_id not in (4, 10)").select("doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id") + 100_000))
    rows = table.collect()
    train = [(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None and (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 != 1)]
    want = brute.languages([(r.doc_id, r.text) for r in rows], train)
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in langid.identify(table).collect()}
    assert got.keys() == want.keys()
    for d, (lang, score) in want.items():
        assert got[d][0] == lang and abs(got[d][1] - score) < 1e-9 and got[d][2] == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs, labels.selectExpr("doc_id", "quality AS label"))
    scores = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    for r in rows:
        if len(r.text or "") < 3000:
            assert abs(scores[r.doc_id] - brute.quality((r.text or "").encode(), model.weights, model.bias)) < 1e-5


def test_language_of_texts_without_letters(odd):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1, 2, 3))


def test_quality_without_labels_or_texts(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    assert quality.classify(empty, none).collect() == []


@pytest.mark.parametrize("heavy", [4096, 1])
def test_repeats_against_brute_force(spark, odd, monkeypatch, heavy):
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    near = [(100 + i, f"{i} unlike start {'abc' * i} " + PASSAGE[:300] + f" and {i} another end") for i in range(12)]
    table = odd.where("doc_id is null or doc_id <> 10").select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rng = np.random.default_rng(2)
    long = "".join(map(chr, rng.integers(97, 123, suffixes.CHUNK + 9000)))  # over one chunk; what it shares lies across the cut
    cross = long[suffixes.CHUNK - 700 : suffixes.CHUNK + 900]
    shared = [(200, long), (201, "other " + cross + " words"), (202, long[:500] + cross[300:700])] + [(210 + i, f"{i * 7919} " * 40 + PASSAGE[:290] + f" {i * 104729}" * 40) for i in range(60)]
    table = table.unionByName(spark.createDataFrame(shared, "doc_id long, text string"))
    rows = [tuple(r) for r in table.collect()]
    sort = lambda x: sorted(x, key=str)
    assert sort(tuple(r) for r in suffixes.remove_repeats(table).collect()) == sort(brute.repeats(rows))


def test_multikey_finds_equal_windows():
    rng = np.random.default_rng(3)
    flat = rng.integers(97, 99, 3000).astype(np.uint8)
    flat[2000:2300] = flat[100:400]
    starts = np.arange(len(flat) - 60)
    seen = {}
    for i in starts:
        seen.setdefault(flat[i : i + 61 - 1].tobytes(), []).append(i)
    want = np.array([len(seen[flat[i : i + 60].tobytes()]) > 1 for i in starts])
    assert (suffixes.multikey(flat, starts, 60) == want).all() and want.any()


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        seed, table = fuse.build(keys)
        held = len(np.unique(keys))
        assert fuse.contains(keys, held, seed, table).all()
        if n >= 1000:
            assert fuse.contains(rng.integers(0, 1 << 63, 20_000).astype(np.uint64), held, seed, table).mean() < 0.01
            assert len(table) < 1.6 * n + 4096


def test_exact_dedup_ingests_batches(odd, docs):
    import hashlib
    import re

    for table, batches in ((docs, 3), (odd.where("doc_id is not null"), 2)):
        norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        rows = [(r.doc_id, norm(r.text)) for r in table.collect()]
        groups = {}
        for d, h in rows:
            groups.setdefault(h, []).append(d)
        want = sorted((d, min(groups[h]), len(groups[h]), d == min(groups[h]), h) for d, h in rows)
        assert sorted(tuple(r) for r in exact_dedup.exact_duplicates(table, batches).collect()) == want


def test_simhash_against_brute_force(odd, docs):
    for table in (docs.limit(150), odd.where("doc_id is not null")):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = sorted(tuple(r)[:3] for r in simhash.near_duplicates(table).collect())
        assert got == brute.near(rows)


def test_multi_index_hashing_finds_every_link(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(4)]
    every = sorted({*map(int, base), *near})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in every], "bits long")).collect()}
    want = {(a, b) for a in every for b in every if a > b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want and want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(30)}


def test_search_is_exact(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 60)
    monkeypatch.setattr(search, "BLOCK", 4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = {}
    for r in search.search(docs, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    import math
    from collections import Counter

    df = Counter(w for _, t in rows for w in set(brute.words(t)))
    mean = sum(len(brute.words(t)) for _, t in rows) / len(rows)
    code = {w: int(np.int64(search.terms([w.encode()])[1].view(np.int64)[0])) for w in df}
    chosen = {}
    for q, t in ((d, t) for d, t in rows if d % 20 == 0):
        tf = Counter(w for w in brute.words(t) if df[w] >= 2)
        n = len(brute.words(t)) / mean
        worth = sorted(tf, key=lambda w: (-math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * n)), code[w]))
        chosen[q] = worth[: search.QUERY_TERMS]
    want = {q: x for q, x in brute.bm25(rows, chosen).items() if x}
    assert got.keys() == want.keys()
    for q in want:
        assert [round(s, 6) for _, s in got[q]] == [round(s, 6) for _, s in want[q]]
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
    blank = odd.select(F.col("doc_id").alias("query_id"), "text")
    assert search.search(empty, blank).collect() == [] and search.search(odd, blank).count() > 0


def test_pipeline_keeps_one_of_each_and_packs_all(spark):
    docs = common.documents(spark, SMALL)
    kept, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.stored(stage(spark, kept, SMALL))
        assert kept.columns == columns, name
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2]
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len({" ".join((t or "").split()) for _, t in rows}) == len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in rows}


def test_scoring_a_batch_copies_a_slice_at_a_time():
    class Plain(quality.Model):
        def scores(self, texts):
            return np.array([float(len(t)) for t in texts])

    texts = pa.array(["x" * 1000] * 20_000 + [None, "", "y" * 3_000_000])  # 23 MB
    tracemalloc.start()
    got = quality.batch_scores(Plain(np.zeros(0), 0.0), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [1000.0] * 20_000 + [0.0, 0.0, 3_000_000.0] and peak < 12_000_000
    assert quality.batch_scores(Plain(np.zeros(0), 0.0), pa.array([], pa.string())).to_pylist() == []


def test_near_stage_links_all_of_similarity_four_fifths(spark, odd, docs, monkeypatch):
    rng = np.random.default_rng(11)
    some = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    for i in range(40):  # copies with one to twelve of their 200 words replaced
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for j in range(4):
            for at in rng.choice(200, rng.integers(1, 13), replace=False):
                base[at] = f"n{rng.integers(0, 5000)}"
            some.append((1000 + 10 * i + j, " ".join(base)))
    hot = [f"h{x}" for x in range(100)]
    some += [(2000 + i, " ".join(hot[:50] + [f"only{i}"] + hot[50:])) for i in range(30)] + [(3000 + i, " ".join(hot) + "".join(f" u{i}x{j}" for j in range(60))) for i in range(30)]
    table = spark.createDataFrame(some, "doc_id long, text string")
    for frequent in (4, 10**9):
        monkeypatch.setattr(resemblance, "FREQUENT", frequent)
        got = {r.doc_id for r in corpus_pipeline.near_stage(spark, table, SMALL).collect()}
        assert got == brute.near_kept(some)
    assert corpus_pipeline.near_stage(spark, odd.where("false"), SMALL).collect() == []


def test_near_stage_takes_simhash_first_and_checks_it(spark, monkeypatch):
    long, short = [f"w{i}" for i in range(20_000)], [f"v{i}" for i in range(12)]
    rows = [(1, " ".join(long)), (2, " ".join([*long, "more"])), (3, " ".join(short)), (4, " ".join(short[::-1])), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    seen, checked = [], resemblance.similar

    def similar(met, held):
        found = checked(met, held)
        seen.append((met.count(), found.count()))
        return found

    monkeypatch.setattr(resemblance, "similar", similar)
    monkeypatch.setattr(resemblance, "pairs", lambda *_: pytest.fail("what SimHash linked is paired again"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, table, SMALL).collect()) == [1, 3, 4, 5]
    assert seen == [(1, 1)]


def test_pairs_of_near_stage_grow_as_the_table(spark, monkeypatch):
    made, paired = {}, resemblance.pairs

    def counted(left, right, *also):
        found = paired(left, right, *also)
        made[n] = made.get(n, 0) + found.count()
        return found

    monkeypatch.setattr(resemblance, "pairs", counted)
    passages, rng = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(40)], np.random.default_rng(3)
    for n in (40, 160):  # texts of 30 of 40 common passages: two of them share some 22
        table = spark.createDataFrame([(i, " ".join(passages[j] for j in sorted(rng.choice(40, 30, replace=False)))) for i in range(n)], "doc_id long, text string")
        corpus_pipeline.near_stage(spark, table, SMALL).count()
    assert made[160] <= 5 * made[40]


def test_buckets_of_the_same_sets_are_one(spark):
    members = spark.createDataFrame([(k, s, 10, (k + s) % 4) for k in range(4) for s in (1, 2)] + [(9, s, 10, 0) for s in (1, 2, 3)], "key long, shape long, n int, at int")
    got = resemblance.merged(members).collect()
    assert sorted((r.size, r.shape, r.n, r["at"]) for r in got) == [(2, 1, 10, 0), (2, 2, 10, 0), (3, 1, 10, 0), (3, 2, 10, 0), (3, 3, 10, 0)]
    assert len({r.key for r in got}) == 2


def test_search_of_whole_texts_is_exact(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in common.documents(spark, SMALL).collect()]
    monkeypatch.setattr(search, "SHARD_DOCS", 60)
    got = {}
    for r in queries.op10_bm25_search(spark, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    want = brute.bm25(rows, {d: sorted(set(brute.words(t))) for d, t in rows if d % 20 == 0})
    assert got == {q: [(d, round(s, 6)) for d, s in x] for q, x in want.items() if x}
    alone = spark.createDataFrame([(1, "unheard of words"), (2, "other things")], "doc_id long, text string")
    assert {r.query_id: r.doc_id for r in search.search(alone, alone.selectExpr("doc_id AS query_id", "text"), n_terms=None, min_docs=1).collect()} == {1: 1, 2: 2}


def test_pruned_and_whole_scoring_agree():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 150) if x < 5000).encode() for _ in range(700)]
    of, term, tf, n = search.counted(texts)
    shard = search.Shard.build(list(range(len(texts))), [n], [(of, term, tf)])
    df = np.diff(shard.offsets.astype(np.int64))
    idf = np.log(1 + (700 - df + 0.5) / (df + 0.5))
    shard.weigh(float(n.mean()), shard.names.copy(), idf)
    assert 0 < shard.matrix.shape[1] < len(shard.names)
    for q in range(0, 700, 35):
        places = shard.at(term[of == q])
        score = np.zeros(700)
        for p in places:
            own = slice(shard.offsets[p], shard.offsets[p + 1])
            f = shard.tf[own].astype(float)
            score[shard.docs[own]] += idf[p] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n[shard.docs[own]] / n.mean()))
        order = np.lexsort((np.arange(700), -score.round(6)))[:10]
        for floor in (0.0, score[order[-1]] - 1e-6, score[order[4]] - 1e-6, score[order[0]] - 1e-6):
            for got, hits in (shard.top(places, 10, floor), next(shard.whole([places], 10, [floor]))):
                want = [d for d in order if score[d] >= floor]
                assert hits.tolist() == want and np.allclose(got, score[want])


def test_search_leaves_out_queries_without_an_id(spark):
    table = spark.createDataFrame([(None, "some words here"), (5, "some words here"), (6, "words " * 70_000 + "here")], "doc_id long, text string")
    got = [tuple(r)[:3] for r in search.search(table, table.selectExpr("doc_id AS query_id", "text"), n_terms=None, min_docs=1).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(5, 1, None), (5, 2, 5), (5, 3, 6)] and {r[0] for r in got} == {5, 6}


def test_rows_without_id_stay_if_their_text_is_theirs_alone(spark):
    same, near = "a text that two rows hold", " ".join(f"w{i}" for i in range(100))
    rows = [(None, same), (1, "one"), (2, "two"), (3, "three"), (4, same), (5, same), (None, "alone"), (None, "x  y"), (None, "x y"), (6, near), (None, near + " end")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(table).collect()
    assert len(got) == len(rows)
    key = {r.text: r.h for r in table.select("text", F.lower(F.hex(exact_dedup.digest(F.col("text")))).alias("h")).collect()}
    of = lambda t: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.text_sha256 == key[t]), key=str)
    assert of(same) == [(4, 4, 3, True), (5, 4, 3, False), (None, 4, 3, False)]
    assert of("alone") == [(None, None, 1, True)]
    exact = common.stored(corpus_pipeline.exact_stage(spark, table, SMALL))
    assert sorted((str(r.doc_id), " ".join(r.text.split())) for r in exact.collect()) == sorted([("1", "one"), ("2", "two"), ("3", "three"), ("4", same), ("None", "alone"), ("None", "x y"), ("6", near), ("None", near + " end")])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, exact, SMALL).collect()]
    assert (None, "alone") in kept and (6, near) in kept and len(kept) == 7


def test_packing_follows_the_mix(spark, docs, tmp_path, monkeypatch):
    mixed = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda d, w=None: mixed(d, w, block_bytes=4096))
    two = docs.where("source is not null").orderBy("source").select("source").distinct().limit(2).collect()
    one, other = two[0].source, two[1].source
    table, means = docs.where(F.col("source").isin(one, other)), []
    for favoured, rest in ((one, other), (other, one)):
        weights = spark.createDataFrame([(favoured, 50.0), (rest, 1.0)], "source string, weight double")
        at = str(tmp_path / favoured)
        corpus_pipeline.mix_stage(spark, table, SMALL, weights).write.parquet(at)
        slot = {r.doc_id: (r.slot, r.doc_id) for r in mixing.mix(table, weights).collect()}
        for read in (spark.read.parquet(at), common.stored(table.join(spark.createDataFrame([(d, s) for d, (s, _) in slot.items()], "doc_id long, slot long"), "doc_id").orderBy("slot", "doc_id").select(table["*"]))):
            got = packing.pack(read, group_items=10, ordered=True).collect()
            order = sorted(slot, key=slot.get)
            count = {d: sum(r.doc_id == d for r in got) for d in order}
            part, past = {}, 0
            for d in order:
                part[d] = sorted((past + i) // 10 for i in range(count[d]))
                past += count[d]
            assert {d: sorted(r.bin_id >> 32 for r in got if r.doc_id == d) for d in order} == part
        packed = corpus_pipeline.pack_stage(spark, spark.read.parquet(at), SMALL).collect()
        first = {}
        for r in packed:
            first[r.bin_id] = min(first.get(r.bin_id, slot[r.doc_id]), slot[r.doc_id])
        assert [first[b] for b in sorted(first)] == sorted(first.values())
        means.append([r.bin_id for r in sorted(packed, key=lambda r: (r.doc_id, r.piece))])
    assert means[0] != means[1]


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2))
    sets = [base, base[::2], base[:0], np.unique(np.concatenate([base[40:], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])), base[:1], base]
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    made = resemblance.sketches(of, np.concatenate(sets), len(sets)).reshape(len(sets), resemblance.WORDS)
    for i, a in enumerate(sets):
        assert sum(int(w).bit_count() for w in made[i]) % 2 == len(a) % 2
        for j, b in enumerate(sets):
            differ = sum((int(x) ^ int(y)).bit_count() for x, y in zip(made[i], made[j], strict=True))
            assert differ <= len(np.setxor1d(a, b))
    assert not resemblance.sketches(np.zeros(0, np.int64), np.zeros(0, np.uint64), 2).any()
