"""One query an operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import alignment, common, divergence, exact_dedup, langid, mixing, packing, pii, quality, search, simhash, suffixes, tokens, vectors

END_ID = 2
#: The queries' key; a real run brings its own.
PII_KEY = "demonstration key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(common.documents(spark, sf_dir), key=PII_KEY)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch(spark, "token-ids")
    parts = tokens.write(common.documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return tokens.read(parts, folder)


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(common.documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(common.documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir), words=3, distance=3)


def op10_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return search.search(docs, docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text"), n_terms=None, min_docs=1)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.documents(spark, sf_dir))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.by_document(alignment.align(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op2_token_output": op2_token_output,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_best_fit": op4_best_fit,
    "op5_language": op5_language,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op8_quality": op8_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op9_simhash": op9_simhash,
    "op10_bm25_search": op10_bm25_search,
    "op11_divergence": op11_divergence,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op11_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents),
        t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
        v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        k AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
        w AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM k GROUP BY ALL),
        s AS (SELECT lang, count(*) AS terms, sum(total) AS of_lang FROM w GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS of FROM g LEFT JOIN k USING (lang, source) GROUP BY ALL),
        c AS (
          SELECT gn.lang, gn.source, w.term, coalesce(k.n, 0) AS n,
                 (1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 2)) // (of + 2 * terms))::BIGINT AS p, (1 + (1000000000::HUGEINT * (total + 2)) // (of_lang + 2 * terms))::BIGINT AS q
          FROM gn JOIN s USING (lang) JOIN w USING (lang) LEFT JOIN k ON k.lang = gn.lang AND k.source = gn.source AND k.term = w.term),
        f AS (
          SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
          FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (
          SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
          FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM c WHERE n > 0 AND p > q),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
        SELECT * FROM z WHERE part = 'pair' OR rank <= 10
    """,
}
