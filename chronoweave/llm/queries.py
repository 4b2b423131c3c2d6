"""The operators of this folder on the test tables, with production parameters.

``QUERIES`` and ``ORACLES`` are what ``__spark_entry__`` adds to its own.  Every query reads its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .byte_bpe import encode_documents
from .common import read_table
from .langid import fit as fit_languages
from .langid import identify
from .licenses import duckdb_sql as license_sql
from .licenses import scan_licenses
from .neardup import near_duplicates
from .packing import pack_documents
from .sharding import shard_by_bytes
from .topk import top_products
from .toxicity import fit as fit_toxicity
from .toxicity import score_documents
from .warc import deduplicated_archives


def op1_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return nearest(table, table.where("vec_id % 50 = 0"), k=5)


def op2_no_random_access_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return top_products(table, table.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated_archives(read_table(spark, sf_dir, "pages"), min_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_table(spark, sf_dir, "documents"), shards=16)


def op5_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs))


def op7_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    f.__name__: f
    for f in (
        op1_multiprobe_neighbours,
        op2_no_random_access_topk,
        op3_warc_revisits,
        op4_best_fit_shards,
        op5_hierarchical_packing,
        op6_nearest_centroid_language,
        op7_setsketch_near_duplicates,
        op8_license_digests,
        op9_compression_toxicity,
        op10_byte_bpe,
    )
}

ORACLES: dict[str, str] = {
    "op2_no_random_access_topk": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), placed AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
    """,
    "op3_warc_revisits": """
        WITH described AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), coded AS (
            SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substring(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((CAST('0x' || substring(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31), 1)), '') AS payload_digest
            FROM described
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id < max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to
        FROM coded WINDOW same AS (PARTITION BY payload_digest)
    """,
    "op7_setsketch_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
        ), shingles AS MATERIALIZED (
            SELECT doc_id, unnest(s) AS g FROM sets
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS MATERIALIZED (
            SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
        ), ways AS MATERIALIZED (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached AS (
            SELECT doc_id, doc_id AS low FROM sets UNION SELECT ways.b, reached.low FROM reached JOIN ways ON ways.a = reached.doc_id
        ), lowest AS (
            SELECT doc_id, min(low) AS component_id FROM reached GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
    """,
    "op8_license_digests": license_sql(),
}
