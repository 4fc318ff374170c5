"""The queries of this subpackage, with production parameters, over whole tables; SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshset.llm import bpe_codec, exact_dedup, katz, licenses, nn_descent, packing, quality, sharding, simhash, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), radius=3, words=3)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), least=0.8)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=2048)


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), sharding.topology(8), sharding.topology(9))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_licenses, op3_packing, op4_nn_descent, op5_token_counts, op6_quality,
        op7_bpe_codec, op8_katz, op9_exact_dedup, op10_sharding,
    )
}

ORACLE: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
             r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                          row_number() OVER w = 1 AS kept
                   FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
        SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
    """,
    # every pair of a label in full, then everything reachable by links
    "op4_nn_descent": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                                        AND len(list_filter(e, lambda x: x <> 0)) > 0),
             links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
                       WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
             reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
             least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
             counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
    """,
    # the first of 16 draws that meets a shard, by region, rack and place, else the smallest draw of the shards themselves (all weights are
    # 1, so that of the largest hash); the checksum is built bit by bit from its polynomial
    "op10_sharding": """
        WITH steps AS (SELECT list(c ORDER BY i) AS crc FROM (
                 SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
             k AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
             d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
                          xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                                          lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32,
                          list_transform(list_transform(range(16), lambda n: md5(key || '@' || n)), lambda m: CAST('0x' || m[1:6] AS BIGINT) % 4 * 4
                                         + CAST('0x' || m[7:12] AS BIGINT) % 2 * 2 + CAST('0x' || m[13:18] AS BIGINT) % 2) AS met,
                          list_transform(range(9), lambda s: CAST('0x' || substr(md5(key || '@' || (s // 4) || '/' || (s // 2 % 2) || '/' || (s % 2)), 1, 13) AS BIGINT)) AS own
                   FROM k, steps),
             p AS (SELECT doc_id, size, text_crc32, CAST(coalesce(list_filter(met, lambda s: s < 8)[1], list_position(own[1:8], list_max(own[1:8])) - 1) AS INTEGER) AS shard,
                          CAST(coalesce(list_filter(met, lambda s: s < 9)[1], list_position(own, list_max(own)) - 1) AS INTEGER) AS grown_shard FROM d)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM p
    """,
}
