"""The operators of this subpackage as registered queries, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cosecha.llm import bpe, fingerprints, language_id, license_scan, lm_score, mixing, ngram_join, prefix_trie, sharding, spelling_variants, suffix_dedup, url_filter, vector_join


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(_table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_level_bpe,
        op2_embedding_neighbours,
        op3_ngram_jaccard_join,
        op4_order_minhash,
        op5_url_filter,
        op6_language_id,
        op7_mix_sources,
        op8_cross_entropy_difference,
        op9_suffix_dedup,
        op10_rendezvous_shards,
        op11_conversation_trie,
        op12_license_scan,
        op13_spelling_variants,
    )
}


def _crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a string's UTF-8 bytes: a shift for each bit of each byte."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substring(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    bits = f"flatten(list_transform({octets}, lambda o: [o, 0, 0, 0, 0, 0, 0, 0]))"
    shift = "(xor(a, o) >> 1)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, o: xor({shift}, 3988292384 * (xor(a, o) & 1))), 4294967295)"


OP11_SQL = f"""
WITH t AS (
    SELECT conv_id, md5(length(role) || ':' || role || text) AS x, length(text) AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 64), md5(length(role) || ':' || role || text)) AS i
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM sizes),
r AS (
    SELECT c.conv_id, t.i AS d, x, chars FROM c JOIN t ON t.conv_id = c.base AND t.i <= h
    UNION ALL
    SELECT c.conv_id, least(h, coalesce(b.n, 0)) + t.i - h, x, chars
    FROM c LEFT JOIN sizes b ON b.conv_id = c.base JOIN t ON t.conv_id = c.conv_id AND t.i > h
), p AS (
    SELECT conv_id, d, chars, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
), node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY path, d),
kids AS (SELECT path[:-33] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
whole AS (
    SELECT node.*, coalesce(kids.n, 0) AS n_children, up.conv_id AS parent_conv_id
    FROM node LEFT JOIN kids USING (path) LEFT JOIN node up ON node.d > 0 AND up.path = node.path[:-33]
), below AS (
    SELECT v.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved_tokens
    FROM whole u JOIN p v ON v.conv_id = u.conv_id AND v.d <= u.d GROUP BY v.path
), ends AS (
    SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, arg_max(path, d) AS path FROM p GROUP BY conv_id) GROUP BY path
)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
    coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM whole JOIN below USING (path) LEFT JOIN ends USING (path)
"""

ORACLES: dict[str, str] = {"op11_conversation_trie": OP11_SQL}


def register(registry) -> None:
    """Add every query of the subpackage to ``registry``."""
    for name, function in QUERIES.items():
        registry.add(name, function, ORACLES.get(name))
