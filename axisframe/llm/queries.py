"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm import (
    bpe, centroids, chat, decontaminate, divergence, oracles, perplexity, pseudo_likelihood, quality, simhash,
    suffix_dedup, token_counts, topk, toxicity)
from axisframe.llm.common import table
from axisframe.session import materialize

Query = Callable[[SparkSession, str], DataFrame]


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document; counts and training windows come from all of them."""
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


def op2_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id is divisible by 20."""
    vectors = materialize(topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), 20)


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 4-word shingles; components over links of at most four differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where items of the benchmark stand in documents, with few edits at most."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the conditional random field, with the offending offsets."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text with the 50k rank file, decode it again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), "doc_id",
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the byte-level convolutional network."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 200 bytes that start anywhere else, and what is left without them."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_preference_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its last reply taken from its neighbour."""
    return chat.format_preferences(*chat.swapped_replies(table(spark, sf_dir, "conversations")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document with the pieces and scores of the 32k piece file."""
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters of the vectors as whole numbers, after five rounds, with their inertia."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line counts of every document, and whether its perplexity is that of its language."""
    return perplexity.rules(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language are apart, and the terms that mark each."""
    return divergence.divergences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {fn.__name__: fn for fn in (
    op1_pseudo_likelihood, op2_maxscore_top_k, op3_simhash_components, op4_benchmark_leaks, op5_toxic_crf,
    op6_bpe_round_trip, op7_quality_cnn, op8_suffix_dedup, op9_preference_chats, op10_token_counts, op11_centroid_clusters,
    op12_perplexity_rules, op13_source_divergence)}

ORACLES: dict[str, str] = {
    "op11_centroid_clusters": oracles.centroids(),
    "op12_perplexity_rules": oracles.PERPLEXITY,
    "op13_source_divergence": oracles.DIVERGENCE,
    "op2_maxscore_top_k": """
WITH sound AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.r, q.vec_id AS query_id, v.vec_id, list_dot_product(q.vec, v.vec)::BIGINT AS score
    FROM sound q JOIN sound v ON q.r <> v.r
    WHERE q.vec_id % 20 = 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank
    FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
""",
    "op9_preference_chats": r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
l AS (
    SELECT conv_id, max(turn) AS last_turn, max({'turn': turn, 'text': text}).text AS reply
    FROM t WHERE role = 'assistant' GROUP BY conv_id),
c AS (
    SELECT t.*, row_number() OVER w AS i FROM t LEFT JOIN l USING (conv_id)
    WHERE last_turn IS NULL OR turn <= last_turn WINDOW w AS (PARTITION BY t.conv_id ORDER BY turn, role, text)),
r0 AS (
    SELECT t.* FROM t LEFT JOIN l USING (conv_id) WHERE last_turn IS NULL OR turn < last_turn
    UNION ALL
    SELECT l.conv_id, l.last_turn, 'assistant', d.reply FROM l JOIN l d ON d.conv_id = xor(l.conv_id, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM r0),
ids AS (SELECT conv_id FROM c UNION SELECT conv_id FROM r),
paired AS (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.i, r.i) AS i,
           coalesce(c.role = r.role AND c.text = r.text, false) AS same
    FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.i = r.i),
n AS (
    SELECT conv_id, coalesce(min(i) FILTER (NOT same) - 1, max(i))::INTEGER AS n FROM paired GROUP BY conv_id),
sides AS (
    SELECT conv_id, i, 'c' AS side, role, text FROM c UNION ALL SELECT conv_id, i, 'r', role, text FROM r),
drawn AS (
    SELECT sides.conv_id, i, side, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body,
           repeat('0', length(role) + 5) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, length(text) + 8) AS mask
    FROM sides JOIN n USING (conv_id))
SELECT conv_id AS pair_id, any_value(n) AS n_prompt_turns,
       coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND i <= n), '') AS prompt,
       coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen,
       coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected,
       coalesce(string_agg(mask, '' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen_mask,
       coalesce(string_agg(mask, '' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected_mask
FROM drawn GROUP BY conv_id
""",
}
