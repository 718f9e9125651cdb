"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import block_labeller, centroids, exact_dedup, langid, mixing, near_join, neighbours, passages, piece_trie, pii, prefix_trie, tokens, toxicity
from .common import table

#: The vocabulary file whose tokens op8 counts and op3 produces.
TOKENIZER = "piece_bpe_32k.model"


def tokenizer_bytes() -> bytes:
    import public_tokenizers

    return tokens.model_bytes(public_tokenizers.path(TOKENIZER))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_bytes())


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_labeller.main_text(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_trie.encoded(table(spark, sf_dir, "documents"), piece_trie.vocabulary(tokenizer_bytes()))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.similar(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS t FROM documents),
k AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY n.t ORDER BY doc_id) = 1 AS kept, sha256(n.t) AS text_sha256
FROM n JOIN k ON n.t = k.t
"""


def queries() -> dict:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_pii": op2_pii,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_language_id": op4_language_id,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_mix_sources": op6_mix_sources,
        "op7_toxicity": op7_toxicity,
        "op8_token_counts": op8_token_counts,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_centroid_clustering": op13_centroid_clustering,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op11_substring_dedup": passages.PASSAGES_SQL, "op12_conversation_trie": prefix_trie.TRIE_SQL, "op13_centroid_clustering": centroids.cluster_sql()}
