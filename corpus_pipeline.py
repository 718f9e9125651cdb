"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokenising. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import exact_dedup, mixing, near_join, piece_trie, registry, toxicity
from frameloom.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, learnt from those of docs with labels, doesn't reject.

    Null and empty texts stay, repeated rows stay or go together; an empty table, or no labels, drops nothing.
    """
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space apart: the least id, null last. Null and empty texts are one text."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts: the least id, null last, then the least hash of the text.

    Texts without words are linked to nothing and stay.
    """
    return near_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; those it takes 0 times, and those without words, stay out.

    Null sources are one source; documents that repeat an id, source and size share their copies.
    """
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256, round_trip of each document, repeated ones too; null texts count as empty."""
    return piece_trie.encoded(docs, piece_trie.vocabulary(registry.tokenizer_bytes()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix),
    ("sentencepiece", tokenise),
]

#: Learnt weights, MinHash candidates and the tokeniser have no SQL form: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
