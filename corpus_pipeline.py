"""A corpus pipeline: stages that each apply one operator to all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import common, jaccard, mixing, packing, repeats, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the table of labels, doesn't reject."""
    docs = docs.select(*COLUMNS)
    return toxicity.clean(docs, toxicity.learn(docs, common.table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8: the smallest doc_id."""
    return jaccard.one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte passages that a smaller doc_id holds; a document of nothing else goes."""
    return repeats.without_repeats(docs.select(*COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: sources in the flattest mix that passes none more than twice as often as another."""
    return mixing.mixed(docs.select(*COLUMNS), most_passes=2.0).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

#: The stages train a classifier and pack bins, which SQL cannot express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each one's rows written before the next begins."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
