"""A corpus pipeline of five stages over the documents table; each stage works on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import exact_dedup, golay, packing, pii, toxicity
from paperloom.llm.queries import PSEUDONYM_KEY, WORD_TOKENIZER
from paperloom.shipping import written
from paperloom.sources.tables import read_table, spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The labels come from the table beside the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, labels, threshold=0.7)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, up to white space, the one with the smallest id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the one with the smallest id stays."""
    return golay.drop_near_duplicates(docs, width=5, similarity=0.8)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their own format; all documents stay."""
    return pii.pseudonymise(docs, PSEUDONYM_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER), capacity=2048, end_id=0)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_equal), ("simhash near-dedup", drop_near), ("pii", pseudonyms), ("packing", pack)]
#: Fingerprints, the classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each reads what the one before has written."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
