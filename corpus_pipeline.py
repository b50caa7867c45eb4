"""From raw documents to encoded training text, in five stages.

Each stage takes what its predecessor kept; all but the last return the columns of documents.
SQL cannot express the classifier, the mixture or the encoder, so ORACLE_SQL is None and the tests
hold every stage against a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tactica.llm import bpe, common, exact_dedup, minhash, mixing, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores under 0.5."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the document of the smallest id."""
    return minhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them, in its shards' order."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of every document of the mixture."""
    return bpe.encode(docs, spark, ids=True)


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", exact_out),
    ("near_dedup", near_out),
    ("mix_sources", mixed),
    ("bpe", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
