"""The corpus pipeline: documents through five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.

Defined results, for all stages: an empty table stays empty; texts of any length are
read whole; columns beside those of documents, whatever their names, are carried by
all stages but the last. What each does with nulls, repeats and ties stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import langid, minhash, packing, pii, quality
from pactum.llm.common import new_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has no words and goes; null languages and sources are groups of their own; repeated rows are judged one by one."""
    return quality.filter_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches, by the limit that its own training rows give.

    A text without a letter goes; a null language or doc_id teaches nothing; equal cosines go to the smaller label; repeated rows are judged one by one.
    """
    return langid.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Of equal rows one stays; rows of one doc_id with different texts are different documents; a text without words and a null doc_id stay.
    """
    return minhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; a null text stays null, and n_chars counts anew."""
    return pii.mask(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed training sequences: a null text has the end id alone, and repeated rows follow each other, null doc_ids first."""
    pieces = packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: The field, the prototypes and the packed ids are beyond SQL; tests/llm/test_pipeline.py follows the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
