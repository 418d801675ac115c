"""Training-data pipeline: rules, near-duplicates, decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept. All but the last return the columns of docs, under any names.

Defined cases: a null or empty text fails the rules (it has too few words); rows
without a doc_id go through all stages like others; of rows that repeat one stays;
of near-duplicates that of the least doc_id stays; an empty table, or one that a stage
leaves empty, gives an empty result with the same columns; a text of any length is
read whole (see pixelloom/llm/_text.py for the memory that it takes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import bpe, decontam, pii_crf, queries, repetition, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; a null text has no words and goes."""
    return repetition.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least doc_id, of equal ids the least hash of the text; rows without an id come before others among themselves."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, items without an item_id included; an empty benchmark removes nothing."""
    return decontam.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; documents without any stay as they are."""
    return pii_crf.redact(docs, pii_crf.learn(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids) of each document."""
    return bpe.round_trip(docs, bpe.Vocabulary.load(queries.tokenizer_path()), keep_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("token_ids", token_ids)]

#: SQL can't express the merges, the field or the trie join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
