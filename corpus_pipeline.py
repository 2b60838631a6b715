"""A corpus pipeline of five of the training-data operators; each stage works on all that the one before kept.

Defined results: a null text counts as empty and stays unless another empty one does; rows that repeat an id are documents
of their own; a null id is kept like any other; extra columns go through all stages but the last, whatever their names;
without labels of both classes no document is toxic, or all are if all labels say so; an empty table gives an
empty result. Each stage's docstring has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalspark.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from vitalspark.llm.common import materialise, remove_written, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the CRF, trained on the labelled ones among them, does not predict to be toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass over a document's source that takes words of it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids as little-endian unsigned 32-bit integers."""
    return bpe.encode_documents(docs, bpe.default_vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", encode)]
#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        began = written()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
            remove_written(spark, began, but=1)  # what the stage's result was made of
    return docs
