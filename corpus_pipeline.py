"""Corpus pipeline: language ID, exact dedup, near dedup and packing, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, language, packing, simhash
from quillon.llm.common import bounded_batches, durable, passing, table
from quillon.llm.corpus_queries import held_out, vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on: those that the classifier rejects go.

    It learns from the rows that are not held out, as its query does, and takes all of them as input.
    """
    bounded_batches(spark)
    model = language.train(docs, ~held_out())
    found = language.predict(docs, model, prefix="_language_")
    return found.where("NOT _language_rejected").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    bounded_batches(spark)
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", known_language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:  # what a stage wrote on its way goes when its result is written
            docs = keep(durable(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn, hash and tokenise beyond what SQL expresses: tests/llm compares them with brute force.
ORACLE_SQL = None
