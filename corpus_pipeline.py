"""A training corpus from raw documents, stage by stage.

Each stage takes all that the one before it kept, written as Parquet in the shared folder and read
again, calls one operator and lets its decisions take effect.  All but the last return whole rows
with all columns, whatever these are named, and no rows where they are given none; texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenderflow.llm import exact, langid, mixing, packing, simhash
from tenderflow.llm.queries import WORD_TOKENIZER, tokenizer_path
from tenderflow.sources.staging import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language.

    Null texts and texts without a letter go; texts with letters stay whatever they say, as do
    repeated rows.  A null doc_id or lang is no reason to go.
    """
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id.

    Null and empty texts are equal.  Of rows that share that doc_id too, one stays; a null doc_id
    stays only if there is no other.
    """
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id.

    Texts without words share the fingerprint zero.  Of rows that tie, one stays.
    """
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them.

    Null is a source of its own.  Documents without words take nothing of the budget; a source
    that has no words at all is left out.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in sequences.

    A null or empty text is one piece, the closing id; only documents longer than a sequence are
    cut.  Repeated rows are packed one by one.
    """
    return packing.pack_documents(docs, tokenizer_path(WORD_TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language filters, fingerprints and tokens are beyond SQL; the tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
