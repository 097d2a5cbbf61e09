"""Corpus pipeline: from documents to token ids, in five stages that are each written and read again.

Stages take empty tables, and further columns whatever their names, and hand both on. doc_id is what tells documents apart; the first two stages keep rows without one as they say, later
ones have none left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality_classifier
from quern.llm.shared import cut, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it is fitted on the labelled ones among ``docs``.

    Null and empty texts score the share of good ones in the sample; without labels all rows score 0.5 and stay. Rows with a null doc_id are scored like others; repeated rows alike.
    """
    return quality_classifier.keep_good(docs, quality_classifier.fitted(spark, sf_dir, docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the least id. Null and empty texts are equal. Rows repeated as a whole stay as often as they occur, and rows with a null doc_id go."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id. Texts without words are one class."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: documents go, stay, or repeat. A null source is one source; null and empty texts have no words to take and go. Ties of keys go by doc_id."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the digest of what they decode to; a row for each row, repeats included. Null and empty texts would have no ids."""
    return byte_bpe.encode(docs).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]
#: SQL expresses neither the classifier nor the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the table documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
