"""A corpus pipeline in stages: each takes (spark, docs, sf_dir) and returns what the next one works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import exact_dedup, langid, mixing, sentencepiece_codec, simhash
from docloom.llm.common import cut, table
from docloom.llm.queries import TOKENIZERS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model is trained on a bounded sample of docs' own labels.

    Null, empty and letterless texts are rejected; repeated rows are kept or rejected alike, with or without an id; texts are read whole; without labelled rows, and so of
    an empty table, nothing is left; all columns, whatever their names, stay as they came.
    """
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id.

    Null texts equal no other one and all stay; empty texts equal each other; of several rows with the smallest id one stays, and rows without an id come last; an
    empty table stays empty; all columns stay as they came.
    """
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Null, empty and white-space texts are never near copies and all stay; repeated rows become one; rows without an id come last; very long texts are compared
    whole; an empty table stays empty; all columns stay as they came.
    """
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it.

    A null source is one of its own; null and empty texts have no tokens and come with their source's epochs; rows of one id in a source go together; documents
    without a label have the middle weight, several labels count as the best one; an empty table stays empty; all columns stay as they came.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces: doc_id, pieces, n_pieces, round_trip.

    A null text has null pieces, an empty one none; repeated rows are encoded alike; texts are encoded whole; an empty table gives no rows; other columns end here.
    """
    return sentencepiece_codec.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("sentencepiece", encode)]

#: Scores in floating point, fingerprints and pieces can't be had in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last cut to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
