"""The training-data pipeline: five stages over documents, each written as Parquet and read back for the next.

In every stage null text counts as empty (and stays null where text is returned), texts of any length are read whole, an empty
table gives no rows, and columns of documents beyond those named here, of any name, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_copies, packing, quality, secrets
from tessera.llm.common import freeze, table

#: SQL cannot express the learned stages; tests hold the pipeline against its stages' brute-force versions.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, does not reject.

    Repeated rows and rows with a null doc_id are judged like others, equal texts alike; without usable labels all stay.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingle sets of Jaccard similarity 0.8 or more.

    The smallest doc_id of a group stays, one row of it; rows with a null doc_id stay; texts without words are copies of each other.
    """
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; repeated rows and null ids like others, overlapping findings as their union."""
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order.

    A null source is a source; rows of one doc_id are repeated alike; a null doc_id is drawn by its text.
    """
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences; each copy and each repeated row is packed on its own, an empty text as the end id."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = freeze(docs, f"stage-{name}")
    return docs
