"""From documents to packed sequences: quality, near-duplicates, personal data, mixture, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain.llm import mixing, packing, pii, quality_gam, simhash
from scenegrain.llm._common import named, stored, table

#: Packing and the models can't be said in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, trained on the labelled ones among them, doesn't reject.

    Null and empty texts are scored like any other, as texts without words; repeated rows share their
    verdict; without usable labels all documents have the smoothed share of good ones for a score.
    """
    return quality_gam.accepted(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Null and empty texts are one group; of repeated rows one is left."""
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets and n_chars, where there is such a column, counted anew (null for a null text)."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources up to twice, in the order of the mixture. Documents without a source are a source of their own."""
    at = F.col(mixing.own_names(docs.columns)["_at"])
    return mixing.mix(docs).repartitionByRange(at).sortWithinPartitions(at, "doc_id").select(*map(named, docs.columns))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, in the order of the mixture. A null or empty text is its closing id alone."""
    return packing.digested(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("windows", windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each but the last is written to the shared folder and read again.

    Rows with nulls in any column, repeated rows and documents without labels pass through as the stages
    say; columns beyond those of documents are carried to the last stage; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
