"""Corpus pipeline over ``documents``: each stage's result is written as Parquet and read again as the next one's input.

Every stage takes what its predecessor kept and, but for the last, returns the columns of ``documents``. NULL texts
count as empty and are kept by the filters; NULL and repeated ids are ordinary rows; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeops.llm import decontamination, hyperminhash, packing, secrets, toxicity
from lakeops.llm.tokens import vocabulary
from lakeops.session import materialised
from lakeops.sources.tables import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from ``labels`` and keep the documents that are not predicted toxic."""
    return toxicity.without_toxic(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked by a similarity of 0.8 over five-word shingles."""
    return hyperminhash.deduplicated(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of ``benchmark``, also with other numbers, names or units."""
    return decontamination.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secret values inside the texts; no document goes."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the kept documents into sequences, sources mixed in their own proportions; the last stage."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json")).drop("ids")


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack)]

#: Subword scores, similarity of sets and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return docs
