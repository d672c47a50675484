"""The corpus pipeline: quality rules, toxicity, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns all that it keeps: the first four drop documents and leave the
columns of the rest alone, the last returns each document's encoding. run() applies them to documents; each result is
stored in the shared folder and read again as the next one's docs. Not expressible in SQL; tests compare the stages
with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from critpath.llm import bpe, decontamination, near_copies, quality_rules, toxicity
from critpath.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules on tokeniser fertility reject."""
    return quality_rules.kept_documents(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents; the model learns from labelled rows of the whole documents table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: Jaccard similarity of five-word shingles 0.8 or more, every such pair."""
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaks."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded and their digests."""
    encoded = bpe.encode_documents(docs)
    return bpe.digests(encoded, "ids", "decoded")


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
