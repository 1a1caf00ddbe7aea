"""Corpus pipeline: documents in, packed pieces out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the
last return the columns of documents. run() writes each stage's result to the shared folder and
reads it again, so a lost executor costs no more than its stage.

All stages: a null text is taken as empty; rows with null or repeated ids and whole repeated rows
are rows like any other (only the deduplication drops some of them); columns beyond those of
documents, of any name, stay; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgraph.llm import packing, quality, secrets, simhash, toxicity
from hearthgraph.llm.common import fold, stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality voters predict as label 1.

    Null and empty texts score the voters' share of label 1, one half without labelled rows, so
    they stay unless low quality is the rule. Rows of null id take no part in learning."""
    voters = quality.train(docs, table(spark, sf_dir, "labels"), "quality", fold(F.col("doc_id"), 3) == 1)
    return docs.where(quality.score_column(voters, F.col("text")) >= 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not predict as label 1.

    Null and empty texts match no clause and stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) == 2)
    return docs.where(toxicity.score_column(model, F.col("text")) < toxicity.THRESHOLD)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest doc_id.

    Null and empty texts are one component. Of null ids, and of different texts under one id, the
    text's hash decides; of whole repeated rows one stays."""
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; null and empty texts have none. n_chars,
    where there is such a column, is that of the text left."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 tokens; a null or empty text is its end token alone. Repeated
    rows are packed as often as they stand."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifiers and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole documents table; an empty one gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
