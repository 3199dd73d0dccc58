"""A corpus from raw documents to training sequences; every stage writes Parquet that the next one reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwatch.llm.mixing import mixed
from panelwatch.llm.ngram_join import one_of_each
from panelwatch.llm.packing import pack_documents
from panelwatch.llm.pii import redact
from panelwatch.llm.queries import TARGETS, domains
from panelwatch.llm.tables import crc_mod, table, unused
from panelwatch.llm.toxicity import fit_toxicity, score_toxicity
from panelwatch.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents scored under 0.5, and those without a word; learned from the labelled ones that are not held out."""
    model = fit_toxicity(docs, table(spark, folder, "labels"), train=crc_mod(F.col("key"), 5) != 0)
    score = unused(docs, "__score")
    has_word = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return score_toxicity(docs, model, score=score).filter((F.col(score) < 0.5) | ~has_word).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of documents linked by a Jaccard similarity of five-word n-grams of 0.8 or more."""
    return one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Spans of personal data replaced by their kind; ``n_chars`` counts the new text (as it was for a null text)."""
    clean = redact(docs)
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_domains(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents repeated or left out so that expected words per domain meet ``TARGETS``."""
    return mixed(docs, domains(table(spark, folder, "labels")), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents with their sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_domains),
    ("packing", pack),
]

# Learned scores and rates, and sampled paths, are beyond SQL. The tests compare each stage with plain Python on its own
# input (mixing: whole documents and their total), and run() with its stages.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
