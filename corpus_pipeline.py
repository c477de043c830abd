"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; ``run`` writes what a
stage returns and hands the table read from it to the next. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import jaccard, langid, packing, secrets, toxicity
from strandline.llm.store import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents but those without any letter: the models name a language for every other text, also for one they do not know."""
    answer = langid.predictor(langid.fitted(docs))(F.col("text").cast("string"))
    d = docs.select(F.struct("*").alias("row"), answer.alias("answer"))
    return d.where(F.col("answer.lang") != langid.UNKNOWN).select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not find toxic."""
    chain = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    p = toxicity.predictor(chain)(F.col("text").cast("string"))
    d = docs.select(F.struct("*").alias("row"), p.alias("p"))
    return d.where(F.col("p.toxic") < toxicity.THRESHOLD).select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("language_id", language),
    ("toxicity", clean),
    ("ngram_jaccard", distinct),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Trained models, tokens and packing have no SQL form; tests/llm/test_pipeline.py compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
