"""A training corpus from raw documents: five stages over all rows.

Each stage is a function of (spark, docs, sf_dir).  ``run`` writes what a stage
returns as Parquet to the folder that executors share and reads it back as the
next stage's documents.  All stages but the last return the columns of
``documents``.

Nulls: a document with a null text isn't toxic, has no near copies, and is
encoded to null tokens; a null source is a source of its own.  An empty table
passes through as an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import bpe, mixing, ngram_join, pii, toxicity
from strandline.llm.common import reach_package, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier doesn't reject."""
    reach_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of lowest id, of each group of similar ones."""
    reach_package(spark)
    return ngram_join.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; ``n_chars`` follows the text."""
    reach_package(spark)
    n_chars = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return pii.redact(docs).withColumn("n_chars", n_chars).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture has them; copies are repeated rows."""
    return mixing.mix_sources(docs, columns=docs.columns, copy_col=None)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, tokens, round_trip) for each row of the mixture."""
    encoded = bpe.encode(docs.select("doc_id", "source", "text"))
    same = bpe.decode(F.col("tokens")) == F.col("text").cast("binary")
    return encoded.select("doc_id", "source", F.size("tokens").alias("n_tokens"), "tokens", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: Trained classifiers, the join's groups and merges can't be told in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
