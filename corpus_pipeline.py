"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes `(spark, docs, sf_dir)` and returns a DataFrame; all but the last return the columns of `documents`. `run` writes each stage's result
as Parquet into the shared folder and reads it back as the next one's input, so a lost executor repeats one stage at most.

Nulls, empty texts, ties, repeated rows, empty tables and further columns are treated as the operators' docstrings say: a document without text is
never toxic and never a duplicate, but the mix takes no words from it, so it ends there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.llm import mixing, ngram_join, packing, pii, queries, toxicity
from plumeline.session import use_checkpoint_dir


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject. It is trained on the labelled ones among them."""
    chain = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.CATEGORIES)
    return toxicity.scored(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns}), chain, "_in_text").where("not rejected").select(
        *[F.col(f"_in_{c}").alias(c) for c in docs.columns]
    )


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that give it away replaced. `n_chars` is the new text's length."""
    out = pii.sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as its source's target allows."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs, queries.tokenizer_path()).withColumnRenamed("doc", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("ngram_join", without_near_duplicates),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None  # a trained model decides in the first stage; the tests hold every stage against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Intermediate tables lie in a folder of this run below `spark.checkpoint.dir`."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
