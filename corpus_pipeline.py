"""A training corpus in five stages, each on all rows that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents,
whatever their names. A null text counts as empty, very long texts are read whole, and an empty table gives an
empty result at every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import exact_dedup, packing, pii, simhash, toxicity
from wordloom.llm.common import delete_folder, ensure_checkpoint_dir
from wordloom.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; each row is judged by its own text, so null ids and repeated rows do not matter. Null and empty texts stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays, one row of it. Null and empty texts are equal. A row without an id stays only where no equal text has one."""
    return exact_dedup.exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-equal fingerprints connect, the one with the smallest id stays, one row of it. A row without an id stays only where none of them has one."""
    return simhash.simhash_dedup(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets; n_chars follows. A null text stays null; every row stays, with its id or without."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else done


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut into pieces and placed in sequences of at most 1024 tokens. Every row is a document of its own; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the toxicity model, the expansion of anchors or the tokeniser; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written to the shared folder and read again by the next.

    A stage's rows are deleted as soon as the next one has written its own; those that the result is read from stay.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
