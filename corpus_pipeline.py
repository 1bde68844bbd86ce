"""A corpus made ready for training: quality, exact and near dedup, mixing to target weights, packing. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from chainloom.llm.common import shared_dir, with_row_key
from chainloom.llm.queries import ACCEPT, quality_model, vocabulary


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels that aren't held out, scores 0.3 or more. Null and empty texts are scored by the bias, repeated rows alike."""
    return quality.score(docs, quality_model(spark, sf_dir)).where(F.col("_score") >= ACCEPT).drop("_score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then the least id; one of rows alike in both. Null texts count as empty, null ids sort last, an empty table gives none."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group over shingles of five words at a similarity of 0.8. Texts without words stay; of rows that ids don't tell apart one of a group stays too."""
    return near_dedup.drop_near_copies(docs, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in order of service, once or twice each, until the sources' targets are met. Texts without words are left out; a null source is one of its own."""
    rows, key = with_row_key(docs)
    stream = mixing.mix_stream(mixing.fair_mix(rows, key=key), whole=True).select(F.col("row").alias("_id"), F.col("finish").alias("_at"), F.col("round").alias("_round"))
    return rows.join(stream, rows[key] == stream["_id"]).orderBy(stream["_at"], stream["_id"], stream["_round"]).select(*[rows[c] for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens. Null texts count as empty: their end id alone is packed."""
    return packing.pack(docs, vocabulary(), payload="crc32")


STAGES = [
    ("accept_quality", accept_quality),
    ("drop_exact_copies", drop_exact_copies),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learning, minima and tokenizing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
