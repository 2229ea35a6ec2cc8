"""The corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are replaced,
sources are mixed to their target weights, and what is left is encoded.

Every stage but the last returns all columns of its documents, whatever else these have; the last has ``doc_id, pieces, exact, lang, source``.

Cases: a null text passes all stages and has null pieces, an empty one has none; rows with a null id are no one's copies and
stay or go in the mix by the hash of an empty id; of rows with one id and the same text one stays, different texts of one id
are judged by themselves; of two near copies that of the lesser id stays; a null source is a source of its own; null labels
are ignored; texts of any length are used whole; without labels nothing is toxic; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import mixing, near_dedup, pieces, secret_scan, toxicity
from siftline.llm.common import shared_dir, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.without_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, keep=("lang", "source"))


STAGES = [("toxicity", toxic), ("near_dedup", near), ("secret_scan", secret), ("mixing", mix), ("sentencepiece", encode)]

#: Neither the search for neighbours nor MinHash or piece encoding can be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet under the checkpoint folder and read again as the next one's documents."""
    docs, place = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}.parquet")
        docs = table(spark, place, name)
    return docs
