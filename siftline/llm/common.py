"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Where none is set, a session within this process makes a temporary one; on
    a cluster that would be a folder of the driver alone, so it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = context.getConf().get("spark.checkpoint.dir")
        if not place:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            place = tempfile.mkdtemp(prefix="siftline-checkpoint-")
        context.setCheckpointDir(place)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hash60(*columns: Column | str) -> Column:
    """A 60-bit hash that DuckDB computes alike: ``('0x' || md5(...)[:15])::BIGINT``."""
    joined = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
