"""Ending a search before it has run through."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def abortable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that start inside can be ended by ``abort`` from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def abort(spark: SparkSession, tag: str) -> None:
    """End the running jobs of ``tag``; what waits for them raises."""
    spark.sparkContext.cancelJobsWithTag(tag)
