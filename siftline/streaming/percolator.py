"""Percolation and index updates on streams of documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.generations import FEW, duplicates
from siftline.operators.percolate import percolate
from siftline.plans.nodes import Node
from siftline.sources.store import Store


def percolate_stream(spark: SparkSession, source: str, schema: str, stored: Mapping[int, Node], sink: str, checkpoint: str) -> DataFrame:
    """Everything that is in ``source`` now, matched and appended to ``sink``."""
    docs = spark.readStream.schema(schema).parquet(source)
    run = percolate(docs, stored).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("doc_id long, query_id long").parquet(sink)


def index_stream(docs: DataFrame, store: Store, checkpoint: str, order: str | None = None):
    """Each micro-batch replaces its documents as a generation of its own; a repeated batch overwrites itself.

    Of rows of one id in a batch the greatest text counts, or the last by ``order`` (a column that says when a row was made) where there is one.
    Rows of ids that come once, which may be all, aren't shuffled while at most ``FEW`` ids come more often.
    """

    def batch(df: DataFrame, number: int) -> None:
        last = F.struct(*[c for c in (order, "text") if c is not None])
        again = duplicates(df).select(F.col("doc_id").alias("again"))
        times = again.count()
        if not times:
            chosen = df.select("doc_id", "text")
        elif times <= FEW:
            same, ids = F.col("doc_id").eqNullSafe(F.col("again")), F.broadcast(again)
            chosen = df.join(ids, same, "left_semi").groupBy("doc_id").agg(F.max_by("text", last).alias("text"))
            chosen = df.join(ids, same, "left_anti").select("doc_id", "text").unionByName(chosen)
        else:
            chosen = df.groupBy("doc_id").agg(F.max_by("text", last).alias("text"))
        store.commit(number + 1, replaced=chosen)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
