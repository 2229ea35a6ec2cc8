"""Connected components by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.)  Each
step is one aggregation and one join on a node, so a hub costs a skewed join
(which adaptive execution splits), never one task's memory.  The number of
rounds is logarithmic in practice; every round is cut into the shared
checkpoint folder so that lost executors only cost the current round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included, beside its edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _least(down)
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = joined.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` of every node of ``edges`` but the roots; ``root`` is the least node of the component.

    Null ends and loops are ignored; no edges give no rows.
    """
    state = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    )
    mark = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == mark or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        state = cut(_small_star(_large_star(state)))
