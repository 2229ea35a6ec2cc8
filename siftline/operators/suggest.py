"""Which of a query's terms occur together, and the best sub-queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.nodes import Node, terms_of


def masks(postings: DataFrame, slots: Sequence[str]) -> DataFrame:
    """``(mask, cnt)``: documents by the slots they have."""
    if len(slots) > 63:
        raise ValueError("at most 63 slots")
    bit = F.lit(0).cast("long")
    for k, t in enumerate(slots):
        bit = bit.bitwiseOR(F.when(F.col("term") == t, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    own = postings.where(F.col("term").isin(list(slots))).groupBy("doc_id").agg(F.bit_or(bit).alias("mask"))
    return own.groupBy("mask").agg(F.count("*").alias("cnt"))


def maximal(found: DataFrame, full: int | None = None) -> DataFrame:
    """Masks that no other contains; ``full`` is left out first.

    Each is held against all others: there are ``2 ** slots`` at most, and no more than documents.
    """
    own = found if full is None else found.where(F.col("mask") != full)
    other = own.select(F.col("mask").alias("other"))
    inside = (F.col("mask") != F.col("other")) & (F.col("mask").bitwiseAND(F.col("other")) == F.col("mask"))
    return own.join(other, inside, "left_anti")


def bits(mask: Column) -> Column:
    """The numbers of the bits that are set, from 0."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("getbit", mask, k) == 1)


def alternatives(postings: DataFrame, slots: Sequence[str], k: int = 5, details: bool = False) -> DataFrame:
    """``(mask, cnt, terms)``: the ``k`` best maximal sub-queries, by their terms and then their documents.

    ``details`` adds ``tokens``, the terms as an array, and ``first_bit``, the number of the first of them.
    """
    best = maximal(masks(postings, slots), (1 << len(slots)) - 1).orderBy(F.desc(F.bit_count("mask")), F.desc("cnt"), "mask").limit(k)
    named = [F.when(F.col("mask").bitwiseAND(F.lit(1 << n)) != 0, F.lit(t)) for n, t in enumerate(slots)]
    out = best.withColumn("terms", F.concat_ws(" ", *named))
    return out.withColumn("tokens", F.array_compact(F.array(*named))).withColumn("first_bit", F.array_min(bits(F.col("mask")))) if details else out


def united(found: Sequence[DataFrame]) -> DataFrame:
    """Masks of several sources added up."""
    return reduce(lambda a, b: a.unionByName(b), found).groupBy("mask").agg(F.sum("cnt").alias("cnt"))


def sub_queries(node: Node, postings: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best sub-queries of an original query of terms, among documents that have not all of them."""
    slots = terms_of(node, positive=True)
    return alternatives(postings, slots, k, details=True)
