"""Generations of an index: visibility, compaction, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ids up to which they are broadcast (some fifty bytes each), so that what they are held against isn't shuffled; more are joined by shuffle.
FEW = 1_000_000


def live(postings: DataFrame, updates: DataFrame, few: bool = False) -> DataFrame:
    """Postings of ``(gen, ...)`` that no strictly newer generation replaced or erased; ``few`` says that at most ``FEW`` ids are."""
    newest = updates.groupBy("doc_id").agg(F.max("gen").alias("ug"))
    newest = F.broadcast(newest) if few else newest
    return postings.join(newest, "doc_id", "left").where("ug is null or gen >= ug").drop("ug")


def merged(postings: DataFrame, updates: DataFrame, gen: int, unique: bool = False, few: bool = False) -> DataFrame:
    """Live postings as one generation; of a (term, document) in several the newest wins.

    With ``unique`` the caller vouches that each document is live in one
    generation only (as in a ``Store``, which replaces), and nothing is shuffled
    where also few ids are hidden (``few``).
    """
    kept = live(postings, updates, few)
    if not unique:
        rest = [c for c in kept.columns if c not in ("term", "doc_id", "gen")]
        kept = kept.groupBy("term", "doc_id").agg(F.max_by(F.struct(*rest), "gen").alias("row")).select("term", "doc_id", "row.*")
    return kept.withColumn("gen", F.lit(gen).cast("long"))


def retention(sources: DataFrame) -> DataFrame:
    """``(gen, decision)`` of ``(gen, candidate)``: merged sources go, but keep their update ids while an older source stays."""
    older = Window.orderBy("gen").rowsBetween(Window.unboundedPreceding, -1)
    stays = F.max(F.when(F.col("candidate"), 0).otherwise(1)).over(older)
    return sources.select("gen", F.when(~F.col("candidate"), "retain_all").when(F.coalesce(stays, F.lit(0)) == 1, "retain_updates").otherwise("delete").alias("decision"))


def duplicates(docs: DataFrame) -> DataFrame:
    """Ids that one session commits more than once."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


def translated(postings: DataFrame, idmap: DataFrame) -> DataFrame:
    """Local document ids replaced by those of ``(local_id, global_id)``."""
    return postings.join(idmap, postings["doc_id"] == idmap["local_id"]).withColumn("doc_id", F.col("global_id")).drop("local_id", "global_id")
