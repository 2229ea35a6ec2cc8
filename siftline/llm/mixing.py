"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 60-bit hash of its id.  A source's budget of tokens is met
by keeping the documents whose hash is below the source's threshold.

1. One pass sums the tokens of each (source, top 12 hash bits) bucket.
2. The running sum over a source's buckets names the boundary bucket, the first
   that passes the budget; only its documents are summed again by the next 12
   bits, until the boundary holds one document or one hash.
3. Documents are filtered by ``hash < threshold``; they are never sorted.

Thresholds are nested: a larger budget keeps a superset.

The tokens of a text are one more than its spaces, 0 for a null or empty text.
Without ``weights`` a source's share is in proportion to the square root of
its tokens; a source with fewer tokens than its share of ``total`` (default:
all tokens) stays whole.  Sources that ``weights`` doesn't name have weight 0.

Cases: a null source is a source of its own; a null id hashes like an empty
one; rows of one id share a hash and stay or go together; documents without
tokens stay as long as their hash is below the threshold; a text longer than
its source's budget goes if the hash puts it at the boundary; other columns,
whatever their names, stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import cut, fresh, hash60

BITS, STEP = 60, 12
#: Thresholds of at most so many sources are broadcast.
BROADCAST_SOURCES = 50_000


def tokens(text: Column) -> Column:
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(spaces + 1).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def budgets(slim: DataFrame, weights: Mapping[str, float] | None, total: int | None) -> DataFrame:
    """``(key, held, budget)`` of each source."""
    held = slim.groupBy("key").agg(F.sum("tokens").alias("held"))
    if weights is None:
        weight = F.sqrt(F.col("held").cast("double"))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("key") == f"={name}", float(w)).otherwise(weight)
    held = cut(held.withColumn("weight", weight))
    sums = held.agg(F.sum("weight"), F.sum("held")).first()
    whole, all_tokens = float(sums[0] or 0), int(sums[1] or 0)
    share = F.round(F.col("weight") / F.lit(whole or 1.0), 9)
    return held.select("key", "held", F.floor(share * F.lit(float(all_tokens if total is None else total))).cast("long").alias("budget"))


def thresholds(slim: DataFrame, budget: DataFrame) -> DataFrame:
    """``(key, threshold)``; ``slim`` has ``key, h, tokens``."""
    top = 1 << BITS
    done = budget.where("held <= budget").select("key", F.lit(top).cast("long").alias("threshold"))
    state = cut(budget.where("held > budget").select("key", F.lit(0).cast("long").alias("bucket"), F.col("budget").alias("left")))
    part, shift = slim, BITS
    while not state.isEmpty():
        before, shift = shift, shift - STEP
        at = part.withColumn("bucket", F.shiftright("h", before)).join(state, ["key", "bucket"])
        if before < BITS:  # few rows are left, so that later rounds don't read all again
            at = cut(at)
            part = at.select("key", "h", "tokens")
        hist = at.groupBy("key", F.shiftright("h", shift).alias("bucket"), "left").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
        run = F.sum("t").over(Window.partitionBy("key").orderBy("bucket"))
        first = F.min_by(F.struct("bucket", "t", "n", "run", "left"), "bucket").alias("b")
        edge = cut(hist.withColumn("run", run).where("run > left").groupBy("key").agg(first).select("key", "b.*"))
        over = F.lit(True) if shift == 0 else F.col("n") == 1
        done = done.unionByName(edge.where(over).select("key", F.shiftleft("bucket", shift).alias("threshold")))
        state = edge.where(~over).select("key", "bucket", (F.col("left") - F.col("run") + F.col("t")).alias("left"))
    return done


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokens_col: str | None = None,
) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with all their columns; ``tokens_col`` adds their tokens, under a longer name where it is taken."""
    count, hashed, key = tokens(docs[text_col]), hash60(id_col, F.lit("mix")), source_key(docs[source_col])
    slim = cut(docs.select(key.alias("key"), hashed.alias("h"), count.alias("tokens")))
    limits = cut(thresholds(slim, budgets(slim, weights, total)))
    k, limit = fresh(docs, "key"), fresh(docs, "threshold")
    limits = limits.select(F.col("key").alias(k), F.col("threshold").alias(limit))
    if limits.count() <= BROADCAST_SOURCES:
        limits = F.broadcast(limits)
    kept = docs.withColumn(k, key).join(limits, k).where(hashed < F.col(limit)).drop(k, limit).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept if tokens_col is None else kept.withColumn(fresh(docs, tokens_col), tokens(F.col(text_col)))


def oracle_sql() -> str:
    return """WITH t AS (SELECT doc_id, source, CASE WHEN coalesce(length(text), 0) = 0 THEN 0
 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS tokens,
 CAST('0x' || substring(md5(concat_ws('|', CAST(doc_id AS VARCHAR), 'mix')), 1, 15) AS BIGINT) AS h FROM documents),
 s AS (SELECT source, sum(tokens) AS held FROM t GROUP BY source),
 b AS (SELECT source, held, floor(round(sqrt(CAST(held AS DOUBLE)) / sum(sqrt(CAST(held AS DOUBLE))) OVER (), 9) * sum(held) OVER ()) AS budget FROM s),
 r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM t)
SELECT r.doc_id, r.source, CAST(r.tokens AS BIGINT) AS tokens FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
WHERE b.held <= b.budget OR r.run <= b.budget"""
