"""Tokens, hits, postings and their statistics, all as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def held(value: Column) -> Column:
    """A value that is computed once for each row: filters on it (those too that an explode of it implies) aren't pushed below, where they would compute it again."""
    return F.explode(F.array(value))


Tokenize = Callable[[Column], Column]


def hits(docs: DataFrame, terms: Iterable[str] | None = None, id_col: str = "doc_id", text_col: str = "text", tokenize: Tokenize = tokens, payload: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(doc_id, term, pos[, payload])`` with positions from 1; only of ``terms`` if given.

    ``tokenize`` makes a text's terms in order: an expression, or a ``pandas_udf``
    of ``array<string>``; terms it leaves null take a position and are no hits.
    ``payload`` makes bytes from a hit's term and position.
    """
    toks = docs.select(F.col(id_col).alias("doc_id"), held(tokenize(F.col(text_col))).alias("toks"))
    found = toks.select("doc_id", F.posexplode("toks").alias("at", "term")).where("term is not null")
    if terms is not None:
        found = found.where(F.col("term").isin(sorted(terms)))
    out = found.select("doc_id", "term", (F.col("at") + 1).alias("pos"))
    return out if payload is None else out.withColumn("payload", payload(F.col("term"), F.col("pos")).cast("binary"))


def fixed(value: Column, size: int = 8) -> Column:
    """A whole number as a payload of ``size`` bytes, the last byte first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)]))


def number(payload: Column) -> Column:
    """The whole number that ``fixed`` made a payload of; null for none."""
    digits = F.hex(payload)
    turned = F.concat(*[F.lpad(F.substring(digits, 15 - 2 * k, 2), 2, "0") for k in range(8)])
    return F.when(F.length(payload) <= 8, F.conv(turned, 16, 10).cast("long"))


def special_terms() -> Column:
    """A document's ``lang:x`` and ``src:y``; null for one that it hasn't."""
    return F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source"))


def specials(docs: DataFrame, payload: Column | None = None) -> DataFrame:
    """``lang:x`` and ``src:y`` tokens, which have position 0 and may have a payload."""
    own = [] if payload is None else [payload.cast("binary").alias("payload")]
    return docs.select("doc_id", F.explode(special_terms()).alias("term"), F.lit(0).alias("pos"), *own).where("term is not null")


def postings(found: DataFrame, positions: bool = True) -> DataFrame:
    """``(term, doc_id, freq[, positions[, payloads]])``; payloads go along with positions, ordered alike."""
    aggs = [F.count("*").cast("int").alias("freq")]
    if positions and "payload" in found.columns:
        pairs = F.sort_array(F.collect_list(F.struct("pos", "payload")))
        grouped = found.groupBy("term", "doc_id").agg(*aggs, pairs.alias("hits"))
        return grouped.select("term", "doc_id", "freq", F.col("hits.pos").alias("positions"), F.col("hits.payload").alias("payloads"))
    if positions:
        aggs.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    return found.groupBy("term", "doc_id").agg(*aggs)


def word_space(found: DataFrame) -> DataFrame:
    """``(doc_id, space)``: of each document the term at each position; of several at one the greatest."""
    own = found.where("pos > 0").groupBy("doc_id", "pos").agg(F.max("term").alias("term"))
    return own.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "term"))).alias("space"))


def stands_at(space: Column, start: Column, terms: Iterable[str]) -> Column:
    """Whether ``terms`` stand side by side from position ``start`` on."""
    out = F.lit(True)
    for k, term in enumerate(terms):
        out = out & F.coalesce(F.try_element_at(space, start + k) == term, F.lit(False))
    return out


def doc_stats(found: DataFrame) -> DataFrame:
    """Of each document the distinct terms, the greatest frequency, all and positional hits, and hits that share a position with another."""
    by_term = found.groupBy("doc_id", "term").agg(F.count("*").alias("freq"), F.count(F.when(F.col("pos") > 0, 1)).alias("placed"))
    places = found.where("pos > 0").groupBy("doc_id", "pos").agg((F.count("*") - 1).alias("over")).groupBy("doc_id").agg(F.sum("over").alias("overlaps"))
    own = by_term.groupBy("doc_id").agg(F.count("*").alias("terms"), F.max("freq").alias("max_freq"), F.sum("freq").alias("hits"), F.sum("placed").alias("positional_hits"))
    return own.join(places, "doc_id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))


def field_stats(p: DataFrame) -> DataFrame:
    """One row: sum of hits, number of terms, of postings and of documents."""
    by_term = p.groupBy("term").agg(F.sum("freq").alias("hits"), F.count("*").alias("docs"))
    documents = p.select("doc_id").distinct().agg(F.count("*").alias("n")).scalar()
    return by_term.agg(F.sum("hits").alias("sum_term_hits"), F.count("*").alias("total_terms"), F.sum("docs").alias("sum_terms_docs")).withColumn("docs_cnt", documents)
