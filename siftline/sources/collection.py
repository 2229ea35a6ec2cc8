"""Sources of postings other than a ``Store``, and views over several.

A source is anything with ``postings()``, ``updates()`` and ``documents()`` as
DataFrames without a generation; a ``Collection`` gives each a generation and
hides what a newer one replaced or erased.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import Tokenize, hits, postings, tokens
from siftline.operators.generations import live, translated
from siftline.plans.compiler import Plan
from siftline.plans.nodes import Node, parse


@runtime_checkable
class Source(Protocol):
    def postings(self) -> DataFrame:
        """``(term, doc_id, freq, positions)``."""

    def updates(self) -> DataFrame:
        """``(doc_id)`` of documents whose older versions are hidden."""

    def documents(self) -> DataFrame:
        """``(doc_id)``."""


class Documents:
    """Texts that are tokenised when asked; ``replacing`` hides older versions; ``idmap`` turns local ids to global ones."""

    def __init__(self, docs: DataFrame, replacing: bool = False, tokenize: Tokenize = tokens, idmap: DataFrame | None = None) -> None:
        self.docs, self.replacing, self.tokenize, self.idmap = docs, replacing, tokenize, idmap

    def postings(self) -> DataFrame:
        found = postings(hits(self.docs, tokenize=self.tokenize))
        return found if self.idmap is None else translated(found, self.idmap).select("term", "doc_id", "freq", "positions")

    def documents(self) -> DataFrame:
        ids = self.docs.select("doc_id")
        return ids if self.idmap is None else translated(ids, self.idmap).select("doc_id")

    def updates(self) -> DataFrame:
        return self.documents() if self.replacing else self.documents().limit(0)


class Masks:
    """No documents, only ids whose older versions are hidden."""

    def __init__(self, ids: DataFrame) -> None:
        self.ids = ids

    def updates(self) -> DataFrame:
        return self.ids.select(F.col("doc_id").cast("long"))

    def documents(self) -> DataFrame:
        return self.updates().limit(0)

    def postings(self) -> DataFrame:
        return self.updates().limit(0).select(F.lit("").alias("term"), "doc_id", F.lit(0).alias("freq"), F.array().cast("array<int>").alias("positions"))


class Listed(Masks):
    """A set of ids of the application's own, to be named in queries."""

    def __init__(self, spark: SparkSession, ids: list[int]) -> None:
        super().__init__(spark.createDataFrame([(k,) for k in ids], "doc_id long"))

    def updates(self) -> DataFrame:
        return self.ids.limit(0)

    def documents(self) -> DataFrame:
        return self.ids.distinct()


class Collection:
    """Sources by generation; only strictly newer ones hide."""

    def __init__(self, sources: Mapping[int, Source]) -> None:
        if not sources:
            raise ValueError("a collection has a source")
        self.sources = dict(sources)

    def _joined(self, part: str) -> DataFrame:
        own = [getattr(s, part)().withColumn("gen", F.lit(g).cast("long")) for g, s in self.sources.items()]
        return reduce(lambda a, b: a.unionByName(b), own)

    def postings(self) -> DataFrame:
        return live(self._joined("postings"), self._joined("updates").select("doc_id", "gen"))

    def documents(self) -> DataFrame:
        return live(self._joined("documents"), self._joined("updates").select("doc_id", "gen"))

    def updates(self) -> DataFrame:
        return self._joined("updates").select("doc_id").distinct()

    def plan(self, query: str | Node, named: Mapping[str, DataFrame] | None = None) -> Plan:
        return Plan(parse(query) if isinstance(query, str) else query, self.postings(), self.documents(), named)
