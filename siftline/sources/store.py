"""An index on disk: Parquet tables partitioned by generation.

``postings`` (ordered by term and document, so that a term's row groups are few
and the rest are skipped), ``terms`` and ``stats`` (frequencies of a generation),
``documents`` (its ids, and whether they have a term), ``updates`` (replaced and
erased ids) and ``commits``, which is written last: readers only see generations
that it names, so none sees half of one.  Writing a generation again replaces it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftline.functions import rows as R
from siftline.functions.text import Tokenize, field_stats, hits, postings, tokens
from siftline.operators.generations import FEW, duplicates, live, merged, retention
from siftline.plans.compiler import Plan
from siftline.plans.nodes import Node, parse

_SCHEMAS = {
    "postings": "term string, doc_id long, freq int, positions array<int>, payloads array<binary>, gen long", "updates": "doc_id long, gen long", "documents": "doc_id long, worded boolean, gen long", "terms": "term string, df long, cf long, gen long",
    "stats": "sum_term_hits long, total_terms long, sum_terms_docs long, docs_cnt long, gen long", "commits": "docs long, updates long, gen long",
}


def _few(marks: Mapping[int, int | None], gens: Iterable[int]) -> bool:
    """Whether ``gens`` are known to hide few ids."""
    sizes = [marks[g] for g in gens]
    return None not in sizes and sum(sizes) <= FEW


class Store:
    """``tokenize`` and ``payload`` are those of ``hits``; what was indexed with them has to be read with terms of the same kind."""

    def __init__(self, spark: SparkSession, root: str, tokenize: Tokenize = tokens, payload: Callable[[Column, Column], Column] | None = None) -> None:
        self.spark, self.root, self.tokenize, self.payload = spark, root, tokenize, payload
        self._kept: dict[str, DataFrame] = {}

    def _read(self, name: str, gens: Iterable[int] | None = None) -> DataFrame:
        gens = self.generations() if gens is None else list(gens)
        if not gens:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        try:
            found = self._kept.get(name)
            found = self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.root}/{name}") if found is None else found
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return found.where(F.col("gen").isin(gens))

    def _write(self, df: DataFrame, name: str, gen: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/gen={gen}")

    def _written(self, name: str, gen: int) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.root}/{name}/gen={gen}")

    def _write_postings(self, rows: DataFrame, gen: int, docs: DataFrame | None = None, ordered: bool = False) -> None:
        """Frequencies are taken from what was written, so that texts aren't tokenised for them; ``docs``, where given, says which documents have a term; ``ordered`` rows are in order and partitions of term and document."""
        rows = rows if ordered else rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        if "payloads" not in rows.columns:
            rows = rows.withColumn("payloads", F.lit(None).cast("array<binary>"))
        self._write(rows, "postings", gen)
        own = self._written("postings", gen)
        self._write(own.groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("cf")).repartitionByRange("term").sortWithinPartitions("term"), "terms", gen)
        if docs is None or not docs.where("worded is null").isEmpty():
            self._write(field_stats(own), "stats", gen)
        else:
            sums = self._written("terms", gen).agg(F.sum("cf").alias("sum_term_hits"), F.count("*").alias("total_terms"), F.sum("df").alias("sum_terms_docs"))
            self._write(sums.withColumn("docs_cnt", docs.where("worded").agg(F.count("*").alias("n")).scalar()), "stats", gen)

    def _mark(self, gen: int, docs: int, updates: int) -> None:
        self._write(self.spark.range(1).select(F.lit(docs).cast("long").alias("docs"), F.lit(updates).cast("long").alias("updates")), "commits", gen)

    def commit(self, gen: int, added: DataFrame | None = None, replaced: DataFrame | None = None, erased: DataFrame | None = None) -> None:
        """One session: new, replaced and erased documents as generation ``gen``; ids may come once."""
        new = [d.select("doc_id", "text") for d in (added, replaced) if d is not None]
        gone = [d.select("doc_id") for d in (replaced, erased) if d is not None]
        count = hidden = 0
        if new:
            docs = new[0] if len(new) == 1 else new[0].unionByName(new[1])
            if not duplicates(docs).isEmpty():
                raise ValueError("a document is committed twice")
            self._write(docs.select("doc_id", R.worded(F.col("text"), self.tokenize).alias("worded")), "documents", gen)
            ids = self._written("documents", gen)
            count = ids.count()
            if self.payload is None:
                self._write_postings(R.postings(docs, R.bounds(docs, count, self.tokenize), self.tokenize), gen, ids, ordered=True)
            else:
                self._write_postings(postings(hits(docs, tokenize=self.tokenize, payload=self.payload)), gen, ids)
            if added is None:
                gone[0] = ids.select("doc_id")
        if gone:
            self._write((gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])).distinct(), "updates", gen)
            hidden = self._written("updates", gen).count()
        self._mark(gen, count, hidden)

    def _marks(self) -> dict[int, int | None]:
        """The committed generations, in order, and how many ids each hides (None: not known)."""
        try:
            rows = self.spark.read.schema(_SCHEMAS["commits"]).parquet(f"{self.root}/commits").select("gen", "updates").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        return {r.gen: r.updates for r in sorted(rows)}

    def generations(self) -> list[int]:
        """The committed generations, in order."""
        return list(self._marks())

    def keep(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Store:
        """Postings and frequencies stay in the executors' memory until ``release``."""
        for name in ("postings", "terms"):
            self._kept[name] = self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.root}/{name}").persist(level)
        return self

    def release(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept = {}

    def _live(self, name: str, marks: Mapping[int, int | None]) -> DataFrame:
        """What no newer generation hides; the oldest one's own updates hide nothing, so a single generation is joined to none."""
        found, newer = self._read(name, marks), list(marks)[1:]
        return live(found, self._read("updates", newer), _few(marks, newer)) if newer else found

    def postings(self) -> DataFrame:
        return self._live("postings", self._marks())

    def documents(self) -> DataFrame:
        return self._live("documents", self._marks()).select("doc_id", "gen")

    def updates(self) -> DataFrame:
        return self._read("updates")

    def terms(self, raw: bool = False) -> DataFrame:
        """``(term, df, cf)`` in order of terms; ``raw`` adds up the generations' own, with replaced and erased documents, as scores do."""
        if raw:
            return self._read("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return self.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("cf")).orderBy("term")

    def lookup(self, term: str) -> DataFrame:
        """``(term, df, cf)`` of one term over all generations, from the row groups that may hold it; no row for an unknown one."""
        return self._read("terms").where(F.col("term") == term).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def stats(self) -> DataFrame:
        """One row, added up over generations."""
        return self._read("stats").agg(*[F.sum(c).alias(c) for c in ("sum_term_hits", "total_terms", "sum_terms_docs", "docs_cnt")])

    def plan(self, query: str | Node, named: Mapping[str, DataFrame] | None = None) -> Plan:
        """A query on the live postings, with the generations' statistics."""
        gens = self._marks()
        node = parse(query) if isinstance(query, str) else query
        return Plan(node, self._live("postings", gens), self._live("documents", gens), named, stats=(self._read("terms", gens), self.stats()))

    def compact(self, gen: int, into: str) -> Store:
        """All generations as one in a new store at ``into``."""
        out = Store(self.spark, into, self.tokenize, self.payload)
        marks = self._marks()
        out._write(self._live("documents", marks).select("doc_id", "worded"), "documents", gen)
        docs = out._written("documents", gen)
        rows = merged(self._read("postings", marks), self._read("updates", marks), gen, unique=True, few=_few(marks, marks))
        out._write_postings(rows.drop("gen"), gen, docs)
        out._mark(gen, docs.count(), 0)
        return out

    def merge(self, gens: list[int], gen: int) -> DataFrame:
        """``gens`` become ``gen`` in this store; the result says what became of each generation by the rule of ``retention``.

        Merged generations leave; their update ids stay where an older generation does.
        """
        marks = self._marks()
        every = list(marks)
        if gen not in gens and gen in every:
            raise ValueError(f"generation {gen} is there already")
        if sorted(gens) != [g for g in every if min(gens) <= g <= max(gens)] or not min(gens) <= gen <= max(gens):
            raise ValueError("only generations that follow each other become one, in their place")
        hiding = [g for g in every if g >= min(gens)]
        newer, few = self._read("updates", hiding), _few(marks, hiding)
        staged = f"{self.root}/staged"
        merged(self._read("postings", gens), newer, gen, unique=True, few=few).drop("gen").write.mode("overwrite").parquet(f"{staged}/postings")
        live(self._read("documents", gens), newer, few).select("doc_id", "worded").write.mode("overwrite").parquet(f"{staged}/documents")
        rule = retention(self.spark.createDataFrame([(g, g in gens) for g in every], "gen long, candidate boolean"))
        kept = {r.gen: r.decision for r in rule.collect()}  # a row for each generation
        ids = self._read("updates", [g for g in gens if kept[g] == "retain_updates"]).select("doc_id").distinct()
        ids.write.mode("overwrite").parquet(f"{staged}/updates")
        for g in gens:
            self._remove(f"commits/gen={g}")
        for g in gens:
            for name in ("postings", "terms", "stats", "documents", "updates"):
                self._remove(f"{name}/gen={g}")
        self._write(self.spark.read.parquet(f"{staged}/documents"), "documents", gen)
        docs = self._written("documents", gen)
        self._write_postings(self.spark.read.parquet(f"{staged}/postings"), gen, docs)
        self._write(self.spark.read.parquet(f"{staged}/updates"), "updates", gen)
        self._mark(gen, docs.count(), self._written("updates", gen).count())
        self._remove("staged")
        return rule

    def _remove(self, place: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
