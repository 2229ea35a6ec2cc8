"""Where each term of a query stands in it: the query's slots, for rich matches and their scoring.

Terms are numbered by the places they take in the query.  What only excludes
has no places.  A term that is repeated side by side is one instance with ``rep``
above 1; the terms of a phrase share a ``phrase_id``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.plans.nodes import And, AndNot, Node, Not, Phrase, Term, children, parse
from siftline.plans.rewrite import Provenance

SCHEMA = "slot int, term string, rep int, to_next_span int, flags int, phrase_id int, first int, stop int, coefficient double, source_size int"


@dataclass(frozen=True)
class Instance:
    slot: int
    term: str
    rep: int = 1
    to_next_span: int = 0  # places to the next slot, 0 for the last
    flags: int = 0
    phrase_id: int = 0  # of single terms 0
    first: int | None = None  # of a rewritten term the places it stands for
    stop: int | None = None
    coefficient: float = 1.0
    source_size: int = 1


def _gather(node: Node, out: list[Instance], slot: int, phrases: list[int]) -> int:
    if isinstance(node, Term):
        if out and out[-1].term == node.text and out[-1].slot == slot - 1 and not out[-1].phrase_id:
            out[-1] = replace(out[-1], rep=out[-1].rep + 1)
            return slot
        out.append(Instance(slot, node.text))
        return slot + 1
    if isinstance(node, Phrase):
        phrases[0] += 1
        out.extend(Instance(slot + k, t, phrase_id=phrases[0]) for k, t in enumerate(node.terms))
        return slot + len(node.terms)
    if isinstance(node, Not):
        return slot
    parts = (node.keep,) if isinstance(node, AndNot) else children(node)
    for k, part in enumerate(parts):
        if k and not isinstance(node, And) and out:  # only neighbours of one And repeat a term
            mark = len(out)
            later: list[Instance] = []
            slot = _gather(part, later, slot, phrases)
            out[mark:] = later
        else:
            slot = _gather(part, out, slot, phrases)
    return slot


def instances(query: str | Node) -> list[Instance]:
    """All places of the query's terms, in order."""
    out: list[Instance] = []
    _gather(parse(query) if isinstance(query, str) else query, out, 0, [0])
    last = max((i.slot for i in out), default=0)
    return [replace(i, to_next_span=0 if i.slot == last else 1) for i in out]


def rewritten(run: Iterable[str], trace: Iterable[Provenance]) -> list[Instance]:
    """The places of a run of terms and of the alternatives that rewriting added to it."""
    words = list(run)
    out = [Instance(k, w, to_next_span=1 if k + 1 < len(words) else 0, first=k, stop=k + 1) for k, w in enumerate(words)]
    for p in trace:
        span = 0 if p.stop >= len(words) else p.stop - p.start
        for i in instances(p.text):
            out.append(replace(i, slot=p.start, to_next_span=span, flags=p.flags, first=p.start, stop=p.stop, coefficient=p.coefficient, source_size=p.source_size))
    return out


def table(spark: SparkSession, found: Iterable[Instance]) -> DataFrame:
    return spark.createDataFrame([tuple(getattr(i, c.split()[0]) for c in SCHEMA.split(", ")) for i in found], SCHEMA)


def index_terms(found: DataFrame, disregard_flags: bool = False) -> DataFrame:
    """The distinct ``(term, to_next_span, flags)`` of each slot; with ``disregard_flags`` those that differ in flags only are one."""
    key = ["slot", "term", "to_next_span"]
    return found.select(*key).distinct() if disregard_flags else found.select(*key, "flags").distinct()


def annotated(rich: DataFrame, found: DataFrame) -> DataFrame:
    """A rich match ``(doc_id, term, freq, positions)`` with each term's instances in the query, which are a few rows."""
    own = found.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("slot", "rep", "to_next_span", "flags", "phrase_id"))).alias("instances"))
    return rich.join(F.broadcast(own), "term")
