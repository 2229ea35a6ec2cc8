"""Stored queries matched against documents, in batch or on a stream.

A few queries are an expression each.  Many are a table: each query becomes
clauses (terms and phrases that must be there and such that must not), each
posted under the hash of its most telling words; a document meets only the
clauses whose words it holds, in one join, and what it meets is verified on its
tokens.  Optional parts count as ``settled`` says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siftline.functions.text import held, tokens
from siftline.plans.nodes import FALSE, TRUE, And, AndNot, AtLeast, Const, Maybe, Node, Not, Or, Phrase, Term, parse, settled, simplify

#: Words of a phrase that are hashed together.
GRAM = 3
#: Queries that are made expressions rather than a table, and clauses into which a query may fall.
EXPRESSIONS, CLAUSES = 24, 512
#: Clauses up to which the table is broadcast (some hundred bytes each); a larger one is joined by shuffle.
BROADCAST = 100_000
_CLAUSES = "query_id long, n int, anchor array<string>, pos array<string>, lines array<string>, no array<string>, no_lines array<string>"

Clause = tuple[frozenset, frozenset]


def _line(words: Column) -> Column:
    return F.concat(F.lit(" "), F.concat_ws(" ", words), F.lit(" "))


def _holds(node: Node, toks: Column) -> Column:
    if isinstance(node, Const):
        return F.lit(node.value)
    if isinstance(node, Term):
        return F.array_contains(toks, node.text)
    if isinstance(node, Phrase):
        return F.array_contains(toks, node.terms[0]) & _line(toks).contains(" " + " ".join(node.terms) + " ")
    if isinstance(node, Not):
        return ~_holds(node.part, toks)
    if isinstance(node, AndNot):
        return _holds(node.keep, toks) & ~_holds(node.drop, toks)
    if isinstance(node, Maybe):
        return F.lit(True)
    parts = [_holds(p, toks) for p in node.parts]
    if isinstance(node, AtLeast):
        return reduce(lambda a, b: a + b, [p.cast("int") for p in parts]) >= node.least
    return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), parts)


def _product(groups: list[set[Clause]]) -> set[Clause]:
    out: set[Clause] = {(frozenset(), frozenset())}
    for group in groups:
        out = {(p | q, n | m) for p, n in out for q, m in group if not (p | q) & (n | m)}
        if len(out) > CLAUSES:
            raise OverflowError
    return out


def _clauses(node: Node, wanted: bool) -> set[Clause]:
    if isinstance(node, Const):
        return {(frozenset(), frozenset())} if node.value == wanted else set()
    if isinstance(node, (Term, Phrase)):
        return {(frozenset([node]), frozenset())} if wanted else {(frozenset(), frozenset([node]))}
    if isinstance(node, Not):
        return _clauses(node.part, not wanted)
    if isinstance(node, AndNot):
        return _clauses(And((node.keep, Not(node.drop))), wanted)
    parts = [_clauses(p, wanted) for p in node.parts]
    if isinstance(node, AtLeast):
        least = node.least if wanted else len(parts) - node.least + 1
        if least <= 0 or least > len(parts):
            return _clauses(TRUE if least <= 0 else FALSE, True)
        out: set[Clause] = set()
        for own in combinations(parts, least):
            out |= _product(list(own))
            if len(out) > CLAUSES:
                raise OverflowError
        return out
    return _product(parts) if isinstance(node, And) == wanted else set().union(*parts)


def clauses(node: Node) -> list[Clause] | None:
    """The ways in which a document can match; None if there are too many, or one that needs no word."""
    try:
        found = _clauses(simplify(settled(node)), True)
    except OverflowError:
        return None
    return None if len(found) > CLAUSES or any(not p for p, _ in found) else [c for c in found if not any(o != c and o[0] <= c[0] and o[1] <= c[1] for o in found)]


def _rows(query_id: int, found: list[Clause]) -> Iterator[tuple]:
    for need, no in found:
        phrases = [p.terms for p in need if isinstance(p, Phrase)]
        grams = [p[k : k + min(GRAM, len(p))] for p in phrases for k in range(len(p) - min(GRAM, len(p)) + 1)] or [(t.text,) for t in need]
        anchor = max(grams, key=lambda g: (len(g), sum(map(len, g)), g))  # longer words are rarer
        yield (
            query_id, len(anchor), list(anchor), sorted(t.text for t in need if isinstance(t, Term)), sorted(f" {' '.join(p)} " for p in phrases),
            sorted(t.text for t in no if isinstance(t, Term)), sorted(f" {' '.join(p.terms)} " for p in no if isinstance(p, Phrase)),
        )


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def _bitmap(hashes: list[int]) -> Callable[[Column], Column]:
    """Whether a hash may be one of ``hashes``: a bit for each value of its last bits, sixteen times as many as hashes."""
    bits = 1 << max(12, (16 * len(hashes) - 1).bit_length())
    words = [0] * (bits // 64)
    for h in hashes:
        words[(h & (bits - 1)) >> 6] |= 1 << (h & 63)
    signed = ",".join(str(w - (1 << 64) if w >> 63 else w) for w in words)
    table = F.split(F.lit(signed), ",").cast("array<long>")  # a constant of the plan

    def known(h: Column) -> Column:
        word = F.get(table, F.call_function("shiftright", h.bitwiseAND(F.lit(bits - 1)), F.lit(6)).cast("int"))
        return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return known


def _met(toks: DataFrame, table: DataFrame) -> DataFrame:
    """``(doc_id, query_id)`` of ``(doc_id, toks)`` and clauses, of which some words must be there."""
    anchor = reduce(lambda c, n: F.when(F.col("n") == n, _hash([F.col("anchor")[k] for k in range(n)])).otherwise(c), range(1, GRAM + 1), F.lit(None).cast("long"))
    table = table.withColumn("gram", anchor).drop("anchor")
    sizes = table.agg(F.count("*").alias("rows"), F.collect_set("n").alias("lengths")).first()  # GRAM lengths at most

    def grams(n: int) -> Column:
        if n == 1:
            return F.transform(F.array_distinct("toks"), lambda t: _hash([t]))
        starts = F.when(F.size("toks") >= n, F.sequence(F.lit(0), F.size("toks") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: _hash([F.get("toks", i + k) for k in range(n)]))

    if not sizes.rows:
        return toks.select("doc_id", F.lit(0).cast("long").alias("query_id")).limit(0)
    every = F.concat(*[grams(n) for n in sorted(sizes.lengths)])  # longer ones seldom repeat
    if sizes.rows <= BROADCAST:
        # tokens go along with each gram, so that only those that may be some clause's are let through
        known = _bitmap([r.gram for r in table.select("gram").distinct().collect()])
        own = toks.select("doc_id", "toks", held(F.array_distinct(F.filter(every, known))).alias("grams"))
        met = own.select("doc_id", "toks", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    else:
        met = toks.select("doc_id", held(every).alias("grams")).select("doc_id", F.explode("grams").alias("gram")).join(table, "gram").drop("gram").join(toks, "doc_id")
    line = _line(F.col("toks"))
    right = (F.size(F.array_except("pos", "toks")) == 0) & ~F.arrays_overlap("no", "toks") & F.forall("lines", lambda p: line.contains(p)) & ~F.exists("no_lines", lambda p: line.contains(p))
    return met.where(right).select("doc_id", "query_id").distinct()


def _tokenised(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", held(tokens(F.col("text"))).alias("toks"))


def _expressions(toks: DataFrame, stored: Mapping[int, Node]) -> DataFrame:
    ids = [F.when(_holds(simplify(settled(n)), F.col("toks")), F.lit(q).cast("long")) for q, n in stored.items()]
    return toks.select("doc_id", held(F.array_compact(F.array(*ids))).alias("ids")).select("doc_id", F.explode("ids").alias("query_id"))


def percolate(docs: DataFrame, stored: Mapping[int, Node]) -> DataFrame:
    """``(doc_id, query_id)`` of documents of distinct ids.

    Up to ``EXPRESSIONS`` queries are stateless expressions, so that streams can be used as well.
    """
    toks = _tokenised(docs)
    if len(stored) <= EXPRESSIONS or docs.isStreaming:
        return _expressions(toks, stored)
    found = {q: clauses(n) for q, n in stored.items()}
    rows = [r for q, own in found.items() if own is not None for r in _rows(q, own)]
    out = _met(toks, docs.sparkSession.createDataFrame(rows, _CLAUSES))
    other = [q for q, own in found.items() if own is None]
    for k in range(0, len(other), EXPRESSIONS):
        out = out.unionByName(_expressions(toks, {q: stored[q] for q in other[k : k + EXPRESSIONS]}))
    return out


def compiled(queries: DataFrame) -> DataFrame:
    """The clauses of a table of stored queries ``(query_id, query)``; a query without clauses has one row with ``n`` 0 and its text as ``anchor``."""

    def compile_rows(rows: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in _CLAUSES.split(", ")]
        for frame in rows:
            out: list[tuple] = []
            for q, text in zip(frame["query_id"], frame["query"]):
                own = clauses(parse(text or ""))
                out += [(q, 0, [text], [], [], [], [])] if own is None else list(_rows(q, own))
            yield pd.DataFrame(out, columns=names)

    return queries.select(F.col("query_id").cast("long"), F.col("query").cast("string")).mapInPandas(compile_rows, _CLAUSES)


def percolate_table(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """As ``percolate`` for a table of stored queries ``(query_id, query)`` of any size.

    Queries that may match without a word meet every document anyway; only these are brought to the driver.
    """
    table, toks = compiled(queries), _tokenised(docs)
    out = _met(toks, table.where("n > 0"))
    rest: list[Row] = table.where("n = 0").select("query_id", F.col("anchor")[0].alias("query")).collect()
    for k in range(0, len(rest), EXPRESSIONS):
        out = out.unionByName(_expressions(toks, {r.query_id: parse(r.query or "") for r in rest[k : k + EXPRESSIONS]}))
    return out


def percolate_phrases(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(doc_id, query_id)`` of the documents that hold a stored phrase ``(query_id, text)``, for any number of phrases of any length.

    Each phrase is posted under those of its words side by side that are longest, so a document meets few that it doesn't hold.
    """
    q = phrases.select(F.col("query_id").cast("long").alias("query_id"), tokens(F.col("text")).alias("qt")).where("size(qt) > 0")
    q = q.withColumn("n", F.least(F.lit(GRAM), F.size("qt")))
    length = lambda i: F.length(F.concat_ws("", F.slice("qt", i + 1, F.col("n"))))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("qt") - F.col("n")), lambda i: F.struct(length(i).alias("size"), (-i).alias("back"))))
    empty = F.array().cast("array<string>")
    table = q.withColumn("start", -best["back"]).select("query_id", "n", F.slice("qt", F.col("start") + 1, F.col("n")).alias("anchor"), empty.alias("pos"), F.array(_line(F.col("qt"))).alias("lines"), empty.alias("no"), empty.alias("no_lines"))
    return _met(_tokenised(docs), table)
