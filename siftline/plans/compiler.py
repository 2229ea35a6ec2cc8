"""Query trees to one lazy DataFrame.

``Plan`` answers all leaves of a query in one pass: every document that may
match gets a frequency (and, for phrases, positions) for each term, and the tree
becomes one boolean and one score expression.  Over documents these come from
the document's own row, with no shuffle, and only of documents whose text holds
the words at all; over postings from one aggregation.  Only a query that can
match a document without any of its terms is joined to the live documents.

Statistics for scores are a one-row subquery of the same plan (or the index's
own tables), so that building a plan runs nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import held, tokens
from siftline.plans.nodes import And, AndNot, AtLeast, Const, Leaf, Maybe, Node, Not, Or, Phrase, Term, leaves, simplify, terms_of

#: Terms of a query up to which documents are read by their rows; beyond, their tokens are posted and aggregated.
IN_ROW = 64


@dataclass(frozen=True)
class Scorer:
    """``score(frequency, weight)`` of a leaf, where ``weight`` is the sum over its terms of ``weigh(documents, documents with the term)``."""

    score: Callable[[Column, Column], Column]
    weigh: Callable[[Column, Column], Column]
    weighted: bool = True


Wrap = Callable[[Node, Column], Column]


def _double(c: Column) -> Column:
    return c.cast("double")


#: Others may be added, or given to ``scored`` as they are.
SCORERS: dict[str, Scorer] = {
    "trivial": Scorer(lambda f, w: _double(f), lambda n, df: F.lit(1.0), weighted=False),
    "tfidf": Scorer(lambda f, w: F.sqrt(_double(f)) * w, lambda n, df: F.log((_double(n) + 1.0) / (_double(df) + 1.0)) + 1.0),
    "bm25": Scorer(lambda f, w: w * (_double(f) / (_double(f) + 1.2)), lambda n, df: F.log(1.0 + (_double(n) - _double(df) + 0.5) / (_double(df) + 0.5))),
}


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _places(toks: Column, term: str) -> Column:
    """The positions of ``term``, from 1."""
    return F.filter(F.transform(toks, lambda x, i: F.when(x == term, i + 1)), lambda x: x.isNotNull())


def _overlapping(terms: tuple[str, ...]) -> bool:
    """Whether a phrase can begin again before it has ended."""
    return any(terms[k:] == terms[: len(terms) - k] for k in range(1, len(terms)))


def _written(terms: tuple[str, ...]) -> str:
    """A phrase as it stands in a line of tokens, each with a blank of its own on either side."""
    return " " + "  ".join(terms) + " "


def _hints(node: Node, text: Column) -> Column | None:
    """A cheap condition that a matching text surely meets: it holds the words as they are written. None for no such."""
    if isinstance(node, Term):
        return text.contains(node.text)
    if isinstance(node, Phrase):
        return _all([text.contains(t) for t in dict.fromkeys(node.terms)])
    if isinstance(node, And):
        own = [h for p in node.parts if not isinstance(p, Maybe) and (h := _hints(p, text)) is not None]
        return _all(own) if own else None
    if isinstance(node, (Or, AtLeast)):
        if isinstance(node, AtLeast) and node.least < 1:
            return None
        own = [_hints(p, text) for p in node.parts]
        return None if not own or any(h is None for h in own) else _any(own)
    if isinstance(node, AndNot):
        return _hints(node.keep, text)
    return _hints(node.part, text) if isinstance(node, Maybe) else None


class Plan:
    """``ids()``, ``scored()``, ``rich()`` and others of one query.

    ``postings`` is ``(term, doc_id, freq[, positions])``.  ``docs`` are the live
    documents, needed where a document may match without a term.  ``named`` has
    the application's own sets of documents.  ``stats`` has ``(term, df)`` and the
    number of documents, if known.  See ``over`` for plans without postings.
    """

    def __init__(
        self, node: Node, postings: DataFrame | None, docs: DataFrame | None = None, named: Mapping[str, DataFrame] | None = None,
        total: int | None = None, stats: tuple[DataFrame, DataFrame] | None = None,
    ) -> None:
        self.node, self.postings, self.docs, self.named = simplify(node), postings, docs, dict(named or {})
        self.total, self.stats = total, stats
        self.terms = terms_of(self.node)
        self.at = {t: k for k, t in enumerate(self.terms)}
        self.phrased = {t for n in leaves(self.node) if isinstance(n, Phrase) for t in n.terms}
        self.rows: DataFrame | None = None
        self.plain = False

    @classmethod
    def over(
        cls, node: Node, docs: DataFrame, named: Mapping[str, DataFrame] | None = None, tokenize: Callable[[Column], Column] = tokens,
        id_col: str = "doc_id", text_col: str = "text", where: Column | str | None = None,
    ) -> Plan:
        """A plan that reads documents of distinct ids by their rows; ``where`` chooses among them before any is tokenised."""
        chosen = docs if where is None else docs.where(where)
        rows = chosen.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        plan = cls(node, None, rows, named)
        plan.plain = tokenize is tokens  # then a term is written in the lower-cased text
        if len(plan.terms) > IN_ROW:
            toks = rows.select("doc_id", held(tokenize(F.col("text"))).alias("toks"))
            found = toks.select("doc_id", F.posexplode("toks").alias("at", "term")).where(F.col("term").isin(plan.terms))
            plan.postings = found.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("freq"), F.sort_array(F.collect_list(F.col("at") + 1)).alias("positions"))
            plan.total = None
        plan.rows, plan.tokenize = rows, tokenize
        return plan

    def _alone(self, node: Node) -> bool:
        """Whether ``node`` can match a document that has none of the query's terms."""
        if isinstance(node, Const):
            return node.value
        if isinstance(node, And):
            needed = [p for p in node.parts if not isinstance(p, Maybe)]
            return all(map(self._alone, needed)) if needed else any(map(self._alone, node.parts))
        if isinstance(node, Or):
            return any(map(self._alone, node.parts))
        if isinstance(node, Not):
            return True
        if isinstance(node, AndNot):
            return self._alone(node.keep)
        if isinstance(node, AtLeast):
            return sum(map(self._alone, node.parts)) >= node.least
        return self._alone(node.part) if isinstance(node, Maybe) else isinstance(node, Leaf)

    def table(self, every: bool = False, counts: bool = True, places: bool = False) -> DataFrame:
        """A row for each document that may match (``every``: for each that has a term), with ``f<k>`` of each term, null where it isn't there.

        Where they are needed (``places``: always) there are ``p<k>``, its positions.  Without ``counts``, ``f<k>`` only says that the term is there.
        """
        if self.rows is not None and self.postings is None:
            found = self._from_rows(every, counts, places)
        else:
            aggs = []
            for t, k in self.at.items():
                aggs.append(F.max(F.when(F.col("term") == t, F.col("freq"))).alias(f"f{k}"))
                if t in self.phrased:
                    aggs.append(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{k}"))
            found = self.postings.where(F.col("term").isin(self.terms)).groupBy("doc_id").agg(*aggs) if aggs else None
            if not every and self._alone(self.node):
                if self.docs is None:
                    raise ValueError("this query needs the live documents")
                live = self.docs.select("doc_id").distinct()
                found = live if found is None else live.join(found, "doc_id", "left")
            elif found is None:
                found = (self.postings if self.postings is not None else self.docs).select("doc_id").limit(0)
        for name in dict.fromkeys(n.name for n in leaves(self.node) if isinstance(n, Leaf)):
            found = found.join(self.named[name].select("doc_id").distinct().withColumn(f"leaf_{name}", F.lit(True)), "doc_id", "left")
        return found

    def _from_rows(self, every: bool, counts: bool, places: bool) -> DataFrame:
        rows = self.rows
        if not every and not self._alone(self.node):
            hint = _hints(self.node, F.lower("text")) if self.plain else None
            rows = rows.where(hint) if hint is not None else rows
        rows = rows.select("doc_id", held(self.tokenize(F.col("text"))).alias("toks"))
        toks = F.col("toks")
        cols = []
        phrases = [n for n in leaves(self.node) if isinstance(n, Phrase)]
        if phrases and self.plain:  # other tokenizers' terms may hold blanks
            rows = rows.select("doc_id", "toks", held(F.concat(F.lit(" "), F.concat_ws("  ", toks), F.lit(" "))).alias("line"))
            cols.append(F.col("line"))
        placed = set(self.terms) if places else {t for n in phrases if not self.plain or (counts and _overlapping(n.terms)) for t in n.terms}
        for t, k in self.at.items():
            freq = F.size(toks) - F.size(F.array_remove(toks, t)) if counts else F.lit(1)
            cols.append(F.when(F.array_contains(toks, t), freq).alias(f"f{k}"))
            if t in placed:
                cols.append(F.when(F.array_contains(toks, t), _places(toks, t)).alias(f"p{k}"))
        if every:
            rows = rows.where(F.size(toks) > 0)
        return rows.select("doc_id", *cols)

    def count(self, node: Phrase | Term) -> Column:
        """Occurrences of a leaf in a document; null or 0 for none."""
        if isinstance(node, Term):
            return F.col(f"f{self.at[node.text]}")
        if self.postings is None and self.plain and not _overlapping(node.terms):
            size = F.length("line") - F.length(F.replace(F.col("line"), F.lit(_written(node.terms)), F.lit("")))
            return (size / len(_written(node.terms))).cast("int")
        first, rest = node.terms[0], node.terms[1:]

        def here(x: Column) -> Column:
            return _all([x > 0, *(F.array_contains(F.col(f"p{self.at[t]}"), x + k) for k, t in enumerate(rest, 1))])

        sized = F.size(F.filter(F.col(f"p{self.at[first]}"), here))
        return F.when(_any([F.col(f"p{self.at[t]}").isNull() for t in dict.fromkeys(node.terms)]), 0).otherwise(sized)

    def match(self, node: Node) -> Column:
        if isinstance(node, Const):
            return F.lit(node.value)
        if isinstance(node, Term):
            return F.col(f"f{self.at[node.text]}").isNotNull()
        if isinstance(node, Phrase):
            return F.col("line").contains(_written(node.terms)) if self.postings is None and self.plain else self.count(node) > 0
        if isinstance(node, Leaf):
            return F.coalesce(F.col(f"leaf_{node.name}"), F.lit(False))
        if isinstance(node, And):
            needed = [p for p in node.parts if not isinstance(p, Maybe)]
            return _all(list(map(self.match, needed))) if needed else _any(list(map(self.match, node.parts)))
        if isinstance(node, Or):
            return _any(list(map(self.match, node.parts)))
        if isinstance(node, Not):
            return ~self.match(node.part)
        if isinstance(node, AndNot):
            return self.match(node.keep) & ~self.match(node.drop)
        if isinstance(node, Maybe):
            return self.match(node.part)
        return reduce(lambda a, b: a + b, [self.match(p).cast("int") for p in node.parts]) >= node.least

    def score(self, node: Node, scorer: Scorer, weights: Mapping[str, Column], wrap: Wrap | None = None) -> Column:
        """Sum over what matches; what only excludes and the application's own sets add nothing. ``wrap`` may change the score of any node."""
        own = self._score(node, scorer, weights, wrap)
        return own if wrap is None else wrap(node, own)

    def _score(self, node: Node, scorer: Scorer, weights: Mapping[str, Column], wrap: Wrap | None) -> Column:
        zero = F.lit(0.0)
        if isinstance(node, (Term, Phrase)):
            weight = reduce(lambda a, b: a + b, [weights[t] for t in ([node.text] if isinstance(node, Term) else node.terms)])
            return F.when(self.match(node), scorer.score(self.count(node), weight)).otherwise(zero)
        if isinstance(node, (And, Or, AtLeast)):
            own = [self.score(p, scorer, weights, wrap) for p in node.parts]
            if not isinstance(node, And):
                own = [F.when(self.match(p), s).otherwise(zero) for p, s in zip(node.parts, own)]
            return reduce(lambda a, b: a + b, own)
        if isinstance(node, AndNot):
            return self.score(node.keep, scorer, weights, wrap)
        if isinstance(node, Maybe):
            return F.when(self.match(node.part), self.score(node.part, scorer, weights, wrap)).otherwise(zero)
        return zero

    def ids(self) -> DataFrame:
        return self.table(counts=False).where(self.match(self.node)).select("doc_id")

    def _statistics(self, wanted: list[str]) -> dict[str, Column]:
        """The number of documents (``n``) and of those with each wanted term (``df<k>``) as scalar subqueries."""
        if self.stats is not None:
            terms, docs = self.stats
            sums = terms.where(F.col("term").isin(wanted)).agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).alias(f"df{self.at[t]}") for t in wanted]) if wanted else None
            out = {f"df{self.at[t]}": F.coalesce(sums.select(f"df{self.at[t]}").scalar(), F.lit(0)) for t in wanted}
            return out | {"n": docs.select("docs_cnt").scalar()}
        dfs = [F.count(F.col(f"f{self.at[t]}")).alias(f"df{self.at[t]}") for t in wanted]
        if self.postings is None:
            one = self.table(every=True, counts=False).agg(F.count("*").alias("n"), *dfs)
        else:
            one = self.table(every=True).agg(F.lit(1).alias("one"), *dfs) if wanted else None
        own = {f"df{self.at[t]}": one.select(f"df{self.at[t]}").scalar() for t in wanted}
        if self.total is not None:
            return own | {"n": F.lit(self.total)}
        if self.postings is None:
            return own | {"n": one.select("n").scalar()}
        count = self.rows.where(F.size(self.tokenize(F.col("text"))) > 0).agg(F.count("*").alias("n")) if self.rows is not None else self.postings.select("doc_id").distinct().agg(F.count("*").alias("n"))
        return own | {"n": count.scalar()}

    def scored(self, scorer: str | Scorer = "bm25", wrap: Wrap | None = None) -> DataFrame:
        """``(doc_id, score)``; ``wrap`` is given each node of the tree with its score, and returns the score to use."""
        rule = SCORERS[scorer] if isinstance(scorer, str) else scorer
        wanted = terms_of(self.node, positive=True)
        if rule.weighted:
            stats = self._statistics(wanted)
            weights = {t: rule.weigh(stats["n"], stats[f"df{self.at[t]}"]) for t in wanted}
        else:
            weights = {t: rule.weigh(F.lit(0), F.lit(0)) for t in wanted}
        return self.table().where(self.match(self.node)).select("doc_id", self.score(self.node, rule, weights, wrap).alias("score"))

    def top(self, k: int, scorer: str | Scorer = "bm25") -> DataFrame:
        return self.scored(scorer).orderBy(F.desc("score"), "doc_id").limit(k)

    def rich(self) -> DataFrame:
        """``(doc_id, term, freq, positions)`` of matches, without terms that only exclude."""
        wanted = terms_of(self.node, positive=True)
        if self.postings is None:
            found = self.table(places=True).where(self.match(self.node))
            each = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"f{self.at[t]}").alias("freq"), F.col(f"p{self.at[t]}").alias("positions")) for t in wanted])
            return found.select("doc_id", F.explode(F.filter(each, lambda x: x["freq"].isNotNull())).alias("m")).select("doc_id", "m.term", "m.freq", "m.positions")
        return self.postings.where(F.col("term").isin(wanted)).join(self.ids(), "doc_id", "left_semi").select("doc_id", "term", "freq", "positions")

    def counted(self) -> DataFrame:
        """``(doc_id, matched)``: how many of the query's positive leaves a matching document has."""
        own = leaves(self.node, positive=True)
        total = reduce(lambda a, b: a + b, [self.match(n).cast("int") for n in own], F.lit(0))
        return self.table(counts=False).where(self.match(self.node)).select("doc_id", total.alias("matched"))

    def explain(self) -> str:
        """The simplified tree, a line for each node, and how its leaves are read."""
        how = "rows of documents" if self.postings is None else "postings"
        lines = [f"read {len(self.terms)} terms from {how}" + (", positions of " + ", ".join(sorted(self.phrased)) if self.phrased else "")]
        if self._alone(self.node):
            lines.append("beside all live documents, since one may match without a term")

        def show(node: Node, depth: int) -> None:
            inner = {Term: lambda: f"term {node.text}", Phrase: lambda: f'phrase "{" ".join(node.terms)}"', Const: lambda: str(node.value).lower(), Leaf: lambda: f"set {node.name}", AtLeast: lambda: f"at least {node.least} of"}
            names = {And: "all of", Or: "any of", Not: "not", AndNot: "first without second", Maybe: "optional"}
            lines.append("  " * depth + (inner[type(node)]() if type(node) in inner else names[type(node)]))
            for part in (node.parts if isinstance(node, (And, Or, AtLeast)) else (node.part,) if isinstance(node, (Not, Maybe)) else (node.keep, node.drop) if isinstance(node, AndNot) else ()):
                show(part, depth + 1)

        show(self.node, 1)
        return "\n".join(lines)


def search(node: Node, postings: DataFrame, docs: DataFrame | None = None, **named: DataFrame) -> DataFrame:
    return Plan(node, postings, docs, named).ids()


def within(docs: DataFrame, start: int | None = None, stop: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """The documents of ids from ``start`` to below ``stop``; the bounds reach the scan."""
    out = docs if start is None else docs.where(F.col(id_col) >= start)
    return out if stop is None else out.where(F.col(id_col) < stop)
