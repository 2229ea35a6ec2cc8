"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting takes at most ``EXAMPLES`` labelled documents of each class (those of
the least id hashes; every ``HELD``-th is held out for calibration).  Terms are
all words of the examples and, for inflected languages, the first ``STEMS``
bytes of longer ones; none is left out for being rare.  A weight is
``(1 + ln tf) * (ln((N + 1) / (df + 1)) + 1)``, with ``N`` and ``df`` counted over
all documents, times how far the term tells the classes apart: the size of the
difference of its log frequencies in them (smoothed by ``SMOOTH``), ``EVEN`` at
least.

Search is exact, by a block-max inverted index.  Examples lie in blocks of
``BLOCK`` like ones; a term in a share of ``HEAVY`` of all or more has its greatest
weight in each block.  The postings of the other terms are added up at once; the
greatest such sum of a block and its terms' greatest weights together bound the
cosine with any of its examples.  The blocks of the greatest bounds are scored
first; then of the others only those whose bound reaches the ``NEAREST``-th best
cosine so far.

The ``NEAREST`` by cosine vote with ``1 / (1.05 - cosine)`` (ties by the lesser
id) against a weight of ``PRIOR`` for clean, so that a few faint likenesses
prove nothing; a logistic curve fitted on the held-out documents makes the share
of toxic votes a probability.

The model has the distinct terms of at most ``2 * EXAMPLES`` texts, whatever the
size of the table, so sending it to executors is safe; texts are only read in
place, and only the terms' document frequencies are shuffled.

Cases: null, empty and wordless texts and texts without a word of
any example have score 0 and are kept; texts of any length are used whole; rows with a null id are
judged by their text too; repeated rows are judged each; of an id's labels the
most toxic counts; null labels are ignored; no toxic labels reject nothing;
other columns, whatever their names, stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.lockstep import Table
from siftline.llm.wordhash import mix64, slices, term_counts, word_hashes

EXAMPLES, HELD, NEAREST = 2000, 4, 15
STEMS = (4, 6, 8)
SMOOTH, EVEN = 0.5, 0.1
#: Examples of a block, the blocks that are scored first, and texts that are judged together.
BLOCK, FIRST, ROWS = 64, 3, 96
#: A term in at least this share of the examples has postings that are skipped by blocks.
HEAVY = 1 / 16
PRIOR = 20.0
THRESHOLD = 0.5


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    out = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _key(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(1)).astype(np.int64)


class Terms:
    """Sorted hashes of known terms, with a table to find them in texts."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.table = Table(_key(hashes), np.arange(len(hashes), dtype=np.int32))

    def __reduce__(self) -> tuple:
        return Terms, (self.hashes,)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, term, count)`` of the known terms of every row, in order."""
        found, offsets = word_hashes(texts, STEMS)
        term = self.table.get(_key(found)).astype(np.int64)
        hit = np.flatnonzero(term >= 0)
        pair = np.sort(np.searchsorted(offsets, hit, side="right") - 1 << 32 | term[hit])
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        return pair[first] >> 32, pair[first] & 0xFFFFFFFF, np.diff(np.append(first, len(pair)))


@dataclass(frozen=True)
class Index:
    terms: Terms
    factor: np.ndarray  # of each term's weight
    starts: np.ndarray  # a light term k has the postings from starts[k] to starts[k + 1]
    rows: np.ndarray  # of each posting the example
    values: np.ndarray  # and the term's weight there
    heavy: np.ndarray  # the number of a heavy term, -1 of a light one
    most: np.ndarray  # of each heavy term and block the greatest weight
    dense: np.ndarray  # of each block the weights of the heavy terms in its examples
    ids: np.ndarray
    toxic: np.ndarray

    def weighted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, term, weight)``, the weights of a row of length 1."""
        row, term, count = self.terms.counts(texts)
        weight = (1.0 + np.log(count)) * self.factor[term]
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(texts)))
        return row, term, weight / norm[row]

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, count: int, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, example, cosine)`` of the ``k`` best positive cosines of each of ``count`` rows, ties by the lesser id, best first."""
        blocks = len(self.dense)
        size = self.starts[term + 1] - self.starts[term]
        at = _ranges(self.starts[term], size)
        cell = np.repeat((row * (blocks * BLOCK)).astype(np.int32), size)
        cell += self.rows[at]
        value = self.values[at]
        value *= np.repeat(weight, size)
        scores = np.bincount(cell, weights=value, minlength=count * blocks * BLOCK).astype(float, copy=False).reshape(count, blocks, BLOCK)
        del at, cell, value
        known = self.heavy[term]
        own = known >= 0
        loud = np.zeros((count, len(self.most)))
        loud[row[own], known[own]] = weight[own]
        bounds = loud @ self.most + scores.max(axis=2)
        rest = bounds > 0
        flat = scores.reshape(count, blocks * BLOCK)
        if blocks > FIRST:
            first = np.zeros(rest.shape, dtype=bool)
            np.put_along_axis(first, np.argpartition(-bounds, FIRST - 1, axis=1)[:, :FIRST], True, axis=1)
            self._add(scores, loud, first & rest)
            floor = np.partition(flat, flat.shape[1] - k, axis=1)[:, -k] if flat.shape[1] > k else np.zeros(count)
            rest &= ~first & (bounds >= floor[:, None] - 2e-9)  # rounding apart
        self._add(scores, loud, rest)
        np.round(flat, 9, out=flat)
        floor = np.partition(flat, flat.shape[1] - k, axis=1)[:, -k] if flat.shape[1] > k else np.zeros(count)
        r, e = np.nonzero((flat > 0) & (flat >= floor[:, None]))
        order = np.lexsort((self.ids[e], -flat[r, e], r))
        r, e = r[order], e[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, e = r[rank < k], e[rank < k]
        return r, e, flat[r, e]

    def _add(self, scores: np.ndarray, loud: np.ndarray, wanted: np.ndarray) -> None:
        """The heavy terms' part of the scores of the wanted rows and blocks."""
        for b in np.flatnonzero(wanted.any(axis=0)):
            own = np.flatnonzero(wanted[:, b])
            scores[own, b] += loud[own] @ self.dense[b]

    def votes(self, row: np.ndarray, example: np.ndarray, cosine: np.ndarray, count: int) -> np.ndarray:
        """The share of toxic votes of each row."""
        each = 1.0 / (1.05 - cosine)
        return np.bincount(row, weights=each * self.toxic[example], minlength=count) / (PRIOR + np.bincount(row, weights=each, minlength=count))


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of at most ``ROWS`` texts."""
    for start, stop in slices(texts):
        for at in range(start, stop, ROWS):
            yield at, min(at + ROWS, stop)


@dataclass(frozen=True)
class Model:
    index: Index
    slope: float
    shift: float

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * votes + self.shift)))

    def judge(self, texts: pa.Array, least: float = 0.0) -> Iterator[tuple[int, float, list[tuple[float, int]]]]:
        """``(row, score, neighbours)`` of the texts that have a neighbour and a score of at least ``least``."""
        if not len(self.index.ids):
            return
        for start, stop in _groups(texts):
            count = stop - start
            row, example, cosine = self.index.nearest(*self.index.weighted(texts.slice(start, count)), count)
            scores = self.scores(self.index.votes(row, example, cosine, count))
            first = np.searchsorted(row, np.arange(count + 1))
            for k in np.flatnonzero((scores >= least) & (first[1:] > first[:-1])):
                own = slice(first[k], first[k + 1])
                yield start + int(k), float(scores[k]), list(zip(cosine[own].tolist(), example[own].tolist()))
        pa.default_memory_pool().release_unused()


#: Of sorted word hashes, the number of documents and of those with each word.
Frequencies = Callable[[np.ndarray], tuple[int, np.ndarray]]


def _order(row: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """An order of the ``n`` examples in which like ones are close: halved again and again along signed sums of weights."""
    sums = np.zeros((n, 12))
    for k in range(12):
        sign = 1.0 - 2.0 * (mix64(word ^ mix64(np.array([k + 1], dtype=np.uint64))) >> np.uint64(63)).astype(float)
        sums[:, k] = np.bincount(row, weights=weight * sign, minlength=n)
    out, todo = [], [np.arange(n)]
    while todo:
        own = todo.pop()
        if len(own) <= BLOCK:
            out.append(own)
            continue
        widest = int(sums[own].var(axis=0).argmax())
        own = own[np.argsort(sums[own, widest], kind="stable")]
        half = -(-len(own) // (2 * BLOCK)) * BLOCK
        todo += [own[half:], own[:half]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def build(ids: list[int], texts: list[str], toxic: list[bool], frequencies: Frequencies | None = None) -> Index:
    """Without ``frequencies`` the examples are all documents."""
    n, flags = len(ids), np.array(toxic, dtype=bool)
    column = pa.array(texts, pa.string())
    # by slices, for the memory that hashing takes
    parts = [(start, *term_counts(*word_hashes(column.slice(start, stop - start), STEMS))) for start, stop in slices(column)]
    row = np.concatenate([start + r for start, r, _, _ in parts] or [np.zeros(0, dtype=np.int64)])
    word = np.concatenate([w for _, _, w, _ in parts] or [np.zeros(0, dtype=np.uint64)])
    count = np.concatenate([c for _, _, _, c in parts] or [np.zeros(0, dtype=np.int64)])
    del parts
    words, at = np.unique(word, return_inverse=True)
    bad = np.bincount(at, weights=flags[row], minlength=len(words)) if n else np.zeros(0)
    df = np.bincount(at, minlength=len(words)).astype(float)
    positive = float(flags.sum())
    apart = np.log((bad + SMOOTH) / (positive + 1)) - np.log((df - bad + SMOOTH) / (n - positive + 1))
    total, documents = frequencies(words) if frequencies and len(words) else (n, df)
    factor = (np.log((total + 1) / (documents + 1)) + 1.0) * np.maximum(np.abs(apart), EVEN)
    weight = (1.0 + np.log(count)) * factor[at]
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))
    value = weight / norm[row]
    place = np.empty(n, dtype=np.int64)
    order = _order(row, word, value, n)
    place[order] = np.arange(n)
    row = place[row]
    blocks = max(1, -(-n // BLOCK))
    heavy = np.full(len(words), -1, dtype=np.int32)
    often = df >= max(2, HEAVY * n)
    heavy[often] = np.arange(int(often.sum()), dtype=np.int32)
    sort = np.argsort(at, kind="stable")
    light = sort[heavy[at[sort]] < 0]
    starts = np.searchsorted(at[light], np.arange(len(words) + 1))
    own = np.flatnonzero(heavy[at] >= 0)
    dense = np.zeros((blocks, int(often.sum()), BLOCK))
    dense[row[own] // BLOCK, heavy[at[own]], row[own] % BLOCK] = value[own]
    most = dense.max(axis=2).T.copy()
    return Index(Terms(words), factor, starts, row[light].astype(np.int32), value[light], heavy, most, dense, np.array(ids, dtype=np.int64)[order], flags[order])


def _logistic(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Platt's curve, with his smoothed targets, by Newton steps."""
    good = (toxic.sum() + 1) / (toxic.sum() + 2)
    target = np.where(toxic, good, 1 / ((~toxic).sum() + 2))
    x = np.column_stack([votes, np.ones(len(votes))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def fit_rows(rows: list[tuple[int, str, int]], frequencies: Frequencies | None = None) -> Model:
    """The model of ``(id, text, toxic)`` rows; every ``HELD``-th of a class calibrates it."""
    train, held = [], []
    for flag in (0, 1):
        own = [r for r in rows if bool(r[2]) == bool(flag)]
        for k, r in enumerate(own):
            (held if k % HELD == HELD - 1 else train).append(r)
    index = build([r[0] for r in train], [r[1] for r in train], [bool(r[2]) for r in train], frequencies)
    if not any(r[2] for r in train):
        return Model(index, 0.0, -20.0)
    check = held or train
    votes = np.zeros(len(check))
    texts = pa.array([r[1] for r in check], pa.string())
    for start, stop in _groups(texts):
        count = stop - start
        votes[start:stop] = index.votes(*index.nearest(*index.weighted(texts.slice(start, count)), count), count)
    return Model(index, *_logistic(votes, np.array([bool(r[2]) for r in check])))


def document_frequencies(texts: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of ``texts`` and of those with each of ``words``, in one aggregation."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(shared.value)
        df, rows = np.zeros(len(known.hashes), dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for start, stop in slices(batch.column(0)):
                df += np.bincount(known.counts(batch.column(0).slice(start, stop - start))[1], minlength=len(df))
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int64()), pa.array(np.append(df[found], rows), pa.int64())], ["term", "n"])

    got = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(len(words))
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Model:
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for flag in (0, 1):
        part = own.where((F.col("toxic") > 0) == bool(flag)).orderBy("h", "doc_id").limit(examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    rows = [(r.doc_id, r.text, r.toxic) for r in sorted(found.collect(), key=lambda r: (r.h, r.doc_id))]
    return fit_rows(rows, lambda words: document_frequencies(texts.select("text"), words))


def rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, evidence)`` of the toxic documents; ``evidence`` has the nearest examples as ``id:cosine:label``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = list(model.judge(batch.column(1), threshold))
            why = [" ".join(f"{model.index.ids[e]}:{c:.4f}:{int(model.index.toxic[e])}" for c, e in near) for _, _, near in got]
            ids = batch.column(0).take(pa.array([n for n, _, _ in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([s for _, s, _ in got], pa.float64()), pa.array(why, pa.string())], ["doc_id", "score", "evidence"])

    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return slim.mapInArrow(judge, "doc_id long, score double, evidence string")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the toxic documents; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            stay = np.ones(batch.num_rows, dtype=bool)
            stay[[n for n, _, _ in model.judge(batch.column(at), threshold)]] = False
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(keep, docs.schema)
