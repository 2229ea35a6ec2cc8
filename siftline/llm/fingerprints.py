"""Document fingerprints by improved consistent weighted sampling (Ioffe, 2010).

A document is its words weighted by their counts.  For each of ``samples``
coordinates and each word, a hash gives ``r, c ~ Gamma(2, 1)`` and a uniform
``beta``; with ``t = floor(ln(weight) / r + beta)`` the word's draw is
``ln a = ln c - r * (t - beta + 1)``.  The word with the least draw is sampled.
Since a draw depends on the word and ``t`` alone, its bits name the sampled
``(word, t)``; two documents agree in a coordinate with a probability equal to
the generalised Jaccard similarity of their weights.

Texts are handled in slices; the draws of each distinct (word, count) pair of
a slice are computed once and gathered.  Nothing is shuffled.

Cases: null, empty and wordless texts have an empty signature; texts of any
length are used whole; repeated rows have a row each; a null id stays null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.wordhash import mix64, slices, term_counts, word_hashes

SAMPLES = 64
#: Bytes of text in a slice; the larger, the more words share their draws.
SLICE = 4 << 20


def _uniform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniforms in (0, 1) of each 64-bit hash."""
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = (x >> np.uint64(32)).astype(np.float64)
    return (low + 0.5) * 2.0**-32, (high + 0.5) * 2.0**-32


def draws(words: np.ndarray, weights: np.ndarray, sample: int) -> np.ndarray:
    """``ln a`` of each (word hash, weight) for one coordinate."""
    seed = mix64(np.array([sample + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
    h = mix64(words ^ seed)
    u1, u2 = _uniform(h)
    u3, u4 = _uniform(mix64(h + np.uint64(1)))
    beta, _ = _uniform(mix64(h + np.uint64(2)))
    r, c = -np.log(u1 * u2), -np.log(u3 * u4)
    t = np.floor(np.log(weights) / r + beta)
    return np.log(c) - r * (t - beta + 1.0)


def signatures(texts: pa.Array, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """The rows with words and their ``int64`` signatures."""
    row, word, count = term_counts(*word_hashes(texts))
    if not len(row):
        return row, np.zeros((0, samples), dtype=np.int64)
    pair = mix64(word) ^ mix64(count.astype(np.uint64))
    _, first, at = np.unique(pair, return_index=True, return_inverse=True)
    words, weights = word[first], count[first].astype(np.float64)
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    out = np.empty((len(starts), samples), dtype=np.int64)
    for k in range(samples):
        least = np.minimum.reduceat(draws(words, weights, k)[at], starts)
        out[:, k] = mix64(least.view(np.uint64)).view(np.int64)
    return row[starts], out


def _signer(samples: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, stop in slices(texts, SLICE):
                rows, signs = signatures(texts.slice(start, stop - start), samples)
                sizes = np.zeros(stop - start + 1, dtype=np.int32)
                sizes[rows + 1] = samples
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(signs.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), lists], ["doc_id", "signature"])

    return sign


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, signature)`` of every row."""
    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return slim.mapInArrow(_signer(samples), "doc_id long, signature array<long>")


def similarity(a: str, b: str) -> F.Column:
    """The estimated generalised Jaccard similarity of two signature columns; null where one is empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / F.size(a))
