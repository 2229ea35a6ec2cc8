"""Postings and statistics of documents from their own rows: nothing is shuffled, and a task holds the tokens of few documents at a time.

The terms of a row are an expression; they are grouped by numpy in the Python workers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import Tokenize, tokens

#: Tokens that are grouped at once; more only where one document has more.
AT_ONCE = 1 << 20
#: Postings of a file of an index, about; which go to which file is guessed from about so many documents, of one of so many of their postings.
FILE, GUESS_DOCS, GUESS_OF = 1_000_000, 10_000, 64
_LAST = np.iinfo(np.int64).max


def _parts(lists: pa.ListArray, at_once: int) -> Iterator[tuple[int, pa.ListArray]]:
    """Runs of rows of about ``at_once`` values, with the first row's number."""
    at = lists.offsets.to_numpy()
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + at_once, "right")) - 1)
        yield start, lists.slice(start, stop - start)
        start = stop


def _grouped(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms in order; of each (term, row), ordered so, the term's number, the row and where it begins among the hits; the hits' positions from 1. Null terms are none."""
    at = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    row = np.repeat(np.arange(len(lists)), np.diff(at))
    pos = (np.arange(len(row)) - at[row] + 1).astype(np.int32)
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    held = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))
    key = rank[coded.indices.fill_null(0).to_numpy()[held]] << 32 | held if len(held) else held.astype(np.int64)
    key.sort()
    term, hit = key >> 32, key & 0xFFFFFFFF
    row, pos = row[hit], pos[hit]
    begins = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])]) if len(key) else held
    return coded.dictionary.take(order), term[begins], row[begins], begins, pos


def keys(docs: DataFrame, tokenize: Tokenize = tokens) -> DataFrame:
    """``(term, doc_id)`` of the postings of documents of distinct ids."""

    at_once = AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lists in _parts(batch.column(1), at_once):
                terms, term, row, *_ = _grouped(lists)
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(term)), batch.column(0).take(pa.array(row + first))], ["term", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long"), tokenize(F.col("text")).alias("toks")).where("toks is not null")
    return rows.mapInArrow(run, "term string, doc_id long")


def bounds(docs: DataFrame, count: int, tokenize: Tokenize = tokens) -> list[tuple[bytes, int]]:
    """The first (term, document) of each file but the first of an index of ``count`` documents. Only the files' sizes depend on the guess, all documents are indexed."""
    share = min(1.0, GUESS_DOCS / max(count, 1))
    some = keys(docs if share == 1.0 else docs.sample(share, seed=1), tokenize).where(F.rand(1) < 1 / GUESS_OF)
    drawn = sorted((r.term.encode(), _LAST if r.doc_id is None else r.doc_id) for r in some.collect())
    files = min(round(len(drawn) * GUESS_OF / share / FILE), len(drawn))
    return [drawn[len(drawn) * k // files] for k in range(1, files)]


_POSTINGS = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("freq", pa.int32()), ("positions", pa.list_(pa.int32()))])


def _packed(rows: pa.RecordBatch) -> bytes:
    raw = rows.serialize()
    return raw.size.to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(piece: bytes) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.decompress(piece[8:], int.from_bytes(piece[:8], "little"), "zstd"), _POSTINGS)


def postings(docs: DataFrame, starts: list[tuple[bytes, int]], tokenize: Tokenize = tokens) -> DataFrame:
    """``(term, doc_id, freq, positions)`` as ``text.postings`` has them of the hits, of documents of distinct ids.

    In order of terms and documents, with a partition for each file that ``starts`` bound.  What a task has for a file of ``AT_ONCE`` tokens travels as one row.
    """

    at_once = AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            for first, lists in _parts(batch.column(1), at_once):
                terms, term, row, begins, pos = _grouped(lists)
                ids = batch.column(0).take(pa.array(row + first))
                cut = _cuts(terms, term, ids.fill_null(_LAST).to_numpy(), starts)
                ends = np.r_[begins, len(pos)].astype(np.int32)
                found = pa.RecordBatch.from_arrays([terms.take(pa.array(term)), ids, pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos))], schema=_POSTINGS)
                files = [k for k in range(len(cut) - 1) if cut[k] < cut[k + 1]]
                pieces = [_packed(found.slice(cut[k], cut[k + 1] - cut[k])) for k in files]
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(pieces, pa.binary())], ["file", "piece"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [_unpacked(p) for batch in batches for p in batch.column(0).to_pylist()]
        if pieces:
            found = pa.Table.from_batches(pieces).combine_chunks()
            coded = found["term"].combine_chunks().dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            order = np.lexsort((found["doc_id"].fill_null(_LAST).to_numpy(), rank[coded.indices.to_numpy()]))
            for k in range(0, len(order), 1 << 16):
                yield from found.take(pa.array(order[k : k + (1 << 16)])).combine_chunks().to_batches()

    rows = docs.select(F.col("doc_id").cast("long"), tokenize(F.col("text")).alias("toks")).where("toks is not null")
    sent = rows.mapInArrow(run, "file int, piece binary").repartitionById(len(starts) + 1, "file").select("piece")
    return sent.mapInArrow(gathered, "term string, doc_id long, freq int, positions array<int>")


def _cuts(terms: pa.Array, term: np.ndarray, ids: np.ndarray, starts: list[tuple[bytes, int]]) -> list[int]:
    """Where each file's postings begin, and their number. ``term`` and, within a term, ``ids`` rise."""
    at = np.searchsorted(term, np.arange(len(terms) + 1))  # where each term's postings begin
    cut = [0]
    for t, d in starts:
        n = bisect_left(terms, t, key=lambda x: x.as_py().encode())
        here = n < len(terms) and terms[n].as_py().encode() == t
        cut.append(int(at[n] + (np.searchsorted(ids[at[n] : at[n + 1]], d) if here else 0)))
    return [*cut, len(term)]


def worded(text: Column, tokenize: Tokenize = tokens) -> Column:
    """Whether a text has a term at all; that of ``tokens`` is seen at the first letter or digit."""
    found = F.lower(text).rlike(r"[\p{L}\p{N}]") if tokenize is tokens else F.exists(tokenize(text), lambda t: t.isNotNull())
    return F.coalesce(found, F.lit(False))


def doc_stats(docs: DataFrame, more: Column, tokenize: Tokenize = tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``text.doc_stats`` has of the hits and of ``more``, an array of terms without a position, of documents of distinct ids."""

    at_once = AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lists in _parts(batch.column(2), at_once):
                _, _, row, begins, pos = _grouped(lists)
                freq, size = np.diff(np.r_[begins, len(pos)]), len(lists)
                most = np.zeros(size, np.int64)
                np.maximum.at(most, row, freq)
                placed = pos <= batch.column(1).slice(first, size).to_numpy()[np.repeat(row, freq)]
                sums = [np.bincount(row, minlength=size), most, np.bincount(row, freq, size), np.bincount(np.repeat(row, freq), placed, size), np.zeros(size)]
                kept = pa.array(sums[0] > 0)
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in (batch.column(0).slice(first, size), *(pa.array(s.astype(np.int64)) for s in sums))], names)

    names = ["doc_id", "terms", "max_freq", "hits", "positional_hits", "overlaps"]
    toks = F.coalesce(tokenize(F.col(text_col)), F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), toks.alias("toks"), more.alias("more"))
    rows = rows.select("doc_id", F.size("toks").alias("n"), F.concat("toks", "more").alias("toks"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join(f"{c} {kind if c == 'doc_id' else 'long'}" for c in names))
