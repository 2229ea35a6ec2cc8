"""Vectorised word hashing over Arrow string arrays.

Every text operator that only needs to know *which* words a text holds (not
their spelling) works on 64-bit word hashes.  They are computed for a whole
slice of texts with a dozen numpy passes over the UTF-8 bytes, so there is no
Python-level work per word.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
bytes of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_STEM = np.uint64(0x5BD1E9955BD1E995)
_WORD = np.zeros(256, dtype=bool)
for _c in range(256):
    _WORD[_c] = _c >= 128 or chr(_c).isalnum() or _c == 95

#: Texts are hashed in slices of about this many bytes, which bounds memory.
SLICE_BYTES = 1 << 19

_pow: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get("p")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES * 2)
        for key, base in (("p", _P), ("i", _PINV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            np.multiply.accumulate(steps, out=steps)
            _pow[key] = steps
    return _pow["p"][:n], _pow["i"]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges that hold about ``limit`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    row = 0
    while row < len(sizes):
        base = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield row, stop
        row = stop


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, starts, ends, offsets)`` of the lower-cased words.

    ``starts`` and ``ends`` index into ``bytes``; the words of row ``i`` are
    numbers ``offsets[i]`` to ``offsets[i + 1]``.  Nulls count as empty texts.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    joined = pc.binary_join_element_wise(low, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    _, offs, data = joined.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    if len(joined) == 0 or off[-1] == off[0]:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint8), none, none, np.zeros(len(joined) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    edge = np.diff(_WORD[raw].astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return raw, starts, ends, np.searchsorted(starts, off - off[0])


def word_hashes(texts: pa.Array, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each row's range of them.

    After each word come, for each number of ``stems``, its first so many bytes
    where it is longer; these hashes differ from those of words.
    """
    raw, starts, ends, offsets = word_spans(texts)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), offsets
    power, inverse = _powers(len(raw))
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    words = mix64((total[ends] - total[starts]) * inverse[starts])
    if not stems:
        return words, offsets
    hashes, there = np.empty((len(words), 1 + len(stems)), dtype=np.uint64), np.ones((len(words), 1 + len(stems)), dtype=bool)
    hashes[:, 0] = words
    for k, size in enumerate(stems, 1):
        there[:, k] = ends - starts > size
        stop = np.minimum(starts + size, ends)
        hashes[:, k] = mix64(((total[stop] - total[starts]) * inverse[starts]) ^ _STEM)
    kept = np.append(0, np.cumsum(there.ravel()))
    return hashes[there], kept[offsets * (1 + len(stems))]


def hash_word(word: str) -> int:
    """The same hash for a single word, one byte at a time (for tests)."""
    h, p = 0, 1
    for b in word.lower().encode():
        h = (h + (b + 1) * p) % (1 << 64)
        p = p * int(_P) % (1 << 64)
    return int(mix64(np.array([h], dtype=np.uint64))[0])


def row_numbers(offsets: np.ndarray) -> np.ndarray:
    """The row that each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def term_counts(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, count)`` of the distinct words of every row, sorted by row then hash."""
    rows = row_numbers(offsets)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    if not len(h):
        return r, h, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))))
    return r[first], h[first], np.diff(np.append(first, len(h)))
