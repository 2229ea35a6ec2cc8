"""Token counts of byte-level BPE, with huge documents encoded in overlapping chunks.

A text of at most ``chunk`` characters is encoded at once.  A longer one is
encoded in chunks that overlap, with the byte offset of each token.  Two
neighbours are spliced at the last *stable common boundary* of their overlap:
a place where a token ends in both encodings and where the pre-tokeniser must
split whatever surrounds it.

Proof of stability.  No alternative of the pattern matches a letter followed
by an ASCII character that isn't a letter (a letter ends every alternative
that has one, or is followed by more letters), so such a place always ends a
pre-token; byte pairs merge within pre-tokens only.  The left chunk starts at
a true boundary and holds the character after the splice, so its tokens up to
the splice are those of the whole text; the right chunk holds the letter
before it, so its tokens after the splice are too, until its own last splice.

When an overlap has no such place it is doubled; when it would cover the left
chunk, the left chunk is doubled instead, in the worst case to the whole text.

Cases: a null text has a null count, an empty one 0; strings that look like
special tokens are ordinary text; repeated rows have a row each; a null id
stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1 << 15, 128
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A letter that every version of Unicode calls one, then an ASCII character that is none.
STABLE = re.compile("[A-Za-zÀ-ÖØ-öø-ʯα-ωА-я一-龥ぁ-ゖァ-ヺ가-힣](?=[\x00-@\\[-`{-\x7f])")

_loaded: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, k in ranks.items():
            self.sizes[k] = len(piece)

    def tokens(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def chunked(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """The tokens of ``text``, spliced from overlapping chunks."""
        out: list[int] = []
        start, size = 0, chunk
        while start + size < len(text):
            end = start + size
            left = self.tokens(text[start:end])
            ends = np.cumsum(self.sizes[left])
            width, splice = min(overlap, size // 2), 0
            while not splice and width < size:
                begin = end - width
                right = self.tokens(text[begin:end])
                splice = self._boundary(text, start, begin, end, ends, np.cumsum(self.sizes[right]))
                width *= 2
            if not splice:
                size *= 2
                continue
            upto = len(text[start:splice].encode(errors="surrogatepass"))
            out += left[: int(np.searchsorted(ends, upto)) + 1]
            start, size = splice, chunk
        return out + self.tokens(text[start:])

    @staticmethod
    def _boundary(text: str, start: int, begin: int, end: int, left: np.ndarray, right: np.ndarray) -> int:
        """The last stable place in ``(begin, end)`` where a token ends in both encodings; 0 for none."""
        places = [m.end() for m in STABLE.finditer(text, begin, end)]
        head = len(text[start:begin].encode(errors="surrogatepass"))
        for place in reversed(places):
            at = len(text[begin:place].encode(errors="surrogatepass"))
            for ends, upto in ((left, head + at), (right, at)):
                k = int(np.searchsorted(ends, upto))
                if k == len(ends) or ends[k] != upto:
                    break
            else:
                return place
        return 0

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        return len(self.tokens(text) if len(text) <= chunk else self.chunked(text, chunk, overlap))


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of the vocabulary at ``path``, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            values = (t.as_py() for t in batch.column(1))
            sizes = [None if t is None else bpe.count(t, chunk, overlap) for t in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(count, "doc_id long, n_tokens long")
