"""SentencePiece (merge type) encoding by backtracking, and decoding.

Merge-type encoding joins the best-scored adjacent pair until none is left.
Its result is the one segmentation in which every two neighbours are
*compatible*: joining the characters of both, by the same rules, gives back
just these two pieces.  So instead of merging, an Aho-Corasick automaton finds
the pieces at each place; the longest is tried first, a piece is accepted if it
is compatible with its left neighbour (decided by re-merging, remembered by
pair), and where nothing fits the last piece is taken back for a shorter one.
A bit field marks the places from which no segmentation exists, so each is
given up once.

No piece holds a space mark after another character (checked on loading), so
texts fall apart before each run of spaces that follows another character.
Characters without a piece become their bytes' pieces and part what is around
them.

A slice of texts is parted with Arrow, each distinct part is encoded once, all
of them in lockstep by numpy (``lockstep``; parts longer than ``LONG``
characters one by one, by the same steps), and the texts' pieces are gathered.
Decoding gathers the bytes of the pieces.

Cases: a null text has null pieces and a null check; an empty text has none;
texts of any length are encoded whole; repeated rows have a row each; a null
id stays null; other columns are ignored unless they are to be kept; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.lockstep import Lockstep
from siftline.llm.wordhash import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Pairs that the one-by-one way remembers, at most; then they are forgotten and found again.
REMEMBERED = 100_000
#: Characters of the longest part that is encoded in lockstep with others.
LONG = 96
#: Bytes of text in a slice; the larger, the more parts are met again.
SLICE = 4 << 20
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

_loaded: dict[str, Pieces] = {}


class Pieces:
    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("not a merge-type model that leaves texts as they are")
        self.prefix = spec.add_dummy_prefix
        self.score, self.id, self.bytes = {}, {}, {}
        self.text: list[bytes] = []
        for k, p in enumerate(model.pieces):
            self.text.append(p.piece.replace(SPACE, " ").encode())
            if p.type == p.NORMAL:
                self.id[p.piece], self.score[p.piece] = k, p.score
            elif p.type == p.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = k
                self.text[k] = bytes([int(p.piece[3:5], 16)])
            elif p.type == p.USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
            elif p.type == p.CONTROL:
                self.text[k] = b""
            else:
                self.text[k], self.unknown = " ⁇ ".encode(), k
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece goes on over a space")
        self.found = ahocorasick.Automaton()
        for p in self.id:
            self.found.add_word(p, p)
        self.found.make_automaton()
        self.fit: dict[tuple[str, str], bool] = {}
        self.own = np.array(list(self.id.values()), dtype=np.int32)
        self.lockstep = Lockstep(list(self.id), [self.score[p] for p in self.id])
        self.raw = pa.array(self.text, pa.large_binary())
        self.lens = np.array([len(t) for t in self.text], dtype=np.int64)
        self.byte = np.array([self.bytes.get(b, -1) for b in range(256)], dtype=np.int32)

    def merged(self, text: str) -> list[str]:
        """The rules as they are defined: join the best pair, the leftmost of equals, until none is left."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        got = self.fit.get((a, b))
        if got is None:
            if len(self.fit) >= REMEMBERED:
                self.fit.clear()
            got = self.fit[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def _backtrack(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters have one."""
        at: list[list[str]] = [[] for _ in text]
        for end, piece in self.found.iter(text):
            at[end + 1 - len(piece)].append(piece)  # the longest comes last
        failed = 0
        out: list[str] = []
        tried = [len(at[0])]
        place = 0
        while place < len(text):
            last, k, options = out[-1] if out else "", tried[-1] - 1, at[place]
            while k >= 0:
                piece = options[k]
                if not failed >> (place + len(piece)) & 1 and self.compatible(last, piece):
                    break
                k -= 1
            if k >= 0:
                tried[-1] = k
                out.append(piece)
                place += len(piece)
                if place < len(text):
                    tried.append(len(at[place]))
            else:
                failed |= 1 << place
                tried.pop()
                place -= len(out.pop())
        return out

    def _part(self, part: str) -> list[int]:
        ids, run = [], []
        for c in [*part, ""]:
            if c in self.id:
                run.append(c)
                continue
            if run:
                ids += [self.id[p] for p in self._backtrack("".join(run))]
                run = []
            if c:
                ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
        return ids

    def encode(self, text: str) -> array:
        out = array("i")
        if text:
            for part in _PARTS.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE)):
                out.extend(self._part(part))
        return out

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(flat, starts, counts)``: the ids of each part, which hold plain spaces for marks."""
        sizes = pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        short, long = np.flatnonzero(sizes <= LONG), np.flatnonzero(sizes > LONG)
        starts, counts = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        flat = np.zeros(0, dtype=np.int32)
        if len(short):
            data = "".join(parts.take(pa.array(short)).to_pylist()).replace(" ", SPACE)
            codes = np.frombuffer(data.encode("utf-32-le"), dtype=np.uint32)
            begins = np.cumsum(sizes[short]) - sizes[short]
            found = self.lockstep.tokens(codes, begins)
            lone = (self.lockstep.classes[codes] == 0).astype(np.int64)
            if self.bytes:
                lone *= 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            each = np.where(found >= 0, 1, lone)
            ends = np.cumsum(each)
            flat = np.empty(int(ends[-1]), dtype=np.int32)
            hit = found >= 0
            flat[ends[hit] - 1] = self.own[found[hit]]
            for k in np.flatnonzero(lone):
                raw = chr(codes[k]).encode()
                flat[ends[k] - each[k] : ends[k]] = [self.bytes[b] for b in raw] if self.bytes else self.unknown
            starts[short] = (ends - each)[begins]
            counts[short] = np.add.reduceat(each, begins)
        tail = [flat]
        at = len(flat)
        for k in long:
            ids = np.array(self._part(parts[k].as_py().replace(" ", SPACE)), dtype=np.int32)
            starts[k], counts[k] = at, len(ids)
            at += len(ids)
            tail.append(ids)
        return np.concatenate(tail), starts, counts

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(flat, offsets)``: the ids of all texts; null and empty ones have none."""
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = pc.replace_substring(plain, SPACE, " ")
        if self.prefix:
            lead = pc.if_else(pc.equal(pc.binary_length(marked), 0), "", " ").cast(pa.large_string())
            marked = pc.binary_join_element_wise(lead, marked, pa.scalar("", pa.large_string()))
        _, offs, data = marked.buffers()
        off = np.frombuffer(offs, dtype=np.int64)[marked.offset : marked.offset + len(marked) + 1]
        if len(marked) == 0 or off[-1] == off[0]:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[: off[-1]]
        space = raw == 32
        edge = space.copy()
        edge[1:] &= ~space[:-1]
        edge[off[:-1][off[:-1] < off[1:]]] = True
        edge[: off[0]] = False
        begins = np.flatnonzero(edge)
        bounds = np.append(begins, off[-1])
        parts = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), data)
        coded = parts.dictionary_encode()
        flat, starts, counts = self._distinct(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        each = counts[at]
        ends = np.cumsum(each)
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[at] - (ends - each), each)]
        return ids, np.append(0, ends)[np.searchsorted(begins, off)]

    def exact(self, texts: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether decoding the ids of each text gives it back; of nulls, whatever."""
        joined = self.raw.take(pa.array(ids))
        data = np.frombuffer(joined.buffers()[2] or b"", dtype=np.uint8)
        at = np.append(0, np.cumsum(self.lens[ids]))[offsets]
        plain = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, offs, raw = plain.buffers()
        off = np.frombuffer(offs, dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
        raw = np.frombuffer(raw or b"", dtype=np.uint8)
        out = np.zeros(len(plain), dtype=bool)
        for k in range(len(plain)):
            a, b = at[k], at[k + 1]
            if self.prefix and a < b and data[a] == 32:
                a += 1
            out[k] = np.array_equal(data[a:b], raw[off[k] : off[k + 1]])
        return out

    def decode(self, ids: array | list[int]) -> str:
        text = self.text
        raw = b"".join([text[k] for k in ids])
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


def pieces(path: str = MODEL) -> Pieces:
    """The model at ``path``, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, pieces, exact)`` of every row, with the columns ``keep`` after them; ``exact``: decoding gives the text back."""
    names = ["doc_id", "pieces", "exact", *keep]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("a column to keep has the name of a result")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            ids, texts, *rest = batch.columns
            for start, stop in slices(texts, SLICE):
                own = texts.slice(start, stop - start)
                flat, offsets = model.encode_all(own)
                null = own.is_null()
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=null)
                exact = pa.array(model.exact(own, flat, offsets), pa.bool_(), mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), lists, exact, *(c.slice(start, stop - start) for c in rest)], names)
            pa.default_memory_pool().release_unused()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType()), *[T.StructField(c, docs.schema[c].dataType) for c in keep]])
    return slim.mapInArrow(encode, schema)
