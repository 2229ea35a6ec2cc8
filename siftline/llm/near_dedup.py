"""MinHash near-duplicates by a signature-coordinate inverted join.

Every text becomes ``coordinates`` MinHash values of its word trigrams.  Two
texts are near-duplicates when at least ``matches`` of the coordinates agree.

1. Texts with the same signature form a class; one text stands for it, so a
   page that was copied a million times is posted once.
2. Each class is posted under its ``(coordinate, value)`` pairs.  Values that
   occur once can't collide; they are counted, never joined.
3. *Prefix merging.* With the values ordered from rare to common, two
   signatures that agree in ``matches`` places share at least ``1 + overlap``
   values among each one's ``coordinates - matches + 1 + overlap`` rarest.
   Only those prefixes are merged, and collisions counted over them.
4. *Skip merging.* The long lists outside the prefixes are never merged: a
   pair that collides often enough in the prefixes has all its coordinates
   compared directly.
5. Exact treatment of hot lists.  First every posting is held only against the
   least text of its list, which is linear, and the components of the pairs so
   found are formed.  Then pairs within a list are tried only *across*
   components, in blocks of about ``BLOCK`` texts.  A group of n near copies so
   costs about n comparisons, not n^2, nothing is capped, and the components
   are those of all matching pairs.  n texts that share enough of their rare
   values without matching cost n^2 candidates; exactness leaves no less.

The result has each text but the least of its group, with its best partner.
Cases: null and wordless texts have no signature and no partners; texts of one
or two words are one shingle; rows with a null id are ignored; repeated rows
count once, and rows of one id are never each other's partners; other columns
of the input, whatever their names, are ignored; texts of any length are used
whole; an empty table gives no rows.  Which rows ``without_near_copies`` keeps
where ids are repeated is said there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, fresh
from siftline.llm.components import components
from siftline.llm.wordhash import mix64, slices, word_hashes

COORDINATES = 64
MATCHES = 32
SHINGLE = 3
#: Collisions beyond the first that two prefixes must have (each lengthens the prefixes by one).
OVERLAP = 3
#: Texts of one component in a block, about.
BLOCK = 256


def _seeds(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    raw = mix64(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    half = (raw >> np.uint64(32)).astype(np.uint32)
    return half[:coordinates] | np.uint32(1), half[coordinates:]


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word ``size``-grams, with the row and first index of each row that has any.

    A row of fewer words is one shingle of all of them.
    """
    lens = np.diff(offsets)
    rows = np.flatnonzero(lens)
    lens, starts = lens[rows], offsets[:-1][rows]
    number = np.maximum(lens - size + 1, 1)
    first = np.cumsum(number) - number
    at = np.arange(number.sum()) + np.repeat(starts - first, number)
    stop = np.repeat(starts + lens, number)
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.append(hashes, np.zeros(size, dtype=np.uint64))
    for k in range(size):
        word = padded[at + k]
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(at + k < stop, word, np.uint64(k + 1))
    return mix64(out), rows, first


def signatures(texts: pa.Array, coordinates: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a word, and their signatures as ``uint32``."""
    scale, shift = _seeds(coordinates)
    hashes, offsets = word_hashes(texts)
    shingles, rows, first = shingle_hashes(hashes, offsets, size)
    signs = np.empty((len(rows), coordinates), dtype=np.uint32)
    if len(rows):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for k in range(coordinates):
            y = (x ^ shift[k]) * scale[k]
            y ^= y >> np.uint32(15)
            signs[:, k] = np.minimum.reduceat(y, first)
    return rows, signs


def _signer(coordinates: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, stop in slices(texts):
                rows, signs = signatures(texts.slice(start, stop - start), coordinates, size)
                flat = pa.array(signs.view(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * coordinates), flat)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows + start)), lists], ["id", "sign"])

    return sign


def _agreeing(a: str, b: str) -> F.Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def _verified(pairs: DataFrame, signs: DataFrame, matches: int) -> DataFrame:
    """Those ``(a, b)`` of which at least ``matches`` coordinates agree."""
    left, right = (signs.select(F.col("id").alias(k), F.col("sign").alias(f"sign_{k}")) for k in "ab")
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", _agreeing("sign_a", "sign_b").alias("matches"))
        .where(F.col("matches") >= matches)
    )


def prefixes(signs: DataFrame, coordinates: int, matches: int, overlap: int) -> DataFrame:
    """``(token, id)`` of the colliding values in each signature's prefix."""
    tokens = signs.select("id", F.posexplode("sign")).select(
        "id", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token")
    )
    common = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    lists = tokens.join(common, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("values"))
    # of `coordinates` values, those that occur once come first in the order
    length = F.greatest(F.lit(0), F.size("values") - (matches - 1 - overlap))
    enough = lists.where(F.size("values") >= matches)
    return enough.select("id", F.explode(F.slice("values", F.lit(1), F.least(length, F.size("values")))).alias("v")).select("v.token", "id")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    shingle: int = SHINGLE,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``(doc_id, near_id, matches, group_id)``: a row for each text that is not the least of its group.

    ``group_id`` is the least id of the group, ``near_id`` a text of the group
    that agrees with ``doc_id`` in ``matches`` coordinates.  Two texts have the
    same group exactly when matching pairs connect them.
    """
    overlap = max(0, min(overlap, matches - 1))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where("id is not null and text is not null")
    signed = cut(texts.mapInArrow(_signer(coordinates, shingle), "id long, sign array<int>"))
    classes = signed.groupBy("sign").agg(F.min("id").alias("rep"))
    signs = cut(classes.select(F.col("rep").alias("id"), "sign").groupBy("id", "sign").agg(F.lit(1).alias("one")).drop("one"))
    posted = cut(prefixes(signs, coordinates, matches, overlap).distinct())

    # 1: against the least text of each list
    least = posted.groupBy("token").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = (
        posted.join(least, "token").where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("hits"))
        .where(F.col("hits") > overlap).select("a", "b")
    )
    first = cut(_verified(stars, signs, matches))
    roots = components(first, "a", "b")

    # 2: across the components found so far
    labelled = posted.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "token", "id", F.coalesce("root", "id").alias("root")
    )
    spans = labelled.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    mixed = labelled.join(spans, "token")
    sizes = mixed.groupBy("token", "root").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    blocks = mixed.join(sizes, ["token", "root"]).groupBy("token", "root", part).agg(F.collect_list("id").alias("ids"))
    left, right = (blocks.select("token", F.col("root").alias(f"root_{k}"), F.col("ids").alias(f"ids_{k}")) for k in "ab")
    across = (
        left.join(right, "token").where("root_a < root_b").select(F.explode("ids_a").alias("x"), "ids_b")
        .select("x", F.explode("ids_b").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .groupBy("a", "b").agg(F.count("*").alias("hits")).where(F.col("hits") > overlap).select("a", "b")
    )
    pairs = cut(first.unionByName(_verified(across, signs, matches)).where("a <> b").groupBy("a", "b").agg(F.max("matches").alias("matches")))
    copies = (
        signed.join(classes, "sign").where("id <> rep")
        .select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(coordinates).alias("matches")).distinct()
    )
    linked = cut(pairs.unionByName(copies))
    roots = components(linked, "a", "b")
    # a text may only have partners of larger ids and yet not be its group's least
    ways = linked.select(F.col("b").alias("node"), F.col("a").alias("near"), "matches").unionByName(linked.select(F.col("a").alias("node"), F.col("b").alias("near"), "matches"))
    best = ways.groupBy("node").agg(F.min(F.struct((-F.col("matches")).alias("m"), "near")).alias("best"))
    return best.join(roots, "node").select(
        F.col("node").alias("doc_id"), F.col("best.near").alias("near_id"), (-F.col("best.m")).cast("int").alias("matches"), F.col("root").alias("group_id")
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``docs`` with one text, that of the least id, of each group of near-duplicates.

    All columns stay.  Rows with a null id, null or wordless texts and texts
    without partners stay.  Different texts of one id are texts of their own:
    one has the id's place in the order of ids, the others come after all ids;
    of rows with one id and the same text that with the least JSON stays.
    """
    repeated = cut(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("twice")).agg(F.count("*").alias("n")).where("n > 1").select("twice"))
    if repeated.isEmpty():
        gone = near_groups(docs, id_col, text_col, **how).select(F.col("doc_id").alias("gone"))
        return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
    key, text = fresh(docs, "key_of_row"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns, ids = [F.col(f"`{c}`") for c in docs.columns], F.col(id_col).cast("long")
    same = F.sha2(F.concat(F.when(F.col(text_col).isNull(), "n").otherwise("t"), text), 256)
    twins = docs.join(repeated, docs[id_col] == repeated["twice"], "left_semi")
    once = cut(twins.select(ids.alias("id"), same.alias("hash"), F.struct(*columns).alias("row")).groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row")))
    # keys above all ids for the further texts of repeated ones, fixed by being written
    first = once.groupBy("id").agg(F.min("hash").alias("first"))
    most = docs.agg(F.max(ids)).first()[0]
    own = F.when(F.col("hash") == F.col("first"), F.col("id")).otherwise(F.lit(most + 1) + F.monotonically_increasing_id())
    once = cut(once.join(first, "id").select("row", own.alias("key"))).select("row.*", F.col("key").alias(key))
    every = docs.join(repeated, docs[id_col] == repeated["twice"], "left_anti").withColumn(key, ids).unionByName(once)
    gone = near_groups(every, key, text_col, **how).select(F.col("doc_id").alias("gone"))
    return every.join(gone, every[key] == gone["gone"], "left_anti").drop(key)
