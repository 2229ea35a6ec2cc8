"""Exact top-k search: the nearest others of every query by Euclidean distance.

Queries are the rows whose id is divisible by ``every``; they are held against
all rows.

Bounds.  Cut into segments, two vectors' squared distance lies between
``sum(length * ((m1 - m2)^2 + (s1 - s2)^2))`` and the same with ``s1 + s2``, over
the segments' means ``m`` and deviations ``s``.  The bounds get closer from one
to four to sixteen segments.  They are used coarse to fine, twice:

1. *Cells.*  Rows go to the nearest of at most ``PIVOTS`` sampled rows, which
   only decides what lies together.  Each cell has a box, the least and
   greatest of each mean and deviation, and a radius around its pivot.  From
   these alone come a least distance of any two cells and, since a cell of
   more than ``k`` rows lies wholly within its greatest distance, a bound on
   every query's k-th distance.  Cells beyond that bound of the queries' cell
   are never sent.
2. *Rows.*  A pair is dropped as soon as a bound passes the query's k-th best
   distance so far; a level that drops little is left out for some blocks.
   Survivors get their distance: where they are many, all of the block by one
   matrix product, and those within its rounding error exactly.

Plan.  Rows are packed into blocks where they are read.  A tile is a part of
the queries with a slice of at most ``TILE`` bytes of blocks; a query's best of
all tiles are merged.  Bytes sent are ``queries / PART`` times the table, less
what cells save; rows without any clusters (as random directions are) save
nothing, so all pairs are then computed, each block by one product.

Cases: null vectors and vectors with null or non-finite elements, empty ones
and rows with a null id are ignored; of rows of one id the least vector counts;
vectors are compared with those of their own length; a query with fewer than
``k`` others has all; ties go to the lesser id; other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import cut

K, EVERY = 10, 20
#: Rows of a block, queries of a part (up to twice as many), bytes of blocks in a tile.
ROWS, PART, TILE = 4096, 8192, 48 << 20
#: Sampled rows around which cells form, at most, and the queries of a cell that are worth one more.
PIVOTS, WORTH = 1024, 4096
LEVELS = (1, 4, 16)
_BLOCKS = "dim int, cell int, ask boolean, n int, ids binary, data binary, low array<double>, high array<double>, radius double"
_TILES = "dim int, cell int, part int, slice int, last boolean, ids binary, data binary, bound double"


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations, by turns, whose plain squared distance is the lower bound."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        out += [x[:, a:b].mean(axis=1) * np.sqrt(b - a), x[:, a:b].std(axis=1) * np.sqrt(b - a)]
    return np.column_stack(out)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b.T
    out *= -2
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)[None, :]
    return out


class Best:
    """The best ``k`` of each query of a part."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, bound: float = np.inf) -> None:
        self.ids, self.x, self.k = ids, x, k
        # a level has to be much smaller than the vectors to be cheaper than they are
        self.levels = {s: summaries(x, s) for s in LEVELS if 4 * s <= x.shape[1]}
        self.rest = dict.fromkeys(self.levels, 0)
        self.far = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.bound, self.size = bound, float((x**2).sum(axis=1).max(initial=0))

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        slack = 1e-9 * (1 + self.size + float((x**2).sum(axis=1).max()))
        levels = {s: summaries(x, s) for s in self.levels if not self.rest[s]}
        kept, tried = dict.fromkeys(levels, 0.0), 0
        for start in range(0, len(self.ids), 512):
            part = slice(start, min(start + 512, len(self.ids)))
            limit = np.minimum(self.far[part, -1], self.bound) + slack
            keep = None
            for s, own in levels.items():
                near = _squares(self.levels[s][part], own) <= limit[:, None]
                keep = near if keep is None else keep & near
                kept[s] += keep.mean()
                if not keep.any():
                    break
            tried += 1
            if keep is None or keep.mean() > 0.05:
                rough = _squares(self.x[part], x)
                if keep is not None:
                    rough[~keep] = np.inf
                if len(ids) > self.k + 1:  # one of them may be the query itself
                    limit = np.minimum(limit, np.partition(rough, self.k, axis=1)[:, self.k] + slack)
                q, c = np.nonzero(rough <= limit[:, None])
            else:
                q, c = np.nonzero(keep)
            q += start
            other = self.ids[q] != ids[c]
            q, c = q[other], c[other]
            for a in range(0, len(q), 1 << 15):
                self._take(q[a : a + (1 << 15)], c[a : a + (1 << 15)], ids, x)
        for s in self.rest:
            self.rest[s] = max(0, self.rest[s] - 1) if s not in kept else 8 if kept[s] > 0.5 * tried else 0

    def _take(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        far = ((self.x[q] - x[c]) ** 2).sum(axis=1)
        near = far <= self.far[q, -1]
        q, far, who = q[near], far[near], ids[c[near]]
        own = np.unique(q)
        q = np.concatenate([q, np.repeat(own, self.k)])
        far, who = np.concatenate([far, self.far[own].ravel()]), np.concatenate([who, self.who[own].ravel()])
        order = np.lexsort((who, far, q))
        starts = np.searchsorted(q[order], own)
        pick = order[starts[:, None] + np.arange(self.k)[None, :]]
        self.far[own], self.who[own] = far[pick], who[pick]

    def rows(self) -> pa.RecordBatch:
        q, r = np.nonzero(np.isfinite(self.far))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.who[q, r]), pa.array(self.far[q, r])], ["vec_id", "near_id", "d"])


def _matrices(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, vectors)`` of each length of vector in a batch of non-null ids and vectors."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    dims = lists.value_lengths().to_numpy()
    for dim in np.unique(dims):
        own = np.flatnonzero(dims == dim)
        yield ids[own], lists.take(pa.array(own)).flatten().to_numpy().astype(kind).reshape(len(own), dim)


def _packer(pivots: dict[int, np.ndarray], every: int, rows: int, kind: np.dtype):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, float]]] = {}
        count: dict[tuple[int, int], int] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            parts = held.pop(key)
            del count[key]
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            stats = np.column_stack([summaries(x.astype(np.float64), s) for s in LEVELS])
            asks, radius = np.flatnonzero(ids % every == 0), max(p[2] for p in parts)
            out = [(key[0], key[1], False, len(ids), ids.tobytes(), x.tobytes(), stats.min(axis=0), stats.max(axis=0), radius)]
            if len(asks):
                out.append((key[0], key[1], True, len(asks), ids[asks].tobytes(), x[asks].tobytes(), stats[asks].min(axis=0), stats[asks].max(axis=0), radius))
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            for ids, x in _matrices(batch, kind):
                dim = x.shape[1]
                cells, away = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), np.inf)
                if dim in pivots:
                    exact = x.astype(np.float64)
                    cells = _squares(exact, pivots[dim]).argmin(axis=1)
                    away = np.sqrt(((exact - pivots[dim][cells]) ** 2).sum(axis=1))
                order = np.argsort(cells, kind="stable")
                edges = np.flatnonzero(np.diff(cells[order], prepend=-1))
                for a, b in zip(edges, np.append(edges[1:], len(order))):
                    key = (dim, int(cells[order[a]]))
                    for at in range(a, b, rows):
                        own = order[at : min(at + rows, b)]
                        held.setdefault(key, []).append((ids[own], x[own], float(away[own].max())))
                        count[key] = count.get(key, 0) + len(own)
                        if count[key] >= rows:
                            yield block(key)
        for key in list(held):
            yield block(key)

    return pack


def _clean(vectors: DataFrame, id_col: str, vector_col: str, element: str) -> DataFrame:
    """``(id, v)``: one valid vector of each id."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    v = v.where("id is not null and v is not null and size(v) > 0").where(fine)
    twice = cut(v.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if twice.isEmpty():  # so the vectors of tables without repeated ids aren't shuffled
        return v
    return v.join(twice, "id", "left_anti").unionByName(v.join(twice, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def _pivots(v: DataFrame, every: int, limit: int, worth: int) -> dict[int, np.ndarray]:
    """For each length of vector with queries for two cells or more, about one sampled row for ``worth`` queries, ``limit`` at most."""
    sizes = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asks")).collect()
    out = {}
    for r in sizes:
        count = min(limit, max(1, (1 << 24) // (8 * r.dim)), r.asks // worth)
        if count > 1:
            share = min(1.0, 1.5 * count / r.n)
            low = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))
            got = v.where((F.size("v") == r.dim) & low).limit(2 * count).collect()
            if len(got) > 1:
                out[r.dim] = np.unique(np.array([list(x.v) for x in got], dtype=np.float64), axis=0)
    return out


def _gaps(dim: int, low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one box and many others the least and greatest squared distance, by the best level."""
    at, least, most = 0, None, None
    for s in LEVELS:
        width = 2 * min(s, dim)
        own = slice(at, at + width)
        apart = np.maximum(0, np.maximum(other_low[:, own] - high[own], low[own] - other_high[:, own]))
        reach = np.maximum(np.abs(other_high[:, own] - low[own]), np.abs(high[own] - other_low[:, own]))
        reach[:, 1::2] = other_high[:, own][:, 1::2] + high[own][1::2]
        a, b = (apart**2).sum(axis=1), (reach**2).sum(axis=1)
        least, most = (a, b) if least is None else (np.maximum(least, a), np.minimum(most, b))
        at += width
    return least, most


def _meetings(blocks: DataFrame, pivots: dict[int, np.ndarray], k: int) -> tuple[dict[tuple[int, int], list[int]], dict[tuple[int, int], tuple[int, float]]]:
    """Of each cell the cells whose queries need it; of each cell of queries their number and a bound on their k-th squared distance.

    What is collected is a box for each cell, of which there are ``PIVOTS`` at
    most for a length of vector.
    """
    sides = blocks.select("dim", "cell", "ask", "n", "radius", F.posexplode(F.arrays_zip("low", "high")))
    boxes = sides.groupBy("dim", "cell", "ask", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"), F.sum("n").alias("n"), F.max("radius").alias("radius"))
    rows = boxes.groupBy("dim", "cell", "ask").agg(F.min("n").alias("n"), F.min("radius").alias("radius"), F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("box")).collect()
    needs: dict[tuple[int, int], list[int]] = {}
    bounds = {}
    for dim in {r.dim for r in rows}:
        data, asks = ([r for r in rows if r.dim == dim and r.ask == flag] for flag in (False, True))
        low, high = (np.array([[b[e] for b in r.box] for r in data]) for e in ("low", "high"))
        full, radius = np.array([r.n > k for r in data]), np.array([r.radius for r in data])
        slack = 1e-9 * (1 + float((np.maximum(np.abs(low), np.abs(high)) ** 2).sum(axis=1).max()))
        for r in asks:
            least, most = _gaps(dim, np.array([b.low for b in r.box]), np.array([b.high for b in r.box]), low, high)
            if dim in pivots:
                apart = np.sqrt(((pivots[dim][[d.cell for d in data]] - pivots[dim][r.cell]) ** 2).sum(axis=1))
                least = np.maximum(least, np.maximum(0, apart - radius - r.radius) ** 2)
                most = np.minimum(most, (apart + radius + r.radius) ** 2)
            bound = float(most[full].min()) if full.any() else float("inf")
            bounds[dim, r.cell] = r.n, bound * (1 + 1e-9)
            for at in np.flatnonzero(least <= bound * (1 + 1e-6) + slack):
                needs.setdefault((dim, data[at].cell), []).append(r.cell)
    return needs, bounds


def _searcher(k: int, kind: np.dtype):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, asks = None, None, []
        for batch in batches:
            for n in range(batch.num_rows):
                dim, cell, part, piece, last, ids, data, bound = (batch.column(c)[n].as_py() for c in range(8))
                ids = np.frombuffer(ids, dtype=np.int64)
                x = np.frombuffer(data, dtype=kind).reshape(len(ids), dim).astype(np.float64)
                if (dim, cell, part, piece) != now:
                    if best is not None:
                        yield best.rows()
                    now, best, asks = (dim, cell, part, piece), None, []
                if not last:
                    asks.append((ids, x))
                    continue
                if best is None:
                    if not asks:  # no block of queries fell to this part
                        continue
                    best = Best(np.concatenate([a for a, _ in asks]), np.concatenate([b for _, b in asks]), k, bound)
                best.meet(ids, x)
        if best is not None:
            yield best.rows()

    return search


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
    rows: int = ROWS, part: int = PART, tile: int = TILE, pivots: int = PIVOTS, worth: int = WORTH,
) -> DataFrame:
    """``(vec_id, rank, near_id, distance)``: the ``k`` nearest others of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType
    single = isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType)
    kind = np.dtype(np.float32 if single else np.float64)
    v = _clean(vectors, id_col, vector_col, "float" if single else "double")
    centres = _pivots(v, every, pivots, worth)
    blocks = cut(v.mapInArrow(_packer(centres, every, rows, kind), _BLOCKS))
    needs, bounds = _meetings(blocks, centres, k)

    parts = {key: max(1, round(n / part)) for key, (n, _) in bounds.items()}
    size = blocks.where("not ask").agg(F.sum(F.length("data")).alias("bytes"), F.count("*").alias("n")).first()
    many = max(1, sum(parts.values()))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-(size.bytes or 0) // tile), min(size.n, -(-3 * wide // many)))

    pair = "dim int, cell int"
    links = [(d, c, [(q, p) for q in own for p in range(parts[d, q])]) for (d, c), own in needs.items()]
    links = F.broadcast(spark.createDataFrame(links, f"{pair}, asks array<struct<cell: int, part: int>>"))
    limits = F.broadcast(spark.createDataFrame([(d, c, parts[d, c], bound) for (d, c), (_, bound) in bounds.items()], f"{pair}, parts int, bound double"))
    piece = F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int").alias("slice")
    sent = blocks.where("not ask").join(links, ["dim", "cell"]).select("dim", piece, "ids", "data", F.explode("asks").alias("to"))
    sent = sent.select("dim", F.col("to.cell").alias("cell"), F.col("to.part").alias("part"), "slice", F.lit(True).alias("last"), "ids", "data").join(limits, ["dim", "cell"])
    own = blocks.where("ask").join(limits, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("ids"), "parts").cast("int"))
    own = own.select("dim", "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(False).alias("last"), "ids", "data", "bound")
    names = [c.split()[0] for c in _TILES.split(", ")]
    key = ["dim", "cell", "part", "slice"]
    tiles = own.select(names).unionByName(sent.select(names)).repartition(many * slices, *key)
    found = tiles.sortWithinPartitions(*key, "last").mapInArrow(_searcher(k, kind), "vec_id long, near_id long, d double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "near_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "near_id", F.round(F.sqrt("d"), 6).alias("distance"))


def oracle_sql(k: int = K, every: int = EVERY) -> str:
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (
 SELECT a.vec_id, b.vec_id AS near_id, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d
 FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.vec_id % {every} = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, near_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, near_id, round(sqrt(d), 6) AS distance FROM r WHERE rank <= {k}"""
