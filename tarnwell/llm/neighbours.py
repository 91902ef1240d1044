"""Problem 2: the most similar vectors of every vector, and all pairs above a cosine.

Block matrix join. Vectors are brought to length 1 and coded in 8 bits with a scale of their own.
The collection is divided into cells around centroids fitted on a bounded sample; every vector of
the base lies in one cell and every searching vector visits cells near to it. A tile is a
block of a cell's base rows against a block of its visitors: one product of integer codes gives all
cosines of the tile together with a proven bound of their quantisation error, so a pair is dropped
only where even the bound cannot bring it to the threshold (or into the best k of its tile).
The pairs that survive are recomputed in floating point; each tile selects its best k, and the tiles'
selections are merged by rank.

Cells and tiles keep the work close to linear: the number of cells grows with the data and a cell's
share of rows is cut into blocks of fixed size, base and visitors alike, so a dense region becomes
many tiles and no task sees more than one. Exact copies are represented by one vector and expanded
when the result is written.

Pairs above a threshold are all found. Vectors of two cells are parted by the plane half way between
the centroids, so one that lies farther from that plane than the threshold's distance has no partner
behind it, and it visits just the cells whose plane is nearer (:meth:`Cells.reached`). The best k of
a vector may lie anywhere; there the number of cells visited follows from a recall asked for, measured
on a sample (:func:`visits_for`), and ``exact`` compares all blocks with all instead.

Cases: null vectors, vectors of another dimension, with null, NaN or infinite values or only zeros
are not usable and take no part; equal cosines are ordered by id; of repeated rows of an id one
counts; rows without id are left out; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import materialize

#: Vectors per cell aimed at, the greatest number of cells, and rows of the sample that fits them, per cell and in all.
CELL_ROWS = 256
MOST_CELLS = 16_384
SAMPLE_PER_CELL = 24
SAMPLE_ROWS = 98_304
#: Centroids of this cosine are one: between cells so alike the visits would be spent without reaching others.
SAME_CELL = 0.9999
#: Rows of a tile's two sides.
BASE_BLOCK = 2048
VISITOR_BLOCK = 8192
#: Share of the best k that the cells visited must hold, and searching vectors on which that is measured.
RECALL = 0.95
MEASURED = 512
#: Rounding that distances to planes between centroids may carry (the closest centroids are 0.014 apart).
SLACK = 2e-4
#: Cosines that agree to this many places are ties.
TIE_PLACES = 6

VECTORS = "id bigint, no int, vec binary"


def usable_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of usable rows, their unit vectors) of a list<float> array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets, dtype=np.int64)
    good = (np.diff(offsets) == dim) & np.asarray(column.is_valid())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = values[offsets[:-1][good][:, None] + np.arange(dim)]
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    good[np.flatnonzero(good)[~fine]] = False
    x = x[fine]
    x = x / np.abs(x).max(1, keepdims=True)
    return good, (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, dim)


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, no, vec): one usable unit vector per row of ``df``; ``no`` is the column ``no`` or 0."""
    no = F.col("no").cast("int") if "no" in df.columns else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = usable_rows(b.column(2), dim)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), binary(x)], names=["id", "no", "vec"])

    return (
        df.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("id"), no.alias("no"), F.col(vector_col).cast("array<float>").alias("v"))
        .where(F.size("v") == dim)
        .mapInArrow(run, VECTORS)
    )


def fit_cells(vectors: DataFrame, dim: int, n: int, cell_rows: int | None = None, rounds: int = 6) -> np.ndarray:
    """Centroids of about n / ``cell_rows`` (CELL_ROWS) cells, at most MOST_CELLS, by spherical k-means on a sample.

    The sample is an even share of the rows by hash, about SAMPLE_PER_CELL per cell and at most
    2 * SAMPLE_ROWS whatever the size of the data. Equal rows of it count once, so that a common vector
    seeds one cell, and centroids without rows or next to another one are dropped.
    """
    cells = int(min(MOST_CELLS, max(1, n // (cell_rows or CELL_ROWS))))
    want = min(cells * SAMPLE_PER_CELL, SAMPLE_ROWS)
    step = max(1, n // want)
    rows = vectors.where(F.pmod(F.xxhash64("id", "no"), F.lit(step)) == 0).select("vec").limit(2 * want).toArrow().column(0)
    x = matrix(rows, np.float32, dim)
    if not len(x):
        return np.zeros((1, dim), np.float32)
    x = x[np.sort(np.unique(x.view(np.dtype((np.void, x.itemsize * dim))).ravel(), return_index=True)[1])]
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c).astype(np.float32)
    return apart(c[norm[:, 0] > 0])


def apart(c: np.ndarray) -> np.ndarray:
    """The centroids less those that reach cosine SAME_CELL with an earlier one that stays."""
    keep = np.ones(len(c), bool)
    for at in range(0, len(c), 1024):
        i, j = np.nonzero(c[at : at + 1024] @ c.T >= SAME_CELL)
        for a, b in zip(i + at, j, strict=True):
            if b < a and keep[b]:
                keep[a] = False
    return c[keep]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in -127..127, scale, length of the error) of unit vectors."""
    scale = np.abs(x).max(1) / np.float32(127)
    code = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x.astype(np.float64) - code * scale[:, None].astype(np.float64), axis=1)
    return code, scale.astype(np.float32), error.astype(np.float32)


def products(
    a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """(cosines from the codes, bound of their error) of all pairs of two blocks.

    With x = x' + e the error of x'y' is at most |x'||e_y| + |e_x||y'| + |e_x||e_y|, and |x'| <= 1 + |e_x|.
    The integer products are sums of at most 2^24, which single precision holds exactly.
    """
    dots = a[0].astype(np.float32) @ b[0].astype(np.float32).T
    cos = dots * a[1][:, None] * b[1][None, :]
    ea, eb = a[2][:, None], b[2][None, :]
    return cos, (1 + ea) * eb + ea * (1 + eb) + ea * eb + np.float32(1e-6)


@dataclass(frozen=True)
class Visits:
    """Which cells a searching vector visits: all that can hold a vector within ``gap``, or the ``count`` nearest."""

    gap: float | None = None
    count: int = 1


def both_search(threshold: float) -> Visits:
    """For pairs of a set with itself. The distances of two vectors from the plane between their homes add up to at
    most their own distance, so one of them is no farther from it than half of that."""
    return Visits(math.sqrt(max(0.0, 2 - 2 * threshold)) / 2)


def one_searches(threshold: float) -> Visits:
    return Visits(math.sqrt(max(0.0, 2 - 2 * threshold)))


class Cells:
    """Centroids with the number of blocks of each cell's base and visitors, estimated from the sample fit."""

    def __init__(self, centroids: np.ndarray, base: np.ndarray, visitors: np.ndarray):
        self.centroids = centroids
        self.load = base
        self.base_blocks = np.maximum(1, np.ceil(base / BASE_BLOCK)).astype(np.int64)
        self.visitor_blocks = np.maximum(1, np.ceil(visitors / VISITOR_BLOCK)).astype(np.int64)

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T).argmax(1)

    def nearest(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the ``count`` cells nearest to each row."""
        sims = x @ self.centroids.T
        count = min(count, sims.shape[1])
        if count == sims.shape[1]:
            return np.repeat(np.arange(len(x)), count), np.tile(np.arange(count), len(x))
        sims[np.arange(len(x)), sims.argmax(1)] = np.inf  # of equal centroids the home is visited
        return np.repeat(np.arange(len(x)), count), np.argpartition(-sims, count - 1, axis=1)[:, :count].ravel()

    def reached(self, x: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each row's home and of all cells that can hold a unit vector within distance ``gap``.

        The plane between the home h and a cell c has the normal h - c, so the row lies (x.h - x.c) / |h - c| from
        it, and every vector of c lies on the plane or behind.
        """
        sims = x @ self.centroids.T
        row, home = np.arange(len(x)), sims.argmax(1)
        homes, at = np.unique(home, return_inverse=True)
        apart_ = np.sqrt(np.maximum(2 - 2 * (self.centroids[homes] @ self.centroids.T), 1e-12))
        near = sims[row, home][:, None] - sims <= (gap + SLACK) * apart_[at]
        near[row, home] = True
        return np.nonzero(near)

    def visited(self, x: np.ndarray, visits: Visits) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest(x, visits.count) if visits.gap is None else self.reached(x, visits.gap)

    def loads(self, df: DataFrame, visits: Visits | None, dim: int, n: int) -> np.ndarray:
        """About how many rows of ``df`` each cell holds, or is visited by, from a sample."""
        x, step = _sample(df, n, dim)
        held = np.zeros(len(self.centroids))
        for at in range(0, len(x), self.rows_at_once):
            part = x[at : at + self.rows_at_once]
            held += np.bincount(self.home(part) if visits is None else self.visited(part, visits)[1], minlength=len(held))
        return held * step

    def with_visitors(self, df: DataFrame, visits: Visits, dim: int, n: int) -> Cells:
        return Cells(self.centroids, self.load, self.loads(df, visits, dim, n))

    @property
    def rows_at_once(self) -> int:
        """Rows whose products with all centroids take about 64 MB."""
        return max(64, min(4096, 16_000_000 // len(self.centroids)))


_TILE = "tile bigint, visitor boolean, id bigint, no int, code binary, scale float, err float"


def _mix(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def to_tiles(vectors: DataFrame, cells: Cells, dim: int, visits: Visits | None, keep_vec: bool) -> DataFrame:
    """Each base row to its cell's tiles; given ``visits``, each searching row to the tiles of the cells it visits."""
    visitor = visits is not None
    names = ["tile", "visitor", "id", "no", "code", "scale", "err", *["vec"] * keep_vec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, cells.rows_at_once):
                b = big.slice(at, cells.rows_at_once)
                x = matrix(b.column("vec"), np.float32, dim)
                code, scale, err = encode(x)
                row, cell = cells.visited(x, visits) if visitor else (np.arange(len(x)), cells.home(x))
                cell = cell.astype(np.int64)
                mine, other = (cells.visitor_blocks, cells.base_blocks) if visitor else (cells.base_blocks, cells.visitor_blocks)
                own = _mix(np.asarray(b.column("id")))[row] % mine[cell]
                copies = other[cell]
                row, cell, own = (np.repeat(y, copies) for y in (row, cell, own))
                across = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                first, second = (across, own) if visitor else (own, across)
                take = pa.array(row)
                cols = [
                    pa.array((cell << 40) | (first << 20) | second), pa.array(np.full(len(row), visitor)), b.column("id").take(take),
                    b.column("no").take(take), binary(code[row]), pa.array(scale[row]), pa.array(err[row]),
                ]
                yield pa.RecordBatch.from_arrays([*cols, *[b.column("vec").take(take)] * keep_vec], names=names)

    return vectors.select("id", "no", "vec").mapInArrow(run, _TILE + ", vec binary" * keep_vec)


def _sides(t: pa.Table, dim: int) -> tuple[pa.Table, pa.Table, tuple, tuple]:
    import pyarrow.compute as pc

    v = t.column("visitor")
    base, visitors = t.filter(pc.invert(v)), t.filter(v)

    def codes(s: pa.Table):
        return matrix(s.column("code"), np.int8, dim), np.asarray(s.column("scale")), np.asarray(s.column("err"))

    return base, visitors, codes(base), codes(visitors)


def _sample(df: DataFrame, n: int, dim: int, rows: int = 20_000) -> tuple[np.ndarray, int]:
    """(about ``rows`` vectors, by hash, and how many each stands for)."""
    step = max(1, n // rows)
    found = df.where(F.pmod(F.xxhash64("no", "id"), F.lit(step)) == 0).select("vec").limit(2 * rows).toArrow().column(0)
    return matrix(found, np.float32, dim), step


def plan_cells(base: DataFrame, visitors: list[tuple[DataFrame, Visits]], dim: int, n: int, cell_rows: int | None = None) -> Cells:
    """Cells fitted on the base, with block counts estimated on samples of both sides."""
    centroids = fit_cells(base, dim, n, cell_rows)
    zero = np.zeros(len(centroids))
    cells = Cells(centroids, zero, zero)
    cells = Cells(centroids, cells.loads(base, None, dim, n), zero)
    return Cells(centroids, cells.load, sum((cells.loads(df, v, dim, n) for df, v in visitors), zero))


def one_cell(dim: int, base: int, visitors: int) -> Cells:
    """All vectors in one cell: its blocks against those of its visitors are all pairs."""
    return Cells(np.zeros((1, dim), np.float32), np.array([base]), np.array([visitors]))


def visits_for(base: DataFrame, asked: DataFrame, dim: int, n: int, k: int, recall: float = RECALL) -> Visits:
    """The number of nearest cells that hold the share ``recall`` of the ``k`` nearest vectors.

    Measured on MEASURED searching vectors against a sample of the base of bounded size. Its vectors are sparser, so
    their nearest lie farther off and in more distant cells than those of the whole base: the number errs upwards.
    """
    cells = Cells(c := fit_cells(base, dim, n), np.zeros(len(c)), np.zeros(len(c)))
    x, _ = _sample(base, n, dim)
    q, _ = _sample(asked, n // 20, dim, MEASURED)
    if not len(x) or not len(q):
        return Visits(count=1)
    home = np.concatenate([cells.home(x[i : i + cells.rows_at_once]) for i in range(0, len(x), cells.rows_at_once)])
    places = []
    for at in range(0, len(q), 64):
        part = q[at : at + 64]
        cos = part @ x.T
        cos[cos > 1 - 1e-6] = -2  # itself and its copies are in its own cell
        best = np.argpartition(-cos, min(k, len(x)) - 1, axis=1)[:, :k]
        to_cell = part @ cells.centroids.T
        own = np.take_along_axis(to_cell, home[best], 1)
        real = np.take_along_axis(cos, best, 1) > -2
        places.append(((to_cell[:, None, :] > own[:, :, None]).sum(2) + 1)[real])
    at = np.sort(np.concatenate(places))
    return Visits(count=int(at[min(len(at) - 1, math.ceil(recall * len(at)))]) if len(at) else 1)


def pairs_above(
    base: DataFrame, visitors: list[tuple[DataFrame, Visits]], cells: Cells, dim: int, threshold: float
) -> DataFrame:
    """(id, no, other, other_no): candidate pairs that the tiles cannot rule out; id is the base's, other the visitor's."""
    tiles = to_tiles(base, cells, dim, None, False)
    for df, visits in visitors:
        tiles = tiles.unionByName(to_tiles(df, cells, dim, visits, False))

    def run(t: pa.Table) -> pa.Table:
        b, v, cb, cv = _sides(t, dim)
        out = []
        for at in range(0, len(v), 1024):
            part = tuple(y[at : at + 1024] for y in cv)
            if not len(b):
                break
            cos, bound = products(part, cb)
            i, j = np.nonzero(cos + bound >= threshold)
            out.append((i + at, j))
        i = np.concatenate([x[0] for x in out] or [np.empty(0, int)])
        j = np.concatenate([x[1] for x in out] or [np.empty(0, int)])
        cols = [b.column("id").take(pa.array(j)), b.column("no").take(pa.array(j)), v.column("id").take(pa.array(i)), v.column("no").take(pa.array(i))]
        return pa.Table.from_arrays([c.combine_chunks() for c in cols], names=["id", "no", "other", "other_no"])

    return tiles.groupBy("tile").applyInArrow(run, "id bigint, no int, other bigint, other_no int")


def best_k(base: DataFrame, members: DataFrame, visitors: DataFrame, cells: Cells, dim: int, k: int, visits: Visits) -> DataFrame:
    """(id, no, other, other_no, cosine, place): the ``k`` vectors of greatest cosine for every searching one.

    Vectors of the same id are not each other's neighbours; those with a negative ``no`` are of another kind and
    exclude none. Each tile keeps k per searching row, after the codes have cut the candidates to those whose bound
    reaches the k-th best. ``base`` and ``members`` come from :func:`contents`: equal vectors are searched as one and expanded at the end.
    """
    found = _best_contents(base, visitors, cells, dim, k, visits)
    w = W.partitionBy("id", "no").orderBy(F.col("cosine").desc(), F.col("other"), F.col("other_no"))
    found = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")
    found = found.join(members, ["other", "other_no"], "left").select(
        "id", "no", F.coalesce("member", "other").alias("other"), F.coalesce("member_no", "other_no").alias("other_no"), "cosine"
    )
    found = found.where((F.col("no") < 0) | (F.col("id") != F.col("other")))
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def contents(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(one vector per content, members of the shared ones as (other, other_no, member, member_no)).

    A shared content goes by its least (id, no), with -1 - no where several ids share it, as it then is a
    neighbour of each of them. Of its members the k + 1 least ids with k vectors each suffice for k neighbours.
    """
    keys = vectors.select("id", "no", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    groups = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).where("n > 1")
    shared = materialize(keys.join(groups, ["h1", "h2"]), "p2-shared")
    of = W.partitionBy("h1", "h2")
    first = shared.where("id = least").groupBy("h1", "h2", "least", "most").agg(F.min("no").alias("first"))
    first = first.withColumn("coded", F.when(F.col("least") < F.col("most"), -1 - F.col("first")).otherwise(F.col("first")))
    few = shared.withColumn("_i", F.dense_rank().over(of.orderBy("id"))).where(F.col("_i") <= k + 1)
    few = few.withColumn("_r", F.row_number().over(W.partitionBy("h1", "h2", "id").orderBy("no"))).where(F.col("_r") <= k)
    members = few.select("h1", "h2", F.col("id").alias("member"), F.col("no").alias("member_no")).join(
        first.select("h1", "h2", F.col("least").alias("other"), F.col("coded").alias("other_no")), ["h1", "h2"]
    )
    single = vectors.join(shared.select("id", "no"), ["id", "no"], "left_anti").select("id", "no", "vec")
    common = vectors.join(first.select(F.col("least").alias("id"), F.col("first").alias("no"), "coded"), ["id", "no"])
    return single.unionByName(common.select("id", F.col("coded").alias("no"), "vec")), members.drop("h1", "h2")


def _best_contents(base: DataFrame, visitors: DataFrame, cells: Cells, dim: int, k: int, visits: Visits) -> DataFrame:
    tiles = to_tiles(base, cells, dim, None, True).unionByName(to_tiles(visitors, cells, dim, visits, True))

    def run(t: pa.Table) -> pa.Table:
        b, v, cb, cv = _sides(t, dim)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(b) and len(v):
            xb, xv = matrix(b.column("vec"), np.float32, dim), matrix(v.column("vec"), np.float32, dim)
            ib, iv = np.asarray(b.column("id")), np.asarray(v.column("id"))
            own_b, own_v = np.asarray(b.column("no")) >= 0, np.asarray(v.column("no")) >= 0
            for at in range(0, len(v), 1024):
                cos, bound = products(tuple(y[at : at + 1024] for y in cv), cb)
                cos[(iv[at : at + 1024][:, None] == ib[None, :]) & own_v[at : at + 1024][:, None] & own_b[None, :]] = -9
                low = cos - bound
                kth = np.partition(low, len(ib) - k, axis=1)[:, len(ib) - k] if len(ib) > k else np.full(len(low), -8.0)
                i, j = np.nonzero((cos + bound >= kth[:, None] - 10.0**-TIE_PLACES) & (cos > -8))
                exact = np.round(np.einsum("ij,ij->i", xv[i + at].astype(np.float64), xb[j].astype(np.float64)), TIE_PLACES)
                order = np.lexsort([ib[j], -exact, i])
                i, j, exact = i[order], j[order], exact[order]
                first = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1]) if len(i) else np.empty(0, int)
                place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                top = place < k
                rows.append((i[top] + at, j[top], exact[top]))
        i, j, e = (np.concatenate([r[q] for r in rows]) if rows else np.empty(0, int) for q in range(3))
        cols = [v.column(c).take(pa.array(i)) for c in ("id", "no")] + [b.column(c).take(pa.array(j)) for c in ("id", "no")]
        return pa.Table.from_arrays(
            [*(c.combine_chunks() for c in cols), pa.array(e.astype(np.float64))], names=["id", "no", "other", "other_no", "cosine"]
        )

    return tiles.groupBy("tile").applyInArrow(run, "id bigint, no int, other bigint, other_no int, cosine double")


def confirm(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The pairs (id, other) for which some pair of vectors reaches ``threshold`` in floating point."""
    joined = pairs.join(left.select("id", "no", F.col("vec").alias("va")), ["id", "no"]).join(
        right.select(F.col("id").alias("other"), F.col("no").alias("other_no"), F.col("vec").alias("vb")), ["other", "other_no"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            va, vb = b.column("va").to_pylist(), b.column("vb").to_pylist()
            dim = len(va[0]) // 4
            x, y = (np.frombuffer(b"".join(z), np.float32).reshape(-1, dim).astype(np.float64) for z in (va, vb))
            cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            keep = pa.array(cos >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(keep), b.column("other").filter(keep)], names=["id", "other"])

    return joined.select("id", "other", "va", "vb").mapInArrow(run, "id bigint, other bigint").distinct()


def copies(vectors: DataFrame, content: str = "vec") -> DataFrame:
    """(id, rep): ids with equal content share the least of them.

    Only two 64-bit hashes of the content are shuffled, aggregated on the map side first; the join
    back is an equi-join that adaptive execution splits where one content has very many copies.
    """
    keys = vectors.select("id", F.xxhash64(content).alias("h1"), F.xxhash64(F.lit(7), content).alias("h2"))
    return keys.join(keys.groupBy("h1", "h2").agg(F.min("id").alias("rep")), ["h1", "h2"]).select("id", "rep")


def representatives(vectors: DataFrame, dupes: DataFrame) -> DataFrame:
    """The rows of ``vectors`` that stand for their copies; ``dupes`` holds the others (id, rep)."""
    return vectors.join(dupes.select("id"), "id", "left_anti")
