"""Problem 2 on this project's tables: similar points, queries and records.

See :mod:`tarnwell.llm.neighbours` for the method and the treatment of dirty rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.neighbours import (
    RECALL,
    Cells,
    Visits,
    best_k,
    binary,
    both_search,
    confirm,
    contents,
    copies,
    matrix,
    one_cell,
    one_searches,
    pairs_above,
    plan_cells,
    representatives,
    unit_vectors,
    usable_rows,
    visits_for,
)
from tarnwell.session import materialize
from tarnwell.sources.tables import latest

POINT_DIM, TOKEN_DIM = 64, 24
#: Copies of one vector that a task pairs with all others of it.
COPIES_AT_ONCE = 2000


@dataclass(frozen=True)
class Similar:
    """Similar vectors without their copies: ``pairs`` (kind, id_a, id_b) of representatives, and ``copies``
    (kind, id, rep) of every id that has the same content as a lesser one."""

    pairs: DataFrame
    copies: DataFrame

    def expanded(self) -> DataFrame:
        """(kind, id_a, id_b) of all ids; the first id of kind ``query`` has copies, the second never does."""
        of_query, dupes = F.col("kind") == "query", self.copies
        out = self.pairs
        for c in ("id_a", "id_b"):
            side = dupes if c == "id_a" else dupes.where("kind <> 'query'")
            more = out.join(side.select("kind", F.col("id").alias("_copy"), F.col("rep").alias(c)), ["kind", c])
            out = out.unionByName(more.withColumn(c, F.col("_copy")).drop("_copy"))
        a, b = F.col("id_a"), F.col("id_b")
        ordered = out.select("kind", F.when(of_query, a).otherwise(F.least(a, b)).alias("id_a"), F.when(of_query, b).otherwise(F.greatest(a, b)).alias("id_b"))
        return ordered.unionByName(_within(dupes.where("kind <> 'query'")))


def live_points(points: DataFrame, dim: int = POINT_DIM) -> DataFrame:
    rows = latest(points.select("point_id", "vector", "deleted", "ingested_at"), "point_id", "ingested_at")
    return unit_vectors(rows.where(~F.coalesce("deleted", F.lit(False))), "point_id", "vector", dim)


def query_vectors(requests: DataFrame, dim: int = POINT_DIM) -> DataFrame:
    """(id, no, vec) with negative ``no``, which tells query vectors from points."""
    rows = latest(requests.select("query_id", "vectors", "ingested_at"), "query_id", "ingested_at")
    return unit_vectors(rows.select("query_id", F.posexplode("vectors").alias("k", "v")).select("query_id", (-1 - F.col("k")).alias("no"), "v"), "query_id", "v", dim)


def token_matrices(records: DataFrame, dim: int = TOKEN_DIM) -> DataFrame:
    """(id, vec): the unit vectors of each record end to end; records with none or with an unusable one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outer = b.column(1)
            offsets = np.asarray(outer.offsets, dtype=np.int64)
            inner = outer.values
            good, x = usable_rows(inner, dim)
            before = np.concatenate([[0], np.cumsum(good)])
            n, ok = np.diff(offsets), before[offsets[1:]] - before[offsets[:-1]]
            keep = (n > 0) & (ok == n) & np.asarray(outer.is_valid())
            rows = [x[before[a] : before[z]].tobytes() for a, z in zip(offsets[:-1][keep], offsets[1:][keep], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(rows, pa.binary())], names=["id", "vec"])

    return (
        records.where(F.col("number").isNotNull() & (F.size("vectors") > 0))
        .select(F.col("number").cast("bigint").alias("id"), F.col("vectors").cast("array<array<float>>").alias("v"))
        .mapInArrow(run, "id bigint, vec binary")
    )


def tokens(matrices: DataFrame, dim: int = TOKEN_DIM, cells: Cells | None = None, visits: Visits | None = None) -> DataFrame:
    """(id, no, vec) for every token of every record, or, given ``cells``, for one token of each: the one
    for which the cells it visits hold the fewest tokens, so that common tokens start no search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(1)
            lens = np.array([len(v) for v in column.to_pylist()]) // (4 * dim)
            x = matrix(column, np.float32, dim)
            start = np.cumsum(lens) - lens
            row = np.repeat(np.arange(len(lens)), lens)
            no = np.arange(len(x)) - start[row]
            if cells is not None:
                load = np.zeros(len(x))
                for at in range(0, len(x), cells.rows_at_once):
                    r, c = cells.visited(x[at : at + cells.rows_at_once], visits)
                    load[at : at + cells.rows_at_once] = np.bincount(r, cells.load[c] + 1, len(x[at : at + cells.rows_at_once]))
                order = np.lexsort([no, load, row])
                pick = order[np.concatenate([[True], np.diff(row[order]) != 0])]
                row, no, x = row[pick], no[pick], x[pick]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(no.astype(np.int32)), binary(x)], names=["id", "no", "vec"])

    return matrices.mapInArrow(run, "id bigint, no int, vec binary")


def _within(dupes: DataFrame) -> DataFrame:
    """(kind, id_a, id_b): pairs of ids with the same content, smaller id first.

    The copies of a content are cut into shares of about COPIES_AT_ONCE by a hash of the id; each share is joined
    with all of them, so the pairs of a very common vector are the work of many tasks.
    """
    every = dupes.unionByName(dupes.select("kind", F.col("rep").alias("id"), "rep").distinct())
    shares = every.groupBy("kind", "rep").agg(F.ceil(F.count("*") / COPIES_AT_ONCE).cast("bigint").alias("_shares"))
    sized = every.join(shares, ["kind", "rep"])
    a = sized.select("kind", "rep", F.pmod(F.xxhash64("id"), "_shares").alias("_share"), F.col("id").alias("id_a"))
    b = sized.select("kind", "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1)).alias("_share"), F.col("id").alias("id_b"))
    return a.join(b, ["kind", "rep", "_share"]).where("id_a < id_b").select("kind", "id_a", "id_b")


def similar_points(points: DataFrame, requests: DataFrame, threshold: float = 0.97, dim: int = POINT_DIM) -> Similar:
    """Pairs of kinds ``point`` (two live points) and ``query`` (a live point and a request).

    Vectors, copies and surviving pairs are written between the steps: the tiles are multiplied once,
    and small tables are known to be small when the joins with them are planned.
    """
    vectors = materialize(live_points(points, dim), "p2-points")
    queries = materialize(query_vectors(requests, dim), "p2-queries")
    dupes = materialize(copies(vectors).where("id <> rep"), "p2-copies")
    base = representatives(vectors, dupes)
    visitors = [(base, both_search(threshold)), (queries, one_searches(threshold))]
    cells = plan_cells(base, visitors, dim, max(base.count(), 1))
    near = pairs_above(base, visitors, cells, dim, threshold).where("id <> other OR other_no < 0")
    # A pair of points is found from either side; one order of the two is enough.
    swap = (F.col("other_no") >= 0) & (F.col("id") > F.col("other"))
    near = near.select(
        F.when(swap, F.col("other")).otherwise(F.col("id")).alias("id"), "no",
        F.when(swap, F.col("id")).otherwise(F.col("other")).alias("other"), "other_no",
    )
    near = materialize(near.distinct(), "p2-pairs")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").alias("id_a"), F.col("other").alias("id_b"))
    of_points = named(confirm(near.where("other_no >= 0"), vectors, vectors, threshold), "point")
    of_queries = named(confirm(near.where("other_no < 0"), vectors, queries, threshold), "query")
    kinds = F.explode(F.array(F.lit("point"), F.lit("query"))).alias("kind")
    return Similar(materialize(of_points.unionByName(of_queries), "p2-found"), dupes.select(kinds, "id", "rep"))


def both_ways(pairs: DataFrame, matrices: DataFrame, threshold: float, dim: int = TOKEN_DIM) -> DataFrame:
    """Pairs (id, other) of records in which every vector of either reaches ``threshold`` with one of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("va").to_pylist(), b.column("vb").to_pylist(), strict=True):
                x, y = (np.frombuffer(z, np.float32).reshape(-1, dim).astype(np.float64) for z in (x, y))
                cos = (x @ y.T) / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :])
                keep.append(cos.max(1).min() >= threshold and cos.max(0).min() >= threshold)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("id").filter(mask), b.column("other").filter(mask)], names=["id", "other"])

    joined = pairs.join(matrices.select("id", F.col("vec").alias("va")), "id").join(
        matrices.select(F.col("id").alias("other"), F.col("vec").alias("vb")), "other"
    )
    return joined.select("id", "other", "va", "vb").mapInArrow(run, "id bigint, other bigint")


def similar_records(records: DataFrame, threshold: float = 0.97, dim: int = TOKEN_DIM) -> Similar:
    """Pairs of kind ``record`` (rows: current records).

    Every vector of a similar record has a counterpart, so any one token of a record finds it.
    """
    matrices = materialize(token_matrices(records, dim), "p2-records")
    dupes = materialize(copies(matrices).where("id <> rep"), "p2-copies")
    distinct = representatives(matrices, dupes)
    base, visits = materialize(tokens(distinct, dim), "p2-tokens"), one_searches(threshold)
    cells = plan_cells(base, [], dim, max(1, base.count()))
    chosen = materialize(tokens(distinct, dim, cells, visits), "p2-chosen")
    cells = cells.with_visitors(chosen, visits, dim, max(1, chosen.count()))
    near = pairs_above(base, [(chosen, visits)], cells, dim, threshold).where("id <> other")
    pairs = materialize(near.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct(), "p2-pairs")
    found = both_ways(pairs, matrices, threshold, dim).select(F.lit("record").alias("kind"), F.col("id").alias("id_a"), F.col("other").alias("id_b"))
    return Similar(materialize(found, "p2-found"), dupes.select(F.lit("record").alias("kind"), "id", "rep"))


def _search(base: DataFrame, asked: DataFrame, dim: int, k: int, recall: float, exact: bool) -> tuple[Cells, Visits]:
    n = max(1, base.count())
    if exact:
        return one_cell(dim, n, asked.count()), Visits(count=1)
    visits = visits_for(base, asked, dim, n, k, recall)
    return plan_cells(base, [(asked, visits)], dim, n), visits


def nearest_points(
    points: DataFrame, requests: DataFrame, k: int = 10, every: int = 20, dim: int = POINT_DIM, recall: float = RECALL, exact: bool = False
) -> DataFrame:
    """(kind, id, no, other, cosine, place): the ``k`` live points nearest to every point and every query
    vector whose id is divisible by ``every``; at least ``recall`` of them, or all with ``exact``."""
    vectors = materialize(live_points(points, dim), "p2-points")
    queries = materialize(query_vectors(requests, dim), "p2-queries")
    asked = vectors.unionByName(queries).where(F.col("id") % every == 0)
    base, members = contents(vectors, k)
    base = materialize(base, "p2-contents")
    cells, visits = _search(base, asked, dim, k, recall, exact)
    return best_k(base, members, asked, cells, dim, k, visits).select(
        F.when(F.col("no") < 0, F.lit("query")).otherwise(F.lit("point")).alias("kind"), "id", "no", "other", "cosine", "place"
    )


def nearest_tokens(
    records: DataFrame, k: int = 10, every: int = 20, dim: int = TOKEN_DIM, recall: float = RECALL, exact: bool = False
) -> DataFrame:
    """(kind, id, no, other, other_no, cosine, place): the ``k`` tokens of other records nearest to every token of
    the records whose number is divisible by ``every``."""
    vectors = materialize(tokens(token_matrices(records, dim), dim), "p2-tokens")
    asked = vectors.where(F.col("id") % every == 0)
    base, members = contents(vectors, k)
    base = materialize(base, "p2-contents")
    cells, visits = _search(base, asked, dim, k, recall, exact)
    return best_k(base, members, asked, cells, dim, k, visits).select(F.lit("record").alias("kind"), "id", "no", "other", "other_no", "cosine", "place")
