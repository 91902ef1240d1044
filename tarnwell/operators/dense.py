"""Dense and late-interaction channels, scored exactly.

A single query is a column expression with its vector as a literal and needs no shuffle but the
final merge of k rows per task. A set of queries is scored by matrix products over Arrow batches;
the set is bounded by a check and larger ones are taken in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.vectors import doubles, maxsim, normalise, sort_key
from tarnwell.operators.quantize import unit
from tarnwell.operators.topk import keep_best, no_best, top, top_per

#: Values of query vectors sent to the tasks at once (64 MB in double precision).
QUERY_VALUES = 8_000_000
#: Scores that a task computes at once, and entries of its tables of best rows, at most.
SCORES, ENTRIES = 1 << 20, 4_000_000
#: Scores that agree to this many places are ties, so that rounding noise never orders rows.
TIE_PLACES = 9


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")


def search(df: DataFrame, vector: str, query: list[float], k: int, metric: str = "cosine", id_col: str = "id", eligible: Column | None = None) -> DataFrame:
    """(id, raw_score, sort_key): the ``k`` nearest rows; the filter works before the cut, rows without vector are skipped."""
    rows = df.where(F.col(vector).isNotNull())
    if eligible is not None:
        rows = rows.where(F.coalesce(eligible, F.lit(False)))
    key = sort_key(metric, vector, literal(query))
    raw = {"cosine": 1.0 - F.col("sort_key"), "dot": -F.col("sort_key"), "euclidean": F.col("sort_key")}[metric]
    scored = rows.select(F.col(id_col).alias("id"), key.alias("sort_key")).withColumn("raw_score", raw)
    return top(scored, k, "sort_key", ascending=True)


def _blocks(queries: DataFrame, qid: str, vector: str, normal: bool, k: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query vectors in blocks of at most QUERY_VALUES values and ENTRIES best rows."""
    ids, rows, held = [], [], 0
    v = normalise(vector) if normal else doubles(vector)
    for r in queries.where(F.col(vector).isNotNull()).select(F.col(qid).cast("bigint").alias("q"), v.alias("v")).toLocalIterator():
        if held and (held + len(r.v) > QUERY_VALUES or (len(ids) + 1) * k > ENTRIES):
            yield np.array(ids), np.array(rows)
            ids, rows, held = [], [], 0
        ids.append(r.q)
        rows.append(np.array(r.v, dtype=np.float64))
        held += len(r.v)
    if ids:
        yield np.array(ids), np.array(rows)


def batch_search(
    df: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "vector", qid: str = "qid", query_vector: str = "vector", normal: bool = True
) -> DataFrame:
    """(qid, id, score, rank): the ``k`` rows of greatest cosine (or dot product, ``normal=False``) for every query.

    A query with several vectors, one per row of ``queries``, counts a row at the best of them. Each task multiplies
    its rows with the queries, about SCORES products at once, and passes on k rows per query; ties go to the lower id.
    """
    rows = df.where(F.col(vector).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), (normalise(vector) if normal else doubles(vector)).alias("v")
    )
    out, blocks = df.sparkSession.createDataFrame([], FOUND), 0
    for ids, q in _blocks(queries, qid, query_vector, normal, k):
        order = np.argsort(ids, kind="stable")
        q, (own, first) = q[order], np.unique(ids[order], return_index=True)

        def run(batches: Iterator[pa.RecordBatch], own: np.ndarray = own, first: np.ndarray = first, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            best_s, best_i = no_best(len(own), k)
            step, end = SCORES // 4096, np.append(first, len(q))
            for big in batches:
                for at in range(0, big.num_rows, 4096):
                    b = big.slice(at, 4096)
                    c = b.column("v")
                    o = np.asarray(c.offsets)
                    fit = np.diff(o) == q.shape[1]
                    x = np.asarray(c.values)[o[:-1][fit][:, None] + np.arange(q.shape[1])]
                    of = np.asarray(b.column("id"))[fit]
                    for a in range(0, len(own), step):
                        e = min(len(own), a + step)
                        s = q[end[a] : end[e]] @ x.T
                        s = np.maximum.reduceat(s, first[a:e] - first[a], axis=0) if e - a < len(s) else s
                        best_s[a:e], best_i[a:e] = keep_best(best_s[a:e], best_i[a:e], s, of, TIE_PLACES)
            yield found(own, best_s, best_i)

        out, blocks = out.unionByName(rows.mapInArrow(run, FOUND)), blocks + 1
    if blocks > 1:  # the vectors of a query may be parted by the blocks
        out = out.groupBy("qid", "id").agg(F.max("score").alias("score"))
    return top_per(out, "qid", k)


FOUND = "qid bigint, id bigint, score double"


def found(qids: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The rows that a task's table of best scores holds."""
    held = score > -np.inf
    return pa.RecordBatch.from_pydict({"qid": np.repeat(qids, held.sum(1)), "id": ids[held], "score": score[held]})


def usable(v: Column | str, dim: int) -> Column:
    """The vector has ``dim`` finite values that are not all 0."""
    c = F.col(v) if isinstance(v, str) else v
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) == dim) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def usable_matrix(m: str, dim: int) -> Column:
    """The matrix has rows, and each is usable."""
    return F.coalesce((F.size(m) > 0) & F.forall(m, lambda v: usable(v, dim)), F.lit(False))


def matrix_blocks(queries: DataFrame) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Query matrices (qid, tokens) in blocks of at most QUERY_VALUES values (or one matrix)."""
    ids, rows, held = [], [], 0
    for r in queries.where(F.size("tokens") > 0).select(F.col("qid").cast("bigint").alias("qid"), "tokens").toLocalIterator():
        t = np.array(r.tokens, dtype=np.float64)
        if held and held + t.size > QUERY_VALUES:
            yield ids, rows
            ids, rows, held = [], [], 0
        ids.append(r.qid)
        rows.append(t)
        held += t.size
    if ids:
        yield ids, rows


def best_tokens(of: Callable[[np.ndarray], np.ndarray], size: np.ndarray) -> np.ndarray:
    """The greatest value per row and document of ``of`` (the columns of the tokens with the numbers it is given), for
    documents of ``size`` tokens end to end. Documents of one size go together, a token of each at a time."""
    first, sizes = np.cumsum(size) - size, np.unique(size)
    if sizes.sum() > 64:  # too many sizes for that
        return np.maximum.reduceat(of(np.arange(size.sum())), first, axis=1)
    out = None
    for n in sizes:
        own = np.flatnonzero(size == n)
        most = of(first[own])
        for t in range(1, n):
            np.maximum(most, of(first[own] + t), out=most)
        if len(sizes) == 1:
            return most
        out = np.empty((len(most), len(size)), most.dtype) if out is None else out
        out[:, own] = most
    return out


def exact_maxsim(docs: DataFrame, tokens: str, queries: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """(qid, id, score, rank) for queries (qid, tokens), over tokens brought to length 1.

    A block of queries, bounded by QUERY_VALUES, goes to the tasks; of these as many are multiplied with the tokens of a
    batch at once as make about SCORES products (one at least). The greatest product per document and query token and
    their sums are segment reductions, and each task passes on k rows per query.
    """
    out = None
    for ids, rows in matrix_blocks(queries):
        start = np.concatenate([[0], np.cumsum([len(t) for t in rows])[:-1]])
        q = unit(np.concatenate(rows))
        out_ids = np.array(ids)

        def run(batches: Iterator[pa.RecordBatch], q=q, start=start, out_ids=out_ids) -> Iterator[pa.RecordBatch]:
            best_s, best_i = no_best(len(out_ids), k)
            end = np.append(start, len(q))
            for big in batches:
                for at in range(0, big.num_rows, 1000):
                    b = big.slice(at, 1000)
                    c = b.column("t")
                    o = np.asarray(c.offsets)
                    inner = c.values.slice(o[0], o[-1] - o[0])
                    io = np.asarray(inner.offsets)
                    x = unit(np.asarray(inner.values)[io[0] : io[-1]].reshape(len(io) - 1, -1).astype(np.float64))
                    of, size, a = np.asarray(b.column("id")), np.diff(o).astype(np.int64), 0
                    while a < len(out_ids):
                        e = max(a + 1, int(np.searchsorted(end, end[a] + SCORES // len(x), "right")) - 1)
                        rows = q[end[a] : end[e]]
                        most = best_tokens(lambda t, rows=rows, x=x: rows @ x[t].T, size)
                        s = np.add.reduceat(most, start[a:e] - start[a], axis=0)
                        best_s[a:e], best_i[a:e] = keep_best(best_s[a:e], best_i[a:e], s, of, TIE_PLACES)
                        a = e
            yield found(out_ids, best_s, best_i)

        d = docs.where(F.size(tokens) > 0).select(F.col(id_col).cast("bigint").alias("id"), F.col(tokens).alias("t"))
        part = d.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], FOUND)
    return top_per(out, "qid", k)


def maxsim_rerank(pool: DataFrame, docs: DataFrame, tokens: str, query: list[list[float]], limit: int, id_col: str = "id") -> DataFrame:
    """Score a pool (id, score) by MaxSim; every candidate must have the field, else the query fails."""
    q = F.array(*[normalise(literal(v)) for v in query])
    joined = pool.select("id").join(docs.select(F.col(id_col).alias("id"), F.col(tokens).alias("t")), "id", "left")
    unit = F.transform(F.col("t"), normalise)
    guarded = F.when(F.size("t") > 0, maxsim(q, unit)).otherwise(
        F.raise_error(F.concat(F.lit("candidate without the rerank field: "), F.col("id").cast("string"))).cast("double")
    )
    return top(joined.select("id", guarded.alias("score")), limit)
