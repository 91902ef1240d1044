"""Sets of token matrices as queries: encoded candidates, centroid pruning, probing, and rescoring on compressed tokens.

Queries are tables (qid, tokens). Candidates come from blocks of queries multiplied inside the tasks that scan the
stored form; what is decided afterwards is a table of (qid, id) that is joined with the stored rows and the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.operators.dense import FOUND, TIE_PLACES, batch_search, best_tokens, matrix_blocks
from tarnwell.operators.fixed_encoding import FixedEncoder, float_rows, token_batch
from tarnwell.operators.quantize import ResidualCodec, unit
from tarnwell.operators.topk import Best, top_per

_MATRIX = "array<array<float>>"
#: Rows of a batch that are encoded or multiplied at once.
ROWS = 500


def one_query(spark: SparkSession, tokens: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(0, [[float(x) for x in t] for t in tokens])], f"qid bigint, tokens {_MATRIX}")


def encode_tokens(df: DataFrame, id_col: str, tokens: str, codec: ResidualCodec, encoder: FixedEncoder, packed_fde: bool = False) -> DataFrame:
    """(id, centroid_ids, residuals, fde): the stored form of each document with tokens.

    With ``packed_fde`` the encoding is the bytes of its floats, which scans hand on whole; only ``token_query`` reads that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, ROWS):
                b = big.slice(start, ROWS)
                x, count = token_batch(b.column(1))
                at, packed = codec.encode_many(x, count)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(at))
                fde = encoder.encode_documents(x, count)
                fde = pa.array([r.tobytes() for r in fde.astype("<f4")], pa.binary()) if packed_fde else float_rows(fde)
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(packed, pa.binary()), fde], names=["id", "centroid_ids", "residuals", "fde"])

    return (
        df.where(F.size(tokens) > 0)
        .select(F.col(id_col).cast("bigint").alias("id"), F.col(tokens).cast(_MATRIX).alias("t"))
        .mapInArrow(run, f"id bigint, centroid_ids array<int>, residuals binary, fde {'binary' if packed_fde else 'array<float>'}")
    )


def fde_candidates(stored: DataFrame, queries: DataFrame, count: int, encoder: FixedEncoder) -> DataFrame:
    """(qid, id, fde_score, rank): documents by the dot product of their encoding with the query's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = token_batch(b.column("tokens"))
            rows = [encoder.encode_query(t) for t in np.split(x, np.cumsum(n)[:-1])] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["qid", "vector"])

    asked = queries.where(F.size("tokens") > 0).select(F.col("qid").cast("bigint").alias("qid"), F.col("tokens").cast(_MATRIX).alias("tokens"))
    encoded = asked.mapInArrow(run, "qid bigint, vector array<double>")
    return batch_search(stored.select("id", F.col("fde").alias("vector")), encoded, count, normal=False).withColumnRenamed("score", "fde_score")


def _scored(pool: DataFrame, stored: DataFrame, queries: DataFrame, columns: list[str], score: Callable, k: int) -> DataFrame:
    """The ``k`` best per query of the pairs (qid, id) by ``score`` of a batch with the columns and the query's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("id"), pa.array(np.round(score(b), TIE_PLACES), pa.float64())], names=["qid", "id", "score"])

    pairs = pool.select("qid", "id").join(stored.select("id", *columns), "id").join(queries.select("qid", F.col("tokens").cast(_MATRIX).alias("tokens")), "qid")
    return top_per(pairs.mapInArrow(run, FOUND), "qid", k)


def _tokens_of(b: pa.RecordBatch) -> list[np.ndarray]:
    x, n = token_batch(b.column("tokens"))
    return np.split(x, np.cumsum(n)[:-1])


def _centroids_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    o = np.asarray(b.column("centroid_ids").offsets, dtype=np.int64)
    return np.asarray(b.column("centroid_ids").values)[o[0] : o[-1]], np.diff(o)


def rescore(pool: DataFrame, stored: DataFrame, queries: DataFrame, k: int, codec: ResidualCodec) -> DataFrame:
    """(qid, id, score, rank): the pool (qid, id) by MaxSim against the decoded tokens."""

    def score(b: pa.RecordBatch) -> list[float]:
        at, count = _centroids_of(b)
        x = codec.decode_many(at, b.column("residuals").to_pylist(), count)
        return [float((q @ t.T).max(1).sum()) for q, t in zip(_tokens_of(b), np.split(x, np.cumsum(count)[:-1]), strict=True)]

    return _scored(pool, stored, queries, ["centroid_ids", "residuals"], score, k)


def exact_rescore(pool: DataFrame, docs: DataFrame, tokens: str, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the pool (qid, id) by MaxSim against the tokens of ``docs`` as they were given.

    Pairs meet the documents in one join; the queries go to the tasks in blocks, so no pair carries tokens through a shuffle.
    """
    stored = docs.where(F.size(tokens) > 0).select("id", F.col(tokens).cast(_MATRIX).alias("t"))
    pairs = pool.select(F.col("qid").cast("bigint").alias("qid"), F.col("id").cast("bigint").alias("id")).join(stored, "id")
    out = pool.sparkSession.createDataFrame([], FOUND)
    for ids, rows in matrix_blocks(queries):
        order = np.argsort(ids, kind="stable")
        qids, asked = np.array(ids)[order], [unit(rows[i].astype(np.float32).astype(np.float64)) for i in order]

        def run(batches: Iterator[pa.RecordBatch], qids: np.ndarray = qids, asked: list[np.ndarray] = asked) -> Iterator[pa.RecordBatch]:
            for b in batches:
                qid = np.asarray(b.column("qid"))
                at = np.minimum(np.searchsorted(qids, qid), len(qids) - 1)
                own = qids[at] == qid
                if own.any():
                    x, count = token_batch(b.column("t"))
                    parts = np.split(x, np.cumsum(count)[:-1])
                    s = [float((asked[at[n]] @ parts[n].T).max(1).sum()) for n in np.flatnonzero(own)]
                    yield pa.RecordBatch.from_pydict({"qid": qid[own], "id": np.asarray(b.column("id"))[own], "score": np.round(s, TIE_PLACES)})

        out = out.unionByName(pairs.mapInArrow(run, FOUND))
    return top_per(out, "qid", k)


#: Queries that a task answers and documents that it holds in compressed form, at most.
BLOCK, HELD = 1000, 500_000
#: Scores of a task's queries and a batch of documents that are computed at once.
SCORES = 1 << 18


def _blocks(queries: DataFrame) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """The queries (ids, matrices of unit tokens) in as many blocks as there are cores, or multiples of that where a
    block would have more than BLOCK queries, but no blocks of less than 50 queries."""
    asked = queries.where(F.size("tokens") > 0).select(F.col("qid").cast("bigint").alias("qid"), F.col("tokens").cast(_MATRIX).alias("tokens"))
    rows = [(r.qid, unit(np.array(r.tokens, dtype=np.float32).astype(np.float64))) for r in asked.toLocalIterator()]
    cores = queries.sparkSession.sparkContext.defaultParallelism
    count = min(cores, -(-len(rows) // 50)) if len(rows) <= cores * BLOCK else -(-len(rows) // (cores * BLOCK)) * cores
    return [(np.array([q for q, _ in part]), [t for _, t in part]) for part in (rows[i::count] for i in range(count))]


def _ranked(stored: DataFrame, queries: DataFrame, k: int, codec: ResidualCodec, count: int, columns: list[str], scorer: Callable, keep: int | None = None) -> DataFrame:
    """(qid, id, first, pruned, score): of the ``count`` best documents by the ``first`` score the ``keep`` best by MaxSim
    over centroids (``pruned``, where ``keep`` is given), and of those the ``k`` best by MaxSim on decoded tokens.

    A task answers a block of queries over all documents and decides every stage itself, so what it passes on is the
    answer and no candidates are shuffled. It holds the tables of ``count`` entries of its queries and the compressed tokens
    of the documents. Where the documents are more than HELD, or the blocks at most half the cores, the documents of a block
    are shared by several tasks, which pass on ``count`` candidates with all scores, and the cuts are made afterwards.

    ``scorer`` makes of a block's matrices a function that scores a slice of the queries against a batch.
    """
    spark = stored.sparkSession
    schema = "qid bigint, id bigint, first double, pruned double, score double"
    blocks = _blocks(queries)
    if not blocks:
        return spark.createDataFrame([], schema)
    stored = stored.where(F.size("centroid_ids") > 0)
    parts = max(1, spark.sparkContext.defaultParallelism // len(blocks), -(-stored.count() // HELD))
    rows = stored.select("id", "centroid_ids", "residuals", *columns).coalesce(parts)
    out = None
    for ids, tokens in blocks:

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, tokens: list[np.ndarray] = tokens) -> Iterator[pa.RecordBatch]:
            score, best, held = scorer(tokens), Best(len(ids), count, ROWS, TIE_PLACES), []
            step = max(1, SCORES // ROWS)
            for big in batches:
                for start in range(0, big.num_rows, ROWS):
                    b = big.slice(start, ROWS)
                    of = np.asarray(b.column("id"))
                    of_batch = score(b)
                    for at in range(0, len(ids), step):
                        best.add(at, of_batch(at, min(len(ids), at + step)), of)
                    # Copies: a view would keep the whole batch with its encodings.
                    held.append((*map(np.array, (of, *_centroids_of(b))), np.array(b.column("residuals").to_pylist(), dtype=object)))
            # What is decided needs all documents of the task.
            if held:
                yield from staged(ids, tokens, best, *[np.concatenate(x) for x in zip(*held, strict=True)])

        def staged(ids: np.ndarray, tokens: list[np.ndarray], best: Best, of: np.ndarray, at: np.ndarray, size: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
            first_s, first_i = best.take()
            by_id, begin = np.argsort(of, kind="stable"), np.cumsum(size) - size
            sorted_ids = of[by_id]
            for n, (qid, q) in enumerate(zip(ids, tokens, strict=True)):
                s, i = first_s[n], first_i[n]
                s, i = s[s > -np.inf], i[s > -np.inf]
                if not len(i):
                    continue
                doc, low = by_id[np.searchsorted(sorted_ids, i)], np.full(len(i), np.nan)
                if keep is not None:
                    low = np.round(_maxsim(q, codec.centroids[at[_spans(begin[doc], size[doc])]], size[doc]), TIE_PLACES)
                    if parts == 1:
                        s, i, doc, low = (x[np.lexsort([i, -low])[:keep]] for x in (s, i, doc, low))
                x = codec.decode_many(at[_spans(begin[doc], size[doc])], packed[doc].tolist(), size[doc])
                full = np.round(_maxsim(q, x, size[doc]), TIE_PLACES)
                if parts == 1:
                    s, i, low, full = (x[np.lexsort([i, -full])[:k]] for x in (s, i, low, full))
                yield pa.RecordBatch.from_pydict({"qid": np.full(len(i), qid), "id": i, "first": s, "pruned": low, "score": full})

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if parts > 1:
        out = top_per(out, "qid", count, "first").drop("rank")
        out = out if keep is None else top_per(out, "qid", keep, "pruned").drop("rank")
        out = top_per(out, "qid", k).drop("rank")
    return out


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the tokens of documents that begin at ``begin``, end to end."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _maxsim(q: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(q @ x.T, np.cumsum(size) - size, axis=1).sum(0)


def token_query(
    stored: DataFrame, queries: DataFrame, k: int, codec: ResidualCodec, encoder: FixedEncoder, candidates: int | None = None, rerank_candidates: int | None = None
) -> DataFrame:
    """(qid, id, score, fde_score): encoded candidates (8 k unless said), pruned by centroids where
    ``rerank_candidates`` is given, rescored on compressed tokens."""
    count = max(k, candidates or 8 * k)
    if rerank_candidates is not None and not count >= rerank_candidates >= k > 0:
        raise ValueError("candidates >= rerank_candidates >= top_k > 0 is required")

    def scorer(tokens: list[np.ndarray]) -> Callable:
        q = np.stack([encoder.encode_query(t) for t in tokens])

        def batch(b: pa.RecordBatch) -> Callable:
            c = b.column("fde")
            if pa.types.is_binary(c.type):
                x = np.frombuffer(b"".join(c.to_pylist()), "<f4")
            else:
                o = np.asarray(c.offsets)
                x = np.asarray(c.values)[o[0] : o[-1]]
            x = x.reshape(b.num_rows, -1).astype(np.float64)
            return lambda a, e: q[a:e] @ x.T

        return batch

    found = _ranked(stored, queries, k, codec, count, ["fde"], scorer, rerank_candidates)
    return found.select("qid", "id", "score", F.col("first").alias("fde_score"))


def probe_query(stored: DataFrame, queries: DataFrame, k: int, candidates: int, probes: int, codec: ResidualCodec) -> DataFrame:
    """(qid, id, score, rank): each query token names its ``probes`` nearest centroids; documents on any of their lists
    are ranked by MaxSim over centroids, and the best are rescored."""

    def scorer(tokens: list[np.ndarray]) -> Callable:
        start = np.cumsum([0] + [len(t) for t in tokens])
        table = np.concatenate(tokens) @ codec.centroids.T
        lists = np.zeros(table.shape, bool)
        np.put_along_axis(lists, np.argsort(-table, axis=1, kind="stable")[:, :probes], True, axis=1)
        lists = np.logical_or.reduceat(lists, start[:-1], axis=0)

        def batch(b: pa.RecordBatch) -> Callable:
            at, size = _centroids_of(b)

            def scores(a: int, e: int) -> np.ndarray:
                rows = table[start[a] : start[e]]
                s = np.add.reduceat(best_tokens(lambda t: rows[:, at[t]], size), start[a:e] - start[a], axis=0)
                own = lists[a:e]
                s[~best_tokens(lambda t: own[:, at[t]], size)] = -np.inf
                return s

            return scores

        return batch

    return top_per(_ranked(stored, queries, k, codec, max(k, candidates), [], scorer), "qid", k).select("qid", "id", "score", "rank")


def explain_tokens(result: DataFrame) -> DataFrame:
    """One row per query: the top score, its lead, the place of the best hit among encoded scores, and the share of hits
    whose two places differ by at most 3."""
    by = lambda c: F.row_number().over(W.partitionBy("qid").orderBy(F.desc(c), F.asc("id")))
    placed = result.withColumn("a", by("score")).withColumn("b", by("fde_score"))
    at = lambda p: F.max(F.when(F.col("a") == p, F.col("score")))
    return placed.groupBy("qid").agg(
        at(1).alias("top_score"),
        (at(1) - at(2)).alias("margin"),
        F.max(F.when(F.col("a") == 1, F.col("b"))).alias("best_fde_rank"),
        F.avg((F.abs(F.col("a") - F.col("b")) <= 3).cast("double")).alias("rank_agreement"),
    )
