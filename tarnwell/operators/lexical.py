"""Lexical and sparse channels: term counts, statistics, BM25 and sparse dot products.

Statistics are those of the whole collection even where a filter restricts who may be found.
A set of queries is scored inside the tasks that hold the documents, in blocks of bounded size: postings
of the block's terms are multiplied with the queries that name them and summed per document, so no pair
of document and term or query is shuffled, however frequent the term.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.text import PLAIN, Analyzer
from tarnwell.operators.dense import FOUND, TIE_PLACES, found
from tarnwell.operators.topk import keep_best, no_best, top_per
from tarnwell.session import materialize
from tarnwell.sources.tables import spread

K1, B = 1.2, 0.75
#: Terms or features of queries sent to the tasks at once.
QUERY_TERMS = 1_000_000
#: Products of postings and queries, and sums per document and query, that a task holds at once.
PRODUCTS, CELLS = 4_000_000, 8_000_000
#: Terms of a search that become a filter on the files of an index.
PUSHED_TERMS = 10_000


def term_counts(docs: DataFrame, id_col: str = "id", text: str = "text", analyzer: Analyzer = PLAIN) -> DataFrame:
    """(id, term, tf) of documents with a text."""
    terms = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.explode_outer(analyzer.column(text)).alias("term")).where("term IS NOT NULL")
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_totals(docs: DataFrame, text: str = "text", analyzer: Analyzer = PLAIN) -> DataFrame:
    """One row: documents with a text (an empty one counts) and their total length in terms."""
    return docs.where(F.col(text).isNotNull()).agg(
        F.count("*").cast("double").alias("n_docs"), F.sum(F.size(analyzer.column(text))).cast("double").alias("total_len")
    )


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class Asked:
    """A block of queries over a vocabulary of codes: the queries that name code c, and with what weight, stand from
    ``start[c]`` to ``start[c + 1]``."""

    ids: np.ndarray
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, query: np.ndarray, code: np.ndarray, weight: np.ndarray, codes: int) -> Asked:
        order = np.argsort(code, kind="stable")
        return cls(ids, np.searchsorted(code[order], np.arange(codes + 1)), query[order], weight[order])

    def scores(self, rows: int, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums of products (queries x rows) of postings (row, code, weight), -inf where a pair shares no code."""
        count = self.start[code + 1] - self.start[code]
        shared, ends = np.zeros(rows * len(self.ids)), np.cumsum(count)
        at = 0
        while at < len(code):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right")))
            n = count[at:to]
            of = np.repeat(np.arange(at, to), n)
            e = np.repeat(self.start[code[at:to]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shared += np.bincount(row[of] * len(self.ids) + self.query[e], weight[of] * self.weight[e], len(shared))
            at = to
        shared[shared == 0] = -np.inf
        return shared.reshape(rows, len(self.ids)).T

    def search(self, ids: np.ndarray, row: np.ndarray, code: np.ndarray, weight: np.ndarray, best: tuple) -> tuple:
        """``best`` after the documents ``ids``; ``row`` rises and numbers them."""
        step = max(1, CELLS // len(self.ids))
        for at in range(0, len(ids), step):
            a, z = np.searchsorted(row, [at, at + step])
            part = ids[at : at + step]
            s = self.scores(len(part), row[a:z] - at, code[a:z], weight[a:z])
            best = keep_best(*best, np.round(s, TIE_PLACES), part)
        return best


def _query_terms(queries: DataFrame, analyzer: Analyzer) -> Iterator[tuple[list, list]]:
    """Queries (ids, lists of terms) in blocks of at most QUERY_TERMS terms."""
    ids, terms, held = [], [], 0
    for r in queries.select(F.col("qid").cast("bigint").alias("qid"), analyzer.column("text").alias("w")).where(F.size("w") > 0).toLocalIterator():
        if ids and held + len(r.w) > QUERY_TERMS:
            yield ids, terms
            ids, terms, held = [], [], 0
        ids.append(r.qid)
        terms.append(r.w)
        held += len(r.w)
    if ids:
        yield ids, terms


def bm25(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    text: str = "text",
    eligible: Column | None = None,
    analyzer: Analyzer = PLAIN,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """(qid, id, score, rank): the ``k`` best documents of every query of ``queries`` (qid, text).

    A term that occurs twice in a query counts twice. ``eligible`` restricts the documents returned. Every text is
    split once: its length and its counts of the queries' terms are written, statistics are taken from them, and
    each task scores its documents against all queries of a block and passes on ``k`` rows per query.
    """
    spark = docs.sparkSession
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    out = spark.createDataFrame([], FOUND)
    for qids, terms in _query_terms(queries, analyzer):
        words = spread(docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), ok.alias("ok"), F.col(text).alias("t")))
        vocabulary = pa.array(sorted({w for t in terms for w in t}))

        def count(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array = vocabulary) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 2000):
                    p = big.slice(at, 2000)
                    w = p.column("w")
                    o = np.asarray(w.offsets, dtype=np.int64)
                    code = pc.index_in(w.values.slice(o[0], o[-1] - o[0]), vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    row = np.repeat(np.arange(p.num_rows), np.diff(o))[code >= 0]
                    key, tf = np.unique(row * len(vocabulary) + code[code >= 0], return_counts=True)
                    ends = np.searchsorted(key, np.arange(p.num_rows + 1) * len(vocabulary)).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % len(vocabulary), tf)]
                    yield pa.RecordBatch.from_arrays([p.column("id"), p.column("ok"), pa.array(np.diff(o)), *lists], names=["id", "ok", "dl", "codes", "tfs"])

        split = words.select("id", "ok", analyzer.column("t").alias("w"))
        counted = materialize(split.mapInArrow(count, "id bigint, ok boolean, dl bigint, codes array<int>, tfs array<int>"), "bm25")
        n, total = counted.agg(F.count("*"), F.sum("dl")).first()
        df = np.zeros(len(vocabulary))
        for r in counted.select(F.explode("codes").alias("c")).groupBy("c").count().toLocalIterator():
            df[r.c] = r["count"]
        of = np.repeat(np.arange(len(qids)), [len(t) for t in terms])
        code = pc.index_in(pa.array([w for t in terms for w in t]), vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        idf_ = np.log1p((n - df + 0.5) / (df + 0.5))
        asked, mean = Asked.of(np.array(qids), of, code, idf_[code], len(vocabulary)), (total or 0) / max(n, 1)

        def run(batches: Iterator[pa.RecordBatch], asked: Asked = asked, mean: float = mean) -> Iterator[pa.RecordBatch]:
            best = no_best(len(asked.ids), k)
            for p in batches:
                o = np.asarray(p.column("codes").offsets, dtype=np.int64)
                row = np.repeat(np.arange(p.num_rows), np.diff(o))
                code, tf = (np.asarray(p.column(c).values)[o[0] : o[-1]] for c in ("codes", "tfs"))
                dl = np.asarray(p.column("dl"))[row]
                weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
                best = asked.search(np.asarray(p.column("id")), row, code, weight, best)
            yield found(asked.ids, *best)

        out = out.unionByName(counted.where("ok AND size(codes) > 0").mapInArrow(run, FOUND))
    return top_per(out, "qid", k)


class LexicalIndex:
    """Postings of a table of texts below ``path``, sorted by term, so that a search reads those of its terms only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.totals = spark.read.parquet(f"{self.path}/totals").first()
        self.analyzer = Analyzer(**json.loads(self.totals.analyzer))

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "id", text: str = "text", analyzer: Analyzer = PLAIN) -> LexicalIndex:
        """Write postings (term, id, tf, dl), terms (term, df) and totals. Ranges of (term, id) part a frequent term's postings."""
        words = spread(docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"))).select("id", analyzer.column("t").alias("w"))
        counts = words.select("id", F.size("w").alias("dl"), F.explode_outer("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        place, options = path.rstrip("/"), {"mode": "overwrite"}
        counts.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{place}/postings", **options)
        postings = docs.sparkSession.read.parquet(f"{place}/postings")
        # A text without words is a row without a term; it counts among the documents.
        postings.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")).sort("term").write.parquet(f"{place}/terms", **options)
        lengths = postings.groupBy("id").agg(F.first("dl").alias("dl"))
        lengths.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.lit(json.dumps(analyzer.describe())).alias("analyzer")).coalesce(1).write.parquet(f"{place}/totals", **options)
        return cls(docs.sparkSession, place)

    def search(self, queries: DataFrame, k: int, eligible: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """(qid, id, score, rank) as :func:`bm25`; ``eligible`` (id) restricts the documents returned."""
        asked = queries.select("qid", F.explode(self.analyzer.column("text")).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("qtf"))
        # Few terms become a filter on the sorted files, many a join.
        names = [r.term for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        pick = F.col("term").isin(names) if len(names) <= PUSHED_TERMS else F.lit(True)
        terms, postings = (self.spark.read.parquet(f"{self.path}/{x}").where(pick) for x in ("terms", "postings"))
        weights = asked.join(terms, "term").select("qid", "term", "qtf", idf(F.lit(float(self.totals.n)), F.col("df").cast("double")).alias("idf"))
        if eligible is not None:
            postings = postings.join(eligible.select("id"), "id", "left_semi")
        mean = float(self.totals.total or 0) / max(self.totals.n, 1)
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
        scored = postings.join(weights, "term").groupBy("qid", "id").agg(F.round(F.sum(part), TIE_PLACES).alias("score"))
        return top_per(scored, "qid", k)


def canonical_sparse(df: DataFrame, id_col: str, sparse: str) -> DataFrame:
    """(id, feature, weight): repeats summed in double precision, zero weights dropped; fields whose arrays
    differ in length count as absent, and so do weights that are negative or not finite."""
    s = F.col(sparse)
    pair = F.arrays_zip(s["indices"].alias("i"), s["values"].alias("v"))
    return (
        df.where(F.size(s["indices"]) == F.size(s["values"]))
        .select(F.col(id_col).alias("id"), F.explode(pair).alias("e"))
        .select("id", F.col("e.i").alias("feature"), F.col("e.v").cast("double").alias("weight"))
        .where("feature IS NOT NULL AND weight >= 0 AND weight < double('Infinity')")
        .groupBy("id", "feature")
        .agg(F.sum("weight").alias("weight"))
        .where("weight > 0")
    )


def _features(column: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of sparse rows; fields whose arrays differ in length are absent, and so are entries
    without a feature or with a weight that is not finite or not above 0."""
    o, p = (np.asarray(c.offsets, dtype=np.int64) for c in (column, values))
    same = np.asarray(column.is_valid()) & np.asarray(values.is_valid()) & (np.diff(o) == np.diff(p))
    n = np.where(same, np.diff(o), 0)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat, w = column.values, values.values.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
    known = np.asarray(flat.is_valid())[o[:-1][row] + inside]
    feature = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[o[:-1][row] + inside]
    weight = w[p[:-1][row] + inside]
    good = known & (weight > 0) & np.isfinite(weight)
    return row[good], feature[good], weight[good]


_SPARSE = ("bigint", "array<bigint>", "array<double>")


def sparse_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): greatest dot products of sparse rows (id, indices, values) with queries (qid, indices, values).

    Repeated indices add up on both sides, as the dot product is linear in each.
    """
    asked = queries.select(*[F.col(c).cast(t).alias(c) for c, t in zip(("qid", "indices", "values"), _SPARSE, strict=True)])
    rows = docs.select(*[F.col(c).cast(t).alias(c) for c, t in zip(("id", "indices", "values"), _SPARSE, strict=True)]).where(F.size("indices") > 0)
    out = docs.sparkSession.createDataFrame([], FOUND)

    def blocks() -> Iterator[list]:
        block, held = [], 0
        for r in asked.where(F.size("indices") > 0).toLocalIterator():
            if block and held + len(r.indices) > QUERY_TERMS:
                yield block
                block, held = [], 0
            block.append(r)
            held += len(r.indices)
        if block:
            yield block

    for block in blocks():
        of, feature, weight = _features(*(pa.array([r[c] for r in block], t) for c, t in ((1, pa.list_(pa.int64())), (2, pa.list_(pa.float64())))))
        vocabulary, code = np.unique(feature, return_inverse=True)
        if not len(vocabulary):
            continue
        queries_ = Asked.of(np.array([r.qid for r in block]), of, code, weight, len(vocabulary))

        def run(batches: Iterator[pa.RecordBatch], asked: Asked = queries_, vocabulary: np.ndarray = vocabulary) -> Iterator[pa.RecordBatch]:
            best = no_best(len(asked.ids), k)
            for b in batches:
                row, feature, weight = _features(b.column("indices"), b.column("values"))
                at = np.minimum(np.searchsorted(vocabulary, feature), len(vocabulary) - 1)
                hit = vocabulary[at] == feature
                best = asked.search(np.asarray(b.column("id")), row[hit], at[hit], weight[hit], best)
            yield found(asked.ids, *best)

        out = out.unionByName(rows.mapInArrow(run, FOUND))
    return top_per(out, "qid", k)


def sparse_dot(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) from (id, feature, weight) and (qid, feature, weight)."""
    asked = queries.select("qid", "feature", F.col("weight").alias("qw"))
    scored = postings.join(asked, "feature").groupBy("qid", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    return top_per(scored, "qid", k)
