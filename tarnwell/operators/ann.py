"""Approximate search over inverted lists: centroids, a table partitioned by them, and probing.

The knobs are the number of lists probed and the number of candidates; every score returned is
exact. A filter is applied before probing, deleted ids are anti-joined, rows written after the build
are scored exactly beside the lists, and probing every list equals the exact search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.vectors import doubles, normalise, sort_key
from tarnwell.operators import dense
from tarnwell.operators.dense import literal
from tarnwell.operators.quantize import train_centroids, unit
from tarnwell.operators.topk import keep_best, no_best, top, top_per
from tarnwell.session import read_text, remove, write_new

#: Rows read to fit centroids, whatever the size of the table.
TRAINING_ROWS = 65_536
#: Lists at most, where their number follows from the rows.
MOST_LISTS = 4096


@dataclass(frozen=True)
class AnnOptions:
    nprobe: int = 8
    candidate_budget: int | None = None
    rerank_factor: int = 4
    adaptive_threshold: float | None = None


@dataclass
class IvfIndex:
    """Lists of a table (id, vector[, other columns]) below ``path``, one directory per list, with the model beside them."""

    path: str
    centroids: np.ndarray
    metric: str
    generation: int = 0
    name: str | None = None

    @classmethod
    def build(
        cls, df: DataFrame, path: str, lists: int | None = None, metric: str = "cosine", iterations: int = 10, generation: int = 0, name: str | None = None
    ) -> IvfIndex:
        """Fit on at most TRAINING_ROWS rows (those with the smallest hashes) and write every row to its list.

        Without ``lists`` there are as many as the root of the rows, at most MOST_LISTS. Rows are written in ranges of
        (list, id), so a list that holds a large share of them becomes several tasks and files.
        """
        usable = df.where(F.col("vector").isNotNull())
        n = usable.count()
        lists = lists or min(MOST_LISTS, max(1, round(n**0.5)))
        step = max(1, n // TRAINING_ROWS)
        sample = usable.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).orderBy(F.xxhash64("id"), "id").limit(TRAINING_ROWS).select("vector").toArrow()
        v = sample.column("vector").combine_chunks()
        x = np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), -1 if len(v) else 0)
        lists = max(1, min(lists, len(x)))
        if metric == "cosine":
            c = train_centroids(x, lists, iterations)
        else:
            c = x[np.arange(lists) * len(x) // lists].copy()
            for _ in range(iterations):
                at = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1) if len(x) * lists < 2_000_000 else np.array([((r - c) ** 2).sum(1).argmin() for r in x])
                c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(lists)])
        index = cls(path, c, metric, generation, name)
        index.assign(usable).repartitionByRange("list", "id").write.mode("overwrite").partitionBy("list").parquet(path)
        model = {"centroids": c.tolist(), "metric": metric, "generation": generation, "name": name}
        remove(df.sparkSession, f"{path}/_model.json")
        write_new(df.sparkSession, f"{path}/_model.json", json.dumps(model))
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex | None:
        """The index that a finished build left at ``path``."""
        text = read_text(spark, f"{path}/_model.json")
        if text is None:
            return None
        m = json.loads(text)
        return cls(path, np.array(m["centroids"], dtype=np.float64), m["metric"], m["generation"], m["name"])

    def assign(self, df: DataFrame) -> DataFrame:
        c, cosine = self.centroids, self.metric == "cosine"

        @F.pandas_udf("int")
        def nearest_list(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), dtype=np.float64)
            x = unit(x) if cosine else x
            d = (c * c).sum(1)[None, :] - 2 * x @ c.T
            return pd.Series(d.argmin(1))

        return df.withColumn("list", nearest_list("vector"))

    def probe(self, query: list[float], nprobe: int) -> list[int]:
        q = np.array(query, dtype=np.float64)
        if self.metric == "cosine":
            q = unit(q)
        d = -(self.centroids @ q) if self.metric == "dot" else ((self.centroids - q) ** 2).sum(1)
        return [int(i) for i in np.argsort(d, kind="stable")[:nprobe]]

    def search(
        self,
        spark: SparkSession,
        query: list[float],
        k: int,
        options: AnnOptions = AnnOptions(),
        eligible: Column | None = None,
        tombstones: DataFrame | None = None,
        delta: DataFrame | None = None,
    ) -> DataFrame:
        """(id, sort_key): the ``k`` nearest rows of the probed lists, minus ``tombstones``, plus ``delta``.

        The list of probed directories is a literal filter on the partition column, so only they are read.
        """
        rows = spark.read.parquet(self.path).where(F.col("list").isin(self.probe(query, options.nprobe)))
        if tombstones is not None:
            rows = rows.join(tombstones.select("id"), "id", "left_anti")
        if eligible is not None:
            rows = rows.where(F.coalesce(eligible, F.lit(False)))
        if delta is not None:
            fresh = delta if eligible is None else delta.where(F.coalesce(eligible, F.lit(False)))
            rows = rows.select("id", "vector").unionByName(fresh.select("id", "vector"))
        key = sort_key(self.metric, "vector", literal(query))
        return top(rows.select("id", key.alias("sort_key")), k, "sort_key", ascending=True)

    def search_batch(self, spark: SparkSession, queries: DataFrame, k: int, nprobe: int, eligible: Column | None = None) -> DataFrame:
        """(qid, id, score, rank): the ``k`` rows of greatest cosine or dot product in the probed lists of every query (qid, vector).

        Queries are taken in blocks; each task multiplies the rows of a list with the queries that probe it and
        passes on k rows per query. Scores that agree to TIE_PLACES are ties and go to the lower id.
        """
        if self.metric == "euclidean":
            raise ValueError("batches are searched by cosine or dot product")
        cosine = self.metric == "cosine"
        rows = spark.read.parquet(self.path)
        if eligible is not None:
            rows = rows.where(F.coalesce(eligible, F.lit(False)))
        rows = rows.select(F.col("id").cast("bigint").alias("id"), "list", (normalise("vector") if cosine else doubles("vector")).alias("v"))
        out = spark.createDataFrame([], dense.FOUND)
        for ids, q in dense._blocks(queries, "qid", "vector", cosine, k):
            # Probes as in ``probe``: the nearest centroids by distance, the first of equals.
            probed = [[] for _ in self.centroids]
            gap = (self.centroids * self.centroids).sum(1) if cosine else np.zeros(len(self.centroids))
            for at in range(0, len(q), 4096):
                near = np.argsort(gap - 2 * q[at : at + 4096] @ self.centroids.T, axis=1, kind="stable")[:, :nprobe]
                for i, lists in enumerate(near, at):
                    for c in lists:
                        probed[c].append(i)
            asked = [np.array(x, dtype=np.int64) for x in probed]

            def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q, asked=asked) -> Iterator[pa.RecordBatch]:
                best_s, best_i = no_best(len(ids), k)
                for big in batches:
                    for at in range(0, big.num_rows, 4096):
                        b = big.slice(at, 4096)
                        o = np.asarray(b.column("v").offsets)
                        x = np.asarray(b.column("v").values)[o[0] : o[-1]].reshape(b.num_rows, -1)
                        of, i = np.asarray(b.column("list")), np.asarray(b.column("id"))
                        for c in np.unique(of):
                            held = of == c
                            for part in range(0, len(asked[c]), 256):
                                a = asked[c][part : part + 256]
                                best_s[a], best_i[a] = keep_best(best_s[a], best_i[a], q[a] @ x[held].T, i[held], dense.TIE_PLACES)
                yield dense.found(ids, best_s, best_i)

            out = out.unionByName(rows.mapInArrow(run, dense.FOUND))
        return top_per(out, "qid", k)

    def search_widening(self, spark: SparkSession, query: list[float], k: int, target: int, options: AnnOptions = AnnOptions(), **kw) -> tuple[list, str]:
        """(rows, backend): search, once more with wider probing where fewer than ``target`` rows or a poor best
        one came back, and exactly (all lists) where that is not enough either."""
        n = len(self.centroids)
        for nprobe, backend in ((options.nprobe, "ivf"), (min(n, max(2 * options.nprobe, options.nprobe + 1)), "ivf_wider"), (n, "exact")):
            rows = self.search(spark, query, k, AnnOptions(nprobe=nprobe), **kw).collect()
            poor = options.adaptive_threshold is not None and rows and rows[0].sort_key > options.adaptive_threshold
            if len(rows) >= target and not poor:
                break
        return rows, backend

    def search_pruned(self, spark: SparkSession, query: list[float], k: int, eligible: Column | None = None) -> tuple[DataFrame, list[int]]:
        """(rows, lists read): the exact ``k`` nearest, without reading lists that cannot hold one of them.

        The k-th distance within the nearest lists bounds the answer; by the triangle inequality a list whose
        centroid is farther than that plus its radius holds nothing nearer. Not for dot products.
        """
        if self.metric == "dot":
            raise ValueError("dot products obey no triangle inequality")
        q = np.array(query, dtype=np.float64)
        q = unit(q) if self.metric == "cosine" else q
        size = {r["list"]: (r.rows, r.radius) for r in self.stats(spark).collect()}
        near, held = [], 0
        for i in self.probe(query, len(self.centroids)):
            near.append(i)
            held += size.get(i, (0, 0.0))[0]
            if held >= k:
                break
        first = self.search(spark, query, k, AnnOptions(nprobe=len(near)), eligible).collect()
        # A cosine distance of d is a chord of length sqrt(2 d) between unit vectors.
        worst = np.inf if len(first) < k else np.sqrt(max(0.0, (2 if self.metric == "cosine" else 1) * first[-1].sort_key))
        gap = np.linalg.norm(self.centroids - q, axis=1)
        lists = [i for i, (_, radius) in sorted(size.items()) if gap[i] - radius <= worst + 1e-9]
        rows = spark.read.parquet(self.path).where(F.col("list").isin(lists))
        if eligible is not None:
            rows = rows.where(F.coalesce(eligible, F.lit(False)))
        return top(rows.select("id", sort_key(self.metric, "vector", literal(query)).alias("sort_key")), k, "sort_key", ascending=True), lists

    def probe_report(self, spark: SparkSession, query: list[float], nprobe: int) -> DataFrame:
        """One row: lists probed, rows scored and rows left unread."""
        probed = F.col("list").isin(self.probe(query, nprobe))
        return spark.read.parquet(self.path).groupBy("list").count().agg(
            F.count(F.when(probed, 1)).alias("lists"), F.coalesce(F.sum(F.when(probed, F.col("count"))), F.lit(0)).alias("scored"),
            F.coalesce(F.sum(F.when(~probed, F.col("count"))), F.lit(0)).alias("unread"),
        )

    def stats(self, spark: SparkSession) -> DataFrame:
        """(list, rows, radius): size of each list and the greatest distance of its rows from the centroid."""
        c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(self.centroids)], "list int, centre array<double>")
        v = normalise("vector") if self.metric == "cosine" else F.col("vector")
        far = sort_key("euclidean", v, "centre")
        return spark.read.parquet(self.path).join(F.broadcast(c), "list").groupBy("list").agg(
            F.count("*").alias("rows"), F.sqrt(F.max(far)).alias("radius")
        )


def overlay(base: DataFrame, tombstones: DataFrame, delta: DataFrame, k: int) -> DataFrame:
    """Scores (id, sort_key) of a base less deleted and replaced ids, joined by those of the rows written since."""
    gone = tombstones.select("id").unionByName(delta.select("id")).distinct()
    return top(base.join(gone, "id", "left_anti").unionByName(delta.select("id", "sort_key")), k, "sort_key", ascending=True)


def lsh_candidates(df: DataFrame, vector: str, bucket_length: float = 2.0, tables: int = 4):
    """Spark's projection hashing for squared distance: (model, hashed table) for ``approxNearestNeighbors``."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_v", array_to_vector(vector))
    lsh = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket_length, numHashTables=tables, seed=13)
    return lsh.fit(ready), ready


def stale(index: IvfIndex, generation: int) -> bool:
    """An index answers only for the generation it was built from."""
    return index.generation != generation


def needs_rebuild(live_base: int, delta: int, fraction: float = 0.2) -> bool:
    return delta > fraction * max(1, live_base)
