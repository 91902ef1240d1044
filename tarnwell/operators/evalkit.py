"""Evaluation: ranking metrics, bootstrap, percentiles, fronts, regret and marginal returns."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import materialize


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, recall_at: tuple[int, ...] = (20, 100)) -> DataFrame:
    """(qid, ndcg, mrr, recall_k, recall_20, ...) of a run (qid, id, rank from 1) against grades (qid, id, grade).

    Gains are linear. Queries with grades but no hits score 0.
    """
    good = qrels.where("grade > 0")
    ideal_place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), F.asc("id")))
    ideal = good.withColumn("p", ideal_place).groupBy("qid").agg(
        F.sum(F.when(F.col("p") <= k, F.col("grade") / F.log2(F.col("p") + 1))).alias("ideal"), F.count("*").alias("relevant")
    )
    hits = run.join(good, ["qid", "id"]).groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"),
        *[F.sum((F.col("rank") <= n).cast("bigint")).alias(f"hits_{n}") for n in sorted({k, *recall_at})],
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(hits, "qid", "left").select(
        "qid",
        zero(F.col("dcg") / F.col("ideal")).alias("ndcg"),
        zero(1.0 / F.col("first")).alias("mrr"),
        *[zero(F.col(f"hits_{n}") / F.col("relevant")).alias(f"recall_{n}") for n in sorted({k, *recall_at})],
    )


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): share of the true k ids among the first k found."""
    a = found.where(F.col("rank") <= k).select("qid", "id")
    b = truth.where(F.col("rank") <= k).select("qid", "id")
    # One join, so that the truth, often an exhaustive search, is computed once.
    hit = b.join(a.withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def paired_bootstrap(deltas: np.ndarray, samples: int = 10_000, seed: int = 13) -> dict[str, float]:
    """Mean difference, its 95 % interval, and the two-sided share of resampled means beyond 0."""
    d = np.asarray(deltas, dtype=np.float64)
    rng = np.random.default_rng(seed)
    means = np.array([d[rng.integers(0, len(d), len(d))].mean() for _ in range(samples)]) if len(d) else np.zeros(1)
    low, high = np.quantile(means, [0.025, 0.975])
    beyond = min((means <= 0).mean(), (means >= 0).mean())
    return {"mean": float(d.mean()) if len(d) else 0.0, "low": float(low), "high": float(high), "p": float(min(1.0, 2 * beyond))}


def rank_percentiles(df: DataFrame, group: list[str], value: str, ps: tuple[float, ...]) -> DataFrame:
    """For each p the value at place round(p (n - 1)) of the sorted values of each group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*group).orderBy(value))
    n = F.sum("c").over(W.partitionBy(*group))
    placed = counts.withColumn("upto", upto).withColumn("n", n)
    return placed.groupBy(*group).agg(
        F.max("n").alias("n"),
        *[F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1) + 0.5), F.col(value))).alias(f"p{round(p * 100)}") for p in ps],
    )


def pareto_front(df: DataFrame, quality: str, latency: str, group: list[str] = []) -> DataFrame:
    """Rows that no other row beats in both: better quality at no more latency, or less latency at no less quality."""
    w = W.partitionBy(*group).orderBy(F.desc(quality), F.asc(latency)) if group else W.orderBy(F.desc(quality), F.asc(latency))
    before = F.min(latency).over(w.rowsBetween(W.unboundedPreceding, -1))
    best = df.groupBy(*group, quality).agg(F.min(latency).alias(latency))
    front = best.withColumn("_b", before).where(F.col("_b").isNull() | (F.col(latency) < F.col("_b"))).drop("_b")
    return df.join(front, [*group, quality, latency], "left_semi")


def plan_regret(observations: DataFrame, epsilon_quality: float = 0.0, budget_ms: float | None = None) -> DataFrame:
    """(plan, quality, latency_ms, regret, epsilon_hit, violations) from (plan, qid, quality, latency_ms).

    Regret is the mean shortfall from the best plan of each query; a failed query has quality 0 and counts.
    """
    per = observations.groupBy("plan", "qid").agg(F.avg(F.coalesce("quality", F.lit(0.0))).alias("quality"), F.expr("percentile(latency_ms, 0.5)").alias("latency_ms"))
    best = F.max("quality").over(W.partitionBy("qid"))
    short = per.withColumn("short", best - F.col("quality"))
    over = F.lit(0) if budget_ms is None else (F.col("latency_ms") > budget_ms).cast("int")
    return short.groupBy("plan").agg(
        F.avg("quality").alias("quality"),
        F.avg("latency_ms").alias("latency_ms"),
        F.avg("short").alias("regret"),
        F.avg((F.col("short") <= epsilon_quality).cast("double")).alias("epsilon_hit"),
        F.sum(over).cast("bigint").alias("violations"),
    )


def marginal_returns(df: DataFrame, group: list[str], knob: str, quality: str, latency: str) -> DataFrame:
    """Each setting of a knob with the step to the next one: gain in quality, added latency, and their ratio."""
    w = W.partitionBy(*group).orderBy(knob)
    dq, dl = F.lead(quality).over(w) - F.col(quality), F.lead(latency).over(w) - F.col(latency)
    return df.withColumn("next_knob", F.lead(knob).over(w)).withColumn("quality_gain", dq).withColumn("latency_cost", dl).withColumn(
        "gain_per_ms", F.when(F.col("latency_cost") != 0, F.col("quality_gain") / F.col("latency_cost"))
    )


def best_at_recall(df: DataFrame, thresholds: list[float], quality: str, latency: str, config: str) -> DataFrame:
    """For each threshold the fastest configuration that reaches it."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    return df.select("*", t).where(F.col(quality) >= F.col("threshold")).groupBy("threshold").agg(
        F.min_by(F.col(config), F.struct(latency, config)).alias("config"), F.min(latency).alias("best_latency")
    )


def intrinsic_dimension(neighbours: DataFrame) -> DataFrame:
    """(qid, lid): Hill estimate of the local dimension from the cosines (qid, score) of a query's neighbours."""
    k = neighbours.select("qid", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("dist"))
    far = k.groupBy("qid").agg(F.max("dist").alias("far"))
    return k.join(far, "qid").where("dist > 0 AND dist < far").groupBy("qid").agg((-1 / F.avg(F.log(F.col("dist") / F.col("far")))).alias("lid"))


def query_hardness(log: DataFrame, query: list[str]) -> DataFrame:
    """(query, mean_recall, worst_recall, configs): how well the configurations answer each query."""
    per = log.where("recall IS NOT NULL").groupBy(*query, "config").agg(F.avg("recall").alias("r"))
    return per.groupBy(*query).agg(F.avg("r").alias("mean_recall"), F.min("r").alias("worst_recall"), F.count("*").alias("configs"))


def paired_effects(df: DataFrame, match: list[str], factor: str, base: str, measures: dict[str, str]) -> DataFrame:
    """Mean difference of each measure from the ``base`` level of a factor, over rows that match in everything else."""
    a = df.where(F.col(factor) == base).select(*match, *[F.col(m).alias(f"_{m}") for m in measures])
    b = df.where(F.col(factor) != base)
    return b.join(a, match).groupBy(factor).agg(
        F.count("*").alias("pairs"), *[F.avg(F.col(m) - F.col(f"_{m}")).alias(name) for m, name in measures.items()]
    )


def summarise_journal(events: DataFrame) -> DataFrame:
    """(plan, queries, failures, quality, p90_ms) from journal events (event, plan, qid, quality, elapsed_ms).

    A query that started and did not finish is a failure; failures count with quality 0.
    """
    started = events.where("event = 'query_started'").select("plan", "qid").distinct()
    done = events.where("event = 'query_finished'").groupBy("plan", "qid").agg(F.max("quality").alias("quality"), F.min("elapsed_ms").alias("ms"))
    return started.join(done, ["plan", "qid"], "left").groupBy("plan").agg(
        F.count("*").alias("queries"),
        F.sum(F.col("ms").isNull().cast("bigint")).alias("failures"),
        F.avg(F.coalesce("quality", F.lit(0.0))).alias("quality"),
        F.expr("percentile(ms, 0.9)").alias("p90_ms"),
    )


def split_queries(queries: DataFrame, qid: str, seed: str) -> DataFrame:
    """Half of the queries for development, half for the test, by the order of a digest of seed and id.

    Sorted in ranges of the digest; the place of a query is that in its range plus the sizes of the ranges before.
    """
    keyed = queries.withColumn("_digest", F.sha2(F.concat(F.lit(seed), F.col(qid).cast("string")), 256))
    cut = materialize(keyed.repartitionByRange("_digest").withColumn("_range", F.spark_partition_id()), "split")
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n")).collect()  # one row per range
    before, n = {}, 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        before[r["_range"]], n = n, n + r["_n"]
    above = queries.sparkSession.createDataFrame(list(before.items()), "_range int, _above bigint")
    place = F.row_number().over(W.partitionBy("_range").orderBy("_digest")) + F.col("_above")
    return cut.join(F.broadcast(above), "_range").withColumn("part", F.when(place <= n // 2, "dev").otherwise("test")).select(*queries.columns, "part")


def digest(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def ridge(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0) -> np.ndarray:
    """Weighted ridge regression with an intercept (first, not penalised)."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x)) if weight is None else weight
    reg = penalty * np.eye(a.shape[1])
    reg[0, 0] = 0
    return np.linalg.solve(a.T @ (a * w[:, None]) + reg, a.T @ (w * y))


def permutation_importance(x: np.ndarray, y: np.ndarray, coef: np.ndarray, seed: int = 13) -> np.ndarray:
    """Growth of the squared error when one column is shuffled."""
    rng = np.random.default_rng(seed)
    error = lambda m: float(np.mean((np.column_stack([np.ones(len(m)), m]) @ coef - y) ** 2))
    base, out = error(x), []
    for j in range(x.shape[1]):
        m = x.copy()
        m[:, j] = rng.permutation(m[:, j])
        out.append(error(m) - base)
    return np.array(out)


def expand_grid(axes: dict[str, list]) -> list[dict]:
    """All combinations of the axes' values, in order."""
    out = [{}]
    for name, values in axes.items():
        out = [o | {name: v} for o in out for v in values]
    return out
