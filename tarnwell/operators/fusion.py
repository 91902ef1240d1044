"""Fusion of channel lists, their agreement, and how deep to rerank."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import prepare

RRF_K = 10.0


def channel_lists(lists: list[DataFrame], keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """One table of (keys, channel, id, score, rank from 0) of channel results (keys, id, score); a repeated id
    of a list counts at its best place."""
    prepare(lists[0].sparkSession)
    parts = [df.select(*keys, F.lit(i).alias("channel"), "id", "score") for i, df in enumerate(lists)]
    both = reduce(DataFrame.unionByName, parts)
    best = both.groupBy(*keys, "channel", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy(*keys, "channel").orderBy(F.desc("score"), F.asc("id"))) - 1
    return best.withColumn("rank", place)


def contribution(fusion: str, channels: int, k: float = RRF_K, weights: list[float] | None = None) -> Column:
    """What a row of a channel list adds to its record's total."""
    if fusion == "rrf":
        if not math.isfinite(k) or k < 0:
            raise ValueError("k must be finite and not negative")
        return F.lit(1.0) / (F.lit(float(k)) + F.col("rank") + 1)
    if fusion == "weighted":
        if weights is None or len(weights) != channels or not any(weights) or any(not math.isfinite(w) or w < 0 for w in weights):
            raise ValueError("one finite weight per channel, none negative and not all 0")
        w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("channel") + 1)
        return w * F.col("score")
    raise ValueError(f"unknown fusion: {fusion}")


def fuse(lists: list[DataFrame], fusion: str = "rrf", k: float = RRF_K, weights: list[float] | None = None, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, id, score, sources): records by their total, with the channels they came from.

    A single list under reciprocal ranks keeps its own scores.
    """
    ranked = channel_lists(lists, keys)
    add = F.col("score") if fusion == "rrf" and len(lists) == 1 else contribution(fusion, len(lists), k, weights)
    # A record holds at most one row per channel, so the list of its parts is bounded; added up in channel order.
    parts = F.sort_array(F.collect_list(F.struct("channel", add.alias("x"))))
    return ranked.groupBy(*keys, "id").agg(parts.alias("p")).select(
        *keys, "id",
        F.aggregate("p", F.lit(0.0), lambda s, e: s + e["x"]).alias("score"),
        F.transform("p", lambda e: e["channel"]).alias("sources"),
    )


def agreement(lists: list[DataFrame], limit: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, agreement): the least Jaccard overlap of the ``limit`` best ids of channel 0 with those of another."""
    if len(lists) < 2:
        raise ValueError("agreement needs two channels")
    tops = channel_lists(lists, keys).where(F.col("rank") < limit).groupBy(*keys, "channel").agg(F.collect_set("id").alias("ids"))
    first = tops.where("channel = 0").select(*keys, F.col("ids").alias("a"))
    rest = tops.where("channel > 0").select(*keys, F.col("channel"), F.col("ids").alias("b"))
    every = first.withColumn("channel", F.explode(F.array(*[F.lit(i) for i in range(1, len(lists))])))
    overlap = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return every.join(rest, [*keys, "channel"], "left").groupBy(*keys).agg(F.min(F.coalesce(overlap, F.lit(0.0))).alias("agreement"))


def rerank_depth(agreed: float, limit: int, min_candidates: int, threshold: float) -> int:
    """Candidates to rerank: few where the channels agree."""
    return min_candidates if agreed >= threshold else limit


def signals(ranked: DataFrame, limit: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, margin, spread): score of the first less the second, and of the first less the last of the list."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    placed = ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    at = lambda p: F.max(F.when(F.col("place") == p, F.col("score")))
    return placed.groupBy(*keys).agg(
        F.coalesce(at(1) - at(2), F.lit(0.0)).alias("margin"), (F.max("score") - F.min("score")).alias("spread")
    )
