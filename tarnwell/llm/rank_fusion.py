"""Problem 6: one ranking from several scores on scales that do not compare.

Reciprocal rank fusion: each channel ranks its records by its own score, a record's total is the sum
of 1 / (k + rank) over the channels that hold it (rank from 1), and totals give the ranking. Only
ranks cross channels, so the size of a channel's numbers cannot decide anything.

Cases: hits without query, channel or record, and scores that are null, NaN or infinite do not
count; a record counts once per channel, at its best score; equal scores and equal totals are
ordered by record number; a query with no hit that counts has no ranking; repeated rows change
nothing; an empty table gives an empty ranking; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import materialize

#: Channels in which a smaller score is better.
SMALLER_IS_BETTER = ("dense_l2",)
#: Where a query has more hits than this, hits are ranked in ranges of (query, score) that many tasks share.
HOT_GROUP = 200_000
#: The constant of reciprocal ranks.
K = 60.0


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def best_hits(hits: DataFrame, smaller: tuple[str, ...] = SMALLER_IS_BETTER) -> DataFrame:
    """One row per (query, channel, record) with ``merit``: its best score, turned so that larger is better."""
    merit = F.when(F.col("channel").isin(*smaller), -F.col("raw_score")).otherwise(F.col("raw_score"))
    return (
        hits.where(
            F.col("query_id").isNotNull() & F.col("channel").isNotNull() & F.col("number").isNotNull() & finite(F.col("raw_score"))
        )
        .groupBy("query_id", "channel", "number")
        .agg(F.max(merit).alias("merit"))
    )


def ranked(df: DataFrame, group: list[str], score: str, tie: str, out: str) -> DataFrame:
    """``out``: place from 1 within ``group`` by ``score`` descending, then ``tie`` ascending, for groups of any size.

    Rows are cut into ranges of (group, score, tie), so a hot group spans many ranges even where all its scores are
    equal; a row's place is that inside its range plus what the group has in the ranges before. The ranges are written
    first, since both parts of the sum must see the same cuts.
    """
    cut = df.repartitionByRange(*group, F.desc(score), F.asc(tie)).withColumn("_range", F.spark_partition_id())
    cut = materialize(cut, "p6-ranges")
    held = cut.groupBy(*group, "_range").agg(F.count("*").alias("_in"))
    before = F.sum("_in").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    above = held.withColumn("_above", before).where("_above > 0").drop("_in")
    place = F.row_number().over(W.partitionBy(*group, "_range").orderBy(F.col(score).desc(), F.col(tie).asc()))
    return (
        cut.withColumn("_place", place)
        .join(above, [*group, "_range"], "left")
        .withColumn(out, (F.col("_place") + F.coalesce("_above", F.lit(0))).cast("bigint"))
        .drop("_place", "_above", "_range")
    )


def _window_place(df: DataFrame, group: list[str], score: str, tie: str, out: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie).asc()))
    return df.withColumn(out, place.cast("bigint"))


def reciprocal_rank_fusion(hits: DataFrame, k: float = K, hot: int = HOT_GROUP) -> DataFrame:
    """(query_id, number, total, position, channels, of_channels, worst_rank).

    ``channels`` counts the channels that hold the record, ``of_channels`` those in which the query
    has hits, ``worst_rank`` is the record's worst place among its channels.

    One small count decides the plan. Where no query has more than ``hot`` hits, the hits are hashed
    by query once and every later step (best hit, channel rank, total, position) works inside that
    partitioning without another shuffle. Otherwise each step aggregates before it shuffles and ranks
    in ranges (:func:`ranked`).
    """
    if hits.groupBy("query_id").count().where(F.col("count") > hot).isEmpty():
        hits, place = hits.select("query_id", "channel", "number", "raw_score").repartition("query_id"), _window_place
    else:
        place = ranked
    in_channel = place(best_hits(hits), ["query_id", "channel"], "merit", "number", "channel_rank")
    fused = in_channel.groupBy("query_id", "number").agg(
        # Rounded, so that the order in which parts are added cannot part equal totals.
        F.round(F.sum(1.0 / (F.lit(k) + F.col("channel_rank"))), 12).alias("total"),
        F.count("*").alias("channels"),
        F.max("channel_rank").alias("worst_rank"),
        F.sum(F.when(F.col("channel_rank") == 1, 1).otherwise(0)).alias("_firsts"),
    )
    # Every channel with hits has exactly one record at place 1, so these add up to the query's channels.
    if place is _window_place:
        placed = place(fused, ["query_id"], "total", "number", "position").withColumn(
            "of_channels", F.sum("_firsts").over(W.partitionBy("query_id"))
        )
    else:
        width = fused.groupBy("query_id").agg(F.sum("_firsts").alias("of_channels"))
        placed = place(fused, ["query_id"], "total", "number", "position").join(width, "query_id")
    return placed.select("query_id", "number", "total", "position", "channels", "of_channels", "worst_rank")


def last_place(within: int, k: float) -> int:
    """The last place of the fused ranking that a record among the ``within`` best of all c channels can take.

    Its total is at least c / (k + within). Ranks in a channel are distinct, so m records have at most
    c * (1 / (k + 1) + ... + 1 / (k + m)) together, and no more can reach that total than the greatest m for which
    the mean of 1 / (k + rank) over ranks 1 to m does.
    """
    m, reached = 0, 0.0
    while reached + 1 / (k + m + 1) >= (m + 1) / (k + within) - 1e-9:
        m += 1
        reached += 1 / (k + m)
    return m


def unanimous_leaders(ranking: DataFrame, within: int = 2, k: float = K) -> DataFrame:
    """Records among the ``within`` best of every channel of a query that has at least two channels.

    The fused ranking names the candidates: totals of at least channels / (k + within), which only the first
    :func:`last_place` places can have. Their ranks are then checked one by one.
    """
    total = F.col("total") >= F.col("of_channels") / F.lit(k + within) - 1e-9
    candidates = ranking.where(total & (F.col("position") <= last_place(within, k)))
    return candidates.where(
        (F.col("of_channels") >= 2) & (F.col("channels") == F.col("of_channels")) & (F.col("worst_rank") <= within)
    ).select("query_id", "number")
