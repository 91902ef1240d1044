"""Ordering and cutting of scored rows: greatest score first, ties by ascending id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "id", ascending: bool = False) -> DataFrame:
    """The ``k`` best rows; Spark keeps k per task and merges them (TakeOrderedAndProject)."""
    first = F.col(score).asc() if ascending else F.col(score).desc()
    return scored.orderBy(first, F.col(tie).asc()).limit(k)


def top_per(scored: DataFrame, group: str | list[str], k: int, score: str = "score", tie: str = "id", ascending: bool = False, rank: str = "rank") -> DataFrame:
    """The ``k`` best rows of each group with their ``rank`` from 1.

    The filter on the rank lets each task drop all but its own k rows of a group before the shuffle.
    """
    first = F.col(score).asc() if ascending else F.col(score).desc()
    keys = [group] if isinstance(group, str) else group
    place = F.row_number().over(W.partitionBy(*keys).orderBy(first, F.col(tie).asc()))
    return scored.withColumn(rank, place).where(F.col(rank) <= k)


def group_top_n(ranked: DataFrame, key: str, per_group: int, groups: int, position: str = "position", score: str = "score") -> DataFrame:
    """Up to ``per_group`` rows of each of the ``groups`` whose leading row scores best; ties go to the group seen first.

    ``position`` is the order of the incoming list. Only the leaders are compared across groups.
    """
    inside = F.row_number().over(W.partitionBy(key).orderBy(position))
    kept = ranked.withColumn("place", inside).where(F.col("place") <= per_group)
    leaders = kept.where("place = 1").select(key, F.col(score).alias("_lead"), F.col(position).alias("_seen"))
    best = leaders.orderBy(F.desc("_lead"), F.asc("_seen")).limit(groups)
    order = F.row_number().over(W.orderBy(F.desc("_lead"), F.asc("_seen")))
    return kept.join(best.withColumn("group_rank", order), key).drop("_lead", "_seen")


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def keep_best(best_s: np.ndarray, best_i: np.ndarray, s: np.ndarray, ids: np.ndarray, places: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row's ``best`` scores (k columns, -inf where free) and its scores ``s`` of the rows ``ids``; of ties the lower ids.

    With ``places`` the scores are rounded to them first, but only those that may be kept."""
    k, least = best_s.shape[1], best_s[:, -1].copy()
    free = np.flatnonzero(least == -np.inf)
    if len(free) and s.shape[1] > k:
        least[free] = np.partition(s[free], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    if places is None:
        i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        x = s[i, j]
    else:
        least = np.round(least, places)
        i, j = np.nonzero(s >= (least - 10.0**-places)[:, None])
        x = np.round(s[i, j], places)
        fit = (x >= least[i]) & (x > -np.inf)
        i, j, x = i[fit], j[fit], x[fit]
    n = np.bincount(i, minlength=len(s))
    rows = np.flatnonzero(n)
    if not len(rows):
        return best_s, best_i
    row = np.concatenate([np.repeat(np.arange(len(rows)), k), np.repeat(np.arange(len(rows)), n[rows])])
    score, at = np.concatenate([best_s[rows].ravel(), x]), np.concatenate([best_i[rows].ravel(), ids[j]])
    order = np.lexsort([at, -score, row])
    count = n[rows] + k
    take = order[((np.cumsum(count) - count)[:, None] + np.arange(k))]
    best_s, best_i = best_s.copy(), best_i.copy()
    best_s[rows], best_i[rows] = score[take], at[take]
    return best_s, best_i


def no_best(rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)


class Best:
    """The ``k`` best scores of each row and their ids, of blocks of at most ``block`` ids that arrive one after another.

    Scores are rounded to ``places``; of ties the lower ids are kept. What arrives is gathered beside the best and cut
    only where a row is full, so a large ``k`` costs no sort per block, and a row holds 2 k + block entries.
    """

    def __init__(self, rows: int, k: int, block: int, places: int):
        self.k, self.places, width = k, places, 2 * k + block
        self.s, self.i = np.full((rows, width), -np.inf), np.full((rows, width), np.iinfo(np.int64).max)
        self.held, self.least = np.zeros(rows, np.int64), np.full(rows, -np.inf)

    def add(self, first: int, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores ``s`` of ``ids`` for the rows from ``first`` on; -inf leaves a pair out."""
        own = slice(first, first + len(s))
        i, j = np.nonzero(s >= (self.least[own] - 10.0**-self.places)[:, None])
        x = np.round(s[i, j], self.places)
        fit = (x >= self.least[own][i]) & (x > -np.inf)
        i, j, x = i[fit], j[fit], x[fit]
        n = np.bincount(i, minlength=len(s))
        if (self.held[own] + n > self.s.shape[1]).any():
            self._cut(first + np.flatnonzero(self.held[own] > self.k))
        place = self.held[own][i] + np.arange(len(i)) - (np.cumsum(n) - n)[i]
        self.s[first + i, place], self.i[first + i, place] = x, ids[j]
        self.held[own] += n

    def _cut(self, rows: np.ndarray) -> None:
        for at in range(0, len(rows), 128):
            r = rows[at : at + 128]
            s, i = self.s[r], self.i[r]
            order = np.argpartition(-s, self.k - 1, axis=1)[:, : self.k]
            least = np.take_along_axis(s, order, 1).min(1)
            for t in np.flatnonzero((s >= least[:, None]).sum(1) > self.k):  # ties across the cut
                order[t] = np.lexsort([i[t], -s[t]])[: self.k]
            self.s[r, : self.k], self.i[r, : self.k] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            self.s[r, self.k :], self.i[r, self.k :] = -np.inf, np.iinfo(np.int64).max
            self.held[r], self.least[r] = self.k, least

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), best first; -inf where a row has fewer than ``k``."""
        self._cut(np.flatnonzero(self.held > self.k))
        s, i = self.s[:, : self.k], self.i[:, : self.k]
        order = np.lexsort([i, -s])
        return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
