"""Problem 1: how strongly each word and each sparse index marks its record.

Score: log-odds ratio of the record against the rest of the collection under an informative
Dirichlet prior taken from the collection's counts, divided by its standard error (a z-score). With
y the record's count of a term, n the record's total, Y and N the same for the collection and
a = prior * Y the prior's share of the term (a0 = prior * N in all)::

    delta = ln((y + a) / (n + a0 - y - a)) - ln((Y - y + a) / (N - n + a0 - Y + y - a))
    z     = delta / sqrt(1 / (y + a) + 1 / (Y - y + a))

z is positive exactly where the term is more frequent in the record than in the collection. Words
and indices are separate vocabularies (``kind``); an index counts with its weight.

Cases: null and empty texts have no words; a sparse field that is null or whose arrays differ in
length is absent; repeated indices add up, null or non-finite weights count as 0 and terms whose
weight is not above 0 do not occur; equal scores are ordered by term; rows without number are left
out and of repeated rows of a record the current one counts, once; a collection of one record gives
z = 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.llm.words import words
from tarnwell.session import materialize

#: The prior weighs as much as this share of the collection.
PRIOR = 0.01


def word_postings(records: DataFrame) -> DataFrame:
    """(number, kind, term, y, n): how often each word occurs in each record.

    The outer form of explode keeps Spark from inferring a filter on the array, which would split every
    text a second time.
    """
    split = records.select("number", words("text").alias("w")).select(
        "number", F.size("w").cast("double").alias("n"), F.explode_outer("w").alias("term")
    ).where("term IS NOT NULL")
    return split.groupBy("number", "n", "term").agg(F.count("*").cast("double").alias("y")).select(
        "number", F.lit("word").alias("kind"), "term", "y", "n"
    )


def index_postings(records: DataFrame) -> DataFrame:
    """(number, kind, term, y, n): the summed weight of each sparse index of each record."""
    sparse = F.col("sparse")
    weight = F.col("e.w").cast("double")
    good = weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) != float("inf"))
    return (
        records.where(F.size(sparse["indices"]) == F.size(sparse["values"]))
        .select("number", F.explode(F.arrays_zip(sparse["indices"].alias("i"), sparse["values"].alias("w"))).alias("e"))
        .select("number", F.col("e.i").alias("i"), F.when(good, weight).otherwise(0.0).alias("w"))
        .where(F.col("i").isNotNull())
        .groupBy("number", "i")
        .agg(F.sum("w").alias("y"))
        .where(F.col("y") > 0)
        .withColumn("n", F.sum("y").over(W.partitionBy("number")))
        .select("number", F.lit("index").alias("kind"), F.col("i").cast("string").alias("term"), "y", "n")
    )


def counted(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, stats): how often each term occurs in each record, and over all of them (kind, term, Y, df).

    Both are written, so that every text is split once however often they are read. Collection counts are
    aggregated on the map side before they shuffle: a word that occurs in every record arrives once per task.
    """
    postings = materialize(word_postings(records).unionByName(index_postings(records)), "p1-postings")
    stats = postings.groupBy("kind", "term").agg(F.sum("y").alias("Y"), F.count("*").alias("df"))
    return postings, materialize(stats, "p1-stats")


def log_odds(y: Column, n: Column, rest: Column, n_all: Column, prior: float) -> Column:
    """The z-score of a term that occurs ``y`` times among the record's ``n`` and ``rest`` times in other records."""
    a, a0 = (y + rest) * prior, n_all * prior
    inside = F.greatest(n + a0 - y - a, F.lit(1e-12))
    others = F.greatest(n_all - n + a0 - rest - a, F.lit(1e-12))
    delta = F.log((y + a) / inside) - F.log((rest + a) / others)
    return delta / F.sqrt(1.0 / (y + a) + 1.0 / (rest + a))


def scored(postings: DataFrame, stats: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(number, kind, term, y, n, df, score) for every term of every record.

    The join of the counts is an equi-join on (kind, term) that adaptive execution splits where a frequent word
    makes a partition large, or broadcasts after measuring the counts. The two-row table of collection totals is
    the only fixed broadcast.
    """
    totals = stats.groupBy("kind").agg(F.sum("Y").alias("N_all"))
    # The rest's count is a difference of sums of doubles; what rounding leaves below 0 is 0.
    return (
        postings.join(stats.withColumnRenamed("Y", "Y_all"), ["kind", "term"])
        .join(F.broadcast(totals), "kind")
        .withColumn("rest", F.greatest(F.col("Y_all") - F.col("y"), F.lit(0.0)))
        .select("number", "kind", "term", "y", "n", "df", log_odds(F.col("y"), F.col("n"), F.col("rest"), F.col("N_all"), prior).alias("score"))
    )


def term_scores(records: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(number, kind, term, y, n, df, score) for every term of every record (rows: current records)."""
    return scored(*counted(records), prior)


#: Quarter octaves of a record's total for which the least score is tabulated, and steps of the rest's count.
OCTAVES, STEPS = range(-80, 240), 48


def least_scores(least: np.ndarray, n: tuple[np.ndarray, np.ndarray], n_all: float, most: float, prior: float) -> np.ndarray:
    """A lower bound of the z-score for counts from ``least`` on, totals between the two arrays of ``n`` and rests up to ``most``.

    The log-odds rise with the count and fall with the rest and the total; what they are multiplied with rises with
    count and rest. So over a step of the rest the least product is that of the log-odds at its end and the factor
    at its start; where the log-odds are negative, the factor is below the root of the rest's count with its prior.
    """
    low_n, high_n = (np.minimum(x, n_all) for x in n)
    at = np.concatenate([[0.0], np.geomspace(0.01, max(most, 0.02), STEPS)])
    y, start, end = least[:, None], at[None, :-1], at[None, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        a, a0 = (y + end) * prior, n_all * prior
        inside = np.maximum(high_n[:, None] + a0 - y - a, 1e-12)
        others = np.maximum(n_all - high_n[:, None] + a0 - end - a, 1e-12)
        delta = np.log((y + a) / inside) - np.log((end + a) / others)
        b = (y + start) * prior
        factor = 1 / np.sqrt(1 / (y + b) + 1 / (start + b))
        beyond = np.sqrt(end * (1 + prior) + prior * high_n[:, None])
        bound = np.nan_to_num(np.where(delta >= 0, delta * factor, delta * beyond), nan=-np.inf, neginf=-np.inf).min(1)
    return np.where(low_n > 0, bound - 1e-6 * (1 + np.abs(bound)), -np.inf)


def score_floors(stats: DataFrame, least_count: float, least_share: float, most_records: int, prior: float) -> DataFrame:
    """(kind, octave, floor): the least score of a term that occurs often enough in a record of that size and in
    at most ``most_records`` records. Two rows of totals are read; the table has 2 * len(OCTAVES) rows."""
    few = F.max(F.when(F.col("df") <= most_records, F.col("Y")))
    edges = 2.0 ** (np.array([*OCTAVES, OCTAVES.stop]) / 4)
    low, high = edges[:-1].copy(), edges[1:].copy()
    low[0], high[-1] = 0.0, np.inf
    rows = []
    for r in stats.groupBy("kind").agg(F.sum("Y").alias("all"), few.alias("most")).collect():
        least = np.full(len(low), float(least_count)) if r.kind == "word" else least_share * low
        bounds = least_scores(least, (low, high), r["all"], r.most or 0.0, prior)
        rows += [(r.kind, o, float(x)) for o, x in zip(OCTAVES, bounds, strict=True)]
    return stats.sparkSession.createDataFrame(rows, "kind string, octave int, floor double")


def marking_terms(
    records: DataFrame, least_count: int = 3, least_share: float = 0.25, most_records: int = 12, prior: float = PRIOR
) -> DataFrame:
    """(number, term): terms that occur often enough in the record and in few records.

    All terms are scored, and those whose score such a term can have in a record of that size
    (:func:`score_floors`) are the candidates; they are written, and their counts are then checked one by one.
    """
    postings, stats = counted(records)
    floors = score_floors(stats, least_count, least_share, most_records, prior)
    octave = F.greatest(F.least(F.floor(4 * F.log2("n")), F.lit(OCTAVES.stop - 1)), F.lit(OCTAVES.start)).cast("int")
    scores = scored(postings, stats, prior).withColumn("octave", octave)
    high = scores.join(F.broadcast(floors), ["kind", "octave"]).where(F.col("score") >= F.col("floor"))
    candidates = materialize(high.select("number", "kind", "term", "y", "n", "df", "score"), "p1-candidates")
    enough = F.when(F.col("kind") == "word", F.col("y") >= least_count).otherwise(F.col("y") >= least_share * F.col("n"))
    return candidates.where(enough & (F.col("df") <= most_records)).select("number", "term").dropDuplicates()


def top_terms(scores: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` terms of highest score per record and kind, with their place; scores that agree to six places are ties."""
    w = W.partitionBy("number", "kind").orderBy(F.col("score").desc(), F.col("term").asc())
    return scores.withColumns({c: F.round(c, 6) for c in ("y", "n", "score")}).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
