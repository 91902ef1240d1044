"""Queries of this package and their SQL, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import communities, distinctive, leakage, packing, quantiles, rank_fusion, repetition, similar, splitting
from tarnwell.llm.sql import oracle_sql as oracle_sql
from tarnwell.llm.words import word_count
from tarnwell.sources.tables import latest, spread, table

#: Ranks of byte pairs of a public tokenizer; a parameter of the queries that measure in tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current rows of retrieval_docs with the columns named."""
    return latest(table(spark, d, "retrieval_docs").select("number", "seq", *columns), "number", "seq")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.top_terms(distinctive.term_scores(current(spark, d, "text", "sparse")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.marking_terms(current(spark, d, "text", "sparse"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    points = similar.nearest_points(table(spark, d, "snapshot_points"), table(spark, d, "query_requests"))
    records = similar.nearest_tokens(current(spark, d, "vectors"))
    return points.withColumn("other_no", F.lit(0)).unionByName(records)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    points = similar.similar_points(table(spark, d, "snapshot_points"), table(spark, d, "query_requests"))
    return points.expanded().unionByName(similar.similar_records(current(spark, d, "vectors")).expanded())


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """The nearest without loss, all blocks against all."""
    points = similar.nearest_points(table(spark, d, "snapshot_points"), table(spark, d, "query_requests"), exact=True)
    both = points.withColumn("other_no", F.lit(0)).unionByName(similar.nearest_tokens(current(spark, d, "vectors"), exact=True))
    return both.drop("cosine")


def _clusters(spark: SparkSession, d: str):
    k = table(spark, d, "index_config").where("collection = 'retrieval_docs'").select("centroids").first()[0]
    return communities.clusters(current(spark, d, "vectors"), k)


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return communities.describe(*_clusters(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return communities.membership(_clusters(spark, d)[0])


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.run_percentiles(table(spark, d, "query_log"), (0.5, 0.95, 0.99))


def p4_collections(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.rollup_percentiles(table(spark, d, "query_log"), "collection")


def p4_days(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.rollup_percentiles(table(spark, d, "query_log"), "day")


def p4_settled(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "query_log")
    kinds = {"run": "run_id", "collection": "collection", "day": "day"}
    parts = [
        quantiles.settled(log, by).select(F.lit(kind).alias("kind"), F.col(by).cast("string").alias("of"), "n", "p50", "p99") for kind, by in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.misstated_runs(table(spark, d, "query_log"), table(spark, d, "run_reports"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(current(spark, d, "id", "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.paragraph_breaks(splitting.split(current(spark, d, "id", "text")))


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.reciprocal_rank_fusion(table(spark, d, "channel_hits")).withColumn("total", F.round("total", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.unanimous_leaders(rank_fusion.reciprocal_rank_fusion(table(spark, d, "channel_hits")))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p7_containers(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = packing.token_sizes(texts(spark, d), "doc_id", "text", tokenizer)
    return packing.fill_containers(sizes, "id", F.col("tokens"), items=table(spark, d, "documents").count()).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.fill_containers(texts(spark, d), "doc_id", word_count("text"))
    return packed.where("oversized").select(F.col("id").alias("doc_id")).distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(texts(spark, d), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    corpus = texts(spark, d)
    return leakage.without_leaks(corpus, leakage.leaks(corpus, table(spark, d, "eval_items"))).select("doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_measures(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure(texts(spark, d), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure(texts(spark, d), "doc_id", "text").where("bad_repeat_share").select("doc_id")


def queries() -> dict[str, Query]:
    found = [
        p1_found, p1_scores, p2_found, p2_neighbours, p2_exact, p3_found, p3_clusters, p4_found, p4_runs, p4_collections, p4_days, p4_settled,
        p5_found, p5_pieces, p6_found, p6_ranking, p7_found, p7_containers, p8_found, p8_leaks, p8_clean, p9_found, p9_measures,
    ]
    return {f.__name__: f for f in found}
