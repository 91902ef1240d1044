"""Recall of the nearest vectors against all blocks with all: python -m tarnwell.llm.recall FOLDER."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import similar
from tarnwell.llm.queries import current
from tarnwell.sources.tables import table


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> tuple[float, float, int]:
    """(mean, least, searches) of the share of ``exact`` that ``found`` holds, per searching vector."""
    hit = exact.join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left").groupBy("kind", "id", "no").agg(
        (F.count("hit") / F.count("*")).alias("recall")
    )
    return hit.agg(F.avg("recall"), F.min("recall"), F.count("*")).first()


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tables = table(spark, folder, "snapshot_points"), table(spark, folder, "query_requests")
    keys = ["kind", "id", "no", "other"]
    found, exact = (similar.nearest_points(*tables, exact=e) for e in (False, True))
    for kind in ("point", "query"):
        print(kind, *recall(found, exact.where(F.col("kind") == kind), keys), flush=True)
    records = current(spark, folder, "vectors")
    found, exact = (similar.nearest_tokens(records, exact=e) for e in (False, True))
    print("token", *recall(found, exact, [*keys, "other_no"]))


if __name__ == "__main__":
    main(sys.argv[1])
