"""Readers of the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per non-null ``key``: the one with the greatest ``order`` columns.

    Rank-one filtering lets Spark drop the losers of each input split before the shuffle
    (WindowGroupLimit), so a key that holds a large share of all rows does not pile up in one task.
    """
    w = W.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where its scan has at most half as many.

    A scan has that few only if all of it is smaller than cores * ``spark.sql.files.maxPartitionBytes``, so what is
    shuffled is small, and costly expressions over a small file are not the work of one task. Larger tables are
    left as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
