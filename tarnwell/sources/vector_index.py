"""A folder of vectors with text ids, searched by dot product."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.dense import search


class VectorIndex:
    """Rows (position, name, vector) in Parquet, numbered in the order given."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, spark: SparkSession, path: str, rows: list[tuple[str, list[float]]]) -> VectorIndex:
        if len({n for n, _ in rows}) != len(rows) or len({len(v) for _, v in rows}) > 1:
            raise ValueError("names must differ and vectors have one dimension")
        data = [(i, n, [float(x) for x in v]) for i, (n, v) in enumerate(rows)]
        spark.createDataFrame(data, "position bigint, name string, vector array<float>").write.parquet(path)
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, query: list[float] | np.ndarray, k: int) -> list[tuple[str, float]]:
        found = search(self.rows(), "vector", list(query), k, "dot", "position")
        return [(r["name"], r.raw_score) for r in found.join(self.rows(), F.col("id") == F.col("position")).orderBy("sort_key", "id").collect()]

    def __len__(self) -> int:
        return self.rows().count()

    def id_at(self, position: int) -> str | None:
        r = self.rows().where(F.col("position") == position).first()
        return r and r["name"]

    def position_of(self, name: str) -> int | None:
        r = self.rows().where(F.col("name") == name).first()
        return r and r.position
