"""Points with payloads: insertion with and without ids, updates, deletes, change log and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.dense import search
from tarnwell.session import materialize, names_in
from tarnwell.streaming.mutations import replay

LOG = "seq bigint, op string, id bigint, vector array<float>, payload string"


class Points:
    """A snapshot below ``path`` and the changes since; ids that were used once are never used again."""

    def __init__(self, spark: SparkSession, path: str, dim: int, metric: str = "cosine"):
        self.spark, self.path, self.dim, self.metric = spark, path.rstrip("/"), dim, metric
        self._log: DataFrame | None = None
        if names_in(spark, f"{self.path}/log"):
            self.seq = self.log().agg(F.max("seq")).first()[0] or 0
        else:
            self.seq = 0
            spark.createDataFrame([], LOG).write.parquet(f"{self.path}/log")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def _append(self, df: DataFrame, op: str) -> None:
        self.seq += 1
        have = set(df.columns)
        col = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
        df.select(F.lit(self.seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), col("id", "bigint"), col("vector", "array<float>"), col("payload", "string")).write.mode("append").parquet(f"{self.path}/log")

    def live(self) -> DataFrame:
        """(id, vector, payload): inserts with the last payload written, without deleted ids."""
        log = self.log()
        inserted = log.where("op = 'insert'").select("id", "vector", F.col("payload").alias("_first"))
        payload = log.where("op = 'payload'").groupBy("id").agg(F.max_by("payload", "seq").alias("_last"), F.lit(True).alias("_changed"))
        gone = log.where("op = 'delete'").select("id").distinct()
        out = inserted.join(gone, "id", "left_anti").join(payload, "id", "left")
        return out.select("id", "vector", F.when(F.col("_changed"), F.col("_last")).otherwise(F.col("_first")).alias("payload"))

    def insert(self, rows: DataFrame) -> None:
        """Insert (id, vector[, payload]); an id that exists or existed refuses the batch, and so does a wrong vector."""
        bad = F.col("id").isNull() | F.coalesce(F.size("vector") != self.dim, F.lit(True))
        if not rows.where(bad).isEmpty():
            raise ValueError("a row without id or with a vector of another dimension")
        used = self.log().where("op = 'insert'").select("id")
        twice = rows.groupBy("id").count().where("count > 1").select("id")
        if not twice.unionByName(rows.join(used, "id", "left_semi").select("id")).isEmpty():
            raise ValueError("an id of the batch exists or existed")
        self._append(rows, "insert")

    def insert_new(self, rows: DataFrame) -> None:
        """Insert (vector[, payload]) under new ids: consecutive blocks per partition above the greatest used."""
        top = self.log().where("op = 'insert'").agg(F.max("id")).first()[0] or 0
        self.insert(materialize(rows.withColumn("id", F.lit(top + 1) + F.monotonically_increasing_id()), "points"))

    def delete(self, id_: int) -> bool:
        if self.live().where(F.col("id") == id_).isEmpty():
            return False
        self._append(self.spark.createDataFrame([(id_,)], "id bigint"), "delete")
        return True

    def update_payload(self, id_: int, payload: str) -> None:
        if self.live().where(F.col("id") == id_).isEmpty():
            raise KeyError(id_)
        self._append(self.spark.createDataFrame([(id_, payload)], "id bigint, payload string"), "payload")

    def purge(self) -> None:
        """Rewrite the log as the live rows; deleted ids stay used."""
        live = self.live().select(F.lit(self.seq).cast("bigint").alias("seq"), F.lit("insert").alias("op"), "id", "vector", "payload")
        gone = self.log().where("op = 'delete'").select("id").distinct()
        kept = gone.select(F.lit(self.seq).cast("bigint").alias("seq"), F.lit("insert").alias("op"), "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("payload"))
        marks = gone.select(F.lit(self.seq).cast("bigint").alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("payload"))
        materialize(live.unionByName(kept).unionByName(marks), "points").write.mode("overwrite").parquet(f"{self.path}/log")

    def search(self, query: list[float], k: int, eligible: Column | None = None) -> DataFrame:
        return search(self.live(), "vector", query, k, self.metric, eligible=eligible)

    def summary(self) -> DataFrame:
        live = self.live()
        return live.agg(F.count("*").alias("points"), F.count("payload").alias("with_payload"), F.avg(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("mean_norm"))


def replay_changes(log: DataFrame) -> DataFrame:
    return replay(log, "id")
