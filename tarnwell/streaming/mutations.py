"""Change logs: replay, upserts from a stream, and running calibration per key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHA = 0.2


def replay(log: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """State after a log of upserts and deletes: the last change of each key, without deleted keys.

    Aggregated before the shuffle, so a key with very many changes arrives as one row per task.
    """
    columns = [c for c in log.columns if c not in (key, op)]
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(op, *columns), seq).alias("r"))
    return last.where(F.col("r")[op] != "delete").select(key, *[F.col("r")[c].alias(c) for c in columns])


def upsert_stream(changes: DataFrame, store: Any, checkpoint: str, trigger: dict | None = None):
    """Apply a stream of rows (id, op, seq, ...) to a store, one generation per batch.

    A batch that is delivered again after a failure finds its number in the store and changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if store.last_batch() is not None and batch_id <= store.last_batch():
            return
        columns = [c for c in batch.columns if c not in ("op", "seq")]
        last = batch.groupBy("id").agg(F.max_by(F.struct("op", *[c for c in columns if c != "id"]), "seq").alias("r"))
        rows = last.select("id", "r.*")
        store.apply(rows.where("op <> 'delete'").select(*columns), rows.where("op = 'delete'").select("id"), batch_id)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def calibrate_stream(observations: DataFrame) -> DataFrame:
    """(key, observations, mean, variance, p90) after each micro-batch, from (key, cost_units, elapsed_ms).

    Exponentially weighted mean and variance of the time per unit of cost, kept as state per key.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, mean, variance = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            f = f[(f.cost_units > 0) & (f.elapsed_ms >= 0)]
            for sample in f.elapsed_ms / f.cost_units:
                n += 1
                if n == 1:
                    mean = float(sample)
                else:
                    delta = float(sample) - mean
                    mean += ALPHA * delta
                    variance = (1 - ALPHA) * (variance + ALPHA * delta * delta)
        state.update((n, mean, variance))
        yield pd.DataFrame([(key[0], n, mean, variance, mean + 1.282 * variance**0.5)], columns=["key", "observations", "mean", "variance", "p90"])

    return observations.groupBy("key").applyInPandasWithState(
        run, "key string, observations bigint, mean double, variance double, p90 double", "n bigint, mean double, variance double", "update", "NoTimeout"
    )


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per key and time window; rows later than ``late`` after the newest are not waited for."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), key, "n"
    )
