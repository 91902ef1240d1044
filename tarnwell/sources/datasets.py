"""Datasets from files: arrays with ground truth, JSON lines, and seeded synthetic clusters."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def from_numpy(spark: SparkSession, vectors: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    import pandas as pd

    ids = np.arange(len(vectors)) if ids is None else ids
    return spark.createDataFrame(pd.DataFrame({"id": ids.astype(np.int64), "vector": list(vectors.astype(np.float32))}), "id bigint, vector array<float>")


def read_array_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, queries, truth) from base.npy, queries.npy and ground_truth.json; truth is (qid, id, rank from 1)."""
    base, queries = (from_numpy(spark, np.load(f"{folder}/{n}.npy", mmap_mode="r")) for n in ("base", "queries"))
    lists = json.loads(Path(folder, "ground_truth.json").read_text())
    rows = [(q, int(i), r) for q, ids in enumerate(lists) for r, i in enumerate(ids, 1)]
    return base, queries.withColumnRenamed("id", "qid"), spark.createDataFrame(rows, "qid bigint, id bigint, rank int")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def synthetic_clusters(n: int, dim: int, clusters: int, spread: float = 0.3, seed: int = 42) -> np.ndarray:
    """Unit vectors around random unit centres."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(clusters, dim)))
    return unit(centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim)) / np.sqrt(dim)).astype(np.float32)


def exact_neighbours(base: np.ndarray, queries: np.ndarray, k: int = 100) -> list[list[int]]:
    return [[int(i) for i in np.argsort(-(base @ q), kind="stable")[:k]] for q in queries]
