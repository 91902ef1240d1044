"""Fixed-dimensional encodings of token matrices, whose dot products stand for MaxSim."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The seed of the encoder and the constants of its generator.
SEED = 0x4D5556455241
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def signs(seed: int, count: int) -> np.ndarray:
    """``count`` values of -1 or 1 from the low bits of a SplitMix64 sequence."""
    i = np.arange(1, count + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + i * np.uint64(STEP)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        z = z ^ (z >> np.uint64(31))
    return np.where(z & np.uint64(1), 1.0, -1.0)


@dataclass(frozen=True)
class FixedEncoder:
    """Tokens fall into 2^ksim buckets by the signs of ksim projections, per repetition. A query adds up its
    tokens per bucket, a document takes their mean, and an empty bucket of a document the mean of the occupied
    bucket that differs in the fewest bits (the lowest of equals). Buckets are projected and put end to end."""

    dimension: int
    ksim: int = 4
    projected: int = 8
    repetitions: int = 20
    seed: int = SEED

    @property
    def output_dimension(self) -> int:
        return (1 << self.ksim) * self.projected * self.repetitions

    @cached_property
    def planes(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self.ksim + self.projected
        all_ = signs(self.seed, self.repetitions * rows * self.dimension).reshape(self.repetitions, rows, self.dimension)
        return all_[:, : self.ksim], all_[:, self.ksim :] / np.sqrt(self.projected)

    @cached_property
    def by_distance(self) -> np.ndarray:
        """For each bucket all buckets in order of differing bits, then of number."""
        n = 1 << self.ksim
        d = np.array([[(a ^ b).bit_count() for b in range(n)] for a in range(n)])
        return np.argsort(d, axis=1, kind="stable")

    def _buckets(self, x: np.ndarray, r: int) -> np.ndarray:
        return ((x @ self.planes[0][r].T > 0) << np.arange(self.ksim)).sum(1)

    def encode_query(self, tokens: np.ndarray) -> np.ndarray:
        x, n = np.asarray(tokens, dtype=np.float64), 1 << self.ksim
        out = np.zeros((self.repetitions, n, self.dimension))
        for r in range(self.repetitions):
            np.add.at(out[r], self._buckets(x, r), x)
        return (out @ self.planes[1].transpose(0, 2, 1)).ravel()

    def encode_documents(self, tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
        """One row per document; ``tokens`` are those of all documents end to end, ``count`` of each. Documents without
        tokens are zero."""
        x, n = np.asarray(tokens, dtype=np.float64), 1 << self.ksim
        of = np.repeat(np.arange(len(count)), count)
        out = np.zeros((len(count), self.repetitions, n, self.projected))
        every, buckets = np.arange(len(count))[:, None], np.arange(n)
        for r in range(self.repetitions):
            key = of * n + self._buckets(x, r)
            order = np.argsort(key, kind="stable")
            held, first = np.unique(key[order], return_index=True)
            sums, size = np.zeros((len(count) * n, self.projected)), np.bincount(key, minlength=len(count) * n)
            if len(held):
                sums[held] = np.add.reduceat(x[order] @ self.planes[1][r].T, first, axis=0) / size[held][:, None]
            full = size.reshape(-1, n) > 0
            # The first occupied bucket in the order of differing bits.
            near = self.by_distance[buckets, full[:, self.by_distance].argmax(2)]
            out[:, r] = sums.reshape(-1, n, self.projected)[every, near]
        return out.reshape(len(count), -1)

    def encode_document(self, tokens: np.ndarray) -> np.ndarray:
        return self.encode_documents(np.asarray(tokens), np.array([len(tokens)]))[0]


def token_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all rows end to end at length 1, tokens per row) of a list<list<float>> array."""
    from tarnwell.operators.quantize import unit

    o = np.asarray(column.offsets, dtype=np.int64)
    inner = column.values.slice(o[0], o[-1] - o[0])
    io = np.asarray(inner.offsets, dtype=np.int64)
    x = np.asarray(inner.values)[io[0] : io[-1]].astype(np.float64)
    return unit(x.reshape(len(io) - 1, -1)) if len(io) > 1 else x.reshape(0, 1), np.diff(o)


def float_rows(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x, dtype=np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def encode_documents(df: DataFrame, id_col: str, tokens: str, encoder: FixedEncoder) -> DataFrame:
    """(id, fde) for documents with tokens, in Arrow batches; tokens are brought to length 1 first."""

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), float_rows(encoder.encode_documents(*token_batch(b.column(1))))], names=["id", "fde"])

    return df.where(F.size(tokens) > 0).select(F.col(id_col).cast("bigint").alias("id"), F.col(tokens).cast("array<array<float>>").alias("t")).mapInArrow(
        run, "id bigint, fde array<float>"
    )
