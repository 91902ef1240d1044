"""Quantisers: 8 and 4 bits per value, and coarse centroids with packed residual codes."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MinMax8:
    """8-bit codes between the least and greatest value of each dimension."""

    low: np.ndarray
    scale: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.low) / self.scale + 0.5), 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes * self.scale + self.low


def fit_minmax(df: DataFrame, vector: str, levels: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """(least, step) of each dimension from one aggregate per dimension, combined before the shuffle."""
    ends = (
        df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("i").collect()
    )
    low = np.array([r.a for r in ends], dtype=np.float64)
    span = np.array([r.b for r in ends], dtype=np.float64) - low
    return low, np.where(span > 0, span / levels, 1.0)


@dataclass(frozen=True)
class Nibble4:
    """4-bit codes, two dimensions per byte with the even one in the low half."""

    low: np.ndarray
    scale: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray) -> Nibble4:
        low, span = x.min(0), np.ptp(x, 0)
        return cls(low.astype(np.float64), np.where(span > 0, span / 15, 1.0))

    @classmethod
    def symmetric(cls, dim: int) -> Nibble4:
        return cls(np.full(dim, -1.0), np.full(dim, 2 / 15))

    def encode(self, x: np.ndarray) -> np.ndarray:
        q = np.clip(np.floor((x - self.low) / self.scale + 0.5), 0, 15).astype(np.uint8)
        if q.shape[1] % 2:
            q = np.concatenate([q, np.zeros((len(q), 1), np.uint8)], 1)
        return q[:, ::2] | (q[:, 1::2] << 4)

    def levels(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), codes.shape[1] * 2), np.uint8)
        out[:, ::2], out[:, 1::2] = codes & 15, codes >> 4
        return out[:, : len(self.low)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.levels(codes) * self.scale + self.low

    def dot(self, codes: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Dot products of coded vectors with a query, without decoding them."""
        return self.levels(codes) @ (query * self.scale) + float(query @ self.low)

    def rmse(self, x: np.ndarray) -> float:
        return float(np.sqrt(np.mean((self.decode(self.encode(x)) - x) ** 2)))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre by squared distance, the first of equals."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return d.argmin(1)


def train_centroids(samples: np.ndarray, count: int, iterations: int) -> np.ndarray:
    """Centroids of unit samples: start at every (n / count)-th sample, mean and length 1 per round; an empty
    cluster keeps its centroid."""
    if len(samples) < count:
        raise ValueError("fewer samples than centroids")
    x = unit(np.asarray(samples, dtype=np.float64))
    c = x[np.arange(count) * len(x) // count].copy()
    for _ in range(max(1, iterations)):
        at = nearest(x, c)
        n = np.bincount(at, minlength=count)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, unit(sums / np.maximum(n, 1)[:, None]), c)
    return c


def train_residual_levels(residuals: np.ndarray, bits: int, iterations: int = 12) -> np.ndarray:
    """2^bits scalar levels: quantiles, then rounds of nearest level and mean; sorted."""
    v = np.sort(np.asarray(residuals, dtype=np.float64).ravel())
    n = 1 << bits
    levels = v[np.minimum(((np.arange(n) + 0.5) * len(v) / n).astype(int), len(v) - 1)] if len(v) else np.zeros(n)
    for _ in range(iterations):
        at = np.abs(v[:, None] - levels[None, :]).argmin(1) if len(v) * n < 5_000_000 else np.searchsorted((levels[1:] + levels[:-1]) / 2, v)
        count = np.bincount(at, minlength=n)
        levels = np.sort(np.where(count > 0, np.bincount(at, v, n) / np.maximum(count, 1), levels))
    return levels


def pack_bits(codes: np.ndarray, bits: int) -> bytes:
    """Codes of ``bits`` bits each, least significant bit first."""
    flat = (codes.ravel()[:, None] >> np.arange(bits)) & 1
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flat.astype(np.int64) << np.arange(bits)).sum(1)


@dataclass(frozen=True)
class ResidualCodec:
    """Token vectors as the number of their nearest centroid and a packed code of what is left."""

    centroids: np.ndarray
    levels: np.ndarray
    bits: int

    @classmethod
    def train(cls, samples: np.ndarray, centroids: int, bits: int, iterations: int = 20) -> ResidualCodec:
        if not 1 <= bits <= 8:
            raise ValueError("residual bits lie in 1..8")
        x = unit(np.asarray(samples, dtype=np.float64))
        c = train_centroids(x, centroids, iterations)
        return cls(c, train_residual_levels(x - c[nearest(x, c)], bits), bits)

    def encode_many(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(centroid of each of the unit tokens ``x``, packed codes per document of ``count`` tokens)."""
        at = nearest(x, self.centroids)
        edges = (self.levels[1:] + self.levels[:-1]) / 2
        codes = np.searchsorted(edges, x - self.centroids[at])
        ends = np.cumsum(count)
        width = self.centroids.shape[1] * self.bits
        if width % 8:
            return at.astype(np.int32), [pack_bits(codes[e - n : e], self.bits) for n, e in zip(count, ends, strict=True)]
        packed = pack_bits(codes, self.bits)  # tokens take whole bytes
        return at.astype(np.int32), [packed[(e - n) * width // 8 : e * width // 8] for n, e in zip(count, ends, strict=True)]

    def decode_many(self, at: np.ndarray, packed: list[bytes], count: np.ndarray) -> np.ndarray:
        """Tokens of documents of ``count`` tokens, end to end."""
        dim = self.centroids.shape[1]
        if dim * self.bits % 8:
            ends = np.cumsum(count)
            parts = [unpack_bits(p, n * dim, self.bits) for p, n in zip(packed, count, strict=True)]
            codes = np.concatenate([*parts, np.empty(0, np.int64)]).reshape(int(ends[-1]) if len(ends) else 0, dim)
        else:
            codes = unpack_bits(b"".join(packed), len(at) * dim, self.bits).reshape(len(at), dim)
        return self.centroids[at] + self.levels[codes]

    def encode(self, tokens: np.ndarray) -> tuple[np.ndarray, bytes]:
        x = unit(np.asarray(tokens, dtype=np.float64))
        at, packed = self.encode_many(x, np.array([len(x)]))
        return at, packed[0]

    def decode(self, at: np.ndarray, packed: bytes) -> np.ndarray:
        return self.decode_many(at, [packed], np.array([len(at)]))

    def to_json(self) -> str:
        return json.dumps({"centroids": self.centroids.tolist(), "levels": self.levels.tolist(), "bits": self.bits})

    @classmethod
    def from_json(cls, text: str) -> ResidualCodec:
        d = json.loads(text)
        return cls(np.array(d["centroids"]), np.array(d["levels"]), d["bits"])
