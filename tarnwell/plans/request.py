"""Requests: channels, fusion, rerank, objective and context, with their limits."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from tarnwell.functions.predicates import Predicate, validate
from tarnwell.operators.context import ContextOptions

MODES = ("manual", "auto", "auto_with_overrides")
QUALITIES = ("fast", "balanced", "high")
BACKENDS = ("auto", "exact", "ann")
MOST_CHANNELS, MOST_RESULTS, MOST_CANDIDATES, MOST_EF, MOST_TEXT = 8, 10_000, 100_000, 65_536, 65_536


class InvalidRequest(ValueError):
    pass


@dataclass(frozen=True)
class Bm25:
    text: str
    limit: int = 100
    k1: float = 1.2
    b: float = 0.75
    kind = "bm25"
    key = ("bm25", None)


@dataclass(frozen=True)
class Sparse:
    field: str
    vector: tuple[tuple[int, float], ...]
    limit: int = 100
    kind = "sparse"

    @property
    def key(self):
        return ("sparse", self.field)


@dataclass(frozen=True)
class Dense:
    field: str
    vector: tuple[float, ...]
    limit: int = 100
    backend: str = "auto"
    ef_search: int = 256
    kind = "dense"

    @property
    def key(self):
        return ("dense", self.field)


@dataclass(frozen=True)
class Multivector:
    vectors: tuple[tuple[float, ...], ...]
    field: str | None = None
    limit: int = 100
    backend: str = "auto"
    ef_search: int = 256
    kind = "multivector"

    @property
    def key(self):
        return ("multivector", self.field)


Channel = Bm25 | Sparse | Dense | Multivector


@dataclass(frozen=True)
class Fusion:
    kind: str = "rrf"
    k: float = 10.0
    weights: tuple[float, ...] | None = None


@dataclass(frozen=True)
class Adaptive:
    min_candidates: int
    agreement_threshold: float


@dataclass(frozen=True)
class Rerank:
    vectors: tuple[tuple[float, ...], ...]
    field: str | None = None
    limit: int = 100
    adaptive: Adaptive | None = None


@dataclass(frozen=True)
class Objective:
    latency_budget_ms: float | None = None
    context_budget_tokens: int | None = None
    quality: str = "balanced"


@dataclass(frozen=True)
class Representations:
    """What a caller supplies of a query for automatic planning."""

    text: str | None = None
    dense: dict = field(default_factory=dict)
    sparse: dict = field(default_factory=dict)
    multivector: dict = field(default_factory=dict)
    fde: tuple | None = None


@dataclass(frozen=True)
class RetrieveRequest:
    prefetch: tuple[Channel, ...] = ()
    planning_mode: str = "manual"
    query: Representations | None = None
    objective: Objective = Objective()
    fusion: Fusion = Fusion()
    filter: Predicate | None = None
    rerank: Rerank | None = None
    limit: int = 10
    context: ContextOptions = ContextOptions()
    diversity_field: str | None = None

    def check(self) -> None:
        auto = self.planning_mode != "manual"
        if self.planning_mode not in MODES or self.objective.quality not in QUALITIES:
            raise InvalidRequest("unknown planning mode or quality")
        if auto and self.query is None:
            raise InvalidRequest("automatic planning needs the query's representations")
        if (not self.prefetch and not auto) or len(self.prefetch) > MOST_CHANNELS or not 1 <= self.limit <= MOST_RESULTS:
            raise InvalidRequest("invalid channels or limit")
        budget = self.objective.latency_budget_ms
        if budget is not None and not (math.isfinite(budget) and budget > 0):
            raise InvalidRequest("the latency budget must be finite and positive")
        if self.objective.context_budget_tokens is not None and self.objective.context_budget_tokens < 1:
            raise InvalidRequest("the token budget must be positive")
        if (self.context.mmr is None) != (self.diversity_field is None):
            raise InvalidRequest("diversity needs both a weight and a dense field")
        if self.filter is not None:
            validate(self.filter)

    def check_channels(self, channels: tuple[Channel, ...]) -> None:
        for c in channels:
            if not 1 <= c.limit <= MOST_CANDIDATES:
                raise InvalidRequest("a channel's limit lies in 1..100000")
            if isinstance(c, Bm25) and (
                len(c.text.encode()) > MOST_TEXT or not math.isfinite(c.k1) or c.k1 < 0 or not 0 <= c.b <= 1
            ):
                raise InvalidRequest("invalid text or parameters of a lexical channel")
            if isinstance(c, (Dense, Multivector)) and (c.backend not in BACKENDS or not 1 <= c.ef_search <= MOST_EF):
                raise InvalidRequest("invalid backend or search width")
        f = self.fusion
        if f.kind == "rrf":
            if not math.isfinite(f.k) or f.k < 0:
                raise InvalidRequest("k must be finite and not negative")
        elif f.weights is None or len(f.weights) != len(channels) or not any(f.weights) or any(not math.isfinite(w) or w < 0 for w in f.weights):
            raise InvalidRequest("one finite weight per channel, none negative and not all 0")
        r = self.rerank
        if r is not None:
            if not self.limit <= r.limit <= MOST_CANDIDATES:
                raise InvalidRequest("the rerank limit covers the result limit")
            a = r.adaptive
            if a is not None and (
                not self.limit <= a.min_candidates <= r.limit or not 0 <= a.agreement_threshold <= 1 or len(channels) < 2
            ):
                raise InvalidRequest("invalid adaptive rerank")
