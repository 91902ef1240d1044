"""A collection with its query surface: plan, retrieve, token queries and maintenance.

Nothing runs until the result is collected, except two small actions: the agreement of the channels
where the rerank depth depends on it, and the count of rows an approximate channel brought back.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions.predicates import compile_predicate
from tarnwell.functions.text import PRESETS
from tarnwell.operators import dense, fusion, late, lexical
from tarnwell.operators.ann import AnnOptions, IvfIndex, needs_rebuild
from tarnwell.operators.context import select_context
from tarnwell.operators.fixed_encoding import FixedEncoder
from tarnwell.operators.quantize import ResidualCodec, unit
from tarnwell.operators.topk import top_per
from tarnwell.plans.calibration import Calibration
from tarnwell.plans.planner import Plan, PlannedChannel, Stats, compile_plan
from tarnwell.plans.request import Bm25, Channel, RetrieveRequest, Sparse
from tarnwell.session import materialize, names_in, read_text, remove, write_new
from tarnwell.sources.store import IndexConfig, Store


@dataclass
class Trace:
    plan: dict
    generation: int
    eligible: int
    reranked: int | None
    agreement: float | None
    elapsed_ms: float


@dataclass
class Response:
    matches: DataFrame
    trace: Trace


@dataclass
class Collection:
    store: Store
    indexes: dict[str | None, IvfIndex] = field(default_factory=dict)
    calibration: Calibration = field(default_factory=Calibration)
    codec: ResidualCodec | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: IndexConfig | None = None) -> Collection:
        """The collection with the codec it was trained with and the indexes of its newest version."""
        c = cls(Store(spark, path, config))
        for name in names_in(spark, f"{c.store.path}/ann"):
            index = IvfIndex.load(spark, f"{c.store.path}/ann/{name}")
            held = index and c.indexes.get(index.name)
            if index and (held is None or held.generation < index.generation):
                c.indexes[index.name] = index
        text = read_text(spark, f"{c.store.path}/codec.json")
        c.codec = text and ResidualCodec.from_json(text)
        return c

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @property
    def config(self) -> IndexConfig:
        return IndexConfig(**self.store.pointer.config)

    @property
    def encoder(self) -> FixedEncoder:
        c = self.config
        return FixedEncoder(c.dimension, c.fde_ksim, c.fde_projected, c.fde_repetitions)

    def upsert(self, batch: DataFrame) -> int:
        return self.store.upsert(batch)

    def delete(self, id_: int) -> bool:
        return self.store.delete(id_)

    def compact(self, files: int | None = None) -> dict:
        return self.store.compact(files)

    def schema(self) -> dict[str, tuple]:
        return {k: tuple(v) for k, v in self.store.pointer.fields.items()}

    def stats(self, request: RetrieveRequest | None = None) -> Stats:
        f = request.filter if request else None
        s = self.store.stats(None if f is None else compile_predicate(f))
        return Stats(
            s["documents"], s["text_documents"], s["token_documents"], s["token_vectors"], self.config.dimension,
            self.encoder.output_dimension, s["fields"], s["generation"],
            None if f is None else s["eligible"], None if f is None else s["eligible_fields"],
        )

    def ready(self) -> set:
        """Fields with an index of exactly the current generation."""
        return {k for k, i in self.indexes.items() if i.generation == self.store.generation}

    def plan(self, request: RetrieveRequest) -> Plan:
        return compile_plan(request, self.stats(request), self.schema(), self.ready(), self.calibration)

    # Maintenance of approximate indexes.

    def _ann_path(self) -> str:
        # The field's name never becomes part of a path.
        return f"{self.store.path}/ann/{self.store.generation}-{uuid.uuid4().hex}"

    def build_dense_ann(self, name: str, lists: int | None = None) -> int:
        if self.schema().get(name, ("",))[0] != "dense":
            raise ValueError(f"unknown dense field {name!r}")
        rows = self.store.documents().select("id", F.col("dense")[name].alias("vector"), "metadata").where("vector IS NOT NULL")
        self.indexes[name] = IvfIndex.build(rows, self._ann_path(), lists, "cosine", generation=self.store.generation, name=name)
        return rows.count()

    def build_fde_ann(self, lists: int | None = None) -> int:
        rows = self.stored().select("id", F.col("fde").alias("vector")).join(self.store.documents().select("id", "metadata"), "id")
        self.indexes[None] = IvfIndex.build(rows, self._ann_path(), lists, "dot", generation=self.store.generation)
        return rows.count()

    def auto_compact_dense_ann(self, name: str, lists: int | None = None, fraction: float = 0.2) -> int | None:
        """Rebuild where the rows written since the build exceed ``fraction`` of those it holds."""
        index = self.indexes.get(name)
        if index is None or index.generation == self.store.generation:
            return None
        held = self.spark.read.parquet(index.path).select("id", F.xxhash64("vector").alias("h"))
        now = self.store.documents().select("id", F.col("dense")[name].alias("v")).where("v IS NOT NULL").select("id", F.xxhash64("v").alias("h"))
        fresh = now.join(held, ["id", "h"], "left_anti").count()
        return self.build_dense_ann(name, lists) if needs_rebuild(held.count(), fresh, fraction) else None

    def auto_compact_fde_ann(self, lists: int | None = None, fraction: float = 0.2) -> int | None:
        """As above for the encoded tokens."""
        index = self.indexes.get(None)
        if index is None or index.generation == self.store.generation:
            return None
        held = self.spark.read.parquet(index.path).select("id", F.xxhash64("vector").alias("h"))
        fresh = self.stored().select("id", F.xxhash64("fde").alias("h")).join(held, ["id", "h"], "left_anti").count()
        return self.build_fde_ann(lists) if needs_rebuild(held.count(), fresh, fraction) else None

    # Token vectors.

    def train(self, samples: np.ndarray, iterations: int = 20) -> None:
        c = self.config
        if not c.centroids <= len(samples) <= 65_536 or not 1 <= iterations <= 100:
            raise ValueError("between centroids and 65536 samples, and 1 to 100 iterations")
        self.codec = ResidualCodec.train(samples, c.centroids, c.residual_bits, iterations)
        place = f"{self.store.path}/codec.json"
        remove(self.spark, place)
        write_new(self.spark, place, self.codec.to_json())

    def stored(self) -> DataFrame:
        if self.codec is None:
            raise ValueError("token queries need a trained codec")
        return late.encode_tokens(self.store.documents(), "id", "vectors", self.codec, self.encoder)

    def query(self, vectors: np.ndarray, k: int = 10, candidates: int | None = None, rerank_candidates: int | None = None) -> DataFrame:
        self._check_tokens(vectors, k, candidates)
        return late.token_query(self.stored(), late.one_query(self.spark, vectors), k, self.codec, self.encoder, candidates, rerank_candidates).drop("qid")

    def query_with_probes(self, vectors: np.ndarray, k: int, candidates: int, probes: int) -> DataFrame:
        self._check_tokens(vectors, k, candidates)
        if not 1 <= probes <= 4096:
            raise ValueError("1 to 4096 probes")
        return late.probe_query(self.stored(), late.one_query(self.spark, vectors), k, candidates, probes, self.codec).select("id", "score")

    @staticmethod
    def _check_tokens(vectors: np.ndarray, k: int, candidates: int | None) -> None:
        if not 1 <= len(vectors) <= 1024 or not 1 <= k <= 10_000 or not 1 <= (candidates or k) <= 100_000:
            raise ValueError("1 to 1024 tokens, 10000 results and 100000 candidates")

    # Retrieval.

    def _channel(self, docs: DataFrame, ok: Column | None, asked: list[tuple[int, Channel]], planned: PlannedChannel) -> DataFrame:
        """(qid, id, score) of one channel for all requests that ask it alike."""
        eligible = docs if ok is None else docs.where(F.coalesce(ok, F.lit(False)))
        channel, frame = asked[0][1], self.spark.createDataFrame
        vectors = lambda f: frame([(q, [float(x) for x in f(c)]) for q, c in asked], "qid bigint, vector array<double>")
        if isinstance(channel, Bm25):
            q = frame([(q, c.text) for q, c in asked], "qid bigint, text string")
            out = lexical.bm25(docs, q, channel.limit, eligible=ok, analyzer=PRESETS[self.config.analyzer], k1=channel.k1, b=channel.b)
        elif isinstance(channel, Sparse):
            rows = [(q, [int(i) for i, _ in c.vector], [float(w) for _, w in c.vector]) for q, c in asked]
            e = F.col("sparse")[channel.field]
            held = eligible.select("id", F.transform(e, lambda x: x["feature"]).alias("indices"), F.transform(e, lambda x: x["weight"]).alias("values"))
            out = lexical.sparse_search(held, frame(rows, "qid bigint, indices array<bigint>, values array<double>"), channel.limit)
        elif planned.operator == "exact_dense":
            held = eligible.select("id", F.col("dense")[channel.field].alias("vector"))
            out = dense.batch_search(held, vectors(lambda c: c.vector), channel.limit)
        elif planned.operator == "ann_dense":
            index, probes = self.indexes[channel.field], max(1, channel.ef_search // 16)
            if len(asked) > 1:
                out = index.search_batch(self.spark, vectors(lambda c: c.vector), channel.limit, probes, ok)
            else:
                target = min(channel.limit, planned_target(eligible, channel.field))
                rows, _ = index.search_widening(self.spark, list(channel.vector), channel.limit, target, AnnOptions(nprobe=probes), eligible=ok)
                out = frame([(asked[0][0], r.id, 1.0 - r.sort_key) for r in rows], dense.FOUND)
        elif planned.operator == "ann_fde":
            encoded = vectors(lambda c: self.encoder.encode_query(unit(np.array(c.vectors, dtype=float))))
            out = self.indexes[None].search_batch(self.spark, encoded, channel.limit, max(1, channel.ef_search // 16), ok)
        else:
            q = frame([(q, [[float(x) for x in v] for v in c.vectors]) for q, c in asked], "qid bigint, tokens array<array<double>>")
            if planned.operator == "exact_fde":
                stored = self.stored().join(eligible.select("id"), "id", "left_semi")
                out = late.fde_candidates(stored, q, channel.limit, self.encoder).withColumnRenamed("fde_score", "score")
            else:
                out = dense.exact_maxsim(eligible.select("id", F.col("multivector")[channel.field].alias("tokens")), "tokens", q, channel.limit)
        return out.select("qid", "id", "score")

    def _matches(self, group: dict[int, tuple[RetrieveRequest, Plan]]) -> tuple[DataFrame, dict, dict, dict]:
        """(matches with the request's number ``qid``, rerank depths, agreements, errors) for requests that differ in nothing
        but what they look for, as one plan against one version."""
        generation, (request, plan) = self.store.generation, next(iter(group.values()))
        docs, f, r = self.store.documents(generation), request.fusion, request.rerank
        ok = None if request.filter is None else compile_predicate(request.filter)
        lists = [
            self._channel(docs, ok, [(q, p.requests[i]) for q, (_, p) in group.items()], planned) for i, planned in enumerate(plan.channels)
        ]
        ranked = fusion.fuse(lists, f.kind, f.k, list(f.weights) if f.weights else None)
        agreed, depth, out = {}, dict.fromkeys(group, None), {}
        if r is not None:
            if len(lists) > 1 and r.adaptive:
                agreed = {x.qid: x.agreement for x in fusion.agreement(lists, request.limit).collect()}
            for q in group:
                agreement = agreed.get(q)
                depth[q] = r.limit if agreement is None else fusion.rerank_depth(agreement, r.limit, r.adaptive.min_candidates, r.adaptive.agreement_threshold)
            depths = self.spark.createDataFrame(list(depth.items()), "qid bigint, depth int")
            pool = top_per(ranked, "qid", r.limit).join(F.broadcast(depths), "qid").where("rank <= depth").select("qid", "id")
            rows = [(q, [[float(x) for x in v] for v in one.rerank.vectors]) for q, (one, _) in group.items()]
            asked = self.spark.createDataFrame(rows, "qid bigint, tokens array<array<double>>")
            if r.field is None:
                scored = late.rescore(pool, self.stored(), asked, r.limit, self.codec)
            else:
                held = docs.select("id", F.col("multivector")[r.field].alias("t")).where(F.size("t") > 0)
                for x in pool.join(held.select("id"), "id", "left_anti").groupBy("qid").agg(F.min("id").alias("id")).collect():
                    out[x.qid] = ValueError(f"candidate without the rerank field: {x.id}")
                scored = late.exact_rescore(pool, held, "t", asked, r.limit)
            ranked = scored.select("qid", "id", "score").join(ranked.select("qid", "id", "sources"), ["qid", "id"])
        options = replace(request.context, limit=request.limit, budget_tokens=request.objective.context_budget_tokens)
        diverse = [F.col("dense")[request.diversity_field].alias("vector")] if options.mmr is not None else []
        rows = docs.select("id", "text", "chunk.parent", "chunk.position", *diverse)
        if options.neighbours and ok is not None:
            rows = rows.join(docs.where(F.coalesce(ok, F.lit(False))).select("id"), "id", "left_semi")
        chosen = select_context(ranked.select("qid", "id", "score"), rows, options, "vector" if diverse else None)
        matches = chosen.join(docs.select("id", "metadata", "text", "chunk"), "id").join(ranked.select("qid", "id", "sources"), ["qid", "id"], "left")
        matches = matches.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy("position")) - 1)
        return matches, depth, agreed, out

    def _retrieve(self, group: dict[int, tuple[RetrieveRequest, Plan]], began: float) -> dict[int, Response | Exception]:
        matches, depth, agreed, out = self._matches(group)
        if len(group) > 1:
            matches = materialize(matches, "retrieved")
        for q, (_, own) in group.items():
            if q not in out:
                elapsed = (time.monotonic() - began) * 1000
                trace = Trace(own.to_dict(), self.store.generation, own.eligible, depth[q], agreed.get(q), elapsed)
                out[q] = Response(matches.where(F.col("qid") == q).drop("qid"), trace)
        return out

    def retrieve(self, request: RetrieveRequest) -> Response:
        """Context for one request, all of it against one generation."""
        began = time.monotonic()
        done = self._retrieve({0: (request, self.plan(request))}, began)[0]
        if isinstance(done, Exception):
            raise done
        return done

    def _groups(self, requests: dict[int, RetrieveRequest]) -> tuple[list[dict], dict[int, Exception]]:
        """Requests of the same shape (channels, limits, fusion, filter, rerank and context) with their plans, and errors.

        Statistics are read once per filter.
        """
        stats, groups, errors = {}, {}, {}
        for i, r in requests.items():
            try:
                key = repr(r.filter)
                if key not in stats:
                    stats[key] = self.stats(r)
                plan = compile_plan(r, stats[key], self.schema(), self.ready(), self.calibration)
                shape = tuple(
                    (type(c).__name__, c.key, c.limit, getattr(c, "k1", None), getattr(c, "b", None), p.operator, p.ef_search)
                    for c, p in zip(plan.requests, plan.channels, strict=True)
                )
                rerank = r.rerank and (r.rerank.field, r.rerank.limit, r.rerank.adaptive)
                groups.setdefault((key, shape, r.fusion, rerank, r.limit, r.context, r.objective.context_budget_tokens, r.diversity_field), {})[i] = (r, plan)
            except Exception as e:  # noqa: BLE001
                errors[i] = e
        return list(groups.values()), errors

    def retrieve_batch(self, requests: list[RetrieveRequest]) -> list[Response | Exception]:
        """One slot per request; a request that fails leaves its error and does not touch the others.

        Requests of the same shape are one plan that scans and splits the documents once for all of them.
        """
        began = time.monotonic()
        groups, out = self._groups(dict(enumerate(requests)))
        for group in groups:
            try:
                out |= self._retrieve(group, began)
            except Exception as e:  # noqa: BLE001
                out |= dict.fromkeys(group, e)
        return [out[i] for i in range(len(requests))]

    def retrieve_all(self, requests: dict[int, RetrieveRequest]) -> DataFrame:
        """Matches of all requests as one table, ``qid`` being the request's number; the first error is raised."""
        groups, errors = self._groups(requests)
        parts = [self._matches(g) for g in groups]
        for e in [*errors.values(), *(e for p in parts for e in p[3].values())]:
            raise e
        return reduce(DataFrame.unionByName, [p[0] for p in parts])


def planned_target(eligible: DataFrame, name: str) -> int:
    """Eligible documents that carry the field: more cannot come back."""
    return eligible.where(F.col("dense")[name].isNotNull()).count()
