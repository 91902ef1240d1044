"""Selection of context from a ranked pool: duplicates, parents, neighbours, diversity and token budget.

The rules depend on what was accepted before, so a query's pool is walked in one task. Pools are
bounded by the channel limits (at most ``POOL`` rows per query), never by the size of the corpus;
the number of queries is what is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.text import estimate_tokens, estimated_tokens
from tarnwell.operators.topk import top_per
from tarnwell.session import materialize

POOL = 4096


@dataclass(frozen=True)
class ContextOptions:
    limit: int = 10
    per_parent: int | None = None
    neighbours: int = 0
    deduplicate: bool = False
    mmr: float | None = None
    budget_tokens: int | None = None

    def __post_init__(self):
        if self.per_parent is not None and self.per_parent < 1:
            raise ValueError("per_parent must be at least 1")
        if not 0 <= self.neighbours <= 8:
            raise ValueError("at most 8 neighbours")
        if self.mmr is not None and not 0 <= self.mmr <= 1:
            raise ValueError("the weight of relevance lies in 0..1")
        if not 1 <= self.limit <= 10_000:
            raise ValueError("limit must lie in 1..10000")


def relevance(scores: np.ndarray) -> np.ndarray:
    """Scores on 0..1 over the pool; all 1 where they are equal."""
    low, high = scores.min(), scores.max()
    return np.ones(len(scores)) if high == low else (scores - low) / (high - low)


def mmr_select(similarity: np.ndarray, scores: np.ndarray, k: int, weight: float) -> list[int]:
    """Positions in order of maximal marginal relevance: weight * score - (1 - weight) * greatest similarity to
    those chosen. Ties go to the earlier position; a score that is not finite gives an empty list."""
    if not np.isfinite(scores).all():
        return []
    weight, left, chosen = min(max(weight, 0.0), 1.0), list(range(len(scores))), []
    near = np.full(len(scores), 0.0)
    while left and len(chosen) < k:
        value = weight * scores[left] - (1 - weight) * (near[left] if chosen else 0)
        i = left.pop(int(np.argmax(value)))
        near = np.maximum(near, similarity[i]) if chosen else similarity[i].copy()
        chosen.append(i)
    return chosen


class Selection:
    """What a query has accepted so far, and why a row may still be refused."""

    def __init__(self, options: ContextOptions):
        self.o = options
        self.rows: list[tuple] = []
        self.ids: set = set()
        self.texts: set = set()
        self.parents: dict = {}
        self.tokens = 0
        self.duplicates = 0

    @property
    def full(self) -> bool:
        return len(self.rows) >= self.o.limit

    def offer(self, row: dict, expanded_from: object = None) -> bool:
        """Accept a row unless it is there already, repeats a text, overfills its parent or the token budget."""
        if self.full or row["id"] in self.ids:
            return False
        text, parent = row["text"], row["parent"]
        if self.o.deduplicate and text is not None and text in self.texts:
            self.duplicates += 1
            return False
        if self.o.per_parent and parent is not None and self.parents.get(parent, 0) >= self.o.per_parent:
            return False
        cost = None
        if self.o.budget_tokens is not None:
            cost = int(row["tokens"]) if "tokens" in row else estimate_tokens(text)
        if cost is not None and self.tokens + cost > self.o.budget_tokens:
            return False
        self.tokens += cost or 0
        self.ids.add(row["id"])
        if text is not None:
            self.texts.add(text)
        if parent is not None:
            self.parents[parent] = self.parents.get(parent, 0) + 1
        self.rows.append((row["id"], row["score"], expanded_from, cost))
        return True


def select(pool: list[dict], around: dict, options: ContextOptions, vectors: np.ndarray | None = None) -> Selection:
    """Walk a pool (dicts of id, score, text, parent, in rank order); ``around`` gives each id's neighbouring chunks."""
    chosen = Selection(options)

    def accept(row: dict) -> bool:
        if not chosen.offer(row):
            return False
        for near in around.get(row["id"], ()):
            chosen.offer(near | {"score": row["score"]}, row["id"])
        return True

    if options.mmr is None:
        for row in pool:
            if chosen.full:
                break
            accept(row)
        return chosen
    if len(pool) > POOL:
        raise ValueError(f"a pool for diversity holds at most {POOL} rows")
    rel = relevance(np.array([r["score"] for r in pool], dtype=float)) if pool else np.empty(0)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12) if vectors is not None and len(pool) else None
    left, near, any_seed = list(range(len(pool))), np.full(len(pool), -np.inf), False
    while left and not chosen.full:
        value = options.mmr * rel[left] - ((1 - options.mmr) * near[left] if any_seed else 0)
        i = left.pop(int(np.argmax(value)))
        if accept(pool[i]):
            any_seed = True
            near = np.maximum(near, unit @ unit[i])
    return chosen


def distinct_texts(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, copies): the least id of each exact text and how many share it; documents without text are never duplicates."""
    key = F.coalesce(F.sha2(text, 256), F.concat(F.lit("id:"), F.col(id_col).cast("string")))
    return docs.groupBy(key.alias("_key")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies")).drop("_key")


def neighbouring(seeds: DataFrame, chunks: DataFrame, distance: int) -> DataFrame:
    """Seeds (parent, at, ...) with the chunks (parent, position, ...) of their parent at most ``distance`` places away.

    Both sides are keyed by stretches of the parent of that many places, a seed by its own and the two beside it, so a
    parent of m chunks costs about m * distance pairs and not m * m.
    """
    width = max(1, distance)
    stretch = lambda c: F.floor(F.col(c) / width)
    near = seeds.withColumn("_stretch", F.explode(F.array(*[stretch("at") + i for i in (-1, 0, 1)])))
    return near.join(chunks.withColumn("_stretch", stretch("position")), ["parent", "_stretch"]).where(F.abs(F.col("position") - F.col("at")) <= distance).drop("_stretch")


OUT = "qid bigint, position int, id bigint, score double, expanded_from bigint, estimated_tokens bigint"


def select_context(ranked: DataFrame, docs: DataFrame, options: ContextOptions, vector: str | None = None) -> DataFrame:
    """Context per query from ranked (qid, id, score) and docs (id, text, parent, position[, vector]).

    Only what can still be accepted is brought together: without duplicates, parents, diversity and budget that is the
    first ``limit`` rows of a query. What decides is carried in place of the texts: a hash and the estimated tokens.
    Neighbours are joined by stretches of their parent (:func:`neighbouring`).
    """
    extra = [vector] if vector else []
    plain_walk = not (options.deduplicate or options.per_parent or options.budget_tokens is not None or options.mmr is not None)
    cut = top_per(ranked.select("qid", "id", "score"), "qid", options.limit).drop("rank") if plain_walk else ranked.select("qid", "id", "score")
    place = docs.select("id", "parent", "position")
    pool = cut.join(place, "id")
    rows = pool.select("qid", F.lit(None).cast("bigint").alias("seed"), "id", "score", "parent", "position")
    if options.neighbours:
        seed = pool.where("parent IS NOT NULL").select("qid", F.col("id").alias("seed"), "score", "parent", F.col("position").alias("at"))
        near = neighbouring(seed, place.where("parent IS NOT NULL"), options.neighbours).where("id <> seed")
        rows = rows.unionByName(near.select("qid", "seed", "id", "score", "parent", "position"))
    # Texts are read and measured only for documents that some query may accept; who that is is written, to be found once.
    rows = materialize(rows, "context")
    held = docs.join(rows.select("id").distinct(), "id", "left_semi")
    rows = rows.join(held.select("id", F.sha2("text", 256).alias("text"), estimated_tokens("text").alias("tokens"), *extra), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text = pdf["text"].astype(object).where(pdf["text"].notna(), None)
        parent = pdf["parent"].astype(object).where(pdf["parent"].notna(), None)
        pdf = pdf.assign(text=text, parent=parent)
        main = pdf[pdf["seed"].isna()].sort_values(["score", "id"], ascending=[False, True], kind="stable")
        around: dict = {}
        for r in pdf[pdf["seed"].notna()].sort_values(["position", "id"], kind="stable").to_dict("records"):
            around.setdefault(int(r["seed"]), []).append(r)
        vectors = None
        if vector and len(main):
            # A row without a vector is like none.
            dim = max((len(v) for v in main[vector] if v is not None), default=1)
            vectors = np.array([np.zeros(dim) if v is None else v for v in main[vector]], dtype=float)
        done = select(main.to_dict("records"), around, options, vectors)
        qid = pdf["qid"].iloc[0]
        return pd.DataFrame(
            [(qid, i, r[0], r[1], r[2], r[3]) for i, r in enumerate(done.rows)],
            columns=["qid", "position", "id", "score", "expanded_from", "estimated_tokens"],
        ).astype({"expanded_from": "Int64", "estimated_tokens": "Int64"})

    # The rows are few bytes and costly to walk: a number given keeps adaptive execution from putting them into one task.
    spark = ranked.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "qid").groupBy("qid").applyInPandas(run, OUT)
