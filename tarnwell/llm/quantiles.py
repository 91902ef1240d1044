"""Problem 4: percentiles from mergeable rank-interval summaries.

A summary of n sorted values is a list of tuples (value, rmin, rmax): the value occurs in the data
and its rank, counted from 1, lies between rmin and rmax. Partitions summarise what they hold, keep
at most ``size`` tuples per group, and summaries merge in a tree of bounded fan-in; ranks stay
proven bounds through every merge and compression, and ``rank_error`` states how far the true
percentile can be from the one given, in places. Everything is deterministic.

Cases: rows whose run, query or repetition is null, and times that are null, NaN, infinite or not
above 0 do not count; repeated rows count once (the copy that arrived first); ties are ordinary
values; runs without a valid time have no summary and no percentile; a summary of at most ``size``
values is the sorted values themselves, with error 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import materialize

#: Tuples kept per summary: the uncertainty of a rank is at most about n / SIZE per level of compression.
SIZE = 1024
#: The same for verdicts on statements, which a fifth of the value decides.
VERDICT_SIZE = 512
#: Summaries of a level merged at once.
FAN_IN = 64
#: Rows a task buffers before it summarises them.
BUFFER = 1_000_000

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]  # values, rmin, rmax, n


def exact(values: np.ndarray) -> Summary:
    v = np.sort(values)
    r = np.arange(1, len(v) + 1, dtype=np.int64)
    return v, r, r.copy(), len(v)


def compress(s: Summary, size: int = SIZE) -> Summary:
    """Keep the first and last tuple and the last of each of ``size`` - 2 equal rank ranges."""
    v, lo, hi, n = s
    if len(v) <= size:
        return s
    slot = (lo - 1) * (size - 2) // max(n, 1)
    keep = np.append(np.flatnonzero(np.diff(slot)), len(v) - 1)
    keep = np.unique(np.append(keep, 0))
    return v[keep], lo[keep], hi[keep], n


def merge(a: Summary, b: Summary) -> Summary:
    """Tuples of both, each with the rank bounds that the other summary adds.

    A value of ``a`` stands above all of ``b`` up to b's last tuple not greater than it, and below
    b's first tuple greater than it. Of equal values those of ``a`` come first.
    """
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b

    def lift(x: Summary, y: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(y[0], x[0], side)
        low = np.where(at > 0, y[1][np.maximum(at - 1, 0)], 0)
        high = np.where(at < len(y[0]), y[2][np.minimum(at, len(y[0]) - 1)] - 1, y[3])
        return x[1] + low, x[2] + high

    (la, ha), (lb, hb) = lift(a, b, "left"), lift(b, a, "right")
    v = np.concatenate([a[0], b[0]])
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate([la, lb])[order], np.concatenate([ha, hb])[order], a[3] + b[3]


def merge_all(parts: list[Summary], size: int = SIZE) -> Summary:
    """Merge in a balanced tree; summaries without error are sorted together instead."""
    if all(len(p[0]) == p[3] for p in parts):
        return compress(exact(np.concatenate([p[0] for p in parts])), size)
    while len(parts) > 1:
        parts = [compress(merge(*parts[i : i + 2]), size) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return compress(parts[0], size)


class Merger:
    """Merges any number of summaries, holding fewer than FAN_IN per level.

    FAN_IN summaries of a level become one of the next, so each value passes a number of merges that is the logarithm
    of the number of summaries, and the ranks' error grows with that.
    """

    def __init__(self, size: int = SIZE):
        self.size = size
        self.levels: list[list[Summary]] = []

    def add(self, s: Summary) -> None:
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(s)
            if len(self.levels[level]) < FAN_IN:
                return
            s, self.levels[level] = merge_all(self.levels[level], self.size), []
            level += 1

    def result(self) -> Summary:
        return merge_all([s for level in self.levels for s in level], self.size)


def at_rank(s: Summary, rank: int) -> tuple[float, float, float, int]:
    """(estimate, low, high, error) for the value at ``rank`` from 1: low and high bound it for certain."""
    v, lo, hi, _ = s
    below = np.searchsorted(hi, rank, "right") - 1  # last tuple certainly not after the rank
    above = np.searchsorted(lo, rank, "left")  # first tuple certainly not before it
    below, above = max(below, 0), min(above, len(v) - 1)
    miss = np.maximum(hi - rank, rank - lo)
    best = int(np.argmin(miss))
    return float(v[best]), float(v[below]), float(v[above]), int(max(miss[best], 0))


def _rows(summaries: list[tuple[tuple, Summary]], keys: pa.Schema, schema: pa.Schema) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k, _ in summaries], type=f.type) for i, f in enumerate(keys)]
    flat = [s for _, s in summaries]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])]).astype(np.int32))
    for j, t in ((0, pa.float64()), (1, pa.int64()), (2, pa.int64())):
        data = np.concatenate([s[j] for s in flat]) if flat else np.empty(0)
        cols.append(pa.ListArray.from_arrays(offsets, pa.array(data, type=t)))
    cols.append(pa.array([s[3] for s in flat], type=pa.int64()))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


_SQL = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _schemas(keys: dict[str, str]) -> tuple[pa.Schema, pa.Schema, str]:
    key_schema = pa.schema([(k, _SQL[t]) for k, t in keys.items()])
    full = pa.schema(
        [*key_schema, ("v", pa.list_(pa.float64())), ("rmin", pa.list_(pa.int64())), ("rmax", pa.list_(pa.int64())), ("n", pa.int64())]
    )
    sql = ", ".join([*(f"`{k}` {t}" for k, t in keys.items()), "v array<double>, rmin array<bigint>, rmax array<bigint>, n bigint"])
    return key_schema, full, sql


def summarise(df: DataFrame, keys: dict[str, str], value: str, size: int = SIZE) -> DataFrame:
    """Summaries of ``value`` per group of ``keys`` (name -> SQL type), one per input partition or buffer."""
    key_schema, full, sql = _schemas(keys)
    names = list(keys)

    def flush(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        codes = []
        for name in names:
            c = t.column(name).combine_chunks().dictionary_encode()
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            codes.append((np.asarray(c.indices.fill_null(-1)), c.dictionary))
        v = np.asarray(t.column(value))
        order = np.lexsort([v, *[c for c, _ in reversed(codes)]])
        sorted_codes = [c[order] for c, _ in codes]
        change = np.zeros(len(v), bool)
        change[0] = True
        for c in sorted_codes:
            change[1:] |= c[1:] != c[:-1]
        starts = np.append(np.flatnonzero(change), len(v))
        v = v[order]
        out = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(None if c[a] < 0 else d[int(c[a])].as_py() for c, (_, d) in zip(sorted_codes, codes, strict=True))
            r = np.arange(1, b - a + 1, dtype=np.int64)
            out.append((key, compress((v[a:b], r, r, int(b - a)), size)))
        return _rows(out, key_schema, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= BUFFER:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return df.select(*names, value).mapInArrow(run, sql)


def _merge_level(df: DataFrame, keys: dict[str, str], size: int) -> DataFrame:
    """One summary per group. Rows arrive sorted by group, so a task merges one group at a time."""
    key_schema, full, sql = _schemas(keys)
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, done = None, None, []
        for b in batches:
            cols = [b.column(n).to_pylist() for n in names]
            lists = []
            for j in ("v", "rmin", "rmax"):
                c = b.column(j)
                lists.append((np.asarray(c.offsets), np.asarray(c.values)))
            n = b.column("n").to_pylist()
            for i, key in enumerate(zip(*cols, strict=True)):
                if held is None or key != current:
                    if held is not None:
                        done.append((current, held.result()))
                    current, held = key, Merger(size)
                held.add((*(x[o[i] : o[i + 1]] for o, x in lists), n[i]))
            if len(done) >= 1000:
                yield _rows(done, key_schema, full)
                done = []
        if held is not None:
            done.append((current, held.result()))
        if done:
            yield _rows(done, key_schema, full)

    return (
        df.select(*names, "v", "rmin", "rmax", "n")
        .repartition(*names)
        .sortWithinPartitions(*names)
        .mapInArrow(run, sql)
    )


def combine(summaries: DataFrame, keys: dict[str, str], pieces: int, size: int = SIZE, spread: str | None = None) -> DataFrame:
    """Merge summaries into one per group of ``keys``.

    ``pieces`` is about how many summaries a group can have; where it exceeds FAN_IN, groups are first
    merged in shares (by a hash of ``spread``, or of the summary itself), level by level, so that a hot
    group is the work of many tasks. However many there are, a task holds a bounded number (:class:`Merger`).
    """
    while pieces > FAN_IN:
        pieces = math.ceil(pieces / FAN_IN)
        salt = F.pmod(F.xxhash64(spread) if spread else F.xxhash64("v"), F.lit(pieces))
        salted = summaries.withColumn("_salt", salt.cast("bigint"))
        summaries = _merge_level(salted, keys | {"_salt": "bigint"}, size)
        spread = "_salt"
    return _merge_level(summaries, keys, size)


def valid_times(log: DataFrame) -> DataFrame:
    """Each (run, query, repetition) once, with a time that is finite and above 0."""
    ms = F.col("elapsed_ms")
    return (
        log.where(
            F.col("run_id").isNotNull() & F.col("query_idx").isNotNull() & F.col("rep").isNotNull()
            & (ms > 0) & ~F.isnan(ms) & (ms != float("inf"))
        )
        .groupBy("run_id", "query_idx", "rep")
        .agg(
            F.min_by("elapsed_ms", "ingested_at").alias("_by_time"),
            F.min("elapsed_ms").alias("_least"),
            F.min("collection").alias("collection"),
            F.min("run_at").cast("date").cast("string").alias("day"),
        )
        .withColumn("elapsed_ms", F.coalesce("_by_time", "_least"))
        .drop("_by_time", "_least")
    )


def percentiles(summaries: DataFrame, keys: list[str], ps: tuple[float, ...]) -> DataFrame:
    """One row per summary: keys, n and for p of ``ps`` the columns p50, p50_low, p50_high, p50_rank_error, ..."""

    def name(p: float) -> str:
        return f"p{p * 100:g}".replace(".", "_")

    fields = [(f"{name(p)}{tail}", t) for p in ps for tail, t in (("", "double"), ("_low", "double"), ("_high", "double"), ("_rank_error", "bigint"))]
    types = {f.name: f.dataType.simpleString() for f in summaries.schema}
    sql = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n bigint", *(f"{a} {b}" for a, b in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [(np.asarray(b.column(j).offsets), np.asarray(b.column(j).values)) for j in ("v", "rmin", "rmax")]
            n = b.column("n").to_pylist()
            out = [[] for _ in fields]
            for i in range(b.num_rows):
                s = (*(x[o[i] : o[i + 1]] for o, x in lists), n[i])
                for j, p in enumerate(ps):
                    for q, x in enumerate(at_rank(s, math.floor(p * (n[i] - 1) + 0.5) + 1)):
                        out[4 * j + q].append(x)
            cols = [b.column(k) for k in keys] + [b.column("n")]
            cols += [pa.array(x, type=pa.float64() if t == "double" else pa.int64()) for x, (_, t) in zip(out, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "n", *(f for f, _ in fields)])

    return summaries.select(*keys, "v", "rmin", "rmax", "n").mapInArrow(run, sql)


def _partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session: how many summaries a group can get from one pass."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def log_summaries(log: DataFrame, keys: dict[str, str], size: int = SIZE) -> DataFrame:
    """One summary per group of ``keys`` (of run_id, collection, day), over all partitions of the log."""
    return combine(summarise(valid_times(log), keys, "elapsed_ms", size), keys, _partitions(log), size)


def run_percentiles(log: DataFrame, ps: tuple[float, ...] = (0.5, 0.99), size: int = SIZE) -> DataFrame:
    """Percentiles per run with their bounds."""
    return percentiles(log_summaries(log, {"run_id": "bigint"}, size), ["run_id"], ps)


def rollup_percentiles(log: DataFrame, by: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99), size: int = SIZE) -> DataFrame:
    """Percentiles per ``by`` (collection or day), from summaries kept per run, collection and day.

    The summaries of runs and days are merged, not the values, in two levels of bounded fan-in.
    """
    parts = log_summaries(log, {"run_id": "bigint", "collection": "string", "day": "string"}, size)
    keys = {by: "string"}
    return percentiles(combine(parts, keys, FAN_IN * FAN_IN, size, spread="run_id"), [by], ps)


def exact_at(rows: DataFrame, wanted: DataFrame, key: str, p: float, low: str, high: str) -> DataFrame:
    """(key, exact): the percentile ``p`` of the groups in ``wanted``, which gives n and bounds that hold it.

    Values below the bounds are only counted; those within, a small share of the group that the
    summary's error bounds, are ranked.
    """
    inside = rows.select(key, "elapsed_ms").join(wanted.select(key, low, high, "n"), key)
    below = inside.groupBy(key).agg(F.sum((F.col("elapsed_ms") < F.col(low)).cast("bigint")).alias("_below"), F.first("n").alias("n"))
    counts = inside.where(F.col("elapsed_ms").between(F.col(low), F.col(high))).groupBy(key, "elapsed_ms").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(key).orderBy("elapsed_ms"))
    rank = F.floor(F.lit(p) * (F.col("n") - 1) + 0.5) + 1
    return (
        counts.withColumn("_upto", upto).join(below, key)
        .where(F.col("_below") + F.col("_upto") >= rank)
        .groupBy(key).agg(F.min("elapsed_ms").alias("exact"))
    )


def settled(log: DataFrame, by: str, size: int = SIZE) -> DataFrame:
    """(by, n, p50, p99): percentiles without error, from merged summaries and a count of what lies between their bounds."""
    if by == "run_id":
        known = run_percentiles(log, (0.5, 0.99), size)
    else:
        known = rollup_percentiles(log, by, (0.5, 0.99), size)
    known, rows = materialize(known, "p4"), valid_times(log)
    out = known.select(by, "n")
    for p, name in ((0.5, "p50"), (0.99, "p99")):
        out = out.join(exact_at(rows, known, by, p, f"{name}_low", f"{name}_high").withColumnRenamed("exact", name), by)
    return out


def verdict(stated: str, low: str, high: str, tolerance: float) -> Column:
    """Whether a stated percentile is off by more than ``tolerance`` of one that lies between two bounds: true or
    false where every value between them gives the same answer, null where the bounds leave it open.

    A statement above a value by too much is so above every smaller one, and one below likewise above every larger one.
    """
    s, lo, hi = F.col(stated), F.col(low), F.col(high)

    def above(x: Column) -> Column:
        return s - x > tolerance * x

    def below(x: Column) -> Column:
        return x - s > tolerance * x

    none = s.isNull() | F.isnan(s)
    return (
        F.when(none, False).when(above(hi) | below(lo), True).when(~above(lo) & ~below(hi), False).otherwise(F.lit(None).cast("boolean"))
    )


def misstated_runs(log: DataFrame, reports: DataFrame, tolerance: float = 0.2, size: int = VERDICT_SIZE) -> DataFrame:
    """(run_id): runs whose stated median or 99th percentile is off by more than ``tolerance``.

    The bounds of the summaries give the verdict; only where both answers are possible between them are the
    values of that run counted.
    """
    stated = reports.where(F.col("run_id").isNotNull()).select("run_id", "p50_ms", "p99_ms").distinct()
    known = run_percentiles(log, (0.5, 0.99), size)
    judged = stated.join(known, "run_id").withColumn("off50", verdict("p50_ms", "p50_low", "p50_high", tolerance)).withColumn(
        "off99", verdict("p99_ms", "p99_low", "p99_high", tolerance)
    )
    judged = materialize(judged, "p4")
    off = judged.where("off50 OR off99").select("run_id")
    undecided = judged.where("NOT coalesce(off50 OR off99, false) AND (off50 IS NULL OR off99 IS NULL)")
    if undecided.isEmpty():
        return off.distinct()
    runs = undecided.select("run_id", "n", "p50_low", "p50_high", "p99_low", "p99_high").distinct()
    rows = valid_times(log.join(runs.select("run_id"), "run_id", "left_semi"))
    for p, name in ((0.5, "50"), (0.99, "99")):
        exact = exact_at(rows, runs, "run_id", p, f"p{name}_low", f"p{name}_high").withColumnRenamed("exact", f"e{name}")
        undecided = undecided.join(exact, "run_id").withColumn(f"off{name}", verdict(f"p{name}_ms", f"e{name}", f"e{name}", tolerance))
    return off.unionByName(undecided.where("off50 OR off99").select("run_id")).distinct()
