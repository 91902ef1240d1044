"""Problem 7: filling containers of fixed capacity with whole items.

Bin completion by branch and bound: the largest item left opens a container; fillings of the room it
leaves are enumerated, dominated ones dropped, most filled first; a branch is cut when the waste it
has already sealed shows that it cannot beat the best solution known, and best-fit decreasing gives
the first such solution. The search ends as soon as the solution meets the lower bound (sum of sizes
over capacity, rounded up) or a fixed number of nodes is used up; the best solution found is kept.
It is not exhaustive: of a container at most 12 fillings are looked at, each of which leaves out at
most 3 of the sizes that would fit on its way (``fillings``), and at most ``BRANCHES`` of them followed.
These limits and the nodes bound the search for fewer containers, never which items are packed.

Items are spread by a hash of their id over groups of about ``GROUP`` items, each packed by one
task. Containers that a group leaves emptier than ``KEEP`` (at most ``REPACK`` of them per group)
are dissolved and packed again together with those of the other groups of a block, so the group
count costs no room. No group grows with the data.

An item larger than the capacity is cut: full containers of its own and one piece with the rest,
which is packed like any other item.

Cases: items without id are left out; a null or negative size counts as 0 and takes no room, but the
item still gets a container; repeated rows are separate items, told apart by their piece number;
an empty table gives an empty result; other columns are ignored. Equal sizes are taken in order of
id.
"""

from __future__ import annotations

import bisect
import heapq
import math
import os
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP = 4096
REPACK = 8
BLOCK = 64
KEEP = 0.995
#: Nodes of one search, and items looked at by all of them together.
NODES, LOOKED_AT = 20_000, 6_000_000
#: Fillings tried per container.
BRANCHES = 6


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions; ``sizes`` must be in decreasing order."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, container), sorted
    for i, s in enumerate(sizes):
        at = bisect.bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([i])
            bisect.insort(room, (capacity - s, len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            bisect.insort(room, (free - s, b))
    return bins


def fillings(rest: list[int], room: int, width: int = 12, skips: int = 3) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with the sizes ``rest`` (decreasing), as positions, most filled first.

    Each filling takes the largest size that still fits until none does, having left out up to
    ``skips`` sizes on the way; those that leave out late are tried first, and at most ``width``. A
    filling is dominated where another has at least as many items, each at least as large.
    """
    below = [-x for x in rest]
    found: list[tuple[int, tuple[int, ...]]] = []
    # Chosen positions as a chain, where to look on, room left, sizes left out.
    stack: list[tuple[tuple | None, int, int, int]] = [(None, 0, room, 0)]
    while stack and len(found) < width:
        chain, start, left, out = stack.pop()
        while left and (i := bisect.bisect_left(below, -left, start)) < len(rest):
            if out < skips and (j := bisect.bisect_right(below, below[i], i)) < len(rest):
                stack.append((chain, j, left, out + 1))
            chain, start, left = (chain, i), i + 1, left - rest[i]
        chosen = []
        while chain:
            chain, i = chain
            chosen.append(i)
        found.append((left, tuple(reversed(chosen))))
    found.sort(key=lambda f: f[0])
    kept: list[tuple[int, ...]] = []
    for _, f in found:
        if not any(len(k) >= len(f) and all(rest[a] >= rest[b] for a, b in zip(k, f, strict=False)) for k in kept):
            kept.append(f)
    return kept


def pack(sizes: list[int], capacity: int, nodes: int | None = None) -> list[list[int]]:
    """Containers as lists of positions of ``sizes`` (any order, each at most ``capacity``)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    zero = [i for i in order if sizes[i] <= 0]
    order = order[: len(order) - len(zero)]
    s = [sizes[i] for i in order]
    best = best_fit_decreasing(s, capacity)
    bound = -(-sum(s) // capacity)
    if len(best) > bound:
        better = _complete(s, capacity, bound, len(best), nodes or min(NODES, LOOKED_AT // len(s)))
        best = better or best
    out = [[order[i] for i in b] for b in best]
    if zero:
        if not out:
            out.append([])
        out[-1].extend(zero)
    return out


def _complete(s: list[int], capacity: int, bound: int, incumbent: int, nodes: int) -> list[list[int]] | None:
    """Bin completion: a solution of fewer than ``incumbent`` containers, or None.

    The waste sealed so far plus what is left to pack gives the fewest containers a branch can
    reach; the branch is cut where that is not below the incumbent. Branches that depart least from the
    most filled choices come first (limited discrepancy), each followed down to a leaf.
    """
    total = sum(s)
    best: list[list[int]] | None = None
    order = count()
    heap: list[tuple] = []
    used = departures = 0
    at: tuple[list[int], int, tuple | None] | None = (list(range(len(s))), 0, None)

    def take(left: list[int], o: tuple[int, ...], sealed: int, done: tuple | None) -> tuple:
        """The branch that fills the first item's container with the items at ``o`` of the others."""
        taken = {k + 1 for k in o}
        return [x for k, x in enumerate(left) if k and k not in taken], sealed, (done, [left[0], *(left[k + 1] for k in o)])

    while at and used < nodes:
        left, waste, done = at
        at = None
        while left and used < nodes and -(-(total + waste) // capacity) < incumbent:
            used += 1
            room = capacity - s[left[0]]
            sizes = [s[i] for i in left[1:]]
            options = fillings(sizes, room)[:BRANCHES]
            sealed = [waste + room - sum(sizes[k] for k in o) for o in options]
            for rank, (o, w) in enumerate(zip(options[1:], sealed[1:], strict=True), 1):
                if -(-(total + w) // capacity) < incumbent:
                    heapq.heappush(heap, (departures + rank, next(order), left, o, w, done))  # the list is shared by its branches
            left, waste, done = take(left, options[0], sealed[0], done)
        if not left:
            chain, bins = done, []
            while chain:
                chain, b = chain
                bins.append(b)
            if len(bins) < incumbent:
                best, incumbent = bins[::-1], len(bins)
                if incumbent <= bound:
                    break
        if heap:
            departures, _, *branch = heapq.heappop(heap)
            at = take(*branch)
    return best


_OUT = "id bigint, piece int, size bigint, oversized boolean, container bigint, fill bigint"
_ARROW = pa.schema(
    [("id", pa.int64()), ("piece", pa.int32()), ("size", pa.int64()), ("oversized", pa.bool_()), ("container", pa.int64()), ("fill", pa.int64())]
)


def _pack_groups(df: DataFrame, key: str, capacity: int, level: int) -> DataFrame:
    """Pack each group of ``key``. Container numbers hold the level, the group and the place in the group."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("piece", "ascending")])
        sizes = t.column("size").to_pylist()
        group = t.column(key)[0].as_py()
        bins = pack(sizes, capacity)
        number, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, b in enumerate(bins):
            number[b] = (level << 60) | (group << 24) | k
            fill[b] = sum(sizes[i] for i in b)
        return pa.Table.from_arrays(
            [*(t.column(c).combine_chunks() for c in ("id", "piece", "size", "oversized")), pa.array(number), pa.array(fill)], schema=_ARROW
        )

    return df.select(key, "id", "piece", "size", "oversized").groupBy(key).applyInArrow(run, _OUT)


def fill_containers(
    df: DataFrame, id_col: str, size: Column, capacity: int = CAPACITY, group: int = GROUP, items: int | None = None
) -> DataFrame:
    """(id, piece, size, oversized, container, fill): where each item, or each piece of an oversized one, goes.

    ``items`` is the number of rows, counted if not given.
    """
    n = df.count() if items is None else items
    groups = max(1, math.ceil(n / group))
    full = F.lit(capacity).cast("bigint")
    sized = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("whole")
    )
    # Rows of an id get piece numbers one after the other, so that copies count as separate items.
    per = F.when(F.col("whole") > full, F.ceil(F.col("whole") / full)).otherwise(F.lit(1)).cast("bigint")
    before = W.partitionBy("id").orderBy("whole").rowsBetween(W.unboundedPreceding, -1)
    pieces = (
        sized.groupBy("id", "whole")
        .agg(F.count("*").alias("copies"))
        .withColumn("pieces", per)
        .withColumn("base", F.coalesce(F.sum(F.col("copies") * F.col("pieces")).over(before), F.lit(0)))
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") * F.col("pieces") - 1)))
        .select(
            "id",
            (F.col("base") + F.col("k")).cast("int").alias("piece"),
            F.when(F.col("k") % F.col("pieces") < F.col("pieces") - 1, full)
            .otherwise(F.col("whole") - full * (F.col("pieces") - 1))
            .alias("size"),
            (F.col("whole") > full).alias("oversized"),
        )
    )
    # Full pieces are containers already; the hash keeps them apart from the packed ones.
    first = _pack_groups(pieces.withColumn("g", F.pmod(F.xxhash64("id", "piece"), F.lit(groups))), "g", capacity, 0)
    if groups == 1:
        return first
    # The emptiest containers of each group are numbered last-first and dissolved.
    loose_place = F.dense_rank().over(W.partitionBy(F.shiftright("container", 24)).orderBy("fill", "container"))
    marked = first.withColumn("loose", (F.col("fill") < int(capacity * KEEP)) & (loose_place <= REPACK))
    again = _pack_groups(
        marked.where("loose").withColumn("g", F.pmod(F.shiftright("container", 24), F.lit(max(1, math.ceil(groups / BLOCK))))),
        "g", capacity, 1,
    )
    return marked.where("NOT loose").drop("loose").unionByName(again)


def token_counter(path: str):
    """A function from texts to token counts with the public tokenizer file at ``path`` (ranks of byte pairs)."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(x) for x in encoding.encode_ordinary_batch(texts, num_threads=1)]


def token_sizes(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, tokens) for every row; a null text has 0 tokens. The tokenizer's file need only exist on the driver, which
    sends it to the executors; it is read once per task."""
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(SparkFiles.get(name))
        for b in batches:
            texts = pc.fill_null(b.column(1), "").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(texts), pa.int64())], names=["id", "tokens"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id bigint, tokens bigint")
