"""Problem 3: dividing records into clusters of mutually similar ones, each described by size and typical members.

1. Neighbour descent. Records are divided into blocks of similar ones; inside a block every record
   starts with random neighbours and takes better ones from the neighbours of its neighbours, and of
   those that name it, until little changes. A second pass with other blocks links records that the
   first pass kept apart. Blocks have a bounded size; dense regions become several blocks.
2. Community detection by modularity. Local moves inside the blocks of the first pass join records
   into small communities, which become the nodes of a contracted graph; both passes give its edges,
   summed before they leave a task. While the contracted graph has more than ``DRIVER_NODES`` nodes
   or ``DRIVER_LINKS`` links, communities are joined in Spark with the neighbour they gain most modularity
   with; then local moves with contraction finish it on the driver. Where none gains any more above
   those limits, the communities are final as they are.
3. The communities are brought to the number asked for: those of alike mean direction are joined, and
   of those that remain, the ones are kept that most of their own records are close to. The driver sees
   the ``MOST_GROUPS`` largest communities; smaller ones are joined in the tasks.
4. A record belongs to the cluster of its community, or else to the one its links weigh most for. The mean
   directions only reject records below the membership limit; a record that the graph left out although it
   reaches a cluster is added last, and counted (``how``).

Typical members are those of highest weighted degree inside their cluster.

Cases: records without vectors or with an unusable one, and those whose mean is zero, are left out;
exact copies are nodes like any other and fall into one cluster; ties are ordered by number; with
fewer communities than asked for there are fewer clusters; an empty table gives an empty result;
other columns are ignored; of repeated rows of a record the current one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.llm.neighbours import Cells, _mix, binary, matrix, plan_cells, usable_rows
from tarnwell.session import materialize, release

DIM = 24
NEIGHBOURS = 8
BLOCK_ROWS = 1024
#: Cosine with the cluster's mean direction that makes a member; mean directions above it are one cluster.
MEMBER = 0.75
#: Neighbours below this cosine are not linked: two members at the limit, placed independently around the
#: mean direction, have its square. Without it stray records bridge clusters and small ones are swallowed.
LINK = MEMBER**2
#: Nodes and links (both directions) of the contracted graph that the driver takes over.
DRIVER_NODES = 10_000
DRIVER_LINKS = 200_000
#: So many of the largest groups are compared on the driver; smaller ones in the tasks.
MOST_GROUPS = 1024


def record_means(records: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, vec): the mean of each record's vectors, brought to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outer = b.column(1)
            offsets = np.asarray(outer.offsets, dtype=np.int64)
            inner = outer.values
            good, _ = usable_rows(inner, dim)
            before = np.concatenate([[0], np.cumsum(good)])
            n = np.diff(offsets)
            keep = (n > 0) & (before[offsets[1:]] - before[offsets[:-1]] == n) & np.asarray(outer.is_valid())
            rows = np.repeat(keep, n)
            at = np.repeat(np.arange(len(n)), n)[rows]
            span = np.arange(offsets[0], offsets[-1])[rows]
            io = np.asarray(inner.offsets, dtype=np.int64)
            raw = inner.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = raw[io[span][:, None] + np.arange(dim)]
            mean = np.zeros((len(n), dim))
            np.add.at(mean, at, x)
            norm = np.linalg.norm(mean, axis=1)
            keep &= norm > 0
            unit = (mean[keep] / norm[keep][:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), binary(unit)], names=["id", "vec"])

    return (
        records.where(F.col("number").isNotNull() & (F.size("vectors") > 0))
        .select(F.col("number").cast("bigint").alias("id"), F.col("vectors").cast("array<array<float>>").alias("v"))
        .mapInArrow(run, "id bigint, vec binary")
    )


def descend(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, cosines) of each row by neighbour descent; -1 and 0 where there is none that reaches LINK."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = (np.arange(n)[:, None] + 1 + rng.integers(0, max(n - 1, 1), (n, k))) % n
    own = np.arange(n)[:, None]
    cos = np.full((n, k), -2.0, np.float32)
    for _ in range(rounds):
        # Up to k of the rows that name a row, in random order.
        flat = near.ravel()
        order = np.lexsort([rng.random(flat.size), flat])
        first = np.searchsorted(flat[order], np.arange(n))
        at = first[:, None] + np.arange(k)
        named = order[np.minimum(at, flat.size - 1)]
        back = np.where((at < flat.size) & (flat[named] == own), named // k, own)
        around = np.concatenate([near, back], 1)
        pick = rng.integers(0, k, (2, around.shape[1], 2))
        second = np.concatenate([near[around, pick[0, :, 0][None, :]], near[around, pick[0, :, 1][None, :]]], 1)
        pool = np.sort(np.concatenate([around, second], 1), 1)
        bad = pool == own
        bad[:, 1:] |= pool[:, 1:] == pool[:, :-1]
        sims = np.matmul(x[pool], x[:, :, None])[:, :, 0]
        sims[bad] = -2
        top = np.argpartition(-sims, min(k, pool.shape[1]) - 1, axis=1)[:, :k]
        fresh_cos = np.take_along_axis(sims, top, 1)
        gained = (fresh_cos.sum(1) > cos.sum(1) + 1e-4).mean()
        near, cos = np.take_along_axis(pool, top, 1), fresh_cos
        if gained < 0.05:
            break
    return np.where(cos >= LINK, near, -1), np.where(cos >= LINK, cos, 0)


def local_moves(start: np.ndarray, to: np.ndarray, w: np.ndarray, loops: np.ndarray, sweeps: int = 10) -> np.ndarray:
    """Community of each node after moving nodes to the neighbouring community of greatest modularity gain.

    ``start`` (n + 1 offsets), ``to`` and ``w`` list each undirected edge from both ends; ``loops`` is
    the weight already inside each node, counted twice.
    """
    n = len(start) - 1
    label = list(range(n))
    start, to, w = start.tolist(), to.tolist(), w.tolist()
    degree = [sum(w[start[i] : start[i + 1]]) + loops[i] for i in range(n)]
    total = list(degree)
    m2 = sum(degree) or 1.0
    for _ in range(sweeps):
        moved = 0
        for i in range(n):
            a, b = start[i], start[i + 1]
            if a == b:
                continue
            mine, d = label[i], degree[i]
            links: dict[int, float] = {}
            for e in range(a, b):
                c = label[to[e]]
                links[c] = links.get(c, 0.0) + w[e]
            total[mine] -= d
            best, gain = mine, links.get(mine, 0.0) - total[mine] * d / m2
            for c, s in links.items():
                g = s - total[c] * d / m2
                if g > gain + 1e-12:
                    best, gain = c, g
            total[best] += d
            if best != mine:
                label[i] = best
                moved += 1
        if moved <= n // 200:
            break
    return np.unique(label, return_inverse=True)[1]


def edges_csr(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, to, w, loops) of an undirected graph from links a-b, both directions added and summed."""
    loop = a == b
    loops = np.bincount(a[loop], w[loop], n)
    a, b, w = a[~loop], b[~loop], w[~loop]
    key = np.concatenate([a * n + b, b * n + a])
    key, at = np.unique(key, return_inverse=True)
    weight = np.bincount(at, np.concatenate([w, w]), len(key))
    return np.searchsorted(key, np.arange(n + 1) * n), key % n, weight, loops * 2


def modularity_communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, levels: int = 10) -> np.ndarray:
    """Community of each node: local moves, contraction of the communities, and again until nothing joins."""
    label = np.arange(n)
    for _ in range(levels):
        size = int(label.max()) + 1 if n else 0
        joined = local_moves(*edges_csr(size, label[a], label[b], w))
        if len(np.unique(joined)) == size:
            break
        label = joined[label]
    return label


def _weights(cos: np.ndarray) -> np.ndarray:
    return cos.astype(np.float64) ** 2


_LINKS = "id bigint, comm bigint, other bigint, w double"


def _links(ids: np.ndarray, comm: np.ndarray, near: np.ndarray, cos: np.ndarray) -> pa.Table:
    """One row per record and community that its neighbours lie in, with the summed weight."""
    row, col = np.nonzero(near >= 0)
    other, w = comm[near[row, col]], _weights(cos[row, col])
    order = np.lexsort([other, row])
    row, other, w = row[order], other[order], w[order]
    first = np.ones(len(row), bool)
    first[1:] = (np.diff(row) != 0) | (np.diff(other) != 0)
    at = np.flatnonzero(first)
    w = np.add.reduceat(w, at) if len(at) else w
    return pa.table({"id": ids[row[at]], "comm": comm[row[at]], "other": other[at], "w": w})


def blocks(vectors: DataFrame, cells: Cells, dim: int, extra: list[str]) -> DataFrame:
    """``vectors`` with the ``block`` of each row: its cell and, in large cells, a share by a hash of its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cells.home(matrix(b.column("vec"), np.float32, dim)).astype(np.int64)
            share = _mix(np.asarray(b.column("id"))) % cells.base_blocks[cell]
            yield pa.RecordBatch.from_arrays([pa.array((cell << 20) | share), *b.columns], names=["block", *b.schema.names])

    columns = ["id", "vec", *extra]
    return vectors.select(*columns).mapInArrow(run, "block bigint, id bigint, vec binary" + "".join(f", {c} bigint" for c in extra))


def first_pass(blocked: DataFrame, dim: int, k: int) -> DataFrame:
    """(id, vec, comm): neighbour descent and local communities of each block."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x, block = matrix(t.column("vec"), np.float32, dim), t.column("block")[0].as_py()
        near, cos = descend(x, k, block % (1 << 31))
        row, col = np.nonzero(near >= 0)
        local = modularity_communities(len(x), row, near[row, col], _weights(cos[row, col]), levels=1)
        # The first record of a community gives it its number.
        ids = np.asarray(t.column("id"))
        lead = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(lead, local, ids)
        comm = lead[local]
        links = [[] for _ in range(len(x))]
        weights = [[] for _ in range(len(x))]
        found = _links(np.arange(len(x)), comm, near, cos)
        for r, o, w in zip(found.column("id").to_pylist(), found.column("other").to_pylist(), found.column("w").to_pylist(), strict=True):
            links[r].append(o)
            weights[r].append(w)
        return pa.table(
            [t.column("id"), t.column("vec"), pa.array(comm), pa.array(links, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64()))],
            names=["id", "vec", "comm", "others", "ws"],
        )

    return blocked.groupBy("block").applyInArrow(run, "id bigint, vec binary, comm bigint, others array<bigint>, ws array<double>")


def second_pass(blocked: DataFrame, dim: int, k: int) -> DataFrame:
    """(id, comm, other, w): links of neighbour descent in other blocks, as links to communities."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x, block = matrix(t.column("vec"), np.float32, dim), t.column("block")[0].as_py()
        near, cos = descend(x, k, (block + 1) % (1 << 31))
        return _links(np.asarray(t.column("id")), np.asarray(t.column("comm")), near, cos)

    return blocked.groupBy("block").applyInArrow(run, _LINKS)


def relabel(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """``column`` with the communities (comm) of ``pairs`` replaced by what they went into."""
    p = pairs.select(F.col("comm").alias("_from"), F.col("into").alias("_to"))
    return df.join(p, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def coarsen(edges: DataFrame, most: int, links: int = DRIVER_LINKS) -> tuple[DataFrame, DataFrame | None, bool]:
    """Join communities with the one they gain most with until at most ``most`` with ``links`` links are left.

    ``edges``: (a, b, w) with both directions. Gives the contracted edges, the table (comm, into) of what was
    joined, or None, and whether the rest is small. It is not only where joining two communities raises
    modularity nowhere any more. Best is the neighbour of most weight for the product of degrees among those that
    gain: by the gain alone a large community would be the best of all around it. In each round the communities are
    heads, which stay, or tails, which join their best if that is a head: of two that are each other's best the
    greater number is a tail, others are by a hash. So about a third goes in a round and no chains arise.
    """
    mapping, turn = None, 0
    while True:
        nodes, rows = edges.agg(F.count_distinct("a"), F.count("*")).first()
        if nodes <= most and rows <= links:
            return edges, mapping, True
        turn += 1
        degree = edges.groupBy("a").agg(F.sum("w").alias("d"))
        m2 = edges.agg(F.sum("w")).first()[0]
        gain = F.col("w") - F.col("da") * F.col("db") / F.lit(m2)
        scored = (
            edges.where("a <> b").join(degree.withColumnRenamed("d", "da"), "a")
            .join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b").where(gain > 0)
        )
        # The same key for both ends.
        key = F.struct(F.col("w") / (F.col("da") * F.col("db")), -F.least("a", "b"), -F.greatest("a", "b"))
        best = materialize(scored.groupBy("a").agg(F.max_by("b", key).alias("b")), "p3-best")
        if best.isEmpty():
            return edges, mapping, False
        coin = F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0
        sided = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("_back")), "b").select(
            "a", "b", F.when(F.col("a") == F.col("_back"), F.col("a") < F.col("b")).otherwise(coin).alias("head")
        )
        heads = sided.where("head").select(F.col("a").alias("b"))
        pairs = materialize(sided.where("NOT head").join(heads, "b", "left_semi").select(F.col("a").alias("comm"), F.col("b").alias("into")), "p3-pairs")
        release(best)
        old = edges
        renamed = relabel(relabel(edges, "a", pairs), "b", pairs)
        edges = materialize(renamed.groupBy("a", "b").agg(F.sum("w").alias("w")), "p3-edges")
        release(old)
        grown = pairs if mapping is None else relabel(mapping, "into", pairs).unionByName(pairs)
        before, mapping = mapping, materialize(grown, "p3-mapping")
        release(before)
        release(pairs)


def directions(sums: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.maximum(norm, 1e-12)


def merge_alike(sums: np.ndarray, sizes: np.ndarray, alike: float = MEMBER) -> tuple[np.ndarray, np.ndarray]:
    """(candidate of each group, sums of the candidates): groups whose mean directions are ``alike``
    are joined, largest first, so a few stray records do not turn the direction of a large one."""
    of = np.full(len(sizes), -1)
    centres, pointing = np.zeros_like(sums), np.zeros_like(sums)
    used = 0
    for i, own in zip(order := np.argsort(-sizes, kind="stable"), directions(sums[order]), strict=True):
        into = used
        if used:
            cos = pointing[:used] @ own
            best = int(cos.argmax())
            into = best if cos[best] >= alike else used
        of[i] = into
        used = max(used, into + 1)
        centres[into] += sums[i]
        pointing[into] = directions(centres[into : into + 1])[0]
    return of, centres[:used]


def alike_within_blocks(groups: DataFrame, dim: int, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(grp, into, n, s): ``groups`` (grp, n, s) joined where alike inside blocks of similar directions; each goes
    by the least of its groups' numbers, with the size and sum of all on the row of that one."""

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("grp"), binary(directions(_rows_of(b, "s", dim)).astype(np.float32))], names=["id", "vec"])

    pointing = materialize(groups.mapInArrow(pointed, "id bigint, vec binary"), "p3-directions")
    cells = plan_cells(pointing.withColumn("no", F.lit(0)), [], dim, max(n, 1), block_rows)
    placed = blocks(pointing, cells, dim, []).select("block", F.col("id").alias("grp")).join(groups, "grp")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("grp").combine_chunks()
        grp, size = np.asarray(t.column("grp")), np.asarray(t.column("n"))
        of, sums = merge_alike(_rows_of(t, "s", dim), size)
        lead = np.full(len(sums), np.iinfo(np.int64).max)
        np.minimum.at(lead, of, grp)
        return pa.table({"grp": grp, "into": lead[of], "n": np.bincount(of, size, len(sums)).astype(np.int64)[of], "s": sums[of].tolist()}, schema=_MERGED)

    return placed.groupBy("block").applyInArrow(run, "grp bigint, into bigint, n bigint, s array<double>")


_MERGED = pa.schema([("grp", pa.int64()), ("into", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))])


def _rows_of(t: pa.Table | pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return np.array(t.column(column).to_pylist(), dtype=np.float64).reshape(-1, dim)


def candidates(groups: DataFrame, dim: int, most: int = MOST_GROUPS) -> tuple[DataFrame, np.ndarray]:
    """((grp, cand), sums of the candidates): which groups (grp, n, s) of the graph are one cluster's.

    The ``most`` largest groups are joined where alike on the driver. Each smaller group goes to the candidate it
    is alike with. Those that are alike with none are joined with each other in blocks, and the ``most`` largest
    that result are candidates too. So what the driver sees does not grow with the number of stray groups, and a
    group it does not see is smaller than all of those.
    """
    spark = groups.sparkSession

    def largest(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = df.orderBy(F.desc("n"), F.asc("grp")).limit(most).select("grp", "n", "s").toArrow()
        return np.asarray(t.column("grp"), dtype=np.int64), np.asarray(t.column("n"), dtype=np.int64), _rows_of(t, "s", dim)

    ids, size, sums = largest(groups)
    of, centre = merge_alike(sums, size)
    pairs = [(int(g), int(c)) for g, c in zip(ids, of, strict=True)]

    def placed(df: DataFrame, centre: np.ndarray) -> DataFrame:
        pointing = directions(centre)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                cand = np.full(b.num_rows, -1)
                if len(pointing):
                    cos = directions(_rows_of(b, "s", dim)) @ pointing.T
                    cand = np.where(cos.max(1) >= MEMBER, cos.argmax(1), -1)
                yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("n"), b.column("s"), pa.array(cand.astype(np.int32))], names=["grp", "n", "s", "cand"])

        return df.select("grp", "n", "s").mapInArrow(run, "grp bigint, n bigint, s array<double>, cand int")

    smaller = groups.where("false")
    if len(ids):
        last = F.col("n") == int(size[-1])
        smaller = groups.where((F.col("n") < int(size[-1])) | (last & (F.col("grp") > int(ids[-1]))))
    small = materialize(placed(smaller, centre), "p3-small")
    loose = small.where("cand < 0").select("grp", "n", "s")
    kept = small.where("cand >= 0").select("grp", "cand")
    if not loose.isEmpty():
        merged = materialize(alike_within_blocks(loose, dim, loose.count()), "p3-loose")
        new, size, sums = largest(merged.where("grp = into"))
        if len(new):
            of, more = merge_alike(sums, size)
            more_of = spark.createDataFrame([(int(g), int(c) + len(centre)) for g, c in zip(new, of, strict=True)], "into bigint, cand int")
            kept = kept.unionByName(merged.join(more_of, "into").select("grp", "cand"))
            centre = np.concatenate([centre, more])
    return spark.createDataFrame(pairs, "grp bigint, cand int").unionByName(kept), centre


def _doubles(column: str, dim: int) -> Column:
    """The doubles of a binary row (little-endian) as an array."""

    @F.pandas_udf("array<double>")
    def read(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.frombuffer(b"".join(v), np.float64).reshape(-1, dim)))

    return read(column)


def _sums(nodes: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, n, sum) over the vectors of each ``key``, added up inside each task first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            keys, at = np.unique(np.asarray(b.column(0)), return_inverse=True)
            s = np.zeros((len(keys), dim))
            np.add.at(s, at, matrix(b.column(1), np.float32, dim))
            for key_, row, n in zip(keys.tolist(), s, np.bincount(at), strict=True):
                have = held.setdefault(key_, [0, np.zeros(dim)])
                have[0] += int(n)
                have[1] += row
            if len(held) > 100_000:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"k": list(held), "n": [v[0] for v in held.values()], "s": [v[1].tolist() for v in held.values()]},
            schema=pa.schema([("k", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]),
        )

    parts = nodes.select(key, "vec").mapInArrow(partial, "k bigint, n bigint, s array<double>")
    return parts.groupBy("k").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s")
    ).withColumnRenamed("k", key)


def clusters(
    records: DataFrame, k: int, dim: int = DIM, neighbours: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS,
    driver_nodes: int = DRIVER_NODES, most_groups: int = MOST_GROUPS,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members are (id, cluster, cosine, how) with cluster 0 .. k - 1, links (id, w, other_cluster)."""
    spark = records.sparkSession
    vectors = materialize(record_means(records, dim), "p3-means")
    n = max(1, vectors.count())
    with_no = vectors.withColumn("no", F.lit(0))
    cells = plan_cells(with_no, [], dim, n, block_rows)
    other_cells = plan_cells(with_no.withColumn("no", F.lit(1)), [], dim, n, block_rows * 3 // 4)
    nodes = materialize(first_pass(blocks(vectors, cells, dim, []), dim, neighbours), "p3-nodes")
    release(vectors)
    within = nodes.select("id", "comm", F.explode(F.arrays_zip(F.col("others"), F.col("ws"))).alias("e")).select(
        "id", "comm", F.col("e.others").alias("other"), F.col("e.ws").alias("w")
    )
    across = materialize(second_pass(blocks(nodes.select("id", "vec", "comm"), other_cells, dim, ["comm"]), dim, neighbours), "p3-links")
    links = within.unionByName(across)
    one_way = links.groupBy("comm", "other").agg(F.sum("w").alias("w"))
    both = one_way.select(F.col("comm").alias("a"), F.col("other").alias("b"), "w").unionByName(
        one_way.select(F.col("other").alias("a"), F.col("comm").alias("b"), "w")
    )
    edges = materialize(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "p3-edges")
    edges, joined, small = coarsen(edges, driver_nodes)
    # (comm, grp) of every community with a link; a record without any has no group and never leaves the tasks.
    if small:
        e = edges.where("a <= b").toArrow()
        a, b, w = (np.asarray(e.column(c)) for c in ("a", "b", "w"))
        comm = np.unique(np.concatenate([a, b]))
        label = modularity_communities(len(comm), np.searchsorted(comm, a), np.searchsorted(comm, b), np.asarray(w, dtype=np.float64))
        grouped = spark.createDataFrame([(int(c), int(g)) for c, g in zip(comm, label, strict=True)], "comm bigint, grp bigint")
    else:
        grouped = edges.select(F.col("a").alias("comm"), F.col("a").alias("grp")).distinct()
    if joined is not None:
        later = joined.join(grouped.withColumnRenamed("comm", "into"), "into").select("comm", "grp")
        grouped = later.unionByName(grouped)
    labelled = materialize(nodes.select("id", "vec", "comm").join(grouped, "comm", "left"), "p3-groups")
    groups = materialize(_sums(labelled.where("grp IS NOT NULL"), "grp", dim), "p3-sums")
    of, centre = candidates(groups, dim, max(most_groups, k))
    labelled = materialize(labelled.join(of, "grp", "left").select("id", "vec", "comm", F.coalesce("cand", F.lit(-1)).alias("cand")), "p3-labelled")
    # Of the candidates those are kept whose own records reach their direction most often.
    size, own = _reaching(labelled, directions(centre), dim)
    keep = np.argsort(-size, kind="stable")[:k]
    place = np.full(len(centre), -1)
    place[keep] = np.arange(len(keep))
    numbers = spark.createDataFrame([(int(c), int(p)) for c, p in enumerate(place) if p >= 0], "cand int, cluster int")
    labelled = labelled.join(F.broadcast(numbers), "cand", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    centres = np.zeros((k, dim))
    centres[: len(keep)] = _reaching(labelled.withColumn("cand", F.col("cluster")), directions(own[keep]), dim)[1]
    clustered = labelled.where("cluster >= 0").select("comm", F.col("cluster").alias("other_cluster")).distinct()
    linked = links.join(clustered.withColumnRenamed("comm", "other"), "other").select("id", "w", "other_cluster")
    return _members(labelled, linked, directions(centres), dim), linked


def _reaching(labelled: DataFrame, centres: np.ndarray, dim: int, least: float = MEMBER) -> tuple[np.ndarray, np.ndarray]:
    """(number, sum) of the vectors of each candidate (column ``cand``) that reach ``least`` with its direction.

    Added up in each task, which passes on one row per candidate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(centres), np.int64), np.zeros((len(centres), dim))
        for b in batches:
            x, of = matrix(b.column("vec"), np.float32, dim).astype(np.float64), np.asarray(b.column("cand")).astype(np.int64)
            good = of >= 0
            good[good] = np.einsum("ij,ij->i", x[good], centres[of[good]]) >= least
            n += np.bincount(of[good], minlength=len(centres))
            np.add.at(s, of[good], x[good])
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(n[hit], pa.int64()), binary(s[hit])], names=["k", "n", "s"])

    size, sums = np.zeros(len(centres), np.int64), np.zeros((len(centres), dim))
    parts = labelled.where("cand >= 0").select("vec", "cand").mapInArrow(run, "k bigint, n bigint, s binary")
    added = F.array(*[F.sum(F.col("v")[i]) for i in range(dim)])
    parts = parts.select("k", "n", _doubles("s", dim).alias("v")).groupBy("k").agg(F.sum("n").alias("n"), added.alias("v"))
    for r in parts.collect():
        size[r.k], sums[r.k] = r.n, r.v
    return size, sums


def _members(labelled: DataFrame, linked: DataFrame, centres: np.ndarray, dim: int, least: float = MEMBER) -> DataFrame:
    """(id, cluster, cosine, how): the cluster of each record's community, else that of most weight among its links,
    else any, each only where the record reaches ``least`` with the cluster's direction; others are left out.

    ``how`` is ``community``, ``links`` or ``direction``. The last stands for records the graph leaves without a
    cluster although they reach one: neighbours that descent did not find.
    """

    def tested(df: DataFrame, how: str, left: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("vec"), np.float32, dim).astype(np.float64)
                at = np.asarray(b.column("cluster")).astype(np.int64)
                if how == "direction":
                    at = (x @ centres.T).argmax(1) if len(x) else at
                cos = np.where(at >= 0, np.einsum("ij,ij->i", x, centres[np.maximum(at, 0)]), -2.0)
                keep = pa.array(cos < least if left else cos >= least)
                if left:
                    yield pa.RecordBatch.from_arrays([b.column("id").filter(keep), b.column("vec").filter(keep)], names=["id", "vec"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("id").filter(keep), pa.array(at).filter(keep), pa.array(cos).filter(keep)], names=["id", "cluster", "cosine"])

        schema = "id bigint, vec binary" if left else "id bigint, cluster bigint, cosine double"
        out = df.select("id", "vec", "cluster").mapInArrow(run, schema)
        return out if left else out.withColumn("how", F.lit(how))

    own = tested(labelled, "community", False)
    rest = materialize(tested(labelled, "community", True), "p3-rest")
    weight = linked.join(rest.select("id"), "id", "left_semi").groupBy("id", "other_cluster").agg(F.sum("w").alias("w"))
    most = weight.groupBy("id").agg(F.max_by("other_cluster", F.struct("w", -F.col("other_cluster"))).alias("cluster"))
    rest = materialize(rest.join(most, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1))), "p3-rest")
    by_links = tested(rest, "links", False)
    last = tested(rest, "links", True).withColumn("cluster", F.lit(-1))
    return materialize(own.unionByName(by_links).unionByName(tested(last, "direction", False)), "p3-members")


def membership(members: DataFrame) -> DataFrame:
    """(number, cluster_number): each cluster named by its smallest number."""
    least = members.groupBy("cluster").agg(F.min("id").alias("cluster_number"))
    return members.join(least, "cluster").select(F.col("id").alias("number"), "cluster_number")


def describe(members: DataFrame, links: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster_number, size, by_links, by_direction, place, number, degree, cosine): the ``typical`` members of each
    cluster of highest weighted degree inside it, and how many members their community did not bring."""
    mine = links.join(members.select("id", "cluster"), "id").where("cluster = other_cluster")
    inside = mine.groupBy("id").agg(F.sum("w").alias("degree"))
    count = lambda how: F.sum((F.col("how") == how).cast("bigint"))
    heads = members.groupBy("cluster").agg(
        F.min("id").alias("cluster_number"), F.count("*").alias("size"), count("links").alias("by_links"), count("direction").alias("by_direction")
    )
    top = W.partitionBy("cluster").orderBy(F.col("degree").desc(), F.col("id"))
    return (
        members.join(inside, "id", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0.0)))
        .withColumn("place", F.row_number().over(top))
        .where(F.col("place") <= typical)
        .join(heads, "cluster")
        .select("cluster_number", "size", "by_links", "by_direction", "place", F.col("id").alias("number"), "degree", "cosine")
    )
