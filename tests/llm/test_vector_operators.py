"""Problems 2, 3, 4 and 6."""

import math

import numpy as np
import oracles as o
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.llm import communities, neighbours, quantiles, rank_fusion, similar

POINT = "point_id bigint, vector array<float>, deleted boolean, ingested_at timestamp"
ASKED = "query_id bigint, vectors array<array<float>>, ingested_at timestamp"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def points_table(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], None, None) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, POINT).withColumn("id", F.lit("clash")).withColumn("vec", F.lit(1))


# Problem 2.


def near_copies(rng, n, dim):
    base = unit(rng.normal(size=(n, dim)))
    return np.concatenate([base, unit(base[: n // 3] + 0.12 * rng.normal(size=(n // 3, dim)) / math.sqrt(dim))])


def test_pairs_above_a_threshold(spark):
    rng = np.random.default_rng(3)
    x = near_copies(rng, 900, 64)
    copies = np.array([x[5]] * 3 + [x[6] * 4])
    q = {10_000 + i: [x[i].tolist(), unit(rng.normal(size=64)).tolist()] for i in range(20)}
    bad = [(5000, None, None, None), (5001, [0.0] * 64, None, None), (5002, [float("nan")] + [1.0] * 63, None, None), (5003, [1.0] * 3, None, None), (None, x[0].tolist(), None, None), (5004, x[0].tolist(), True, None), (3, x[3].tolist(), None, None)]
    x = np.concatenate([x, copies])
    asked = [(i, v, None) for i, v in q.items()] + [(20_000, None, None), (20_001, [], None), (20_002, [[1.0]], None)]
    got = {tuple(r) for r in similar.similar_points(points_table(spark, x, bad), spark.createDataFrame(asked, ASKED)).expanded().collect()}
    u = unit(x)
    want = {("point", i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.97)) if i < j}
    want |= {("query", int(i), k) for k, vs in q.items() for v in vs for i in np.nonzero(u @ unit(np.array(v)) >= 0.97)[0]}
    assert got == want


def test_empty_tables(spark):
    p, a = spark.createDataFrame([], POINT), spark.createDataFrame([], ASKED)
    assert similar.similar_points(p, a).expanded().count() == 0 and similar.nearest_points(p, a).count() == 0


def test_records_match_both_ways(spark):
    rng = np.random.default_rng(4)
    base = [unit(rng.normal(size=(rng.integers(1, 5), 24))) for _ in range(120)]
    rows = {i: m for i, m in enumerate(base)}
    for i in range(40):
        rows[200 + i] = unit(base[i] + 0.05 * rng.normal(size=base[i].shape) / 5)[::-1]
        rows[300 + i] = np.concatenate([base[i], unit(rng.normal(size=(1, 24)))])  # one vector without counterpart
        rows[400 + i] = base[i]
    table = [(i, m.tolist()) for i, m in rows.items()] + [(900, None), (901, []), (902, [[0.0] * 24]), (903, [base[0][0].tolist(), [1.0]])]
    got = {tuple(r)[1:] for r in similar.similar_records(spark.createDataFrame(table, "number bigint, vectors array<array<float>>")).expanded().collect()}
    want = set()
    for a in rows:
        for b in rows:
            s = rows[a] @ rows[b].T
            if a < b and s.max(1).min() >= 0.97 and s.max(0).min() >= 0.97:
                want.add((a, b))
    assert got == want and len(want) >= 100


def clustered(rng, n, dim, centres=30, spread=0.9):
    c = unit(rng.normal(size=(centres, dim)))
    return unit(c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim)) / math.sqrt(dim))


@pytest.fixture
def small_cells(monkeypatch):
    """Cells of 16 vectors, so that a few thousand make many more cells than are visited; the visits chosen are kept."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    chosen, search = [], similar.visits_for
    monkeypatch.setattr(similar, "visits_for", lambda *a: chosen.append(search(*a)) or chosen[-1])
    return chosen


def test_recall_of_points_and_queries(spark, small_cells):
    rng = np.random.default_rng(5)
    n = 9000
    x, q = clustered(rng, n, 64), clustered(np.random.default_rng(5), 400, 64)
    asked = spark.createDataFrame([(100_000 + 20 * i, [v.tolist()], None) for i, v in enumerate(q)], ASKED)
    got = {}
    for r in similar.nearest_points(points_table(spark, x), asked).collect():
        got.setdefault((r.kind, r.id), set()).add(r.other)
        assert r.kind == "query" or r.cosine == pytest.approx(float(x[r.id] @ x[r.other]), abs=1e-5)
    ids = range(0, n, 20)
    assert sorted(i for k, i in got if k == "point") == list(ids) and len(got) == len(ids) + len(q)
    s = x[::20] @ x.T
    s[np.arange(len(s)), list(ids)] = -2
    near = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(got["point", i] & set(t.tolist())) / 10 for i, t in zip(ids, near)]) >= 0.9
    near = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(got["query", 100_000 + 20 * i] & set(t.tolist())) / 10 for i, t in enumerate(near)]) >= 0.9
    assert small_cells[0].count * 10 <= n // 16


def test_recall_of_tokens(spark, small_cells):
    rng = np.random.default_rng(6)
    x = clustered(rng, 8000, 24, 200, 0.5)
    rows = [(i, x[2 * i : 2 * i + 2].tolist()) for i in range(4000)]
    got = {}
    for r in similar.nearest_tokens(spark.createDataFrame(rows, "number bigint, vectors array<array<float>>")).collect():
        got.setdefault(2 * r.id + r.no, set()).add(2 * r.other + r.other_no)
    ids = [i for i in range(8000) if i // 2 % 20 == 0]
    assert sorted(got) == ids
    s = x[ids] @ x.T
    s[np.arange(8000)[None, :] // 2 == np.array(ids)[:, None] // 2] = -2
    near = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(got[i] & set(t.tolist())) / 10 for i, t in zip(ids, near)]) >= 0.9
    assert small_cells[0].count * 10 <= 8000 // 16


def test_exact_search_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BASE_BLOCK", 300)
    monkeypatch.setattr(neighbours, "VISITOR_BLOCK", 20)
    x = clustered(np.random.default_rng(7), 2000, 64)
    got = {}
    for r in similar.nearest_points(points_table(spark, x), spark.createDataFrame([], ASKED), exact=True).orderBy("place").collect():
        got.setdefault(r.id, []).append(r.other)
    truth = o.neighbours(np.round(x.astype(np.float32).astype(float), 9), 10)
    assert got == {i: truth[i].tolist() for i in range(0, 2000, 20)}


def test_pairs_across_cells_are_all_found(spark, monkeypatch):
    """Vectors spread evenly, so that most pairs have their ends in different cells."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    rng = np.random.default_rng(8)
    x = unit(rng.normal(size=(4000, 64)))
    x[2000:] = unit(x[:2000] + 0.23 * rng.normal(size=(2000, 64)) / 8)
    q = unit(x[:300] + 0.2 * rng.normal(size=(300, 64)) / 8)
    asked = spark.createDataFrame([(10_000 + i, [v.tolist()], None) for i, v in enumerate(q)], ASKED)
    found = similar.similar_points(points_table(spark, x), asked)
    got = {tuple(r) for r in found.expanded().collect()}
    want = {("point", int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.97)) if i < j}
    want |= {("query", int(i), 10_000 + int(j)) for i, j in zip(*np.nonzero(x @ q.T >= 0.97))}
    assert got == want and len(want) > 1500


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 1000), st.sampled_from([0.5, 0.8, 0.97]))
def test_cells_reached_hold_all_partners(seed, threshold):
    rng = np.random.default_rng(seed)
    x = unit(rng.normal(size=(300, 6))).astype(np.float32)
    cells = neighbours.Cells(unit(rng.normal(size=(25, 6))).astype(np.float32), np.zeros(25), np.zeros(25))
    one = set(zip(*map(np.ndarray.tolist, cells.visited(x, neighbours.one_searches(threshold)))))
    both = set(zip(*map(np.ndarray.tolist, cells.visited(x, neighbours.both_search(threshold)))))
    home = cells.home(x)
    for i, j in zip(*np.nonzero(x @ x.T >= threshold)):
        assert (i, home[j]) in one and ((i, home[j]) in both or (j, home[i]) in both)


def test_copies_are_members_until_expanded(spark, monkeypatch):
    monkeypatch.setattr(similar, "COPIES_AT_ONCE", 7)
    x = np.repeat(np.eye(64)[:2], [60, 3], axis=0)
    found = similar.similar_points(points_table(spark, x), spark.createDataFrame([(1000, [x[0].tolist()], None)], ASKED))
    assert {tuple(r) for r in found.pairs.collect()} == {("query", 0, 1000)}
    assert {(r.id, r.rep) for r in found.copies.where("kind = 'point'").collect()} == {(i, 0) for i in range(1, 60)} | {(61, 60), (62, 60)}
    every = [tuple(r) for r in found.expanded().collect()]
    assert len(every) == len(set(every)) == 60 * 59 // 2 + 3 + 60


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 1000))
def test_bound_of_the_codes_holds(seed):
    rng = np.random.default_rng(seed)
    a, b = (unit(rng.normal(size=(20, 24)) * rng.exponential(size=24)).astype(np.float32) for _ in range(2))
    cos, bound = neighbours.products(neighbours.encode(a), neighbours.encode(b))
    assert (np.abs(cos - a.astype(float) @ b.T.astype(float)) <= bound).all()


def test_dense_cells_become_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = near_copies(rng, 300, 64)
    monkeypatch.setattr(neighbours, "BASE_BLOCK", 20)
    monkeypatch.setattr(neighbours, "VISITOR_BLOCK", 50)
    got = {tuple(r)[1:] for r in similar.similar_points(points_table(spark, x), spark.createDataFrame([], ASKED)).expanded().collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.97)) if i < j}


def with_a_common_vector(rng, n, dim, near):
    """Vectors of which the last third are one; ``near`` of the others lie at about cosine 0.98 from it."""
    x = unit(rng.normal(size=(n, dim)))
    x[:near] = unit(x[-1] + 0.2 * rng.normal(size=(near, dim)) / math.sqrt(dim))
    x[n - n // 3 :] = x[-1]
    return x


def test_a_common_vector_hides_no_pairs(spark):
    rng = np.random.default_rng(11)
    n = 9000
    x = with_a_common_vector(rng, n, 64, 40)
    x[100:2100] = unit(x[2100:4100] + 0.12 * rng.normal(size=(2000, 64)) / 8)
    got = similar.similar_points(points_table(spark, x), spark.createDataFrame([(7, [x[-1].tolist()], None)], ASKED)).expanded()
    got = {tuple(r) for r in got.where(f"kind = 'query' OR id_a < {n - n // 3}").collect()}
    i, j = np.nonzero(x[: n - n // 3] @ x.T >= 0.97)
    want = {("point", int(a), int(b)) for a, b in zip(i, j) if a < b}
    want |= {("query", int(a), 7) for a in np.nonzero(x @ x[-1] >= 0.97)[0]}
    assert got == want


def test_cells_of_a_common_vector(spark):
    x = with_a_common_vector(np.random.default_rng(12), 60_000, 16, 200).astype(np.float32)
    df = spark.createDataFrame([(i, 0, r.tobytes()) for i, r in enumerate(x)], neighbours.VECTORS)
    cells = neighbours.plan_cells(df, [(df, neighbours.both_search(0.97))], 16, len(x))
    c = cells.centroids
    assert np.sort(c @ c.T, axis=1)[:, -2].max() < 0.9999 and len(c) > 100
    tied = neighbours.Cells(np.repeat(c[:1], 50, axis=0), np.zeros(50), np.zeros(50))
    assert (tied.nearest(x[:100], 6)[1].reshape(100, 6) == tied.home(x[:100])[:, None]).any(1).all()


def test_nearest_of_a_common_vector(spark):
    rng = np.random.default_rng(13)
    n = 30_000
    x = with_a_common_vector(rng, n, 64, 400)
    hot = n - n // 3
    x[1000:4000] = unit(x[4000:7000] + 0.5 * rng.normal(size=(3000, 64)) / 8)
    asked = [(20, [x[-1].tolist(), x[20].tolist()], None)]
    got = {}
    for r in similar.nearest_points(points_table(spark, x), spark.createDataFrame(asked, ASKED)).orderBy("place").collect():
        got.setdefault((r.kind, r.id, r.no), []).append(r.other)
    least = list(range(hot, hot + 11))
    for i in range(hot, n, 20):
        assert got["point", i, 0] == [j for j in least if j != i][:10]
    assert got["query", 20, -1] == least[:10] and got["query", 20, -2][0] == 20
    for i in range(0, 400, 20):  # all of them lie nearest to the common vector
        cos = x[i] @ x.T
        assert set(got["point", i, 0]) == set(np.lexsort([np.arange(n), -np.where(np.arange(n) == i, -9, np.round(cos, 6))])[:10].tolist())
    pairs = [(i, i + 3000) for i in range(1000, 4000, 20)]
    assert np.mean([b in got["point", a, 0] for a, b in pairs]) >= 0.95


def test_nearest_of_a_common_token(spark):
    rng = np.random.default_rng(14)
    hot = unit(rng.normal(size=24))
    rows = [[hot.tolist()] * (1 + (i % 5 == 0)) + unit(rng.normal(size=(2, 24))).tolist() for i in range(3000)]
    got = {}
    found = similar.nearest_tokens(spark.createDataFrame(list(enumerate(rows)), "number bigint, vectors array<array<float>>"), k=4)
    for r in found.orderBy("place").collect():
        got.setdefault((r.id, r.no), []).append((r.other, r.other_no))
    members = [(i, no) for i in range(20) for no in range(1 + (i % 5 == 0))]
    assert len(got) == 150 * 4 and all(len(v) == 4 for v in got.values())
    for i in range(0, 3000, 20):
        assert got[i, 0] == got[i, 1] == [m for m in members if m[0] != i][:4]


# Problem 3.


def test_planted_clusters(spark):
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    truth, rows = {}, []
    for c in range(6):
        for _ in range([400, 120, 60, 40, 30, 25][c]):
            i = len(rows)
            truth[i] = c
            m = unit(q[c] + 0.45 * rng.normal(size=24) / math.sqrt(24))
            rows.append((i, (np.stack([m, m * 3]) * rng.uniform(0.2, 5)).tolist()))
    for _ in range(60):
        rows.append((len(rows), [unit(q[6:].T @ rng.normal(size=18)).tolist()]))
    rows += [(2000, None), (2001, []), (2002, [[0.0] * 24]), (2003, [[1.0] + [0.0] * 23, [-1.0] + [0.0] * 23]), (2004, [[1.0]])]
    df = spark.createDataFrame(rows, "number bigint, vectors array<array<float>>").withColumn("cluster", F.lit("clash"))
    for nodes, groups in ((50_000, 1024), (10, 6), (0, 6)):  # contracted on the driver, in Spark first, and only there
        members, links = communities.clusters(df, 6, block_rows=200, driver_nodes=nodes, most_groups=groups)
        got = {r.number: r.cluster_number for r in communities.membership(members).collect()}
        assert got == {i: min(j for j, d in truth.items() if d == c) for i, c in truth.items()}
    described = communities.describe(members, links).collect()
    assert {r.cluster_number: r["size"] for r in described} == {min(j for j, d in truth.items() if d == c): n for c, n in enumerate([400, 120, 60, 40, 30, 25])}
    assert all(r.degree > 0 for r in described)


def test_strays_stay_off_the_driver(spark, monkeypatch):
    """What is compared on the driver does not grow with records that belong nowhere."""
    rng = np.random.default_rng(21)
    centres = np.eye(24)[:3]
    seen = []
    joined = communities.merge_alike
    monkeypatch.setattr(communities, "merge_alike", lambda sums, *a: seen.append(len(sums)) or joined(sums, *a))
    for strays in (200, 1500):
        members = [unit(centres[i % 3] + 0.4 * rng.normal(size=24) / math.sqrt(24)) for i in range(300)]
        rows = [(i, [x.tolist()]) for i, x in enumerate([*members, *unit(rng.normal(size=(strays, 24)) * ([0] * 3 + [1] * 21))])]
        seen.clear()
        found, _ = communities.clusters(spark.createDataFrame(rows, "number bigint, vectors array<array<float>>"), 3, block_rows=200, most_groups=8)
        got = {r.number: r.cluster_number for r in communities.membership(found).collect()}
        assert got == {i: i % 3 for i in range(300)} and max(seen) <= 8


def test_merging_alike_equals_plain_version():
    rng = np.random.default_rng(2)
    sums, sizes = rng.normal(size=(60, 3)), rng.integers(1, 9, 60)
    centres, want = [], np.empty(60, int)
    for i in np.argsort(-sizes, kind="stable"):
        cos = [float(unit(c) @ unit(sums[i])) for c in centres]
        if cos and max(cos) >= 0.75:
            want[i] = int(np.argmax(cos))
            centres[want[i]] = centres[want[i]] + sums[i]
        else:
            want[i] = len(centres)
            centres.append(sums[i].copy())
    of, found = communities.merge_alike(sums, sizes)
    assert (of == want).all() and np.allclose(found, centres)


def test_no_records(spark):
    members, links = communities.clusters(spark.createDataFrame([], "number bigint, vectors array<array<float>>"), 3)
    assert members.count() == 0 and communities.describe(members, links).count() == 0


def test_descent_finds_neighbours():
    x = unit(np.random.default_rng(9).normal(size=(500, 8))).astype(np.float32)
    near, _ = communities.descend(x, 8, 1)
    truth = o.neighbours(x, 8)
    s = x @ x.T
    hits = [len({j for j in near[i] if j >= 0} & set(truth[i].tolist())) / max(1, sum(s[i, j] >= communities.LINK for j in truth[i])) for i in range(500)]
    assert np.mean(hits) > 0.85


def test_modularity_separates_two_cliques():
    a, b = np.array([(i, j) for c in (0, 5) for i in range(c, c + 5) for j in range(i)if j >= c] + [(0, 5)]).T
    label = communities.modularity_communities(10, a, b, np.ones(len(a)))
    assert len(set(label[:5])) == 1 and len(set(label[5:])) == 1 and label[0] != label[5]


# Problem 4.


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40).map(float), min_size=1, max_size=60), min_size=1, max_size=9), st.integers(4, 30))
def test_ranks_stay_bounds(parts, size):
    s = quantiles.merge_all([quantiles.compress(quantiles.exact(np.array(p)), size) for p in parts], size)
    values = np.sort(np.concatenate([np.array(p) for p in parts]))
    assert s[3] == len(values) and len(s[0]) <= size
    assert s[0][0] == values[0] and s[0][-1] == values[-1]
    for rank in range(1, len(values) + 1):
        estimate, low, high, error = quantiles.at_rank(s, rank)
        assert low <= values[rank - 1] <= high
        at = np.flatnonzero(values == estimate) + 1
        assert np.abs(at - rank).min() <= error


def test_error_stays_small():
    rng = np.random.default_rng(0)
    parts = [rng.lognormal(size=5000) for _ in range(40)]
    s = quantiles.merge_all([quantiles.compress(quantiles.exact(p), 512) for p in parts], 512)
    n = 200_000
    for p in (0.01, 0.5, 0.99):
        assert quantiles.at_rank(s, int(p * n))[3] <= 0.02 * n


LOG = "run_id bigint, collection string, query_idx int, rep int, elapsed_ms double, run_at timestamp, ingested_at timestamp"


def log_table(spark, n=3000):
    from datetime import datetime, timedelta

    rng, rows, start = np.random.default_rng(1), [], datetime(2025, 1, 1)
    for run in range(6):
        for q in range(n if run == 0 else 40):
            at = start + timedelta(hours=int(rng.integers(0, 60)))
            rows.append((run, "ab"[run % 2], q, 0, float(rng.lognormal()), at, at))
    bad = [(1, "b", 900 + i, 0, v, start, start) for i, v in enumerate((None, float("nan"), -1.0, 0.0, float("inf")))]
    repeats = [(*r[:6], r[6] + timedelta(days=1)) for r in rows[:50]]
    more = [(None, "a", 1, 1, 1.0, start, start), (7, "a", 1, 1, None, start, start)]
    return spark.createDataFrame(rows + bad + repeats + more, LOG).withColumn("n", F.lit("clash")), rows


def test_percentiles_of_runs_collections_and_days(spark):
    df, rows = log_table(spark)
    by = {}
    for r in rows:
        by.setdefault(("run", r[0]), []).append(r[4])
        by.setdefault(("collection", r[1]), []).append(r[4])
        by.setdefault(("day", str(r[5].date())), []).append(r[4])
    for size in (4096, 64):
        for kind, out in (("run", quantiles.run_percentiles(df, (0.5, 0.99), size)), ("collection", quantiles.rollup_percentiles(df, "collection", (0.5, 0.99), size)), ("day", quantiles.rollup_percentiles(df, "day", (0.5, 0.99), size))):
            got = out.collect()
            assert {(kind, r[0]) for r in got} == {k for k in by if k[0] == kind}
            for r in got:
                v = np.array(by[kind, r[0]])
                assert r.n == len(v)
                for p, name in ((0.5, "p50"), (0.99, "p99")):
                    true = o.place(v, p)
                    assert r[f"{name}_low"] <= true <= r[f"{name}_high"]
                    assert (np.sort(v) == r[name]).any() and (size < 4096 or r[name] == true)


def test_misstated_runs_with_small_summaries(spark):
    df, rows = log_table(spark)
    reports, want = [], set()
    for run in range(6):
        v = np.array([r[4] for r in rows if r[0] == run])
        p50, p99 = o.place(v, 0.5), o.place(v, 0.99)
        stated = [(p50, p99), (p50 * 1.3, p99), (None, p99 * 0.7), (None, None), (p50 * 1.19, p99 * 0.81), (float("nan"), p99)][run]
        if run in (1, 2):
            want.add(run)
        reports += [(run, *stated)] * 2
    rep = spark.createDataFrame(reports + [(7, 1.0, 1.0), (99, 1.0, 1.0), (None, 1.0, 1.0)], "run_id bigint, p50_ms double, p99_ms double")
    for size in (4096, 16):
        assert {r.run_id for r in quantiles.misstated_runs(df, rep, size=size).collect()} == want


def test_levels_of_merging(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN_IN", 2)
    df, rows = log_table(spark, 300)
    got = {r.run_id: r.p50 for r in quantiles.run_percentiles(df).collect()}
    assert got[0] == o.place(np.array([r[4] for r in rows if r[0] == 0]), 0.5)


def test_any_number_of_summaries(spark):
    """More summaries in a group than one level of merging takes, with few held at once."""
    rng, m, values = np.random.default_rng(3), quantiles.Merger(64), []
    for i in range(quantiles.FAN_IN**2 + 100):
        v = np.round(rng.lognormal(size=int(rng.integers(1, 40))), 2)
        values.append(v)
        m.add(quantiles.compress(quantiles.exact(v), 64))
        assert i % 500 or max(map(len, m.levels)) < quantiles.FAN_IN
    s, v = m.result(), np.sort(np.concatenate(values))
    assert s[3] == len(v) and len(s[0]) <= 64 and len(m.levels) == 3
    for p in (0.0, 0.01, 0.5, 0.9, 0.99, 1.0):
        rank = int(p * (len(v) - 1)) + 1
        estimate, low, high, error = quantiles.at_rank(s, rank)
        at = np.searchsorted(v, estimate, "left") + 1, np.searchsorted(v, estimate, "right")
        assert low <= v[rank - 1] <= high and at[0] - error <= rank <= at[1] + error and error <= 0.15 * len(v)


def test_verdicts(spark):
    rows = [(130.0, 90.0, 100.0, True), (130.0, 100.0, 120.0, None), (100.0, 95.0, 110.0, False), (70.0, 95.0, 110.0, True), (85.0, 100.0, 110.0, None), (None, 1.0, 2.0, False), (float("nan"), 1.0, 2.0, False)]
    df = spark.createDataFrame(rows, "s double, lo double, hi double, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", quantiles.verdict("s", "lo", "hi", 0.2)).collect())


def test_settled_percentiles(spark):
    df, rows = log_table(spark, 600)
    for by, at in (("run_id", lambda r: r[0]), ("collection", lambda r: r[1]), ("day", lambda r: str(r[5].date()))):
        for r in quantiles.settled(df, by, 16).collect():
            v = np.array([x[4] for x in rows if at(x) == r[by]])
            assert (r.n, r.p50, r.p99) == (len(v), o.place(v, 0.5), o.place(v, 0.99))


# Problem 6.

HIT = "query_id bigint, channel string, number bigint, raw_score double"


@pytest.mark.parametrize("hot", [200_000, 5])
def test_fusion_equals_plain_version(spark, hot):
    rng = np.random.default_rng(2)
    rows = []
    for q in range(8):
        for c in ("bm25", "dense_l2", "sparse_dot")[: 1 + q % 3]:
            for n in rng.permutation(30)[: rng.integers(1, 25)]:
                rows.append((q, c, int(n), float(np.round(rng.normal() * 10 ** (q % 3), 1))))
    rows += [(0, "bm25", 1, None), (0, "bm25", 2, float("nan")), (1, "x", 3, float("inf")), (None, "bm25", 1, 1.0), (1, None, 1, 1.0), (1, "bm25", None, 1.0)]
    rows += rows[:20] + [(q, c, n, s - 1 if c != "dense_l2" else s + 1) for q, c, n, s in rows[:20] if s is not None]
    df = spark.createDataFrame(rows, HIT).withColumn("total", F.lit("clash")).withColumn("sort_key", F.lit(0.0))
    best = {}
    for q, c, n, s in rows:
        if None not in (q, c, n, s) and math.isfinite(s):
            s = -s if c == "dense_l2" else s
            m = best.setdefault(q, {}).setdefault(c, {})
            m[n] = max(m.get(n, -1e9), s)
    want = {}
    for q, channels in best.items():
        total, ranks = {}, {}
        for m in channels.values():
            for r, n in enumerate(sorted(m, key=lambda n: (-m[n], n)), 1):
                total[n] = total.get(n, 0) + 1 / (60 + r)
                ranks.setdefault(n, []).append(r)
        for p, n in enumerate(sorted(total, key=lambda n: (-round(total[n], 12), n)), 1):
            want[q, n] = (p, len(ranks[n]), len(channels), max(ranks[n]))
    got = rank_fusion.reciprocal_rank_fusion(df, hot=hot)
    assert {(r.query_id, r.number): (r.position, r.channels, r.of_channels, r.worst_rank) for r in got.collect()} == want
    lead = {tuple(r) for r in rank_fusion.unanimous_leaders(got).collect()}
    assert lead == {k for k, v in want.items() if v[1] == v[2] >= 2 and v[3] <= 2}
    assert rank_fusion.reciprocal_rank_fusion(df.where("false"), hot=hot).count() == 0


def test_places_of_a_hot_group_of_ties(spark):
    rows = [(1, 0.5, i) for i in range(900)] + [(2, float(i % 3), i) for i in range(90)]
    df = spark.createDataFrame(rows, "q int, s double, n bigint").repartition(4)
    got = {(r.q, r.n): r.place for r in rank_fusion.ranked(df, ["q"], "s", "n", "place").collect()}
    want = {(q, n): i for q in (1, 2) for i, (_, n) in enumerate(sorted((-s, n) for p, s, n in rows if p == q), 1)}
    assert got == want


@pytest.mark.parametrize("k", [0.0, 1.0, 10.0, 60.0])
def test_last_place_of_a_leader(k):
    """Random channels in which record 0 is among the two best of each: its total reaches the bound and its place too."""
    rng = np.random.default_rng(int(k))
    last = rank_fusion.last_place(2, k)
    for _ in range(300):
        c, totals = int(rng.integers(2, 7)), {}
        for _ in range(c):
            order = [int(n) for n in rng.permutation(np.arange(1, 9))]
            order.insert(int(rng.integers(0, 2)), 0)
            for r, n in enumerate(order, 1):
                totals[n] = totals.get(n, 0) + 1 / (k + r)
        assert totals[0] >= c / (k + 2) - 1e-9
        assert sum(t >= totals[0] - 1e-12 for t in totals.values()) <= last
