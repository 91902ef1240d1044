import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.functions.predicates import Eq
from tarnwell.operators.context import ContextOptions
from tarnwell.plans.calibration import Calibration, key
from tarnwell.plans.engine import Collection
from tarnwell.plans.planner import Stats, auto_channels, choose_access, compile_plan, intent, override
from tarnwell.plans.request import Adaptive, Bm25, Dense, Fusion, InvalidRequest, Objective, Representations, Rerank, RetrieveRequest, Sparse
from tarnwell.sources.points import Points
from tarnwell.sources import store as store_module
from tarnwell.sources.store import Collections, ConfigMismatch, Conflict, IndexConfig, InvalidDocument, Store

DOC = "id bigint, text string, metadata string, chunk struct<parent: string, position: bigint>, dense map<string, array<float>>, multivector map<string, array<array<float>>>, sparse map<string, array<struct<feature: bigint, weight: float>>>"


def corpus(spark):
    rows = [
        (1, "E123 repair", '{"tenant": "a"}', ("p", 0), {"semantic": [0.8, 0.6]}, {"tok": [[0.8, 0.6]]}, {"sp": [(4294967295, 1.0)]}),
        (2, "E123 manual", '{"tenant": "a"}', ("p", 1), {"semantic": [0.6, 0.8]}, {"tok": [[0.0, 1.0]]}, {"sp": [(2, 1.0), (2, 2.0)]}),
        (3, "E123 repair repair", '{"tenant": "denied"}', ("q", 0), {"semantic": [1.0, 0.0]}, {"tok": [[1.0, 0.0]]}, None),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    c = Collection.open(spark, str(tmp_path_factory.mktemp("c") / "main"), IndexConfig(2, centroids=2, fde_ksim=1, fde_projected=2, fde_repetitions=2))
    c.upsert(corpus(spark))
    return c


def ids(response):
    return [r.id for r in response.matches.orderBy("position").collect()]


def test_filter_works_before_the_cut(collection):
    r = collection.retrieve(RetrieveRequest((Dense("semantic", (1.0, 0.0), 1), Bm25("E123 repair", 1)), filter=Eq("tenant", "a"), limit=3))
    assert set(ids(r)) <= {1, 2} and r.trace.eligible == 2


def test_plan_equals_trace(collection):
    q = RetrieveRequest((Dense("semantic", (1.0, 0.0), 3), Bm25("E123 repair", 3)), limit=3)
    assert collection.plan(q).to_dict() == collection.retrieve(q).trace.plan


def test_sparse_and_rerank(collection):
    assert ids(collection.retrieve(RetrieveRequest((Sparse("sp", ((2, 1.0), (4294967295, 0.5))),)))) == [2, 1]
    r = collection.retrieve(
        RetrieveRequest((Dense("semantic", (1.0, 0.0)), Bm25("repair E123")), limit=1, rerank=Rerank(((0.0, 1.0),), "tok", 3, Adaptive(1, 0.0)))
    )
    assert r.trace.reranked == 1 and len(ids(r)) == 1


def test_neighbours_and_duplicates(collection):
    r = collection.retrieve(RetrieveRequest((Bm25("repair"),), context=ContextOptions(neighbours=1), limit=10))
    assert [(m.id, m.expanded_from) for m in r.matches.orderBy("position").collect()][:2] == [(3, None), (1, None)]


def test_ann_equals_exact_on_all_lists(collection):
    assert collection.build_dense_ann("semantic", 2) == 3
    q = lambda b: RetrieveRequest((Dense("semantic", (0.9, 0.1), 3, b, 64),), limit=3)
    assert ids(collection.retrieve(q("ann"))) == ids(collection.retrieve(q("exact")))
    with pytest.raises(InvalidRequest):
        collection.plan(RetrieveRequest((Dense("semantic", (1.0,)),)))


def test_token_queries_and_rebuilds(spark, tmp_path):
    c = Collection.open(spark, str(tmp_path / "t"), IndexConfig(2, centroids=2, residual_bits=8, fde_ksim=1, fde_projected=2, fde_repetitions=4))
    rows = [(i, [[float(np.cos(i)), float(np.sin(i))]]) for i in range(6)]
    c.upsert(spark.createDataFrame(rows, "id bigint, vectors array<array<float>>"))
    with pytest.raises(ValueError):
        c.query(np.array([[1.0, 0.0]]), 1)
    c.train(np.array([r[1][0] for r in rows]), 3)
    assert c.query(np.array([rows[2][1][0]]), 2, 6).orderBy(F.desc("score")).first().id == 2
    assert c.query_with_probes(np.array([rows[3][1][0]]), 1, 6, 2).first().id == 3
    assert c.build_fde_ann(2) == 6 and c.ready() == {None} and c.auto_compact_fde_ann(2) is None
    c.upsert(spark.createDataFrame([(i, [[1.0, 0.1 * i]]) for i in range(10, 14)], "id bigint, vectors array<array<float>>"))
    assert not c.ready() and c.auto_compact_fde_ann(2) == 10 and c.ready() == {None}


def test_batch_keeps_errors_apart(collection):
    a, b = collection.retrieve_batch([RetrieveRequest((Dense("none", (1.0, 0.0)),)), RetrieveRequest((Bm25("repair"),))])
    assert isinstance(a, InvalidRequest) and ids(b)


def test_batch_equals_single_requests(collection):
    collection.build_dense_ann("semantic", 2)
    shapes = [
        lambda v: RetrieveRequest((Dense("semantic", v, 3, "exact"), Bm25("E123 repair", 3)), limit=3),
        lambda v: RetrieveRequest((Dense("semantic", v, 3, "ann", 64),), limit=2),
        lambda v: RetrieveRequest((Sparse("sp", ((2, v[0]), (4294967295, 0.5))),), filter=Eq("tenant", "a")),
        lambda v: RetrieveRequest((Dense("semantic", v), Bm25("repair")), limit=1, rerank=Rerank((v,), "tok", 3, Adaptive(1, 0.9))),
        lambda v: RetrieveRequest((Bm25("repair"),), context=ContextOptions(neighbours=1), limit=10),
        lambda v: RetrieveRequest((Dense("none", v),)),
    ]
    requests = [f(v) for v in ((1.0, 0.0), (0.6, 0.8)) for f in shapes]
    for r, got in zip(requests, collection.retrieve_batch(requests), strict=True):
        if r.prefetch[0].kind == "dense" and r.prefetch[0].field == "none":
            assert isinstance(got, InvalidRequest)
            continue
        one = collection.retrieve(r)
        rows = lambda x: [(m.id, round(m.score, 9), m.expanded_from, m.sources) for m in x.matches.orderBy("position").collect()]
        assert rows(got) == rows(one) and rows(one)
        assert (got.trace.reranked, got.trace.agreement) == (one.trace.reranked, one.trace.agreement)


def test_a_reopened_collection_has_its_indexes_and_codec(spark, tmp_path):
    c = Collection.open(spark, str(tmp_path / "c"), IndexConfig(2, centroids=2, residual_bits=4, fde_ksim=1, fde_projected=2, fde_repetitions=2))
    rows = [(i, {"f": [float(np.cos(i)), float(np.sin(i))]}, [[float(np.cos(i)), float(np.sin(i))]]) for i in range(8)]
    c.upsert(spark.createDataFrame(rows, "id bigint, dense map<string, array<float>>, vectors array<array<float>>"))
    c.train(np.array([r[2][0] for r in rows]), 3)
    c.build_dense_ann("f"), c.build_fde_ann()
    again = Collection.open(spark, str(tmp_path / "c"))
    assert again.ready() == {"f", None} and np.allclose(again.codec.centroids, c.codec.centroids)
    q = RetrieveRequest((Dense("f", (1.0, 0.2), 3, "ann", 64),), limit=3)
    assert again.plan(q).channels[0].operator == "ann_dense" and ids(again.retrieve(q)) == ids(c.retrieve(q))
    assert [tuple(r) for r in again.query(np.array([[1.0, 0.0]]), 2).collect()] == [tuple(r) for r in c.query(np.array([[1.0, 0.0]]), 2).collect()]
    c.upsert(spark.createDataFrame([(9, {"f": [1.0, 0.0]})], "id bigint, dense map<string, array<float>>"))
    assert Collection.open(spark, str(tmp_path / "c")).ready() == set()


def test_writers_cannot_lose_each_others_batches(spark, tmp_path):
    a = Store(spark, str(tmp_path / "s"), IndexConfig(2))
    b = Store(spark, str(tmp_path / "s"))
    batch = lambda i: spark.createDataFrame([(i, "t")], "id bigint, text string")
    a.upsert(batch(1))
    with pytest.raises(Conflict):
        b.upsert(batch(2))
    with pytest.raises(Conflict):
        b.compact()
    b.refresh()
    b.upsert(batch(2))
    a.refresh()
    assert {r.id for r in a.documents().collect()} == {1, 2} and a.documents(1).count() == 1
    with pytest.raises(InvalidDocument):
        a.upsert(batch(3).unionByName(batch(3)))
    a.vacuum(1)
    assert a.documents().count() == 2


def test_segments_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "SEGMENTS", 3)
    s = Store(spark, str(tmp_path / "s"), IndexConfig(2))
    for i in range(5):
        s.upsert(spark.createDataFrame([(i, f"v{i}"), (100, f"v{i}")], "id bigint, text string"))
    assert len(s.pointer.segments) == 1 and s.pointer.base
    assert {r.id: r.text for r in s.documents().collect()} == {**{i: f"v{i}" for i in range(5)}, 100: "v4"}


def test_store_state_machine(spark, tmp_path):
    rng, truth = np.random.default_rng(5), {}
    s = Store(spark, str(tmp_path / "s"), IndexConfig(2))
    for step in range(8):
        op, i = rng.integers(0, 3), int(rng.integers(0, 4))
        if op < 2:
            s.upsert(spark.createDataFrame([(i, f"t{step}")], "id bigint, text string"))
            truth[i] = f"t{step}"
        else:
            assert s.delete(i) == (truth.pop(i, None) is not None)
        if step == 4:
            s = Store(spark, str(tmp_path / "s"))
        assert {r.id: r.text for r in s.documents().collect()} == truth
    assert s.compact()["bytes_after"] > 0 and {r.id: r.text for r in s.documents().collect()} == truth
    with pytest.raises(ConfigMismatch):
        Store(spark, str(tmp_path / "s"), IndexConfig(3))


def test_store_batches_are_atomic(spark, tmp_path):
    s = Collections(spark, str(tmp_path)).create("one", IndexConfig(2))
    s.upsert(spark.createDataFrame([(1, {"f": [1.0, 0.0]})], "id bigint, dense map<string, array<float>>"))
    g = s.generation
    for bad in ({"f": [1.0]}, {"f": [float("nan"), 1.0]}):
        with pytest.raises(InvalidDocument):
            s.upsert(spark.createDataFrame([(2, {"f": [1.0, 1.0]}), (3, bad)], "id bigint, dense map<string, array<float>>"))
    assert s.generation == g and s.documents().count() == 1
    last = spark.createDataFrame([(5, "a", 1), (5, "b", 2)], "id bigint, text string, seq bigint")
    s.upsert(last)
    assert s.documents().where("id = 5").first().text == "b"
    assert Collections(spark, str(tmp_path)).names() == ["one"]
    with pytest.raises(ValueError):
        Collections(spark, str(tmp_path)).create("../x", IndexConfig(2))


def test_points(spark, tmp_path):
    p = Points(spark, str(tmp_path / "p"), 2)
    p.insert(spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], None)], "id bigint, vector array<float>, payload string"))
    p.insert_new(spark.createDataFrame([([0.6, 0.8],)], "vector array<float>"))
    assert p.live().count() == 3
    p.update_payload(2, "y")
    assert p.delete(1) and not p.delete(1)
    with pytest.raises(ValueError):
        p.insert(spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, vector array<float>"))
    p.purge()
    with pytest.raises(ValueError):
        p.insert(spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, vector array<float>"))
    assert {r.id: r.payload for r in p.live().collect()}[2] == "y"
    assert p.search([0.0, 1.0], 1).first().id == 2


def stats(**kw):
    return Stats(1000, 1000, 1000, 1000, 2, 8, {"semantic": 1000}, **kw)


def test_policy():
    schema = {"semantic": ("dense", 2)}
    q = Representations("HTTP 404 in parseUserID", {"semantic": (1.0, 0.0)})
    assert intent(q)[0] == "lexical"
    c, _ = auto_channels(q, stats(), 10, "balanced", schema)
    assert [(x.kind, x.limit, getattr(x, "ef_search", None)) for x in c] == [("bm25", 100, None), ("dense", 50, 256)]
    q = Representations("which settings make long running searches slower than short ones", {"semantic": (1.0, 0.0)})
    c, _ = auto_channels(q, stats(), 10, "balanced", schema)
    assert intent(q)[0] == "semantic" and [x.limit for x in c] == [50, 100] and c[1].ef_search == 512
    few = stats(eligible=12, eligible_fields={"semantic": 12})
    c, _ = auto_channels(q, few, 10, "high", schema)
    assert [x.limit for x in c] == [12, 12]
    assert override(c, (Bm25("other", 7),))[0].limit == 7 and len(override(c, (Dense("b", (1.0,)),))) == 3


def test_calibration_and_budget():
    c, k = Calibration(), key("exact_dense", 2, 1000, None)
    for _ in range(4):
        c.observe(k, 100, 2)
    assert c.estimate_ms(k, 200) is None
    c.observe(k, 100, 2)
    c.observe(k, 0, 2)
    assert c.estimate_ms(k, 200) == pytest.approx(4.0)
    with pytest.raises(InvalidRequest):
        compile_plan(RetrieveRequest((Bm25("a"),), objective=Objective(latency_budget_ms=5)), stats(), {})


def test_access_choice():
    assert choose_access("exact", True, True, 1, 2, None, None) == ("exact", "requested_exact")
    assert choose_access("auto", False, True, 1, 2, None, None) == ("exact", "ann_unavailable")
    assert choose_access("auto", True, False, 9, 2, None, None) == ("exact", "filter_requires_exact")
    assert choose_access("auto", True, True, 156, 3072, None, None) == ("exact", "lower_estimated_cost")
    assert choose_access("auto", True, True, 1, 2, 9.0, 1.0) == ("ann", "lower_calibrated_latency")


@pytest.mark.parametrize("bad", [{"prefetch": ()}, {"limit": 0}, {"fusion": Fusion("weighted", weights=(0.0,))}, {"fusion": Fusion(k=-1)}, {"diversity_field": "x"}])
def test_requests_are_checked(bad):
    with pytest.raises(ValueError):
        compile_plan(RetrieveRequest(**({"prefetch": (Bm25("a"),)} | bad)), stats(), {})
