import json
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.functions import predicates as P
from tarnwell.functions import vectors as V
from tarnwell.functions.stem import stem
from tarnwell.functions.text import ENGLISH, PLAIN, Analyzer, estimate_tokens, estimated_tokens, is_identifier, query_features
from tarnwell.operators import ann, context, dense, evalkit, fixed_encoding, fusion, late, lexical, quantize, topk
from tarnwell.sources import datasets
from tarnwell.streaming import mutations


def test_analyzers(spark):
    text = "Don't STOP. café's E123 — repair!"
    assert sorted(PLAIN.terms(text)) == ["café", "don", "e123", "repair", "s", "stop", "t"]
    assert sorted(Analyzer(fold=True).terms("Ünïcödé ﬁ 東京")) == ["fi", "unicode", "東京"]
    assert ENGLISH.terms("x" * 41) == ["x" * 40]
    assert Analyzer(stem=True).terms("the running") == ["the", "run"] and Analyzer(stop=True).terms("the running") == ["running"]
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(PLAIN.column("t")).collect()] == [PLAIN.terms(text), [], []]
    assert [r[0] for r in df.select(ENGLISH.column("t")).collect()] == [ENGLISH.terms(text), [], []]
    with pytest.raises(ValueError):
        Analyzer(max_token_length=0)


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("agreed", "agre"), ("sky", "sky"), ("happy", "happi"), ("news", "news"), ("adoption", "adopt")])
def test_stems(word, want):
    assert stem(word) == want


def test_text_features(spark):
    assert [is_identifier(t) for t in ("parseUserID", "HTTP", "404", "a_b", "word", "of", "(E123)")] == [True, True, False, True, False, False, True]
    assert query_features('say "two words" 404')["quoted_phrase_count"] == 1
    texts = ["a b c ", "", None, "word " * 200]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(estimated_tokens("t")).collect()]
    assert got == [estimate_tokens(t) for t in texts] == [3, 1, 1, 260]


def naive(p, m):
    try:
        m = json.loads(m) if m else {}
    except ValueError:
        m = {}

    def get(field):
        x = m
        for s in P._steps(field):
            x = x[int(s)] if isinstance(x, list) and s.isdigit() and int(s) < len(x) else x.get(s, KeyError) if isinstance(x, dict) else KeyError
        return x

    same = lambda a, b: type(a) is type(b) and a == b
    match p:
        case P.Eq(f, v):
            return same(get(f), v)
        case P.In(f, vs):
            x = get(f)
            return any(same(x, v) for v in vs) or (isinstance(x, list) and any(same(y, v) for y in x for v in vs))
        case P.Range(f, a, b):
            x = get(f)
            return isinstance(x, (int, float)) and not isinstance(x, bool) and (a is None or x >= a) and (b is None or x <= b)
        case P.And(fs):
            return all(naive(f, m if isinstance(m, str) else json.dumps(m)) for f in fs)
        case P.Or(fs):
            return any(naive(f, m if isinstance(m, str) else json.dumps(m)) for f in fs)
        case P.Not(f):
            return not naive(f, json.dumps(m))


def test_predicates_match_plain_evaluation(spark):
    docs = ['{"t":"a","y":1}', '{"t":"b","y":1.0}', '{"y":"1"}', '{"t":null}', '{"tags":["x","y"],"o":{"k":[1,2]}}', '{"t":true,"y":-3}', '{"t":"a"', None, ""]
    tests = [
        P.Eq("t", "a"), P.Eq("y", 1), P.Eq("y", 1.0), P.Eq("y", "1"), P.Eq("t", None), P.Eq("t", True), P.Eq("/o/k/1", 2),
        P.In("tags", ("x",)), P.In("t", ("a", "b")), P.Range("y", 0, 2), P.Range("y", None, 0), P.Not(P.Eq("t", "a")),
        P.And((P.Eq("t", "a"), P.Range("y", 1))), P.Or((P.Eq("t", "b"), P.Not(P.Range("y", 0)))),
    ]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(docs)], "id int, metadata string")
    got = df.select("id", *[P.compile_predicate(p).alias(f"p{j}") for j, p in enumerate(tests)]).orderBy("id").collect()
    for i, m in enumerate(docs):
        for j, p in enumerate(tests):
            assert got[i][f"p{j}"] == naive(p, m), (m, p)
    assert P.from_json({"op": "not", "filter": {"op": "eq", "field": "t", "value": "a"}}) == P.Not(P.Eq("t", "a"))
    for bad in (P.Range("y"), P.In("t", ()), P.And(()), P.Eq("t", [1])):
        with pytest.raises(ValueError):
            P.validate(bad)
    assert P.searchable(P.And((P.Eq("a", 1),))) and not P.searchable(P.Range("a", 1)) and not P.indexed(P.Range("a", 1))


def test_payload_predicates(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, ["z"]), (3, "b", None)], "n bigint, s string, l array<string>")
    ids = lambda c: sorted(r.n for r in df.where(c).collect())
    assert ids(P.compare("s", "string", "neq", "a")) == [3]
    assert ids(P.compare("l", "array<string>", "neq", "x")) == [2]
    assert ids(P.list_query("l", "length", "gte", 2)) == [1] and ids(P.list_query("l", "element", 0, "eq", "z")) == [2]
    assert ids(P.match("l", ["z"])) == [2]
    assert ids(P.from_conditions({"or": [{"s": {"match": {"value": "a"}}}, {"n": {"range": {"gt": 2}}}]}, {"n": "bigint"})) == [1, 3]
    with pytest.raises(TypeError):
        P.compare("n", "bigint", "eq", 1.0)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        df.where("n = 2").where(P.list_query("l", "element", 5, "eq", "z")).collect()


def test_metrics(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(V.cosine("a", "a").alias("c"), V.cosine("a", "z").alias("z"), V.cosine("z", "z").alias("zz"), V.l2_squared("a", "z").alias("l"), V.normalise("z").alias("nz"), V.normalise("a").alias("na")).first()
    assert r.c == pytest.approx(1) and r.z == 0 and r.zz == 1 and r.l == 25 and r.nz == [0, 0] and r.na == pytest.approx([0.6, 0.8])


def test_sparse_canonical(spark):
    df = spark.createDataFrame([(1, ([4294967295, 2, 2, 3], [1.0, 1.0, 2.0, 0.0])), (2, ([1], [1.0, 2.0])), (3, None)], "id bigint, s struct<indices: array<bigint>, values: array<float>>")
    p = lexical.canonical_sparse(df, "id", "s")
    assert sorted((r.id, r.feature, r.weight) for r in p.collect()) == [(1, 2, 3.0), (1, 4294967295, 1.0)]
    assert lexical.sparse_dot(p, p.withColumnRenamed("id", "qid"), 5).first().score == 10


def test_bm25_ties_and_repeated_terms(spark):
    docs = spark.createDataFrame([(2, "alpha"), (1, "beta"), (3, None), (4, "")], "id bigint, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta beta")], "qid bigint, text string")
    rows = {(r.qid, r.id): (r.score, r["rank"]) for r in lexical.bm25(docs, q, 5).collect()}
    assert rows[1, 1][0] == rows[1, 2][0] and rows[1, 1][1] == 1
    assert rows[2, 1][0] == pytest.approx(2 * rows[2, 2][0]) and len(rows) == 4


def test_fusion_validates(spark):
    a = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0)], "qid bigint, id bigint, score double")
    b = spark.createDataFrame([(1, 2, 9.0)], "qid bigint, id bigint, score double")
    got = {r.id: (r.score, r.sources) for r in fusion.fuse([a, b], k=0).collect()}
    assert got == {1: (1.0, [0]), 2: (1.5, [0, 1])}
    assert {r.id: r.score for r in fusion.fuse([a]).collect()} == {1: 3.0, 2: 1.0}
    assert fusion.agreement([a, b], 2).first().agreement == 0.5
    for bad in ([1.0], [0.0, 0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            fusion.fuse([a, b], "weighted", weights=bad)


ROW = {"text": None, "parent": None}


def test_context_rules():
    pool = [{"id": i, "score": 3 - i, "text": t, "parent": p} for i, (t, p) in enumerate([("same", "p"), ("same", "p"), ("other", "q")])]
    ids = lambda s: [r[0] for r in s.rows]
    s = context.select(pool, {}, context.ContextOptions(deduplicate=True))
    assert ids(s) == [0, 2] and s.duplicates == 1
    assert ids(context.select(pool, {}, context.ContextOptions(per_parent=1))) == [0, 2]
    around = {0: [{"id": 9, "text": "near", "parent": "p"}]}
    s = context.select(pool, around, context.ContextOptions(neighbours=1, deduplicate=True))
    assert [(r[0], r[2]) for r in s.rows] == [(0, None), (9, 0), (2, None)]
    long = [{"id": 0, "score": 1, "text": "w " * 200, "parent": None}, {"id": 1, "score": 0.5, "text": "w", "parent": None}]
    assert ids(context.select(long, {}, context.ContextOptions(budget_tokens=50))) == [1]
    vectors = np.array([[1.0, 0], [1, 0.01], [0, 1]])
    assert ids(context.select(pool, {}, context.ContextOptions(limit=2, mmr=0.3), vectors)) == [0, 2]
    sims = np.array([[1, 0.9, 0.9, 0], [0.9, 1, 0.9, 0], [0.9, 0.9, 1, 0], [0, 0, 0, 1.0]])
    assert context.mmr_select(sims, np.array([0.9, 0.8, 0.7, 0.6]), 2, 1.0) == [0, 1]
    assert context.mmr_select(sims, np.array([0.9, 0.8, 0.7, 0.6]), 2, 0.2) == [0, 3]
    assert context.mmr_select(sims, np.array([np.nan, 0.8, 0.7, 0.6]), 2, 0.2) == []


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 8), st.lists(st.integers(0, 255), min_size=1, max_size=40))
def test_bits_round_trip(bits, values):
    codes = np.array(values) % (1 << bits)
    assert (quantize.unpack_bits(quantize.pack_bits(codes, bits), len(codes), bits) == codes).all()


def test_codecs():
    x = quantize.unit(np.random.default_rng(0).normal(size=(300, 9)))
    n = quantize.Nibble4.train(x)
    assert n.rmse(x) < 0.05 and np.allclose(n.dot(n.encode(x), x[0]), n.decode(n.encode(x)) @ x[0])
    errors = []
    for bits in (1, 2, 4, 8):
        c = quantize.ResidualCodec.train(x, 8, bits, 5)
        errors.append(np.abs(c.decode(*c.encode(x[:50])) - x[:50]).mean())
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.01
    with pytest.raises(ValueError):
        quantize.train_centroids(x[:3], 4, 1)


def test_encoder_fills_empty_buckets():
    e = fixed_encoding.FixedEncoder(4, 3, 2, 2)
    one = e.encode_document(np.array([[1.0, 0, 0, 0]])).reshape(2, 8, 2)
    assert np.allclose(one, one[:, :1])  # every bucket holds the only token
    q = e.encode_query(np.array([[1.0, 0, 0, 0]])).reshape(2, 8, 2)
    assert ((np.abs(q).sum(2) > 0).sum(1) == 1).all() and len(q.ravel()) == e.output_dimension


def test_token_queries_against_plain_maxsim(spark):
    rng = np.random.default_rng(1)
    docs = {i: quantize.unit(rng.normal(size=(3, 6))) for i in range(60)}
    df = spark.createDataFrame([(i, m.tolist()) for i, m in docs.items()], "id bigint, t array<array<float>>")
    codec = quantize.ResidualCodec.train(np.concatenate(list(docs.values())), 8, 8, 8)
    encoder = fixed_encoding.FixedEncoder(6, 3, 4, 20)
    stored = late.encode_tokens(df, "id", "t", codec, encoder).cache()
    q, one = docs[7], late.one_query(spark, docs[7])
    truth = sorted(docs, key=lambda i: -(q @ docs[i].T).max(1).sum())[:5]
    got = [r.id for r in late.token_query(stored, one, 5, codec, encoder, candidates=60).orderBy(F.desc("score")).collect()]
    assert got[0] == 7 and len(set(got) & set(truth)) >= 4
    pruned = late.token_query(stored, one, 5, codec, encoder, 60, 30)
    assert late.explain_tokens(pruned).first().top_score > 2.9
    assert late.probe_query(stored, one, 5, 60, 8, codec).orderBy(F.desc("score")).first().id == 7
    exact = dense.exact_maxsim(df, "t", spark.createDataFrame([(1, q.tolist())], "qid bigint, tokens array<array<double>>"), 5)
    assert [r.id for r in exact.orderBy("rank").collect()] == truth
    with pytest.raises(ValueError):
        late.token_query(stored, one, 5, codec, encoder, 10, 20)


def test_inverted_lists(spark, tmp_path):
    x = datasets.synthetic_clusters(400, 8, 6)
    df = datasets.from_numpy(spark, x)
    index = ann.IvfIndex.build(df, str(tmp_path / "ivf"), 8)
    q, truth = x[5].tolist(), [int(i) for i in np.argsort(-(x @ x[5]), kind="stable")[:10]]
    found = lambda n, **kw: [r.id for r in index.search(spark, q, 10, ann.AnnOptions(nprobe=n), **kw).collect()]
    assert set(found(8)) == set(truth)
    overlap = [len(set(found(n)) & set(truth)) for n in (1, 2, 4, 8)]
    assert overlap == sorted(overlap)
    gone = spark.createDataFrame([(5,)], "id bigint")
    assert 5 not in found(8, tombstones=gone)
    delta = spark.createDataFrame([(1000, [float(v) for v in x[5]])], "id bigint, vector array<float>")
    assert 1000 in found(8, delta=delta)
    assert index.search_widening(spark, q, 10, 401)[1] == "exact"
    pruned, lists = index.search_pruned(spark, q, 10)
    assert [r.id for r in pruned.collect()] == truth and len(lists) < 8
    report = index.probe_report(spark, q, 2).first()
    assert report.lists == 2 and report.scored + report.unread == 400
    assert index.stats(spark).agg(F.sum("rows")).first()[0] == 400


def test_inverted_lists_in_batches(spark, tmp_path):
    x = datasets.synthetic_clusters(600, 8, 6)
    x[300:330] = x[7]
    df = datasets.from_numpy(spark, x)
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "qid")
    index = ann.IvfIndex.build(df, str(tmp_path / "ivf"), 8)
    rows = lambda t: {(r.qid, r["rank"]): r.id for r in t.collect()}
    assert rows(index.search_batch(spark, asked, 10, 8)) == rows(dense.batch_search(df, asked, 10))
    few = rows(index.search_batch(spark, asked, 10, 2))
    one = index.search(spark, x[40].tolist(), 10, ann.AnnOptions(nprobe=2)).collect()
    assert {few[40, i] for i in range(1, 11)} == {r.id for r in one}


def test_lists_are_fitted_on_rows_of_all_ids(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(ann, "TRAINING_ROWS", 100)
    monkeypatch.setattr(ann, "train_centroids", lambda x, lists, iterations: seen.append(x) or x[:lists])
    x = np.ones((190, 8))
    x[100:, 0] = 9
    ann.IvfIndex.build(datasets.from_numpy(spark, x), str(tmp_path / "ivf"), 4)
    assert len(seen[0]) == 100 and 30 <= (seen[0][:, 0] == 9).sum() <= 65


def test_inverted_list_queries(spark):
    from tarnwell import queries

    live = queries._live(spark, "/root/testdata/sf0.001")
    asked = {r.id for r in live.where("id % 20 = 0").select("id").collect()}
    found = queries.QUERIES["ivf_topk"](spark, "/root/testdata/sf0.001").collect()
    assert {r.qid for r in found} == asked and len(found) == 10 * len(asked)
    recall = [r.recall for r in queries.QUERIES["ivf_recall"](spark, "/root/testdata/sf0.001").collect()]
    assert len(recall) == len(asked) and np.mean(recall) >= 0.9


def test_evaluation(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid bigint, id bigint, rank int")
    qrels = spark.createDataFrame([(1, 11, 1.0), (1, 12, 1.0), (2, 5, 1.0)], "qid bigint, id bigint, grade double")
    m = {r.qid: r for r in evalkit.ranking_metrics(run, qrels, 10).collect()}
    assert m[1].ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3))) and m[1].mrr == 0.5 and m[2].ndcg == 0
    b = evalkit.paired_bootstrap(np.full(20, 0.1), 200)
    assert b["low"] == pytest.approx(0.1) and b["p"] == 0
    grid = evalkit.expand_grid({"m": [8, 16], "ef": [1, 2, 3]})
    assert len(grid) == 6 and grid[1] == {"m": 8, "ef": 2}
    x = np.random.default_rng(0).normal(size=(200, 2))
    coef = evalkit.ridge(x, 3 + 2 * x[:, 0], penalty=1e-6)
    assert coef == pytest.approx([3, 2, 0], abs=1e-3) and evalkit.permutation_importance(x, 3 + 2 * x[:, 0], coef)[0] > 1


def test_change_stream_is_idempotent(spark, tmp_path):
    from tarnwell.sources.store import IndexConfig, Store

    schema = "id bigint, text string, op string, seq bigint"
    changes = spark.createDataFrame([(1, "a", "upsert", 1), (1, "b", "upsert", 2), (2, "x", "upsert", 3), (2, None, "delete", 4)], schema)
    changes.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"), IndexConfig(2))
    for _ in range(2):
        stream = mutations.read_changes(spark, str(tmp_path / "in"), schema)
        mutations.upsert_stream(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert [(r.id, r.text) for r in store.documents().collect()] == [(1, "b")]
    first = store.generation
    mutations.upsert_stream(mutations.read_changes(spark, str(tmp_path / "in"), schema), store, str(tmp_path / "cp2")).awaitTermination()
    assert store.generation == first  # batch 0 again, with a lost checkpoint
    log = changes.select("id", "seq", "op", "text")
    assert [(r.id, r.text) for r in mutations.replay(log, "id").collect()] == [(1, "b")]


def test_running_calibration_stream(spark, tmp_path):
    schema = "key string, cost_units double, elapsed_ms double"
    spark.createDataFrame([("k", 100.0, 2.0)] * 5 + [("j", 0.0, 1.0)], schema).write.parquet(str(tmp_path / "o"))
    stream = mutations.calibrate_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "o")))
    q = stream.writeStream.format("memory").queryName("calibration").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    row = spark.table("calibration").where("key = 'k'").first()
    assert row.observations == 5 and row.p90 == pytest.approx(0.02)


def test_vector_index_and_sql_functions(spark, tmp_path):
    from tarnwell.functions.registry import register
    from tarnwell.sources.vector_index import VectorIndex

    v = VectorIndex.build(spark, str(tmp_path / "v"), [("a", [1, 0, 0]), ("b", [0, 1, 0]), ("c", [0.5, 0.5, 0])])
    assert [n for n, _ in v.search([0.9, 0.2, 0], 2)] == ["a", "c"] and len(v) == 3
    assert v.id_at(1) == "b" and v.position_of("c") == 2 and v.id_at(9) is None
    assert "tw_cosine" in register(spark)
    r = spark.sql("SELECT tw_cosine(array(1.0, 0.0), array(2.0, 0.0)) AS c, tw_maxsim(array(array(1.0, 0.0)), array(array(0.5, 1.0), array(1.0, 1.0))) AS m, tw_analyze_english('The running dogs') AS t").first()
    assert (r.c, r.m, r.t) == (1.0, 1.0, ["run", "dog"])


def test_flatten_and_journal(spark):
    assert P.flat_scalars('{"a": {"b/c": [1, null, "x"]}, "d": 1.5}') == [("/a/b~1c/0", "int", "1"), ("/a/b~1c/2", "string", "x"), ("/d", "float", "1.5")]
    assert P.flat_scalars('{"a"') == [] and P.flat_scalars(None) == []
    events = [("query_started", "p", 1, None, None), ("query_finished", "p", 1, 0.8, 5.0), ("query_started", "p", 2, None, None)]
    r = evalkit.summarise_journal(spark.createDataFrame(events, "event string, plan string, qid int, quality double, elapsed_ms double")).first()
    assert (r.queries, r.failures, r.quality) == (2, 1, 0.4)


def test_sql_functions_on_odd_values(spark):
    from tarnwell.functions.registry import register

    register(spark)
    r = spark.sql(
        "SELECT tw_analyze_plain('Ünder_1 B') AS t, tw_analyze_plain(NULL) AS n, tw_cosine(array(0.0, 0.0), array(0.0, 0.0)) AS zeros, tw_cosine(array(0.0), array(1.0)) AS zero, "
        "tw_cosine(NULL, array(1.0)) AS missing, tw_cosine(array(1.0, 2.0), array(-2.0, -4.0)) AS back, tw_maxsim(array(), array(array(1.0))) AS none"
    ).first()
    assert r.t == ["ünder", "1", "b"] and r.n == [] and (r.zeros, r.zero, r.missing, r.none) == (1.0, 0.0, None, None) and r.back == pytest.approx(-1)


def test_cells_of_neighbouring_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "pq"[i % 2], int(p)) for i, p in enumerate(rng.integers(-5, 40, 200))] + [(900, None, 1), (901, "p", None)]
    c = spark.createDataFrame(rows, "id bigint, parent string, position bigint")
    for distance in (0, 1, 3):
        got = context.neighbouring(c.select(F.col("id").alias("seed"), "parent", F.col("position").alias("at")), c, distance)
        want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] is not None and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= distance)
        assert sorted((r.seed, r.id) for r in got.collect()) == want


def test_lexical_and_sparse_search_on_dirty_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "b b c"), (4, "b b c")], "id bigint, text string").withColumn("tf", F.lit("clash"))
    asked = spark.createDataFrame([(7, "b"), (8, ""), (9, None), (10, "zz")], "qid bigint, text string")
    assert {(r.qid, r.id) for r in lexical.bm25(docs, asked, 5).collect()} == {(7, 1), (7, 4)}
    assert lexical.bm25(docs.where("false"), asked, 5).count() == 0 and lexical.bm25(docs, asked.where("false"), 5).count() == 0
    s = "indices array<bigint>, values array<double>"
    rows = [(1, [4294967295, 3, 3], [1.0, 2.0, 3.0]), (2, None, None), (3, [1], [1.0, 2.0]), (4, [3, None], [float("nan"), 1.0]), (5, [], []), (6, [3, 9], [-1.0, 1.0])]
    q = spark.createDataFrame([(1, [3, 4294967295, 3], [1.0, 1.0, 1.0]), (2, None, None), (3, [9], [2.0])], f"qid bigint, {s}")
    got = {(r.qid, r.id): r.score for r in lexical.sparse_search(spark.createDataFrame(rows, f"id bigint, {s}"), q, 5).collect()}
    assert got == {(1, 1): 11.0, (3, 6): 2.0}


def peak_mb(monkeypatch, frame, plan):
    """Greatest memory in MB that a Python task of ``plan``'s plan takes for its rows and its queries."""
    real, runs = type(frame).mapInArrow, []
    with monkeypatch.context() as m:
        m.setattr(type(frame), "mapInArrow", lambda self, f, *a, **k: runs.append((self, f)) or real(self, f, *a, **k))
        plan()
    peaks = []
    for rows, run in runs:
        batches = rows.toArrow().to_batches()
        tracemalloc.start()
        for _ in run(iter(batches)):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    return max(peaks)


def test_best_of_blocks_with_ties():
    rng = np.random.default_rng(2)
    s, ids = rng.integers(0, 40, (9, 700)) / 8.0, rng.permutation(700)
    s[0], s[1, 5:] = 1.0, -np.inf
    best = topk.Best(9, 50, 100, 9)
    for at in range(0, 700, 100):
        for first in (0, 4):
            best.add(first, s[first : first + (4 if first == 0 else 5), at : at + 100] + 1e-12, ids[at : at + 100])
    got_s, got_i = best.take()
    for row, a, b in zip(s, got_s, got_i, strict=True):
        order = [j for j in np.lexsort([ids, -row])[:50] if row[j] > -np.inf]
        assert (a[: len(order)] == row[order]).all() and (b[: len(order)] == ids[order]).all() and (a[len(order) :] == -np.inf).all()


@pytest.fixture(scope="module")
def many_tokens(spark):
    x = quantize.unit(np.random.default_rng(3).normal(size=(2000, 3, 6)))
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(x)], "id bigint, tokens array<array<float>>").cache()
    codec, encoder = quantize.ResidualCodec.train(x.reshape(-1, 6), 8, 4, 3), fixed_encoding.FixedEncoder(6, 2, 2, 5)
    return x, df, late.encode_tokens(df, "id", "tokens", codec, encoder).cache(), codec, encoder


def test_token_candidates_are_bounded(spark, monkeypatch, many_tokens):
    x, df, stored, codec, encoder = many_tokens
    asked = df.withColumnRenamed("id", "qid")
    few = asked.where("qid < 7")
    # One block of seven queries is shared by the cores, blocks of many queries are not: the same answer.
    one = late.token_query(stored, few, 5, codec, encoder, 300, 40).orderBy("qid", "id").collect()
    monkeypatch.setattr(late, "BLOCK", 500)
    many = late.token_query(stored, asked, 5, codec, encoder, 300, 40)
    assert many.where("qid < 7").orderBy("qid", "id").collect() == one and many.count() == 5 * len(x)
    unit32 = quantize.unit(x.astype(np.float32).astype(np.float64))
    code = {i: codec.encode(m) for i, m in enumerate(unit32)}
    for qid in (0, 6):
        held = np.array([r.fde for r in stored.orderBy("id").select("fde").collect()]) @ encoder.encode_query(unit32[qid])
        low = {i: (unit32[qid] @ codec.centroids[code[i][0]].T).max(1).sum() for i in np.lexsort([np.arange(len(x)), -np.round(held, 9)])[:300]}
        kept = sorted(low, key=lambda i: (-round(low[i], 9), i))[:40]
        full = {i: (unit32[qid] @ codec.decode(*code[i]).T).max(1).sum() for i in kept}
        assert {r.id for r in one if r.qid == qid} == set(sorted(full, key=lambda i: (-round(full[i], 9), i))[:5])
    assert peak_mb(monkeypatch, df, lambda: late.token_query(stored, asked, 5, codec, encoder, 300, 40)) < 40


def test_batch_search_is_bounded(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(4000, 4)), 1)
    x[7::500] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>").coalesce(1).cache()
    asked = df.where("id < 3000").withColumnRenamed("id", "qid")
    found = dense.batch_search(df, asked, 5, normal=False)
    got = {(r.qid, r["rank"]): r.id for r in found.where("qid % 250 = 7").collect()}
    for qid in range(7, 3000, 250):
        assert [got[qid, n] for n in range(1, 6)] == np.lexsort([np.arange(4000), -np.round(x @ x[qid], 9)])[:5].tolist()
    # A query in two blocks of vectors is one query still.
    twice = asked.where("qid < 40").unionByName(asked.where("qid < 40").select("qid", F.transform("vector", lambda v: -v).alias("vector")))
    whole = dense.batch_search(df, twice, 5, normal=False).orderBy("qid", "rank").collect()
    with monkeypatch.context() as m:
        m.setattr(dense, "ENTRIES", 5 * 60)
        m.setattr(dense, "SCORES", 4096 * 7)
        assert dense.batch_search(df, twice, 5, normal=False).orderBy("qid", "rank").collect() == whole
    assert peak_mb(monkeypatch, df, lambda: dense.batch_search(df, asked, 5, normal=False)) < 40


def test_recall_of_empty_and_partial_answers(spark):
    truth = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 3, 2), (2, 4, 3)], "qid bigint, id bigint, rank int")
    found = spark.createDataFrame([(1, 2, 1), (1, 1, 3), (3, 1, 1)], "qid bigint, id bigint, rank int")
    assert {r.qid: r.recall for r in evalkit.recall_at_k(found, truth, 2).collect()} == {1: 0.5, 2: 0.0}


def test_maxsim_and_rescoring_are_bounded(spark, monkeypatch, many_tokens):
    x, df, _, _, _ = many_tokens
    asked = df.withColumnRenamed("id", "qid")
    u = quantize.unit(x.astype(np.float32).astype(np.float64))
    exact = dense.exact_maxsim(df, "tokens", asked, 5)
    for qid in (0, 999, 1999):
        full = np.round(np.einsum("qd,ntd->nqt", u[qid], u).max(2).sum(1), 9)
        assert [r.id for r in exact.where(f"qid = {qid}").orderBy("rank").collect()] == np.lexsort([np.arange(len(x)), -full])[:5].tolist()
    rng = np.random.default_rng(5)
    for size in (np.full(7, 3), np.array([1, 3, 2, 3, 1]), np.arange(1, 20)):
        m = rng.normal(size=(4, size.sum()))
        assert (dense.best_tokens(lambda t, m=m: m[:, t], size) == np.maximum.reduceat(m, np.cumsum(size) - size, axis=1)).all()
    pool = exact.select("qid", "id")
    again = late.exact_rescore(pool, df, "tokens", asked, 5)
    assert again.select("qid", "id", "rank").exceptAll(exact.select("qid", "id", "rank")).count() == 0 and again.count() == 5 * len(x)
    assert peak_mb(monkeypatch, df, lambda: dense.exact_maxsim(df.coalesce(1), "tokens", asked, 5)) < 60
