"""Problems 1, 5, 7, 8 and 9."""

import math
import random

import numpy as np
import oracles as o
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.llm import distinctive, leakage, packing, repetition, splitting
from tarnwell.llm.words import word_count, words

RNG = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(60)] + ["Straße", "İstanbul", "東京", "x2", "naïve"]


def text(n, vocabulary=VOCABULARY):
    return " ".join(RNG.choice(vocabulary) for _ in range(n))


def test_words(spark):
    rows = ["Don't stop_now 1.5", None, "", " \n", "İSTANBUL Ünïcode²"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(words("t")).collect()]
    assert got == [o.words(t) for t in rows]


# Problem 9.


def test_repetition_equals_plain_version(spark):
    phrase = text(11)
    rows = [(i, t) for i, t in enumerate([
        None, "", "   ", "one", text(7), text(8), phrase, phrase + " " + phrase, phrase.upper() + ", " + phrase, "a " * 30,
        text(40) + phrase + text(30) + phrase, "x y " * 3000, text(5000, ["a", "b"]), (text(20) + "\r\n") * 4, phrase + " " + phrase,
    ])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("repeat_share", F.lit("clash")).withColumn("h", F.lit(1))
    got = {r.doc_id: r.repeat_share for r in repetition.measure(df, "doc_id", "text").collect()}
    assert got == {i: o.repeat_share(t) for i, t in rows}
    assert repetition.measure(df.where("false"), "doc_id", "text").count() == 0


def test_measures_of_layout(spark):
    t = "- the one\n- the one\n\n- other...\n"
    r = repetition.measure(spark.createDataFrame([(1, t)], "id bigint, text string"), "id", "text").first()
    assert r.n_words == 5 and r.bullet_line_ratio == 1 and r.bad_bullet_line_ratio
    assert r.duplicate_line_ratio == pytest.approx(1 / 3) and r.ellipsis_line_ratio == pytest.approx(1 / 3) and r.bad_duplicate_line_ratio
    assert r.stop_word_ratio == pytest.approx(2 / 5) and r.mean_word_length == pytest.approx(3.4)


def test_repetition_is_one_projection(spark):
    df = spark.range(1).select("id", F.lit("a").alias("text"))
    plan = repetition.measure(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# Problem 8.


def test_leaks_equal_plain_version(spark):
    items = {i: text(RNG.randint(3, 40)) for i in range(12)}
    items[50], items[51] = items[3], None
    docs = {0: None, 1: "", 2: text(300), 3: text(9)}
    for d in range(4, 40):
        base = o.words(items[d % 12])
        a = RNG.randint(0, max(0, len(base) - 12))
        docs[d] = text(RNG.randint(0, 30)) + " — ".join(["", *base[a : a + RNG.randint(8, 25)], ""]) + text(RNG.randint(0, 30))
    docs[90], docs[91] = docs[5], ", ".join(o.words(items[3])) + " " + items[3].upper()
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    ev = spark.createDataFrame(list(items.items()), "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    want = o.leaks(docs, {i: t for i, t in items.items() if t})
    found = leakage.leaks(df, ev)
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert {k: v.match_words for k, v in got.items()} == want and want
    for (d, i), r in got.items():
        assert o.words(docs[d])[r.doc_word : r.doc_word + r.match_words] == o.words(items[i])[r.item_word : r.item_word + r.match_words]
    assert {r.doc_id for r in leakage.without_leaks(df, found).collect()} == set(docs) - {d for d, _ in want}
    assert leakage.leaks(df.where("false"), ev).count() == 0 and leakage.leaks(df, ev.where("false")).count() == 0


def test_small_shards_and_blocks_change_nothing(spark, monkeypatch):
    items = {i: text(20) for i in range(6)}
    docs = {d: text(20) + " " + items[d % 6] for d in range(30)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    ev = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    rows = lambda: sorted(map(tuple, leakage.leaks(df, ev).collect()))
    whole = rows()
    monkeypatch.setattr(leakage, "ITEM_WORDS", 45)
    monkeypatch.setattr(leakage, "SHARD_WORDS", 50)
    assert rows() == whole


def test_a_passage_in_every_text(spark, monkeypatch):
    """Each document and item share one passage: one hit for each pair, followed in pieces of bounded size."""
    passage = text(40)
    docs = {d: f"x{d} {passage} y{d}" for d in range(300)}
    items = {i: f"a{i} {passage} b{i}" for i in range(40)}
    seen, follow = [], leakage.common_length
    monkeypatch.setattr(leakage, "PAIRS", 500)
    monkeypatch.setattr(leakage, "common_length", lambda r, a, b, most: seen.append(len(a)) or follow(r, a, b, most))
    block = leakage.Items(np.arange(40), [np.array([hash(w) for w in o.words(t)]) for t in items.values()], 12)
    words = [np.array([hash(w) for w in o.words(t)]) for t in docs.values()]
    out = leakage.shard_matches(np.arange(300), np.concatenate(words), np.array([len(w) for w in words]), block, 12)
    assert out.num_rows == 300 * 40 and set(out.column("match_words").to_pylist()) == {40}
    assert sum(seen) == 300 * 40 and max(seen) <= 500


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 20))
def test_ranks_give_order_and_common_length(sequence, length):
    words = np.array([*sequence, 0])
    ranks = leakage.suffix_ranks(words, 64)
    suffixes = [tuple(words[i:]) + (0,) * 64 for i in range(len(words))]
    assert np.argsort(ranks[-1], kind="stable").tolist() == sorted(range(len(words)), key=lambda i: (suffixes[i][:64], i))
    heads = [s[:length] for s in suffixes]
    place = {h: i for i, h in enumerate(sorted(set(heads)))}
    assert np.unique(leakage.prefix_ranks(ranks, length), return_inverse=True)[1].tolist() == [place[h] for h in heads]
    a, b = np.zeros(len(words), int), np.arange(len(words))
    want = [next((n for n in range(64) if suffixes[0][n] != suffixes[i][n]), 64) for i in b]
    assert leakage.common_length(ranks, a, b, np.full(len(b), 64)).tolist() == want


# Problem 1.

RECORD = "number bigint, text string, sparse struct<indices: array<bigint>, values: array<float>>"


def test_scores_equal_plain_version(spark):
    rows = [(i, text(RNG.randint(0, 60)), ([1, 2, 2, 4294967295, i], [0.5, 1.0, 0.25, 2.0, 0.0])) for i in range(8)]
    rows += [(20, None, None), (21, "", ([1], [1.0, 2.0])), (22, "only only only", ([7, None], [None, 3.0]))]
    df = spark.createDataFrame(rows, RECORD).withColumn("term", F.lit("clash")).withColumn("df", F.lit(0))
    got = {(r.number, r.kind, r.term): r for r in distinctive.term_scores(df).collect()}
    counts, weights = {}, {}
    for n, t, s in rows:
        for w in o.words(t):
            counts.setdefault(n, {}).setdefault(w, 0)
            counts[n][w] += 1
        if s and len(s[0]) == len(s[1]):
            for i, v in zip(*s, strict=True):
                if i is not None and v:
                    weights.setdefault(n, {}).setdefault(str(i), 0)
                    weights[n][str(i)] += v
    for kind, c in (("word", counts), ("index", weights)):
        want = o.z_scores(c, distinctive.PRIOR)
        assert {(n, t) for n, k, t in got if k == kind} == set(want)
        for (n, t), z in want.items():
            assert got[n, kind, t].score == pytest.approx(z, abs=1e-6)
    marks = {tuple(r) for r in distinctive.marking_terms(df).collect()}
    assert (22, "only") in marks and all(k in marks for k in [(n, "4294967295") for n in range(8)])
    assert distinctive.term_scores(df.where("false")).count() == 0 and distinctive.marking_terms(df.where("false")).count() == 0


def test_one_record_and_ties(spark):
    df = spark.createDataFrame([(1, "a a a b b b", None)], RECORD)
    top = distinctive.top_terms(distinctive.term_scores(df), 1).collect()
    assert [(r.term, r.place) for r in top] == [("a", 1)] and distinctive.marking_terms(df).count() == 2


@settings(max_examples=300, deadline=None)
@given(st.floats(1, 2000), st.floats(0, 5000), st.floats(0, 1e6), st.floats(0, 1e7), st.sampled_from([3.0, 0.25]))
def test_least_scores_are_bounds(y, rest, more, other, least):
    """Whatever a term's counts, its score is not below the bound for its record's total."""
    n = y + more
    y = max(y, 3.0 if least == 3.0 else 0.25 * n)
    n = max(n, y)
    n_all = n + rest + other
    octave = int(np.floor(4 * np.log2(n)))
    low, high = np.array([2.0 ** (octave / 4)]), np.array([2.0 ** ((octave + 1) / 4)])
    start = np.array([3.0]) if least == 3.0 else 0.25 * low
    bound = distinctive.least_scores(start, (low, high), n_all, y + rest, 0.01)[0]
    a, a0 = 0.01 * (y + rest), 0.01 * n_all
    delta = math.log((y + a) / max(n + a0 - y - a, 1e-12)) - math.log((rest + a) / max(n_all - n + a0 - rest - a, 1e-12))
    assert bound <= delta / math.sqrt(1 / (y + a) + 1 / (rest + a)) + 1e-6


# Problem 5.


def long_texts():
    p = lambda n: ". ".join(text(RNG.randint(3, 12)).capitalize() for _ in range(n)) + "."
    return {
        1: "\n\n".join(p(RNG.randint(1, 12)) for _ in range(12)), 2: "\r\n \t\r\n".join(p(4) for _ in range(15)), 3: "x" * 7000,
        4: p(80), 5: "\n".join(p(1) for _ in range(60)), 6: " \n\n  " + p(3) + "\n\n" + "y" * 4000 + "\n\n" + p(30), 7: "short", 8: None, 9: "",
        10: " " * 3000, 11: "a" * 1500, 12: "b" * 1501, 13: "😀 " * 2000, 14: ("w" * 1349 + " ") * 5,
    }


@pytest.fixture(scope="module")
def pieces(spark):
    df = spark.createDataFrame([(n, f"id{n}", t) for n, t in long_texts_fixed.items()], "number bigint, id string, text string").withColumn("at", F.lit("clash"))
    return splitting.split(df).cache()


long_texts_fixed = long_texts()


def test_pieces_cover_the_text(pieces):
    by = {}
    for r in pieces.orderBy("number", "chunk.position").collect():
        by.setdefault(r.number, []).append(r)
    assert set(by) == {n for n, t in long_texts_fixed.items() if t and len(t) > 1500}
    for n, rows in by.items():
        t = long_texts_fixed[n]
        offsets, kinds = splitting.boundaries(t)
        assert [0] + [r.stop for r in rows] == o.greedy_cuts(offsets, kinds, 1500, 150)
        joined = rows[0].text
        for i, (a, b) in enumerate(zip(rows, rows[1:])):
            assert b.start == max(0, a.stop - 150) and b.text.startswith(t[b.start : a.stop]) and b.chunk.position == i + 1
            joined += b.text[a.stop - b.start :]
        assert joined == t and all(len(r.text) <= 1500 and r.text == t[r.start : r.stop] for r in rows)
        assert rows[0].chunk.parent == f"id{n}"


def test_paragraph_starts(pieces):
    got = {}
    for n, at in splitting.paragraph_breaks(pieces).collect():
        got.setdefault(n, []).append(at)
    want = {n: o.paragraph_starts(t) for n, t in long_texts_fixed.items() if t and len(t) > 1500}
    assert {n: sorted(a) for n, a in got.items()} == {n: a for n, a in want.items() if a}


def test_nothing_to_split(spark):
    df = spark.createDataFrame([(1, "a", "short")], "number bigint, id string, text string")
    assert splitting.split(df).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\r", min_size=30, max_size=300))
def test_kept_boundaries_lose_no_cut(t):
    """Leaving out boundaries of lower kinds does not change the greedy cuts."""
    limit, overlap = 25, 5
    offsets, kinds = splitting.boundaries(t, limit, overlap)
    found = (*splitting.line_starts(t), splitting.sentence_starts(t, 0, len(t)), splitting.word_starts(t, 0, len(t)))
    every = {p: k for k, f in reversed(list(enumerate(found, 1))) for p in f if 0 < p < len(t)}
    all_at = sorted({0, len(t), *every, *offsets})
    kept = dict(zip(offsets, kinds))
    all_kinds = [kept[p] if p in (0, len(t)) else every.get(p, kept.get(p)) for p in all_at]
    assert o.greedy_cuts(offsets, kinds, limit, overlap) == o.greedy_cuts(all_at, all_kinds, limit, overlap)


# Problem 7.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_packing_is_valid_and_tight(sizes):
    bins = packing.pack(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 50 for b in bins)
    bound = math.ceil(sum(sizes) / 50) if sizes else 0
    by_size = packing.best_fit_decreasing(sorted((s for s in sizes if s), reverse=True), 50)
    assert bound <= len(bins) <= max(len(by_size), 1 if sizes else 0)


def test_completion_beats_best_fit():
    sizes = [6, 5, 5, 4, 3, 3, 2, 2]  # best fit decreasing needs four of ten, three are enough
    wins = 0
    for seed in range(40):
        r = random.Random(seed)
        s = []
        for _ in range(12):
            a = r.randint(20, 60)
            b = r.randint(10, 99 - a - 5) if a < 80 else 5
            s += [a, b, 100 - a - b]
        wins += len(packing.pack(s, 100)) < len(packing.best_fit_decreasing(sorted(s, reverse=True), 100))
    assert wins > 0 and len(packing.pack(sizes, 10)) == 3


def test_containers(spark):
    rows = [(i, RNG.randint(1, 900)) for i in range(3000)] + [(5000, 2048), (5001, 2049), (5002, 10_000), (5003, None), (5004, -3), (7, 100), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, w bigint").withColumn("container", F.lit("clash"))
    out = packing.fill_containers(df, "doc_id", F.col("w"), group=500).collect()
    fill, pieces = {}, {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.size
        pieces.setdefault(r.id, []).append(r.size)
    assert all(f <= 2048 for f in fill.values()) and {r.container: r.fill for r in out} == fill
    assert len({(r.id, r.piece) for r in out}) == len(out)
    for i, w in rows[:-2]:
        if i is not None and i != 7:
            assert sum(pieces[i]) == max(w or 0, 0) and (len(pieces[i]) == 1 or w > 2048)
    assert len(pieces[7]) == 2 and {r.id for r in out if r.oversized} == {5001, 5002}
    used = sum(fill.values()) / (2048 * len(fill))
    assert used > 0.98
    assert packing.fill_containers(df.where("false"), "doc_id", F.col("w")).count() == 0


def test_token_sizes(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "id bigint, text string")
    assert {r.id: r.tokens for r in packing.token_sizes(df, "id", "text", path).collect()} == {1: 2, 2: 0, 3: 0}


def test_word_count(spark):
    assert spark.createDataFrame([("a b-c",)], "t string").select(word_count("t")).first()[0] == 3
