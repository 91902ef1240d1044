"""Queries of the core over the test tables, each with its SQL where SQL can express it.

Searches take as queries every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions import predicates as P
from tarnwell.functions import text as T
from tarnwell.functions import vectors as V
from tarnwell.operators import context, dense, evalkit, fixed_encoding, fusion, late, lexical, quantize
from tarnwell.operators.topk import group_top_n, rounded, top, top_per
from tarnwell.plans import engine, request
from tarnwell.session import materialize, scratch_path
from tarnwell.sources import store
from tarnwell.sources.tables import latest, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def current(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(s, d, "retrieval_docs").select("number", "seq", *columns), "number", "seq")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").withColumnRenamed("doc_id", "id")


def items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def first_vector(s: SparkSession, d: str) -> list[float]:
    return list(vectors(s, d).orderBy("id").select("vector").first()[0])


def hits(s: SparkSession, d: str) -> DataFrame:
    ok = F.col("raw_score").isNotNull() & ~F.isnan("raw_score") & (F.abs("raw_score") != float("inf"))
    score = F.when(F.col("channel") == "dense_l2", -F.col("raw_score")).otherwise(F.col("raw_score"))
    rows = table(s, d, "channel_hits").where(ok & F.col("query_id").isNotNull() & F.col("number").isNotNull())
    return rows.select(F.col("query_id").alias("qid"), "channel", F.col("number").alias("id"), score.alias("score"))


def channel(s: SparkSession, d: str, name: str) -> DataFrame:
    return hits(s, d).where(F.col("channel") == name).drop("channel")


WORDS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda w: lower(w))"
CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY seq DESC) AS rn FROM retrieval_docs WHERE number IS NOT NULL) WHERE rn = 1)"
UNIT = "list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])))"
HITS = """hits AS (SELECT query_id AS qid, channel, number AS id, max(CASE WHEN channel = 'dense_l2' THEN -raw_score ELSE raw_score END) AS score
  FROM channel_hits WHERE isfinite(raw_score) AND query_id IS NOT NULL AND number IS NOT NULL GROUP BY ALL)"""


# Lexical and sparse channels.

TF = f"SELECT doc_id AS id, unnest({WORDS}) AS term FROM documents WHERE text IS NOT NULL"


@query(f"SELECT id, term, count(*)::BIGINT AS tf FROM ({TF}) GROUP BY ALL")
def term_counts(s, d):
    return lexical.term_counts(docs(s, d))


@query(f"SELECT term, count(DISTINCT id)::BIGINT AS df FROM ({TF}) GROUP BY term")
def doc_freq(s, d):
    return lexical.document_frequency(lexical.term_counts(docs(s, d)))


def _bm25_sql(where: str = "true", k: int = 10) -> str:
    return f"""
WITH d AS (SELECT doc_id AS id, {where} AS ok, {WORDS} AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS avgdl FROM d),
p AS (SELECT id, ok, len(w)::DOUBLE AS dl, unnest(w) AS term FROM d),
tf AS (SELECT id, coalesce(ok, false) AS ok, dl, term, count(*)::DOUBLE AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
q AS (SELECT qid, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id AS qid, unnest({WORDS}) AS term FROM eval_items WHERE item_id % 20 = 0) GROUP BY ALL),
sc AS (SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term), t WHERE ok GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
SELECT qid, id, round(round(score, 9), 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= {k}"""


def _bm25(s, d, eligible=None):
    return lexical.bm25(docs(s, d), items(s, d), 10, eligible=eligible).withColumn("score", rounded("score"))


@query(_bm25_sql())
def bm25_topk(s, d):
    return _bm25(s, d)


@query(_bm25_sql("lang = 'en'"))
def bm25_filtered_global_idf(s, d):
    return _bm25(s, d, F.col("lang") == "en")


@query(_bm25_sql())
def bm25_indexed(s, d):
    """As ``bm25_topk``, from postings written before."""
    index = lexical.LexicalIndex.build(docs(s, d), scratch_path(s, "postings"))
    return index.search(items(s, d), 10).withColumn("score", rounded("score"))


@query()
def bm25_english(s, d):
    return lexical.bm25(docs(s, d), items(s, d), 10, analyzer=T.ENGLISH)


SPARSE = f"""sp AS (SELECT number AS id, feature, sum(weight) AS weight FROM (
  SELECT number, unnest(sparse.indices) AS feature, unnest(sparse."values")::DOUBLE AS weight FROM {CURRENT}
  WHERE len(sparse.indices) = len(sparse."values")) WHERE feature IS NOT NULL AND weight >= 0 AND isfinite(weight) GROUP BY ALL HAVING sum(weight) > 0)"""


@query(f"WITH {SPARSE} SELECT id, feature, round(weight, 6) AS weight FROM sp")
def sparse_canonical(s, d):
    return lexical.canonical_sparse(current(s, d, "sparse"), "number", "sparse").withColumn("weight", rounded("weight"))


@query(f"""WITH {SPARSE}, sc AS (SELECT q.id AS qid, p.id, sum(q.weight * p.weight) AS score FROM sp p JOIN sp q USING (feature) WHERE q.id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
SELECT qid, id, round(round(score, 9), 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def sparse_dot_topk(s, d):
    rows = current(s, d, "sparse").select(F.col("number").alias("id"), "sparse.indices", "sparse.values")
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "qid")
    return lexical.sparse_search(rows, asked, 10).withColumn("score", rounded("score"))


# Dense and late-interaction channels.

ONE = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"


def _dense_sql(key: str, raw: str, where: str = "true") -> str:
    return f"""WITH q AS (SELECT {ONE} AS q), s AS (SELECT vec_id AS id, {key} AS sort_key, embedding::DOUBLE[] AS e FROM embeddings, q WHERE {where})
SELECT id, round(sort_key, 6) AS sort_key, round({raw}, 6) AS raw_score FROM s ORDER BY sort_key, id LIMIT 10"""


def _dense(s, d, metric, eligible=None):
    out = dense.search(vectors(s, d), "vector", first_vector(s, d), 10, metric, eligible=eligible)
    return out.select("id", rounded("sort_key").alias("sort_key"), rounded("raw_score").alias("raw_score"))


COSINE = "1 - greatest(-1, least(1, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))))"


@query(_dense_sql(COSINE, "1 - sort_key"))
def dense_cosine_topk(s, d):
    return _dense(s, d, "cosine")


@query(_dense_sql("-list_dot_product(embedding::DOUBLE[], q)", "-sort_key"))
def dense_dot_topk(s, d):
    return _dense(s, d, "dot")


@query(_dense_sql("list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", "sort_key"))
def dense_l2_topk(s, d):
    return _dense(s, d, "euclidean")


@query(_dense_sql(COSINE, "1 - sort_key", "label = 3"))
def dense_filtered_topk(s, d):
    return _dense(s, d, "cosine", F.col("label") == 3)


BATCH = f"""e AS (SELECT vec_id AS id, label, {UNIT.format(v='embedding')} AS v FROM embeddings),
sc AS (SELECT q.id AS qid, e.id, e.label, q.label AS qlabel, list_dot_product(q.v, e.v) AS score FROM e, e q WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)"""


def _batch(s, d, k=10):
    v = vectors(s, d)
    return dense.batch_search(v, v.where("id % 20 = 0").withColumnRenamed("id", "qid"), k)


@query(f"WITH {BATCH} SELECT qid, id, round(round(score, 9), 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def dense_batch_topk(s, d):
    return _batch(s, d).withColumn("score", rounded("score"))


GOOD_MATRIX = """len(vectors) > 0 AND len(list_filter(vectors, lambda v: v IS NULL OR len(v) <> 24 OR len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0
  OR len(list_filter(v, lambda x: x <> 0)) = 0)) = 0"""
TOKENS = f"""tok AS (SELECT number AS id, list_transform(vectors, lambda v: {UNIT.format(v='v')}) AS m FROM {CURRENT} WHERE {GOOD_MATRIX})"""


def _matrices(s, d):
    return current(s, d, "vectors").where(dense.usable_matrix("vectors", 24)).select(F.col("number").alias("id"), F.col("vectors").alias("tokens"))


@query(f"""WITH {TOKENS}, q AS (SELECT id AS qid, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM tok WHERE id % 20 = 0),
b AS (SELECT qid, i, id, list_max(list_transform(m, lambda y: list_dot_product(y, v))) AS best FROM q, tok),
sc AS (SELECT qid, id, sum(best) AS score FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
SELECT qid, id, round(round(score, 9), 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def maxsim_topk(s, d):
    m = _matrices(s, d)
    out = dense.exact_maxsim(m, "tokens", m.where("id % 20 = 0").withColumnRenamed("id", "qid"), 5)
    return out.withColumn("score", rounded("score"))


CODES = "list_transform({u}, lambda x: floor(greatest(0.0, least(255.0, x * 127.5 + 128.0)) + 0.5)::INTEGER)"


@query(f"""SELECT vec_id AS id, list_sum(c)::BIGINT AS total, list_max(c)::INTEGER AS top, list_min(c)::INTEGER AS low, list_aggregate(c, 'string_agg', ',') AS codes
FROM (SELECT vec_id, {CODES.format(u=UNIT.format(v='embedding'))} AS c FROM embeddings)""")
def sq8_codes(s, d):
    c = vectors(s, d).select("id", V.sq8_code(V.normalise("vector")).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return c.select("id", total.alias("total"), F.array_max("c").alias("top"), F.array_min("c").alias("low"), F.array_join(F.col("c").cast("array<string>"), ",").alias("codes"))


@query(f"""WITH u AS (SELECT vec_id AS id, {UNIT.format(v='embedding')} AS u FROM embeddings),
q AS (SELECT u AS q FROM u ORDER BY id LIMIT 1),
c AS (SELECT id, u, q, {CODES.format(u='u')} AS c, list_transform(q, lambda x: round(greatest(-128.0, least(127.0, x * 127.5)))::INTEGER) AS qc FROM u, q),
s AS (SELECT id, u, q, list_sum(list_transform(list_zip(c, qc), lambda p: (p[1] - 128) * p[2])) AS code_score FROM c ORDER BY code_score DESC, id LIMIT 50)
SELECT id, code_score::BIGINT AS code_score, round(list_dot_product(u, q), 6) AS score FROM s ORDER BY score DESC, id LIMIT 10""")
def sq8_rerank(s, d):
    q = dense.literal(list(quantize.unit(np.array(first_vector(s, d), dtype=float))))
    u = vectors(s, d).select("id", V.normalise("vector").alias("u"))
    coded = u.withColumn("code_score", V.sq8_score(V.sq8_code("u"), V.sq8_query(q)))
    return top(top(coded, 50, "code_score").select("id", "code_score", rounded(V.dot("u", q)).alias("score")), 10)


# Predicates.

META = "SELECT number, metadata FROM " + CURRENT + " WHERE {w}"


def _meta(s, d, p):
    return current(s, d, "metadata").where(P.compile_predicate(p)).select("number")


VALID = "(CASE WHEN json_valid(metadata) THEN metadata END)"


@query(f"SELECT number FROM {CURRENT} WHERE coalesce(json_type({VALID}, '$.year') IN ('UBIGINT', 'BIGINT') AND json_extract({VALID}, '$.year')::VARCHAR = '2024', false)")
def pred_eq_json(s, d):
    return _meta(s, d, P.Eq("year", 2024))


@query(f"SELECT number FROM {CURRENT} WHERE coalesce(json_type({VALID}, '$.lang') = 'VARCHAR' AND json_extract_string({VALID}, '$.lang') IN ('en', 'de'), false)")
def pred_in(s, d):
    return _meta(s, d, P.In("lang", ("en", "de")))


@query(f"SELECT number FROM {CURRENT} WHERE coalesce(json_type({VALID}, '$.year') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_extract_string({VALID}, '$.year')::DOUBLE BETWEEN 2023 AND 2025, false)")
def pred_range(s, d):
    return _meta(s, d, P.Range("year", 2023, 2025))


@query(f"SELECT number FROM {CURRENT} WHERE NOT coalesce(json_type({VALID}, '$.lang') = 'VARCHAR' AND json_extract_string({VALID}, '$.lang') = 'en', false)")
def pred_not_missing(s, d):
    return _meta(s, d, P.Not(P.Eq("lang", "en")))


@query("SELECT doc_id FROM documents WHERE coalesce(n_chars >= 500, false) AND coalesce(lang <> 'en', false)")
def payload_compare(s, d):
    return table(s, d, "documents").where(P.compare("n_chars", "bigint", "gte", 500) & P.compare("lang", "string", "neq", "en")).select("doc_id")


@query("SELECT query_id, count(*)::BIGINT AS copies FROM query_requests WHERE list_contains(channels, 'bm25') AND len(channels) >= 2 GROUP BY query_id")
def list_ops(s, d):
    ok = P.list_query("channels", "contains", "bm25") & P.list_query("channels", "length", "gte", 2)
    return table(s, d, "query_requests").where(ok).groupBy("query_id").agg(F.count("*").alias("copies"))


# Fusion.

CHANNELS = ("bm25", "exact_dense", "sparse_dot")


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, channel ORDER BY score DESC, id) - 1 AS rank FROM hits WHERE channel IN {CHANNELS})
SELECT qid, id, round(sum(1 / (10.0 + rank + 1)), 6) AS score, count(*)::INTEGER AS n_sources FROM r GROUP BY qid, id""")
def rrf_fusion(s, d):
    return fusion.fuse([channel(s, d, c) for c in CHANNELS]).select("qid", "id", rounded("score").alias("score"), F.size("sources").alias("n_sources"))


@query(f"""WITH {HITS} SELECT qid, id, round(sum(score * CASE channel WHEN 'bm25' THEN 0.5 WHEN 'exact_dense' THEN 2.0 ELSE 0.25 END), 6) AS score
FROM hits WHERE channel IN {CHANNELS} GROUP BY qid, id""")
def weighted_fusion(s, d):
    return fusion.fuse([channel(s, d, c) for c in CHANNELS], "weighted", weights=[0.5, 2.0, 0.25]).select("qid", "id", rounded("score").alias("score"))


@query(f"WITH {HITS} SELECT qid, id, round(score, 6) AS score FROM hits WHERE channel = 'bm25'")
def single_channel_native(s, d):
    return fusion.fuse([channel(s, d, "bm25")]).select("qid", "id", rounded("score").alias("score"))


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, channel ORDER BY score DESC, id) AS rank FROM hits WHERE channel IN {CHANNELS}),
t AS (SELECT qid, channel, list(id) AS ids FROM r WHERE rank <= 10 GROUP BY ALL),
o AS (SELECT a.qid, c.channel, coalesce(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))), 0) AS j
  FROM t a CROSS JOIN (SELECT unnest(['exact_dense', 'sparse_dot']) AS channel) c LEFT JOIN t b ON a.qid = b.qid AND b.channel = c.channel WHERE a.channel = 'bm25')
SELECT qid, round(min(j), 6) AS agreement FROM o GROUP BY qid""")
def channel_agreement(s, d):
    return fusion.agreement([channel(s, d, c) for c in CHANNELS], 10).select("qid", rounded("agreement").alias("agreement"))


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits WHERE channel = 'bm25')
SELECT qid, round(coalesce(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 0), 6) AS margin, round(max(score) - min(score), 6) AS spread
FROM r WHERE rank <= 10 GROUP BY qid""")
def ranking_signals(s, d):
    best = channel(s, d, "bm25").groupBy("qid", "id").agg(F.max("score").alias("score"))
    return fusion.signals(best, 10).select("qid", rounded("margin").alias("margin"), rounded("spread").alias("spread"))


def _asked(s, d, every=20):
    rows = latest(table(s, d, "query_requests").select("query_id", "text", "vectors", "ingested_at"), "query_id", "ingested_at")
    return rows.where(F.col("query_id") % every == 0).select(F.col("query_id").alias("qid"), "text", "vectors")


def _live(s, d):
    rows = latest(table(s, d, "snapshot_points").select("point_id", "vector", "deleted", "ingested_at"), "point_id", "ingested_at")
    return rows.where(~F.coalesce("deleted", F.lit(False)) & dense.usable("vector", 64)).select(F.col("point_id").alias("id"), "vector")


GOOD_VECTOR = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"


@query(rf"""
WITH asked AS (SELECT query_id AS qid, text, vectors FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ingested_at DESC) AS rn FROM query_requests) WHERE rn = 1 AND query_id % 20 = 0),
live AS (SELECT point_id AS id, {UNIT.format(v='vector')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC) AS rn FROM snapshot_points)
  WHERE rn = 1 AND NOT coalesce(deleted, false) AND {GOOD_VECTOR.format(v='vector')}),
dn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM
  (SELECT qid, id, max(list_dot_product(v, {UNIT.format(v='vector')})) AS score FROM (SELECT qid, unnest(vectors) AS vector FROM asked), live WHERE {GOOD_VECTOR.format(v='vector')} GROUP BY qid, id)),
d AS (SELECT number AS id, {WORDS} AS w FROM {CURRENT} WHERE text IS NOT NULL),
t AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS avgdl FROM d),
tf AS (SELECT id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT id, len(w)::DOUBLE AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
q AS (SELECT qid, term, count(*)::DOUBLE AS qtf FROM (SELECT qid, unnest({WORDS}) AS term FROM asked) GROUP BY ALL),
lx AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM
  (SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), t GROUP BY qid, id)),
f AS (SELECT qid, id, round(sum(1 / (10.0 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM dn WHERE rank <= 100 UNION ALL SELECT qid, id, rank FROM lx WHERE rank <= 100) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)
SELECT qid, r.id, round(score, 6) AS score, rank::INTEGER AS rank, text FROM r LEFT JOIN (SELECT number AS id, text FROM {CURRENT}) x USING (id) WHERE rank <= 10""")
def hybrid_rrf(s, d):
    return hybrid(s, d)


def hybrid(s, d, every=20):
    """BM25 over texts and exact cosine over vectors of the same numbers, each record at the best of a request's vectors,
    fused by reciprocal ranks, with the text joined to the ten best."""
    asked, records = _asked(s, d, every), current(s, d, "text").withColumnRenamed("number", "id")
    lex = lexical.bm25(records, asked.select("qid", "text"), 100)
    den = dense.batch_search(_live(s, d), asked.select("qid", F.explode("vectors").alias("vector")).where(dense.usable("vector", 64)), 100)
    fused = fusion.fuse([lex, den]).withColumn("score", F.round("score", 9))
    return top_per(fused, "qid", 10).join(records, "id", "left").select("qid", "id", rounded("score").alias("score"), "rank", "text")


@query(f"""WITH q AS (SELECT {ONE} AS q), s AS (SELECT vec_id AS id, label, list_dot_product(embedding::DOUBLE[], q) AS score FROM embeddings, q),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) AS place FROM p),
l AS (SELECT label, row_number() OVER (ORDER BY score DESC, pos) AS group_rank FROM g WHERE place = 1)
SELECT id, label, place::INTEGER AS place, group_rank::INTEGER AS group_rank FROM g JOIN l USING (label) WHERE place <= 2 AND group_rank <= 3""")
def group_top(s, d):
    scored = vectors(s, d).select("id", "label", V.dot("vector", dense.literal(first_vector(s, d))).alias("score"))
    # A list position is needed only for the best rows; the best two of every label are enough to place them all.
    short = top_per(scored, "label", 2, rank="_r").withColumn("position", F.row_number().over(W.orderBy(F.desc("score"), F.asc("id"))))
    return group_top_n(short, "label", 2, 3).select("id", "label", "place", "group_rank")


# Context.


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL")
def dedup_exact_text(s, d):
    return context.distinct_texts(table(s, d, "documents"), "doc_id")


@query(f"""WITH {HITS}, r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS ord FROM hits WHERE channel = 'bm25'),
p AS (SELECT r.*, c.parent, row_number() OVER (PARTITION BY qid, c.parent ORDER BY ord) AS place FROM r JOIN (SELECT number AS id, chunk.parent AS parent FROM {CURRENT}) c USING (id))
SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY ord) - 1)::INTEGER AS position FROM p WHERE parent IS NULL OR place <= 2""")
def per_parent_cap(s, d):
    best, rows = _pool(s, d)
    return context.select_context(best, rows, context.ContextOptions(limit=10_000, per_parent=2)).select("qid", "id", "position")


@query(f"""WITH c AS (SELECT number, chunk.parent AS parent, chunk."position" AS pos FROM {CURRENT} WHERE chunk.parent IS NOT NULL)
SELECT a.number AS seed, b.number AS number, (b.pos - a.pos)::BIGINT AS gap FROM c a JOIN c b ON a.parent = b.parent AND abs(a.pos - b.pos) <= 2 AND a.number <> b.number""")
def neighbour_expand(s, d):
    c = current(s, d, "chunk").select("number", "chunk.parent", "chunk.position").where("parent IS NOT NULL")
    near = context.neighbouring(c.select(F.col("number").alias("seed"), "parent", F.col("position").alias("at")), c, 2)
    return near.where("seed <> number").select("seed", "number", (F.col("position") - F.col("at")).alias("gap"))


@query(r"SELECT doc_id, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\s\x{000B}\x{0085}\p{Z}]+')) * 13 // 10)::BIGINT AS tokens FROM documents")
def token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", T.estimated_tokens("text").alias("tokens"))


def _pool(s, d):
    best = channel(s, d, "bm25").groupBy("qid", "id").agg(F.max("score").alias("score"))
    rows = current(s, d, "text", "chunk").select(F.col("number").alias("id"), "text", "chunk.parent", "chunk.position")
    return best, rows


@query()
def context_select(s, d):
    best, rows = _pool(s, d)
    return context.select_context(best, rows, context.ContextOptions(limit=8, per_parent=2, neighbours=1, deduplicate=True, budget_tokens=600))


@query()
def context_mmr(s, d):
    best, rows = _pool(s, d)
    # A record stands for the mean of its vectors; those without are like none.
    mean = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.aggregate("tokens", F.lit(0.0), lambda a, t: a + F.get(t, i)) / F.size("tokens"))
    rows = rows.join(_matrices(s, d).select("id", mean.alias("vector")), "id", "left")
    return context.select_context(best, rows, context.ContextOptions(limit=5, mmr=0.5), "vector")


# Storage semantics.


@query(f"SELECT number, seq, md5(coalesce(text, '')) AS digest FROM {CURRENT}")
def upsert_last_wins(s, d):
    """One batch with every version of a record, into a collection of its own."""
    rows = table(s, d, "retrieval_docs").where("number IS NOT NULL")
    held = store.Store(s, scratch_path(s, "store"), store.IndexConfig(24))
    held.upsert(rows.select(F.col("number").alias("id"), "seq", "text", F.col("seq").cast("string").alias("metadata")))
    return held.documents().select(F.col("id").alias("number"), F.col("metadata").cast("bigint").alias("seq"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT snapshot, count(DISTINCT point_id)::BIGINT AS live FROM snapshot_points WHERE NOT coalesce(deleted, false) AND point_id NOT IN (SELECT point_id FROM snapshot_points WHERE deleted) GROUP BY snapshot")
def delete_tombstone(s, d):
    """A batch of points (every point lies in one snapshot), a batch of deletions, and what is left."""
    p = table(s, d, "snapshot_points").where("point_id IS NOT NULL")
    held = store.Store(s, scratch_path(s, "store"), store.IndexConfig(64))
    held.upsert(p.select(F.col("point_id").alias("id"), F.col("snapshot").alias("text")).distinct())
    held.apply(None, p.where("deleted").select(F.col("point_id").alias("id")))
    return held.documents().groupBy(F.col("text").alias("snapshot")).agg(F.count("*").alias("live"))


@query("""SELECT user_id, event_id AS seq, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 AND event_type <> 'error'""")
def wal_replay(s, d):
    from tarnwell.streaming.mutations import replay

    log = table(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "value")
    return replay(log, "user_id").select("user_id", F.col("seq.event_id").alias("seq"), rounded("value").alias("value"))


@query(f"""SELECT count(*)::BIGINT AS documents, count(text)::BIGINT AS text_documents, count_if({GOOD_MATRIX})::BIGINT AS token_documents,
coalesce(sum(CASE WHEN {GOOD_MATRIX} THEN len(vectors) END), 0)::BIGINT AS token_vectors, count_if(len(sparse.indices) = len(sparse."values"))::BIGINT AS sparse_documents FROM {CURRENT}""")
def index_stats(s, d):
    held = store.Store(s, scratch_path(s, "store"), store.IndexConfig(24))
    held.upsert(_documents(s, d))
    stats = held.stats()
    names = ("documents", "text_documents", "token_documents", "token_vectors")
    row = [stats[n] for n in names] + [stats["fields"].get("terms", 0)]
    return s.createDataFrame([row], ", ".join(f"{n} bigint" for n in (*names, "sparse_documents")))


def _documents(s, d):
    """The current records as documents of a collection, with what is usable of their vectors and sparse fields."""
    i, v = F.col("sparse.indices"), F.col("sparse.values")
    kept = F.filter(F.arrays_zip(i.alias("f"), v.alias("w")), lambda e: e["f"].isNotNull() & (e["w"] >= 0) & (e["w"] < float("inf")))
    pairs = F.transform(kept, lambda e: F.struct(e["f"].alias("feature"), e["w"].alias("weight")))
    return current(s, d, "text", "metadata", "chunk", "vectors", "sparse").select(
        F.col("number").alias("id"), "text", "metadata", "chunk", F.when(dense.usable_matrix("vectors", 24), F.col("vectors")).alias("vectors"),
        F.when(F.size(i) == F.size(v), F.create_map(F.lit("terms"), pairs)).alias("sparse"),
    )


@query(rf"""
WITH asked AS (SELECT query_id AS qid, text, vectors FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ingested_at DESC) AS rn FROM query_requests) WHERE rn = 1 AND query_id % 20 = 0),
live AS (SELECT point_id AS id, {UNIT.format(v='vector')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC) AS rn FROM snapshot_points)
  WHERE rn = 1 AND NOT coalesce(deleted, false) AND {GOOD_VECTOR.format(v='vector')}),
av AS (SELECT qid, j, vector FROM (SELECT qid, unnest(vectors) AS vector, generate_subscripts(vectors, 1) AS j FROM asked) WHERE {GOOD_VECTOR.format(v='vector')}),
dn AS (SELECT *, row_number() OVER (PARTITION BY qid, j ORDER BY round(score, 9) DESC, id) AS rank FROM
  (SELECT qid, j, id, list_dot_product(v, {UNIT.format(v='vector')}) AS score FROM av, live)),
d AS (SELECT number AS id, {WORDS} AS w FROM {CURRENT} WHERE text IS NOT NULL),
t AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS avgdl FROM d),
tf AS (SELECT id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT id, len(w)::DOUBLE AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
q AS (SELECT qid, term, count(*)::DOUBLE AS qtf FROM (SELECT qid, unnest({WORDS}) AS term FROM asked) GROUP BY ALL),
lx AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM
  (SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), t GROUP BY qid, id)),
h AS (SELECT qid, id, rank, score FROM dn WHERE rank <= 50 UNION ALL SELECT qid, id, rank, score FROM lx WHERE rank <= 50),
c AS (SELECT qid, count(*) AS channels FROM (SELECT qid, j FROM av UNION ALL SELECT DISTINCT qid, 0 FROM q) GROUP BY qid),
f AS (SELECT qid, id, CASE WHEN max(channels) = 1 THEN max(round(score, 9)) ELSE sum(1 / (10.0 + rank)) END AS score FROM h JOIN c USING (qid) GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) - 1 AS position FROM f)
SELECT qid, id, round(score, 6) AS score, position::INTEGER AS position FROM r WHERE position < 10""")
def collection_retrieve(s, d):
    """Requests answered by a collection of its own in one batch: a lexical channel for a text with words and a dense one for
    each usable vector, fused by reciprocal ranks where there are several."""
    asked = _asked(s, d)
    usable = F.filter(F.coalesce("vectors", F.array()), lambda v: dense.usable(v, 64))
    have = asked.select("qid", F.when(F.size(T.plain("text")) > 0, F.col("text")).alias("text"), usable.alias("vectors")).orderBy("qid").collect()
    held = engine.Collection.open(s, scratch_path(s, "collection"), store.IndexConfig(24))
    points = _live(s, d).select("id", F.create_map(F.lit("point"), F.col("vector")).alias("dense"))
    held.upsert(current(s, d, "text").select(F.col("number").alias("id"), "text").join(points, "id", "full"))
    held.compact()
    requests = {}
    for r in have:
        channels = [request.Bm25(r.text, 50)] * (r.text is not None) + [request.Dense("point", tuple(v), 50, "exact") for v in r.vectors or ()]
        if channels:
            requests[r.qid] = request.RetrieveRequest(tuple(channels))
    if not requests:
        return s.createDataFrame([], "qid bigint, id bigint, score double, position int")
    return held.retrieve_all(requests).select("qid", "id", rounded("score").alias("score"), "position")


# Compressed tokens, encodings and inverted lists.


def _models(s, d, packed_fde=True):
    """(stored tokens, codec, encoder, queries, probes) with the codec of index_config fitted on the tokens of at most 4,096
    records with the smallest hashes; queries are the matrices of all records whose number is divisible by 20."""
    c = table(s, d, "index_config").where("collection = 'retrieval_docs'").first()
    m = materialize(_matrices(s, d), "matrices")
    rows = m.orderBy(F.xxhash64("id"), "id").limit(4096).select("tokens").collect()
    samples = np.concatenate([np.array(r.tokens, dtype=float) for r in rows])
    codec = quantize.ResidualCodec.train(samples, min(c.centroids, len(samples)), c.residual_bits, 10)
    encoder = fixed_encoding.FixedEncoder(c.dimension, c.fde_ksim, c.fde_projected, c.fde_repetitions)
    asked = m.where("id % 20 = 0").withColumnRenamed("id", "qid")
    # A query reads the stored form several times (candidates, pruning, rescoring), so it is written first.
    return materialize(late.encode_tokens(m, "id", "tokens", codec, encoder, packed_fde), "tokens"), codec, encoder, asked, c.probes


@query()
def fde_topk(s, d):
    stored, _, encoder, asked, _ = _models(s, d, False)
    return late.fde_candidates(stored, asked, 20, encoder)


#: Candidates of token queries: by encodings, of those kept by centroids, by probes, and rescored exactly.
ENCODED, BROAD, PROBED, RESCORED = 400, 1500, 1000, 100


def _by_encodings(m, k):
    stored, codec, encoder, asked, _ = m
    return late.token_query(stored, asked, k, codec, encoder, ENCODED)


def _by_centroids(m, k):
    stored, codec, encoder, asked, _ = m
    return late.token_query(stored, asked, k, codec, encoder, BROAD, ENCODED)


def _by_probes(m, k):
    stored, codec, _, asked, probes = m
    return late.probe_query(stored, asked, k, PROBED, probes, codec)


@query()
def residual_maxsim(s, d):
    return _by_encodings(_models(s, d), 10)


@query()
def centroid_prune(s, d):
    return _by_centroids(_models(s, d), 10)


@query()
def centroid_probes(s, d):
    return _by_probes(_models(s, d), 10)


@query()
def token_rerank(s, d):
    """The best hundred by encodings and compressed tokens, rescored on the tokens themselves."""
    m = _models(s, d)
    return late.exact_rescore(_by_encodings(m, RESCORED), _matrices(s, d), "tokens", m[3], 10)


@query()
def token_explain(s, d):
    stored, codec, encoder, asked, _ = _models(s, d)
    return late.explain_tokens(late.token_query(stored, asked, 10, codec, encoder))


@query()
def token_recall(s, d):
    """(way, compressed, rescored): recall of the ten best of each way against exact MaxSim over all queries, as the
    compressed tokens rank them and after the best hundred are rescored on the tokens themselves."""
    m, docs_ = _models(s, d), _matrices(s, d)
    exact = materialize(dense.exact_maxsim(docs_, "tokens", m[3], 10), "maxsim")
    out = s.createDataFrame([], "way string, compressed double, rescored double")
    for way, f in (("encodings", _by_encodings), ("centroids", _by_centroids), ("probes", _by_probes)):
        hundred = materialize(f(m, RESCORED), "hundred")
        found = {"compressed": top_per(hundred, "qid", 10), "rescored": late.exact_rescore(hundred, docs_, "tokens", m[3], 10)}
        parts = [evalkit.recall_at_k(x.select("qid", "id", "rank"), exact, 10).agg(F.avg("recall").alias(name)) for name, x in found.items()]
        out = out.unionByName(parts[0].crossJoin(parts[1]).withColumn("way", F.lit(way)))  # one row each
    return out


#: Lists of the index and lists probed.
IVF_LISTS, IVF_PROBES = 32, 12


def _ivf(s, d, probes=None):
    from tarnwell.operators.ann import IvfIndex
    from tarnwell.session import scratch_path

    live = materialize(_live(s, d), "ivf-live")
    asked = live.where("id % 20 = 0").withColumnRenamed("id", "qid")
    index = IvfIndex.build(live, scratch_path(s, "ivf"), IVF_LISTS)
    return index.search_batch(s, asked, 10, probes or IVF_PROBES), live, asked


@query()
def ivf_topk(s, d):
    return _ivf(s, d)[0]


@query()
def ivf_recall(s, d):
    """Recall of ``ivf_topk`` against exhaustive search, per query."""
    found, live, asked = _ivf(s, d)
    return evalkit.recall_at_k(found, dense.batch_search(live, asked, 10), 10)


@query(f"""WITH live AS (SELECT point_id AS id, {UNIT.format(v='vector')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC) AS rn FROM snapshot_points)
  WHERE rn = 1 AND NOT coalesce(deleted, false) AND {GOOD_VECTOR.format(v='vector')}),
sc AS (SELECT q.id AS qid, p.id, list_dot_product(q.v, p.v) AS score FROM live p JOIN live q ON q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
SELECT qid, id, round(round(score, 9), 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def ivf_all_lists(s, d):
    """With all lists probed the index gives the exact answer."""
    return _ivf(s, d, IVF_LISTS)[0].withColumn("score", rounded("score"))


# Evaluation.


@query(f"""WITH {BATCH}, run AS (SELECT qid, id, rank, label = qlabel AS hit FROM r WHERE rank <= 100),
ideal AS (SELECT q.id AS qid, count(*) AS n FROM e q JOIN e ON q.label = e.label WHERE q.id % 20 = 0 GROUP BY ALL),
dcg AS (SELECT qid, sum(CASE WHEN hit AND rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg, min(CASE WHEN hit AND rank <= 10 THEN rank END) AS first,
  count_if(hit AND rank <= 10) AS h10, count_if(hit AND rank <= 100) AS h100 FROM run GROUP BY qid)
SELECT qid, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr,
round(h10 / n, 6) AS recall_10, round(h100 / n, 6) AS recall_100 FROM ideal JOIN dcg USING (qid)""")
def ndcg_recall_mrr(s, d):
    v = vectors(s, d)
    qrels = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "label").join(v.select("id", "label"), "label").select("qid", "id", F.lit(1.0).alias("grade"))
    m = evalkit.ranking_metrics(_batch(s, d, 100), qrels, 10, (100,))
    return m.select("qid", *[rounded(c).alias(c) for c in ("ndcg", "mrr", "recall_10", "recall_100")])


@query(f"""WITH {BATCH}, {{coded}}
SELECT t.qid, round(count(c.id) / 10, 6) AS recall FROM (SELECT * FROM r WHERE rank <= 10) t LEFT JOIN (SELECT qid, id FROM cr WHERE rank <= 10) c ON t.qid = c.qid AND t.id = c.id GROUP BY t.qid""".replace(
    "{coded}", f"""cd AS (SELECT id, {CODES.format(u='v')} AS c, list_transform(v, lambda x: round(greatest(-128.0, least(127.0, x * 127.5)))::INTEGER) AS qc FROM e),
cs AS (SELECT q.id AS qid, cd.id, list_sum(list_transform(list_zip(cd.c, q.qc), lambda p: (p[1] - 128) * p[2])) AS score FROM cd, cd q WHERE q.id % 20 = 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cs)"""))
def recall_of_codes(s, d):
    u = vectors(s, d).select("id", V.normalise("vector").alias("u"))
    c = u.select("id", F.transform(V.sq8_code("u"), lambda x: (x - 128).cast("double")).alias("vector"))
    q = u.where("id % 20 = 0").select(F.col("id").alias("qid"), V.sq8_query("u").cast("array<double>").alias("vector"))
    found = dense.batch_search(c, q, 10, normal=False)
    return evalkit.recall_at_k(found, _batch(s, d), 10).withColumn("recall", rounded("recall"))


#: Each (run, query, repetition) once: the row that arrived first.
LOG = """log AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query_idx, rep ORDER BY ingested_at, elapsed_ms) AS copy FROM query_log) WHERE copy = 1)"""


def _log(s, d, *columns, timed=True):
    """``columns`` of the log without repeated rows; with ``timed`` those whose time is finite and above 0."""
    keys = ("run_id", "query_idx", "rep")
    more = [c for c in dict.fromkeys(("elapsed_ms", *columns)) if c not in keys]
    first = F.min_by(F.struct(*more), F.struct("ingested_at", "elapsed_ms"))
    rows = table(s, d, "query_log").groupBy(*keys).agg(first.alias("r")).select(*keys, "r.*")
    ok = (F.col("elapsed_ms") > 0) & ~F.isnan("elapsed_ms") & (F.col("elapsed_ms") != float("inf"))
    return rows.where(ok) if timed else rows


@query(f"""WITH {LOG}, v AS (SELECT config, elapsed_ms, row_number() OVER (PARTITION BY config ORDER BY elapsed_ms) - 1 AS i, count(*) OVER (PARTITION BY config) AS n
FROM log WHERE elapsed_ms > 0 AND isfinite(elapsed_ms))
SELECT config, max(n)::BIGINT AS n, max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN elapsed_ms END) AS p50, max(CASE WHEN i = floor(0.99 * (n - 1) + 0.5) THEN elapsed_ms END) AS p99 FROM v GROUP BY config""")
def percentiles(s, d):
    return evalkit.rank_percentiles(_log(s, d, "config"), ["config"], "elapsed_ms", (0.5, 0.99))


REPORTS = "reports AS (SELECT DISTINCT run_id, collection, config, ef_search, recall, p50_ms FROM run_reports WHERE recall IS NOT NULL AND p50_ms IS NOT NULL)"


def _reports(s, d):
    return table(s, d, "run_reports").select("run_id", "collection", "config", "ef_search", "recall", "p50_ms").where("recall IS NOT NULL AND p50_ms IS NOT NULL").distinct()


@query(f"""WITH {REPORTS} SELECT a.run_id, a.collection, a.recall, a.p50_ms FROM reports a WHERE NOT EXISTS (SELECT 1 FROM reports b WHERE b.collection = a.collection
AND b.recall >= a.recall AND b.p50_ms <= a.p50_ms AND (b.recall > a.recall OR b.p50_ms < a.p50_ms))""")
def pareto_front(s, d):
    return evalkit.pareto_front(_reports(s, d), "recall", "p50_ms", ["collection"]).select("run_id", "collection", "recall", "p50_ms")


@query(f"""WITH {LOG}, o AS (SELECT config AS plan, query_idx AS qid, avg(coalesce(recall, 0)) AS quality, quantile_cont(elapsed_ms, 0.5) AS latency_ms
  FROM log WHERE elapsed_ms > 0 AND isfinite(elapsed_ms) GROUP BY ALL),
s AS (SELECT *, max(quality) OVER (PARTITION BY qid) - quality AS short FROM o)
SELECT plan, round(avg(quality), 6) AS quality, round(avg(latency_ms), 6) AS latency_ms, round(avg(short), 6) AS regret,
round(avg(CASE WHEN round(short, 9) <= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS epsilon_hit, count_if(latency_ms > 1.0)::BIGINT AS violations FROM s GROUP BY plan""")
def plan_regret(s, d):
    o = _log(s, d, "config", "recall").select(F.col("config").alias("plan"), F.col("query_idx").alias("qid"), F.col("recall").alias("quality"), F.col("elapsed_ms").alias("latency_ms"))
    out = evalkit.plan_regret(o, 0.05 + 5e-10, 1.0)
    return out.select("plan", *[rounded(c).alias(c) for c in ("quality", "latency_ms", "regret", "epsilon_hit")], "violations")


@query(f"""WITH {REPORTS}, g AS (SELECT collection, config, ef_search, avg(recall) AS recall, avg(p50_ms) AS p50 FROM reports GROUP BY ALL)
SELECT collection, config, ef_search, lead(ef_search) OVER w AS next_ef, round(lead(recall) OVER w - recall, 6) AS quality_gain, round(lead(p50) OVER w - p50, 6) AS latency_cost
FROM g WINDOW w AS (PARTITION BY collection, config ORDER BY ef_search)""")
def knob_marginal_returns(s, d):
    g = _reports(s, d).groupBy("collection", "config", "ef_search").agg(F.avg("recall").alias("recall"), F.avg("p50_ms").alias("p50"))
    out = evalkit.marginal_returns(g, ["collection", "config"], "ef_search", "recall", "p50")
    return out.select("collection", "config", "ef_search", F.col("next_knob").alias("next_ef"), rounded("quality_gain").alias("quality_gain"), rounded("latency_cost").alias("latency_cost"))


@query(f"""WITH {REPORTS}, t AS (SELECT unnest([0.8, 0.9, 0.95]) AS threshold)
SELECT threshold::DOUBLE AS threshold, min(p50_ms) AS best_latency, arg_min(config, (p50_ms, config)) AS config FROM reports, t WHERE recall >= threshold GROUP BY threshold""")
def best_at_recall(s, d):
    return evalkit.best_at_recall(_reports(s, d), [0.8, 0.9, 0.95], "recall", "p50_ms", "config")


@query("""SELECT item_id, CASE WHEN row_number() OVER (ORDER BY sha256('seed-1' || item_id::VARCHAR)) <= (SELECT count(*) // 2 FROM eval_items) THEN 'dev' ELSE 'test' END AS part FROM eval_items""")
def query_split(s, d):
    return evalkit.split_queries(table(s, d, "eval_items").select("item_id"), "item_id", "seed-1")


# Statistics of indexes and logs.


@query("SELECT snapshot, max_level, count(DISTINCT point_id)::BIGINT AS points FROM snapshot_points GROUP BY ALL")
def level_histogram(s, d):
    return table(s, d, "snapshot_points").groupBy("snapshot", "max_level").agg(F.count_distinct("point_id").alias("points"))


LIVE = f"""live AS (SELECT point_id AS id, snapshot, vector::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC) AS rn FROM snapshot_points)
  WHERE rn = 1 AND NOT coalesce(deleted, false) AND {GOOD_VECTOR.format(v='vector')})"""


@query(f"""WITH {LIVE}, n AS (SELECT sqrt(list_dot_product(v, v)) AS norm FROM live)
SELECT count(*)::BIGINT AS vectors, round(avg(norm), 6) AS mean_norm, round(min(norm), 6) AS least_norm, round(max(norm), 6) AS greatest_norm, round(stddev_pop(norm), 6) AS spread FROM n""")
def norm_stats(s, d):
    n = _live(s, d).select(V.norm("vector").alias("norm"))
    return n.agg(
        F.count("*").alias("vectors"), rounded(F.avg("norm")).alias("mean_norm"), rounded(F.min("norm")).alias("least_norm"),
        rounded(F.max("norm")).alias("greatest_norm"), rounded(F.stddev_pop("norm")).alias("spread"),
    )


@query("""WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
r AS (SELECT i, min(x) AS low, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 15 ELSE 1 END AS step FROM x GROUP BY i)
SELECT round(sqrt(avg(power(low + step * greatest(0, least(15, floor((x - low) / step + 0.5))) - x, 2))), 6) AS rmse FROM x JOIN r USING (i)""")
def sq4_rmse(s, d):
    """Error of 4-bit codes between each dimension's extremes, measured on the table itself."""
    x = vectors(s, d).select(F.posexplode(V.doubles("vector")).alias("i", "x"))
    r = x.groupBy("i").agg(F.min("x").alias("low"), F.when(F.max("x") > F.min("x"), (F.max("x") - F.min("x")) / 15).otherwise(1.0).alias("step"))
    code = F.greatest(F.lit(0), F.least(F.lit(15), F.floor((F.col("x") - F.col("low")) / F.col("step") + 0.5)))
    error = F.col("low") + F.col("step") * code - F.col("x")
    return x.join(r, "i").agg(rounded(F.sqrt(F.avg(error * error))).alias("rmse"))


@query(f"""WITH {BATCH}, k AS (SELECT qid, rank, sqrt(greatest(2 - 2 * score, 0)) AS dist FROM r WHERE rank BETWEEN 2 AND 17),
m AS (SELECT qid, max(dist) AS far FROM k GROUP BY qid)
SELECT qid, round(-1 / avg(ln(dist / far)), 4) AS lid FROM k JOIN m USING (qid) WHERE dist > 0 AND dist < far GROUP BY qid""")
def intrinsic_dimension(s, d):
    """Hill estimate from the distances to the sixteen nearest others."""
    return evalkit.intrinsic_dimension(_batch(s, d, 17).where("rank > 1")).withColumn("lid", rounded("lid", 4))


@query(f"""WITH {LOG}, o AS (SELECT collection, query_idx, config, avg(recall) AS recall FROM log WHERE recall IS NOT NULL GROUP BY ALL)
SELECT collection, query_idx, round(avg(recall), 6) AS mean_recall, round(min(recall), 6) AS worst_recall, count(*)::BIGINT AS configs FROM o GROUP BY ALL""")
def query_hardness(s, d):
    return evalkit.query_hardness(_log(s, d, "collection", "config", "recall", timed=False), ["collection", "query_idx"]).select(
        "collection", "query_idx", rounded("mean_recall").alias("mean_recall"), rounded("worst_recall").alias("worst_recall"), "configs")


@query(f"""WITH {REPORTS}, g AS (SELECT collection, config, ef_search, avg(recall) AS recall, avg(p50_ms) AS p50 FROM reports GROUP BY ALL)
SELECT b.config, count(*)::BIGINT AS pairs, round(avg(b.recall - a.recall), 6) AS recall_effect, round(avg(b.p50 - a.p50), 6) AS latency_effect
FROM g a JOIN g b ON a.collection = b.collection AND a.ef_search = b.ef_search AND a.config = 'm16' AND b.config <> 'm16' GROUP BY b.config""")
def paired_effects(s, d):
    g = _reports(s, d).groupBy("collection", "config", "ef_search").agg(F.avg("recall").alias("recall"), F.avg("p50_ms").alias("p50"))
    out = evalkit.paired_effects(g, ["collection", "ef_search"], "config", "m16", {"recall": "recall_effect", "p50": "latency_effect"})
    return out.select("config", "pairs", rounded("recall_effect").alias("recall_effect"), rounded("latency_effect").alias("latency_effect"))


@query(f"""SELECT number, replace(replace(replace(substr(e.fullkey, 2), '.', '/'), '[', '/'), ']', '') AS pointer,
CASE WHEN e.type = 'VARCHAR' THEN 'string' WHEN e.type IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN e.type = 'DOUBLE' THEN 'float' ELSE 'bool' END AS kind,
CASE WHEN e.type = 'VARCHAR' THEN e.value->>'$' ELSE e.value::VARCHAR END AS value FROM {CURRENT}, json_tree({VALID}) e WHERE e.type NOT IN ('NULL', 'OBJECT', 'ARRAY')""")
def payload_flatten(s, d):
    return P.flatten(current(s, d, "metadata"), "number", "metadata")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
