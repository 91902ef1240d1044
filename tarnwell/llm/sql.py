"""SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from tarnwell.llm.repetition import RULES, STOP_WORDS

WORDS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda w: lower(w))"
CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY seq DESC) AS rn FROM retrieval_docs WHERE number IS NOT NULL) WHERE rn = 1)"


def good(v: str, dim: int) -> str:
    return f"coalesce(len({v}) = {dim} AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0, false)"


def unit(v: str) -> str:
    return f"list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])))"


P1 = f"""
WITH w AS (SELECT number, term, count(*) AS y FROM (SELECT number, unnest({WORDS}) AS term FROM {CURRENT}) GROUP BY ALL),
i AS (SELECT number, i::VARCHAR AS term, sum(v) AS y FROM (SELECT number, unnest(sparse.indices) AS i, unnest(sparse."values")::DOUBLE AS v FROM {CURRENT}
  WHERE len(sparse.indices) = len(sparse."values")) WHERE i IS NOT NULL GROUP BY ALL),
k AS (SELECT *, sum(y) OVER (PARTITION BY number) AS n FROM i WHERE y > 0)
SELECT number, term FROM w WHERE y >= 3 AND term IN (SELECT term FROM w GROUP BY term HAVING count(*) <= 12)
UNION SELECT number, term FROM k WHERE y >= 0.25 * n AND term IN (SELECT term FROM k GROUP BY term HAVING count(*) <= 12)"""

P1_SCORES = f"""
WITH w AS (SELECT number, 'word' AS kind, term, count(*)::DOUBLE AS y, n FROM (SELECT number, len(w)::DOUBLE AS n, unnest(w) AS term FROM (SELECT number, {WORDS} AS w FROM {CURRENT})) GROUP BY ALL),
i AS (SELECT number, i::VARCHAR AS term, sum(CASE WHEN isfinite(v) THEN v ELSE 0 END) AS y FROM (SELECT number, unnest(sparse.indices) AS i, unnest(sparse."values")::DOUBLE AS v FROM {CURRENT}
  WHERE len(sparse.indices) = len(sparse."values")) WHERE i IS NOT NULL GROUP BY ALL HAVING sum(CASE WHEN isfinite(v) THEN v ELSE 0 END) > 0),
p AS (SELECT * FROM w UNION ALL SELECT number, 'index', term, y, sum(y) OVER (PARTITION BY number) FROM i),
t AS (SELECT kind, term, sum(y) AS cy, count(*)::BIGINT AS df FROM p GROUP BY ALL),
c AS (SELECT kind, sum(cy) AS cn FROM t GROUP BY kind),
x AS (SELECT number, kind, term, y, n, df, 0.01 * cy AS a, 0.01 * cn AS a0, greatest(cy - y, 0) AS rest, cn FROM p JOIN t USING (kind, term) JOIN c USING (kind)),
z AS (SELECT number, kind, term, y, n, df, (ln((y + a) / greatest(n + a0 - y - a, 1e-12)) - ln((rest + a) / greatest(cn - n + a0 - rest - a, 1e-12))) / sqrt(1 / (y + a) + 1 / (rest + a)) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY number, kind ORDER BY round(score, 6) DESC, term) AS place FROM z)
SELECT number, kind, term, round(y, 6) AS y, round(n, 6) AS n, df, round(score, 6) AS score, place::INTEGER AS place FROM r WHERE place <= 10"""

P2 = f"""
WITH p AS (SELECT point_id AS id, {unit('vector')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC) AS rn FROM snapshot_points)
  WHERE rn = 1 AND NOT coalesce(deleted, false) AND {good('vector', 64)}),
q AS (SELECT id, {unit('v')} AS v FROM (SELECT query_id AS id, unnest(vectors) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ingested_at DESC) AS rn FROM query_requests) WHERE rn = 1)
  WHERE {good('v', 64)}),
r AS (SELECT number AS id, list_transform(vectors, lambda v: {unit('v')}) AS m FROM {CURRENT} WHERE len(vectors) > 0 AND len(list_filter(vectors, lambda v: NOT {good('v', 24)})) = 0),
t AS (SELECT id, unnest(m) AS v, m[1] AS first, m FROM r),
c AS (SELECT DISTINCT a.id AS a, b.id AS b, a.m AS x, b.m AS y FROM r a JOIN t b ON a.id <> b.id AND list_dot_product(a.m[1], b.v) >= 0.97)
SELECT 'point' AS kind, a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON a.id < b.id AND list_dot_product(a.v, b.v) >= 0.97
UNION SELECT 'query', p.id, q.id FROM p JOIN q ON list_dot_product(p.v, q.v) >= 0.97
UNION SELECT 'record', least(a, b), greatest(a, b) FROM c
  WHERE list_min(list_transform(x, lambda u: list_max(list_transform(y, lambda v: list_dot_product(u, v))))) >= 0.97
  AND list_min(list_transform(y, lambda u: list_max(list_transform(x, lambda v: list_dot_product(u, v))))) >= 0.97"""

P2_EXACT = f"""
WITH p AS (SELECT point_id AS id, 0 AS no, {unit('vector')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC) AS rn FROM snapshot_points)
  WHERE rn = 1 AND NOT coalesce(deleted, false) AND {good('vector', 64)}),
q AS (SELECT id, no, {unit('v')} AS v FROM (SELECT query_id AS id, unnest(vectors) AS v, -generate_subscripts(vectors, 1) AS no FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ingested_at DESC) AS rn FROM query_requests) WHERE rn = 1) WHERE {good('v', 64)}),
r AS (SELECT number, vectors FROM {CURRENT} WHERE len(vectors) > 0 AND len(list_filter(vectors, lambda v: NOT {good('v', 24)})) = 0),
t AS (SELECT number AS id, no, {unit('v')} AS v FROM (SELECT number, unnest(vectors) AS v, generate_subscripts(vectors, 1) - 1 AS no FROM r)),
c AS (SELECT a.kind, a.id, a.no, b.id AS other, b.no AS other_no, list_dot_product(a.v, b.v) AS c FROM
  (SELECT 'point' AS kind, * FROM p UNION ALL SELECT 'query', * FROM q) a JOIN p b ON a.id % 20 = 0 AND (a.id <> b.id OR a.kind = 'query')
  UNION ALL SELECT 'record', a.id, a.no, b.id, b.no, list_dot_product(a.v, b.v) FROM t a JOIN t b ON a.id % 20 = 0 AND a.id <> b.id)
SELECT kind, id, no::INTEGER AS no, other, other_no::INTEGER AS other_no, place::INTEGER AS place
FROM (SELECT *, row_number() OVER (PARTITION BY kind, id, no ORDER BY round(c, 6) DESC, other, other_no) AS place FROM c) WHERE place <= 10"""

#: The definition of problem 3 without a graph: the records near a record point along its cluster's mean direction, and so
#: do, more exactly, all records near that direction; whoever reaches that of the least such record is a member.
_ADDED = "[" + ", ".join(f"sum(b.u[{i}])" for i in range(1, 25)) + "]"
P3 = f"""
WITH v AS (SELECT number, unnest(vectors)::DOUBLE[] AS u FROM {CURRENT} WHERE len(vectors) > 0 AND len(list_filter(vectors, lambda v: NOT {good('v', 24)})) = 0),
s AS (SELECT number, {_ADDED} AS u FROM v b GROUP BY number),
r AS (SELECT number, {unit('u')} AS u FROM s WHERE len(list_filter(u, lambda x: x <> 0)) > 0),
m AS (SELECT a.number, any_value(a.u) AS u, {_ADDED} AS m FROM r a JOIN r b ON list_dot_product(a.u, b.u) >= 0.6 GROUP BY a.number),
c AS (SELECT a.number, any_value(a.u) AS u, {_ADDED} AS m FROM m a JOIN r b ON list_dot_product({unit('a.m')}, b.u) >= 0.75 GROUP BY a.number),
d AS (SELECT number, u, {unit('m')} AS m FROM c),
h AS (SELECT a.number, any_value(a.u) AS u, min(b.number) AS cluster_number FROM d a JOIN r b ON list_dot_product(a.m, b.u) >= 0.75 GROUP BY a.number),
f AS (SELECT h.number, h.cluster_number FROM h JOIN d ON d.number = h.cluster_number AND list_dot_product(h.u, d.m) >= 0.75),
k AS (SELECT cluster_number, row_number() OVER (ORDER BY count(*) DESC, cluster_number) AS place FROM f GROUP BY cluster_number)
SELECT number, cluster_number FROM f JOIN k USING (cluster_number) WHERE place <= (SELECT centroids FROM index_config WHERE collection = 'retrieval_docs')"""

P4 = """
WITH t AS (SELECT run_id, query_idx, rep, arg_min(elapsed_ms, ingested_at) AS ms FROM query_log WHERE elapsed_ms > 0 AND isfinite(elapsed_ms) GROUP BY ALL),
s AS (SELECT run_id, ms, row_number() OVER (PARTITION BY run_id ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM t),
p AS (SELECT run_id, max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN ms END) AS a50, max(CASE WHEN i = floor(0.99 * (n - 1) + 0.5) THEN ms END) AS a99 FROM s GROUP BY run_id)
SELECT DISTINCT run_id FROM run_reports JOIN p USING (run_id) WHERE (NOT isnan(p50_ms) AND abs(p50_ms - a50) > 0.2 * a50) OR (NOT isnan(p99_ms) AND abs(p99_ms - a99) > 0.2 * a99)"""

P4_SETTLED = """
WITH t AS (SELECT run_id, query_idx, rep, arg_min(elapsed_ms, ingested_at) AS ms, min(collection) AS collection, min(run_at)::DATE::VARCHAR AS day
  FROM query_log WHERE elapsed_ms > 0 AND isfinite(elapsed_ms) GROUP BY ALL),
k AS (SELECT 'run' AS kind, run_id::VARCHAR AS of, ms FROM t UNION ALL SELECT 'collection', collection, ms FROM t UNION ALL SELECT 'day', day, ms FROM t),
s AS (SELECT kind, of, ms, row_number() OVER (PARTITION BY kind, of ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY kind, of) AS n FROM k)
SELECT kind, of, max(n)::BIGINT AS n, max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN ms END) AS p50, max(CASE WHEN i = floor(0.99 * (n - 1) + 0.5) THEN ms END) AS p99
FROM s GROUP BY kind, of"""

P5 = rf"""
WITH l AS (SELECT number, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT number, string_split(text, chr(10)) AS x FROM {CURRENT} WHERE length(text) > 1500)),
o AS (SELECT number, i, line, regexp_extract(line, '^[\s\x{{000B}}\x{{0085}}\p{{Z}}]*') AS lead, coalesce(sum(length(line) + 1) OVER (PARTITION BY number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
b AS (SELECT *, length(lead) = length(line) AS blank FROM o),
c AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY number ORDER BY i), true) AS after_blank FROM b)
SELECT number, (pos + length(lead))::BIGINT AS break_at FROM c WHERE NOT blank AND after_blank"""

P6 = """
WITH h AS (SELECT query_id, channel, number, max(CASE WHEN channel = 'dense_l2' THEN -raw_score ELSE raw_score END) AS s FROM channel_hits
  WHERE isfinite(raw_score) AND query_id IS NOT NULL AND channel IS NOT NULL AND number IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY s DESC, number) AS place FROM h),
n AS (SELECT query_id, count(DISTINCT channel) AS channels FROM h GROUP BY query_id)
SELECT query_id, number FROM r JOIN n USING (query_id) WHERE place <= 2 AND channels >= 2 GROUP BY query_id, number, channels HAVING count(*) = channels"""

P6_RANKING = """
WITH h AS (SELECT query_id, channel, number, max(CASE WHEN channel = 'dense_l2' THEN -raw_score ELSE raw_score END) AS s FROM channel_hits
  WHERE isfinite(raw_score) AND query_id IS NOT NULL AND channel IS NOT NULL AND number IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY s DESC, number) AS place FROM h),
f AS (SELECT query_id, number, round(sum(1 / (60.0 + place)), 12) AS total, count(*) AS channels, max(place) AS worst_rank FROM r GROUP BY ALL)
SELECT query_id, number, round(total, 6) AS total, channels, of_channels, worst_rank, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, number) AS position
FROM f JOIN (SELECT query_id, count(DISTINCT channel) AS of_channels FROM h GROUP BY query_id) USING (query_id)"""

P7 = f"SELECT doc_id FROM documents WHERE len({WORDS}) > 2048"

P8 = f"""
WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), e AS (SELECT item_id AS id, {WORDS} AS w FROM eval_items),
ds AS (SELECT id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
es AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT ds.id AS doc_id, es.id AS item_id FROM ds JOIN es USING (s)"""

P8_LEAKS = f"""
WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL), e AS (SELECT item_id AS id, {WORDS} AS w FROM eval_items),
ds AS (SELECT id, i, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
es AS (SELECT id, i, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12)),
m AS (SELECT ds.id AS doc_id, es.id AS item_id, ds.i, es.i AS j, ds.i - row_number() OVER (PARTITION BY ds.id, es.id, ds.i - es.i ORDER BY ds.i) AS run FROM ds JOIN es USING (s)),
l AS (SELECT doc_id, item_id, count(*) + 11 AS n, min(i) - 1 AS i, min(j) - 1 AS j FROM m GROUP BY doc_id, item_id, i - j, run),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, i, j) AS place FROM l)
SELECT doc_id, item_id, n::INTEGER AS match_words, i::INTEGER AS doc_word, j::INTEGER AS item_word FROM r WHERE place = 1"""

P9 = f"""
WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT id, len(w) AS n, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT id, n, i FROM (SELECT *, row_number() OVER (PARTITION BY id, s ORDER BY i) AS k FROM s) WHERE k > 1),
c AS (SELECT id, n, least(8, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, 8)) AS covered FROM r)
SELECT id AS doc_id FROM c GROUP BY id, n HAVING sum(covered) / n >= 0.3"""


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / ({whole}) ELSE 0.0 END"


def _repeated(parts: str) -> str:
    kept = f"list_filter(list_transform({parts}, lambda x: trim(x)), lambda x: x <> '')"
    return _share(f"len({kept}) - len(list_distinct({kept}))", f"len({kept})")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_LINES = "list_filter(l, lambda x: trim(x) <> '')"
_MEASURES = {
    "n_words": "len(w)::DOUBLE",
    "mean_word_length": _share("length(array_to_string(w, ''))", "len(w)"),
    "symbol_ratio": _share(r"length(regexp_replace(t, '[\p{L}\p{N}\s\x{000B}]+', '', 'g'))", "length(t)"),
    "stop_word_ratio": _share(f"len(list_filter(w, lambda x: lower(x) IN ({_STOP})))", "len(w)"),
    "bullet_line_ratio": _share(rf"len(list_filter({_LINES}, lambda x: regexp_matches(x, '^[\s\x{{000B}}]*[-*•]')))", f"len({_LINES})"),
    "ellipsis_line_ratio": _share(rf"len(list_filter({_LINES}, lambda x: regexp_matches(x, '(\.\.\.|…)[\s\x{{000B}}]*$')))", f"len({_LINES})"),
    "duplicate_line_ratio": _repeated("l"),
    "duplicate_paragraph_ratio": _repeated(r"string_split_regex(t, '\r?\n[ \t]*\r?\n')"),
    "repeat_share": "CASE WHEN len(w) > 0 THEN coalesce(covered, 0) / len(w) ELSE 0.0 END",
}


def _limits() -> str:
    tests = []
    for r in RULES:
        sides = [f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} >= {r.most}"] * (r.most is not None)
        tests.append(f"({' OR '.join(sides)}) AS bad_{r.measure}")
    return ", ".join(tests)


P9_MEASURES = rf"""
WITH x AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+') AS w,
  string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents),
s AS (SELECT k, i, array_to_string(v[i:i + 7], ' ') AS s FROM (SELECT k, list_transform(w, lambda y: lower(y)) AS v, unnest(range(1, len(w) - 6)) AS i FROM x WHERE len(w) >= 8)),
r AS (SELECT k, i FROM (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY i) AS again FROM s) WHERE again > 1),
c AS (SELECT k, sum(width)::DOUBLE AS covered FROM (SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS width FROM r) GROUP BY k),
m AS (SELECT doc_id, {", ".join(f"{c} AS {n}" for n, c in _MEASURES.items())} FROM x LEFT JOIN c USING (k))
SELECT *, {_limits()} FROM m"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1, "p1_scores": P1_SCORES, "p2_found": P2, "p2_exact": P2_EXACT, "p3_found": P3, "p4_found": P4, "p4_settled": P4_SETTLED, "p5_found": P5, "p6_found": P6, "p6_ranking": P6_RANKING,
        "p7_found": P7, "p8_found": P8, "p8_leaks": P8_LEAKS, "p8_clean": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P8}))", "p9_found": P9, "p9_measures": P9_MEASURES,
    }
