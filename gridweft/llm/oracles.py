"""DuckDB SQL of the corpus queries that SQL can express on whole tables.

The others need a tokenizer, XXH64, sampled keys, learnt scores or Spark's shuffle order; their
tests hold them against brute force.
"""

_BLANK = "[^ \\t\\r\\x0B\\x0C]"
_SPACE = "[\\x20\\x09-\\x0D]+"

LINES = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), f AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line FROM l WHERE regexp_matches(x, '{_BLANK}')
), r AS (
  SELECT doc_id, line, x, lead(x) OVER (PARTITION BY doc_id ORDER BY line) AS y FROM f
), a AS (
  SELECT doc_id, line FROM r WHERE y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY doc_id, line) > 1
), b AS (
  SELECT doc_id, line FROM r WHERE length(x) >= 100 QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, line) > 1
), gone AS (
  SELECT doc_id, line FROM a UNION SELECT doc_id, line + 1 FROM a UNION SELECT doc_id, line FROM b
), runs AS (
  SELECT 1 AS d, doc_id, line, md5(x) AS id FROM f QUALIFY count(*) OVER (PARTITION BY x) > 1
  UNION ALL
  SELECT d, doc_id, line, id FROM (
    SELECT runs.d + 1 AS d, runs.doc_id, runs.line, md5(runs.id || md5(f.x)) AS id FROM runs JOIN f ON f.doc_id = runs.doc_id AND f.line = runs.line + runs.d
  ) QUALIFY count(*) OVER (PARTITION BY id) > 1
), longest AS (
  SELECT doc_id, max(d) AS d FROM runs GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS body FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.i = l.i
  LEFT JOIN gone ON gone.doc_id = f.doc_id AND gone.line = f.line WHERE gone.line IS NULL GROUP BY l.doc_id
), n AS (
  SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id
), g AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(longest.d, 0)::BIGINT AS longest_repeat, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN longest ON longest.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

TOP_K = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.r AS of, a.vec_id AS query_id, b.vec_id, b.r, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)
)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY of ORDER BY score DESC, vec_id, r) QUALIFY row_number() OVER w <= 5
"""

SUBSTRINGS = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(list_transform(generate_series(1, len(ws) - 19), lambda s: {{'s': s, 'run': array_to_string(ws[s:s + 19], ' ')}})) AS w FROM d WHERE len(ws) >= 20
), later AS (
  SELECT doc_id, w.s AS s FROM p QUALIFY row_number() OVER (PARTITION BY w.run ORDER BY doc_id, w.s) > 1
), gone AS (
  SELECT DISTINCT doc_id, s + k AS i FROM later, generate_series(0, 19) AS t(k)
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.i) AS body FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS MATERIALIZED (
  SELECT r, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.r, b.r AS s FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.9
), reach AS (
  SELECT r, vec_id AS id FROM v UNION SELECT l.r, reach.id FROM l JOIN reach ON l.s = reach.r
), named AS (
  SELECT r, min(id) AS component_id FROM reach GROUP BY r
), n AS (
  SELECT r, count(*) AS n FROM l GROUP BY r
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN named ON named.r = v.r LEFT JOIN n ON n.r = v.r
"""


def _balls(rounds: int) -> str:
    """Whole comparisons of vectors and centroids; a round is an assignment and a move."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (
  SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM q, c{k}
), a{k} AS MATERIALIZED (
  SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)""")
        if k < rounds:
            steps.append(f"""x{k} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(q.v) AS x, generate_subscripts(q.v, 1) AS i FROM a{k} a JOIN q ON q.r = a.r) GROUP BY c, i
), m{k} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM x{k} GROUP BY c
), c{k + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m{k}.m, o.m) AS m FROM c{k} o LEFT JOIN m{k} ON m{k}.c = o.c
)""")
    return ",\n".join(steps)


BALLS = f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER w - 1)::INT AS c, v AS m FROM q WINDOW w AS (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) QUALIFY row_number() OVER w <= 16
), {_balls(3)}, sums AS (
  SELECT c, sum(d) AS s FROM a3 GROUP BY c
)
SELECT q.vec_id, a.c AS cluster, a.d AS distance, sums.s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM sums)::BIGINT AS inertia, sha256(array_to_string(c3.m, ',')) AS centroid_sha256
FROM q JOIN a3 a ON a.r = q.r JOIN c3 ON c3.c = a.c JOIN sums ON sums.c = a.c
"""

AUDIT = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(body, '{_SPACE}'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY body) AS first FROM d
), f AS (
  SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body), regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
    coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM w LEFT JOIN (SELECT doc_id AS of, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l ON l.of = w.doc_id
), g AS MATERIALIZED (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), o AS (
  SELECT [] :: INT[] AS p UNION ALL SELECT list_append(p, k::INT) FROM o, range(1, 6) AS t(k) WHERE NOT list_contains(p, k::INT)
), s AS (
  SELECT array_to_string(list_transform(p, lambda k: 'ABCDE'[k]), '') AS filter_order, step::INT AS step, p[1:step - 1] AS before, p[step] AS next FROM o, range(1, 6) AS t(step) WHERE len(p) = 5
), r AS MATERIALIZED (
  SELECT part, filter_order, step, next, n, good, toxic, len(list_filter(before, lambda k: fails[k])) = 0 AS here, fails[next] AS bad, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM s, g
), e AS MATERIALIZED (
  SELECT part, filter_order, step, next, sum(n * (here AND NOT bad)::INT) AS kept, sum(n * (here AND bad)::INT) AS removed, sum(n * (NOT here AND bad)::INT) AS redundant, sum(n * (bad AND alone)::INT) AS unique_fails,
    sum(good * (here AND bad)::INT) AS good_lost, sum(toxic * (here AND bad)::INT) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, next))::BIGINT AS shapley FROM e
"""
