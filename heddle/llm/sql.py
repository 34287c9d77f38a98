"""The same results in DuckDB SQL, where SQL can express them."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS t FROM (SELECT item_id, n, w, unnest(range(len(w) - n + 1)) AS s FROM i)),
pos AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) AS k WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, pos.n, s, item_id FROM pos JOIN win ON pos.n = win.n AND pos.t = win.t),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN item USING (doc_id)
"""

_BITS = " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))

OP3 = f"""
WITH c AS (SELECT DISTINCT vec_id, {_BITS} AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, min(bit_count(xor(q.code, c.code)))::INTEGER AS distance
  FROM c AS q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, rank, neighbour_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM near) WHERE rank <= 10
"""

OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS s FROM w, (VALUES (1), (2), (3)) AS k(d) WHERE len(w) >= d),
f AS MATERIALIZED (SELECT lang, d, array_to_string(w[s : s + d - 1], ' ') AS t, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, d, t, a, split_part(t, ' ', 1) AS w1, split_part(t, ' ', 2) AS w2, split_part(t, ' ', 3) AS w3 FROM f WHERE d >= 2),
held AS (SELECT lang, t, max(a) AS longer FROM (SELECT lang, w1 || ' ' || w2 AS t, a FROM c WHERE d = 3 UNION ALL SELECT lang, w2 || ' ' || w3 AS t, a FROM c WHERE d = 3) GROUP BY ALL),
way AS (SELECT lang, t, a, 1 AS k, w1 AS first, CASE d WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS last FROM c UNION ALL SELECT lang, t, a, 2, w1 || ' ' || w2, w3 FROM c WHERE d = 3),
cut AS (SELECT way.lang, way.t, way.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * way.a * way.a) // (l.a::HUGEINT * r.a) AS score
  FROM way JOIN f AS l ON l.lang = way.lang AND l.t = way.first JOIN f AS r ON r.lang = way.lang AND r.t = way.last),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY score, k) = 1),
ranked AS (SELECT best.lang, best.t AS phrase, best.a, l, r, score::BIGINT AS score
  FROM best LEFT JOIN held ON held.lang = best.lang AND held.t = best.t WHERE longer IS NULL OR 100 * longer < 50 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN n USING (lang) QUALIFY rank <= 2000
"""

OP12 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

ORACLE_SQL = {"op3_hamming_top_k": OP3, "op10_decontaminate": OP10, "op12_itq_near_dedup": OP12, "op13_collocations": OP13}
