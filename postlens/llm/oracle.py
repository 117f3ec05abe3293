"""The vector queries again, as DuckDB SQL over the whole table: every pair is compared, nothing is pruned."""

from __future__ import annotations

INTEGERS = "list_transform(embedding, lambda x: floor({scale} * x::DOUBLE))"
WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_K = f"""
WITH v AS (SELECT vec_id, {INTEGERS.format(scale=256)} AS x FROM embeddings WHERE {WHOLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

NEGATIVES = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {INTEGERS.format(scale=256)} AS x FROM embeddings WHERE label IS NOT NULL AND {WHOLE}),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND {WHOLE}),
w AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS norm FROM v WHERE list_inner_product(x, x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds as a chain of tables; a codebook entry is (p, e, y)."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, {INTEGERS.format(scale=1024)} AS x FROM embeddings WHERE {WHOLE})",
        f"part AS MATERIALIZED (SELECT vec_id, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) AS y FROM v, range({parts}) t(p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries})",
        "book0 AS MATERIALIZED (SELECT p, e, y FROM part JOIN first USING (vec_id))",
    ]
    near = "SELECT vec_id, p, any_value(y) AS y, arg_min(e, d * 1024 + e) AS e, min(d) AS d FROM (SELECT vec_id, part.p, part.y, e, list_inner_product(part.y, part.y) - 2 * list_inner_product(part.y, b.y) + list_inner_product(b.y, b.y) AS d FROM part JOIN book{k} b ON b.p = part.p) GROUP BY vec_id, p"
    for k in range(rounds):
        steps += [
            f"near{k} AS MATERIALIZED ({near.format(k=k)})",
            f"mean{k} AS (SELECT p, e, list(m ORDER BY i) AS y FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS m FROM (SELECT p, e, unnest(y) AS x, generate_subscripts(y, 1) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e)",
            f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN mean{k} m USING (p, e))",
        ]
    steps += [
        f"near{rounds} AS MATERIALIZED ({near.format(k=rounds)})",
        f"own AS (SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)",
        f"sha AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda t: t::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM own JOIN v USING (vec_id), sha"


SQL = {"op5_exact_top_k": TOP_K, "op11_hard_negatives": NEGATIVES, "op12_embedding_dedup": NEAR_DUPLICATES, "op13_vector_codes": vector_codes()}
