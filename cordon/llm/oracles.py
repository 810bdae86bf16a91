"""DuckDB SQL of the numbered queries that SQL can express in full."""

from __future__ import annotations


def kmeans_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """Every vector against every centroid in every round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v AS m FROM (SELECT v, sha256('{seed}:' || vec_id::VARCHAR) AS h FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"""p{r} AS (SELECT vec_id, v, c, list_sum([(v[i] - m[i]) * (v[i] - m[i]) for i in range(1, {dims + 1})])::BIGINT AS d FROM v, c{r}),
a{r} AS MATERIALIZED (SELECT * FROM p{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
n{r} AS (SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN n{r} USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


def _crc32_sql(text: str) -> str:
    """Over the bytes one by one, with the table of the reflected polynomial."""
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || x)::UBIGINT for x in regexp_extract_all(hex({text}), '..')]), lambda a, b: xor(a >> 8, tbl[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT"


def kd_sql(shards: int = 16) -> str:
    """A window over each node for every level; ``shards`` is a power of two."""
    text = lambda c: f"coalesce(('0x' || rpad(substr(hex({c}), 1, 14), 14, '0'))::BIGINT, -1)"
    step = lambda c: f"[CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END for x in {c}]"
    table = "[x::UBIGINT for x in range(256)]"
    parts = []
    for k in range(8):
        parts.append(f"b{k} AS (SELECT {step(table if k == 0 else 't')} AS t{'' if k == 0 else f' FROM b{k - 1}'})")
    parts.append(f"""r0 AS MATERIALIZED (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, coalesce(n_chars, -2305843009213693952) AS d0, {text("lang")} AS d1, {text("source")} AS d2,
  ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS digest, 0 AS node FROM documents),
wide AS MATERIALIZED (SELECT greatest(1, max(d0) - min(d0)) AS w0, greatest(1, max(d1) - min(d1)) AS w1, greatest(1, max(d2) - min(d2)) AS w2 FROM r0)""")
    level, m = 0, shards
    while m > 1:
        parts.append(f"""s{level} AS (SELECT node, sum(size) * {m // 2} // {m} AS target, (max(d0) - min(d0)) / any_value(w0) AS x0, (max(d1) - min(d1)) / any_value(w1) AS x1,
  (max(d2) - min(d2)) / any_value(w2) AS x2 FROM r{level}, wide GROUP BY node),
o{level} AS (SELECT r.*, target, CASE WHEN x0 >= x1 AND x0 >= x2 THEN d0 WHEN x1 >= x2 THEN d1 ELSE d2 END AS here FROM r{level} r JOIN s{level} USING (node)),
r{level + 1} AS MATERIALIZED (SELECT doc_id, size, d0, d1, d2, digest, CASE WHEN 2 * sum(size) OVER (PARTITION BY node ORDER BY here, digest, doc_id ROWS UNBOUNDED PRECEDING) - size <= 2 * target
  THEN node ELSE node + {m // 2} END AS node FROM o{level})""")
        level, m = level + 1, m // 2
    return f"""WITH {", ".join(parts)}
SELECT r.doc_id, size::BIGINT AS size, {_crc32_sql("coalesce(text, '')").replace("tbl", "t")} AS text_crc32, 'bytes' AS law, node::INT AS shard,
  row_number() OVER (PARTITION BY node ORDER BY r.doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM r{level} r JOIN documents USING (doc_id), b7"""


AUDIT = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, [x for x in string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') if x <> ''] AS ws FROM d),
f AS (SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed, count(*) AS n, count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(name, bit)),
o AS (SELECT [p.name, q.name, r.name, s.name, t.name] AS names, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p, x q, x r, x s, x t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
z AS (SELECT array_to_string(names, '') AS filter_order, k AS step, bits[k]::INT AS own, coalesce(list_sum(bits[:k - 1]), 0)::INT AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE failed & (own | earlier) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE failed & own <> 0 AND failed & earlier = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE failed & own <> 0 AND failed & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE failed = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE failed & own <> 0 AND failed & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE failed & own <> 0 AND failed & earlier = 0), 0)::BIGINT AS toxic_lost FROM g, z GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM y
"""
