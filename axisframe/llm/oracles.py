"""SQL of the centroid, perplexity and divergence queries."""

from __future__ import annotations


def centroids(rounds: int = 5, k: int = 40, width: int = 64, scale: int = 256, prefix: str = "2:") -> str:
    """Rounds of k-means over whole numbers, one pair of tables a round."""
    parts = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS vec
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = {width}
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT r, unnest(vec) AS x, unnest(range(1, {width + 1})) AS d FROM kept),
c0 AS MATERIALIZED (
    SELECT c, unnest(vec) AS x, unnest(range(1, {width + 1})) AS d
    FROM (SELECT vec, row_number() OVER (ORDER BY sha256('{prefix}' || vec_id), vec) - 1 AS c FROM kept
          WHERE vec_id IS NOT NULL) WHERE c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
    SELECT r, min({{'distance': distance, 'c': c}}) AS best
    FROM (SELECT r, c, sum((cells.x - c{i}.x) * (cells.x - c{i}.x)) AS distance
          FROM cells JOIN c{i} USING (d) GROUP BY r, c) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""
m{i} AS (
    SELECT best.c AS c, d, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN cells USING (r) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (
    SELECT c, d, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
    FROM c{i} LEFT JOIN m{i} USING (c, d))""")
    return ",".join(parts) + f""",
digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, best.distance::BIGINT AS distance,
       (sum(best.distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(best.distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN digests ON best.c = digests.c
"""


def _order(n: int, level: str, lower: str) -> str:
    """Modified Kneser-Ney of one order; hex digits name bytes."""
    context, rest = f"left(g, {2 * n - 2})", f"right(g, {2 * n - 2})"
    share = "1.0::DOUBLE / 256" if n == 1 else "b.p"
    below = "" if n == 1 else f"JOIN {lower} b ON b.g = {rest.replace('(g', '(x.g')}"
    return f"""
n{n} AS (SELECT count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n = 3) AS n3,
                count(*) FILTER (n = 4) AS n4 FROM {level}),
y{n} AS (SELECT *, n1::DOUBLE / (n1 + 2 * n2) AS y FROM n{n}),
d{n} AS (
    SELECT CASE WHEN n1 * n2 = 0 THEN 0.5 ELSE least(greatest(1 - 2 * y * n2 / n1, 0), 1) END AS d1,
           CASE WHEN n1 * n2 = 0 THEN 0.5 ELSE least(greatest(2 - 3 * y * n3 / n2, 0), 2) END AS d2,
           CASE WHEN n1 * n2 = 0 THEN 0.5 WHEN n3 = 0 THEN 1.5 ELSE least(greatest(3 - 4 * y * n4 / n3, 0), 3) END AS d3
    FROM y{n}),
x{n} AS (
    SELECT g, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d, {context} AS c FROM {level}, d{n}),
p{n} AS MATERIALIZED (
    SELECT x.g, (greatest(x.n - x.d, 0) + t.d * {share}) / t.n AS p
    FROM x{n} x JOIN (SELECT c, sum(n) AS n, sum(d) AS d FROM x{n} GROUP BY c) t USING (c) {below})"""


PERPLEXITY = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS MATERIALIZED (SELECT r, i, ws[i:i + 7] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
covered AS (
    SELECT r, count(DISTINCT j) AS n FROM (SELECT win.r, unnest(range(win.i, win.i + 8)) AS j FROM win JOIN dup USING (r, g)) GROUP BY r),
lines AS (
    SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l),
doubled AS (SELECT r, sum(n) - count(*) AS n FROM lines GROUP BY r),
base AS MATERIALIZED (
    SELECT r, doc_id, lang, len(ws)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(doubled.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           len(ws) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(ws) AS base_failed, strlen(text) AS n_bytes
    FROM d JOIN w USING (r) LEFT JOIN doubled USING (r) LEFT JOIN covered USING (r)),
h AS (SELECT r, '0A0A' || hex(encode(text)) AS h FROM d),
grams AS MATERIALIZED (
    SELECT r, g, count(*) AS n FROM (SELECT r, substr(h, i, 6) AS g FROM (
        SELECT r, h, unnest(range(1, length(h) - 4, 2)) AS i FROM h)) GROUP BY r, g),
three AS MATERIALIZED (SELECT g, sum(n)::BIGINT AS n FROM grams GROUP BY g),
two AS MATERIALIZED (SELECT right(g, 4) AS g, count(*) AS n FROM three GROUP BY 1),
one AS MATERIALIZED (SELECT right(g, 2) AS g, count(*) AS n FROM two GROUP BY 1),""" + ",".join(
    [_order(1, "one", ""), _order(2, "two", "p1"), _order(3, "three", "p2")]) + r""",
bits AS (SELECT r, sum(-log2(p) * n) / sum(n) AS bits FROM grams JOIN p3 USING (g) GROUP BY r),
passed AS MATERIALIZED (
    SELECT r, lang, bits, sqrt(n_bytes) AS root FROM base JOIN bits USING (r) WHERE NOT base_failed),
middle AS (SELECT lang, quantile_cont(round(bits, 4), 0.5) AS median FROM passed GROUP BY lang),
strayed AS MATERIALIZED (
    SELECT r, lang, bits, (bits - median) * root AS off FROM passed JOIN middle USING (lang)),
quartiles AS (
    SELECT lang, quantile_cont(round(bits / 1e-4) * 1e-4, 0.25) AS b1, quantile_cont(round(bits / 1e-4) * 1e-4, 0.75) AS b3,
           quantile_cont(round(off / 1e-2) * 1e-2, 0.25) AS o1, quantile_cont(round(off / 1e-2) * 1e-2, 0.75) AS o3
    FROM strayed GROUP BY lang),
verdicts AS (
    SELECT r, bits BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)
              OR off BETWEEN o1 - 2 * (o3 - o1) AND o3 + 2 * (o3 - o1) AS fine
    FROM strayed JOIN quartiles USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(fine, true) AS kept
FROM base LEFT JOIN verdicts USING (r)
"""

DIVERGENCE = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
found AS MATERIALIZED (
    SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM found GROUP BY lang, term HAVING count(*) >= 30),
counts AS MATERIALIZED (
    SELECT lang, source, term, sum(n)::HUGEINT AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
totals AS (
    SELECT DISTINCT d.lang, d.source, coalesce(t.n, 0)::HUGEINT AS total
    FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source),
shares AS MATERIALIZED (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v) AS p
    FROM totals t JOIN kept k ON k.lang = t.lang JOIN sizes s ON s.lang = t.lang
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
whole AS (
    SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
    FROM counts JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM totals GROUP BY lang) USING (lang)
    JOIN sizes USING (lang) GROUP BY lang, term),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT s.lang, s.source, 'term', s.term, (p - q)::BIGINT
    FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.n > 0 AND p > q),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 50
"""
