"""SQL for the queries whose results DuckDB can count by itself."""

from __future__ import annotations

from pramana.llm import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bench_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_bench_words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_bench_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (SELECT DISTINCT item, m, array_to_string(w[k : k + m - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
windows AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM phrases) WHERE len(w) >= m)),
met AS (SELECT w.doc_id, w.k, w.m, p.item FROM windows w JOIN phrases p ON p.g = w.g AND p.m = w.m),
hits AS (SELECT doc_id, count(DISTINCT at_) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS at_ FROM met) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS items FROM met GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

SUBSTRINGS = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS at_ FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at_ FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY at_) AS t, count(*) AS n FROM words WHERE (doc_id, at_) NOT IN (SELECT (doc_id, at_) FROM gone) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _notices() -> str:
    rows = []
    for name, text in sorted(licenses.TEMPLATES.items()):
        w = licenses._words(text)
        stride = max(1, len(w) // 8)
        shingles = sorted({" ".join(w[i : i + licenses.SHINGLE]) for i in range(max(1, len(w) - licenses.SHINGLE + 1))})
        rows += [f"('{name}', {len(w) + stride - 1}, {stride}, {len(shingles)}, '{s}')" for s in shingles]
    return ", ".join(rows)


LICENSES = f"""WITH notices(template, width, stride, total, shingle) AS (VALUES {_notices()}),
d AS (SELECT doc_id, xh, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (SELECT DISTINCT doc_id, text, hash(text) AS xh FROM documents WHERE text IS NOT NULL)),
grams AS (SELECT doc_id, xh, len(w) AS n, k - 1 AS p, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, xh, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
met AS (SELECT doc_id, xh, n, p, template, width, stride, total, shingle FROM grams JOIN notices ON g = shingle),
places AS (SELECT DISTINCT doc_id, xh, n, template, width, total, unnest(range(greatest(0, CAST(ceil((p + 5 - width) / stride::DOUBLE) AS BIGINT)), p // stride + 1)) * stride AS first_word FROM met),
held AS (SELECT l.doc_id, l.xh, l.template, l.first_word, least(l.width, l.n - l.first_word) AS n_words, count(DISTINCT m.shingle)::DOUBLE / l.total AS containment FROM places l JOIN met m ON m.doc_id = l.doc_id AND m.xh = l.xh AND m.template = l.template AND m.p BETWEEN l.first_word AND l.first_word + l.width - 5 GROUP BY l.doc_id, l.xh, l.template, l.first_word, l.width, l.n, l.total),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, xh, template ORDER BY containment DESC, first_word) AS r FROM held WHERE containment >= {licenses.SIMILARITY})
SELECT doc_id, template, containment, CAST(first_word AS INTEGER) AS first_word, CAST(n_words AS INTEGER) AS n_words FROM best WHERE r = 1"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def _share(n: str, total: str) -> str:
    return f"1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v)"


DIVERGENCE = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, {_TERMS} AS w FROM documents),
occ AS (SELECT lang, source, r, unnest(w) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS n FROM occ GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS nl FROM kept GROUP BY 1),
cells AS (SELECT lang, source, t, count(*) AS n FROM occ SEMI JOIN kept USING (lang, t) GROUP BY 1, 2, 3),
groups AS (SELECT lang, source, coalesce(ng, 0) AS ng, coalesce(v, 0) AS v, coalesce(nl, 0) AS nl FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS ng FROM cells GROUP BY 1, 2) USING (lang, source) LEFT JOIN langs USING (lang)),
p AS (SELECT lang, source, t, coalesce(c.n, 0) AS n, {_share('coalesce(c.n, 0)', 'ng')} AS p, {_share('k.n', 'nl')} AS q FROM groups JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, t)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = o.source
UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""

NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

#: All pairs: the index may miss a link, which would show here as a row that differs.
NEAR_VECTORS = """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM e),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.95 * a.size * b.size),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a"""
