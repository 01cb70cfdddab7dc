"""DuckDB SQL of the queries that SQL can express."""

SPACED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

EXACT_DEDUP = f"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {SPACED} AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
SELECT d.doc_id, coalesce(max(z.n), 0) AS n_shingles, min(r.seen) AS component_id,
       d.doc_id = min(r.seen) AS kept
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
GROUP BY d.doc_id
"""

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(
    range(1, len(w) - least(len(w), 10) + 2),
    lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM items WHERE len(w) > 0),
grams AS (
  SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2),
    lambda i: {{'p': i, 'g': array_to_string(w[i:i + k - 1], ' ')}})) AS x
  FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
found AS (
  SELECT doc_id, item_id, x['p'] AS p0, grams.k FROM grams JOIN windows
  ON windows.g = x['g'] AND windows.k = grams.k),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(p0, p0 + k)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# base32 of SHA-1: 160 bits are 32 letters of 5 bits
WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '')
    AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def _vector_codes(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds one after another: the nearest entry of each part, then the entries' new means."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * {width} + 1 : p * {width} + {width}] AS s FROM kept, range({parts}) AS t(p)),
c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    apart = " + ".join(f"(a.s[{i}] - c.s[{i}]) * (a.s[{i}] - c.s[{i}])" for i in range(1, width + 1))
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p, s, best['e'] AS e, best['d'] AS d FROM (
    SELECT a.vec_id, a.p, any_value(a.s) AS s, min({{'d': {apart}, 'e': c.e}}) AS best
    FROM parts AS a JOIN c{r} AS c ON a.p = c.p GROUP BY a.vec_id, a.p))""")
        if r < rounds:
            sums = ", ".join(f"sum(s[{i}])::BIGINT" for i in range(1, width + 1))
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(list_transform(t.sums, lambda x: ((x - ((x % t.n) + t.n) % t.n) // t.n)::BIGINT), c.s) AS s
  FROM c{r} AS c LEFT JOIN (SELECT p, e, [{sums}] AS sums, count(*)::BIGINT AS n FROM a{r} GROUP BY p, e) AS t
  ON t.p = c.p AND t.e = c.e)""")
    return ",".join(steps) + f""",
coded AS (
  SELECT vec_id, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS digest FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       digest AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


VECTOR_CODES = _vector_codes()

# the limit of a source holds exactly for the first ones by words per unit of weight
SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s),
o AS (
  SELECT *, sum(words) OVER () - coalesce(sum(3 * words) OVER earlier, 0) AS remains,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open_weight
  FROM w WINDOW earlier AS (ORDER BY words / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT remains::BIGINT AS l, open_weight::BIGINT AS ow FROM o
  WHERE remains * weight <= 3 * words * open_weight ORDER BY words / weight, rank LIMIT 1),
t AS (
  SELECT source, words, CASE WHEN l * weight > 3 * words * ow THEN (3 * words)::DOUBLE
         ELSE (l * weight)::DOUBLE / ow::DOUBLE END AS target
  FROM w, level),
f AS (
  SELECT *, CASE WHEN words = 0 THEN 0 ELSE least(3, floor(target + 0.5)::BIGINT // words) END AS whole FROM t),
r AS (
  SELECT d.*, words, target, whole, CASE WHEN whole = 3 THEN 0 ELSE floor(target + 0.5)::BIGINT - whole * words END AS extra,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, words AS source_size, target,
       (size * (whole + CASE WHEN earlier + size <= extra THEN 1
                             WHEN earlier < extra AND 2 * (extra - earlier) >= size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

# a class of everything that parts terms; only A-Z are put in lower case
RANKED_SEARCH = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM docs WHERE len(w) > 0),
wanted AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(w) AS t FROM items) GROUP BY ALL),
held AS (
  SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs)
  WHERE t IN (SELECT t FROM wanted) GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM held, total GROUP BY t),
lengths AS (SELECT doc_id, (75 + (25 * len(w) * n_docs) // n_words)::BIGINT AS m FROM docs, total),
scores AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM wanted JOIN held USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
