"""DuckDB SQL for the queries whose whole result SQL can say. It is written from the contract, by plain enumeration: all
windows, all pairs that share a shingle, reachability by a recursive union. Token ids, archives of pictures, forests and
random fields are outside SQL; the tests compare those queries with brute force."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Operator 3: links between sets of 4-word shingles, and what is reachable by them.
MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS n_union, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n),
half AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * n_union),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
r AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON link.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id, least(n.doc_id, coalesce(min(r.b), n.doc_id)) = n.doc_id AS kept
FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, {1 + 5 * i}, 5) AS INTEGER) // {2 ** shift}) % 32 + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))

#: Operator 5: what is read back from the archive.
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to, true AS agrees FROM q
"""

#: Operator 6: words covered by a window of 35 words that starts in two places or more.
SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS start FROM w WHERE len(ws) >= 35),
x AS (SELECT v.doc_id, v.start, sha256(array_to_string(ws[v.start:v.start + 34], ' ')) AS h FROM v JOIN w USING (doc_id)),
hit AS (SELECT doc_id, start FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM x) WHERE n > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(start, start + 35)))) AS places FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda y, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def _codes() -> str:
    """Operator 12, round by round: distances by plain sums over components, each entry the floored mean of its parts."""
    steps = []
    for k in range(5):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, min(d * 256 + entry) AS best FROM (SELECT p.*, b.entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM p JOIN b{k} b USING (part)) GROUP BY ALL)""")
        if k < 4:
            steps.append(f"""m{k} AS (SELECT part, best % 256 AS entry, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(new, c) AS c FROM b{k} LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS new FROM m{k} GROUP BY part, entry) USING (part, entry))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM kept, range(4) r(part)),
b0 AS MATERIALIZED (SELECT part, entry, c FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p) WHERE entry < 256),
{", ".join(steps)},
e AS (SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b4) AS codebooks_sha256 FROM e
"""


#: Operator 12.
CODES = _codes()

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
# the checksum bit by bit: a byte is mixed in, then eight shifts, of which each may mix in the polynomial 0xEDB88320
_BITS = "flatten(list_transform(range(1, len(h), 2), lambda i: [CAST('0x' || h[i:i + 1] AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce(list_concat([4294967295], {_BITS}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"

#: Operator 13.
IMPORTANCE = f"""
WITH w AS MATERIALIZED (SELECT doc_id, len(ws) AS n_words, {_FEATURES} AS fs FROM (SELECT doc_id, {_RUNS} AS ws FROM documents)),
f AS MATERIALIZED (SELECT doc_id, unnest(fs) AS feature FROM w),
o AS MATERIALIZED (SELECT unnest({_FEATURES}) AS feature FROM (SELECT {_RUNS} AS ws FROM benchmark)),
b AS MATERIALIZED (SELECT feature, CAST({_CRC} AS BIGINT) % 10000 AS bucket FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM f UNION SELECT feature FROM o))),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM o JOIN b USING (feature) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM o) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN b USING (feature) JOIN g USING (bucket) GROUP BY doc_id),
y AS (SELECT w.doc_id, n_words, CAST(len(fs) AS BIGINT) AS n_features, CASE WHEN total IS NULL THEN 0 ELSE (total - ((total % len(fs)) + len(fs)) % len(fs)) // len(fs) END AS weight, CAST('0x' || substr(sha256('7:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN x USING (doc_id)),
z AS (SELECT doc_id, n_words, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS BIGINT) AS score FROM y),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM z WHERE n_words >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM r) // 100 THEN place END AS rank FROM z LEFT JOIN r USING (doc_id)
"""

SQL = {"op3_minhash": MINHASH, "op5_warc": WARC, "op6_substring": SUBSTRING, "op12_vector_codes": CODES, "op13_importance": IMPORTANCE}
