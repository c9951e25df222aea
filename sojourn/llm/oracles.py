"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

import string

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_GROUPS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS g
      FROM d, unnest(range(1, greatest(len(w) - 2, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= PERCENT * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS root, y AS node FROM e UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.root), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id"""
JACCARD = _GROUPS.replace("PERCENT", "85")
NEAR = f"SELECT *, doc_id = component_id AS kept FROM ({_GROUPS.replace('PERCENT', '80')})"

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {}) & 31 AS INT) + 1, 1)"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
x AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex, last FROM p JOIN f USING (h)),
g AS (SELECT page_id, i, CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS INT) AS v FROM x, unnest(range(0, 8)) t(i)),
b AS (SELECT page_id, string_agg({' || '.join(_DIGIT.format(s) for s in (15, 10, 5, 0))}, '' ORDER BY i) AS payload_digest FROM g GROUP BY ALL)
SELECT x.page_id, x.payload_bytes, b.payload_digest, CASE WHEN x.page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN x.page_id = last THEN NULL ELSE last END AS refers_to FROM x JOIN b USING (page_id)"""

REPEATS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS b FROM d, unnest(range(1, len(w) - 48)) t(i) WHERE len(w) >= 50),
least_of AS (SELECT b, min(doc_id) AS m FROM win GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, k FROM win JOIN least_of USING (b), unnest(range(i, i + 50)) u(k) WHERE m < doc_id),
word AS (SELECT doc_id, k, w[k] AS x FROM d, unnest(range(1, len(w) + 1)) u(k)),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.k) AS s FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY ALL)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
c AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM c, unnest(range(1, len(w) - n + 2)) t(i)),
win AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM d, (SELECT DISTINCT n FROM pat) l, unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT doc_id, i, pat.n, item FROM win JOIN pat USING (n, p)),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) u(k) GROUP BY ALL),
its AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY ALL)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

_CRC = "xor(list_reduce(list_transform(string_split({}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295)"
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


MANIFEST = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(0, 8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(0, 256) t(i))),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS part, {_leaf('text')} AS h,
  {_leaf(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS other,
  doc_id IS NOT NULL AND {_CRC.format('CAST(doc_id AS VARCHAR)')} % 3 = 0 AS changed FROM documents, crc),
leaf AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM d),
lv AS (SELECT 0 AS l, part, i, n, h FROM leaf UNION ALL
  SELECT l + 1, part, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY l, part, i // 8, n),
top AS (SELECT part, h, row_number() OVER (ORDER BY part) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
rt AS (SELECT 0 AS l, i, n, h FROM top UNION ALL
  SELECT l + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM rt WHERE n > 1 GROUP BY l, i // 8, n),
root AS (SELECT h FROM rt WHERE n = 1),
near AS (SELECT a.l, a.part, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS x,
  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS y
  FROM lv a JOIN lv b ON a.l = b.l AND a.part = b.part AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.l, a.part, a.i),
far AS (SELECT a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS x,
  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS y
  FROM rt a JOIN rt b ON a.l = b.l AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.l, a.i),
low AS (SELECT part, i AS leaf, 0 AS l, i, CASE WHEN changed THEN other ELSE h END AS f, '' AS proof FROM leaf UNION ALL
  SELECT low.part, leaf, low.l + 1, low.i // 8, sha256(x || f || y), proof || x || y
  FROM low JOIN near ON near.l = low.l AND near.part = low.part AND near.i = low.i),
high AS (SELECT low.part, leaf, 0 AS l, top.i, f, proof FROM low JOIN top USING (part) JOIN lv ON lv.part = low.part AND lv.l = low.l AND lv.n = 1 UNION ALL
  SELECT high.part, leaf, high.l + 1, high.i // 8, sha256(x || f || y), proof || x || y FROM high JOIN far ON far.l = high.l AND far.i = high.i)
SELECT leaf.doc_id, leaf.h AS leaf, top.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM leaf JOIN high ON high.part = leaf.part AND high.leaf = leaf.i JOIN rt ON rt.l = high.l AND rt.n = 1 JOIN top ON top.part = leaf.part, root"""


def _codes() -> str:
    """Six rounds, each a pair of tables: the nearest entry of each part, and the entries moved to the floors of their means."""
    near = """n{0} AS MATERIALIZED (SELECT vec_id, label, p, v, min(ROW(d, e)) AS b FROM (
  SELECT vec_id, label, part.p, part.v, e, CAST(list_sum(list_transform(list_zip(part.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM part JOIN c{0} c ON c.p = part.p) GROUP BY ALL)"""
    move = """c{1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN (
  SELECT p, e, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
    SELECT p, b[2] AS e, j, sum(v[j]) AS s, count(*) AS n FROM n{0}, unnest(range(1, len(v) + 1)) t(j) GROUP BY ALL) GROUP BY ALL) m USING (p, e))"""
    rounds = [x for r in range(6) for x in (near.format(r), move.format(r, r + 1))]
    return ",\n".join([
        """WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "part AS MATERIALIZED (SELECT vec_id, label, p, q[p * (len(q) // 8) + 1:(p + 1) * (len(q) // 8)] AS v FROM k, range(0, 8) t(p))",
        """c0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part) WHERE e < 16)""",
        *rounds, near.format(6),
        """book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS h
  FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS x FROM c6))""",
        """row AS (SELECT vec_id, label, string_agg(lpad(format('{:x}', b[2]), 2, '0'), '' ORDER BY p) AS code, CAST(sum(b[1]) AS BIGINT) AS error
  FROM n6 GROUP BY ALL)"""]) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM row, book"""


CODES = _codes()
