"""SQL for those queries of this subpackage whose rows SQL can express."""

from __future__ import annotations

from .decontaminate import LOWER, UPPER, WINDOW
from .line_dedup import LONG_CHARS, RUN
from .ngram_join import THRESHOLD
from .shingles import WIDTH
from .warc import BASE32


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def base32_sql(h: str) -> str:
    """Base32 of a SHA-1 in hexadecimal."""
    out = []
    for i in range(8):
        bits = " + ".join(f"(strpos('0123456789abcdef', substr({h}, {5 * i + j + 1}, 1)) - 1) * {16 ** (4 - j)}" for j in range(5))
        out += [f"substr('{BASE32}', CAST(((({bits}) // {32 ** (3 - k)}) % 32) + 1 AS INTEGER), 1)" for k in range(4)]
    return " || ".join(out)


WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {base32_sql("h")} AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to FROM p"""

LINES = f"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
d AS (SELECT doc_id, t, a, list_filter(a, lambda l: trim(l, ' ') <> '') AS l FROM raw),
w AS (
  SELECT doc_id, {RUN} AS size, unnest(list_transform(range(1, CAST(len(l) AS BIGINT) - {RUN - 2}), lambda i: {{'i': i, 'k': array_to_string(l[i:i + {RUN - 1}], chr(10))}})) AS x FROM d
  UNION ALL
  SELECT doc_id, 1 AS size, unnest(list_filter(list_transform(range(1, CAST(len(l) AS BIGINT) + 1), lambda i: {{'i': i, 'k': l[i]}}), lambda y: length(y.k) >= {LONG_CHARS})) AS x FROM d),
r AS (SELECT doc_id, size, x.i AS i, row_number() OVER (PARTITION BY size, x.k ORDER BY doc_id, x.i) AS rn FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM r WHERE rn > 1),
n AS (SELECT g.doc_id, count(*) AS gone, count(*) FILTER (WHERE b.p IS NULL) AS runs FROM g LEFT JOIN g b ON b.doc_id = g.doc_id AND b.p = g.p - 1 GROUP BY 1),
e AS (SELECT doc_id, unnest(range(1, CAST(len(a) AS BIGINT) + 1)) AS pos, unnest(a) AS line FROM d),
q AS (SELECT doc_id, pos, line, sum(CASE WHEN trim(line, ' ') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM e),
k AS (SELECT q.doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM q LEFT JOIN g ON g.doc_id = q.doc_id AND g.p = q.p AND trim(line, ' ') <> '' WHERE g.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_runs,
sha256(CASE WHEN gone IS NULL THEN t WHEN gone = len(l) THEN '' ELSE kept END) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, greatest(CAST(len(w) AS BIGINT) - {WINDOW - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS k
        FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - n + 2), lambda i: {{'i': i, 'k': array_to_string(w[i:i + n - 1], ' ')}})) AS x FROM d, lens WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, x.i AS i, spot.n, item_id FROM spot JOIN win ON win.n = spot.n AND win.k = x.k),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

SIMILAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(CAST(len(w) AS BIGINT) - {WIDTH - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS x FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE m.n >= {THRESHOLD} * (ca.n + cb.n - m.n) - 1e-9
      UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.t = y.t AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v)
SELECT v AS doc_id, min(root) AS class_id, (SELECT count(*) FROM l WHERE l.a = v) AS n_links FROM r GROUP BY v"""

SQL = {"op3_warc_archive": WARC, "op7_ngram_join": SIMILAR, "op8_line_dedup": LINES, "op9_decontamination": LEAKS}
