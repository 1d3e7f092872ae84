"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from .jaccard import PERCENT, WORDS
from .licences import COVER, GRAM, MERGE, PHRASES, TEMPLATES, words_of
from .warc import MIN_REVISIT_BYTES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = _UPPER + "234567"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {WORDS} THEN list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""


def _base32(digest: str) -> str:
    """A hexadecimal SHA-1 as base32: five digits make four letters."""
    letters = []
    for g in range(8):
        value = f"CAST('0x' || substr({digest}, {1 + 5 * g}, 5) AS INTEGER)"
        letters += [f"substr('{_BASE32}', 1 + (({value} >> {shift}) & 31), 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(letters)


WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS size, sha1(body) AS h FROM p),
k AS (SELECT *, CASE WHEN size >= {MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS keeper FROM d)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, {_base32("h")} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""


def _licences() -> str:
    rows = ", ".join(f"({i}, '{label}', {words_of(text)!r})" for i, (label, text) in enumerate(TEMPLATES))
    gram = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(GRAM))
    phrases = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        test = " AND ".join(f"ws[i + {j}] = '{p}'" if j else f"ws[i] = '{p}'" for j, p in enumerate(parts))
        phrases.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(ws) + 1), lambda i: coalesce({test}, false))) - 1 AS spot FROM w")
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t(template, label, ws) AS (VALUES {rows}),
tg AS (SELECT template, label, len(ws) AS n, i - 1 AS template_at, {gram} AS gram FROM (SELECT *, unnest(range(1, len(ws) - {GRAM - 2})) AS i FROM t)),
g AS (SELECT doc_id, i - 1 AS spot, {gram} AS gram FROM (SELECT *, unnest(range(1, len(ws) - {GRAM - 2})) AS i FROM w)),
hits AS (SELECT DISTINCT doc_id, template, label, n, template_at, spot, spot - template_at AS diagonal FROM g JOIN tg USING (gram)),
diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM hits),
starts AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {MERGE} THEN 0 ELSE 1 END AS new FROM diagonals),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM starts),
covers AS (SELECT doc_id, template, label, run, CAST(count(DISTINCT template_at + j) AS DOUBLE) / any_value(n) AS cover FROM hits JOIN runs USING (doc_id, template, diagonal), range(0, {GRAM}) r(j) GROUP BY ALL),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(cover) AS cover FROM covers WHERE cover >= {COVER} GROUP BY doc_id),
places AS ({" UNION ALL ".join(phrases)}),
base AS (SELECT doc_id, count(*) AS n, min(spot) AS a, max(spot) AS b, list(DISTINCT label) AS labels FROM places GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, b AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       greatest(CASE WHEN coalesce(base.n, 0) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, coalesce(more.cover, CAST(0 AS DOUBLE))) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


LICENCES = _licences()
