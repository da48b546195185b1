"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lavra.llm import audit, decontam, jaccard, ranked
from lavra.llm import license as licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _words(column: str) -> str:
    return rf"regexp_extract_all({_lowered(column)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP3 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, w[i : i + least({decontam.WINDOW}, len(w)) - 1] AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {decontam.WINDOW - 1}))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, x.item FROM (SELECT doc_id, i, n, w[i : i + n - 1] AS g FROM places) p JOIN windows x ON p.g = x.g),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
posts AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS pos FROM d WHERE len(w) > 0),
phrases AS (SELECT row_number() OVER () AS id, g, len(g) AS n, least({decontam.MISSING}, (len(g) - 1) // 4) AS allowed FROM (SELECT DISTINCT g FROM windows)),
terms AS (SELECT id, n, allowed, unnest(g) AS word, unnest(generate_series(0, len(g) - 1)) AS k FROM phrases),
freq AS (SELECT word, count(*) AS f FROM posts GROUP BY word),
ranked AS (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY coalesce(f, 0), k) AS r FROM terms t LEFT JOIN freq USING (word)),
starts AS (
  SELECT DISTINCT doc_id, id, n, allowed, pos - k + shift AS start
  FROM ranked JOIN posts USING (word), (SELECT unnest(generate_series(-{decontam.SLOP}, {decontam.SLOP})) AS shift) WHERE r <= allowed + 1
),
near AS (
  SELECT s.doc_id, s.id FROM starts s JOIN terms t ON t.id = s.id JOIN posts p ON p.doc_id = s.doc_id AND p.word = t.word AND abs(p.pos - s.start - t.k) <= {decontam.SLOP}
  GROUP BY s.doc_id, s.id, s.start, s.n, s.allowed HAVING count(DISTINCT t.k) >= s.n - s.allowed
),
near_items AS (
  SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_names
  FROM (SELECT DISTINCT doc_id, item FROM near JOIN phrases USING (id) JOIN windows ON phrases.g = windows.g) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {decontam.HIT_SHARE} * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near_names, '')) AS near_sha256
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""

_TEMPLATES = ", ".join(f"({t}, '{label}', '{text}', {base}, {pairs})" for t, (label, text, base, pairs) in enumerate(licenses.templates()))

OP7 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
t(template, label, phrase, base, pairs) AS (VALUES {_TEMPLATES}),
tw AS (SELECT template, label, base, pairs, string_split(phrase, ' ') AS p FROM t),
grams AS (SELECT template, label, base, pairs, i - 1 AS tpos, p[i] AS a, p[i + 1] AS b FROM (SELECT *, unnest(generate_series(1, pairs)) AS i FROM tw)),
pairs AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d WHERE len(w) > 1)),
hits AS (SELECT doc_id, pos, template, label, base, grams.pairs AS pairs, tpos, pos - tpos AS diagonal FROM pairs JOIN grams USING (a, b)),
diagonals AS (SELECT DISTINCT doc_id, template, base, diagonal FROM hits),
gaps AS (
  SELECT *, coalesce(CAST(diagonal - lag(diagonal) OVER v > CASE WHEN base = 1 THEN 0 ELSE {licenses.MERGE} END AS INTEGER), 0) AS gap
  FROM diagonals WINDOW v AS (PARTITION BY doc_id, template ORDER BY diagonal)
),
banded AS (SELECT doc_id, template, diagonal, sum(gap) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM gaps),
votes AS (SELECT doc_id, template, diagonal, count(DISTINCT tpos) AS votes FROM hits GROUP BY ALL),
bands AS (
  SELECT h.doc_id, template, label, base, pairs, band, count(DISTINCT tpos) AS covered, min(pos) AS low, max(pos) AS high, min(diagonal) AS start, max(votes) AS best
  FROM hits h JOIN banded USING (doc_id, template, diagonal) JOIN votes USING (doc_id, template, diagonal) GROUP BY ALL
),
found AS (
  SELECT *, base = 1 AND covered = pairs AS place,
    CASE WHEN base = 0 AND covered / pairs >= {licenses.COVER} AND high - low + 1 <= {licenses.STRETCH} * pairs THEN covered / pairs
      WHEN base = 0 AND best / pairs >= {licenses.COVER} THEN best / pairs END AS share, share IS NOT NULL AS notice
  FROM bands
),
by_doc AS (
  SELECT doc_id, count(*) FILTER (place) AS n_base, min(start) FILTER (place) AS first_word, max(start) FILTER (place) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (place))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label) FILTER (place OR notice))), ',') AS labels,
    max(CASE WHEN place THEN 1.0::DOUBLE WHEN notice THEN share END) AS score
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN by_doc USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lowered('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {jaccard.SHINGLE} THEN w ELSE w[i : i + {jaccard.SHINGLE - 1}] END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {jaccard.SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {jaccard.SIMILAR} * (x.n + y.n - c)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reached r JOIN either e ON e.a = r.seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM reached GROUP BY doc_id) m USING (doc_id)
"""

_BITS = {name: 1 << i for i, name in enumerate(audit.FILTERS)}
_BIT = "CASE name " + " ".join(f"WHEN '{name}' THEN {bit}" for name, bit in _BITS.items()) + " END"

OP11 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < {audit.LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {audit.DISTINCT} * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {audit.CAPITALS} * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)
),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
f(name) AS (VALUES {', '.join(f"('{x}')" for x in audit.FILTERS)}),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a JOIN f b ON b.name <> a.name JOIN f c ON c.name NOT IN (a.name, b.name)
  JOIN f d ON d.name NOT IN (a.name, b.name, c.name) JOIN f e ON e.name NOT IN (a.name, b.name, c.name, d.name)
),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS name FROM orders, generate_series(1, 5) g(step)),
bits AS (SELECT *, {_BIT} AS bit FROM steps),
sofar AS (SELECT *, CAST(coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS earlier FROM bits),
found AS (
  SELECT part, filter_order, step, name,
    coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM counts, sofar GROUP BY part, filter_order, step, name
)
SELECT part, filter_order, step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley
FROM found
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lowered('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all({_lowered('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
shares AS (
  SELECT doc_id, term, CAST(floor({ranked.WEIGHT} * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
    * (({ranked.SHARE} * tf) // ({ranked.COUNT} * tf + {ranked.LENGTH} * ({100 - ranked.PART} + ({ranked.PART} * n * n_docs) // n_terms))) AS share
  FROM tf JOIN df USING (term), total
),
scored AS (SELECT item_id, doc_id, CAST(sum(times * share) AS BIGINT) AS score FROM asked JOIN shares USING (term) GROUP BY item_id, doc_id HAVING sum(times * share) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored QUALIFY rank <= {ranked.TOP}
"""

ORACLE: dict[str, str] = {"op3_decontamination": OP3, "op7_licenses": OP7, "op8_jaccard": OP8, "op11_audit": OP11, "op13_ranked": OP13}
