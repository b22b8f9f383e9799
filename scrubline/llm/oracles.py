"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

# A word goes if the last window to be removed that starts at or before it, starts less than 50 words before.
SUBSTRING = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS t FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(t[i:i + 49], ' ')) AS h FROM texts, UNNEST(range(1, len(t) - 48)) u(i)),
firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h),
gone AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > f),
words AS (SELECT doc_id, i, t[i] AS word FROM texts, UNNEST(range(1, len(t) + 1)) u(i)),
marked AS (SELECT w.doc_id, w.i, word, coalesce(w.i - max(g.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) < 50, false) AS dead FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (dead) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT dead) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN sums USING (doc_id)
"""

# Equal sets are one. Linked sets share one of the rarest n - ceil(0.9 n) + 1 shingles of either.
JACCARD = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS t FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')))) END AS s FROM texts),
named AS (SELECT doc_id, len(s) AS n, s, sha256(array_to_string(s, chr(10))) AS h FROM sets),
reps AS (SELECT min(doc_id) AS rep, h, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY h),
shingles AS (SELECT rep, n, unnest(s) AS w FROM reps),
often AS (SELECT w, count(*) AS c FROM shingles GROUP BY w),
ranked AS (SELECT rep, n, w, row_number() OVER (PARTITION BY rep ORDER BY c, w) AS r FROM shingles JOIN often USING (w)),
prefix AS (SELECT rep, n, w FROM ranked WHERE r <= n - (90 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT p.rep AS a, q.rep AS b, p.n AS n, q.n AS m FROM prefix p JOIN prefix q USING (w) WHERE p.rep < q.rep AND 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)),
shared AS (SELECT a, b, pairs.n AS n, m, count(*) AS k FROM pairs JOIN shingles x ON x.rep = a JOIN shingles y ON y.rep = b AND y.w = x.w GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (n + m - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep, rep AS far FROM reps UNION SELECT r.rep, e.b FROM reach r JOIN edges e ON e.a = r.far),
roots AS (SELECT rep, min(far) AS root FROM reach GROUP BY rep)
SELECT d.doc_id, d.n AS n_shingles, coalesce(root, d.doc_id) AS component_id FROM named d LEFT JOIN reps p ON p.h = d.h AND d.n > 0 LEFT JOIN roots o ON o.rep = p.rep
"""

# Every group has every kept term of its language, with a count of 0 where it doesn't hold it.
DIVERGENCE = r"""
WITH texts AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
words AS (SELECT lang, source, d, unnest(t) AS w FROM texts),
often AS (SELECT lang, w, count(*) AS n FROM words GROUP BY lang, w HAVING count(DISTINCT d) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM often GROUP BY lang),
pools AS (SELECT DISTINCT lang, source FROM texts),
held AS (SELECT lang, source, w, count(*) AS c FROM words SEMI JOIN often USING (lang, w) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM held GROUP BY ALL),
shares AS (SELECT g.lang, g.source, o.w, coalesce(h.c, 0) AS c, 1 + (1000000000 * (coalesce(h.c, 0) + 5)::HUGEINT) // (coalesce(t.n, 0) + 5 * s.v)::HUGEINT AS p, 1 + (1000000000 * (o.n + 5)::HUGEINT) // (s.n + 5 * s.v)::HUGEINT AS q
  FROM pools g JOIN often o ON o.lang = g.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.w = o.w),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM pools a JOIN pools b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', w, (p - q)::BIGINT FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

# A phrase is its words joined by spaces, which no word holds.
COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS t FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(t) - m + 2), lambda i: array_to_string(t[i:i + m - 1], ' '))) AS p FROM split, (VALUES (1), (2), (3)) v(m)),
often AS MATERIALIZED (SELECT lang, p, m, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM often WHERE m = 1 GROUP BY lang),
good AS MATERIALIZED (SELECT lang, m, p, f AS a, string_split(p, ' ') AS w FROM often WHERE m > 1 AND f >= 10),
parts AS MATERIALIZED (SELECT lang, p, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM good, (VALUES (1), (2)) c(k) WHERE k < m),
cuts AS (SELECT g.lang, g.p, a, k, x.f AS l, y.f AS r, ((1000000 * a::HUGEINT * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM parts g JOIN often x ON x.lang = g.lang AND x.p = g.head JOIN often y ON y.lang = g.lang AND y.p = g.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, p, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM good WHERE m = 3) GROUP BY ALL),
left_ AS (SELECT c.lang, c.p AS phrase, a, l, r, score FROM lowest c LEFT JOIN longer o ON o.lang = c.lang AND o.p = c.p WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM left_ JOIN sizes USING (lang) QUALIFY rank <= 2000
"""
