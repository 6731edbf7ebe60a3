"""SQL that gives the rows of those numbered queries that SQL can express on whole tables."""

from __future__ import annotations

#: CRC-32 of a conversation's decimal digits, bit by bit; words are counted by pattern.
PREFIX_TRIE = r"""WITH turns AS (
    SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY pos) AS turns, CAST(conv_id AS VARCHAR) AS digits FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(digits) + 1), lambda i: CAST(ascii(digits[i]) AS BIGINT))),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) % 4 AS h
    FROM own),
built AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM heads c LEFT JOIN heads b ON b.conv_id = c.conv_id - c.conv_id % 20),
paths AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) END AS saved
    FROM paths GROUP BY d, prefix),
children AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
below AS (SELECT n.top, n.prefix[1:n.top] AS prefix, sum(saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
    FROM (SELECT *, unnest(range(0, d + 1)) AS top FROM nodes) n LEFT JOIN children c ON c.d = n.d AND c.prefix = n.prefix GROUP BY 1, 2)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN below b ON b.top = x.d AND b.prefix = x.prefix
LEFT JOIN children c ON c.d = x.d AND c.prefix = x.prefix
LEFT JOIN nodes p ON p.d = x.d - 1 AND p.prefix = x.prefix[1:x.d - 1]"""

SOURCE_DIVERGENCE = r"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY lang),
every_term AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM every_term GROUP BY lang, source),
rates AS (SELECT e.lang, e.source, e.term, e.n, 1 + CAST(1000000000 AS HUGEINT) * (e.n + 1) // (t.total + s.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (e.n_lang + 1) // (s.total + s.v) AS q
    FROM every_term e JOIN totals t ON t.lang = e.lang AND t.source = e.source JOIN sizes s ON s.lang = e.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM rates a JOIN rates b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM rates WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
