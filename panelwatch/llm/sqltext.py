"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{WORD}') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM d
), grams AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r
), c AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(replace(text, '!', '')) AS n_shouts,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS n_stop_words,
    len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•·]'))) AS n_bullets,
    len(list_filter(ls, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS n_ellipses
  FROM w LEFT JOIN repeats USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed
    AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words
    AND 4 * n_symbols <= n_words AND 2 * n_shouts <= n_words
    AND (n_words < 50 OR n_stop_words >= n_words * 0.02::DOUBLE)
    AND n_dup_lines <= n_lines * 0.4::DOUBLE
    AND (n_words < 50 OR n_bullets <= n_lines * 0.9::DOUBLE)
    AND (n_words < 50 OR 2 * n_ellipses <= n_lines) AS kept
FROM b
"""

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], {SPACES}), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.*, shared.k IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN shared ON l.k = shared.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _item_words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORD}')"


DECONTAMINATE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_item_words("text")} AS ws FROM documents
), b AS (
  SELECT item_id, {_item_words("text")} AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), grams AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)
), met AS (
  SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM met) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""

SUFFIX_DEDUP = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k
  FROM (SELECT r, h, unnest(range(0, strlen(h) // 2 - 399)) AS i FROM d WHERE strlen(h) >= 800)
), again AS (
  SELECT r, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)
), runs AS (
  SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again)
), spans AS (
  SELECT r, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, run
), gaps AS (
  SELECT r, b - a AS removed, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS start, a AS stop,
    row_number() OVER (PARTITION BY r ORDER BY a DESC) = 1 AS is_last, b
  FROM spans
), kept AS (
  SELECT r, sum(removed) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start)
      || any_value(substr(h, 2 * b + 1)) FILTER (is_last) AS rest
  FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

CONVERSATION_TRIE = """WITH own AS (
  SELECT conv_id AS c, list({'d': sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')),
      'n': strlen(coalesce(text, ''))}
    ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
asked AS (
  SELECT c, t, xor(list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295::BIGINT) % 9 AS h
  FROM own),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM asked a LEFT JOIN own b ON b.c = a.c - a.c % 5),
members AS (
  SELECT c, d, len(t) AS size, array_to_string(list_transform(t[1:d], lambda x: x.d), ',') AS key,
    CASE WHEN d > 0 THEN array_to_string(list_transform(t[1:d - 1], lambda x: x.d), ',') END AS parent,
    CASE WHEN d > 0 THEN t[d].n ELSE 0 END AS bytes
  FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT key, d, min(c) AS conv, min(parent) AS parent, count(*) AS n, min(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = d), '')) AS ends
  FROM members GROUP BY key, d),
counted AS (
  SELECT nodes.*, coalesce(k.n_children, 0) AS n_children
  FROM nodes LEFT JOIN (SELECT parent AS key, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2) k USING (key, d)),
sums AS (
  SELECT a.key, a.d, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.bytes) AS saved
  FROM counted a JOIN counted b ON b.d >= a.d AND (a.d = 0 OR starts_with(b.key || ',', a.key || ',')) GROUP BY 1, 2)
SELECT a.conv AS conv_id, CAST(a.d AS BIGINT) AS depth, p.conv AS parent_conv_id, a.n AS n_convs, a.n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM counted a JOIN sums USING (key, d) LEFT JOIN nodes p ON p.key = a.parent AND p.d = a.d - 1"""
