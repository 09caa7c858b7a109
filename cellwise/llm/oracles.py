"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
  seen AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN seen USING (s) WHERE first < doc_id),
  lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format(_LOWER)} AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_PLAIN.format(_LOWER)} AS w FROM benchmark),
  inst AS (SELECT b.*, row_number() OVER () AS item FROM b WHERE len(w) > 0),
  spots AS (SELECT item, item_id, j, least(len(w), 13) AS n, array_to_string(w[j:j + 12], ' ') AS s FROM inst, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j)),
  win AS (SELECT DISTINCT item_id, n, s FROM spots),
  sizes AS (SELECT DISTINCT n FROM win),
  places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
  m AS (SELECT DISTINCT doc_id, i, n, item_id FROM places JOIN win USING (s, n)),
  hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
  pairs AS (SELECT doc_id, item, item_id, n, i, j, i - row_number() OVER (PARTITION BY doc_id, item, n, i - j ORDER BY i) AS run FROM places JOIN spots USING (s, n)),
  verbatim AS (SELECT doc_id, item_id, min(i) - 1 AS spot, min(j) - 1 AS item_at, count(*) + n - 1 AS size FROM pairs WHERE n = 13 GROUP BY doc_id, item, item_id, n, i - j, run
    UNION ALL SELECT doc_id, item_id, i - 1, 0, n FROM pairs WHERE n < 13),
  best AS (SELECT doc_id, size, spot, item_id, item_at FROM verbatim QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, spot, item_id NULLS LAST, item_at) = 1),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(size, 0) AS BIGINT) AS longest_match, CAST(spot AS BIGINT) AS match_at, best.item_id AS match_item, CAST(item_at AS BIGINT) AS match_item_at
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)"""

_RATIOS = "[{'r': 'word_len', 'v': 100 * word_chars // n_words}, {'r': 'symbols', 'v': 1000 * n_symbols // n_words}, {'r': 'dup_lines', 'v': 1000 * n_dup_lines // n_lines}, {'r': 'repeats', 'v': 1000 * n_repeat_words // n_words}]"


_SPREADS = "CASE r WHEN 'word_len' THEN 10 WHEN 'symbols' THEN 40 WHEN 'dup_lines' THEN 120 ELSE 100 END"


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
  threes AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS t FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
  often AS (SELECT doc_id, t FROM threes GROUP BY doc_id, t HAVING count(*) > 1),
  repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM threes JOIN often USING (doc_id, t)) GROUP BY doc_id),
  c AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN repeated USING (doc_id)),
  k AS (SELECT *, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
  values_ AS (SELECT doc_id, lang, source, base_failed, unnest({_RATIOS}, recursive := true) FROM k WHERE n_words > 0),
  cells AS (SELECT lang, source, r, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS b, CAST(count(*) AS HUGEINT) AS n FROM values_ WHERE NOT base_failed GROUP BY 1, 2, 3, 4),
  whole AS (SELECT r, b, CAST(sum(n) AS HUGEINT) AS n, CAST(sum(sum(n)) OVER (PARTITION BY r) AS HUGEINT) AS total FROM cells GROUP BY r, b),
  by_lang AS (SELECT lang, r, b, CAST(sum(n) AS HUGEINT) AS n FROM cells GROUP BY lang, r, b),
  langs AS (SELECT g.lang, r, w.b, coalesce(o.n, 0) * w.total + 100 * w.n AS n FROM (SELECT DISTINCT lang, r FROM cells) g JOIN whole w USING (r) LEFT JOIN by_lang o USING (lang, r, b)),
  wide AS (SELECT *, CAST(sum(n) OVER (PARTITION BY lang, r) AS HUGEINT) AS total FROM langs),
  mixed AS (SELECT g.lang, g.source, r, w.b, coalesce(o.n, 0) * w.total + 100 * w.n AS n FROM (SELECT DISTINCT lang, source, r FROM cells) g JOIN wide w USING (lang, r) LEFT JOIN cells o USING (lang, source, r, b)),
  ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, r ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, r) AS total FROM mixed),
  quarts AS (SELECT lang, source, r, min(b) FILTER (WHERE upto * 4 >= total) AS q1, min(b) FILTER (WHERE upto * 4 >= total * 3) AS q3 FROM ranked GROUP BY lang, source, r),
  judged AS (SELECT v.doc_id, bool_and(coalesce(v <= q3 + 3 * greatest(q3 - q1, {_SPREADS}), TRUE) AND (r <> 'word_len' OR coalesce(v >= q1 - 3 * greatest(q3 - q1, {_SPREADS}), TRUE))) AS fine
    FROM values_ v LEFT JOIN quarts USING (lang, source, r) GROUP BY v.doc_id)
SELECT k.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, TRUE) AS kept FROM k LEFT JOIN judged USING (doc_id)"""
