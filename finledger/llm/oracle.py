"""DuckDB SQL of the training-data queries that SQL can express (whole tables, whole texts)."""

from __future__ import annotations

from finledger.llm import mixing, quality_rules, substring_dedup
from finledger.llm._common import LOWER, UPPER

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents)"

QUALITY_RULES = rf"""
WITH {_WORDS},
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
line AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS x FROM w),
norm AS (SELECT doc_id, source, t, x,
    regexp_extract_all(translate(x, '{UPPER}123456789', '{LOWER}000000000'), '{_WORD}') AS nw FROM line),
full_lines AS (SELECT doc_id, source, t, x, array_to_string(nw, ' ') AS l, len(nw) AS n FROM norm WHERE len(nw) > 0),
frequent AS (SELECT source, l, min(doc_id) AS first_id FROM full_lines GROUP BY source, l HAVING count(DISTINCT t) > {quality_rules.MAX_DOCS}),
gone AS (SELECT a.doc_id, sum(a.n) AS n FROM full_lines a JOIN frequent f ON a.l = f.l AND a.source IS NOT DISTINCT FROM f.source
  WHERE a.doc_id <> f.first_id GROUP BY a.doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM full_lines GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_line_words >= {quality_rules.MIN_KEPT} * n_words AS kept, n_line_words FROM b
"""

_K = substring_dedup.WINDOW
SUBSTRING_DEDUP = rf"""
WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {_K - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {_K - 2})) AS i FROM w)),
late AS (SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, {_K})) AS k FROM late)),
pos AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce((SELECT count(*) FROM gone WHERE gone.doc_id = w.doc_id), 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_over USING (doc_id)
"""

_WEIGHTS = "[" + ", ".join(f"{x}.0::DOUBLE" for x in mixing.WEIGHTS) + "]"
_REST = mixing.LEAST_QUALITY
MIXING = rf"""
WITH {_WORDS},
d AS (SELECT doc_id, source, len(ws) AS size,
    -ln((CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
      / (1.0 - {1 - _REST} * least(1.0, 10.0 * len(regexp_extract_all(t, '[#*$%&|<>]')) / greatest(length(t), 1)::DOUBLE)) AS key FROM w),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, {_WEIGHTS}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS wt,
    (source_size * {mixing.MOST})::DOUBLE AS cap FROM src),
level AS (SELECT *, cap / wt AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * {mixing.SHARE} - coalesce(sum(cap) OVER o, 0.0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER o, 0.0)) AS lv
  FROM weighed WINDOW o AS (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (SELECT source, source_size, CASE WHEN lam IS NULL THEN cap ELSE least(cap, lam * wt) END AS target
  FROM (SELECT *, (SELECT lv FROM level WHERE ratio > lv ORDER BY ratio, source NULLS LAST LIMIT 1) AS lam FROM level)),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN least({mixing.MOST}, floor(target / source_size)) ELSE 0 END AS epochs FROM target),
run AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, r.source,
  CAST((epochs + CASE WHEN before + size / 2.0 <= greatest(0.0, target - epochs * source_size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM run r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
"""
