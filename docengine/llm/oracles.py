"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

SOURCE_MIX = rf"""
WITH s AS (SELECT doc_id, source, len({_WORDS.format('text')})::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s GROUP BY source),
ord AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM src),
lv AS (SELECT k, cap, w, ((sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT)::DOUBLE / ((sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT)::DOUBLE AS level
  FROM ord WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pick AS (SELECT arg_min(level, k) AS level FROM lv WHERE cap >= level * w),
rates AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target, CASE WHEN source_size > 0 THEN least(cap::DOUBLE, level * w) / source_size ELSE 0.0 END AS rate FROM ord CROSS JOIN pick)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || left(md5('mix42|' || coalesce(s.source, chr(0)) || '|' || coalesce(doc_id::VARCHAR, chr(0))), 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN rates ON s.source IS NOT DISTINCT FROM rates.source"""

LINE_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format('text')} AS w FROM documents),
pos AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ')) AS c FROM pos),
hit AS (SELECT DISTINCT r, i + unnest(range(5)) AS p FROM win WHERE c > 1),
rep AS (SELECT r, count(*) AS n_repeat_words FROM hit GROUP BY r),
ln AS (SELECT r, line, len({_WORDS.format('line')}) AS n, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (SELECT r, line, n, NOT (length(regexp_replace(line, '[^|]', '', 'g')) >= 3 OR sym > 0.3::DOUBLE * n
  OR (n > 1 AND upper(line) = line AND length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) >= 20)
  OR regexp_matches(lower(line), '\b(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|accept (?:all )?cookies|enable javascript|javascript is (?:disabled|required)|click here to|sign up for our newsletter|subscribe to our newsletter|skip to (?:main )?content|lorem ipsum|powered by wordpress|add to cart|forgot your password)\b')
  OR NOT (n <= 12 OR regexp_matches(line, '[.!?…。！？｡．؟۔।॥։።፧។៕။།༎᠃᠉]')
    OR 2 * length(regexp_replace(line, '[^\x{{0E00}}-\x{{0EFF}}]', '', 'g')) > length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))) AS ok FROM ln WHERE n > 0),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS n_kept_words FROM judged GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_kept_words, 0)::BIGINT AS n_kept_words FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_kept_words <= 0.5::DOUBLE * n_words AS kept FROM b"""

PIVOT_INDEX = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9::DOUBLE),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN deg USING (vec_id)"""
