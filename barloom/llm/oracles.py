"""DuckDB SQL for the corpus queries that SQL can express, over the same tables."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents
), g AS (
  SELECT doc_id, length(t) AS n_chars, p,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth, count(*) OVER (PARTITION BY p) AS group_size
  FROM d WINDOW w AS (PARTITION BY p ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(p) AS text_sha256, n_chars FROM g
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), c AS (
  SELECT *, CASE WHEN size < 4 THEN size ELSE length(bin(size)) * 4 + ((size >> (length(bin(size)) - 3)) & 3) END AS class,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 5))::INT % greatest(64, least(1048576, (2 ** ceil(log2(greatest(count(*) OVER (), 1)) / 2))::INT)) AS part
  FROM d
), s AS (
  SELECT source, sum(size)::DOUBLE AS total, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM c GROUP BY source
), w AS (
  SELECT *, ((nth - 1) % 3 + 1)::DOUBLE AS weight, total * 3 AS most, sum(total) OVER () AS everything FROM s
), o AS (
  SELECT *, row_number() OVER q AS pos, coalesce(sum(most) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WINDOW q AS (ORDER BY most / weight, nth)
), l AS (
  SELECT arg_min((everything - before) / rest, pos) AS level FROM o WHERE (everything - before) / rest * weight <= most
), t AS (
  SELECT source, total, least(most, level * weight) AS target FROM o, l
), r AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total * 1e15)::BIGINT ELSE 0 END::HUGEINT AS rate,
         (('0x' || substr(sha256('mix:' || coalesce(source, 'no source')), 1, 13))::BIGINT % 1000000000000000)::HUGEINT AS start
  FROM t
), n AS (
  SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY class, part, size, doc_id)::HUGEINT AS nth FROM c
)
SELECT doc_id, size, total::BIGINT AS source_size, target,
       (size * ((start + nth * rate) // 1000000000000000 - (start + (nth - 1) * rate) // 1000000000000000))::BIGINT AS taken
FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1, "op2_mix_sources": OP2}
