"""Query op5: bytes of every document that repeat what an earlier document holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .registry import query
from .suffixes import remove_repeats


# Every 50-byte string of every text, in hex, with the least document it starts in; what it covers in later ones are runs.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, h[2 * i + 1 : 2 * i + 100] AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > least)),
run AS (
  SELECT doc_id, min(i) AS first, max(i) + 50 AS after
  FROM (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM hit) GROUP BY doc_id, n),
gone AS (SELECT doc_id, sum(after - first)::BIGINT AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id),
kept AS (
  SELECT doc_id, sha256(unhex(string_agg(h[2 * a + 1 : 2 * z], '' ORDER BY a))) AS kept_sha256
  FROM (SELECT doc_id, h, after AS a, coalesce(lead(first) OVER w, len(h) // 2) AS z FROM d JOIN run USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY first)
        UNION ALL SELECT doc_id, h, 0, min(first) FROM d JOIN run USING (doc_id) GROUP BY doc_id, h)
  GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256(unhex(h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op5_suffixes", SQL)
def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
