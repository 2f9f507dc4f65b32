"""Query op13: vector codes by ball k-means."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ball_kmeans import ball_codes, label_errors
from .common import table
from .registry import query

# One round: nearest entry of each part (ties to the lower index), then the floor of the mean of its parts.
ROUND = """
a{k} AS MATERIALIZED (
  SELECT row_id, part, e, d FROM (
    SELECT row_id, part, e, d, row_number() OVER (PARTITION BY row_id, part ORDER BY d, e) AS r FROM (
      SELECT p.row_id, p.part, c.e, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
      FROM p JOIN c{k} c ON c.part = p.part)) WHERE r = 1),
c{n} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT part, e, list(v ORDER BY i) AS x FROM (
      SELECT part, e, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
      FROM (SELECT a.part, a.e, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM a{k} a JOIN p USING (row_id, part)) GROUP BY part, e, i)
    GROUP BY part, e) m ON m.part = c.part AND m.e = c.e),"""

SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT row_id, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x FROM (SELECT row_id, v, unnest(range(16)) AS part FROM kept)),
c0 AS MATERIALIZED (SELECT part, row_id - 1 AS e, x FROM p WHERE row_id <= 64),
{ROUND.format(k=0, n=1)}
{ROUND.format(k=1, n=2)}
{ROUND.format(k=2, n=3)}
rows AS (
  SELECT row_id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY row_id),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN rows USING (row_id) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM kept JOIN rows USING (row_id) JOIN sums ON sums.label IS NOT DISTINCT FROM kept.label, book
"""


@query("op13_ball_kmeans", SQL)
def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ball_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    book = hashlib.sha256(",".join(map(str, codes.codebook.reshape(-1).tolist())).encode()).hexdigest()
    return label_errors(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book).alias("codebooks_sha256"))
