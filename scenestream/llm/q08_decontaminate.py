"""Query op8: documents that quote benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_windows
from .registry import query

SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s + 1 : s + least(len(ws), 10)], ' ') AS t
  FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 10, 0) + 1)) AS s FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
cand AS (
  SELECT doc_id, s, n, array_to_string(ws[s + 1 : s + n], ' ') AS t
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM w, lens WHERE len(ws) >= n)),
hit AS (SELECT doc_id, s, c.n, item_id FROM cand c JOIN win USING (t) WHERE c.n = win.n),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS x FROM hit) GROUP BY doc_id)
SELECT w.doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op8_decontaminate", SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
