"""Query op6: a verdict on every page's url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .registry import query
from .urlfilter import PATTERNS, judge

_BLOCKED = " OR ".join("regexp_matches(low, '" + p.pattern + "')" for p in PATTERNS)
SQL = f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, q, v)),
best AS (
  SELECT page_id, host, path, low, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM p LEFT JOIN r ON starts_with(path, q) AND (host = h OR ends_with(host, '.' || h)) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict FROM best
"""


@query("op6_urlfilter", SQL)
def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
