"""Query op11: trie of rebuilt conversations, of which some borrow their first turns from another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .prefix_trie import KEY, digested, end_digests, prefix_trie
from .registry import query

# DuckDB has no crc32: bytes and bits of the decimal id go through the polynomial one by one.
SQL = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(cast(conv_id AS varchar), ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
        lambda v, k: xor(v >> 1, 3988292384::BIGINT * (v & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
s AS (
  SELECT c.conv_id, b.pos, b.r, b.t FROM c JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.pos < c.h
  UNION ALL
  SELECT c.conv_id, o.pos, o.r, o.t FROM c JOIN o USING (conv_id) WHERE o.pos >= c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS d, t, string_agg(md5(strlen(r) || ':' || r || t), '') OVER w AS path
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
m AS (SELECT conv_id, d, t, min(conv_id) OVER (PARTITION BY d, path) AS node, max(d) OVER (PARTITION BY conv_id) = d AS is_end FROM p),
n AS (
  SELECT node, d, count(*) AS n_convs, (count(*) - 1) * any_value(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS saved,
    sha256(coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM m GROUP BY node, d),
up AS (SELECT n.node, n.d, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT m.node, m.d, sum(n.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM n LEFT JOIN kids k USING (node, d) JOIN m ON m.conv_id = n.node AND m.d <= n.d GROUP BY m.node, m.d)
SELECT n.node AS conv_id, n.d AS depth, up.parent AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children,
  below.n_leaves, cast(below.saved_tokens AS bigint) AS saved_tokens, n.ends_sha256
FROM n JOIN up USING (node, d) JOIN below USING (node, d) LEFT JOIN kids USING (node, d)
"""

GROUP, LONGEST_HEAD = 20, 3


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns (see ``digested``) of each conversation after its first ``h`` ones were replaced by those of its group's first one."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    convs = turns.where("pos = 0").select("conv_id", base, h)
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < LONGEST_HEAD)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    cols = ["conv_id", "pos", "digest", "words"]
    borrowed = convs.join(heads, "base").where("pos < h").select(cols)
    own = turns.where(F.col("pos") >= F.crc32(F.col("conv_id").cast("string")) % 4).select(cols)
    exists = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return borrowed.unionByName(own).unionByName(exists)


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut(digested(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    trie = prefix_trie(rebuilt(turns))
    return trie.nodes.join(end_digests(trie.ends), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
