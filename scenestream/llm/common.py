"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Everything that is no digit, ASCII letter or non-ASCII character separates words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Lower-cased words of a text; null and blank texts have none."""
    spaced = F.trim(F.regexp_replace(ascii_lower(c), WORD_BREAK, " "))
    return F.when(spaced.isNull() | (spaced == ""), F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def word_count(c: Column, pattern: str = WORD) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name = "_" + name
    return name


def text_key(c: Column) -> Column:
    """With the id, tells rows of one document from those of another that has the same id."""
    return F.xxhash64(c)


def join_documents(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, text_key); a null id equals a null id. The key columns of ``a`` stay."""
    b = b.withColumnsRenamed({"doc_id": "__doc_id", "text_key": "__text_key"})
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_key") == F.col("__text_key"))
    return a.join(b, on, how).drop("__doc_id", "__text_key")


# A key asked for by more than one in this many rows is heavy.
HEAVY = 2000


def join_uneven(rows: DataFrame, lookup: DataFrame, keys: list[str], uses: str, total: int) -> DataFrame:
    """Left join of ``rows`` with a ``lookup`` of unique ``keys``, whatever share of the rows asks for one key.

    ``uses`` (a column of the lookup) counts the rows that ask for it, ``total`` all rows. At most ``HEAVY`` keys are asked
    for by more than one in ``HEAVY`` rows; these are broadcast, the others shuffled. Both inputs are read twice. Keys of the
    rows may be null and then find nothing; ``uses`` is dropped.
    """
    gained = [c for c in lookup.columns if c not in keys and c != uses]
    heavy = F.col(uses) * HEAVY > F.lit(total)
    many = lookup.where(heavy).select(*keys, F.lit(True).alias("__heavy"))
    marked = rows.join(F.broadcast(many), keys, "left")
    hot = marked.where("__heavy").drop("__heavy").join(F.broadcast(lookup.where(heavy).drop(uses)), keys, "left")
    rest = marked.where("__heavy is null").drop("__heavy").join(lookup.where(~heavy).drop(uses), keys, "left")
    names = [*rows.columns, *gained]
    return hot.select(names).unionByName(rest.select(names))


def by_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Runs of rows, sorted by their first ``columns`` columns, in whole buckets."""
    held: list[pa.RecordBatch] = []
    key = lambda b, i: tuple(b.column(c)[i].as_py() for c in range(columns))
    for b in batches:
        if not b.num_rows:
            continue
        last = key(b, b.num_rows - 1)
        if held and key(held[-1], 0) == last and key(b, 0) == last:
            held.append(b)
            continue
        # All before the bucket that is still open at the end of this batch is whole.
        same = np.ones(b.num_rows, bool)
        for c, v in enumerate(last):
            same &= b.column(c).to_numpy(zero_copy_only=False) == v
        cut_at = int(np.argmax(same))
        done = [*held, b.slice(0, cut_at)] if cut_at or held and key(held[-1], 0) != last else []
        if done:
            yield pa.Table.from_batches(done)
            held = []
        held.append(b.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)
