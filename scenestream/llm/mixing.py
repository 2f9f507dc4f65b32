"""Mixing sources to target weights by entropy balancing: a convex dual solved by distributed Newton steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED_WORD, cut, text_key, word_count

# No source takes more than this many times its words, and no document.
MOST = 3
# Documents rounded together; more of them are cut into pieces by hash.
PIECE = 1_000
STEPS, TOLERANCE = 60, 1e-10
# A tilt beyond all others, at which every document with words is capped.
CAPPED = 1e12


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, source, size`` for each row."""
    return docs.select(
        "doc_id", F.coalesce(text_key(F.col("text")), F.lit(0)).alias("text_key"), "source", word_count(F.col("text"), SPACED_WORD).alias("size")
    )


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row a source.

    Sources in code point order (null last) weigh ``weights`` in turn and share the total. No target exceeds ``MOST``
    times its source: whoever would is set there, and the excess goes to the others by weight until none is above.
    That level is found in closed form: sources saturate in order of ``MOST * size / weight``.
    The windows hold one row a source, the only thing here that is not spread.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    ranked = totals.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", F.lit(float(MOST)) * F.col("source_size")).withColumn("at", F.col("cap") / F.col("weight"))
    up = Window.orderBy("at", "weight", F.col("source").isNull(), F.col("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    ahead = up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    marked = (
        ranked.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(ahead))
        .withColumn("all", F.sum("source_size").over(every))
    )
    # With everything before this source saturated, the rest would stand at this level.
    marked = marked.withColumn("level", (F.col("all") - F.col("filled")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(every)["level"]
    return marked.withColumn("chosen", first).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("chosen") * F.col("weight"), F.col("cap"))).alias("target")
    )


def tilt(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, mean, b``: rates ``exp(b * u)`` with ``u = size / mean size``, at most ``MOST``, nearest in entropy to taking all once.

    The words of a source are its only constraint, so the dual has one unknown a source and is convex: the words taken grow with
    ``b``. Each Newton step sums them and their slope over the histogram of sizes, for all sources at once; the cap is part
    of both. A step that leaves the bracket found so far is replaced by its middle. Sources that take ``MOST`` times their words have no finite
    ``b`` and get one that caps every document; sources without words have none.
    """
    per_source = histogram.groupBy("source").agg(F.sum("docs").alias("n_docs"), F.sum(F.col("docs") * F.col("size")).cast("double").alias("source_size"))
    goal = goals.select(F.col("source").alias("g_source"), F.col("target"))
    full = F.col("target") >= F.lit(float(MOST) * (1 - 1e-12)) * F.col("source_size")
    at = cut(
        per_source.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).where("source_size > 0")
        .select("source", (F.col("source_size") / F.col("n_docs")).alias("mean"), F.col("target").alias("want"), F.when(full, F.lit(CAPPED)).otherwise(0.0).alias("b"),
                F.lit(-CAPPED).alias("lo"), F.lit(CAPPED).alias("hi"))
    )
    for _ in range(STEPS):
        t = at.withColumnRenamed("source", "t_source")
        u = F.col("size") / F.col("mean")
        r = F.least(F.lit(float(MOST)), F.exp(F.least(F.col("b") * u, F.lit(30.0))))
        words = F.col("docs") * F.col("size") * r
        sums = (
            histogram.join(t, F.col("source").eqNullSafe(F.col("t_source")))
            .groupBy("source", "mean", "want", "b", "lo", "hi")
            .agg(F.sum(words).alias("taken"), F.sum(F.when(r < MOST, words * u).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("taken") - F.col("want")
        lo, hi = F.when(gap < 0, F.col("b")).otherwise(F.col("lo")), F.when(gap > 0, F.col("b")).otherwise(F.col("hi"))
        newton = F.col("b") - gap / F.col("slope")
        # A bracket that is still open on one side is closed by doubling.
        open_ = F.greatest(F.lit(-CAPPED), F.least(F.lit(CAPPED), F.col("b") * 2 - F.signum(gap)))
        middle = F.when((lo > -CAPPED) & (hi < CAPPED), (lo + hi) / 2).otherwise(open_)
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi) & (F.abs(newton - F.col("b")) <= 4 + 2 * F.abs("b"))
        step = F.when(F.abs(gap) <= TOLERANCE * F.col("want"), F.col("b")).when(inside, newton).otherwise(middle)
        at = cut(sums.select("source", "mean", "want", step.alias("b"), lo.alias("lo"), hi.alias("hi"), (F.abs(gap) / F.col("want")).alias("gap")))
        if (at.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    return at.select("source", "mean", "b")


def _round(rows: DataFrame) -> DataFrame:
    """Copies of each row. Within a piece, largest documents first, a copy more or less is taken so that the words so far
    stay nearest the words the rates ask for; what is left over is less than the smallest documents there."""

    def run(t: pa.Table) -> pa.Table:
        size, rate = t["size"].to_numpy().astype(float), t["rate"].to_numpy()
        order = np.lexsort((t["text_key"].to_numpy(), t["order_id"].to_numpy(), -size))
        low = np.floor(rate + 1e-12)
        copies, owed = low.copy(), 0.0
        for i in order.tolist():
            owed += (rate[i] - low[i]) * size[i]
            if owed * 2 >= size[i] > 0 and low[i] < MOST:
                copies[i] += 1
                owed -= size[i]
        return t.append_column("copies", pa.array(copies.astype(np.int64))).drop_columns(["piece", "order_id"])

    schema = "doc_id long, text_key long, source string, size long, source_size long, target double, rate double, copies long"
    return rows.groupBy("source", "piece").applyInArrow(run, schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``doc_id, text_key, source, size, source_size, target, rate, copies`` for each row of ``docs``.

    ``size`` counts words between ASCII blanks (null text: 0). A null source is a source, last in order. Rows may repeat, each
    is rounded on its own; texts without words get no copy. An empty table gives none. Other columns are not read.
    """
    rows = cut(sizes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")))
    histogram = cut(rows.groupBy("source", "size").agg(F.count("*").alias("docs")))
    totals = histogram.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).cast("long").alias("source_size"), F.sum("docs").alias("n"))
    goals = cut(targets(totals.select("source", "source_size"), weights))
    tilts = tilt(histogram, goals)
    per = goals.join(tilts.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")), "left")
    per = per.join(totals.select(F.col("source").alias("n_source"), "n"), F.col("source").eqNullSafe(F.col("n_source")))
    per = cut(per.select(F.col("source").alias("p_source"), "source_size", "target", "mean", "b", "n"))
    rate = F.least(F.lit(float(MOST)), F.exp(F.least(F.col("b") * F.col("size") / F.col("mean"), F.lit(30.0))))
    pieces = F.ceil(F.col("n") / PIECE).cast("long")
    asked = rows.join(per, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(0.0).alias("rate"),
        F.pmod(F.xxhash64("doc_id", "text_key"), pieces).alias("piece"), F.coalesce("doc_id", F.lit(-1)).alias("order_id"),
    )
    return _round(asked)


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), copy: str = "copy") -> DataFrame:
    """The mixed corpus: each document as many times as it was given copies, with all its columns, and ``copy`` from 1.

    A column of that name is replaced. Rows that repeat share the copies of all of them, the remainder goes to the first by a hash of all
    columns. Null texts and texts without words have no copies; an empty table stays empty.
    """
    docs = docs.drop(copy)
    keys = ["__id", "__key", "__source", "__no_source"]

    def keyed(df: DataFrame, key) -> DataFrame:
        return df.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__key": key,
                               "__source": F.coalesce(F.col("source").cast("string"), F.lit("")), "__no_source": F.col("source").isNull()})

    n = keyed(mix(docs, weights), F.col("text_key")).groupBy(keys).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    # Rows that repeat share their copies: all but the remainder alike, the remainder to the first.
    each = F.floor(F.col("__copies") / F.col("__rows"))
    columns = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(docs.schema[c].dataType, T.MapType) else F.col(c) for c in docs.columns])
    nth = F.row_number().over(Window.partitionBy(keys).orderBy(columns))
    found = keyed(docs, F.coalesce(text_key(F.col("text")), F.lit(0))).join(n, keys).withColumn("__nth", nth)
    found = found.withColumn("__n", (each + (F.col("__nth") <= F.col("__copies") - each * F.col("__rows")).cast("long")).cast("int")).where("__n > 0")
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias(copy))
