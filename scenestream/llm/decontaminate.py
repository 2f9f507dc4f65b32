"""Benchmark decontamination: a prefix-filtered join of item windows with documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_documents, text_key, words

# Bits of the membership map, a fixed 128 KB whatever the size of either side. It only thins out the
# positions that reach the join; what it lets through wrongly is dropped by the join.
MAP_BITS = 1 << 20
# Windows (of ten words) up to which their prefixes, a few tens of megabytes, are sent to every executor.
BROADCAST_WINDOWS = 200_000


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """Each different window once: ``(window, length, item_ids)``. A shorter item is one window, an empty one none."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    cut_out = F.transform(starts, lambda s: F.slice(F.col("w"), s + 1, F.least(n, F.lit(width))))
    one = w.select("item_id", F.explode(cut_out).alias("window"))
    return one.select("item_id", "window", F.size("window").alias("length"))


def _shingle(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def _tokens(windows: DataFrame, k: int) -> DataFrame:
    """Shingles of each window with their offset; windows of fewer than ``k`` words fall back to single words."""
    w, n = F.col("window"), F.col("length")
    long_ones = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(F.lit(k).alias("k"), i.alias("offset"), _shingle(w, i, k).alias("token")))
    short_ones = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(1).alias("k"), i.alias("offset"), _shingle(w, i, 1).alias("token")))
    return windows.select("window", "length", F.explode(F.when(n >= k, long_ones).otherwise(short_ones)).alias("t")).select(
        "window", "length", "t.k", "t.offset", "t.token"
    )


def _membership(tokens: DataFrame) -> Column | None:
    """A literal bit map of all tokens: slot number to 64 bits; None if there are none."""
    slot = F.col("token").bitwiseAND(F.lit(MAP_BITS - 1))
    bits = (
        tokens.select(F.shiftright(slot, 6).alias("slot"), F.expr("shiftleft(1L, cast(token & 63 as int))").alias("bit"))
        .groupBy("slot")
        .agg(F.bit_or("bit").alias("bit"))
        .collect()  # at most MAP_BITS / 64 rows
    )
    if not bits:
        return None
    filled = [0] * (MAP_BITS // 64)
    for r in bits:
        filled[r["slot"]] = r["bit"]
    return F.from_json(F.lit("[" + ",".join(map(str, filled)) + "]"), "array<bigint>")


def find_windows(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 3) -> DataFrame:
    """Per document row ``doc_id, n_words, n_hit, n_items, item_ids``.

    Every window of ``width`` item words (an item of fewer words is one window) is a set of shingles. Shingles
    are ordered by rarity over all documents; as a window must be contained whole, its necessary prefix is its
    rarest shingle, and only that is joined. A candidate must leave room for the window before and behind
    the shingle (length and positional bounds), then its words are compared one by one.

    Null and blank texts have no words. Rows may repeat: each gets its own result. A null ``doc_id`` is a
    document like any other; a null ``item_id`` counts as an item named by the empty string. Empty tables
    on either side give no hits. Other columns are not read.
    """
    by_item = cut(item_windows(items, width))
    windows = by_item.select("window", "length").distinct()
    tokens = _tokens(windows, shingle)
    maps = {k: _membership(tokens.where(F.col("k") == k)) for k in (shingle, 1)}
    w, n = F.col("w"), F.size("w")

    def held(i: Column, k: int) -> Column:
        bitmap = maps[k]
        if bitmap is None:
            return F.lit(False)
        slot = _shingle(w, i, k).bitwiseAND(F.lit(MAP_BITS - 1))
        return F.getbit(F.get(bitmap, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    matched = F.filter(positions, lambda i: held(i, shingle) | held(i, 1))
    around = F.transform(
        matched,
        lambda i: F.struct(
            i.alias("pos"),
            F.greatest(i - width + 1, F.lit(0)).alias("from"),
            _shingle(w, i, shingle).alias("token"),
            _shingle(w, i, 1).alias("word"),
            F.slice(w, F.greatest(i - width + 1, F.lit(0)) + 1, F.least(i, F.lit(width - 1)) + width).alias("near"),
        ),
    )
    read = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))
    seen = cut(read.select("doc_id", "text_key", n.alias("n_words"), F.posexplode_outer(around).alias("nth", "m")))

    places = seen.where(F.col("nth").isNotNull()).select(
        "doc_id", "text_key", "n_words", "m.pos", "m.from", "m.near",
        F.explode(F.array(F.struct(F.lit(shingle).alias("k"), F.col("m.token").alias("token")), F.struct(F.lit(1).alias("k"), F.col("m.word").alias("token")))).alias("t"),
    )
    common = places.groupBy("t.k", "t.token").agg(F.count("*").alias("n"))
    ranked = tokens.join(common, ["k", "token"], "left").groupBy("window", "length")
    rarest = ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset", "k")).alias("p"))
    prefix = cut(rarest.select("window", "length", "p.k", "p.token", "p.offset"))
    if prefix.count() <= BROADCAST_WINDOWS:  # beyond it, both sides are shuffled
        prefix = F.broadcast(prefix)

    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    whole = F.slice("near", start - F.col("from") + 1, F.col("length")) == F.col("window")
    hits = cut(
        places.select("*", "t.k", "t.token").join(prefix, ["k", "token"]).where(fits).where(whole)
        .select("doc_id", "text_key", "window", start.alias("start"), "length").distinct()
    )
    hit_words = (
        hits.select("doc_id", "text_key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
        .distinct().groupBy("doc_id", "text_key").agg(F.count("*").alias("n_hit"))
    )
    found = (
        hits.select("doc_id", "text_key", "window").distinct()
        .join(by_item.select("window", "item_id").distinct(), "window").select("doc_id", "text_key", "item_id").distinct()
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    )
    every = seen.where(F.col("nth").isNull() | (F.col("nth") == 0)).select("doc_id", "text_key", "n_words")
    out = join_documents(join_documents(every, hit_words, "left"), found, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents without a benchmark window, all their columns as they were."""
    bad = find_windows(docs, items, width).where("n_hit > 0").select("doc_id", "text_key").distinct()
    kept = docs.withColumn("__key", text_key(F.col("text")))
    bad = bad.withColumnsRenamed({"doc_id": "__doc_id", "text_key": "__text_key"})
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__key") == F.col("__text_key"))
    return kept.join(bad, on, "left_anti").drop("__key")
