"""Approximate nearest neighbours on shifted space-filling curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Hilbert curves of randomly rotated, shifted projections, and the size of a window of neighbouring keys.
CURVES, DIMENSIONS, BITS, WINDOW = 16, 10, 6, 1500
SEED = 20_240_601
# Recall to reach, two standard errors above it, on so many asking vectors compared with all rows.
RECALL, SAMPLE = 0.9, 200
# About so many vectors scale the axes.
GRID = 5000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of grid cells (``bits`` bits a coordinate, at most 63 in all).

    The coordinates are turned into the transposed index by undoing, from the highest bit down, the reflections and
    exchanges of the curve; Gray decoding and interleaving give the key.
    """
    x = [c.copy() for c in cells.T.astype(np.int64)]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for i in range(n):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(up, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ turn) >> b & 1)
    return key


def _curve(c: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, c])
    axes = np.linalg.qr(rng.normal(size=(size, size)))[0][:, : min(DIMENSIONS, size)]
    return axes, rng.random(axes.shape[1])


def usable(vector: Column) -> Column:
    """Vectors with only finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate makes all vectors equally long, so that the largest product is the nearest point. Longer ones,
    which only ask here, are shortened: that changes no order of products."""
    squares = (v**2).sum(1)
    v = v * np.minimum(1, longest / np.sqrt(np.maximum(squares, 1e-300)))[:, None]
    return np.column_stack([v, np.sqrt(np.maximum(0, longest**2 - squares))])


def _grid(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and spread of each projected axis, by quartiles, which a few far rows do not move."""
    low, middle, high = np.quantile(v, [0.25, 0.5, 0.75], axis=0)
    return middle, np.maximum((high - low) / 1.349, 1e-300)


def _cells(v: np.ndarray, c: int, sample: np.ndarray) -> np.ndarray:
    """Grid cells of lifted vectors on curve ``c``; the axes are scaled by the lifted ``sample``."""
    axes, shift = _curve(c, v.shape[1])
    middle, spread = _grid(sample @ axes)
    at = (v @ axes - middle) / (8 * spread) + 0.5 + (shift - 0.5) / 8
    return np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def _ranked(vectors: DataFrame, samples: dict[int, np.ndarray], longest: float, curves: range) -> DataFrame:
    """``curve, rank, vec_id, embedding``: the place of each vector along each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lengths = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(1).flatten().to_numpy().astype(float)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                v = flat[starts[rows][:, None] + np.arange(size)]
                v = _lifted(v, longest)
                # A length that the sample lacks is rare.
                sample = _lifted(samples[size], longest) if size in samples else v
                for c in curves:
                    cells = _cells(v, c, sample)
                    keys = hilbert_keys(cells, BITS)
                    yield pa.record_batch(
                        [pa.array(np.full(len(rows), c, np.int32)), pa.array(keys), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))],
                        names=["curve", "key", "vec_id", "embedding"],
                    )

    keyed = vectors.mapInArrow(run, "curve int, key long, vec_id long, embedding array<double>")
    # A global place along each curve: sorted ranges, counted; the counts (one a range and curve) give the offsets.
    parts = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread_out = cut(keyed.repartitionByRange(int(parts), "curve", "key", "vec_id").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("curve", "part").orderBy("key", "vec_id")
    counts = spread_out.groupBy("curve", "part").agg(F.count("*").alias("n"))
    offset = counts.select("curve", "part", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return spread_out.withColumn("nth", F.row_number().over(within)).join(offset, ["curve", "part"]).select(
        "curve", (F.col("before") + F.col("nth") - 1).alias("rank"), "vec_id", "embedding"
    )


def _best(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, id, score`` of the ``k`` largest products of each query, ties to the smaller id."""
    take = min(len(candidates), k)
    fast = queries @ candidates.T
    # All within rounding error of the last place by the fast product; their scores are then taken pair by pair, always in one order.
    room = 4 * queries.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(candidates, axis=1).max()
    who, which = np.nonzero(fast >= (np.partition(fast, -take, axis=1)[:, -take] - room)[:, None])
    score = np.concatenate([np.einsum("ij,ij->i", queries[who[s : s + 65536]], candidates[which[s : s + 65536]]) for s in range(0, len(who), 65536)])
    order = np.lexsort((ids[which], -score, who))
    who, which, score = who[order], which[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < take
    return who[keep], ids[which[keep]], score[keep]


def _lists(both: DataFrame, k: int) -> DataFrame:
    """``q_rep, rep, score``: the best ``k`` of each group ``(curve, block)`` for each vector that asks there."""

    def run(t: pa.Table) -> pa.Table:
        asks, ids = t["asks"].to_numpy(), t["vec_id"].to_numpy()
        col = t["embedding"].combine_chunks()
        offsets = col.offsets.to_numpy()
        flat, sizes, found = col.values.to_numpy(), np.diff(offsets), [[], [], []]
        for size in np.unique(sizes):
            q, c = np.flatnonzero(asks & (sizes == size)), np.flatnonzero(~asks & (sizes == size))
            if not len(q) or not len(c):
                continue
            candidates = flat[offsets[c][:, None] + np.arange(size)]
            for s in range(0, len(q), 512):
                who, what, score = _best(flat[offsets[q[s : s + 512]][:, None] + np.arange(size)], candidates, ids[c], k)
                found[0].append(ids[q[s : s + 512]][who])
                found[1].append(what)
                found[2].append(score)
        if not found[0]:
            return pa.table({"q_rep": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table(dict(zip(("q_rep", "rep", "score"), map(np.concatenate, found))))

    return both.groupBy("curve", "block").applyInArrow(run, "q_rep long, rep long, score double")


def _along_curves(indexed: DataFrame, asking: DataFrame, samples: dict[int, np.ndarray], longest: float, curves: range, window: int) -> DataFrame:
    """Groups of one block and the vectors that ask in it or in an adjacent one."""
    placed = cut(_ranked(indexed, samples, longest, curves).withColumn("block", F.floor(F.col("rank") / window)))
    near = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1))
    asked = placed.join(asking.select("vec_id"), "vec_id", "left_semi").select("curve", near.alias("block"), F.lit(True).alias("asks"), "vec_id", "embedding")
    return asked.union(placed.select("curve", "block", F.lit(False), "vec_id", "embedding"))


def _all_pairs(indexed: DataFrame, n: int, asking: DataFrame, n_asking: int, window: int) -> DataFrame:
    """Groups in which every vector that asks meets every row once, each of about one window of either."""
    across, down = -(-n_asking // window) or 1, -(-n // (3 * window)) or 1
    part = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias
    asked = asking.select(part(across)("curve"), every(down)("block"), F.lit(True).alias("asks"), "vec_id", "embedding")
    return asked.union(indexed.select(every(across)("curve"), part(down)("block"), F.lit(False), "vec_id", "embedding"))


def _first(lists: DataFrame, k: int) -> DataFrame:
    merged = lists.groupBy("q_rep", "rep").agg(F.max("score").alias("score"))
    return merged.withColumn("nth", F.row_number().over(Window.partitionBy("q_rep").orderBy(F.desc("score"), "rep"))).where(F.col("nth") <= k).drop("nth")


def _recall(found: DataFrame, true: DataFrame) -> tuple[float, float]:
    """Mean share of the true entries that were found, over the sampled vectors, and its standard error."""
    per = true.join(found.select("q_rep", "rep", F.lit(1).alias("hit")), ["q_rep", "rep"], "left").groupBy("q_rep").agg((F.count("hit") / F.count("*")).alias("share"))
    r = per.agg(F.avg("share").alias("mean"), F.coalesce(F.stddev("share"), F.lit(0.0)).alias("dev"), F.count("*").alias("n")).first()
    return (1.0, 0.0) if not r["n"] else (r["mean"], r["dev"] / r["n"] ** 0.5)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, window: int = WINDOW, curves: int = CURVES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` largest inner products with other rows.

    Equal vectors are indexed once, with their ``k + 1`` smallest ids (no list needs more). Blocks of ``window``
    neighbours along each curve meet the queries of their own and both adjacent blocks. Blocks are cut by place, not by
    key, so dense regions fill no task. Each block keeps its best ``k + 1``; the blocks' lists are merged. After the first
    ``curves`` curves recall is measured: ``SAMPLE`` asking vectors (the smallest hashes) meet all rows. While it is not
    ``RECALL`` by two standard errors, as many further curves follow as the recall so far asks for; once a round would cost
    more products than comparing all, all are compared. So the work follows the number of rows. Ties go to the smaller id.
    Null, zero and non-finite vectors and null ids take no part; vectors of different lengths never meet; rows that repeat
    count once; an empty table gives none; other columns are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = cut(v.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct().withColumn("asks", is_query))
    different = cut(v.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.max("asks").alias("asks"), F.count("*").alias("n")))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    # One row whatever the input: the middle length, and how many there are.
    scale = different.agg(F.percentile_approx(squares, 0.5).alias("m"), F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    if scale["m"] is None:
        return v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    members = cut(v.join(different.select("embedding", "rep"), "embedding").select("rep", "vec_id", "asks"))
    indexed = different.select(F.col("rep").alias("vec_id"), "embedding")
    asking = different.where("asks").select(F.col("rep").alias("vec_id"), "embedding")
    n = scale["n"]
    # The longest, if over twice the middle length, meet every vector that asks; the lift is by the longest of the rest.
    long = cut(indexed.where(squares > 4 * scale["m"]).orderBy(F.desc(squares), "vec_id").limit(window))
    n_long = long.count()
    longest = (indexed.join(long.select("vec_id"), "vec_id", "left_anti").agg(F.max(squares)).first()[0] or scale["m"]) ** 0.5
    # A bounded sample scales the axes.
    bit = F.pmod(F.xxhash64("vec_id", F.lit("grid")), F.lit(1 << 30)) <= F.lit(int(min(1, GRID / n) * (1 << 30)))
    picked: dict[int, list] = {}
    for r in indexed.where(bit).orderBy("vec_id").select("embedding").toLocalIterator():
        picked.setdefault(len(r[0]), []).append(r[0])
    samples = {size: np.array(rows) for size, rows in picked.items()}
    sample = cut(asking.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE))
    true = cut(_first(_lists(_all_pairs(indexed, n, sample, SAMPLE, window), k + 1), k + 1).where("q_rep != rep"))
    top, done, more = None, 0, curves
    if n_long:
        top = cut(_first(_lists(_all_pairs(long, n_long, asking, scale["q"], window), k + 1), k + 1))
    while True:
        lists = _lists(_along_curves(indexed, asking, samples, longest, range(done, done + more), window), k + 1)
        top, done = cut(_first(lists.union(top) if top else lists, k + 1)), done + more
        recall, error = _recall(top, true)
        if recall - 2 * error >= RECALL:
            break
        # Each curve misses about the same share of the neighbours that the ones before it missed.
        missed, wanted = math.log(max(1 - recall, 1e-9)) / done, math.log((1 - RECALL) / 2)
        more = max(curves // 4, 1, min(2 * done, math.ceil(wanted / missed) - done if missed < 0 else done))
        if 3 * window * more >= n:
            top = cut(_first(_lists(_all_pairs(indexed, n, asking, scale["q"], window), k + 1), k + 1))
            break
    least = members.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("nth") <= k + 1).select("rep", "vec_id")
    # k + 1 entries are enough for every query that shares the vector, as it leaves out only itself.
    listed = top.join(least, "rep").withColumn("nth", F.row_number().over(Window.partitionBy("q_rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    queries = members.where("asks").select(F.col("rep").alias("q_rep"), F.col("vec_id").alias("query_id"))
    pairs = queries.join(listed.drop("nth"), "q_rep").where("query_id != vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
