"""One-to-one greedy matching of boxes to truth boxes and of events to truth events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as g
from ..session import cut
from .neighbours import touching_pairs

THRESHOLDS = [0.5 + 0.05 * i for i in range(10)]


def iou_pairs(dets: DataFrame, truth: DataFrame, iou: float, by_class: bool = False) -> DataFrame:
    """Detection/truth pairs of an image with IoU of at least ``iou``: image_id, det_idx, gt_idx, iou, ...

    Both sides are clustered by image once, before their boxes are spread over grid cells; what follows per image stays there.
    """
    right = truth.select(
        "image_id",
        "gt_idx",
        F.col("class_id").alias("gt_class"),
        *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")],
    ).repartition("image_id")
    left = dets.select("image_id", "det_idx", "class_id", "confidence", "x1", "y1", "x2", "y2").repartition("image_id")
    pairs = touching_pairs(left, right, ["image_id"])
    if by_class:
        pairs = pairs.where("class_id = gt_class")
    return pairs.withColumn("iou", g.iou(g.box(), g.box("r_"))).where(F.col("iou") >= iou)


def greedy_boxes(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches (keys, det_idx, gt_idx, iou): surest detection first, each takes its best free truth.

    Earlier boxes win ties. Per key the fold sees only detections that overlap some truth.
    """
    options = pairs.groupBy(*keys, "det_idx", "confidence").agg(
        F.expr("sort_array(collect_list(struct(-iou as miss, gt_idx)))").alias("options")
    )
    image = options.groupBy(*keys).agg(
        F.expr("sort_array(collect_list(struct(-confidence as rank, det_idx, options)))").alias("dets")
    )
    pick = "get(filter(d.options, o -> not array_contains(a.used, o.gt_idx)), 0)"
    fold = (
        "aggregate(dets, named_struct('used', cast(array() as array<bigint>), 'out', "
        "cast(array() as array<struct<det_idx:bigint,gt_idx:bigint,iou:double>>)), (a, d) -> "
        f"if({pick} is null, a, named_struct('used', array_append(a.used, {pick}.gt_idx), 'out', "
        f"array_append(a.out, named_struct('det_idx', d.det_idx, 'gt_idx', {pick}.gt_idx, 'iou', -{pick}.miss))))).out"
    )
    return image.selectExpr(*keys, f"inline({fold})")


def match_boxes(dets: DataFrame, truth: DataFrame, iou: float = 0.5, by_class: bool = False) -> DataFrame:
    keys = ["image_id", "class_id"] if by_class else ["image_id"]
    return greedy_boxes(iou_pairs(dets, truth, iou, by_class), keys)


def match_levels(dets: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Class-aware matches at several IoU thresholds: image_id, class_id, det_idx, ``hits`` (a flag for each threshold).

    Overlaps are computed once and boxes are not repeated: an image's boxes are walked through once for each threshold.
    Detections that match at none of them may be left out.
    """
    keys = ["image_id", "class_id"]
    options = iou_pairs(dets, truth, min(thresholds), True).groupBy(*keys, "det_idx", "confidence").agg(
        F.expr("sort_array(collect_list(struct(-iou as miss, gt_idx)))").alias("options")
    )
    image = options.groupBy(*keys).agg(F.expr("sort_array(collect_list(struct(-confidence as rank, det_idx, options)))").alias("dets"))
    pick = "get(filter(d.options, o -> -o.miss >= l and not array_contains(a.used, o.gt_idx)), 0)"
    none = "cast(array() as array<bigint>)"
    fold = (
        f"aggregate(dets, named_struct('used', {none}, 'out', {none}), (a, d) -> if({pick} is null, a, "
        f"named_struct('used', array_append(a.used, {pick}.gt_idx), 'out', array_append(a.out, bigint(d.det_idx))))).out"
    )
    levels = ", ".join(f"{float(t)!r}D" for t in thresholds)
    matched = image.selectExpr(*keys, "dets", f"transform(array({levels}), l -> {fold}) as levels")
    return matched.selectExpr(
        *keys, "inline(transform(dets, d -> struct(d.det_idx, transform(levels, m -> array_contains(m, bigint(d.det_idx))) as hits)))"
    )


# --- events ---------------------------------------------------------------------------------------


def _reach(tolerance: float) -> tuple[Column, Column]:
    """Span of prediction times that may match a truth event."""
    lasting = F.col("t_start").isNotNull()
    lo = F.when(lasting, F.col("t_start")).otherwise(F.col("time_sec")) - tolerance
    hi = F.when(lasting, F.col("t_end")).otherwise(F.col("time_sec")) + tolerance
    return lo, hi


def event_candidates(pred: DataFrame, truth: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Prediction/truth pairs close in time: keys, pred_idx, gt_idx, t, dist.

    An instant matches within the tolerance; a duration matches when the prediction lies in it, widened
    by the tolerance, and the distance is that to its middle. The range join runs on time buckets whose width doubles from
    level to level: a truth lies in the three buckets at most of the level that fits its length, a prediction in one bucket of each
    level that occurs.
    """
    width = max(float(tolerance), 1e-3)
    lo, hi = _reach(tolerance)
    t = truth.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
    # The logarithm of nothing is NULL, which ``greatest`` passes over.
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("_hi") - F.col("_lo")) / width)).cast("int"))
    t = t.withColumn("_level", level)
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))
    t = t.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    mid = F.when(F.col("t_start").isNotNull(), (F.col("t_start") + F.col("t_end")) / 2).otherwise(F.col("time_sec"))
    t = t.select(*keys, "gt_idx", "_level", "_b", "_lo", "_hi", mid.alias("_mid"))
    # As many levels as the span of times has doublings.
    levels = sorted(r[0] for r in t.select("_level").distinct().collect())
    p = pred.select(*keys, "pred_idx", "t", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")).alias("_level"))
    p = p.withColumn("_b", F.floor(F.col("t") / size))
    return (
        p.join(t, [*keys, "_level", "_b"])
        .where((F.col("t") >= F.col("_lo")) & (F.col("t") <= F.col("_hi")))
        .select(*keys, "pred_idx", "gt_idx", "t", F.abs(F.col("t") - F.col("_mid")).alias("dist"))
    )


def mutually_first(pairs: DataFrame, keys: Sequence[str], left: str, right: str, cost: str) -> DataFrame:
    """Greedy one-to-one matches of ``pairs``: least ``cost`` first, then least ``left``, then least ``right``.

    A pair that comes first for both its sides is sure to match, whatever the others do. Each round keeps these and drops all
    pairs of a side that has one: two aggregations and two anti joins, so neither a key nor a stretch of time meets in one
    task. Rounds end when no pair is left, after as many as the longest run of ever closer pairs that share a side.
    """
    keys, sides = list(keys), [*keys, left, right, cost]
    order = F.min(F.struct(cost, left, right)).alias("b")
    left_over, found = cut(pairs.select(*sides)), []
    while not left_over.isEmpty():
        by_left = left_over.groupBy(*keys, left).agg(order).select(*keys, "b.*")
        by_right = left_over.groupBy(*keys, right).agg(order).select(*keys, "b.*")
        sure = cut(by_left.join(by_right, sides))
        found.append(sure)
        left_over = cut(left_over.join(sure.select(*keys, left), [*keys, left], "left_anti").join(sure.select(*keys, right), [*keys, right], "left_anti"))
    out = found[0] if found else left_over
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*sides)


# Width of the first stretches of time in reaches.
STRETCH = 8


def _closest_first(sides: Sequence[int], ids: Sequence[int], times: Sequence[float], lo: float, hi: float, reach: float) -> tuple[list, set[int]]:
    """Greedy matches (place of side 0, place of side 1, distance) of one stretch of time from ``lo`` to ``hi``, and the places left open.

    Among the free rows the closest two of different sides are neighbours in time, so only neighbours are compared. Left open is
    what a row outside, or another open row, may come first for.
    """
    spots: list[list] = []  # a time, and for each side its places by id
    for i in sorted(range(len(ids)), key=lambda i: (times[i], ids[i])):
        if not spots or spots[-1][0] != times[i]:
            spots.append([times[i], ([], [])])
        spots[-1][1][sides[i]].append(i)
    matches, queues = [], []
    for at, (a, b) in spots:
        n = min(len(a), len(b))
        matches += [(x, y, 0.0) for x, y in zip(a, b)]
        if len(a) != len(b):
            queues.append((at, int(len(b) > n), deque((a if len(a) > n else b)[n:])))
    ahead, behind = [*range(1, len(queues)), None], [None, *range(len(queues) - 1)]
    # For each end and side the nearest place at which a row may be that is not known to be free.
    walls, alive, heap = [[lo, lo], [hi, hi]], [True] * len(queues), []

    def offer(q: int | None) -> None:
        """Put the closest pair of a spot and the next one up, and its distance to an end."""
        if q is None:
            return
        at, side, places = queues[q]
        for end, beside in ((0, behind[q]), (1, ahead[q])):
            gap = abs(walls[end][1 - side] - at)
            if beside is None and gap <= reach:
                heappush(heap, (gap, -1, -1, q, end, places[0]))
        r = ahead[q]
        if r is not None and queues[r][1] != side:
            gap = abs(at - queues[r][0])
            if gap <= reach:
                x, y = (places[0], queues[r][2][0])[:: -1 if side else 1]
                heappush(heap, (gap, ids[x], ids[y], q, r, (x, y)))

    def unlink(q: int) -> None:
        alive[q], left, right = False, behind[q], ahead[q]
        if left is not None:
            ahead[left] = right
        if right is not None:
            behind[right] = left

    for q in range(len(queues)):
        offer(q)
    opened: set[int] = set()
    while heap:
        gap, first, _, q, r, what = heappop(heap)
        if not alive[q]:
            continue
        left, right = behind[q], ahead[q]
        if first == -1 and not isinstance(what, tuple):
            if (ahead if r else behind)[q] is None and what == queues[q][2][0]:
                at, side, places = queues[q]
                opened.update(places)
                unlink(q)
                walls[r][side] = at
                offer(left)
                offer(right)
            continue
        if right != r or what not in ((queues[q][2][0], queues[r][2][0]), (queues[r][2][0], queues[q][2][0])):
            continue
        matches.append((*what, gap))
        after = ahead[r]
        for spot in (q, r):
            queues[spot][2].popleft()
            if not queues[spot][2]:
                unlink(spot)
        for spot in {left, q, r, after}:
            if spot is not None and alive[spot]:
                offer(spot)
    return matches, opened


def _starts(rows: pd.DataFrame, by: list[str]) -> list[int]:
    return np.flatnonzero((rows[by] != rows[by].shift()).any(axis=1)).tolist()


def _whole_stretches(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows, dealt so that rows alike in ``by`` come together."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        same = not held or all(held[-1][c].iloc[-1] == rows[c].iloc[-1] for c in by)
        if same:
            held.append(rows)
            continue
        rows = pd.concat([*held, rows], ignore_index=True)
        last = _starts(rows, by)[-1]
        yield rows.iloc[:last].reset_index(drop=True)
        held = [rows.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _within_reach(events: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Greedy matches (keys, pred_idx, gt_idx, dist) of ``events`` (keys, side, idx, at) at most ``reach`` apart.

    Stretches of time are matched each by itself, up to where their ends could matter. What stays open near the ends is matched
    in the next pass, across the seams and in longer stretches, until nothing is open. No pair of rows is ever stored.
    """
    schema = StructType([*events.schema, *StructType.fromDDL("state int, mate bigint, dist double")])
    names, width, shift = schema.names, STRETCH * reach, 0.0
    found = []
    while True:

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in _whole_stretches(batches, [*keys, "_s"]):
                state, mate, dist = np.zeros(len(rows), "int32"), np.zeros(len(rows), "int64"), np.zeros(len(rows))
                sides, ids, times, s = (rows[c].to_numpy() for c in ("side", "idx", "at", "_s"))
                starts = _starts(rows, [*keys, "_s"])
                for a, b in zip(starts, [*starts[1:], len(rows)]):
                    lo = float(s[a]) * width - shift
                    own = ids[a:b].tolist()
                    matches, opened = _closest_first(sides[a:b].tolist(), own, times[a:b].tolist(), lo, lo + width, reach)
                    for x in opened:
                        state[a + x] = 1
                    for x, y, d in matches:
                        state[a + x], state[a + y], mate[a + x], dist[a + x] = 2, 3, own[y], d
                yield rows.assign(state=state, mate=mate, dist=dist)[names]

        sliced = events.withColumn("_s", F.floor((F.col("at") + shift) / width))
        done = cut(sliced.repartition(*keys, "_s").sortWithinPartitions(*keys, "_s").mapInPandas(fold, schema))
        found.append(done.where("state = 2").selectExpr(*keys, "idx as pred_idx", "mate as gt_idx", "dist"))
        events = done.where("state = 1").select(*events.columns)
        if events.isEmpty():
            return reduce(DataFrame.unionByName, found)
        # Two stretches that meet become one in the next pass: the ends never stay where they were.
        width, shift = 2 * width, 0.0 if shift else width


def match_events(pred: DataFrame, truth: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Greedy matches (keys, pred_idx, gt_idx, dist): closest pair first, one-to-one, earlier rows win ties.

    Every truth takes predictions up to some distance from its middle. Up to the least such distance the matches come from
    stretches of time without any pairs (``_within_reach``). Only what is free by then is paired, for truths that reach farther.
    """
    keys = list(keys)
    lo, hi = _reach(tolerance)
    mid = F.when(F.col("t_start").isNotNull(), (F.col("t_start") + F.col("t_end")) / 2).otherwise(F.col("time_sec"))
    p = pred.dropna(subset=[*keys, "t"])
    t = truth.dropna(subset=keys).where(lo <= hi)
    rows = p.select(*keys, F.lit(0).alias("side"), F.col("pred_idx").cast("bigint").alias("idx"), F.col("t").cast("double").alias("at")).unionByName(
        t.select(*keys, F.lit(1).alias("side"), F.col("gt_idx").cast("bigint").alias("idx"), mid.cast("double").alias("at"))
    )
    finite = "abs(at) < double('infinity')"
    bounds = t.agg(F.min((hi - lo) / 2).alias("reach")).join(rows.where(finite).agg(F.max(F.abs("at")).alias("far"))).first()
    # A span's ends are rounded; what lies that near to them is left to the pairs.
    reach = (bounds["reach"] or 0.0) - 1e-12 * (bounds["far"] or 0.0) - 1e-9
    if not 0 < reach < float("inf"):
        return mutually_first(event_candidates(pred, truth, keys, tolerance), keys, "pred_idx", "gt_idx", "dist")
    # An index that occurs twice in its key stands for one event at several times: its key is left to the pairs.
    twice = rows.groupBy(*keys, "side", "idx").count().where("count > 1").select(*keys).distinct()
    near = _within_reach(rows.where(finite).join(twice, keys, "left_anti"), keys, reach)
    taken = cut(near)
    left = event_candidates(
        pred.join(taken.select(*keys, "pred_idx"), [*keys, "pred_idx"], "left_anti"),
        truth.join(taken.select(*keys, "gt_idx"), [*keys, "gt_idx"], "left_anti"),
        keys, tolerance,
    )
    return taken.unionByName(mutually_first(left, keys, "pred_idx", "gt_idx", "dist"))
