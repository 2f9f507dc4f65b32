"""Boxes inside a frame: suppression, merging, overlap with motion, stationary objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import near_pairs, touching_pairs
from .rules import TRACK, tracked
from .sequence import ORDER, link_rows, running

FRAME = ["camera_id", "frame_seq"]


def suppress(dets: DataFrame, iou: float = 0.5, keys: Sequence[str] = ("camera_id", "frame_seq", "class_id")) -> DataFrame:
    """Non-maximum suppression: surest box first, drop boxes overlapping a kept one by more than ``iou``."""
    keys = list(keys)
    rest = [c for c in dets.columns if c not in keys]
    row = "struct(-confidence as rank, det_idx, x1, y1, x2, y2, struct({}) as row)".format(", ".join(rest))
    cover = (
        "greatest(0D, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0D, least(k.y2, b.y2) - greatest(k.y1, b.y1))"
    )
    union = f"((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {cover} + 1e-6D)"
    fold = (
        "aggregate(boxes, slice(boxes, 1, 0), (kept, b) -> "
        f"if(exists(kept, k -> {cover} / {union} > {float(iou)!r}D), kept, array_append(kept, b)))"
    )
    per = dets.groupBy(*keys).agg(F.expr(f"sort_array(collect_list({row}))").alias("boxes"))
    kept = per.selectExpr(*keys, f"explode({fold}) as k")
    return kept.select(*[F.col(c) if c in keys else F.col(f"k.row.{c}").alias(c) for c in dets.columns])


def merge_sources(sources: Sequence[DataFrame], iou: float = 0.5) -> DataFrame:
    """Detections of several passes over the same frames, duplicates suppressed per class.

    ``det_idx`` is renumbered so that boxes of an earlier source come first on equal confidence.
    """
    union = None
    for k, s in enumerate(sources):
        s = s.withColumn("det_idx", F.col("det_idx") + k * 1_000_000)
        union = s if union is None else union.unionByName(s)
    return suppress(union, iou)


BOX_TYPE = "struct<x1:double,y1:double,x2:double,y2:double,area:double>"


def _to_fixpoint(margin: float) -> str:
    """``boxes`` after each has grown by every later one within the margin, until nothing changes."""
    m = f"{float(margin)!r}D"
    near = f"h.hull.x1 - {m} <= b.x2 and b.x1 - {m} <= h.hull.x2 and h.hull.y1 - {m} <= b.y2 and b.y1 - {m} <= h.hull.y2"
    grown = (
        "named_struct('x1', least(h.hull.x1, b.x1), 'y1', least(h.hull.y1, b.y1), 'x2', greatest(h.hull.x2, b.x2), "
        "'y2', greatest(h.hull.y2, b.y2), 'area', h.hull.area + b.area)"
    )
    # The first box takes in what is near, in order, and grows as it does; the others stand apart.
    absorbed = (
        "aggregate(slice(a.rest, 2, size(a.rest)), named_struct('hull', get(a.rest, 0), 'apart', slice(a.rest, 1, 0)), (h, b) -> "
        f"if({near}, named_struct('hull', {grown}, 'apart', h.apart), named_struct('hull', h.hull, 'apart', array_append(h.apart, b))))"
    )
    once = (
        "aggregate(sequence(1, size(p.boxes)), named_struct('out', slice(p.boxes, 1, 0), 'rest', p.boxes), (a, k) -> if(size(a.rest) = 0, a, "
        f"get(transform(array({absorbed}), s -> named_struct('out', array_append(a.out, s.hull), 'rest', s.apart)), 0))).out"
    )
    return (
        "aggregate(sequence(1, size(boxes)), named_struct('boxes', boxes, 'done', false), (p, k) -> if(p.done, p, "
        f"get(transform(array({once}), o -> named_struct('boxes', o, 'done', size(o) = size(p.boxes))), 0))).boxes"
    )


def merge_boxes(motion: DataFrame, margin: float = 50.0, order: str = "box_idx") -> DataFrame:
    """Merge motion boxes of a frame that lie within ``margin`` of each other.

    Input: camera_id, frame_seq, box_idx, x1..y2, area. The boxes of a frame are one row.
    """
    sides = ", ".join(f"'{c}', double({c})" for c in ("x1", "y1", "x2", "y2", "area"))
    listed = f"transform(sort_array(collect_list(struct({order} as i, named_struct({sides}) as box))), x -> x.box)"
    per = motion.groupBy(*FRAME).agg(F.expr(f"cast({listed} as array<{BOX_TYPE}>)").alias("boxes"))
    merged = per.selectExpr(*FRAME, f"posexplode({_to_fixpoint(margin)}) as (box_idx, box)")
    return merged.selectExpr(*FRAME, "bigint(box_idx) as box_idx", "box.*")


def motion_extent(motion: DataFrame, width: int, height: int, margin: int = 50) -> DataFrame:
    """Region of a frame worth analysing: hull of its motion, widened; the whole frame above 70 % of it."""
    hull = motion.groupBy(*FRAME).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    wide = hull.selectExpr(
        "*", f"greatest({margin}, 100, cast(floor(greatest(x2 - x1, y2 - y1) * 0.5D) as bigint)) as m"
    ).selectExpr(
        *FRAME,
        "greatest(0D, x1 - m) as x1",
        "greatest(0D, y1 - m) as y1",
        f"least({float(width)!r}D, x2 + m) as x2",
        f"least({float(height)!r}D, y2 + m) as y2",
    )
    full = f"(x2 - x1) * (y2 - y1) > {0.7 * width * height!r}D"
    return wide.selectExpr(
        *FRAME,
        f"if({full}, 0D, x1) as x1",
        f"if({full}, 0D, y1) as y1",
        f"if({full}, {float(width)!r}D, x2) as x2",
        f"if({full}, {float(height)!r}D, y2) as y2",
    )


def unmatched_extra(extra: DataFrame, known: DataFrame, radius: float = 60.0) -> DataFrame:
    """Extra boxes whose centre is at least ``radius`` from the centre of every tracked box of the frame."""
    e = extra.selectExpr(*FRAME, "det_idx", "(x1 + x2) / 2 as _ex", "(y1 + y2) / 2 as _ey")
    k = known.selectExpr(*FRAME, "(x1 + x2) / 2 as _kx", "(y1 + y2) / 2 as _ky")
    seen = near_pairs(e, k, FRAME, radius, ("_ex", "_ey"), ("_kx", "_ky")).select(*FRAME, "det_idx").distinct()
    return extra.join(seen, [*FRAME, "det_idx"], "left_anti")


def backfill(detected: DataFrame, reused: DataFrame) -> DataFrame:
    """Detections plus reused ones whose track was not detected in the frame."""
    have = detected.where("track_id >= 0").select(*FRAME, "track_id").distinct()
    return detected.unionByName(reused.join(have, [*FRAME, "track_id"], "left_anti"))


def overlapping_motion(dets: DataFrame, motion: DataFrame) -> DataFrame:
    """Detections that touch any motion box of their frame."""
    right = motion.selectExpr(*FRAME, "x1 as r_x1", "y1 as r_y1", "x2 as r_x2", "y2 as r_y2")
    hit = touching_pairs(dets.select(*FRAME, "det_idx", "x1", "y1", "x2", "y2"), right, FRAME)
    return dets.join(hit.select(*FRAME, "det_idx").distinct(), [*FRAME, "det_idx"], "left_semi")


def stationary(
    obs: DataFrame, threshold: float = 20.0, frames: int = 15, recheck: int = 30, expire_s: float = 60.0
) -> DataFrame:
    """Tracked observations with their run of still steps, whether they are stationary, and when to recheck.

    A step shorter than ``threshold`` px is still; ``frames`` still steps in a row make an object
    stationary. A track unseen for longer than ``expire_s`` starts anew.
    """
    limit = int(expire_s * 1000)

    def still(prev, cur):
        dx, dy = cur["cx"] - prev["cx"], cur["cy"] - prev["cy"]
        return (F.sqrt(dx * dx + dy * dy) < threshold) & (cur["frame_ms"] - prev["frame_ms"] <= limit)

    t = link_rows(tracked(obs), TRACK, ORDER, ["cx", "cy", "frame_ms"], still)
    counted = running(t, [*TRACK, "spell_ms"], ORDER, {"still_frames": F.lit(1).cast("bigint")})
    run = F.col("still_frames") - 1
    return counted.drop("prev", "linked").withColumns(
        {
            "still_frames": run,
            "is_stationary": run >= frames,
            "recheck": (run >= frames) & (run % recheck == 0),
        }
    )


def attach_pose(dets: DataFrame, poses: DataFrame) -> DataFrame:
    """Key points of a pose pass onto person detections, by track; the last pose row of a track wins."""
    last = poses.where("track_id >= 0").groupBy(*FRAME, "track_id").agg(F.max_by("keypoints", "det_idx").alias("_kp"))
    person = F.col("class_name") == "person"
    return (
        dets.join(last, [*FRAME, "track_id"], "left")
        .withColumn("keypoints", F.when(person & F.col("_kp").isNotNull(), F.col("_kp")).otherwise(F.col("keypoints")))
        .drop("_kp")
    )
