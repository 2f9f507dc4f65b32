"""Queries on boxes inside frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as bx
from ..sources import projection as p
from .registry import query
from .rules import observations
from .views import with_views


def _dets(spark, sf):
    return p.detections(spark, sf, keypoints=False)


def _nms(source: str, name: str) -> str:
    return f"""
  {name}_r AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_seq, grp ORDER BY confidence DESC, det_idx) AS rk FROM {source}),
  {name}_s AS (
    SELECT DISTINCT camera_id, frame_seq, grp, CAST(0 AS BIGINT) AS rk, CAST(NULL AS BIGINT) AS det_idx,
      CAST([] AS STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept FROM {name}_r
    UNION ALL
    SELECT camera_id, frame_seq, grp, rk, CASE WHEN keep THEN d END,
      CASE WHEN keep THEN list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE kept END
    FROM (SELECT r.camera_id, r.frame_seq, r.grp, r.rk, r.det_idx AS d, r.x1, r.y1, r.x2, r.y2, s.kept,
        len(list_filter(s.kept, lambda k:
          greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1))
          / ((k.x2 - k.x1)*(k.y2 - k.y1) + (r.x2 - r.x1)*(r.y2 - r.y1)
             - greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1)) + 1e-6) > 0.5)) = 0 AS keep
      FROM {name}_s s JOIN {name}_r r ON r.camera_id = s.camera_id AND r.frame_seq = s.frame_seq AND r.grp = s.grp AND r.rk = s.rk + 1)),
  {name} AS (SELECT camera_id, frame_seq, grp, det_idx FROM {name}_s WHERE det_idx IS NOT NULL)"""


# Boxes pulled together per group of four frames, so that suppression has something to do.
@query(
    "nms",
    with_views(
        "det",
        "src AS (SELECT camera_id, frame_seq // 4 AS frame_seq, class_id AS grp, det_idx + 10*(frame_seq % 4) AS det_idx, confidence, x1, y1, x2, y2 FROM det),"
        + _nms("src", "nm")
        + "SELECT camera_id, frame_seq, grp AS class_id, det_idx FROM nm",
        True,
    ),
)
def nms(spark, sf):
    d = _dets(spark, sf).selectExpr(
        "camera_id", "frame_seq div 4 as frame_seq", "class_id", "det_idx + 10 * (frame_seq % 4) as det_idx", "confidence", "x1", "y1", "x2", "y2"
    )
    return bx.suppress(d).select("camera_id", "frame_seq", "class_id", "det_idx")


@query(
    "detections_merge",
    with_views(
        "sdet gtb",
        "src AS (SELECT camera_id, frame_seq, class_id AS grp, det_idx, confidence, x1, y1, x2, y2 FROM sdet UNION ALL "
        "SELECT camera_id, frame_seq, class_id, gt_idx + 1000000, 0.6::DOUBLE, x1, y1, x2, y2 FROM gtb),"
        + _nms("src", "nm")
        + "SELECT camera_id, frame_seq, grp AS class_id, det_idx FROM nm",
        True,
    ),
)
def detections_merge(spark, sf):
    cols = ["camera_id", "frame_seq", "class_id", "det_idx", "confidence", "x1", "y1", "x2", "y2"]
    a = p.scored_detections(spark, sf).select(*cols)
    b = p.gt_boxes(spark, sf).withColumnRenamed("gt_idx", "det_idx").withColumn("confidence", F.lit(0.6)).select(*cols)
    return bx.merge_sources([a, b]).select("camera_id", "frame_seq", "class_id", "det_idx")


def _motion(spark, sf):
    return _dets(spark, sf).selectExpr(
        "camera_id", "frame_seq", "det_idx as box_idx", "x1", "y1", "x2", "y2", "(x2 - x1) * (y2 - y1) as area"
    )


# A frame's boxes one by one: ``cur`` grows by the boxes of ``todo`` that are near, the others go to ``apart``; a pass that
# leaves as many boxes as it found ends it.
_B = "STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, area DOUBLE)"
_MERGED = f"""
  st AS (
    SELECT camera_id, frame_seq, CAST(NULL AS {_B}) AS cur, boxes AS todo, CAST([] AS {_B}[]) AS apart, CAST([] AS {_B}[]) AS out, len(boxes) AS n, false AS done
    FROM (SELECT camera_id, frame_seq, list(CAST({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'area': (x2 - x1) * (y2 - y1)}} AS {_B}) ORDER BY det_idx) AS boxes
      FROM det GROUP BY camera_id, frame_seq)
    UNION ALL
    SELECT camera_id, frame_seq,
      CASE WHEN cur IS NULL THEN b WHEN b IS NULL THEN NULL WHEN near THEN CAST({{'x1': least(cur.x1, b.x1), 'y1': least(cur.y1, b.y1),
        'x2': greatest(cur.x2, b.x2), 'y2': greatest(cur.y2, b.y2), 'area': cur.area + b.area}} AS {_B}) ELSE cur END,
      CASE WHEN b IS NOT NULL THEN todo[2:] WHEN cur IS NOT NULL THEN apart ELSE out END,
      CASE WHEN b IS NULL THEN CAST([] AS {_B}[]) WHEN cur IS NOT NULL AND NOT near THEN list_append(apart, b) ELSE apart END,
      CASE WHEN b IS NULL AND cur IS NOT NULL THEN list_append(out, cur) WHEN b IS NULL AND len(out) < n THEN CAST([] AS {_B}[]) ELSE out END,
      CASE WHEN b IS NULL AND cur IS NULL THEN len(out) ELSE n END, b IS NULL AND cur IS NULL AND len(out) = n
    FROM (SELECT *, cur.x1 - 50 <= b.x2 AND b.x1 - 50 <= cur.x2 AND cur.y1 - 50 <= b.y2 AND b.y1 - 50 <= cur.y2 AS near FROM (SELECT *, todo[1] AS b FROM st WHERE NOT done)))
  SELECT camera_id, frame_seq, i - 1 AS box_idx, out[i].x1 AS x1, out[i].y1 AS y1, out[i].x2 AS x2, out[i].y2 AS y2, out[i].area AS area
  FROM (SELECT *, unnest(range(1, len(out) + 1)) AS i FROM st WHERE done)"""


@query("boxes_merge", with_views("det", _MERGED, True))
def boxes_merge(spark, sf):
    return bx.merge_boxes(_motion(spark, sf), 50.0)


@query(
    "motion_extent",
    with_views(
        "det",
        """h AS (SELECT camera_id, frame_seq, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM det GROUP BY ALL),
        m AS (SELECT *, greatest(50, 100, CAST(floor(greatest(x2 - x1, y2 - y1) * 0.5) AS BIGINT)) AS m FROM h),
        w AS (SELECT camera_id, frame_seq, greatest(0, x1 - m) AS x1, greatest(0, y1 - m) AS y1, least(1280, x2 + m) AS x2, least(720, y2 + m) AS y2 FROM m)
        SELECT camera_id, frame_seq, CASE WHEN big THEN 0 ELSE x1 END AS x1, CASE WHEN big THEN 0 ELSE y1 END AS y1,
          CASE WHEN big THEN 1280 ELSE x2 END AS x2, CASE WHEN big THEN 720 ELSE y2 END AS y2
        FROM (SELECT *, (x2 - x1)*(y2 - y1) > 645120 AS big FROM w)""",
    ),
)
def motion_extent(spark, sf):
    return bx.motion_extent(_motion(spark, sf), p.WIDTH, p.HEIGHT)


@query(
    "unmatched_extra",
    with_views(
        "det",
        """SELECT e.camera_id, e.frame_seq, e.det_idx FROM det e WHERE e.track_id < 0 AND NOT EXISTS (SELECT 1 FROM det k
        WHERE k.camera_id = e.camera_id AND k.frame_seq = e.frame_seq AND k.track_id >= 0
          AND sqrt((k.cx - e.cx)*(k.cx - e.cx) + (k.cy - e.cy)*(k.cy - e.cy)) < 60)""",
    ),
)
def unmatched_extra(spark, sf):
    d = _dets(spark, sf)
    out = bx.unmatched_extra(d.where("track_id < 0"), d.where("track_id >= 0"))
    return out.select("camera_id", "frame_seq", "det_idx")


@query(
    "stationary_backfill",
    with_views(
        "det",
        """dd AS (SELECT * FROM det WHERE confidence >= 0.5), ru AS (SELECT * REPLACE (det_idx + 100 AS det_idx) FROM det WHERE track_id >= 0 AND confidence < 0.6)
        SELECT camera_id, frame_seq, track_id, det_idx FROM dd UNION ALL
        SELECT camera_id, frame_seq, track_id, det_idx FROM ru WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.camera_id = ru.camera_id
          AND dd.frame_seq = ru.frame_seq AND dd.track_id = ru.track_id)""",
    ),
)
def stationary_backfill(spark, sf):
    d = _dets(spark, sf)
    reused = d.where("track_id >= 0 and confidence < 0.6").withColumn("det_idx", F.col("det_idx") + 100)
    out = bx.backfill(d.where("confidence >= 0.5"), reused)
    return out.select("camera_id", "frame_seq", "track_id", "det_idx")


@query(
    "motion_overlap",
    with_views(
        "det",
        """SELECT d.camera_id, d.frame_seq, d.det_idx FROM det d WHERE d.track_id >= 0 AND EXISTS (SELECT 1 FROM det m
        WHERE m.camera_id = d.camera_id AND m.frame_seq = d.frame_seq AND m.track_id < 0
          AND d.x1 <= m.x2 AND m.x1 <= d.x2 AND d.y1 <= m.y2 AND m.y1 <= d.y2)""",
    ),
)
def motion_overlap(spark, sf):
    d = _dets(spark, sf)
    out = bx.overlapping_motion(d.where("track_id >= 0"), d.where("track_id < 0"))
    return out.select("camera_id", "frame_seq", "det_idx")


@query(
    "stationary_tracks",
    with_views(
        "tracked",
        """st AS (SELECT *, CASE WHEN sqrt((cx - px)*(cx - px) + (cy - py)*(cy - py)) < 24 AND frame_ms - pm <= 60000 THEN 0 ELSE 1 END AS brk
          FROM (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(frame_ms) OVER w AS pm FROM tracked
            WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_seq, det_idx))),
        g AS (SELECT *, sum(brk) OVER (PARTITION BY camera_id, track_id ORDER BY frame_seq, det_idx) AS g FROM st),
        r AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, g ORDER BY frame_seq, det_idx) - 1 AS still_frames FROM g)
        SELECT camera_id, track_id, frame_seq, still_frames, still_frames >= 3 AS is_stationary,
          still_frames >= 3 AND still_frames % 4 = 0 AS recheck FROM r""",
    ),
)
def stationary_tracks(spark, sf):
    out = bx.stationary(observations(spark, sf, roi=None), 24.0, 3, 4)
    return out.select("camera_id", "track_id", "frame_seq", "still_frames", "is_stationary", "recheck")


@query(
    "pose_merge",
    with_views(
        "det",
        """kp AS (SELECT camera_id, frame_seq, track_id, arg_max(pk % 10, det_idx) AS k FROM det
          WHERE class_id = 0 AND sk % 3 = 0 AND track_id >= 0 GROUP BY ALL)
        SELECT d.camera_id, d.frame_seq, d.det_idx, CASE WHEN d.class_id = 0 THEN k / 10.0::DOUBLE END AS nose_conf
        FROM det d LEFT JOIN kp USING (camera_id, frame_seq, track_id)""",
    ),
)
def pose_merge(spark, sf):
    full = p.detections(spark, sf)
    plain = full.withColumn("keypoints", F.when(F.lit(False), F.col("keypoints")))
    out = bx.attach_pose(plain, full.where("keypoints is not null"))
    return out.select("camera_id", "frame_seq", "det_idx", F.col("keypoints")[0]["conf"].alias("nose_conf"))
