"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels, pose
from ..sources import projection as p
from .flow import _SIDE, _meets
from .registry import query
from .views import FALLEN, with_views


def _dets(spark, sf, keypoints=False):
    return p.detections(spark, sf, keypoints=keypoints).selectExpr("*", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy")


@query(
    "points_in_roi",
    with_views(
        "det",
        """SELECT camera_id, frame_seq, det_idx, cx AS foot_x, y2 AS foot_y,
        cx >= 300 AND cx < 1000 AND y2 >= 150 AND y2 < 550 AS inside FROM det""",
    ),
)
def points_in_roi(spark, sf):
    d = _dets(spark, sf)
    fx, fy = g.foot(g.box())
    polygon = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p.ROI])
    inside = g.in_polygon_column((F.col("foot_x"), F.col("foot_y")), polygon)
    return d.withColumns({"foot_x": fx, "foot_y": fy}).select("camera_id", "frame_seq", "det_idx", "foot_x", "foot_y", inside.alias("inside"))


@query(
    "segment_hits",
    with_views(
        "det",
        f"""SELECT camera_id, frame_seq, det_idx, {_meets('x1', 'y1', 'x2', 'y2')} AS meets,
        CAST({_SIDE.format(x='x2', y='y2')} AS INT) AS side,
        CASE WHEN {_meets('x1', 'y1', 'x2', 'y2')} AND {_SIDE.format(x='x2', y='y2')} <> 0
          THEN CASE WHEN {_SIDE.format(x='x2', y='y2')} > 0 THEN 'in' ELSE 'out' END END AS direction FROM det""",
    ),
)
def segment_hits(spark, sf):
    d = _dets(spark, sf)
    a, b = g.lit_point(p.WIRE["p1"]), g.lit_point(p.WIRE["p2"])
    start, end = (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))
    sign = g.crossing_sign(start, end, a, b)
    return d.select(
        "camera_id", "frame_seq", "det_idx", g.segments_meet(start, end, a, b).alias("meets"),
        g.side_of_line(end, a, b).alias("side"), g.crossing_direction(sign, F.lit("left_to_right")).alias("direction"),
    )


@query(
    "boxes_rescale",
    with_views(
        "det",
        """SELECT camera_id, frame_seq, det_idx, x1*1.5 + 40 AS x1, y1*1.5 + 20 AS y1, x2*1.5 + 40 AS x2, y2*1.5 + 20 AS y2,
        round((x2 - x1)/(y2 - y1), 6) AS ratio FROM det""",
    ),
)
def boxes_rescale(spark, sf):
    d = _dets(spark, sf)
    moved = g.shift_and_scale(g.box(), F.lit(40.0), F.lit(20.0), 1.5)
    return d.select(
        "camera_id", "frame_seq", "det_idx", *[c.alias(n) for c, n in zip(moved, ("x1", "y1", "x2", "y2"))],
        F.round(g.aspect_ratio(g.box()), 6).alias("ratio"),
    )


@query(
    "pose_fallen",
    with_views("det", f"SELECT camera_id, frame_seq, det_idx, {FALLEN} AS fallen FROM det WHERE class_id = 0 AND sk % 3 = 0"),
)
def pose_fallen(spark, sf):
    d = _dets(spark, sf, keypoints=True).where("keypoints is not null")
    return d.select("camera_id", "frame_seq", "det_idx", pose.is_fallen(F.col("keypoints")).alias("fallen"))


# --- label lines ------------------------------------------------------------------------------------

_NORM = "(x1 + x2) / 2.0 / 1280 AS nx, (y1 + y2) / 2.0 / 720 AS ny, (x2 - x1) / 1280 AS nw, (y2 - y1) / 720 AS nh"


@query(
    "labels_render",
    with_views(
        "det frames",
        f"""ln AS (SELECT camera_id, frame_seq, det_idx, '# conf=' || printf('%.2f', confidence) || ' ' || class_name AS c,
          class_id || ' ' || printf('%.6f', nx) || ' ' || printf('%.6f', ny) || ' ' ||
          printf('%.6f', nw) || ' ' || printf('%.6f', nh) AS l
          FROM (SELECT *, {_NORM} FROM det))
        SELECT f.camera_id, f.frame_seq, coalesce(string_agg(c || chr(10) || l, chr(10) ORDER BY det_idx), '# no detections') AS body
        FROM frames f LEFT JOIN ln USING (camera_id, frame_seq) GROUP BY ALL""",
    ),
)
def labels_render(spark, sf):
    from ..sources.labels import label_files

    return label_files(_dets(spark, sf), p.frames(spark, sf), p.WIDTH, p.HEIGHT)


_LINE = "CASE WHEN pk % 17 = 0 THEN '# note' WHEN pk % 13 = 0 THEN '0 0.5 oops 0.1 0.1' WHEN pk % 11 = 0 THEN '1 0.5 0.5 0.2' " \
    "WHEN pk % 19 = 0 THEN '   ' ELSE '  ' || class_id || ' ' || (pk % 8) / 8.0::DOUBLE || '  ' || (sk % 16) / 16.0::DOUBLE || ' 0.125 0.25' END"


def _lines(spark, sf):
    base = p._boxes(spark, sf)
    line = (
        "case when pk % 17 = 0 then '# note' when pk % 13 = 0 then '0 0.5 oops 0.1 0.1' when pk % 11 = 0 then '1 0.5 0.5 0.2' "
        "when pk % 19 = 0 then '   ' else concat('  ', class_id, ' ', (pk % 8) / 8.0D, '  ', (sk % 16) / 16.0D, ' 0.125 0.25') end"
    )
    return base.selectExpr(f"{p._IMAGE} as image_id", "ln as line_no", f"{line} as line")


_PARSED = f"""raw AS (SELECT 'cam' || (ok % 4) || '_' || fs AS image_id, ln AS line_no, pk, sk, class_id, {_LINE} AS line FROM boxed)"""


@query(
    "labels_parse",
    with_views(
        "boxed",
        _PARSED
        + """SELECT image_id, line_no, CASE WHEN pk % 13 = 0 OR pk % 11 = 0 THEN 'bad' ELSE 'ok' END AS state,
        CASE WHEN NOT (pk % 13 = 0 OR pk % 11 = 0) THEN ((pk % 8) / 8.0 - 0.0625)*1280 END::DOUBLE AS x1,
        CASE WHEN NOT (pk % 13 = 0 OR pk % 11 = 0) THEN ((sk % 16) / 16.0 + 0.125)*720 END::DOUBLE AS y2
        FROM raw WHERE pk % 17 <> 0 AND (pk % 13 = 0 OR pk % 11 = 0 OR pk % 19 <> 0)""",
    ),
)
def labels_parse(spark, sf):
    rows = _lines(spark, sf).where(labels.is_label_text(F.col("line"))).withColumn("v", labels.parse_line(F.col("line")))
    x1, _, _, y2 = labels.to_pixels(F.col("v"), F.lit(1280.0), F.lit(720.0))
    return rows.select(
        "image_id", "line_no", F.when(F.col("v").isNull(), "bad").otherwise("ok").alias("state"), x1.alias("x1"), y2.alias("y2")
    )


@query(
    "labels_scan",
    with_views(
        "boxed frames",
        _PARSED
        + """SELECT 'cam' || (o_orderkey % 4) || '_' || (o_orderkey // 4) AS image_id,
          count(r.line_no) FILTER (pk % 17 <> 0 AND pk % 13 <> 0 AND pk % 11 <> 0 AND pk % 19 <> 0) AS boxes,
          count(r.line_no) FILTER (pk % 17 <> 0 AND (pk % 13 = 0 OR pk % 11 = 0)) AS bad_lines, count(r.line_no) = 0 AS skipped
        FROM orders o LEFT JOIN raw r ON r.image_id = 'cam' || (o_orderkey % 4) || '_' || (o_orderkey // 4) GROUP BY 1""",
    ),
)
def labels_scan(spark, sf):
    from ..sources.labels import scan_summary

    images = p.frames(spark, sf).selectExpr("concat(camera_id, '_', frame_seq) as image_id", "1280 as width", "720 as height")
    return scan_summary(_lines(spark, sf), images)


@query(
    "labels_roundtrip",
    with_views("det", "SELECT camera_id, frame_seq, det_idx, class_id, round(x1, 2) AS x1, round(y1, 2) AS y1, round(x2, 2) AS x2, round(y2, 2) AS y2 FROM det"),
)
def labels_roundtrip(spark, sf):
    d = _dets(spark, sf)
    w, h = F.lit(float(p.WIDTH)), F.lit(float(p.HEIGHT))
    line = labels.render_line(F.col("class_id"), *labels.to_normalised(g.box(), w, h))
    v = d.select("camera_id", "frame_seq", "det_idx", labels.parse_line(line).alias("v"))
    px = labels.to_pixels(F.col("v"), w, h)
    # Six digits of a normalised value are 0.001 px; the sample boxes lie on half pixels.
    return v.select(
        "camera_id", "frame_seq", "det_idx", F.col("v.class_id").alias("class_id"),
        *[(F.round(c * 2) / 2).alias(n) for c, n in zip(px, ("x1", "y1", "x2", "y2"))],
    )
