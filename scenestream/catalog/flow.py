"""Crossing, flow, occupancy and frame-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import in_active_hours, sample_interval
from ..operators import flow
from ..operators import tripwire as tw
from ..schema import AREA_CLASSES
from ..sources import projection as p
from .registry import query
from .rules import observations, wire_dim
from .views import with_views

# Sides of the sample wire (200,300)-(1100,500) and the meeting test, in SQL.
_SIDE = "sign(900.0*({y} - 300.0) - 200.0*({x} - 200.0))"


def _meets(x1: str, y1: str, x2: str, y2: str) -> str:
    d1 = f"(900.0*({y1} - 300.0) - 200.0*({x1} - 200.0))"
    d2 = f"(900.0*({y2} - 300.0) - 200.0*({x2} - 200.0))"
    d3 = f"(({x2} - {x1})*(300.0 - {y1}) - ({y2} - {y1})*(200.0 - {x1}))"
    d4 = f"(({x2} - {x1})*(500.0 - {y1}) - ({y2} - {y1})*(1100.0 - {x1}))"
    on = "({x} BETWEEN 200 AND 1100 AND {y} BETWEEN 300 AND 500)"
    btw = "({px} BETWEEN least({x1}, {x2}) AND greatest({x1}, {x2}) AND {py} BETWEEN least({y1}, {y2}) AND greatest({y1}, {y2}))"
    a = btw.format(px="200.0", py="300.0", x1=x1, x2=x2, y1=y1, y2=y2)
    b = btw.format(px="1100.0", py="500.0", x1=x1, x2=x2, y1=y1, y2=y2)
    return (
        f"((({d1} > 0 AND {d2} < 0) OR ({d1} < 0 AND {d2} > 0)) AND (({d3} > 0 AND {d4} < 0) OR ({d3} < 0 AND {d4} > 0))"
        f" OR ({d1} = 0 AND {on.format(x=x1, y=y1)}) OR ({d2} = 0 AND {on.format(x=x2, y=y2)})"
        f" OR ({d3} = 0 AND {a}) OR ({d4} = 0 AND {b}))"
    )


def _sign(px: str, py: str, x: str, y: str, given: str = "true") -> str:
    return f"nullif(CASE WHEN {given} AND {px} IS NOT NULL AND {_meets(px, py, x, y)} THEN {_SIDE.format(x=x, y=y)} END, 0)"


_RECENT = "frame_ms - oms > 30 AND frame_ms - oms < 8000"
TRACKED_WIRE = f"""
  w0 AS (SELECT *, lag(frame_ms) OVER w AS pms, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(y2) OVER w AS py2
    FROM tracked WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_seq, det_idx)),
  w1 AS (SELECT * EXCLUDE (pcx, pcy, py2),
      CASE WHEN frame_ms - pms <= 10000 THEN pcx END AS pcx, CASE WHEN frame_ms - pms <= 10000 THEN pcy END AS pcy,
      CASE WHEN frame_ms - pms <= 10000 THEN py2 END AS py2,
      sum(CASE WHEN frame_ms - pms <= 10000 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id
        ORDER BY frame_seq, det_idx) AS life FROM w0),
  w2 AS (SELECT *, first(frame_ms) OVER h AS oms, first(cx) OVER h AS ocx, first(cy) OVER h AS ocy, first(y2) OVER h AS oy2
    FROM w1 WINDOW h AS (PARTITION BY camera_id, track_id, life ORDER BY frame_seq, det_idx
      ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  w3 AS (SELECT *, coalesce({_sign('pcx', 'py2', 'cx', 'y2')}, {_sign('pcx', 'pcy', 'cx', 'cy')},
      {_sign('ocx', 'oy2', 'cx', 'y2', _RECENT)}, {_sign('ocx', 'ocy', 'cx', 'cy', _RECENT)}) AS s FROM w2),
  tcross AS (SELECT camera_id, 'tw01' AS tripwire_id, track_id, frame_seq, frame_ms, det_idx, class_name,
      CASE WHEN s > 0 THEN 'in' ELSE 'out' END AS direction
    FROM w3 WHERE s IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY camera_id, track_id, life ORDER BY frame_seq, det_idx) = 1)"""

UNTRACKED_WIRE = f"""
  full_f AS (SELECT *, lag(frame_seq) OVER w AS from_seq, lag(frame_ms) OVER w AS from_ms FROM (
      SELECT camera_id, frame_seq, frame_ms, bool_or(track_id < 0) AS loose FROM obs GROUP BY ALL)
    WINDOW w AS (PARTITION BY camera_id ORDER BY frame_seq)),
  leftover AS (SELECT o.* FROM obs o JOIN full_f f USING (camera_id, frame_seq) WHERE (o.track_id < 0) = f.loose),
  pr AS (SELECT d.camera_id, d.frame_seq, d.frame_ms, d.det_idx, d.class_name, d.cx, d.y2, q.det_idx AS q_idx,
      q.cx AS qx, q.y2 AS qy, greatest(d.x2 - d.x1, d.y2 - d.y1, 1) AS size,
      sqrt((q.cx - d.cx)*(q.cx - d.cx) + (q.cy - d.cy)*(q.cy - d.cy)) AS shift,
      greatest(0, least(d.x2, q.x2) - greatest(d.x1, q.x1)) * greatest(0, least(d.y2, q.y2) - greatest(d.y1, q.y1)) AS ov,
      (d.x2 - d.x1)*(d.y2 - d.y1) + (q.x2 - q.x1)*(q.y2 - q.y1) AS areas
    FROM obs d JOIN full_f f ON d.camera_id = f.camera_id AND d.frame_seq = f.frame_seq AND f.frame_ms - f.from_ms < 3000
      JOIN leftover q ON q.camera_id = d.camera_id AND q.frame_seq = f.from_seq AND q.class_id = d.class_id
    WHERE d.track_id < 0),
  pri AS (SELECT *, CASE WHEN ov = 0 THEN 0 ELSE ov / (areas - ov) END AS iou FROM pr),
  best AS (SELECT * FROM pri QUALIFY row_number() OVER (PARTITION BY camera_id, frame_seq, det_idx ORDER BY
      CASE WHEN iou >= 0.01 THEN 0 WHEN shift < 3*size THEN 1 WHEN iou > 0 THEN 2 ELSE 3 END,
      CASE WHEN iou >= 0.01 THEN -iou WHEN shift < 3*size THEN shift ELSE -iou END, q_idx) = 1),
  flips AS (SELECT *, {_SIDE.format(x='cx', y='y2')} AS side, {_SIDE.format(x='qx', y='qy')} AS was FROM best
    WHERE iou > 0 OR shift < 3*size),
  firsts AS (SELECT camera_id, 'tw01' AS tripwire_id, class_name, frame_seq, frame_ms, det_idx,
      CASE WHEN side > 0 THEN 'in' ELSE 'out' END AS direction
    FROM flips WHERE side * was = -1 AND shift >= 0.05*size
    QUALIFY row_number() OVER (PARTITION BY camera_id, frame_seq, class_name ORDER BY det_idx) = 1),
  ucand AS (SELECT f.* FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM tcross t WHERE t.camera_id = f.camera_id
      AND t.class_name = f.class_name AND t.frame_ms <= f.frame_ms AND f.frame_ms < t.frame_ms + 2000)),
  ufire AS (
    SELECT camera_id, class_name, min(frame_ms) AS t FROM ucand GROUP BY ALL
    UNION ALL
    SELECT f.camera_id, f.class_name, (SELECT min(n.frame_ms) FROM ucand n WHERE n.camera_id = f.camera_id
      AND n.class_name = f.class_name AND n.frame_ms >= f.t + 800) FROM ufire f WHERE f.t IS NOT NULL),
  ucross AS (SELECT u.* FROM ucand u JOIN (SELECT DISTINCT * FROM ufire WHERE t IS NOT NULL) f
      ON u.camera_id = f.camera_id AND u.class_name = f.class_name AND u.frame_ms = f.t),
  crossed AS (SELECT camera_id, tripwire_id, track_id, frame_seq, frame_ms, det_idx, class_name, direction FROM tcross
    UNION ALL SELECT camera_id, tripwire_id, -1, frame_seq, frame_ms, det_idx, class_name, direction FROM ucross)"""

CROSSED = TRACKED_WIRE + "," + UNTRACKED_WIRE


def crossings(spark, sf):
    return tw.crossings(observations(spark, sf, roi=None), wire_dim(spark))


_COLS = ["camera_id", "tripwire_id", "track_id", "frame_seq", "frame_ms as ts_ms", "det_idx", "class_name", "direction"]
_SQL_COLS = "camera_id, tripwire_id, track_id, frame_seq, frame_ms AS ts_ms, det_idx, class_name, direction"


@query("rule_tripwire", with_views("tracked", TRACKED_WIRE + f"SELECT {_SQL_COLS} FROM tcross"))
def rule_tripwire(spark, sf):
    return tw.tracked_crossings(observations(spark, sf, roi=None), wire_dim(spark)).selectExpr(*_COLS)


@query(
    "rule_tripwire_untracked",
    with_views("tracked", CROSSED + f"SELECT {_SQL_COLS} FROM crossed WHERE track_id = -1", True),
)
def rule_tripwire_untracked(spark, sf):
    out = tw.untracked_crossings(observations(spark, sf, roi=None), wire_dim(spark))
    return out.withColumn("track_id", F.lit(-1)).selectExpr(*_COLS)


def _flow_sql(body: str) -> str:
    return with_views("tracked", CROSSED + body, True)


_IN_OUT = "count(*) FILTER (direction = 'in') AS total_in, count(*) FILTER (direction = 'out') AS total_out"


@query("flow_totals", _flow_sql(f"SELECT camera_id, class_name, {_IN_OUT} FROM crossed GROUP BY camera_id, class_name"))
def flow_totals(spark, sf):
    return flow.flow_totals(crossings(spark, sf), ["camera_id", "class_name"])


@query(
    "flow_by_day",
    _flow_sql(
        f"""SELECT camera_id, strftime(make_timestamp(frame_ms * 1000 + 28800000000), '%Y-%m-%d') AS day, {_IN_OUT}
        FROM crossed GROUP BY ALL"""
    ),
)
def flow_by_day(spark, sf):
    return flow.flow_by_day(crossings(spark, sf), "Asia/Shanghai")


_WIN = """
  , cw AS (SELECT camera_id, frame_ms // 60000 * 60000 AS window_start, count(*) FILTER (direction = 'in') AS window_in,
      count(*) FILTER (direction = 'out') AS window_out, count(*) FILTER (direction = 'in' AND class_name = 'person') AS person_in
    FROM crossed GROUP BY ALL)"""


@query(
    "flow_windows",
    _flow_sql(
        _WIN
        + """SELECT camera_id, window_start, window_start + 60000 AS window_end, window_in, window_out, person_in,
        CAST(sum(window_in) OVER w AS BIGINT) AS total_in, CAST(sum(window_out) OVER w AS BIGINT) AS total_out
        FROM cw WINDOW w AS (PARTITION BY camera_id ORDER BY window_start)"""
    ),
)
def flow_windows(spark, sf):
    w = flow.flow_windows(crossings(spark, sf))
    person_in = F.coalesce(F.try_element_at("by_class", F.lit("person"))["in"], F.lit(0))
    return w.select(
        "camera_id", "window_start", "window_end", "window_in", "window_out", person_in.alias("person_in"),
        "total_in", "total_out",
    )


@query(
    "flow_trailing",
    _flow_sql(
        """SELECT c.camera_id, c.track_id, c.frame_seq, c.det_idx, count(*) FILTER (p.direction = 'in') AS window_in,
        count(*) FILTER (p.direction = 'out') AS window_out
        FROM crossed c JOIN crossed p ON p.camera_id = c.camera_id AND p.frame_ms BETWEEN c.frame_ms - 20000 AND c.frame_ms
        GROUP BY ALL"""
    ),
)
def flow_trailing(spark, sf):
    t = flow.flow_trailing(crossings(spark, sf), 20, stretch_ms=60_000)
    return t.select("camera_id", "track_id", "frame_seq", "det_idx", "window_in", "window_out")


_INSIDE = "cx >= 300 AND cx < 1000 AND y2 >= 150 AND y2 < 550"
_AREA = (
    """area AS (SELECT f.camera_id, f.frame_seq, f.frame_ms, """
    + ", ".join(f"count(*) FILTER (d.class_name = '{c}' AND f.has_motion) AS {c}" for c in AREA_CLASSES)
    + f""", count(d.class_name) FILTER (f.has_motion) AS total
    FROM frames f LEFT JOIN (SELECT * FROM det WHERE track_id >= 0 AND {_INSIDE}) d USING (camera_id, frame_seq)
    GROUP BY ALL)"""
)
_AREA_COLS = "camera_id, frame_seq, frame_ms AS ts_ms, person, car, truck, motorcycle, bicycle, bus, total"


def _area(spark, sf):
    from ..functions.geometry import in_polygon

    d = p.detections(spark, sf, keypoints=False).selectExpr("*", "(x1 + x2) / 2 as cx")
    return flow.area_counts(d, p.frames(spark, sf), in_polygon("cx", "y2", p.ROI))


@query("area_counts", with_views("det frames", _AREA + f"SELECT {_AREA_COLS} FROM area"))
def area_counts(spark, sf):
    return _area(spark, sf).withColumnRenamed("frame_ms", "ts_ms")


@query(
    "area_snapshots",
    with_views(
        "det frames",
        _AREA
        + f"""SELECT {_AREA_COLS}, frame_ms // 60000 * 60000 AS window_start FROM area
        QUALIFY row_number() OVER (PARTITION BY camera_id, frame_ms // 60000 ORDER BY frame_ms) = 1""",
    ),
)
def area_snapshots(spark, sf):
    counts = _area(spark, sf)
    s = flow.area_snapshots(counts).withColumn("frame_seq", F.floor((F.col("frame_ms") - p.START_MS) / p.FRAME_MS))
    return s.withColumnRenamed("frame_ms", "ts_ms")


@query(
    "unique_tracks",
    with_views(
        "det",
        """SELECT class_name, count(*) AS tracks FROM (SELECT DISTINCT class_name, camera_id, track_id FROM det
        WHERE track_id >= 0) GROUP BY ROLLUP (class_name)""",
    ),
)
def unique_tracks(spark, sf):
    return flow.unique_tracks(p.detections(spark, sf, keypoints=False))


@query(
    "frame_throttle",
    with_views(
        "frames",
        """kept AS (
          SELECT camera_id, min(frame_ms) AS t FROM frames GROUP BY camera_id
          UNION ALL
          SELECT k.camera_id, (SELECT min(n.frame_ms) FROM frames n WHERE n.camera_id = k.camera_id
            AND n.frame_ms >= k.t + 667 AND n.frame_ms < k.t + 2000) FROM kept k WHERE k.t IS NOT NULL)
        SELECT f.camera_id, f.frame_seq, f.frame_ms AS ts_ms FROM frames f JOIN kept k
          ON f.camera_id = k.camera_id AND f.frame_ms = k.t""",
        True,
    ),
)
def frame_throttle(spark, sf):
    out = flow.throttle(p.frames(spark, sf), 1.5)
    return out.select("camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"))


@query(
    "frame_sample",
    with_views("frames", "SELECT camera_id, frame_seq FROM frames WHERE frame_seq % 6 = 0"),
)
def frame_sample(spark, sf):
    every = sample_interval(F.lit(29.97), F.lit(5.0))
    return flow.sample_frames(p.frames(spark, sf), every).select("camera_id", "frame_seq")


@query(
    "motion_gate",
    with_views("obs", "SELECT camera_id, frame_seq, det_idx, prev_seq FROM obs"),
)
def motion_gate(spark, sf):
    from ..operators.sequence import observe

    obs = observe(p.detections(spark, sf, keypoints=False), p.frames(spark, sf))
    return obs.select("camera_id", "frame_seq", "det_idx", "prev_seq")


@query(
    "active_hours",
    with_views(
        "alerts",
        """SELECT alert_id, ts_ms FROM (SELECT *, make_timestamp(ts_ms * 1000 + 28800000000) AS t FROM alerts)
        WHERE isodow(t) - 1 IN (0, 1, 2, 3, 4) AND (strftime(t, '%H:%M') >= '22:00' OR strftime(t, '%H:%M') <= '06:00')""",
    ),
)
def active_hours(spark, sf):
    a = p.alerts(spark, sf)
    night = in_active_hours(F.col("ts_ms"), "22:00", "06:00", [0, 1, 2, 3, 4], "Asia/Shanghai")
    return a.where(night).select("alert_id", "ts_ms")


@query(
    "camera_gaps",
    with_views(
        "alerts",
        """SELECT camera_id, last_ms, ts_ms AS next_ms, ts_ms - last_ms AS gap_ms FROM (SELECT *,
        lag(ts_ms) OVER (PARTITION BY camera_id ORDER BY ts_ms) AS last_ms FROM alerts) WHERE ts_ms - last_ms > 7200000""",
    ),
)
def camera_gaps(spark, sf):
    return flow.gaps(p.alerts(spark, sf), 7_200_000, time="ts_ms")


@query(
    "pipeline_perf",
    with_views(
        "frames",
        """SELECT camera_id, frame_ms // 60000 * 60000 AS window_start, round(count(*) / 60.0::DOUBLE, 1) AS fps,
        round(count(*) FILTER (has_motion) / 60.0::DOUBLE, 1) AS detection_fps,
        round(count(*) FILTER (NOT has_motion) * 100.0::DOUBLE / count(*), 1) AS skip_rate FROM frames GROUP BY ALL""",
    ),
)
def pipeline_perf(spark, sf):
    return flow.pipeline_perf(p.frames(spark, sf))


@query(
    "camera_overview",
    with_views(
        "tracked det frames alerts",
        CROSSED
        + ","
        + _AREA
        + f""", fl AS (SELECT camera_id, {_IN_OUT} FROM crossed GROUP BY camera_id),
        ar AS (SELECT camera_id, arg_max(total, frame_ms) AS area_total FROM area GROUP BY camera_id),
        al AS (SELECT camera_id, count(*) AS alert_count, max(ts_ms) AS last_ms FROM alerts GROUP BY camera_id)
        SELECT camera_id, coalesce(total_in, 0) AS total_in, coalesce(total_out, 0) AS total_out,
          coalesce(area_total, 0) AS area_total, coalesce(alert_count, 0) AS alert_count, last_ms
        FROM fl FULL JOIN ar USING (camera_id) FULL JOIN al USING (camera_id)""",
        True,
    ),
)
def camera_overview(spark, sf):
    return flow.camera_overview(crossings(spark, sf), _area(spark, sf), p.alerts(spark, sf))
