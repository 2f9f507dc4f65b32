"""Rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as r
from ..operators import sequence as q
from ..operators import tripwire as tw
from ..operators.neighbours import near_pairs
from ..sources import projection as p
from .registry import query
from .views import FALLEN, with_views


def observations(spark, sf, roi=p.ROI, keypoints=False):
    return r.watch(p.detections(spark, sf, keypoints=keypoints), p.frames(spark, sf), roi)


def wire_rows():
    w = p.WIRE
    return [(c, w["id"], w["id"], *w["p1"], *w["p2"], w["direction"], int(w["cooldown"] * 1000)) for c in p.CAMERAS]


def wire_dim(spark):
    return tw.wires(spark, wire_rows())


def cooldown_sql(source: str, keys: str, wait_ms: int, cols: str, time: str = "frame_ms") -> str:
    """SQL for the greedy spacing: from each kept row jump to the first row late enough."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"n.{k} = f.{k}" for k in ks)
    ksel = ", ".join(f"f.{k}" for k in ks)
    return f"""
      fired AS (
        SELECT {keys}, min({time}) AS t FROM {source} GROUP BY {keys}
        UNION ALL
        SELECT {ksel}, (SELECT min(n.{time}) FROM {source} n WHERE {same} AND n.{time} >= f.t + {wait_ms}) AS t
        FROM fired f WHERE f.t IS NOT NULL)
      SELECT {cols} FROM {source} s JOIN (SELECT DISTINCT * FROM fired WHERE t IS NOT NULL) f
        ON {" AND ".join(f"s.{k} = f.{k}" for k in ks)} AND s.{time} = f.t"""


BASIC = "s.camera_id, s.frame_seq, s.frame_ms AS ts_ms, s.track_id, s.class_name, s.confidence, s.x1, s.y1, s.x2, s.y2"


def basic(df, *more):
    return df.select(
        "camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "track_id", "class_name", "confidence",
        "x1", "y1", "x2", "y2", *more,
    )


_HITS2 = """
  inside AS (SELECT * FROM tracked WHERE in_roi),
  isl AS (SELECT *, fno - row_number() OVER (PARTITION BY camera_id, track_id ORDER BY fno) AS isl FROM inside),
  cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, isl ORDER BY fno) AS run
           FROM isl) WHERE run >= 2)"""


@query(
    "confirm_runs",
    with_views("tracked", _HITS2 + "SELECT camera_id, track_id, frame_seq, frame_ms AS ts_ms FROM cand"),
)
def confirm_runs(spark, sf):
    inside = observations(spark, sf).where("track_id >= 0 and in_roi")
    out = q.confirmed_unbroken(inside, r.TRACK, 2)
    return out.select("camera_id", "track_id", "frame_seq", F.col("frame_ms").alias("ts_ms"))


@query("rule_intrusion", with_views("tracked", _HITS2 + "," + cooldown_sql("cand", "camera_id, track_id", 1000, BASIC), True))
def rule_intrusion(spark, sf):
    return basic(r.intrusion(observations(spark, sf), confirm=2, cooldown_s=1.0))


@query(
    "cooldown",
    with_views(
        "alerts",
        cooldown_sql("alerts", "camera_id", 7_200_000, "s.camera_id, s.alert_id, s.ts_ms", "ts_ms"),
        True,
    ),
)
def cooldown(spark, sf):
    """Greedy spacing of all alerts of a camera, two hours apart."""
    a = p.alerts(spark, sf)
    return q.cooldown(a, ["camera_id"], 7_200_000, time="ts_ms", slice_width=86_400_000).select(
        "camera_id", "alert_id", "ts_ms"
    )


_PRESENT = "cand AS (SELECT * FROM tracked WHERE in_roi AND class_id IN (0,2,3,5,7) AND confidence >= 0.5)"
_LABEL = (
    "CASE s.class_id WHEN 0 THEN '人员' WHEN 1 THEN '自行车' WHEN 2 THEN '汽车' WHEN 3 THEN '摩托车' "
    "WHEN 5 THEN '公交车' WHEN 7 THEN '卡车' ELSE s.class_name END"
)


@query(
    "rule_presence",
    with_views("tracked", _PRESENT + "," + cooldown_sql("cand", "camera_id, track_id", 1000, BASIC + f", {_LABEL} AS sub_type"), True),
)
def rule_presence(spark, sf):
    out = r.presence(observations(spark, sf), cooldown_s=1.0)
    return basic(out, F.col("label").alias("sub_type"))


_SPELL = """
  spell AS (SELECT *, min(frame_ms) OVER (PARTITION BY camera_id, track_id, g) AS spell_ms FROM (
    SELECT *, fno - row_number() OVER (PARTITION BY camera_id, track_id ORDER BY fno) AS g
    FROM tracked WHERE in_roi))"""


@query(
    "visibility_spells",
    with_views(
        "tracked",
        _SPELL + "SELECT camera_id, track_id, frame_seq, frame_ms AS ts_ms, spell_ms, frame_ms - spell_ms AS dwell_ms FROM spell",
    ),
)
def visibility_spells(spark, sf):
    s = r.visibility_spells(observations(spark, sf))
    return s.select(
        "camera_id", "track_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "spell_ms",
        (F.col("frame_ms") - F.col("spell_ms")).alias("dwell_ms"),
    )


def _runs_sql(source: str, keys: str, n: int) -> str:
    """Candidates: the condition ``hit`` held on the last n observations of the key."""
    return f"""
      cand AS (SELECT * FROM (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY {keys} ORDER BY frame_seq, det_idx
        ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS held FROM {source}) WHERE held = {n})"""


@query(
    "rule_dwell",
    with_views(
        "tracked",
        _SPELL
        + ", judged AS (SELECT *, frame_ms - spell_ms AS dwell_ms, frame_ms - spell_ms >= 600 AS hit FROM spell),"
        + _runs_sql("judged", "camera_id, track_id", 2)
        + ","
        + cooldown_sql("cand", "camera_id, track_id", 2000, BASIC + ", round(s.dwell_ms / 1000.0, 1)::DOUBLE AS dwell_seconds"),
        True,
    ),
)
def rule_dwell(spark, sf):
    out = r.dwell(observations(spark, sf), max_seconds=0.6, confirm=2, cooldown_s=2.0)
    return basic(out, F.round(F.col("dwell_ms") / 1000.0, 1).alias("dwell_seconds"))


_STEPS = """
  st AS (SELECT *, frame_ms - pms AS dt_ms, cx - pcx AS dx, sqrt((cx - pcx)*(cx - pcx) + (cy - pcy)*(cy - pcy)) AS moved
    FROM (SELECT *, lag(frame_ms) OVER w AS pms, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy
          FROM tracked WHERE in_roi WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_seq, det_idx))
    WHERE pms IS NOT NULL)"""


@query(
    "track_speed",
    with_views(
        "tracked",
        _STEPS + """SELECT camera_id, track_id, frame_seq, dx, dt_ms, round(moved / (dt_ms / 1000.0::DOUBLE), 4) AS pixel_speed
        FROM st WHERE dt_ms > 0""",
    ),
)
def track_speed(spark, sf):
    s = r.track_speed(observations(spark, sf))
    return s.select("camera_id", "track_id", "frame_seq", "dx", "dt_ms", F.round("pixel_speed", 4).alias("pixel_speed"))


@query(
    "rule_wrong_way",
    with_views(
        "tracked",
        _STEPS
        + ", judged AS (SELECT *, dx < -5 AS hit FROM st),"
        + _runs_sql("judged", "camera_id, track_id", 3)
        + ","
        + cooldown_sql("cand", "camera_id, track_id", 1500, BASIC),
        True,
    ),
)
def rule_wrong_way(spark, sf):
    return basic(r.wrong_way(observations(spark, sf), confirm=3, cooldown_s=1.5))


@query(
    "rule_speed",
    with_views(
        "tracked",
        _STEPS
        + ", judged AS (SELECT *, moved / (dt_ms / 1000.0::DOUBLE) > 70 AS hit FROM st WHERE dt_ms > 0),"
        + _runs_sql("judged", "camera_id, track_id", 2)
        + ","
        + cooldown_sql("cand", "camera_id, track_id", 1500, BASIC + ", round(s.moved / (s.dt_ms / 1000.0::DOUBLE), 1) AS pixel_speed"),
        True,
    ),
)
def rule_speed(spark, sf):
    out = r.speed(observations(spark, sf), max_pixel_speed=70.0, confirm=2, cooldown_s=1.5)
    return basic(out, F.round("pixel_speed", 1).alias("pixel_speed"))


_PAIRS = """
  pairs AS (SELECT a.camera_id, a.frame_seq, a.frame_ms, a.track_id AS p_track, b.track_id AS v_track,
      b.class_name AS v_class, a.det_idx, b.det_idx AS v_idx,
      sqrt((a.cx - b.cx)*(a.cx - b.cx) + (a.y2 - b.y2)*(a.y2 - b.y2)) AS dist
    FROM tracked a JOIN tracked b USING (camera_id, frame_seq)
    WHERE a.in_roi AND b.in_roi AND a.class_name = 'person' AND b.class_name IN ('car','truck','bus','motorcycle','bicycle'))"""


@query(
    "proximity_pairs",
    with_views(
        "tracked",
        _PAIRS + "SELECT camera_id, frame_seq, p_track, v_track, v_class, round(dist, 4) AS dist FROM pairs WHERE dist < 120",
    ),
)
def proximity_pairs(spark, sf):
    out = r.proximity_pairs(observations(spark, sf), 120.0)
    return out.select("camera_id", "frame_seq", "p_track", "v_track", "v_class", F.round("dist", 4).alias("dist"))


def _proximity(n: int) -> str:
    return with_views(
        "tracked",
        _PAIRS
        + ", judged AS (SELECT *, dist < 120 AS hit FROM pairs),"
        + _runs_sql("judged", "camera_id, p_track, v_track", n)
        + ","
        + cooldown_sql(
            "cand", "camera_id, p_track, v_track", 1000,
            "s.camera_id, s.frame_seq, s.frame_ms AS ts_ms, s.p_track, s.v_track, s.v_class, round(s.dist, 1) AS distance",
        ),
        True,
    )


def _proximity_rows(out):
    return out.select(
        "camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "p_track", "v_track", "v_class",
        F.round("dist", 1).alias("distance"),
    )


@query("rule_proximity", _proximity(1))
def rule_proximity(spark, sf):
    return _proximity_rows(r.proximity(observations(spark, sf), 120.0, confirm=1, cooldown_s=1.0))


@query("rule_proximity_confirmed", _proximity(2))
def rule_proximity_confirmed(spark, sf):
    return _proximity_rows(r.proximity(observations(spark, sf), 120.0, confirm=2, cooldown_s=1.0))


@query(
    "crowd_density",
    with_views(
        "tracked",
        """per AS (SELECT * FROM tracked WHERE class_name = 'person')
        SELECT a.camera_id, a.frame_seq, a.det_idx, count(b.det_idx) AS others
        FROM per a LEFT JOIN per b ON a.camera_id = b.camera_id AND a.frame_seq = b.frame_seq AND a.det_idx <> b.det_idx
          AND sqrt((a.cx - b.cx)*(a.cx - b.cx) + (a.cy - b.cy)*(a.cy - b.cy)) < 400
        GROUP BY ALL""",
    ),
)
def crowd_density(spark, sf):
    persons = r._persons(observations(spark, sf, roi=None))
    return r.company(persons, 400.0).select("camera_id", "frame_seq", "det_idx", "others")


_SIGNS = """
  sg AS (SELECT *, ratio - pratio AS ratio_change, cy - pcy AS y_drop,
      CASE WHEN ratio > 1.3 THEN 'lying' WHEN pratio IS NOT NULL THEN 'drop' END AS sign
    FROM (SELECT *, CASE WHEN pseq = prev_seq THEN pr END AS pratio, CASE WHEN pseq = prev_seq THEN pc END AS pcy FROM (
      SELECT *, (x2 - x1) / (y2 - y1) AS ratio, lag(frame_seq) OVER w AS pseq,
        lag((x2 - x1) / (y2 - y1)) OVER w AS pr, lag(cy) OVER w AS pc
      FROM tracked WHERE class_name = 'person' AND in_roi
      WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_seq, det_idx)))),
  judged AS (SELECT *, CASE WHEN sign = 'drop' THEN ratio > 1.0 AND ratio_change > 0.5 AND y_drop > 20 ELSE true END AS hit
    FROM sg WHERE sign IS NOT NULL)"""


# With key points: a fallen pose is a sign of its own, before the shape of the box.
_POSED = _SIGNS.replace("CASE WHEN ratio > 1.3", f"CASE WHEN sk % 3 = 0 AND ({FALLEN}) THEN 'pose' WHEN ratio > 1.3")


def _fall_sql(confirm: int) -> str:
    held = _runs_sql("judged", "camera_id, track_id", confirm)
    return with_views("tracked", _POSED + "," + held + "," + cooldown_sql("cand", "camera_id, track_id", 1000, BASIC + ", s.sign"), True)


@query("rule_fall", _fall_sql(1))
def rule_fall(spark, sf):
    return basic(r.fall(observations(spark, sf, keypoints=True), confirm=1, cooldown_s=1.0), "sign")


@query("rule_fall_pose", _fall_sql(2))
def rule_fall_pose(spark, sf):
    """Confirmed over two observations in a row."""
    return basic(r.fall(observations(spark, sf, keypoints=True), confirm=2, cooldown_s=1.0), "sign")


def _first_in_frame_sql(wait_ms: int, cols: str) -> str:
    """Frames in order; in each the first hit whose track is not cooling down fires (confirmation 1)."""
    return f"""
  fr0 AS (SELECT camera_id, frame_seq, frame_ms, list({{'tr': track_id, 'd': det_idx}} ORDER BY det_idx) AS hits,
      count(*) AS n FROM judged WHERE hit GROUP BY camera_id, frame_seq, frame_ms),
  fr AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_seq) AS k FROM fr0),
  sc AS (
    SELECT DISTINCT camera_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(tr BIGINT, ms BIGINT)[]) AS live,
      CAST(NULL AS BIGINT) AS frame_seq, CAST(NULL AS BIGINT) AS d FROM fr
    UNION ALL
    SELECT camera_id, k, CASE WHEN h IS NULL THEN live ELSE list_append(live, {{'tr': h.tr, 'ms': frame_ms}}) END, frame_seq, h.d
    FROM (SELECT *, list_filter(hits, lambda x: NOT list_contains(list_transform(live, lambda y: y.tr), x.tr))[1] AS h
      FROM (SELECT f.camera_id, f.k, f.frame_seq, f.frame_ms, f.hits,
              list_filter(s.live, lambda x: f.frame_ms - x.ms < {wait_ms}) AS live
            FROM sc s JOIN fr f ON f.camera_id = s.camera_id AND f.k = s.k + 1)))
  SELECT {cols} FROM judged j JOIN sc ON sc.camera_id = j.camera_id AND sc.frame_seq = j.frame_seq AND sc.d = j.det_idx"""


_HEADS = """
  per AS (SELECT *, count(*) OVER (PARTITION BY camera_id, frame_seq) AS heads FROM tracked WHERE in_roi AND class_name = 'person')"""


@query(
    "rule_crowd",
    with_views(
        "tracked",
        _HEADS
        + """, near AS (SELECT a.camera_id, a.frame_seq, a.frame_ms, a.det_idx, a.track_id, count(b.det_idx) + 1 AS nearby
          FROM per a LEFT JOIN per b ON a.camera_id = b.camera_id AND a.frame_seq = b.frame_seq AND a.det_idx <> b.det_idx
            AND sqrt((a.cx - b.cx)*(a.cx - b.cx) + (a.cy - b.cy)*(a.cy - b.cy)) < 400
          WHERE a.heads > 1 GROUP BY ALL),
        judged AS (SELECT *, nearby > 1 AS hit FROM near),"""
        + _first_in_frame_sql(1000, "j.camera_id, j.frame_seq, j.frame_ms AS ts_ms, j.det_idx, j.track_id, j.nearby"),
        True,
    ),
)
def rule_crowd(spark, sf):
    out = r.crowd(observations(spark, sf), max_count=1, radius=400.0, confirm=1, cooldown_s=1.0)
    return out.select("camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "det_idx", "track_id", "nearby")


def _fight_rows(out):
    return out.select(
        "camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "det_idx", "track_id", "involved_count",
        F.round("avg_speed", 4).alias("avg_speed"), "has_pose",
    )


# Wrists of the sample's key points (points 9 and 10 of those that have any), and where they were last seen in the same visit.
_MOTION = """
  hand AS (SELECT *, fno - row_number() OVER (PARTITION BY camera_id, track_id ORDER BY fno) AS visit,
      CASE WHEN sk % 3 = 0 THEN list_filter([
        CASE WHEN ((pk + 9) % 10) / 10.0::DOUBLE > 0.3 THEN {'x': cx + hw / 2, 'y': CASE WHEN pk % 40 = 0 THEN y2 - 9 * h / 16 ELSE y1 + 9 * h / 16 END} END,
        CASE WHEN ((pk + 10) % 10) / 10.0::DOUBLE > 0.3 THEN {'x': cx - hw / 2, 'y': CASE WHEN pk % 40 = 0 THEN y2 - 10 * h / 16 ELSE y1 + 10 * h / 16 END} END
      ], lambda k: k IS NOT NULL) END AS seen FROM per),
  memo AS (SELECT *, last_value(CASE WHEN len(seen) > 0 THEN seen END IGNORE NULLS) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old,
      (frame_ms - lag(frame_ms) OVER v) / 1000.0::DOUBLE AS dt, cx - lag(cx) OVER v AS dx, cy - lag(cy) OVER v AS dy
    FROM hand WINDOW v AS (PARTITION BY camera_id, track_id, visit ORDER BY fno)),
  mv AS (SELECT *, coalesce(sqrt(dx * dx + dy * dy) / dt, 0) AS sp,
      coalesce(list_max(flatten(list_transform(seen, lambda a: list_transform(old, lambda b: sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))))) / dt, 0) AS limb
    FROM memo),
  near AS (SELECT a.camera_id, a.frame_seq, a.frame_ms, a.fno, a.det_idx, a.track_id, a.sp, a.limb, greatest(a.sp, a.limb * 0.6) AS top, count(b.det_idx) + 1 AS involved_count,
      coalesce(sum(b.sp), 0) AS others_sp, max(greatest(a.limb, coalesce(b.limb, 0))) > 0 AS has_pose
    FROM mv a LEFT JOIN mv b ON a.camera_id = b.camera_id AND a.frame_seq = b.frame_seq AND a.det_idx <> b.det_idx
      AND sqrt((a.cx - b.cx)*(a.cx - b.cx) + (a.cy - b.cy)*(a.cy - b.cy)) < 400
    WHERE a.heads >= 2 GROUP BY ALL),
  judged AS (SELECT *, involved_count >= 2 AND top > 80 AS hit FROM near),"""


def _confirmed_in_frame_sql(confirm: int, wait_ms: int, cols: str) -> str:
    """Persons of a camera one by one: runs by track, which a frame outside the set ends, and the first firing of each frame."""
    return f"""
  ordered AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_seq, det_idx) AS k FROM judged),
  sc AS (
    SELECT DISTINCT camera_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(tr BIGINT, n BIGINT)[]) AS runs,
      CAST([] AS STRUCT(tr BIGINT, ms BIGINT)[]) AS live, CAST(-1 AS BIGINT) AS done, CAST(-1 AS BIGINT) AS last, false AS fire FROM ordered
    UNION ALL
    SELECT camera_id, k,
      CASE WHEN skip THEN held WHEN hit THEN list_append(list_filter(held, lambda x: x.tr <> track_id), {{'tr': track_id, 'n': n}})
        ELSE list_filter(held, lambda x: x.tr <> track_id) END,
      CASE WHEN fires THEN list_append(live, {{'tr': track_id, 'ms': frame_ms}}) ELSE live END,
      CASE WHEN fires THEN frame_seq ELSE done END, fno, fires
    FROM (SELECT *, NOT skip AND hit AND n >= {confirm} AND NOT list_contains(list_transform(live, lambda y: y.tr), track_id) AS fires
      FROM (SELECT *, coalesce(list_filter(held, lambda x: x.tr = track_id)[1].n, 0) + 1 AS n
        FROM (SELECT o.camera_id, o.k, o.frame_seq, o.frame_ms, o.fno, o.track_id, o.hit, s.done, s.done = o.frame_seq AS skip,
            CASE WHEN o.fno > s.last + 1 THEN CAST([] AS STRUCT(tr BIGINT, n BIGINT)[]) ELSE s.runs END AS held,
            list_filter(s.live, lambda x: o.frame_ms - x.ms < {wait_ms}) AS live
          FROM sc s JOIN ordered o ON o.camera_id = s.camera_id AND o.k = s.k + 1))))
  SELECT {cols} FROM ordered j JOIN sc ON sc.camera_id = j.camera_id AND sc.k = j.k AND sc.fire"""


_FIGHT_COLS = (
    "j.camera_id, j.frame_seq, j.frame_ms AS ts_ms, j.det_idx, j.track_id, j.involved_count, "
    "round((j.sp + j.others_sp) / j.involved_count, 4) AS avg_speed, j.has_pose"
)


@query("rule_fight", with_views("tracked", _HEADS + "," + _MOTION + _first_in_frame_sql(1000, _FIGHT_COLS), True))
def rule_fight(spark, sf):
    return _fight_rows(r.fight(observations(spark, sf, keypoints=True), radius=400.0, min_speed=80.0, confirm=1, cooldown_s=1.0))


@query("rule_fight_pose", with_views("tracked", _HEADS + "," + _MOTION + _confirmed_in_frame_sql(2, 1000, _FIGHT_COLS), True))
def rule_fight_pose(spark, sf):
    """With key points and confirmation over two observations."""
    obs = observations(spark, sf, keypoints=True)
    return _fight_rows(r.fight(obs, radius=400.0, min_speed=80.0, confirm=2, cooldown_s=1.0))


_CROWDED = """, near AS (SELECT a.camera_id, a.frame_seq, a.frame_ms, a.fno, a.det_idx, a.track_id, count(b.det_idx) + 1 AS nearby
          FROM per a LEFT JOIN per b ON a.camera_id = b.camera_id AND a.frame_seq = b.frame_seq AND a.det_idx <> b.det_idx
            AND sqrt((a.cx - b.cx)*(a.cx - b.cx) + (a.cy - b.cy)*(a.cy - b.cy)) < 400
          WHERE a.heads > 1 GROUP BY ALL),
        judged AS (SELECT *, nearby > 1 AS hit FROM near),"""
_CROWD_COLS = "j.camera_id, j.frame_seq, j.frame_ms AS ts_ms, j.det_idx, j.track_id, j.nearby"


@query("rule_crowd_confirmed", with_views("tracked", _HEADS + _CROWDED + _confirmed_in_frame_sql(2, 60_000, _CROWD_COLS), True))
def rule_crowd_confirmed(spark, sf):
    """Two observations in a row and the default wait of a minute."""
    out = r.crowd(observations(spark, sf), max_count=1, radius=400.0, confirm=2, cooldown_s=60.0)
    return out.select("camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "det_idx", "track_id", "nearby")


def sample_cameras():
    from ..plans.ruleset import Camera

    w = p.WIRE
    on = {"enabled": True}
    rules = {
        "intrusion": {**on, "confirm_frames": 2, "cooldown": 1.0},
        "presence": {**on, "cooldown": 1.0, "min_confidence": 0.5},
        "dwell": {**on, "max_seconds": 0.6, "confirm_frames": 2, "cooldown": 2.0},
        "crowd": {**on, "max_count": 1, "radius": 400.0, "confirm_frames": 1, "cooldown": 1.0},
        "proximity": {**on, "min_distance": 120.0, "confirm_frames": 1, "cooldown": 1.0},
        "wrong_way": {**on, "expected_direction": "positive", "confirm_frames": 3, "cooldown": 1.5},
        "speed": {**on, "max_pixel_speed": 70.0, "confirm_frames": 2, "cooldown": 1.5},
        "fight": {**on, "proximity_radius": 400.0, "min_speed": 80.0, "min_persons": 2, "confirm_frames": 1, "cooldown": 1.0},
        "fall": {**on, "ratio_threshold": 1.0, "min_ratio_change": 0.5, "min_y_drop": 20.0, "confirm_frames": 1, "cooldown": 1.0},
    }
    allowed = ["intrusion", "tripwire", "anomaly/dwell", "anomaly/crowd", "anomaly/proximity", "anomaly/fight", "anomaly/fall"]
    return [Camera(c, rules, p.ROI, [w], allowed) for c in p.CAMERAS]


@query("rule_all")
def rule_all(spark, sf):
    from ..plans.ruleset import rule_set

    return rule_set(p.detections(spark, sf), p.frames(spark, sf), sample_cameras())


@query(
    "track_exits",
    with_views(
        "tracked",
        """SELECT t.camera_id, t.track_id, t.frame_seq FROM tracked t
        LEFT JOIN tracked n ON n.camera_id = t.camera_id AND n.track_id = t.track_id AND n.prev_seq = t.frame_seq
        WHERE n.track_id IS NULL AND EXISTS (SELECT 1 FROM proc q WHERE q.camera_id = t.camera_id AND q.prev_seq = t.frame_seq)""",
    ),
)
def track_exits(spark, sf):
    return r.track_exits(observations(spark, sf), p.frames(spark, sf)).select("camera_id", "track_id", "frame_seq")
