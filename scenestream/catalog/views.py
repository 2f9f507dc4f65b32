"""SQL forms of the projected tables, as named common table expressions."""

from __future__ import annotations

_KIND = (
    "CASE event_type WHEN 'click' THEN 'presence' WHEN 'view' THEN 'tripwire' "
    "WHEN 'error' THEN 'intrusion' ELSE 'anomaly' END"
)
_SUB = (
    "CASE event_type WHEN 'purchase' THEN 'dwell' WHEN 'signup' THEN 'crowd' "
    "WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END ELSE '' END"
)
_WIRE = "CASE WHEN event_type = 'view' THEN 'tw' || (event_id % 3) END"
_MS = "(epoch_us(ts) // 1000)"

_VIEWS = {
    "items": (
        [],
        """SELECT l_orderkey AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ln,
           l_partkey AS pk, l_suppkey AS sk, l_orderkey // 4 AS fs FROM lineitem""",
    ),
    "boxed": (
        ["items"],
        """SELECT *, cx - hw AS x1, cx + hw AS x2, y2 - h AS y1 FROM (
             SELECT *,
               CAST(abs((fs*14 + ln*173 + (ok % 4)*311) % 2560 - 1280) AS DOUBLE) AS cx,
               120.0 + CAST(abs((fs*9 + ln*97) % 1160 - 580) AS DOUBLE) AS y2,
               CAST(CASE WHEN pk % 40 = 0 THEN 45 ELSE 18 + pk % 5 END AS DOUBLE) AS hw,
               CAST(CASE WHEN pk % 40 = 0 THEN 40 ELSE 80 + sk % 10 END AS DOUBLE) AS h,
               CASE WHEN ln <= 3 THEN 0 WHEN ln IN (4, 6) THEN 2 WHEN ln = 5 THEN 7 ELSE 3 END AS class_id
             FROM items)""",
    ),
    "det": (
        ["boxed"],
        """SELECT 'cam' || (ok % 4) AS camera_id, fs AS frame_seq, 1704067200000 + fs*200 AS frame_ms,
             ln AS det_idx, CASE WHEN ln >= 6 THEN -1 ELSE ln + 10*(fs // 50) END AS track_id,
             class_id,
             CASE class_id WHEN 0 THEN 'person' WHEN 2 THEN 'car' WHEN 7 THEN 'truck' ELSE 'motorcycle' END
               AS class_name,
             (25 + pk % 75) / 100.0::DOUBLE AS confidence, x1, y1, x2, y2, cx, (y1 + y2) / 2 AS cy, pk, sk, hw, h
           FROM boxed""",
    ),
    "frames": (
        [],
        """SELECT 'cam' || (o_orderkey % 4) AS camera_id, o_orderkey // 4 AS frame_seq,
             1704067200000 + (o_orderkey // 4)*200 AS frame_ms, o_custkey % 10 <> 0 AS has_motion
           FROM orders""",
    ),
    # Frames the rules see, with the one before and a running number per camera.
    "proc": (
        ["frames"],
        """SELECT camera_id, frame_seq, frame_ms,
             lag(frame_seq) OVER (PARTITION BY camera_id ORDER BY frame_seq) AS prev_seq,
             row_number() OVER (PARTITION BY camera_id ORDER BY frame_seq) AS fno
           FROM frames WHERE has_motion""",
    ),
    # Detections on frames the rules see.
    "obs": (
        ["det", "proc"],
        """SELECT d.*, p.prev_seq, p.fno,
             d.cx >= 300 AND d.cx < 1000 AND d.y2 >= 150 AND d.y2 < 550 AS in_roi
           FROM det d JOIN proc p USING (camera_id, frame_seq)""",
    ),
    "tracked": (["obs"], "SELECT * FROM obs WHERE track_id >= 0"),
    "gtb": (
        ["boxed"],
        """SELECT 'cam' || (ok % 4) || '_' || fs AS image_id, 'cam' || (ok % 4) AS camera_id, fs AS frame_seq,
             ln AS gt_idx, CASE WHEN pk % 31 = 0 THEN 7 ELSE class_id END AS class_id,
             x1 + (sk % 7 - 3)*3 + CASE WHEN pk % 8 = 0 THEN 4000 ELSE 0 END AS x1, y1,
             x2 + (sk % 7 - 3)*3 + CASE WHEN pk % 8 = 0 THEN 4000 ELSE 0 END AS x2, y2
           FROM boxed""",
    ),
    "sdet": (
        ["boxed"],
        """SELECT 'cam' || (ok % 4) || '_' || fs AS image_id, 'cam' || (ok % 4) AS camera_id, fs AS frame_seq,
             ln AS det_idx, class_id, (25 + pk % 75) / 100.0::DOUBLE AS confidence,
             x1 - CASE WHEN pk % 9 = 0 THEN 4000 ELSE 0 END AS x1, y1, x2 - CASE WHEN pk % 9 = 0 THEN 4000 ELSE 0 END AS x2, y2
           FROM boxed""",
    ),
    "alerts": (
        [],
        f"""SELECT event_id AS alert_id, {_KIND} AS type, {_SUB} AS sub_type,
             'cam' || (user_id % 8) AS camera_id, user_id AS track_id,
             ['person', 'car', 'truck'][CAST(user_id % 3 + 1 AS INT)] AS class_name,
             (event_id % 100) / 100.0::DOUBLE AS confidence, props AS extra, {_MS} AS ts_ms
           FROM events""",
    ),
    "pred": (
        [],
        f"""SELECT 'clip' || (user_id % 10) AS video, event_id AS pred_idx, {_KIND} AS type, {_SUB} AS sub_type,
             {_WIRE} AS tripwire_id, CASE WHEN event_type = 'view' THEN {_SUB} END AS direction,
             CAST({_MS} // 1000 - 1704067200 + CASE WHEN event_id % 3 = 0 THEN 100000000 ELSE 0 END AS DOUBLE) AS t
           FROM events""",
    ),
    "truth": (
        [],
        f"""SELECT video, gt_idx, type, sub_type, tripwire_id, direction,
             CASE WHEN gt_idx % 5 <> 0 THEN tat END AS time_sec,
             CASE WHEN gt_idx % 5 = 0 THEN tat - 300 END AS t_start,
             CASE WHEN gt_idx % 5 = 0 THEN tat + 600 END AS t_end
           FROM (SELECT 'clip' || (user_id % 10) AS video, event_id AS gt_idx, {_KIND} AS type, {_SUB} AS sub_type,
             {_WIRE} AS tripwire_id,
             CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 11 < 8 THEN {_SUB} ELSE 'in' END END
               AS direction,
             CAST({_MS} // 1000 - 1704067200 + (event_id % 7 - 3) * 600
               + CASE WHEN event_id % 4 = 0 THEN 300000000 ELSE 0 END AS DOUBLE) AS tat
           FROM events)""",
    ),
    "samples": (
        [],
        """SELECT doc_id AS sample_id,
             'img_' || doc_id || CASE WHEN n_chars % 11 = 0 THEN '.gif' WHEN n_chars % 3 = 0 THEN '.PNG' ELSE '.jpg'
               END AS filename,
             source AS dataset_name, lang, l.has_label IS NOT NULL AS annotated,
             CASE WHEN l.has_label THEN CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'auto' END END
               AS annotation_type, doc_id AS upload_seq
           FROM documents LEFT JOIN (SELECT DISTINCT doc_id, true AS has_label FROM labels) l USING (doc_id)""",
    ),
    "models": (
        [],
        """SELECT p_partkey AS model_id, 'v' || (p_partkey % 50 + 1) AS version,
             CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent_id, 'job' || (p_partkey // 3) AS job_id,
             CAST(p_size AS BIGINT) AS size
           FROM part""",
    ),
    "epochs": (
        [],
        """SELECT 'job' || conv_id AS job_id, turn AS epoch, (length(text) % 1000) / 1000.0::DOUBLE AS map50,
             (length(text) * 7 % 1000) / 1000.0::DOUBLE AS box_loss
           FROM conversations""",
    ),
}


def _order(names: list[str], seen: dict[str, None]) -> dict[str, None]:
    for n in names:
        if n not in seen:
            _order(_VIEWS[n][0], seen)
            seen[n] = None
    return seen


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Prefix a body with the views it needs. A body may start with its own ``name AS (...),`` list,
    closed by the final SELECT."""
    views = ",\n".join(f"{n} AS MATERIALIZED ({_VIEWS[n][1]})" for n in _order(names.split(), {}))
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    return head + views + ("\n" if body.upper().startswith("SELECT") else ",\n") + body


def _mean_y(parts) -> str:
    cond = "((pk + {i}) % 10) / 10.0 > 0.3"
    y = "CASE WHEN pk % 40 = 0 THEN y2 - {i}*h/16 ELSE y1 + {i}*h/16 END"
    s = " + ".join(f"CASE WHEN {cond.format(i=i)} THEN {y.format(i=i)} ELSE 0 END" for i in parts)
    n = " + ".join(f"CASE WHEN {cond.format(i=i)} THEN 1 ELSE 0 END" for i in parts)
    return f"({s}) / nullif({n}, 0)"


def _mean_x(parts) -> str:
    cond = "((pk + {i}) % 10) / 10.0 > 0.3"
    s = " + ".join(
        f"CASE WHEN {cond.format(i=i)} THEN {'cx + hw/2' if i % 2 else 'cx - hw/2'} ELSE 0 END" for i in parts
    )
    n = " + ".join(f"CASE WHEN {cond.format(i=i)} THEN 1 ELSE 0 END" for i in parts)
    return f"({s}) / nullif({n}, 0)"


# Head below the hips or a flat body, from the key points of the "det" view.
FALLEN = f"""coalesce(({_mean_y((0, 1, 2))}) IS NOT NULL AND ({_mean_y((11, 12))}) IS NOT NULL AND (
  ({_mean_y((0, 1, 2))}) > ({_mean_y((11, 12))})
  OR coalesce(abs(({_mean_x((15, 16))}) - ({_mean_x((5, 6))})) > 0
    AND abs(({_mean_y((15, 16))}) - ({_mean_y((5, 6))})) / abs(({_mean_x((15, 16))}) - ({_mean_x((5, 6))})) < 0.5, false)), false)"""
