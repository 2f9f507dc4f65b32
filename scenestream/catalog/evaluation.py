"""Accuracy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, matching
from ..plans import evaluation as ev
from ..sources import projection as p
from .registry import query
from .views import with_views

TOL = 7200.0

_PAIRS = """
  prs AS (SELECT d.image_id, d.det_idx, d.class_id, d.confidence, g.gt_idx, g.class_id AS gt_class,
      greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1)) AS ov,
      (d.x2 - d.x1)*(d.y2 - d.y1) + (g.x2 - g.x1)*(g.y2 - g.y1) AS areas
    FROM sdet d JOIN gtb g USING (image_id)),
  pairs AS (SELECT *, ov / (areas - ov) AS iou FROM prs WHERE ov > 0)"""


def _greedy(source: str, keys: str, name: str) -> str:
    """Step through the detections of each key by rank; each takes its best free truth."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"c.{k} = s.{k}" for k in ks)
    sk = ", ".join(f"s.{k}" for k in ks)
    return f"""
  {name}_o AS (SELECT {keys}, det_idx, confidence, list(gt_idx ORDER BY iou DESC, gt_idx) AS cands FROM {source}
    GROUP BY {keys}, det_idx, confidence),
  {name}_c AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY confidence DESC, det_idx) AS rk FROM {name}_o),
  {name}_s AS (
    SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS det_idx,
      CAST(NULL AS BIGINT) AS gt_idx FROM {name}_c
    UNION ALL
    SELECT {keys}, rk, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END, det_idx, g FROM (
      SELECT {sk}, c.rk, s.used, c.det_idx, list_filter(c.cands, lambda x: NOT list_contains(s.used, x))[1] AS g
      FROM {name}_s s JOIN {name}_c c ON {same} AND c.rk = s.rk + 1)),
  {name} AS (SELECT {keys}, det_idx, gt_idx FROM {name}_s WHERE gt_idx IS NOT NULL)"""


_M50 = _PAIRS + ", p50 AS (SELECT * FROM pairs WHERE iou >= 0.5)," + _greedy("p50", "image_id", "m")
_MC = _PAIRS + ", pc AS (SELECT * FROM pairs WHERE iou >= 0.5 AND class_id = gt_class)," + _greedy("pc", "image_id, class_id", "mc")


def _boxes(spark, sf):
    return p.scored_detections(spark, sf), p.gt_boxes(spark, sf)


@query("match_boxes", with_views("sdet gtb", _M50 + "SELECT * FROM m", True))
def match_boxes(spark, sf):
    return matching.match_boxes(*_boxes(spark, sf), 0.5).select("image_id", "det_idx", "gt_idx")


@query("match_boxes_class", with_views("sdet gtb", _MC + "SELECT * FROM mc", True))
def match_boxes_class(spark, sf):
    return matching.match_boxes(*_boxes(spark, sf), 0.5, by_class=True).select("image_id", "class_id", "det_idx", "gt_idx")


@query(
    "box_iou",
    with_views("sdet gtb", _PAIRS + "SELECT image_id, det_idx, gt_idx, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.1"),
)
def box_iou(spark, sf):
    pairs = matching.iou_pairs(*_boxes(spark, sf), 0.1)
    return pairs.select("image_id", "det_idx", "gt_idx", F.round("iou", 6).alias("iou"))


_IMG = """, img AS (SELECT image_id, CAST(sum(g) AS BIGINT) AS gt_count, CAST(sum(d) AS BIGINT) AS det_count, CAST(sum(t) AS BIGINT) AS tp_count FROM (
    SELECT image_id, 1 AS g, 0 AS d, 0 AS t FROM gtb UNION ALL SELECT image_id, 0, 1, 0 FROM sdet
    UNION ALL SELECT image_id, 0, 0, 1 FROM m) GROUP BY image_id)"""


@query("per_image_eval", with_views("sdet gtb", _M50 + _IMG + "SELECT * FROM img", True))
def per_image_eval(spark, sf):
    d, t = _boxes(spark, sf)
    return ev.per_image(d, t, matching.match_boxes(d, t, 0.5))


_PRF = """round(CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision",
  round(CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall"""
_F1 = "round(CASE WHEN tp = 0 THEN 0 ELSE 2.0*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))) END::DOUBLE, 6) AS f1"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "global_pr",
    with_views(
        "sdet gtb",
        _M50
        + _IMG
        + f""", s AS (SELECT CAST(sum(tp_count) AS BIGINT) AS tp, CAST(sum(det_count - tp_count) AS BIGINT) AS fp,
        CAST(sum(gt_count - tp_count) AS BIGINT) AS fn FROM img)
        SELECT tp, fp, fn, {_PRF}, {_F1} FROM s""",
        True,
    ),
)
def global_pr(spark, sf):
    d, t = _boxes(spark, sf)
    out = ev.global_pr(ev.per_image(d, t, matching.match_boxes(d, t, 0.5)))
    return _rounded(out, "precision", "recall", "f1")


@query(
    "confusion_matrix",
    with_views(
        "sdet gtb",
        _M50
        + """, cells AS (
          SELECT coalesce(t.class_id, -1) AS gt_class, coalesce(d.class_id, -1) AS pred_class
          FROM (SELECT d.image_id, d.class_id, m.gt_idx FROM sdet d LEFT JOIN m USING (image_id, det_idx)) d
          FULL JOIN gtb t ON d.image_id = t.image_id AND d.gt_idx = t.gt_idx),
        cls AS (SELECT DISTINCT class_id AS c FROM gtb UNION ALL SELECT -1),
        folded AS (SELECT gt_class, CASE WHEN pred_class IN (SELECT c FROM cls) THEN pred_class ELSE -1 END AS pred_class,
          count(*) AS n FROM cells GROUP BY ALL)
        SELECT a.c AS gt_class, b.c AS pred_class, coalesce(f.n, 0) AS n FROM cls a CROSS JOIN cls b
        LEFT JOIN folded f ON f.gt_class = a.c AND f.pred_class = b.c""",
        True,
    ),
)
def confusion_matrix(spark, sf):
    d, t = _boxes(spark, sf)
    return ev.confusion_matrix(d, t, matching.match_boxes(d, t, 0.5))


def _curve(scored: str, counts: str, keys: str, name: str) -> str:
    return f"""
  {name} AS (SELECT *, cum_tp / rank AS prec, cum_tp / gt_count AS rec FROM (
    SELECT {keys}, image_id, det_idx, is_tp, gt_count,
      sum(CASE WHEN is_tp THEN 1 ELSE 0 END) OVER w AS cum_tp, row_number() OVER w AS rank
    FROM {scored} JOIN {counts} USING ({keys})
    WINDOW w AS (PARTITION BY {keys} ORDER BY confidence DESC, image_id, det_idx)))"""


_SCORED = (
    _MC
    + """, sc AS (SELECT d.class_id, d.image_id, d.det_idx, d.confidence, mc.gt_idx IS NOT NULL AS is_tp FROM sdet d
    LEFT JOIN mc ON mc.image_id = d.image_id AND mc.class_id = d.class_id AND mc.det_idx = d.det_idx),
  gc AS (SELECT class_id, count(*) AS gt_count FROM gtb GROUP BY class_id),"""
    + _curve("sc", "gc", "class_id", "cv")
)
_AP11 = " + ".join(f"coalesce(max(prec) FILTER (rec >= {i / 10.0}::DOUBLE), 0)" for i in range(11))


@query(
    "pr_curve",
    with_views(
        "sdet gtb",
        _SCORED
        + """SELECT class_id, image_id, det_idx, is_tp, rank, CAST(cum_tp AS BIGINT) AS cum_tp, round(prec, 6) AS "precision",
        round(rec, 6) AS recall FROM cv""",
        True,
    ),
)
def pr_curve(spark, sf):
    c = ev.class_curve(*_boxes(spark, sf))
    return _rounded(c.select("class_id", "image_id", "det_idx", "is_tp", "rank", "cum_tp", "precision", "recall"), "precision", "recall")


@query("ap_interp11", with_views("sdet gtb", _SCORED + f"SELECT class_id, round(({_AP11}) / 11, 6) AS ap FROM cv GROUP BY class_id", True))
def ap_interp11(spark, sf):
    return _rounded(curves.average_precision(ev.class_curve(*_boxes(spark, sf)), ["class_id"]), "ap")


@query(
    "ap_all_points",
    with_views(
        "sdet gtb",
        _SCORED
        + """, up AS (SELECT *, max(prec) OVER (PARTITION BY class_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          AS ceiling FROM cv)
        SELECT class_id, round(coalesce(sum(ceiling) FILTER (is_tp), 0) / any_value(gt_count), 6) AS ap FROM up GROUP BY class_id""",
        True,
    ),
)
def ap_all_points(spark, sf):
    return _rounded(curves.average_precision_all_points(ev.class_curve(*_boxes(spark, sf)), ["class_id"]), "ap")


_CLASS = (
    _SCORED
    + f""", ap AS (SELECT class_id, ({_AP11}) / 11 AS ap FROM cv GROUP BY class_id),
  fd AS (SELECT class_id, count(*) FILTER (is_tp) AS tp, count(*) FILTER (NOT is_tp) AS fp FROM sc GROUP BY class_id),
  cm AS (SELECT class_id, coalesce(gt_count, 0) AS gt_count, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp,
    coalesce(gt_count, 0) - coalesce(tp, 0) AS fn, coalesce(gt_count, 0) > 0 AS has_samples,
    CASE WHEN gt_count > 0 THEN coalesce(ap, 0) END AS ap
    FROM gc FULL JOIN fd USING (class_id) LEFT JOIN ap USING (class_id))"""
)


@query(
    "class_metrics",
    with_views("sdet gtb", _CLASS + f"SELECT class_id, gt_count, tp, fp, fn, has_samples, round(ap, 6) AS ap, {_PRF} FROM cm", True),
)
def class_metrics(spark, sf):
    return _rounded(ev.class_metrics(*_boxes(spark, sf)), "ap", "precision", "recall")


@query("map50", with_views("sdet gtb", _CLASS + "SELECT round(avg(ap), 6) AS map50 FROM cm", True))
def map50(spark, sf):
    return _rounded(ev.map50(ev.class_metrics(*_boxes(spark, sf))), "map50")


_THR = (
    _PAIRS
    + ", thr AS (SELECT unnest(["
    + ", ".join(f"{t!r}::DOUBLE" for t in matching.THRESHOLDS)
    + "]) AS threshold), pt AS (SELECT * FROM pairs JOIN thr ON iou >= threshold WHERE class_id = gt_class),"
    + _greedy("pt", "threshold, image_id, class_id", "mt")
    + """, sc AS (SELECT t.threshold, d.class_id, d.image_id, d.det_idx, d.confidence, m.gt_idx IS NOT NULL AS is_tp
      FROM sdet d CROSS JOIN thr t LEFT JOIN mt m ON m.threshold = t.threshold AND m.image_id = d.image_id
        AND m.class_id = d.class_id AND m.det_idx = d.det_idx),
  gc AS (SELECT threshold, class_id, count(*) AS gt_count FROM gtb CROSS JOIN thr GROUP BY ALL),"""
    + _curve("sc", "gc", "threshold, class_id", "cv")
    + f""", ap AS (SELECT threshold, class_id, ({_AP11}) / 11 AS ap FROM cv GROUP BY ALL),
  by_t AS (SELECT threshold, avg(coalesce(ap, 0)) AS map FROM gc LEFT JOIN ap USING (threshold, class_id) GROUP BY threshold)"""
)


@query("map_by_threshold", with_views("sdet gtb", _THR + "SELECT round(threshold, 2) AS threshold, round(map, 6) AS map FROM by_t", True))
def map_by_threshold(spark, sf):
    m = ev.map_by_threshold(*_boxes(spark, sf))
    return m.select(F.round("threshold", 2).alias("threshold"), F.round("map", 6).alias("map"))


@query("map50_95", with_views("sdet gtb", _THR + "SELECT round(avg(map), 6) AS map50_95 FROM by_t", True))
def map50_95(spark, sf):
    return _rounded(ev.map50_95(ev.map_by_threshold(*_boxes(spark, sf))), "map50_95")


# --- events ---------------------------------------------------------------------------------------

_SCOPED = """
  sp AS (SELECT * REPLACE (CASE WHEN type = 'anomaly' THEN sub_type ELSE '' END AS sub_type) FROM pred WHERE type <> 'tripwire'),
  st AS (SELECT * REPLACE (CASE WHEN type = 'anomaly' THEN sub_type ELSE '' END AS sub_type) FROM truth WHERE type <> 'tripwire')"""


def _cands(p_: str, t_: str, keys: str, name: str) -> str:
    return f"""
  {name} AS (SELECT {keys}, p.pred_idx, t.gt_idx,
      abs(p.t - CASE WHEN t.t_start IS NOT NULL THEN (t.t_start + t.t_end) / 2 ELSE t.time_sec END) AS dist
    FROM {p_} p JOIN {t_} t USING ({keys})
    WHERE p.t BETWEEN coalesce(t.t_start, t.time_sec) - {TOL} AND coalesce(t.t_end, t.time_sec) + {TOL})"""


@query(
    "event_candidates",
    with_views("pred truth", _SCOPED + "," + _cands("sp", "st", "video, type, sub_type", "ca") + "SELECT * FROM ca"),
)
def event_candidates(spark, sf):
    types = ("intrusion", "presence", "anomaly")
    pr = ev._scoped(p.predicted_events(spark, sf).where(F.col("type").isin(*types)))
    tr = ev._scoped(p.truth_events(spark, sf).where(F.col("type").isin(*types)))
    return matching.event_candidates(pr, tr, ev.EVENT_KEYS, TOL).drop("t")


def _event_greedy(cands: str, keys: str, name: str) -> str:
    """Rounds: a pair that is the closest one left for both of its events is matched."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"s.{k} = c.{k}" for k in ks)
    ck = ", ".join(f"c.{k}" for k in ks)
    return f"""
  {name}_l AS (SELECT {keys}, list({{'d': dist, 'p': pred_idx, 'g': gt_idx}} ORDER BY dist, pred_idx, gt_idx) AS cs
    FROM {cands} GROUP BY {keys}),
  {name}_s AS (
    SELECT {keys}, cs, CAST([] AS BIGINT[]) AS used_p, CAST([] AS BIGINT[]) AS used_g, CAST(NULL AS BIGINT) AS pred_idx,
      CAST(NULL AS BIGINT) AS gt_idx FROM {name}_l
    UNION ALL
    SELECT {keys}, list_filter(cs, lambda x: x.p <> cs[1].p AND x.g <> cs[1].g), [], [], cs[1].p, cs[1].g
    FROM {name}_s WHERE len(cs) > 0),
  {name} AS (SELECT {keys}, pred_idx, gt_idx FROM {name}_s WHERE pred_idx IS NOT NULL)"""


_EM = _SCOPED + "," + _cands("sp", "st", "video, type, sub_type", "ca") + "," + _event_greedy("ca", "video, type, sub_type", "em")


@query("match_events", with_views("pred truth", _EM + "SELECT * FROM em", True))
def match_events(spark, sf):
    types = ("intrusion", "presence", "anomaly")
    pr = ev._scoped(p.predicted_events(spark, sf).where(F.col("type").isin(*types)))
    tr = ev._scoped(p.truth_events(spark, sf).where(F.col("type").isin(*types)))
    return matching.match_events(pr, tr, ev.EVENT_KEYS, TOL).drop("dist")


_MISSES = (
    _EM
    + """, ms AS (
    SELECT video, type, sub_type, 'fp' AS kind, pred_idx AS idx, t FROM sp
      WHERE EXISTS (SELECT 1 FROM st WHERE st.video = sp.video AND st.type = sp.type AND st.sub_type = sp.sub_type)
        AND NOT EXISTS (SELECT 1 FROM em WHERE em.video = sp.video AND em.type = sp.type AND em.sub_type = sp.sub_type AND em.pred_idx = sp.pred_idx)
    UNION ALL
    SELECT video, type, sub_type, 'fn', gt_idx, coalesce(t_start, time_sec) FROM st
      WHERE NOT EXISTS (SELECT 1 FROM em WHERE em.video = st.video AND em.type = st.type AND em.sub_type = st.sub_type AND em.gt_idx = st.gt_idx))"""
)


def _misses(spark, sf):
    return ev.event_misses(p.predicted_events(spark, sf), p.truth_events(spark, sf), TOL)


@query("event_misses", with_views("pred truth", _MISSES + "SELECT * FROM ms", True))
def event_misses(spark, sf):
    return _misses(spark, sf)


@query(
    "report_details",
    with_views(
        "pred truth",
        _MISSES + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, type, sub_type, kind ORDER BY t, idx) AS rank FROM ms) WHERE rank <= 20""",
        True,
    ),
)
def report_details(spark, sf):
    """The first 20 false positives and negatives of each rule, as a report shows them."""
    return ev.detail_items(_misses(spark, sf), [*ev.EVENT_KEYS, "kind"], ["t", "idx"])


_ER = (
    _EM
    + """, mk AS (SELECT video, type, sub_type, sum(g) AS gt, sum(p) AS pr, sum(m) AS tp FROM (
      SELECT video, type, sub_type, 1 AS g, 0 AS p, 0 AS m FROM st UNION ALL SELECT video, type, sub_type, 0, 1, 0 FROM sp
      UNION ALL SELECT video, type, sub_type, 0, 0, 1 FROM em) GROUP BY ALL HAVING sum(g) > 0),
  er AS (SELECT video, type, sub_type, CAST(tp AS BIGINT) AS tp, CAST(pr - tp AS BIGINT) AS fp, CAST(gt - tp AS BIGINT) AS fn,
      true AS has_samples FROM mk
    UNION ALL
    SELECT v.video, x.type, '', 0, 0, 0, false FROM (SELECT DISTINCT video FROM truth) v
      CROSS JOIN (SELECT unnest(['intrusion', 'presence', 'anomaly']) AS type) x
      WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.video = v.video AND t.type = x.type))"""
)


def _eval_rules(spark, sf):
    return ev.evaluate_rules(p.predicted_events(spark, sf), p.truth_events(spark, sf), TOL)


@query("eval_rules", with_views("pred truth", _ER + f"SELECT *, {_PRF}, {_F1} FROM er", True))
def eval_rules(spark, sf):
    return _rounded(_eval_rules(spark, sf), "precision", "recall", "f1")


_RM = (
    _ER
    + """, rm AS (SELECT type, sub_type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
    CAST(sum(fn) AS BIGINT) AS fn, bool_or(has_samples) AS has_samples FROM er GROUP BY ALL)"""
)


@query("rule_metrics", with_views("pred truth", _RM + f"SELECT *, {_PRF}, {_F1} FROM rm", True))
def rule_metrics(spark, sf):
    return _rounded(ev.aggregate_metrics(_eval_rules(spark, sf)), "precision", "recall", "f1")


@query(
    "report_overview",
    with_views(
        "pred truth",
        _RM
        + f""", sc AS (SELECT *, {_PRF}, {_F1} FROM rm QUALIFY row_number() OVER (PARTITION BY type ORDER BY sub_type) = 1)
        SELECT n.type, CASE WHEN sc.type IS NULL THEN 'not evaluated' WHEN NOT has_samples THEN 'no samples' ELSE 'evaluated' END
          AS status, "precision", recall, f1
        FROM (SELECT unnest(['anomaly', 'counting', 'intrusion', 'presence', 'tripwire']) AS type) n LEFT JOIN sc USING (type)""",
        True,
    ),
)
def report_overview(spark, sf):
    out = ev.report_overview(ev.aggregate_metrics(_eval_rules(spark, sf)))
    return _rounded(out, "precision", "recall", "f1")


_TW = (
    """tp_ AS (SELECT * FROM pred WHERE type = 'tripwire' AND video IN (SELECT video FROM truth WHERE type = 'tripwire')),
  tt AS (SELECT * FROM truth WHERE type = 'tripwire'),"""
    + _cands("tp_", "tt", "video, tripwire_id", "tc")
    + ","
    + _event_greedy("tc", "video, tripwire_id", "tm")
    + """, tk AS (SELECT video, coalesce(tripwire_id, 'overall') AS sub_type, CAST(sum(g) AS BIGINT) AS gt, CAST(sum(p) AS BIGINT) AS pr,
      CAST(sum(m) AS BIGINT) AS tp, CAST(sum(ok) AS BIGINT) AS direction_correct FROM (
    SELECT video, tripwire_id, 1 AS g, 0 AS p, 0 AS m, 0 AS ok FROM tt
    UNION ALL SELECT video, tripwire_id, 0, 1, 0, 0 FROM tp_
    UNION ALL SELECT m.video, m.tripwire_id, 0, 0, 1, CASE WHEN a.direction = b.direction THEN 1 ELSE 0 END
      FROM tm m JOIN tp_ a ON a.pred_idx = m.pred_idx JOIN tt b ON b.gt_idx = m.gt_idx)
    GROUP BY GROUPING SETS ((video, tripwire_id), (video))),
  tx AS (SELECT video, sub_type, tp, pr - tp AS fp, gt - tp AS fn, direction_correct FROM tk)"""
)


@query(
    "eval_tripwire",
    with_views(
        "pred truth",
        _TW
        + f"""SELECT *, round(CASE WHEN tp > 0 THEN direction_correct / tp ELSE 0 END, 6) AS direction_accuracy, {_PRF}, {_F1} FROM tx""",
        True,
    ),
)
def eval_tripwire(spark, sf):
    out = ev.evaluate_tripwire(p.predicted_events(spark, sf), p.truth_events(spark, sf), TOL)
    return _rounded(out, "precision", "recall", "f1", "direction_accuracy")


_COUNTED = "count(*) FILTER (direction = 'in') AS {a}_in, count(*) FILTER (direction = 'out') AS {a}_out"


@query(
    "eval_counting",
    with_views(
        "pred truth",
        f"""e AS (SELECT video, tripwire_id, {_COUNTED.format(a='expected')} FROM truth WHERE type = 'tripwire' GROUP BY ALL),
        a AS (SELECT video, tripwire_id, {_COUNTED.format(a='actual')} FROM pred WHERE type = 'tripwire' GROUP BY ALL),
        j AS (SELECT e.*, coalesce(actual_in, 0) AS actual_in, coalesce(actual_out, 0) AS actual_out FROM e LEFT JOIN a USING (video, tripwire_id))
        SELECT *, abs(actual_in - expected_in) AS abs_error_in, abs(actual_out - expected_out) AS abs_error_out,
        round(CASE WHEN expected_in > 0 THEN abs(actual_in - expected_in) / expected_in WHEN actual_in = 0 THEN 0 ELSE 'inf'::DOUBLE END, 6) AS rel_error_in,
        round(CASE WHEN expected_out > 0 THEN abs(actual_out - expected_out) / expected_out WHEN actual_out = 0 THEN 0 ELSE 'inf'::DOUBLE END, 6) AS rel_error_out
        FROM j""",
    ),
)
def eval_counting(spark, sf):
    from ..operators.flow import flow_totals

    keys = ["video", "tripwire_id"]
    exp = flow_totals(p.truth_events(spark, sf).where("type = 'tripwire'"), keys)
    act = flow_totals(p.predicted_events(spark, sf).where("type = 'tripwire'"), keys)
    return _rounded(ev.evaluate_counting(exp, act, keys), "rel_error_in", "rel_error_out")


@query(
    "count_error",
    with_views(
        "pred truth",
        """j AS (SELECT video, (SELECT count(*) FROM truth t WHERE t.video = v.video AND t.type = 'tripwire') AS expected,
          (SELECT count(*) FROM pred q WHERE q.video = v.video AND q.type = 'tripwire') AS actual FROM (SELECT DISTINCT video FROM truth) v)
        SELECT video, abs(actual - expected) AS abs_error, round(abs(actual - expected) / expected, 6) AS rel_error FROM j""",
    ),
)
def count_error(spark, sf):
    from ..functions.scores import count_error as err

    wire = F.col("type") == "tripwire"
    t = p.truth_events(spark, sf).groupBy("video").agg(F.count_if(wire).alias("expected"))
    a = p.predicted_events(spark, sf).groupBy("video").agg(F.count_if(wire).alias("actual"))
    j = t.join(a, "video", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    gap, rel = err(F.col("expected"), F.col("actual"))
    return j.select("video", gap.alias("abs_error"), F.round(rel, 6).alias("rel_error"))


@query(
    "prf",
    with_views(
        "pred truth",
        f"""c AS (SELECT video, CAST(count(*) FILTER (gt_idx % 7 > 1) AS BIGINT) AS tp, CAST(count(*) FILTER (gt_idx % 7 = 1) AS BIGINT) AS fp,
          CAST(count(*) FILTER (gt_idx % 7 = 0) AS BIGINT) AS fn FROM truth GROUP BY video)
        SELECT *, {_PRF}, {_F1} FROM c""",
    ),
)
def prf(spark, sf):
    from ..functions.scores import with_prf

    k = F.col("gt_idx") % 7
    c = p.truth_events(spark, sf).groupBy("video").agg(
        F.count_if(k > 1).alias("tp"), F.count_if(k == 1).alias("fp"), F.count_if(k == 0).alias("fn")
    )
    return _rounded(with_prf(c), "precision", "recall", "f1")


@query("report_json")
def report_json(spark, sf):
    d, t = _boxes(spark, sf)
    return ev.report_json(ev.class_metrics(d, t), ev.aggregate_metrics(_eval_rules(spark, sf)))


@query("evaluate_all")
def evaluate_all(spark, sf):
    """Box and rule scores of one run, as (scope, name, value)."""
    d, t = _boxes(spark, sf)
    return ev.evaluate_all(d, t, p.predicted_events(spark, sf), p.truth_events(spark, sf), TOL)
