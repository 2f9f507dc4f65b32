"""Alert log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..sources import projection as p
from ..sources import sinks
from .registry import query
from .views import with_views

DAY = 86_400_000
WEEK_AGO = p.NOW_MS - 7 * DAY
_COLS = "alert_id, type, sub_type, camera_id, track_id, class_name, confidence, extra, ts_ms"


def _a(body: str) -> str:
    return with_views("alerts", body)


@query(
    "alert_search",
    _a(
        f"""SELECT {_COLS} FROM alerts WHERE camera_id = 'cam3' AND type = 'anomaly' AND ts_ms >= {p.NOW_MS - 20 * DAY}
        AND ts_ms <= {p.NOW_MS - 2 * DAY} ORDER BY ts_ms DESC, alert_id DESC LIMIT 50 OFFSET 20"""
    ),
)
def alert_search(spark, sf):
    return al.search(
        p.alerts(spark, sf), 50, 20, camera_id="cam3", kind="anomaly", start_ms=p.NOW_MS - 20 * DAY, end_ms=p.NOW_MS - 2 * DAY
    )


@query(
    "alert_count",
    _a(f"SELECT count(*) AS total FROM alerts WHERE camera_id = 'cam3' AND type = 'anomaly' AND ts_ms >= {p.NOW_MS - 20 * DAY}"),
)
def alert_count(spark, sf):
    return al.count(p.alerts(spark, sf), camera_id="cam3", kind="anomaly", start_ms=p.NOW_MS - 20 * DAY)


_KEY = "type || CASE WHEN sub_type <> '' THEN '/' || sub_type ELSE '' END"


@query("alert_summary", _a(f"SELECT {_KEY} AS key, count(*) AS n FROM alerts WHERE ts_ms >= {WEEK_AGO} GROUP BY ALL"))
def alert_summary(spark, sf):
    return al.summary(p.alerts(spark, sf), WEEK_AGO)


@query(
    "alert_rollup",
    _a(
        f"""SELECT type, sub_type, count(*) AS n, CAST(grouping(type, sub_type) AS INT) AS level FROM alerts
        WHERE ts_ms >= {WEEK_AGO} GROUP BY ROLLUP (type, sub_type)"""
    ),
)
def alert_rollup(spark, sf):
    return al.roll_up(p.alerts(spark, sf), WEEK_AGO)


_STATS = f"""stats AS (SELECT type, sub_type, camera_id, count(*) AS total_alerts, avg(confidence) AS avg_confidence,
  min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM alerts WHERE ts_ms >= {WEEK_AGO} GROUP BY ALL)"""


@query("alert_stats", _a(_STATS + "SELECT * REPLACE (round(avg_confidence, 3) AS avg_confidence) FROM stats"))
def alert_stats(spark, sf):
    s = al.stats(p.alerts(spark, sf), WEEK_AGO)
    return s.withColumn("avg_confidence", F.round("avg_confidence", 3))


@query(
    "alert_stats_by_rule",
    _a(
        _STATS
        + """SELECT type, sub_type, CAST(sum(total_alerts) AS BIGINT) AS total_alerts, count(*) AS cameras,
        round(avg(avg_confidence), 3) AS avg_confidence FROM stats GROUP BY ALL"""
    ),
)
def alert_stats_by_rule(spark, sf):
    return al.stats_by_rule(al.stats(p.alerts(spark, sf), WEEK_AGO))


@query(
    "alert_kpis",
    _a(
        _STATS
        + """SELECT CAST(sum(total_alerts) AS BIGINT) AS total_alerts, count(DISTINCT camera_id) AS cameras,
        round(sum(avg_confidence * total_alerts) / sum(total_alerts), 3) AS avg_confidence FROM stats"""
    ),
)
def alert_kpis(spark, sf):
    return al.kpis(al.stats(p.alerts(spark, sf), WEEK_AGO))


_TREND = f"""trend AS (SELECT ts_ms // 3600000 * 3600000 AS bucket_ms, {_KEY} AS key, count(*) AS n FROM alerts
  WHERE ts_ms >= {WEEK_AGO} GROUP BY ALL)"""
_KEYS = ["presence", "intrusion", "tripwire/in", "tripwire/out", "anomaly/dwell", "anomaly/crowd"]


@query("alert_trend", _a(_TREND + "SELECT * FROM trend"))
def alert_trend(spark, sf):
    return al.trend(p.alerts(spark, sf), WEEK_AGO)


@query(
    "alert_trend_pivot",
    _a(
        _TREND
        + "SELECT bucket_ms, "
        + ", ".join(f"CAST(coalesce(sum(n) FILTER (key = '{k}'), 0) AS BIGINT) AS {k.replace('/', '_')}" for k in _KEYS)
        + " FROM trend GROUP BY bucket_ms"
    ),
)
def alert_trend_pivot(spark, sf):
    return al.trend_pivot(al.trend(p.alerts(spark, sf), WEEK_AGO), _KEYS)


@query(
    "rule_distribution",
    _a(
        f"""SELECT type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share FROM alerts
        WHERE ts_ms >= {WEEK_AGO} GROUP BY type"""
    ),
)
def rule_distribution(spark, sf):
    return al.distribution(p.alerts(spark, sf), WEEK_AGO)


@query(
    "camera_stats",
    _a(
        """SELECT camera_id, count(*) FILTER (type = 'tripwire' AND sub_type = 'in') AS total_in,
        count(*) FILTER (type = 'tripwire' AND sub_type = 'out') AS total_out, count(*) AS alert_count,
        max(ts_ms) AS last_event_ms FROM alerts GROUP BY camera_id"""
    ),
)
def camera_stats(spark, sf):
    return al.camera_stats(p.alerts(spark, sf))


@query(
    "latest_per_camera",
    _a(
        f"""SELECT {_COLS} FROM alerts
        QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY ts_ms DESC, alert_id DESC) <= 100"""
    ),
)
def latest_per_camera(spark, sf):
    return al.latest_per_key(p.alerts(spark, sf), 100)


@query(
    "alert_allowlist",
    _a(
        """SELECT alert_id, type IN ('intrusion', 'presence') OR (type = 'anomaly' AND sub_type = 'dwell') AS is_alert,
        type = 'intrusion' OR (type = 'anomaly' AND sub_type = 'dwell') AS has_evidence FROM alerts"""
    ),
)
def alert_allowlist(spark, sf):
    flagged = al.flag_alerts(p.alerts(spark, sf), ["intrusion", "presence", "anomaly/dwell"])
    return flagged.select("alert_id", "is_alert", "has_evidence")


@query("retention", _a(f"SELECT alert_id, ts_ms FROM alerts WHERE ts_ms >= {p.NOW_MS - 10 * DAY}"))
def retention(spark, sf):
    return al.retained(p.alerts(spark, sf), p.NOW_MS, 10).select("alert_id", "ts_ms")


@query(
    "alerts_decode",
    _a("SELECT alert_id, CAST(json_extract(extra, '$.k') AS BIGINT) AS k FROM alerts"),
)
def alerts_decode(spark, sf):
    a = p.alerts(spark, sf)
    return a.select("alert_id", F.from_json("extra", "k bigint")["k"].alias("k"))


@query(
    "sink_alerts",
    _a(
        """SELECT CAST(alert_id AS VARCHAR) AS alert_id, type, sub_type, camera_id, track_id, class_name, confidence, ts_ms,
        strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS event_date, true AS is_alert,
        substr(trim(extra), 1, length(trim(extra)) - 1) || ',"zone":' || (track_id % 3) || '}' AS extra FROM alerts"""
    ),
)
def sink_alerts(spark, sf):
    """Rows as the alert sink stores them."""
    a = p.alerts(spark, sf).withColumn("zone", F.col("track_id") % 3)
    rows = sinks.alert_rows(a)
    return rows.select(
        "alert_id", "type", "sub_type", "camera_id", "track_id", "class_name", "confidence", "ts_ms", "event_date", "is_alert", "extra",
    )


@query(
    "alert_docs",
    _a(
        """SELECT alert_id, type, camera_id, ts_ms, 'events-' || strftime(make_timestamp(ts_ms * 1000), '%Y.%m') AS index_name,
        strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS doc_time FROM alerts"""
    ),
)
def alert_docs(spark, sf):
    d = sinks.search_documents(p.alerts(spark, sf), "events")
    return d.select("alert_id", "type", "camera_id", "ts_ms", "index_name", "doc_time")


@query("jsonl_tail", _a(f"SELECT {_COLS} FROM alerts ORDER BY ts_ms DESC, alert_id DESC LIMIT 100"))
def jsonl_tail(spark, sf):
    return al.tail(p.alerts(spark, sf), 100)


_REVIEW = """rv AS (SELECT camera_id, type AS rule_type, count(*) FILTER (alert_id % 5 < 3) AS confirmed,
  count(*) FILTER (alert_id % 5 = 3) AS false_positive, count(*) FILTER (alert_id % 5 = 4) AS missed,
  max(ts_ms) AS period_end FROM alerts GROUP BY ALL),
  sc AS (SELECT *, round(confirmed / (confirmed + false_positive), 4) AS "precision",
    round(confirmed / (confirmed + missed), 4) AS recall FROM rv),
  records AS (SELECT *, round(2 * "precision" * recall / ("precision" + recall), 4) AS f1 FROM sc)"""


def _records(spark, sf):
    from ..operators.quality import review_records

    k = F.col("alert_id") % 5
    counts = (
        p.alerts(spark, sf)
        .groupBy("camera_id", F.col("type").alias("rule_type"))
        .agg(
            F.count_if(k < 3).alias("confirmed"),
            F.count_if(k == 3).alias("false_positive"),
            F.count_if(k == 4).alias("missed"),
            F.max("ts_ms").alias("period_end"),
        )
    )
    return review_records(counts)


@query("review_scores", _a(_REVIEW + "SELECT * FROM records"))
def review_scores(spark, sf):
    return _records(spark, sf)


@query(
    "accuracy_search",
    _a(_REVIEW + "SELECT * FROM records WHERE rule_type = 'anomaly' ORDER BY period_end DESC, camera_id DESC LIMIT 5"),
)
def accuracy_search(spark, sf):
    rows = _records(spark, sf).where("rule_type = 'anomaly'")
    return al.newest(rows, 5, time="period_end", tie="camera_id")
