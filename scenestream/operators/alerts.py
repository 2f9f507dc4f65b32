"""Search, summaries and trends over the alert log.

``since_ms`` is always a parameter; nothing reads the wall clock. Filters come first, so they reach the
Parquet scan and its date partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import bucket_start
from ..functions.naming import alert_key, is_allowed

DAY_MS = 86_400_000
PERF_DAYS = 7


def matching(
    alerts: DataFrame,
    camera_id: str | None = None,
    kind: str | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
) -> DataFrame:
    """Optional filters; an absent, empty or zero argument does not filter."""
    out = alerts
    if camera_id:
        out = out.where(F.col("camera_id") == camera_id)
    if kind:
        out = out.where(F.col("type") == kind)
    if start_ms:
        out = out.where(F.col("ts_ms") >= start_ms)
    if end_ms:
        out = out.where(F.col("ts_ms") <= end_ms)
    return out


def newest(rows: DataFrame, limit: int, offset: int = 0, time: str = "ts_ms", tie: str = "alert_id") -> DataFrame:
    """Newest rows first. Offset before limit, so Spark takes ``offset + limit`` rows per task, no full sort."""
    return rows.orderBy(F.col(time).desc(), F.col(tie).desc()).offset(offset).limit(limit)


def search(alerts: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    return newest(matching(alerts, **filters), limit, offset)


def count(alerts: DataFrame, **filters) -> DataFrame:
    return matching(alerts, **filters).agg(F.count(F.lit(1)).alias("total"))


def summary(alerts: DataFrame, since_ms: int, camera_id: str | None = None) -> DataFrame:
    """Counts by type/sub_type."""
    key = alert_key(F.col("type"), F.col("sub_type")).alias("key")
    return matching(alerts, camera_id, start_ms=since_ms).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def roll_up(alerts: DataFrame, since_ms: int) -> DataFrame:
    """Counts by type and sub_type with type totals and the grand total (``level`` 0, 1, 3)."""
    return (
        matching(alerts, start_ms=since_ms)
        .rollup("type", "sub_type")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
    )


def stats(alerts: DataFrame, since_ms: int) -> DataFrame:
    """Per rule and camera: count, mean confidence, first and last time."""
    return (
        matching(alerts, start_ms=since_ms)
        .groupBy("type", "sub_type", "camera_id")
        .agg(
            F.count(F.lit(1)).alias("total_alerts"),
            F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
            F.min("ts_ms").alias("first_ms"),
            F.max("ts_ms").alias("last_ms"),
        )
    )


def stats_by_rule(camera_stats: DataFrame) -> DataFrame:
    """Over cameras: total, number of cameras, unweighted mean of their mean confidences."""
    return camera_stats.groupBy("type", "sub_type").agg(
        F.sum("total_alerts").alias("total_alerts"),
        F.count(F.lit(1)).alias("cameras"),
        F.round(F.avg("avg_confidence"), 3).alias("avg_confidence"),
    )


def kpis(camera_stats: DataFrame) -> DataFrame:
    """Confidence weighted by alert count, and cameras that raised any alert."""
    weighted = F.sum(F.col("avg_confidence") * F.col("total_alerts")) / F.sum("total_alerts")
    return camera_stats.agg(
        F.sum("total_alerts").alias("total_alerts"),
        F.round(weighted, 3).alias("avg_confidence"),
        F.count_distinct("camera_id").alias("cameras"),
    )


def trend(alerts: DataFrame, since_ms: int, bucket_minutes: int = 60, camera_id: str | None = None) -> DataFrame:
    bucket = bucket_start(F.col("ts_ms"), bucket_minutes * 60_000).alias("bucket_ms")
    key = alert_key(F.col("type"), F.col("sub_type")).alias("key")
    return (
        matching(alerts, camera_id, start_ms=since_ms)
        .groupBy(bucket, key)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("bucket_ms", "key")
    )


def trend_pivot(trend_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One column per alert key; 0 where a bucket has none."""
    wide = trend_rows.groupBy("bucket_ms").pivot("key", list(keys)).agg(F.sum("n"))
    return wide.select("bucket_ms", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k.replace("/", "_")) for k in keys])


def distribution(alerts: DataFrame, since_ms: int) -> DataFrame:
    """Rules ranked by alerts, with their share of the total."""
    per = matching(alerts, start_ms=since_ms).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    # One row per rule by now: gather them beside their total and spread them again.
    whole = per.agg(F.collect_list(F.struct("type", "n")).alias("rules"), F.sum("n").alias("total"))
    return (
        whole.select("total", F.inline("rules"))
        .select("type", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("share"))
        .orderBy(F.desc("n"), "type")
    )


def camera_stats(alerts: DataFrame) -> DataFrame:
    """In/out totals, alert count and time of the last event per camera."""
    crossed = F.col("type") == "tripwire"
    return alerts.groupBy("camera_id").agg(
        F.count_if(crossed & (F.col("sub_type") == "in")).alias("total_in"),
        F.count_if(crossed & (F.col("sub_type") == "out")).alias("total_out"),
        F.count(F.lit(1)).alias("alert_count"),
        F.max("ts_ms").alias("last_event_ms"),
    )


def latest_per_key(rows: DataFrame, n: int, key: str = "camera_id", time: str = "ts_ms", tie: str = "alert_id") -> DataFrame:
    """Newest ``n`` rows of each key.

    A first cut per key and hour spreads a busy key over tasks; its final ranking then sees at most ``n``
    rows per hour.
    """
    order = [F.col(time).desc(), F.col(tie).desc()]
    hourly = Window.partitionBy(key, "_h").orderBy(*order)
    cut = (
        rows.withColumn("_h", F.floor(F.col(time) / F.lit(3_600_000)))
        .withColumn("_n", F.row_number().over(hourly))
        .where(F.col("_n") <= n)
    )
    final = Window.partitionBy(key).orderBy(*order)
    return cut.withColumn("_n", F.row_number().over(final)).where(F.col("_n") <= n).drop("_h", "_n")


def tail(rows: DataFrame, limit: int) -> DataFrame:
    """Last ``limit`` rows of every camera's log, merged, newest first, cut to ``limit``."""
    return newest(latest_per_key(rows, limit), limit)


def flag_alerts(alerts: DataFrame, allowed: Sequence[str] | Column) -> DataFrame:
    """Mark which events count as alerts, and which of those keep a picture as evidence."""
    ok = is_allowed(F.col("type"), F.col("sub_type"), allowed)
    return alerts.withColumn("is_alert", ok).withColumn("has_evidence", F.col("is_alert") & (F.col("type") != "presence"))


def retained(rows: DataFrame, now_ms: int, days: int = 30, time: str = "ts_ms") -> DataFrame:
    return rows.where(F.col(time) >= now_ms - days * DAY_MS)


def page(rows: DataFrame, order: Sequence[Column], page_no: int, page_size: int) -> DataFrame:
    return rows.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def page_totals(rows: DataFrame, page_size: int) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.ceil(n / F.lit(page_size)).alias("total_pages"))
