"""Windowed counts and stream hygiene. Inputs carry a watermark on ``ts`` (see ``rules.timed``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import alert_key
from ..schema import AREA_CLASSES


def deduplicate(stream: DataFrame, keys: Sequence[str] = ("camera_id", "frame_seq", "det_idx")) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(list(keys))


def _start(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.unix_millis(F.col("window.start"))).drop("window")


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def flow_windows(crossings: DataFrame, width: str = "60 seconds", slide: str | None = None) -> DataFrame:
    """In/out per camera and aligned window; with ``slide`` a trailing count on a fixed step."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = F.col("direction")
    return _start(crossings.groupBy("camera_id", w).agg(_n(d == "in").alias("window_in"), _n(d == "out").alias("window_out")))


def sessions(rows: DataFrame, gap: str = "10 seconds", keys: Sequence[str] = ("camera_id", "track_id")) -> DataFrame:
    """Start, end and number of rows of each key's sessions: rows less than ``gap`` apart. Sessions that a late row joins are merged."""
    # Session windows that touch are merged: a microsecond less keeps rows apart that are exactly ``gap`` from each other.
    shorter = F.expr(f"cast('{gap}' as interval) - cast('1 microsecond' as interval)")
    out = rows.groupBy(*keys, F.session_window("ts", shorter).alias("s")).agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.unix_millis("_from").alias("start_ms"), F.unix_millis("_to").alias("end_ms"), "n")


def alert_trend(alerts: DataFrame, width: str = "60 minutes") -> DataFrame:
    key = alert_key(F.col("type"), F.col("sub_type")).alias("key")
    return _start(alerts.groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n")))


def camera_stats(alerts: DataFrame) -> DataFrame:
    """Running totals per camera (update mode)."""
    crossed = F.col("type") == "tripwire"
    return alerts.groupBy("camera_id").agg(
        _n(crossed & (F.col("sub_type") == "in")).alias("total_in"),
        _n(crossed & (F.col("sub_type") == "out")).alias("total_out"),
        F.count(F.lit(1)).alias("alert_count"),
        F.max("ts_ms").alias("last_event_ms"),
    )


def area_snapshots(detections: DataFrame, frames: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Occupancy of the first frame in each window.

    Detections and frames meet in one aggregation per frame, a second one picks the first frame.
    """
    there = detections.where("track_id >= 0").select("camera_id", "ts", "class_name", F.lit(None).cast("boolean").alias("has_motion"))
    marks = frames.select("camera_id", "ts", F.lit(None).cast("string").alias("class_name"), "has_motion")
    moving = F.coalesce(F.bool_or("has_motion"), F.lit(False))
    cols = [F.when(moving, _n(F.col("class_name") == c)).otherwise(0).alias(c) for c in AREA_CLASSES]
    total = F.when(moving, _n(F.col("class_name").isNotNull())).otherwise(0).alias("total")
    per_frame = there.unionByName(marks).groupBy("camera_id", F.window("ts", "1 millisecond").alias("w")).agg(*cols, total)
    at = per_frame.withColumn("ts", F.window_time("w"))
    best = F.min_by(F.struct(*AREA_CLASSES, "total"), F.col("w.start")).alias("s")
    out = at.groupBy("camera_id", F.window("ts", width)).agg(best)
    return _start(out).select("camera_id", "window_start", "s.*")


def pipeline_perf(frames: DataFrame, seconds: int = 60) -> DataFrame:
    n = F.count(F.lit(1))
    return _start(
        frames.groupBy("camera_id", F.window("ts", f"{seconds} seconds")).agg(
            F.round(n / F.lit(float(seconds)), 1).alias("fps"),
            F.round(_n(F.col("has_motion")) / F.lit(float(seconds)), 1).alias("detection_fps"),
            F.round(_n(~F.col("has_motion")) * 100.0 / n, 1).alias("skip_rate"),
        )
    )
