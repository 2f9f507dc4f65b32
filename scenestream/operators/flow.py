"""Counts over time: directed flow from crossings, occupancy from detections, health of the frame log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import bucket_start, local_time
from ..schema import AREA_CLASSES
from .sequence import cooldown


def _is(direction: str) -> Column:
    return F.count_if(F.col("direction") == direction)


def flow_totals(crossings: DataFrame, by: Sequence[str] = ("camera_id",)) -> DataFrame:
    return crossings.groupBy(*by).agg(_is("in").alias("total_in"), _is("out").alias("total_out"))


def flow_by_day(crossings: DataFrame, zone: str = "UTC") -> DataFrame:
    """Counts that start over at local midnight."""
    day = F.to_date(local_time(F.col("frame_ms"), zone)).cast("string")
    return flow_totals(crossings.withColumn("day", day), ["camera_id", "day"])


def flow_windows(crossings: DataFrame, seconds: int = 60) -> DataFrame:
    """Aligned count windows with running totals and counts by class."""
    width = seconds * 1000
    per_class = flow_totals(
        crossings.withColumn("window_start", bucket_start(F.col("frame_ms"), width)),
        ["camera_id", "window_start", "class_name"],
    )
    entry = F.struct(
        F.col("class_name"), F.struct(F.col("total_in").alias("in"), F.col("total_out").alias("out")).alias("n")
    )
    windows = (
        per_class.groupBy("camera_id", "window_start")
        .agg(
            F.sum("total_in").alias("window_in"),
            F.sum("total_out").alias("window_out"),
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_class"),
        )
        .withColumn("window_end", F.col("window_start") + width)
    )
    # At most one row per camera and window, so a camera's windows fit one task whatever the traffic.
    w = Window.partitionBy("camera_id").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumns({"total_in": F.sum("window_in").over(w), "total_out": F.sum("window_out").over(w)})


def recovered_today(windows: DataFrame, now_ms: int, zone: str = "UTC") -> DataFrame:
    """Today's counts per camera from stored windows, with the ``day``; 0 where nothing was stored since midnight."""
    today = F.to_date(local_time(F.lit(now_ms), zone))
    current = F.to_date(local_time(F.col("window_end"), zone)) == today
    return windows.groupBy("camera_id").agg(
        F.first(today.cast("string")).alias("day"),
        F.coalesce(F.sum(F.when(current, F.col("window_in"))), F.lit(0)).alias("today_in"),
        F.coalesce(F.sum(F.when(current, F.col("window_out"))), F.lit(0)).alias("today_out"),
    )


def flow_trailing(crossings: DataFrame, seconds: int = 60, stretch_ms: int = 3_600_000) -> DataFrame:
    """At each crossing, how many of its camera lie in the last ``seconds`` (both ends included).

    Crossings near the end of a stretch are shown to the next one too, so a camera is never one task.
    """
    back = seconds * 1000
    stretch_ms = max(stretch_ms, back)
    home = F.floor(F.col("frame_ms") / F.lit(stretch_ms))
    until = F.floor((F.col("frame_ms") + back) / F.lit(stretch_ms))
    spread = crossings.withColumn("_home", home).withColumn("_in", F.explode(F.sequence(F.col("_home"), until)))
    w = Window.partitionBy("camera_id", "_in").orderBy("frame_ms").rangeBetween(-back, 0)
    counted = spread.withColumns({"window_in": _is("in").over(w), "window_out": _is("out").over(w)})
    return counted.where("_home = _in").drop("_home", "_in")


def area_counts(detections: DataFrame, frames: DataFrame, inside: Column | None = None) -> DataFrame:
    """Occupancy per frame: tracked boxes inside the region by class. Frames without any count as 0.

    A frame without motion is empty whatever the log says. Frames and boxes meet in one aggregation.
    """
    there = detections.where("track_id >= 0")
    there = there.where(inside) if inside is not None else there
    boxes = there.select("camera_id", "frame_seq", "frame_ms", "class_name", F.lit(None).cast("boolean").alias("has_motion"))
    marks = frames.select("camera_id", "frame_seq", "frame_ms", F.lit(None).cast("string").alias("class_name"), "has_motion")
    moving = F.bool_or("has_motion")

    def n(cond: Column) -> Column:
        return F.when(F.coalesce(moving, F.lit(False)), F.count_if(cond)).otherwise(F.lit(0))

    cols = [n(F.col("class_name") == c).alias(c) for c in AREA_CLASSES]
    return (
        boxes.unionByName(marks)
        .groupBy("camera_id", "frame_seq", "frame_ms")
        .agg(F.count("has_motion").alias("_frames"), *cols, n(F.col("class_name").isNotNull()).alias("total"))
        .where("_frames > 0")
        .drop("_frames")
    )


def area_snapshots(counts: DataFrame, seconds: int = 60) -> DataFrame:
    """First occupancy of each aligned window."""
    cols = ["frame_ms", *AREA_CLASSES, "total"]
    return (
        counts.withColumn("window_start", bucket_start(F.col("frame_ms"), seconds * 1000))
        .groupBy("camera_id", "window_start")
        .agg(F.min_by(F.struct(*cols), "frame_ms").alias("s"))
        .select("camera_id", "window_start", "s.*")
    )


def unique_tracks(detections: DataFrame) -> DataFrame:
    """Distinct tracks per class and, with a NULL class, over all classes."""
    pairs = detections.where("track_id >= 0").select("class_name", "camera_id", "track_id").distinct()
    return pairs.rollup("class_name").agg(F.count(F.lit(1)).alias("tracks"))


def throttle(frames: DataFrame, fps: float) -> DataFrame:
    """Keep a frame when at least 1/fps seconds passed since the last kept frame of its camera (exact)."""
    return cooldown(frames, ["camera_id"], int(round(1000.0 / fps)), order=["frame_seq"])


def sample_frames(frames: DataFrame, every: Column | int) -> DataFrame:
    return frames.where(F.col("frame_seq") % every == 0)


def gaps(rows: DataFrame, limit_ms: int, time: str = "frame_ms", key: str = "camera_id", stretch_ms: int = 3_600_000) -> DataFrame:
    """Silences longer than ``limit_ms``: key, last time before and first time after."""
    r = rows.select(key, F.col(time).alias("_t"), F.floor(F.col(time) / F.lit(stretch_ms)).alias("_s"))
    within = r.withColumn("_p", F.lag("_t").over(Window.partitionBy(key, "_s").orderBy("_t")))
    ends = r.groupBy(key, "_s").agg(F.min("_t").alias("_t"), F.max("_t").alias("_e"))
    across = ends.withColumn("_p", F.lag("_e").over(Window.partitionBy(key).orderBy("_s")))
    both = within.select(key, "_p", "_t").unionByName(across.select(key, "_p", "_t"))
    long = both.where(F.col("_t") - F.col("_p") > limit_ms)
    return long.select(key, F.col("_p").alias("last_ms"), F.col("_t").alias("next_ms"), (F.col("_t") - F.col("_p")).alias("gap_ms"))


def pipeline_perf(frames: DataFrame, seconds: int = 60, inference_ms: str | None = None) -> DataFrame:
    """Frames and detections per second, share of frames without motion (%), mean inference time."""
    per = [
        F.round(F.count(F.lit(1)) / F.lit(float(seconds)), 1).alias("fps"),
        F.round(F.count_if("has_motion") / F.lit(float(seconds)), 1).alias("detection_fps"),
        F.round(F.count_if(~F.col("has_motion")) * 100.0 / F.count(F.lit(1)), 1).alias("skip_rate"),
    ]
    if inference_ms:
        per.append(F.round(F.avg(inference_ms), 1).alias("mean_inference_ms"))
    start = bucket_start(F.col("frame_ms"), seconds * 1000).alias("window_start")
    return frames.groupBy("camera_id", start).agg(*per)


def camera_overview(flow: DataFrame, occupancy: DataFrame, alerts: DataFrame) -> DataFrame:
    """Flow totals, latest occupancy and alert counts per camera; absent parts count as 0."""
    latest = occupancy.groupBy("camera_id").agg(F.max_by("total", "frame_ms").alias("area_total"))
    raised = alerts.groupBy("camera_id").agg(F.count(F.lit(1)).alias("alert_count"), F.max("ts_ms").alias("last_ms"))
    joined = flow_totals(flow).join(latest, "camera_id", "full_outer").join(raised, "camera_id", "full_outer")
    cols = ["total_in", "total_out", "area_total", "alert_count"]
    return joined.select("camera_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols], "last_ms")
