"""Streaming queries: the sample logs are replayed as a stream, whose rows equal those of the batch rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flow as batch_flow
from ..operators import rules as r
from ..session import cut, shared_folder
from ..sources import projection as p
from ..streaming import aggregates, cameras
from ..streaming import rules as live
from .flow import CROSSED, crossings
from .registry import ORACLES, query
from .rules import _SPELL, basic, observations, wire_rows
from .views import with_views

# Frames far behind the end of the log: they move the watermark past all others, and show that all tracks have gone.
END_AFTER_MS = 100_000_000


def _files(df: DataFrame, name: str) -> DataFrame:
    """A table as files in the shared folder, read as a stream."""
    path = f"{shared_folder(df.sparkSession)}/log-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def replayed(spark, sf, keypoints: bool = False) -> tuple[DataFrame, DataFrame]:
    """Detection and frame logs as streams. Each camera's frames end with a marker far ahead."""
    frames = p.frames(spark, sf)
    ends = frames.groupBy("camera_id").agg(
        (F.max("frame_seq") + END_AFTER_MS).alias("frame_seq"), (F.max("frame_ms") + END_AFTER_MS).alias("frame_ms"), F.lit(True).alias("has_motion")
    )
    return _files(p.detections(spark, sf, keypoints), "detections"), _files(frames.unionByName(ends), "frames")


def drained(stream: DataFrame) -> DataFrame:
    """All rows the stream puts out until its files are read and its last state has come out, as a table in the shared folder."""
    spark, base = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").start()
    )
    try:
        # Unlike a trigger that ends with the files, this also waits for the batches without rows in which state comes out.
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query("stream_intrusion", ORACLES["rule_intrusion"])
def stream_intrusion(spark, sf):
    return basic(drained(live.intrusion(*replayed(spark, sf), p.ROI, confirm=2, wait_s=1.0)))


@query("stream_dwell", ORACLES["rule_dwell"])
def stream_dwell(spark, sf):
    out = drained(live.dwell(*replayed(spark, sf), p.ROI, max_seconds=0.6, confirm=2, wait_s=2.0))
    return basic(out, F.round(F.col("dwell_ms") / 1000.0, 1).alias("dwell_seconds"))


@query("stream_proximity", ORACLES["rule_proximity"])
def stream_proximity(spark, sf):
    return _pairs(drained(live.proximity(*replayed(spark, sf), p.ROI, 120.0, confirm=1, wait_s=1.0)))


@query("stream_proximity_confirmed", ORACLES["rule_proximity_confirmed"])
def stream_proximity_confirmed(spark, sf):
    return _pairs(drained(live.proximity(*replayed(spark, sf), p.ROI, 120.0, confirm=2, wait_s=1.0)))


def _pairs(out):
    return out.select(
        "camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "p_track", "v_track", "v_class", F.round("dist", 1).alias("distance")
    )


@query("stream_crowd", ORACLES["rule_crowd"])
def stream_crowd(spark, sf):
    out = drained(live.crowd(*replayed(spark, sf), p.ROI, max_count=1, radius=400.0, confirm=1, wait_s=1.0))
    return out.select("camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "det_idx", "track_id", "nearby")


@query("stream_fight", ORACLES["rule_fight_pose"])
def stream_fight(spark, sf):
    """With key points and confirmation over two observations."""
    out = drained(live.fight(*replayed(spark, sf, keypoints=True), p.ROI, radius=400.0, min_speed=80.0, confirm=2, wait_s=1.0))
    return out.select(
        "camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "det_idx", "track_id", "involved_count", F.round("avg_speed", 4).alias("avg_speed"), "has_pose"
    )


@query("stream_crowd_confirmed", ORACLES["rule_crowd_confirmed"])
def stream_crowd_confirmed(spark, sf):
    out = drained(live.crowd(*replayed(spark, sf), p.ROI, max_count=1, radius=400.0, confirm=2, wait_s=60.0))
    return out.select("camera_id", "frame_seq", F.col("frame_ms").alias("ts_ms"), "det_idx", "track_id", "nearby")


@query("stream_fall", ORACLES["rule_fall_pose"])
def stream_fall(spark, sf):
    return basic(drained(live.fall(*replayed(spark, sf, keypoints=True), p.ROI, confirm=2, wait_s=1.0)), "sign")


@query("stream_tripwire", with_views("tracked", CROSSED + "SELECT camera_id, tripwire_id, track_id, frame_seq, frame_ms AS ts_ms, det_idx, class_name, direction FROM crossed", True))
def stream_tripwire(spark, sf):
    """Tracked and untracked crossings from one pass."""
    out = drained(live.tripwire(*replayed(spark, sf), wire_rows()))
    return out.selectExpr("camera_id", "tripwire_id", "track_id", "frame_seq", "frame_ms as ts_ms", "det_idx", "class_name", "direction")


_VISITS = with_views(
    "tracked", _SPELL + "SELECT camera_id, track_id, spell_ms AS start_ms, max(frame_ms) AS end_ms, count(*) AS n_frames FROM spell GROUP BY camera_id, track_id, spell_ms"
)


@query("visits", _VISITS)
def visits(spark, sf):
    return r.visits(observations(spark, sf))


@query("stream_visits", _VISITS)
def stream_visits(spark, sf):
    return drained(live.visits(*replayed(spark, sf), p.ROI))


@query(
    "stream_sessions",
    with_views(
        "det",
        """gaps AS (SELECT *, sum(CASE WHEN frame_ms - before < 3000 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, track_id ORDER BY frame_ms, det_idx) AS session FROM (
          SELECT *, lag(frame_ms, 1, -100000) OVER (PARTITION BY camera_id, track_id ORDER BY frame_ms, det_idx) AS before FROM det WHERE track_id >= 0))
        SELECT camera_id, track_id, min(frame_ms) AS start_ms, max(frame_ms) AS end_ms, count(*) AS n FROM gaps GROUP BY camera_id, track_id, session""",
    ),
)
def stream_sessions(spark, sf):
    """Sessions of tracks: sightings less than three seconds apart, whatever the frames between them."""
    det = p.detections(spark, sf, keypoints=False).where("track_id >= 0").select("camera_id", "track_id", "frame_ms")
    end = p.frames(spark, sf).groupBy("camera_id").agg((F.max("frame_ms") + END_AFTER_MS).alias("frame_ms")).select("camera_id", F.lit(-1).cast("long").alias("track_id"), "frame_ms")
    out = aggregates.sessions(live.timed(_files(det.unionByName(end), "sightings")), "3 seconds")
    return drained(out).where("track_id >= 0")


@query(
    "stream_today",
    with_views(
        "tracked",
        CROSSED
        + """SELECT camera_id, max(day) AS day, count(*) FILTER (direction = 'in' AND day = last_day) AS today_in, count(*) FILTER (direction = 'out' AND day = last_day) AS today_out
        FROM (SELECT *, strftime(make_timestamp(frame_ms * 1000), '%Y-%m-%d') AS day, max(strftime(make_timestamp(frame_ms * 1000), '%Y-%m-%d')) OVER (PARTITION BY camera_id) AS last_day
          FROM crossed) GROUP BY camera_id""",
        True,
    ),
)
def stream_today(spark, sf):
    """Counts of the day, recovered from stored windows of its first half and continued by a stream over the second one."""
    rows = cut(crossings(spark, sf).select("camera_id", "class_name", "direction", "frame_ms"))
    windows = batch_flow.flow_windows(rows)
    last = rows.agg(F.max("frame_ms").alias("m"), F.min("frame_ms").alias("n")).first()
    border = ((last["m"] + last["n"]) // 2) // 60_000 * 60_000
    start = batch_flow.recovered_today(windows.where(F.col("window_end") <= border), border - 1)
    return _latest(cameras.today_counts(_files(rows.where(F.col("frame_ms") >= border), "crossings"), start), start)


def _latest(stream: DataFrame, start: DataFrame) -> DataFrame:
    """The last counts of each camera of a stream in update mode; where none came, those it started with."""
    spark, name = stream.sparkSession, f"stream_{uuid.uuid4().hex}"
    base = f"{shared_folder(spark)}/{name}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch_id={batch_id}")

    running = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    rows = spark.read.schema("camera_id string, day string, today_in bigint, today_out bigint, batch_id int").parquet(f"{base}/rows")
    both = rows.unionByName(start.select("camera_id", "day", "today_in", "today_out", F.lit(-1).alias("batch_id")))
    return both.groupBy("camera_id").agg(F.max_by(F.struct("day", "today_in", "today_out"), "batch_id").alias("s")).select("camera_id", "s.*")
