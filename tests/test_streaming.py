"""A stream replayed in several files gives the rows of the batch rule."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from scenestream.catalog.rules import observations
from scenestream.operators import flow, rules as batch
from scenestream.schema import DETECTIONS, FRAMES
from scenestream.sources import projection as p
from scenestream.streaming import aggregates, ordered, rules as live
from tests.conftest import SF

FAR = p.START_MS + 10_000_000
CAMS = ["cam0", "cam1"]


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """Detection and frame logs in three files each, the last row far ahead to flush the watermark."""
    base = str(tmp_path_factory.mktemp("logs"))
    keep = F.col("camera_id").isin(*CAMS) & (F.col("frame_seq") < 150)
    det = p.detections(spark, SF).where(keep).select(*[f.split()[0] for f in DETECTIONS.split(", ")])
    frm = p.frames(spark, SF).where(keep)
    clock = iter(range(1_700_000_000, 1_700_001_000))

    def put(df, name):
        """Append one file and date it after the ones before: the stream reads files by date."""
        have = set(glob.glob(f"{base}/{name}/*.parquet"))
        df.coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        for f in set(glob.glob(f"{base}/{name}/*.parquet")) - have:
            t = next(clock)
            os.utime(f, (t, t))

    for k in range(3):
        part = F.floor(F.col("frame_seq") / 50) == k
        put(det.where(part), "det")
        put(frm.where(part), "frm")
    # Two rounds far ahead: the first moves the watermark, the second lets it take effect. They lie in the
    # region, since Spark filters rows before it looks at their time.
    for k in range(2):
        seq, ms = 10**6 + k, FAR + 100_000 * k
        put(spark.createDataFrame([(c, seq, ms, 1, 9999, 0, "person", 0.9, 500.0, 300.0, 540.0, 400.0, None) for c in CAMS], DETECTIONS), "det")
        put(spark.createDataFrame([(c, seq, ms, True) for c in CAMS], FRAMES), "frm")
    return base


def source(spark, path, ddl):
    return live.timed(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path))


def drain(df, name, scratch):
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STATE_STORE)
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", scratch + "/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def keyset(df):
    return sorted((r.camera_id, r.frame_seq, r.track_id) for r in df.select("camera_id", "frame_seq", "track_id").collect() if r.frame_seq < 10**6)


def batch_obs(spark):
    keep = F.col("camera_id").isin(*CAMS) & (F.col("frame_seq") < 150)
    return batch.watch(p.detections(spark, SF, keypoints=False).where(keep), p.frames(spark, SF).where(keep), p.ROI)


def test_presence(spark, logs, scratch):
    got = drain(live.presence(source(spark, f"{logs}/det", DETECTIONS), p.ROI, 1.0), "s_presence", scratch)
    keep = F.col("camera_id").isin(*CAMS) & (F.col("frame_seq") < 150)
    everything = p.frames(spark, SF).where(keep).withColumn("has_motion", F.lit(True))
    want = batch.presence(batch.watch(p.detections(spark, SF, keypoints=False).where(keep), everything, p.ROI), cooldown_s=1.0)
    assert keyset(got) == keyset(want) and keyset(want)


@pytest.mark.parametrize("name", ["intrusion", "dwell"])
def test_linked_rules(spark, logs, scratch, name):
    det, frm = source(spark, f"{logs}/det", DETECTIONS), source(spark, f"{logs}/frm", FRAMES)
    if name == "intrusion":
        out, want = live.intrusion(det, frm, p.ROI, 2, 1.0), batch.intrusion(batch_obs(spark), 2, 1.0)
    else:
        out, want = live.dwell(det, frm, p.ROI, 0.6, 2, 2.0), batch.dwell(batch_obs(spark), 0.6, 2, 2.0)
    assert keyset(drain(out, f"s_{name}", scratch)) == keyset(want) and keyset(want)


def test_speed(spark, logs, scratch):
    keep = F.col("camera_id").isin(*CAMS) & (F.col("frame_seq") < 150)
    everything = p.frames(spark, SF).where(keep).withColumn("has_motion", F.lit(True))
    want = batch.speed(batch.watch(p.detections(spark, SF, keypoints=False).where(keep), everything), 70.0, 2, 1.5)
    got = drain(live.speed(source(spark, f"{logs}/det", DETECTIONS).drop("keypoints"), 70.0, 2, 1.5), "s_speed", scratch)
    assert keyset(got) == keyset(want) and keyset(want)


def test_windows(spark, logs, scratch):
    got = drain(aggregates.pipeline_perf(source(spark, f"{logs}/frm", FRAMES), 10), "s_perf", scratch)
    keep = F.col("camera_id").isin(*CAMS) & (F.col("frame_seq") < 150)
    want = flow.pipeline_perf(p.frames(spark, SF).where(keep), 10)

    def rows(df):
        return sorted(tuple(r) for r in df.select("camera_id", "window_start", "fps", "detection_fps", "skip_rate").collect() if r.window_start < FAR - 60_000)

    assert rows(got) == rows(want) and rows(want)


def test_area_snapshots(spark, logs, scratch):
    det, frm = source(spark, f"{logs}/det", DETECTIONS).drop("keypoints"), source(spark, f"{logs}/frm", FRAMES)
    got = drain(aggregates.area_snapshots(det, frm, "10 seconds"), "s_area", scratch)
    keep = F.col("camera_id").isin(*CAMS) & (F.col("frame_seq") < 150)
    counts = flow.area_counts(p.detections(spark, SF, keypoints=False).where(keep), p.frames(spark, SF).where(keep))
    want = flow.area_snapshots(counts, 10)

    def rows(df):
        return sorted(tuple(r) for r in df.select("camera_id", "window_start", "person", "car", "total").collect() if r.window_start < FAR - 60_000)

    assert rows(got) == rows(want) and rows(want)


def test_deduplicate(spark, scratch, tmp_path):
    rows = spark.createDataFrame([("cam0", 1, 1000, 1), ("cam0", 1, 1000, 1), ("cam0", 2, 1200, 1)], "camera_id string, frame_seq bigint, frame_ms bigint, det_idx bigint")
    rows.coalesce(1).write.parquet(str(tmp_path / "d"))
    s = live.timed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "d")))
    assert drain(aggregates.deduplicate(s), "s_dedup", scratch).count() == 2


def test_fan_out(spark, scratch, tmp_path):
    from scenestream.sources import readers
    from scenestream.streaming.fanout import fan_out

    a = p.alerts(spark, SF).limit(50).selectExpr("cast(alert_id as string) alert_id", "type", "sub_type", "camera_id", "track_id", "ts_ms", "alert_id % 2 = 0 as is_alert")
    a.write.parquet(str(tmp_path / "a"))
    q = fan_out(spark.readStream.schema(a.schema).parquet(str(tmp_path / "a")), scratch + "/cp", store=str(tmp_path / "store"), camera_log=str(tmp_path / "log")).start()
    q.processAllAvailable()
    q.stop()
    n = spark.read.parquet(str(tmp_path / "a")).where("is_alert").count()
    assert readers.alert_store(spark, str(tmp_path / "store")).count() == 50
    assert readers.camera_log(spark, str(tmp_path / "log")).count() == n
