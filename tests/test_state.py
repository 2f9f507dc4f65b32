"""What streams remember and forget: expiry, recovered counts, silent cameras, late rows, frames whose counter starts again."""

import glob
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from scenestream.operators import flow, rules as batch, sequence
from scenestream.schema import DETECTIONS, FRAMES
from scenestream.streaming import cameras, late, ordered, rules as live

ROI = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)]
T0 = 1_700_000_000_000


class Feed:
    """Files of a stream, dated one after the other."""

    def __init__(self, spark, folder, ddl):
        self.spark, self.folder, self.ddl, self.clock = spark, f"{folder}/{uuid.uuid4().hex}", ddl, iter(range(1_700_000_000, 1_700_001_000))
        self.rows = 0
        self.put([])

    def put(self, rows):
        self.rows += len(rows)
        have = set(glob.glob(f"{self.folder}/*.parquet"))
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(self.folder)
        for f in set(glob.glob(f"{self.folder}/*.parquet")) - have:
            t = next(self.clock)
            os.utime(f, (t, t))

    def stream(self):
        return self.spark.readStream.schema(self.ddl).parquet(self.folder)


def box(seq, ms, det, track, camera="c", name="person", x=100.0):
    return (camera, seq, ms, det, track, 0 if name == "person" else 2, name, 0.9, x, 100.0, x + 40, 200.0, None)


def settle(q, *feeds):
    """Wait until all rows of the feeds were read, and the batches without rows after them have run."""
    until = time.time() + 120
    while sum(p.numInputRows for p in q.recentProgress) < sum(f.rows for f in feeds) and time.time() < until:
        time.sleep(0.2)
    q.processAllAvailable()


def start(df, scratch, name, mode="append"):
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STATE_STORE)
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{scratch}/{name}").start()


def remembered(spark, scratch, name, state):
    return spark.read.format("statestore").option("stateVarName", state).load(f"{scratch}/{name}").count()


def test_presence_forgets_after_three_waits(spark, scratch):
    det = Feed(spark, scratch, DETECTIONS)
    q = start(live.presence(live.timed(det.stream()), ROI, 10.0), scratch, "t_presence")
    try:
        det.put([box(1, T0, 1, 7)])
        settle(q, det)
        det.put([box(2, T0 + 25_000, 1, 8)])
        settle(q, det)
        assert remembered(spark, scratch, "t_presence", "state") >= 1
        det.put([box(3, T0 + 30_000 + 11_000, 1, 9)])  # the watermark passes T0 + 30 s: track 7 was quiet for three waits
        settle(q, det)
        kept = {r["key"]["track_id"] for r in spark.read.format("statestore").option("stateVarName", "state").load(f"{scratch}/t_presence").collect()}
        assert 7 not in kept and 8 in kept
        det.put([box(4, T0 + 10_000_000, 1, 10)])
        settle(q, det)
        for state in ("state", "seen"):
            assert remembered(spark, scratch, "t_presence", state) == 0
    finally:
        q.stop()


def test_frame_memory_is_bounded(spark, scratch):
    """Tracks that are gone leave nothing; a camera that stays silent leaves nothing at all."""
    det, frm = Feed(spark, scratch, DETECTIONS), Feed(spark, scratch, FRAMES)
    q = start(live.intrusion(det.stream(), frm.stream(), ROI, 1, 1.0), scratch, "t_bounded")
    try:
        seq, most = 0, []
        for part in range(6):
            rows, marks = [], []
            for _ in range(50):
                seq += 1
                rows.append(box(seq, T0 + 2000 * seq, 1, seq // 2))  # a new track every second frame
                marks.append(("c", seq, T0 + 2000 * seq, True))
            det.put(rows)
            frm.put(marks)
            settle(q, det, frm)
            most.append(remembered(spark, scratch, "t_bounded", "memory"))
        assert seq // 2 == 150 and max(most) <= 40 and most[-1] > 0
        frm.put([("other", 1, T0 + 10_000_000, True)])
        settle(q, det, frm)
        assert [remembered(spark, scratch, "t_bounded", s) for s in ("memory", "waiting")] == [0, 1]  # only the other camera's marker
        assert {r["key"]["camera_id"] for r in spark.read.format("statestore").option("stateVarName", "last").load(f"{scratch}/t_bounded").collect()} == set()
    finally:
        q.stop()


def crossing_log(hours):
    return [("c", "person", "in" if h % 2 else "out", T0 + 3_600_000 * h + k) for h in hours for k in range(3)]


CROSSINGS = "camera_id string, class_name string, direction string, frame_ms bigint"


def test_counts_go_on_after_a_restart(spark, scratch):
    """A new stream continues from stored windows; midnight starts over; a camera without stored windows starts from zero."""
    stored = spark.createDataFrame(crossing_log(range(0, 4)), CROSSINGS)  # T0 is 22:13 UTC
    windows = flow.flow_windows(stored)
    recovered = flow.recovered_today(windows, T0 + 4 * 3_600_000)
    assert [tuple(r) for r in recovered.collect()] == [("c", "2023-11-15", 3, 3)]
    feed, rows = Feed(spark, scratch, CROSSINGS), []

    def run():
        counts = cameras.today_counts(feed.stream(), recovered)
        out = counts.writeStream.outputMode("update").foreachBatch(lambda batch, _: rows.extend(tuple(r) for r in batch.collect()))
        return out.option("checkpointLocation", f"{scratch}/t_today").start()

    q = run()
    try:
        feed.put(crossing_log([5]) + [("d", "person", "in", T0 + 5 * 3_600_000)] + crossing_log([0]))  # the last ones are of the day before
        settle(q, feed)
        feed.put(crossing_log([26]))
        settle(q, feed)
    finally:
        q.stop()
    assert [r for r in rows if r[0] == "c"] == [("c", "2023-11-15", 6, 3), ("c", "2023-11-16", 0, 3)]
    assert [r for r in rows if r[0] == "d"] == [("d", "2023-11-15", 1, 0)]
    # A restart from the checkpoint keeps the counts and does not add the recovered ones again.
    q = run()
    try:
        feed.rows = 0  # a new run counts its own
        feed.put(crossing_log([27]))
        settle(q, feed)
        assert rows[-1] == ("c", "2023-11-16", 3, 3)
    finally:
        q.stop()


def test_a_camera_that_never_returns_is_reported_once(spark, scratch):
    feed = Feed(spark, scratch, FRAMES)
    expected = spark.createDataFrame([("dead",), ("a",)], "camera_id string")
    q = start(cameras.silent_cameras(feed.stream(), 3.0, expected), scratch, "t_silent", "update")
    try:
        feed.put([("a", 1, T0, True), ("b", 1, T0 + 5, True)])
        until = time.time() + 60
        while time.time() < until and spark.table("t_silent").where("event = 'silent'").count() < 3:
            time.sleep(0.5)
        time.sleep(4)  # longer than the limit: none is reported twice
        assert sorted(tuple(r) for r in spark.table("t_silent").collect()) == [("a", "silent", T0), ("b", "silent", T0 + 5), ("dead", "silent", None)]
        feed.put([("b", 2, T0 + 99, True)])
        while time.time() < until and spark.table("t_silent").where("event = 'back'").count() < 1:
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("t_silent").where("event = 'back'").collect()] == [("b", "back", T0 + 5)]
    finally:
        q.stop()


def test_late_rows_are_counted(spark, scratch):
    det = Feed(spark, scratch, DETECTIONS)
    counter = late.count_late(spark)
    q = start(live.presence(live.timed(det.stream()), ROI, 1.0), scratch, "t_late")
    try:
        det.put([box(1, T0, 1, 1)])
        settle(q, det)
        det.put([box(2, T0 + 60_000, 1, 2)])
        settle(q, det)
        det.put([box(3, T0 + 1_000, 1, 3), box(4, T0 + 2_000, 1, 4), box(5, T0 + 58_000, 1, 5)])  # two behind the watermark, one within the delay
        settle(q, det)
        det.put([box(9, T0 + 900_000, 1, 9)])
        settle(q, det)
        seen = {r["track_id"] for r in spark.table("t_late").collect()}
        assert seen == {1, 2, 5} and late.late_rows(q) == 2
    finally:
        q.stop()
        spark.streams.removeListener(counter)
    assert counter.dropped["t_late"] == 2


def restarted():
    """Two frames of one number, minutes apart, and two within the clock slack of each other."""
    frames = [("c", 1, T0, True), ("c", 2, T0 + 200, True), ("c", 1, T0 + 300_000, True), ("c", 2, T0 + 300_200, False), ("c", 5, T0 + 600_000, True), ("c", 5, T0 + 601_000, True)]
    dets = [
        box(1, T0 + 30, 1, 1), box(2, T0 + 190, 1, 1), box(1, T0 + 300_010, 1, 2), box(2, T0 + 300_200, 1, 2), box(5, T0 + 600_400, 1, 3), box(5, T0 + 600_500, 2, 4),
        box(5, T0 + 600_999, 3, 5), box(7, T0, 1, 6), box(1, T0 + 100_000, 1, 7),
    ]
    want = {(1, T0, 1), (2, T0 + 200, 1), (1, T0 + 300_000, 2), (5, T0 + 600_000, 3), (5, T0 + 601_000, 4), (5, T0 + 601_000, 5)}
    return dets, frames, want


@pytest.mark.parametrize("slice_ms", ["1000", "3000", "600000"])
def test_a_detection_has_one_frame(spark, slice_ms):
    """The nearest of its number in time, if it has motion; none beyond the slack."""
    dets, frames, want = restarted()
    before = spark.conf.get("spark.scenestream.sliceMs", "600000")
    spark.conf.set("spark.scenestream.sliceMs", slice_ms)
    try:
        got = sequence.observe(spark.createDataFrame(dets, DETECTIONS), spark.createDataFrame(frames, FRAMES)).collect()
    finally:
        spark.conf.set("spark.scenestream.sliceMs", before)
    assert sorted((r["frame_seq"], r["frame_ms"], r["track_id"]) for r in got) == sorted(want)
    assert {(r["frame_ms"], r["prev_seq"]) for r in got} == {(T0, None), (T0 + 200, 1), (T0 + 300_000, 2), (T0 + 600_000, 1), (T0 + 601_000, 5)}


def test_a_streamed_detection_has_one_frame(spark, scratch):
    dets, frames, want = restarted()
    det, frm = Feed(spark, scratch, DETECTIONS), Feed(spark, scratch, FRAMES)
    det.put(dets)
    frm.put(frames + [("c", 99, T0 + 9_000_000, True)])
    q = start(live.intrusion(det.stream(), frm.stream(), ROI, 1, 0.0), scratch, "t_frames")
    try:
        settle(q, det, frm)
        assert {(r["frame_seq"], r["frame_ms"], r["track_id"]) for r in spark.table("t_frames").collect()} == want
    finally:
        q.stop()


def test_presence_counts_each_sighting_once(spark):
    dets, frames, want = restarted()
    obs = batch.watch(spark.createDataFrame(dets, DETECTIONS), spark.createDataFrame(frames, FRAMES), ROI)
    assert batch.presence(obs, cooldown_s=0.0).count() == len(want)
