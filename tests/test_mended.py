"""One test for each answer that was once wrong."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scenestream.operators import curves, datasets, matching, quality, rules, sequence, tripwire
from scenestream.plans import evaluation, ruleset
from scenestream.sources import labels, projection, readers, sinks
from scenestream.streaming import aggregates, frames as streamed, judges
from scenestream.streaming.frames import FrameByFrame, Judge, judged
from scenestream.streaming.judges import Unbroken

SF = "/root/testdata/sf0.001"


def test_label_rows_read_back(spark, scratch):
    files = spark.createDataFrame([("c1", 7, "# x\n0 0.5 0.5 0.1 0.2\nbad"), ("c2", 1, "# no detections")], "camera_id string, frame_seq bigint, body string")
    labels.write_label_rows(files, scratch + "/labels")
    lines = labels.read_label_rows(spark, scratch + "/labels")
    assert sorted((r.image_id, r.line_no, r.line) for r in lines.collect()) == [
        ("c1_7", 0, "# x"), ("c1_7", 1, "0 0.5 0.5 0.1 0.2"), ("c1_7", 2, "bad"), ("c2_1", 0, "# no detections"),
    ]
    images = spark.createDataFrame([("c1_7", 100, 100)], "image_id string, width int, height int")
    assert [r.class_id for r in labels.parse(lines, images).collect()] == [0]


def test_wires_without_an_id_score_nothing(spark):
    schema = "video string, {} bigint, type string, sub_type string, tripwire_id string, direction string, {}"
    pred = spark.createDataFrame([("v", 1, "tripwire", "in", "a", "in", 1.0), ("v", 2, "tripwire", "in", None, "in", 1.0)], schema.format("pred_idx", "t double"))
    truth = spark.createDataFrame(
        [("v", 1, "tripwire", "in", "a", "in", 1.0, None, None), ("v", 2, "tripwire", "in", None, "in", 1.0, None, None)],
        schema.format("gt_idx", "time_sec double, t_start double, t_end double"),
    )
    got = sorted((r.sub_type, r.tp, r.fp, r.fn) for r in evaluation.evaluate_tripwire(pred, truth, 2.0).collect())
    assert got == [("a", 1, 0, 0), ("overall", 1, 0, 0)]


def test_tracks_alive_at_the_end_have_not_gone(spark):
    frames = spark.createDataFrame([("c", 1, 200, True), ("c", 2, 400, True), ("c", 3, 600, False)], "camera_id string, frame_seq bigint, frame_ms bigint, has_motion boolean")
    obs = spark.createDataFrame([("c", 1, 200, 5, None), ("c", 1, 200, 6, None), ("c", 2, 400, 6, 1)], "camera_id string, frame_seq bigint, frame_ms bigint, track_id bigint, prev_seq bigint")
    assert [r.track_id for r in rules.track_exits(obs, frames).collect()] == [5]


def test_uploads(spark):
    files = spark.createDataFrame([("b", "x.bmp"), ("b", "x.JPG")], "batch string, filename string")
    assert [r.error for r in quality.upload_errors(files, "batch").collect()] == ["invalid_format: x.bmp"]


def test_extra_is_merged(spark):
    rows = [('{"k": 1}', 5), ("{}", 6), (None, 7), ("plain", 8)]
    df = spark.createDataFrame(rows, "extra string, zone int").withColumn("ts_ms", F.lit(0).cast("bigint"))
    assert [r.extra for r in sinks.alert_rows(df).collect()] == ['{"k": 1,"zone":5}', '{"zone":6}', '{"zone":7}', '{"extra":"plain","zone":8}']


def test_counting_totals(spark):
    doc = '{"video_path": "a/v1.mp4", "events": [{"type": "counting", "expected_in": 3, "expected_out": 1}]}'
    from scenestream.schema import VIDEO_ANNOTATION

    docs = spark.createDataFrame([(doc,)], "doc string").select(F.from_json("doc", VIDEO_ANNOTATION).alias("a")).select("a.*")
    assert [tuple(r) for r in readers.expected_counts(docs).collect()] == [("v1", "*", 3, 1)]


def test_long_lineage_and_circles(spark):
    chain = [(i, i - 1 if i else None) for i in range(151)] + [(1000, 1001), (1001, 1000)]
    up = datasets.lineage(spark.createDataFrame(chain, "model_id bigint, parent_id bigint"))
    assert up.where("model_id = 150").agg(F.count("*"), F.max("steps")).first() == (150, 150)
    assert sorted((r.ancestor_id, r.steps) for r in up.where("model_id = 1000").collect()) == [(1000, 2), (1001, 1)]


def test_a_tracked_crossing_silences_the_next_slice(short_slices):
    def rows(ms):
        return [("c", "w", "car", ms // 3000, ms // 200, ms, 1, 2000)]

    schema = "camera_id string, tripwire_id string, class_name string, slice bigint, frame_seq bigint, frame_ms bigint, det_idx bigint, cooldown_ms bigint"
    tracked = short_slices.createDataFrame(rows(5800), schema)
    firsts = short_slices.createDataFrame(rows(6200) + rows(7800), schema)
    assert [r.frame_ms for r in tripwire._silenced(firsts, tracked, ["camera_id", "tripwire_id", "class_name"]).collect()] == [7800]


def test_rows_a_whole_gap_apart_are_two_sessions(spark):
    rows = spark.createDataFrame([("c", 1, 0), ("c", 1, 2999), ("c", 1, 5999)], "camera_id string, track_id bigint, frame_ms bigint")
    got = aggregates.sessions(rows.withColumn("ts", F.timestamp_millis("frame_ms")), "3 seconds").collect()
    assert sorted((r.start_ms, r.end_ms, r.n) for r in got) == [(0, 2999, 2), (5999, 5999, 1)]


class Holding(Judge):
    """Says of each frame how many tracks are remembered."""

    state, adds, keep_ms = "x bigint", "held bigint", 1000

    def frame(self, frame, rows, memory):
        for r in rows:
            memory.put(frame.ms, "track", r["track_id"], x=0)
            yield {**r, "held": len(memory.entries)}


def test_a_stream_forgets_within_one_batch(spark, scratch):
    rows = spark.range(1000).selectExpr("'c' as camera_id", "id as frame_seq", "id * 200 + 1000 as frame_ms", "id as track_id", "1L as det_idx")
    rows.drop("track_id", "det_idx").withColumn("has_motion", F.lit(True)).write.parquet(scratch + "/frames")
    end = spark.createDataFrame([("c", 10**9, 10**9, True)], "camera_id string, frame_seq bigint, frame_ms bigint, has_motion boolean")
    end.write.mode("append").parquet(scratch + "/frames")
    rows.write.parquet(scratch + "/dets")
    dets, frames = (spark.readStream.schema(spark.read.parquet(f"{scratch}/{n}").schema).parquet(f"{scratch}/{n}") for n in ("dets", "frames"))
    q = judged(dets, frames, Holding()).writeStream.format("memory").queryName("holding").option("checkpointLocation", scratch + "/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("holding").collect()
    assert sorted(r.track_id for r in got) == list(range(1000))
    assert max(r.held for r in got) < 300


def test_dense_events_are_matched_without_storing_their_pairs(spark, monkeypatch):
    rng = random.Random(5)
    preds = [("a", i, float(rng.randrange(3000))) for i in range(400)]
    truth = [("a", i, float(rng.randrange(3000)), None, None) for i in range(300)] + [("a", 300 + i, None, 90.0 * i, 90.0 * i + 60) for i in range(30)]
    stored = []
    plain = matching.mutually_first
    monkeypatch.setattr(matching, "mutually_first", lambda pairs, *a: stored.append(pairs.count()) or plain(pairs, *a))
    p = spark.createDataFrame(preds, "video string, pred_idx long, t double")
    t = spark.createDataFrame(truth, "video string, gt_idx long, time_sec double, t_start double, t_end double")
    got = {(r.pred_idx, r.gt_idx, r.dist) for r in matching.match_events(p, t, ["video"], 200.0).collect()}
    spans = [(g, (s + e) / 2, s - 200, e + 200) if s is not None else (g, at, at - 200, at + 200) for _, g, at, s, e in truth]
    pairs = sorted((abs(at - mid), i, g) for _, i, at in preds for g, mid, lo, hi in spans if lo <= at <= hi)
    used, want = set(), set()
    for d, i, g in pairs:
        if not {("p", i), ("g", g)} & used:
            used |= {("p", i), ("g", g)}
            want.add((i, g, d))
    assert got == want
    assert sum(stored) < len(pairs) / 20


class _Map(dict):
    """A map state without a stream."""

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop

    def iterator(self):
        return iter(list(self.items()))


def test_waiting_rows_need_few_blocks_however_many_spans_they_are_of(spark):
    rows = StructType.fromDDL("camera_id string, frame_seq bigint, frame_ms bigint, det_idx bigint, x1 double, has_motion boolean")
    proc = FrameByFrame(Unbroken(1, 1), rows, rows, 2000)
    proc.spans, proc.blocks = _Map(), _Map()
    sent = [{"camera_id": "a", "frame_seq": i, "frame_ms": i * 60_000, "det_idx": i % 2 - 1, "x1": None if i % 3 else 0.5, "has_motion": None if i % 2 else True} for i in range(600)]
    for part in range(3):
        proc._wait([pa.RecordBatch.from_pylist(sent[part::3][::-1], schema=proc.row_schema)])
    assert len(proc.blocks) == 3
    pool = []
    got = [r for _, rows in proc._begun(299 * 60_000, pool) for r in rows]
    assert got == sent[:300] and len(proc.blocks) == 0
    assert sum(len(spans) - place for spans, place, _ in pool) == 300


def test_a_long_log_is_cut_into_more_tasks(short_slices, monkeypatch):
    frames = short_slices.range(400).selectExpr("concat('c', id % 2) as camera_id", "id as frame_seq", "id * 5000 as frame_ms", "true as has_motion")
    dets = frames.selectExpr("camera_id", "frame_seq", "frame_ms", "1L as det_idx")
    few = sequence.observe(dets, frames).collect()
    monkeypatch.setattr(sequence, "FRAMES_PER_TASK", 40)
    many = sequence.observe(dets, frames)
    short_slices.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert many.select(F.spark_partition_id()).distinct().count() == 10
    finally:
        short_slices.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(many.collect()) == sorted(few)


def test_key_points_are_not_carried_on(spark):
    obs = rules.watch(projection.detections(spark, SF), projection.frames(spark, SF), projection.ROI)
    assert "keypoints" not in rules.person_motion(obs).columns


def test_rules_share_one_written_table_of_observations(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ruleset, "cut", lambda df: written.append(df.columns) or df)
    on = {"enabled": True, "confirm_frames": 1, "cooldown": 1.0}
    camera = ruleset.Camera("cam0", {"intrusion": on, "speed": {**on, "max_pixel_speed": 70.0}}, projection.ROI)
    assert set(ruleset.rule_plans(projection.detections(spark, SF), projection.frames(spark, SF), [camera])) == {"intrusion", "speed"}
    assert len(written) == 1 and "in_roi" in written[0]


def test_lineage_makes_each_pair_once(spark, monkeypatch):
    kind = type(spark.range(1))
    joined, union = [], kind.union
    monkeypatch.setattr(kind, "union", lambda a, b: joined.append(b.count()) or union(a, b))
    models = spark.createDataFrame([(i, i - 1) for i in range(1, 9)] + [(100, 101), (101, 100)], "model_id bigint, parent_id bigint")
    want = {(m, a, m - a) for m in range(1, 9) for a in range(m)} | {(100, 101, 1), (100, 100, 2), (101, 100, 1), (101, 101, 2)}
    assert sorted(map(tuple, datasets.lineage(models).collect())) == sorted(want)
    # 28 pairs of the chain lie beyond the first step and 2 of the circle, which goes round once more.
    assert sum(joined) <= 40


BOX = "image_id string, class_id long, {} long, confidence double, x1 double, y1 double, x2 double, y2 double"


def test_boxes_are_clustered_by_image_once(spark):
    """Cells, options and the walk through an image need no further exchange."""
    rows = [(f"i{k % 3}", 0, k, 0.5 + k / 100, 200.0 + k, 200.0, 300.0 + k, 300.0) for k in range(9)]
    d, t = (spark.createDataFrame(rows, BOX.format(c)) for c in ("det_idx", "gt_idx"))
    for found in (matching.match_boxes(d, t), matching.match_boxes(d, t, by_class=True), matching.match_levels(d, t)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(image_id") == 2 == plan.count("Exchange ")
        assert found.count() == 9


def test_only_true_positives_are_lifted(spark, monkeypatch):
    """Average precision looks at true positives alone; a class without any has the area 0."""
    rng = random.Random(5)
    rows = [(c, f"i{i}", 0, rng.choice([0.1, 0.5, 0.9]), c < 3 and rng.random() < 0.4) for c in range(4) for i in range(50)]
    curve = curves.pr_curve(
        spark.createDataFrame(rows, "class_id long, image_id string, det_idx long, confidence double, is_tp boolean"),
        spark.createDataFrame([(c, 40) for c in range(4)], "class_id long, gt_count long"), ["class_id"],
    )
    seen, whole = [], curves.running
    monkeypatch.setattr(curves, "running", lambda df, *a, **kw: seen.append(df.count()) or whole(df, *a, **kw))
    got = {r["class_id"]: r["ap"] for r in curves.average_precision_all_points(curve, ["class_id"]).collect()}
    assert seen[0] <= sum(r[4] for r in rows) + 4 < len(rows)
    for c in range(4):
        hits = [r[4] for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[3], r[1]))]
        precision = [sum(hits[: i + 1]) / (i + 1) for i in range(50)]
        assert abs(got[c] - sum(max(precision[i:]) for i in range(50) if hits[i]) / 40) < 1e-12


def test_rows_of_one_frame_travel_as_one(spark):
    kinds = StructType.fromDDL("camera_id string, frame_seq bigint, frame_ms bigint, det_idx int, x1 double, x2 float, class_name string, has_motion boolean, note string, mark tinyint")
    proc = FrameByFrame(Unbroken(1, 1), kinds, kinds, 2000, packed=True)
    rng = random.Random(3)

    def some(value):
        return None if rng.random() < 0.3 else value

    sent = [
        {
            "camera_id": "a", "frame_seq": some(i), "frame_ms": 200 * (i // 4), "det_idx": i % 4, "x1": some(i / 3), "x2": some(0.5), "class_name": some(["person", "", "車"][i % 3]),
            "has_motion": some(i % 2 == 0), "note": some("x" * (i % 5)), "mark": some(i % 100),
        }
        for i in range(200)
    ]
    rows = pa.RecordBatch.from_pylist(sent, schema=proc.row_schema)
    packed = streamed._packed(rows.slice(10, 150), proc.slots)
    assert packed.num_rows == 38 and set(packed.column("camera_id").to_pylist()) == {"a"}
    assert packed.column("frame_ms").to_pylist() == [200 * n for n in range(2, 40)]
    assert streamed._unpacked(packed.to_pandas(), "a", proc.row_schema, proc.slots).to_pylist() == sent[10:160]
    both = pa.RecordBatch.from_pylist([{**sent[0], "camera_id": c, "frame_ms": ms} for c, ms in [("a", 1), (None, 1), (None, 1), ("b", 1), ("b", None), ("b", None)]], schema=proc.row_schema)
    assert [(r["camera_id"], r["frame_ms"]) for r in streamed._packed(both, proc.slots).to_pylist()] == [("a", 1), (None, 1), ("b", 1), ("b", None)]
    assert streamed._slots(StructType.fromDDL("camera_id string, frame_ms bigint, price decimal(5, 2)")) is None


def test_a_track_goes_into_the_memory_once_for_many_frames():
    """Columns are read once; what is remembered is what frame by frame leaves."""
    wires = [("a", f"w{n}", f"w{n}", 0.0, 10.0 * n, 100.0, 10.0 * n, "left_to_right", 500) for n in (1, 2)]
    rng, rows, starts = random.Random(4), [], [0]
    ready = [streamed.Frame(n, 200 * n, n - 1, 200 * n - 200) for n in range(120)]
    for f in ready:
        for d in range(rng.randrange(5)):
            x, y = 50 + rng.randrange(3), rng.choice([8.0, 12.0, 18.0, 22.0])
            rows.append({"camera_id": "a", "frame_seq": f.seq, "frame_ms": f.ms, "det_idx": d, "track_id": rng.choice([-1, d]), "class_id": 0, "class_name": "person", "x1": x - 1.0, "y1": y - 2, "x2": x + 1.0, "y2": y, "cx": float(x), "cy": y - 1})
        starts.append(len(rows))
    batch, kept, found = pa.RecordBatch.from_pylist(rows), [], []
    for step in (120, 1):
        memory, puts = streamed.Memory({}), []
        memory.put, plain = lambda ms, part, *a, **k: puts.append(part) or plain(ms, part, *a, **k), memory.put
        judge, out = judges.Wires(wires), []
        for n in range(0, 120, step):
            at = [s - starts[n] for s in starts[n : n + step + 1]]
            out += judge.frames(ready[n : n + step], at, batch.slice(starts[n], at[-1]), memory)
        kept.append((memory.entries, len([p for p in puts if p == "track"])))
        found.append(out)
    assert found[0] == found[1] and {r["method"] for r in found[0]} == {"tracked", "untracked"}
    assert kept[0][0] == kept[1][0] and kept[0][1] <= 4 < kept[1][1]


def test_streams_with_a_watermark_or_other_columns_are_judged_alike(spark, scratch):
    rows = spark.range(300).selectExpr("concat('c', id % 2) as camera_id", "id as frame_seq", "id * 200 as frame_ms", "id % 7 as track_id", "1L as det_idx", "cast(id as decimal(9, 2)) as price")
    frames = rows.select("camera_id", "frame_seq", "frame_ms", F.lit(True).alias("has_motion"))
    rows = rows.unionByName(rows.where("frame_seq < 2").withColumn("frame_ms", F.lit(10**9)))  # both streams go on, so that all frames end
    ends = spark.createDataFrame([(c, 10**9, 10**9, True) for c in ("c0", "c1")], frames.schema)
    got = {}
    for name, dets, timed in (("packed", rows.drop("price"), False), ("priced", rows, False), ("timed", rows.drop("price"), True)):
        logs = []
        for part, df in (("dets", dets), ("frames", frames.unionByName(ends))):
            df.coalesce(1).write.parquet(f"{scratch}/{name}/{part}")
            log = spark.readStream.schema(df.schema).parquet(f"{scratch}/{name}/{part}")
            logs.append(log.withColumn("ts", F.timestamp_millis("frame_ms")).withWatermark("ts", "10 seconds") if timed else log)
        out = judged(*logs, Unbroken(1, 1000))
        q = out.writeStream.format("memory").queryName(f"alike_{name}").option("checkpointLocation", f"{scratch}/{name}/cp").start()
        q.processAllAvailable()
        q.stop()
        got[name] = {(r.camera_id, r.frame_seq, r.frame_ms, r.track_id, r.det_idx) for r in spark.table(f"alike_{name}").collect()}
    assert len(got["packed"]) > 100 and got["packed"] == got["priced"] == got["timed"]
