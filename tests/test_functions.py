"""Properties of scores, curves, labels and readers."""

import json
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenestream.functions import geometry as g
from scenestream.functions import labels
from scenestream.functions.scores import count_error, with_prf
from scenestream.operators import curves
from scenestream.plans import evaluation as ev
from scenestream.sources import labels as label_files
from scenestream.sources import readers, sinks

FEW = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
BOX = st.tuples(st.integers(0, 900), st.integers(0, 900), st.integers(1, 99), st.integers(1, 99))


@FEW
@given(st.lists(st.tuples(BOX, BOX), min_size=20, max_size=60))
def test_iou(spark, pairs):
    rows = [tuple(float(v) for b in pr for v in (b[0], b[1], b[0] + b[2], b[1] + b[3])) for pr in pairs]
    df = spark.createDataFrame(rows, "x1 double,y1 double,x2 double,y2 double,r_x1 double,r_y1 double,r_x2 double,r_y2 double")
    a, b = g.box(), g.box("r_")
    for x in df.select(g.iou(a, b).alias("ab"), g.iou(b, a).alias("ba"), g.iou(a, a).alias("aa"), g.boxes_touch(a, b).alias("t")).collect():
        assert 0 <= x.ab <= 1 and x.ab == x.ba and x.aa == 1.0 and (x.t or x.ab == 0)


@FEW
@given(st.lists(st.tuples(st.integers(0, 100), st.booleans()), min_size=1, max_size=60), st.integers(0, 10))
def test_average_precision(spark, dets, missed):
    tp = sum(x for _, x in dets)
    gt = max(tp + missed, 1)
    rows = [(0, f"img{i:03d}", i, c / 100, t) for i, (c, t) in enumerate(dets)]
    scored = spark.createDataFrame(rows, "class_id int, image_id string, det_idx int, confidence double, is_tp boolean")
    counts = spark.createDataFrame([(0, gt)], "class_id int, gt_count int")
    curve = curves.pr_curve(scored, counts, ["class_id"])
    order = sorted(dets_i for dets_i in range(len(dets)))
    order.sort(key=lambda i: -dets[i][0])
    prec, rec, n = [], [], 0
    for k, i in enumerate(order, 1):
        n += dets[i][1]
        prec.append(n / k)
        rec.append(n / gt)
    want11 = sum(max([q for q, r_ in zip(prec, rec) if r_ >= t / 10.0], default=0.0) for t in range(11)) / 11
    steps = [(rec[k] - (rec[k - 1] if k else 0.0)) * max(prec[k:]) for k in range(len(rec))]
    assert abs(curves.average_precision(curve, ["class_id"]).first().ap - want11) < 1e-9
    assert abs(curves.average_precision_all_points(curve, ["class_id"]).first().ap - sum(steps)) < 1e-9


def test_scores(spark):
    rows = [(0, 0, 0), (0, 5, 3), (4, 1, 0), (3, 3, 3)]
    out = with_prf(spark.createDataFrame(rows, "tp int, fp int, fn int")).collect()
    assert [(r.precision, r.recall) for r in out] == [(0, 0), (0, 0), (0.8, 1.0), (0.5, 0.5)]
    gap, rel = count_error(F.col("e"), F.col("a"))
    errs = spark.createDataFrame([(0, 0), (0, 2), (4, 3)], "e int, a int").select(gap.alias("g"), rel.alias("r")).collect()
    assert [(r.g, r.r) for r in errs] == [(0, 0.0), (2, float("inf")), (1, 0.25)]


def test_label_lines(spark):
    rnd = random.Random(3)
    vals = [(i % 8, *(rnd.choice([rnd.random(), k / 1280, 0.5]) for k in range(4))) for i in range(200)]
    df = spark.createDataFrame(vals, "c int, x double, y double, w double, h double")
    line = labels.render_line(F.col("c"), *[F.col(k) for k in "xywh"])
    for r in df.select("*", line.alias("l")).select("*", labels.parse_line(F.col("l")).alias("v")).collect():
        assert r.l == f"{r.c} {r.x:.6f} {r.y:.6f} {r.w:.6f} {r.h:.6f}"
        assert r.v.class_id == r.c and abs(r.v.cx - r.x) < 1e-6
    bad = spark.createDataFrame([("1 2 3",), ("a 1 1 1 1",), ("1 1 1 1 1 9",), ("",)], "l string")
    assert bad.where(labels.parse_line(F.col("l")).isNotNull()).count() == 0
    assert bad.where(labels.parse_line(F.col("l"), strict=False).isNotNull()).count() == 1


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n0 0.5 0.5 0.25 0.5\n\nbad line\n")
    (tmp_path / "b.txt").write_text("# no detections\n")
    images = spark.createDataFrame([("a", 640, 480), ("b", 640, 480), ("c", 640, 480)], "image_id string, width int, height int")
    lines = label_files.read_lines(spark, str(tmp_path))
    boxes = label_files.parse(lines, images).collect()
    assert [(b.image_id, b.x1, b.y1, b.x2, b.y2) for b in boxes] == [("a", 240.0, 120.0, 400.0, 360.0)]
    got = {r.image_id: (r.boxes, r.bad_lines, r.skipped) for r in label_files.scan_summary(lines, images).collect()}
    assert got == {"a": (1, 1, False), "b": (0, 0, False), "c": (0, 0, True)}


def test_annotation_files(spark, tmp_path):
    doc = {
        "video_path": "/v/clip7.mp4",
        "events": [
            {"type": "intrusion", "time_range": [2, 8], "class_name": "person"},
            {"type": "counting", "expected_in": 2, "expected_out": 1, "by_class": {"person": {"in": 2, "out": 1}}},
        ],
    }
    (tmp_path / "clip7.json").write_text(json.dumps(doc))
    docs = readers.video_annotations(spark, str(tmp_path))
    assert docs.first().fps_sample == 5.0
    t = readers.annotation_truth(docs).collect()
    assert [(r.video, r.gt_idx, r.type, r.t_start, r.t_end) for r in t][0] == ("clip7", 0, "intrusion", 2.0, 8.0)
    assert [tuple(r) for r in readers.expected_counts(docs).collect()] == [("clip7", "*", 2, 1), ("clip7", "person", 2, 1)]


def test_epoch_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("   epoch,  train/box_loss, metrics/mAP50(B)\n  1, 0.5, 0.25\n 2, 0.25, x\n")
    rows = readers.epoch_metrics(spark, str(tmp_path)).collect()
    assert [(r.epoch, r.train_box_loss, r.metrics_mAP50_B) for r in rows] == [(1, 0.5, 0.25), (2, 0.25, None)]


def test_alert_sink(spark, tmp_path):
    ms = 1_704_067_200_000
    e = spark.createDataFrame([("x", "anomaly", "cam0", ms, 3), ("y", None, "cam1", ms - 1, 4)], "alert_id string, type string, camera_id string, ts_ms bigint, zone int")
    sinks.write_alerts(e, str(tmp_path / "s"))
    rows = {r.alert_id: r for r in readers.alert_store(spark, str(tmp_path / "s")).collect()}
    assert rows["y"].type == "unknown" and rows["y"].track_id == -1 and json.loads(rows["x"].extra) == {"zone": 3}
    assert {str(r.event_date) for r in rows.values()} == {"2024-01-01", "2023-12-31"}
    assert sinks.drop_old_dates(spark, str(tmp_path / "s"), "2024-01-01") == ["event_date=2023-12-31"]


def test_config(spark):
    cfg = {"cameras": [{"id": "c1", "rules": {"intrusion": {"enabled": True, "cooldown": 5.0}, "anomaly": {"crowd": {"enabled": True}}}}]}
    dim = {r.rule: (r.enabled, json.loads(r.settings)) for r in readers.rule_dim(spark, cfg).collect()}
    assert dim["intrusion"] == (True, {"enabled": True, "confirm_frames": 5, "cooldown": 5.0})
    assert dim["crowd"][1]["max_count"] == 5 and not dim["dwell"][0]


def test_confusion_totals(spark):
    d = spark.createDataFrame([("a", 0, 0, 0.9, 0.0, 0.0, 9.0, 9.0), ("a", 1, 5, 0.8, 50.0, 50.0, 60.0, 60.0)], "image_id string, det_idx bigint, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame([("a", 0, 0, 0.0, 0.0, 9.0, 9.0), ("a", 1, 2, 20.0, 0.0, 29.0, 9.0)], "image_id string, gt_idx bigint, class_id int, x1 double, y1 double, x2 double, y2 double")
    m = ev.match_boxes(d, t)
    cells = {(r.gt_class, r.pred_class): r.n for r in ev.confusion_matrix(d, t, m).collect()}
    assert len(cells) == 9 and cells[(0, 0)] == 1 and cells[(2, -1)] == 1 and cells[(-1, -1)] == 1 and sum(cells.values()) == 3
