"""Invariants over many random cases at once, each case a key of one table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scenestream.operators import boxes, matching, neighbours
from scenestream.operators.matching import THRESHOLDS
from scenestream.plans import evaluation

RNG = random.Random(23)
EVENT = "video string, type string, sub_type string, "


def greedy(pairs):
    used_p, used_g, out = set(), set(), set()
    for d, p, g in sorted(pairs):
        if p not in used_p and g not in used_g:
            used_p.add(p)
            used_g.add(g)
            out.add((p, g))
    return out


@pytest.fixture(scope="module")
def events():
    """Sparse and crowded videos, ties, repeated times, instants, durations of very different length, chains of ever closer pairs."""
    pred, truth = [], []
    for v in range(120):
        span = RNG.choice([5, 50, 2000])
        for i in range(RNG.randint(0, 25)):
            pred.append((f"v{v}", "intrusion", "", i, float(RNG.randint(0, span))))
        for i in range(RNG.randint(0, 15)):
            at = float(RNG.randint(0, span))
            lasting = RNG.random() < 0.4
            truth.append((f"v{v}", "intrusion", "", i, None if lasting else at, at if lasting else None, at + RNG.choice([0, 1, 30, 900]) if lasting else None))
    for i in range(12):  # p0 g0 p1 g1 ... each pair closer than the one before
        pred.append(("chain", "intrusion", "", i, 100.0 + 3 * i - 0.01 * i * i))
        truth.append(("chain", "intrusion", "", i, 101.5 + 3 * i - 0.01 * i * i - 0.05, None, None))
    return pred, truth


def test_event_matches(spark, events):
    """One to one, and those of the plain greedy walk."""
    pred, truth = events
    p = spark.createDataFrame(pred, EVENT + "pred_idx bigint, t double")
    t = spark.createDataFrame(truth, EVENT + "gt_idx bigint, time_sec double, t_start double, t_end double")
    got = {}
    rows = matching.match_events(p, t, ["video"], 2.0).collect()
    for r in rows:
        got.setdefault(r["video"], []).append((r["pred_idx"], r["gt_idx"]))
    for v in {x[0] for x in pred + truth}:
        pairs = []
        for _, _, _, i, at in (x for x in pred if x[0] == v):
            for _, _, _, j, when, lo, hi in (x for x in truth if x[0] == v):
                a, b = (lo, hi) if lo is not None else (when, when)
                if a - 2 <= at <= b + 2:
                    pairs.append((abs(at - (a + b) / 2), i, j))
        mine = got.get(v, [])
        assert len({m[0] for m in mine}) == len({m[1] for m in mine}) == len(mine)
        assert set(mine) == greedy(pairs), v
    misses = evaluation.event_misses(p, t, 2.0).groupBy("kind").count().collect()
    kinds = {r["kind"]: r["count"] for r in misses}
    have = {x[0] for x in truth}
    assert kinds == {"fn": len(truth) - len(rows), "fp": sum(x[0] in have for x in pred) - len(rows)}


def test_boxes_at_all_thresholds(spark):
    """Flags of one walk equal the matches of each threshold; per image, matches never exceed either side, and confusion adds up."""
    def some(n, image, idx):
        out = []
        for i in range(n):
            x, y = RNG.randint(0, 40), RNG.randint(0, 40)
            out.append((image, i, RNG.randint(0, 1), RNG.randint(1, 4) / 4, float(x), float(y), float(x + RNG.randint(5, 30)), float(y + RNG.randint(5, 30))))
        return out

    dets = [r for k in range(60) for r in some(RNG.randint(0, 8), f"i{k}", "det_idx")]
    truth = [r for k in range(60) for r in some(RNG.randint(0, 6), f"i{k}", "gt_idx")]
    box = "class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
    d, t = spark.createDataFrame(dets, f"image_id string, det_idx bigint, {box}"), spark.createDataFrame(truth, f"image_id string, gt_idx bigint, {box}").drop("confidence")
    flags = {(r["image_id"], r["det_idx"], l) for r in matching.match_levels(d, t).collect() for l, h in enumerate(r["hits"]) if h}
    for level in (0, 3, 9):
        want = {(r["image_id"], r["det_idx"], level) for r in matching.match_boxes(d, t, THRESHOLDS[level], by_class=True).collect()}
        assert {f for f in flags if f[2] == level} == want
    m = matching.match_boxes(d, t, 0.5)
    images = evaluation.per_image(d, t, m).collect()
    assert all(r["tp_count"] <= min(r["gt_count"], r["det_count"]) for r in images)
    cells = evaluation.confusion_matrix(d, t, m)
    total = {r["gt_class"]: r["n"] for r in cells.groupBy("gt_class").agg(F.sum("n").alias("n")).collect()}
    assert all(total[c] == sum(x[2] == c for x in truth) for c in {x[2] for x in truth})
    assert cells.agg(F.sum("n")).first()[0] == len(dets) + len(truth) - m.count()


def test_merged_boxes_are_a_fixpoint(spark):
    rows = []
    for k in range(80):
        for i in range(RNG.randint(1, 9)):
            x, y, w, h = RNG.randint(0, 300), RNG.randint(0, 300), RNG.randint(1, 60), RNG.randint(1, 60)
            rows.append(("c", k, i, float(x), float(y), float(x + w), float(y + h), float(w * h)))
    ddl = "camera_id string, frame_seq bigint, box_idx bigint, x1 double, y1 double, x2 double, y2 double, area double"
    once = boxes.merge_boxes(spark.createDataFrame(rows, ddl), 20.0)
    merged = once.collect()
    apart = lambda a, b: a["x1"] - 20 > b["x2"] or b["x1"] - 20 > a["x2"] or a["y1"] - 20 > b["y2"] or b["y1"] - 20 > a["y2"]
    for k in range(80):
        own = [r for r in merged if r["frame_seq"] == k]
        assert sum(r["area"] for r in own) == sum(r[7] for r in rows if r[1] == k)
        assert all(apart(a, b) for a in own for b in own if a["box_idx"] < b["box_idx"])
    again = boxes.merge_boxes(once, 20.0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, merged))


def test_near_pairs_by_a_column(spark):
    """A radius of each camera's own finds what plain distances find."""
    ddl = "camera_id string, {0}_idx bigint, {0}_x double, {0}_y double, s_radius double"
    make = lambda: [(f"c{k}", i, RNG.uniform(0, 200), RNG.uniform(0, 200), 10.0 + 30 * k) for k in range(3) for i in range(25)]
    a, b = make(), make()
    got = neighbours.near_pairs(spark.createDataFrame(a, ddl.format("p")), spark.createDataFrame(b, ddl.format("v")), ["camera_id"], F.col("s_radius"), ("p_x", "p_y"), ("v_x", "v_y"))
    want = {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and math.sqrt((x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2) < x[4]}
    assert {(r["camera_id"], r["p_idx"], r["v_idx"]) for r in got.collect()} == want and want
