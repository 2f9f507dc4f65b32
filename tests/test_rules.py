"""Order-dependent rules against plain Python models; short slices against long ones."""

import pytest
from pyspark.sql import functions as F

from scenestream.catalog.flow import wire_dim
from scenestream.catalog.rules import observations
from scenestream.operators import boxes as bx
from scenestream.operators import rules as r
from scenestream.operators import tripwire as tw
from scenestream.sources import projection as p
from tests.conftest import SF


def key(df, *cols):
    cols = cols or ("camera_id", "frame_seq", "det_idx")
    return sorted(tuple(x) for x in df.select(*cols).collect())


def frames_of(obs_rows, processed):
    """camera -> [(frame_seq, ms, [person rows])] over all processed frames."""
    per = {}
    for o in obs_rows:
        per.setdefault((o.camera_id, o.frame_seq), []).append(o)
    return {c: [(s, ms, sorted(per.get((c, s), []), key=lambda o: o.det_idx)) for s, ms in fs] for c, fs in processed.items()}


def scan(frames, least, confirm, wait, judge):
    """The rule loop as written down in the semantics: runs cleared below the head count, stop at a firing."""
    out = []
    for cam, fs in frames.items():
        runs, fired, before = {}, {}, {}
        for seq, ms, people in fs:
            hits = judge(people, ms, before)
            before = {o.track_id: (ms, o) for o in people}
            if len(people) < least:
                runs.clear()
                continue
            for o, hit in zip(people, hits):
                t = o.track_id
                runs[t] = runs.get(t, 0) + 1 if hit else 0
                if hit and runs[t] >= confirm and (t not in fired or ms - fired[t] >= wait):
                    fired[t] = ms
                    out.append((cam, seq, o.det_idx))
                    break
    return sorted(out)


@pytest.fixture(scope="module")
def people(spark):
    obs = r._persons(observations(spark, SF)).select("camera_id", "frame_seq", "frame_ms", "det_idx", "track_id", "cx", "cy").collect()
    processed = {}
    for f in p.frames(spark, SF).where("has_motion").orderBy("camera_id", "frame_seq").collect():
        processed.setdefault(f.camera_id, []).append((f.frame_seq, f.frame_ms))
    return frames_of(obs, processed)


def dist(a, b):
    return ((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) ** 0.5


@pytest.mark.parametrize("confirm,wait", [(1, 1.0), (2, 0.6), (3, 3.0)])
def test_crowd(short_slices, people, confirm, wait):
    def judge(rows, ms, before):
        return [1 + sum(o is not x and dist(o, x) < 600 for x in rows) > 1 for o in rows]

    want = scan(people, 2, confirm, int(wait * 1000), judge)
    got = r.crowd(observations(short_slices, SF), 1, 600.0, confirm, wait)
    assert key(got) == want and (want or confirm == 3)


def test_fight(short_slices, people):
    def judge(rows, ms, before):
        def fast(o):
            if o.track_id not in before:
                return 0.0
            t0, q = before[o.track_id]
            return dist(o, q) / ((ms - t0) / 1000)

        return [sum(o is not x and dist(o, x) < 600 for x in rows) >= 1 and fast(o) > 70 for o in rows]

    want = scan(people, 2, 2, 800, judge)
    obs = observations(short_slices, SF).withColumn("keypoints", F.lit(None).cast("array<struct<x:double,y:double,conf:double>>"))
    assert key(r.fight(obs, 600.0, 70.0, 2, 2, 0.8)) == want and want


def run_all(spark):
    o = observations(spark, SF, keypoints=True)
    w = wire_dim(spark)
    o.persist()
    out = {
        "intrusion": key(r.intrusion(o, 3, 1.0)),
        "dwell": key(r.dwell(o, 0.6, 3, 2.0)),
        "wrong_way": key(r.wrong_way(o, confirm=2, cooldown_s=1.0)),
        "fall": key(r.fall(o, confirm=1, cooldown_s=1.0)),
        "proximity": key(r.proximity(o, 400.0, 2, 1.0), "camera_id", "frame_seq", "p_idx", "v_idx"),
        "fight": key(r.fight(o, 600.0, 60.0, 2, 2, 1.0)),
        "crossings": key(tw.crossings(o, w), "camera_id", "frame_seq", "det_idx", "direction"),
        "stationary": key(bx.stationary(o, 24.0, 2, 3), "camera_id", "frame_seq", "det_idx", "still_frames"),
    }
    o.unpersist()
    return out


def test_slices_do_not_matter(spark, request):
    want = run_all(spark)
    got = run_all(request.getfixturevalue("short_slices"))
    for name, rows in want.items():
        assert got[name] == rows and rows, name


def test_merge_boxes(spark):
    rows = [("c", 1, 0, 0.0, 0.0, 10.0, 10.0, 100.0), ("c", 1, 1, 200.0, 0.0, 210.0, 10.0, 100.0), ("c", 1, 2, 100.0, 0.0, 160.0, 10.0, 600.0), ("c", 1, 3, 55.0, 0.0, 60.0, 5.0, 25.0), ("c", 2, 0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "camera_id string, frame_seq bigint, box_idx bigint, x1 double, y1 double, x2 double, y2 double, area double")
    got = sorted(tuple(x)[1:] for x in bx.merge_boxes(df, 50.0).collect())
    assert got == [(1, 0, 0.0, 0.0, 210.0, 10.0, 825.0), (2, 0, 0.0, 0.0, 1.0, 1.0, 1.0)]


def test_rule_set_is_union_of_rules(spark):
    from scenestream.catalog.rules import sample_cameras
    from scenestream.plans.ruleset import rule_plans

    plans = rule_plans(p.detections(spark, SF), p.frames(spark, SF), sample_cameras())
    assert set(plans) == {"intrusion", "presence", "dwell", "crowd", "proximity", "wrong_way", "speed", "fight", "fall", "tripwire"}
    intrusion = plans["intrusion"].collect()
    assert len(intrusion) == r.intrusion(observations(spark, SF), 2, 1.0).count()
    assert all(a.is_alert and a.type == "intrusion" for a in intrusion)
    assert not any(a.is_alert for a in plans["presence"].limit(20).collect())
