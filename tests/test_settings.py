"""Settings as data: one plan for any number of cameras, each camera by its own settings."""

import json

from pyspark.sql import functions as F

from scenestream.catalog.rules import sample_cameras
from scenestream.operators import rules as r
from scenestream.operators import sequence as q
from scenestream.plans import ruleset
from scenestream.plans.ruleset import Camera, rule_plans
from scenestream.sources import projection as p
from tests.conftest import SF


def cameras(n):
    """The sample cameras with settings of their own, and more that see nothing."""
    base, out = sample_cameras()[0], []
    for i in range(n):
        rules = json.loads(json.dumps(base.rules))
        for name, s in rules.items():
            s["cooldown"] = 0.4 + 0.6 * (i % 4)
            if "confirm_frames" in s:
                s["confirm_frames"] = 1 + i % 3
        rules["proximity"]["min_distance"] = 120.0 + 40 * i
        rules["crowd"] |= {"radius": 300.0 + 60 * i, "max_count": 1 + i % 2}
        rules["fight"] |= {"proximity_radius": 300.0 + 60 * i, "min_speed": 60.0 + 5 * (i % 4), "min_persons": 2}
        rules["wrong_way"]["expected_direction"] = "positive" if i % 2 else "negative"
        rules["speed"]["enabled"] = i != 2
        if i % 2:
            rules["time_period"] = {"enabled": True, "start": "00:00", "end": "00:00" if i == 1 else "23:59", "days": list(range(7))}
        out.append(Camera(f"cam{i}", rules, base.roi, base.tripwires if i != 3 else (), base.alert_types, base.zone))
    return out


def rows(df):
    return sorted((a.alert_id, a.type, a.sub_type, a.camera_id, a.ts_ms, a.track_id, a.detail, a.extra, a.is_alert) for a in df.collect())


def test_each_camera_by_its_own_settings(spark):
    spark.conf.set("spark.scenestream.sliceMs", "20000")
    det, frm = p.detections(spark, SF).where("frame_seq < 250"), p.frames(spark, SF).where("frame_seq < 250")
    together = {k: rows(df) for k, df in rule_plans(det, frm, cameras(4)).items()}
    apart: dict[str, list] = {}
    asked = cameras(4)[1:3]  # one with hours, one without a rule
    together = {k: [a for a in v if a[3] in ("cam1", "cam2")] for k, v in together.items()}
    for c in asked:
        only = F.col("camera_id") == c.camera_id
        for k, df in rule_plans(det.where(only), frm.where(only), [c]).items():
            apart.setdefault(k, []).extend(rows(df))
    spark.conf.set("spark.scenestream.sliceMs", "600000")
    assert set(together) == set(apart) and len(together) == 10
    for k, found in together.items():
        assert found == sorted(apart[k]), k
    assert sum(bool(v) for v in together.values()) >= 8
    assert not any(a[3] == "cam2" for a in together["speed"])


def plan_size(df):
    return df._jdf.queryExecution().analyzed().toString().count("\n")


def test_one_plan_for_any_number_of_cameras(spark):
    det, frm = p.detections(spark, SF).where("frame_seq < 40"), p.frames(spark, SF).where("frame_seq < 40")
    for rule in ("intrusion", "crowd", "proximity", "speed"):
        sizes = []
        for n in (4, 4000):
            some = [Camera(c.camera_id, {rule: c.rules[rule]} | {"time_period": c.rules.get("time_period")}, c.roi, (), c.alert_types, c.zone) for c in cameras(n)]
            sizes.append(plan_size(rule_plans(det, frm, some)[rule]))
        assert sizes[0] == sizes[1], rule


def test_columns_equal_numbers(spark):
    """Cooldown and confirmation by a column give what each key's number gives; no wait keeps all."""
    spark.conf.set("spark.scenestream.sliceMs", "3000")
    obs = r.watch(p.detections(spark, SF, keypoints=False), p.frames(spark, SF), p.ROI).where("track_id >= 0").cache()
    wait, confirm = F.expr("track_id % 4 * 700"), F.expr("int(1 + track_id % 3)")
    obs = obs.withColumn("hit", F.expr("cx < 900"))

    def key(df):
        return sorted((x.camera_id, x.track_id, x.frame_seq, x.det_idx) for x in df.select("camera_id", "track_id", "frame_seq", "det_idx").collect())

    def each(fn, k):
        out = []
        for v in range(k):
            out += key(fn(obs.where(f"track_id % {k} = {v}"), v))
        return sorted(out)

    assert key(q.cooldown(obs, r.TRACK, wait, order=["det_idx"])) == each(lambda o, v: q.cooldown(o, r.TRACK, v * 700, order=["det_idx"]), 4)
    assert key(q.confirmed(obs, r.TRACK, q.ORDER, "hit", confirm, 3)) == each(lambda o, v: q.confirmed(o, r.TRACK, q.ORDER, "hit", v + 1), 3)
    inside = obs.where("in_roi")
    got = key(q.confirmed_unbroken(inside, r.TRACK, confirm, longest=3))
    assert got == sorted(sum((key(q.confirmed_unbroken(inside.where(f"track_id % 3 = {v}"), r.TRACK, v + 1)) for v in range(3)), []))
    spark.conf.set("spark.scenestream.sliceMs", "600000")
    obs.unpersist()


def test_settings_cover_what_the_rules_read():
    import inspect
    import re

    for rule, build in {**ruleset.ALWAYS, **ruleset.ANOMALY}.items():
        read = set(re.findall(r's\["(\w+)"\]', inspect.getsource(build))) - {"longest"}
        assert read == {f.split()[0] for f in ruleset.SETTINGS[rule].split(", ")}
