"""Ordered operators against plain Python, with short and with long slices."""

import random

import pytest
from pyspark.sql import functions as F

from scenestream.operators import flow, sequence as q


@pytest.fixture(params=["spark", "short_slices"])
def mode(request):
    return request.getfixturevalue(request.param)


def make(spark, n=600, seed=1):
    """Random sightings of three keys over a minute; one key holds most of them."""
    rnd = random.Random(seed)
    rows, seqs = [], {}
    for _ in range(n):
        k = rnd.choices([1, 2, 3], [8, 1, 1])[0]
        seqs.setdefault(k, set()).add(rnd.randrange(0, 300))
    for k, ss in seqs.items():
        rows += [("cam0", k, s, s * 200, 1, float(rnd.randrange(0, 60)), rnd.random() < 0.6) for s in sorted(ss)]
    df = spark.createDataFrame(rows, "camera_id string, track_id bigint, frame_seq bigint, frame_ms bigint, det_idx bigint, cx double, hit boolean")
    df = df.withColumn("prev_seq", F.col("frame_seq") - 1)
    return q.with_slice(df), rows


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_link_rows(mode):
    df, rows = make(mode)
    memo = F.when(F.col("cx") > 30, F.col("cx"))
    got = q.link_rows(df, ["camera_id", "track_id"], ["frame_seq"], ["frame_seq", "prev_seq", "cx"], q.same_spell, memo=memo)
    got = {(r.track_id, r.frame_seq): (r.prev.frame_seq if r.prev else None, r.linked, r.spell_ms, r.memo) for r in got.collect()}
    want = {}
    for k, rs in by_key(rows).items():
        last, spell, note = None, None, None
        for r in rs:
            linked = last is not None and last == r[2] - 1
            if not linked:
                spell, note = r[3], None
            want[(k, r[2])] = (last, linked, spell, note)
            if r[5] > 30:
                note = r[5]
            last = r[2]
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 4])
def test_confirmed(mode, n):
    df, rows = make(mode, seed=n)
    got = {(r.track_id, r.frame_seq) for r in q.confirmed(df, ["camera_id", "track_id"], ["frame_seq"], "hit", n).collect()}
    want = set()
    for k, rs in by_key(rows).items():
        run = 0
        for r in rs:
            run = run + 1 if r[6] else 0
            if run >= n:
                want.add((k, r[2]))
    assert got == want and want


@pytest.mark.parametrize("n", [2, 3])
def test_confirmed_unbroken(mode, n):
    df, rows = make(mode, seed=n + 10)
    got = {(r.track_id, r.frame_seq) for r in q.confirmed_unbroken(df.where("hit"), ["camera_id", "track_id"], n).collect()}
    want = set()
    for k, rs in by_key(rows).items():
        run, last = 0, None
        for r in rs:
            if not r[6]:
                run = 0
                continue
            run = run + 1 if run and last == r[2] - 1 else 1
            last = r[2]
            if run >= n:
                want.add((k, r[2]))
    assert got == want and want


@pytest.mark.parametrize("wait,width", [(400, 1000), (1000, 1000), (2500, 1000), (999, 60_000), (700, 3000)])
def test_cooldown(spark, wait, width):
    df, rows = make(spark, n=900, seed=wait)
    got = sorted((r.track_id, r.frame_seq) for r in q.cooldown(df, ["camera_id", "track_id"], wait, slice_width=width).collect())
    want = []
    for k, rs in by_key(rows).items():
        fired = None
        for r in rs:
            if fired is None or r[3] - fired >= wait:
                fired = r[3]
                want.append((k, r[2]))
    assert got == sorted(want)


def test_running(mode):
    df, rows = make(mode, n=400)
    up = q.running(df, ["track_id"], ["frame_seq"], {"s": F.col("cx"), "n": F.lit(1).cast("bigint")})
    down = q.running(df, ["track_id"], ["frame_seq"], {"m": F.col("cx")}, how="max", reverse=True)
    before = q.running(df, ["track_id"], ["frame_seq"], {"m": F.col("cx")}, how="max", exclusive=True)
    got_up = {(r.track_id, r.frame_seq): (round(r.s, 3), r.n) for r in up.collect()}
    got_down = {(r.track_id, r.frame_seq): r.m for r in down.collect()}
    got_before = {(r.track_id, r.frame_seq): r.m for r in before.collect()}
    for k, rs in by_key(rows).items():
        vals = [r[5] for r in rs]
        for i, r in enumerate(rs):
            assert got_up[(k, r[2])] == (round(sum(vals[: i + 1]), 3), i + 1)
            assert got_down[(k, r[2])] == max(vals[i:])
            assert got_before[(k, r[2])] == (max(vals[:i]) if i else None)


def test_processed_frames(mode):
    rnd = random.Random(5)
    frames = [("cam0", s, s * 200, rnd.random() < 0.4) for s in range(300)]
    df = mode.createDataFrame(frames, "camera_id string, frame_seq bigint, frame_ms bigint, has_motion boolean")
    got = {r.frame_seq: r.prev_seq for r in q.processed_frames(df).collect()}
    seen = [f[1] for f in frames if f[3]]
    assert got == dict(zip(seen, [None, *seen[:-1]]))


def test_trailing_and_gaps(spark):
    rnd = random.Random(8)
    rows = [("cam0", rnd.randrange(0, 200_000), rnd.choice(["in", "out"]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "camera_id string, frame_ms bigint, direction string, i bigint")
    got = {r.i: (r.window_in, r.window_out) for r in flow.flow_trailing(df, 10, stretch_ms=15_000).collect()}
    for _, ms, _, i in rows:
        near = [d for _, m, d, _ in rows if ms - 10_000 <= m <= ms]
        assert got[i] == (near.count("in"), near.count("out"))
    times = sorted(r[1] for r in rows)
    want = sorted((a, b) for a, b in zip(times, times[1:]) if b - a > 2000)
    assert sorted((r.last_ms, r.next_ms) for r in flow.gaps(df, 2000, stretch_ms=5000).collect()) == want


def test_frame_decides_on_time(short_slices):
    """A detection stamped past the end of its frame's slice stays with its frame; a counter that restarts keeps time order."""
    frames = short_slices.createDataFrame(
        [("c", 10, 2999, True), ("c", 11, 3199, True), ("c", 1, 6200, True), ("c", 2, 6400, True)], "camera_id string, frame_seq bigint, frame_ms bigint, has_motion boolean"
    )
    dets = short_slices.createDataFrame(
        [("c", 10, 3000, 0, 7, 0.0), ("c", 11, 3199, 0, 7, 1.0), ("c", 1, 6200, 0, 7, 2.0), ("c", 2, 6400, 0, 7, 3.0)],
        "camera_id string, frame_seq bigint, frame_ms bigint, det_idx bigint, track_id bigint, cx double",
    )
    obs = q.observe(dets, frames)
    assert sorted((r.frame_seq, r.frame_ms, r.prev_seq) for r in obs.collect()) == [(1, 6200, 11), (2, 6400, 1), (10, 2999, None), (11, 3199, 10)]
    steps = q.link_rows(obs, ["camera_id", "track_id"], q.ORDER, ["frame_ms", "cx"]).where("prev is not null")
    assert sorted((r.frame_seq, r.frame_ms - r.prev.frame_ms) for r in steps.collect()) == [(1, 3001), (2, 200), (11, 200)]


def test_long_cooldown_chain(spark):
    """One key that is never quiet, over many slices."""
    n = 20_000
    df = spark.range(n).selectExpr("'k' as k", "id * 500 as frame_ms")
    got = [r.frame_ms for r in q.cooldown(df, ["k"], 1200, slice_width=1000).orderBy("frame_ms").collect()]
    assert got == list(range(0, n * 500, 1500))
