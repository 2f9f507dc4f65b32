"""Streaming forms of the rules: the same conditions as the batch rules, with keyed state.

Conditions that look at one row (region, class, confidence) stay native filters in front of the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import pose
from ..schema import VEHICLES, WATCHED_CLASS_IDS
from . import judges
from .frames import judged
from .ordered import in_order

TRACK = ["camera_id", "track_id"]


def timed(stream: DataFrame, delay: str = "10 seconds", ms: str = "frame_ms") -> DataFrame:
    """Event time and watermark."""
    return stream.withColumn("ts", F.timestamp_millis(ms)).withWatermark("ts", delay)


def _ms(seconds: float) -> int:
    return int(round(seconds * 1000))


def _spaced(wait_ms: int):
    """Greedy spacing as a step; keeps the time of the last firing in ``fired``."""

    def ok(state: dict, ms: int) -> bool:
        last = state.get("fired")
        return last is None or ms - last >= wait_ms

    return ok


def cooldown(stream: DataFrame, keys: Sequence[str], wait_ms: int, time: str = "frame_ms", order: Sequence[str] = ("frame_ms", "frame_seq", "det_idx")) -> DataFrame:
    """Greedy spacing. A key that is quiet for three waits is forgotten, which changes nothing."""
    ok = _spaced(wait_ms)

    def step(state: dict, row: dict) -> tuple[dict, bool]:
        return ({"fired": row[time]}, True) if ok(state, row[time]) else (state, False)

    return in_order(stream, keys, step, "fired bigint", time=time, order=order, keep_ms=3 * wait_ms)


def presence(detections: DataFrame, roi=None, wait_s: float = 10.0, min_confidence: float = 0.5, classes: Sequence[int] = WATCHED_CLASS_IDS) -> DataFrame:
    seen = detections.where((F.col("track_id") >= 0) & F.col("class_id").isin(*classes) & (F.col("confidence") >= min_confidence))
    if roi:
        seen = seen.withColumn("cx", (F.col("x1") + F.col("x2")) / 2).where(g.in_polygon("cx", "y2", roi)).drop("cx")
    return cooldown(seen, TRACK, int(wait_s * 1000))


def _placed(detections: DataFrame) -> DataFrame:
    return detections.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def _inside(detections: DataFrame, roi) -> DataFrame:
    held = _placed(detections.where("track_id >= 0"))
    return held.where(g.in_polygon("cx", "y2", roi)) if roi else held


def intrusion(detections: DataFrame, frames: DataFrame, roi, confirm: int = 5, wait_s: float = 30.0) -> DataFrame:
    """Foot inside the region in ``confirm`` consecutive processed frames."""
    return judged(_inside(detections, roi), frames, judges.Unbroken(confirm, _ms(wait_s)))


def dwell(
    detections: DataFrame, frames: DataFrame, roi=None, max_seconds: float = 120.0, confirm: int = 5, wait_s: float = 60.0
) -> DataFrame:
    """Visible without a break for ``max_seconds``; adds ``dwell_ms``."""
    return judged(_inside(detections, roi), frames, judges.Staying(_ms(max_seconds), confirm, _ms(wait_s)))


def visits(detections: DataFrame, frames: DataFrame, roi=None, keep_s: float = 3600.0) -> DataFrame:
    """``start_ms, end_ms, n_frames`` of each unbroken visibility of a track, once it is over (see ``rules.visits``)."""
    out = judged(_inside(detections, roi), frames, judges.Visits(_ms(keep_s)))
    return out.select("camera_id", "track_id", "start_ms", "end_ms", "n_frames")


def proximity(
    detections: DataFrame, frames: DataFrame, roi=None, min_distance: float = 50.0, confirm: int = 3, wait_s: float = 30.0, keep_s: float = 300.0
) -> DataFrame:
    """A person and a vehicle stay closer than ``min_distance`` over ``confirm`` shared frames in a row."""
    seen = _inside(detections, roi).where(F.col("class_name").isin("person", *VEHICLES))
    out = judged(seen, frames, judges.Close(min_distance, confirm, _ms(wait_s), max(_ms(keep_s), 3 * _ms(wait_s))))
    pair = [f.split()[0] for f in judges.Close.adds.split(", ")]
    return out.select("camera_id", "frame_seq", "frame_ms", *pair)


def _persons(detections: DataFrame, roi) -> DataFrame:
    return _inside(detections, roi).where("class_name = 'person'")


def crowd(
    detections: DataFrame, frames: DataFrame, roi=None, max_count: int = 5, radius: float = 200.0, confirm: int = 5, wait_s: float = 60.0, keep_s: float = 300.0
) -> DataFrame:
    """More than ``max_count`` persons within ``radius`` of one of them; one firing per frame."""
    return judged(_persons(detections, roi), frames, judges.Crowding(max_count, radius, confirm, _ms(wait_s), max(_ms(keep_s), 3 * _ms(wait_s))))


def fight(
    detections: DataFrame, frames: DataFrame, roi=None, radius: float = 150.0, min_speed: float = 60.0, min_persons: int = 2, confirm: int = 3,
    wait_s: float = 30.0, keep_s: float = 300.0,
) -> DataFrame:
    """A fast person with enough others near; one firing per frame. Wrists count where the detections have ``keypoints``."""
    persons = _persons(detections, roi)
    hands = pose.wrists(F.col("keypoints")) if "keypoints" in detections.columns else F.lit(None).cast("array<struct<x:double,y:double>>")
    persons = persons.withColumn("hands", hands)
    persons = persons.withColumns({f"h{i + 1}_{a}": F.get("hands", F.lit(i))[a].cast("double") for i in (0, 1) for a in "xy"}).drop("hands")
    out = judged(persons, frames, judges.Fighting(radius, min_speed, min_persons, confirm, _ms(wait_s), max(_ms(keep_s), 3 * _ms(wait_s))))
    return out.drop("h1_x", "h1_y", "h2_x", "h2_y")


def fall(
    detections: DataFrame, frames: DataFrame, roi=None, ratio_threshold: float = 1.0, min_ratio_change: float = 0.5, min_y_drop: float = 20.0, confirm: int = 2,
    wait_s: float = 30.0, keep_s: float = 300.0,
) -> DataFrame:
    """Lying, fallen by key points, or suddenly wider and lower. Key points count where the detections have ``keypoints``."""
    fallen = pose.is_fallen(F.col("keypoints")) if "keypoints" in detections.columns else F.lit(False)
    persons = _persons(detections, roi).withColumns({"ratio": g.aspect_ratio(g.box()), "fallen": fallen})
    judge = judges.Falling(ratio_threshold, min_ratio_change, min_y_drop, confirm, _ms(wait_s), max(_ms(keep_s), 3 * _ms(wait_s)))
    return judged(persons, frames, judge).drop("fallen")


def tripwire(detections: DataFrame, frames: DataFrame, wires: Sequence[tuple]) -> DataFrame:
    """Tracked and untracked crossings (``method``) of ``wires``, configuration rows as of ``operators.tripwire.wires``."""
    return judged(_placed(detections), frames, judges.Wires(wires))


def _moving(detections: DataFrame, hit, confirm: int, wait_s: float, keep_s: float) -> DataFrame:
    """Rules on the step since the track was last seen: hit(dx, dist, dt_ms), None when it is no observation.

    A track not seen for ``keep_s`` (three waits at least) starts anew and leaves no state behind.
    """
    ok = _spaced(int(wait_s * 1000))

    def step(state: dict, row: dict) -> tuple[dict, bool]:
        x, y, ms = (row["x1"] + row["x2"]) / 2, (row["y1"] + row["y2"]) / 2, row["frame_ms"]
        new = {"x": x, "y": y, "ms": ms, "run": state.get("run") or 0, "fired": state.get("fired")}
        if state.get("ms") is None:
            return new, False
        dx, dy = x - state["x"], y - state["y"]
        seen = hit(dx, (dx * dx + dy * dy) ** 0.5, ms - state["ms"])
        if seen is None:
            return new, False
        new["run"] = new["run"] + 1 if seen else 0
        fire = bool(seen) and new["run"] >= confirm and ok(new, ms)
        if fire:
            new["fired"] = ms
        return new, fire

    return in_order(
        detections.where("track_id >= 0"), TRACK, step, "x double, y double, ms bigint, run bigint, fired bigint",
        keep_ms=max(_ms(keep_s), 3 * _ms(wait_s)),
    )


def speed(detections: DataFrame, max_pixel_speed: float = 100.0, confirm: int = 3, wait_s: float = 30.0, keep_s: float = 300.0) -> DataFrame:
    return _moving(detections, lambda dx, d, dt: d / (dt / 1000.0) > max_pixel_speed if dt > 0 else None, confirm, wait_s, keep_s)


def wrong_way(detections: DataFrame, expected: str = "positive", confirm: int = 5, wait_s: float = 60.0, keep_s: float = 300.0) -> DataFrame:
    hit = (lambda dx, d, dt: dx < -5) if expected == "positive" else (lambda dx, d, dt: dx > 5)
    return _moving(detections, hit, confirm, wait_s, keep_s)


def silence(rows: DataFrame, limit_ms: int, keys: Sequence[str] = ("camera_id",)) -> DataFrame:
    """First row after a silence longer than ``limit_ms``; adds ``gap_ms``."""

    def step(state: dict, row: dict) -> tuple[dict, bool]:
        gap = row["frame_ms"] - state["last"] if state.get("last") is not None else 0
        return {"last": row["frame_ms"], "gap": gap}, gap > limit_ms

    return in_order(
        rows, keys, step, "last bigint, gap bigint", order=("frame_ms", "frame_seq"), add="gap_ms bigint",
        emit=lambda s, r: {**r, "gap_ms": s["gap"]},
    )
