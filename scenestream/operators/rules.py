"""Alert rules over observations.

An observation is a detection on a processed frame (see ``sequence.observe``) with ``in_roi`` added by
``watch``. Every rule returns the observations at which it fires, plus its own columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import naming, pose
from ..schema import PRESENCE_LABELS, VEHICLES, WATCHED_CLASS_IDS
from ..session import cut
from .folds import first_in_frame
from .neighbours import near_pairs
from .sequence import (
    FRAME,
    ORDER,
    SLICE,
    confirmed,
    confirmed_unbroken,
    cooldown,
    link_rows,
    observe,
    same_spell,
)

TRACK = ["camera_id", "track_id"]


# A setting of a rule: one number for all cameras, or a column with that of each row's camera. Such columns are named ``s_...`` and stay
# with the rows of their camera.
Setting = float | Column


def seconds(s: Setting) -> int | Column:
    return F.round(s * 1000).cast("bigint") if isinstance(s, Column) else int(round(s * 1000))


def _settings(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("s_")]


def watch(detections: DataFrame, frames: DataFrame, roi: Sequence[Sequence[float]] | Column | None = None) -> DataFrame:
    """Observations with centre, foot and ``in_roi`` (NULL when there is no region)."""
    obs = observe(detections, frames).selectExpr("*", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy")
    if roi is None:
        inside = F.lit(None).cast("boolean")
    elif isinstance(roi, Column):
        inside = g.in_polygon_column((F.col("cx"), F.col("y2")), roi)
    else:
        inside = g.in_polygon("cx", "y2", roi)
    return obs.withColumn("in_roi", inside)


def tracked(obs: DataFrame) -> DataFrame:
    """Tracked observations inside the region; no region means the whole frame."""
    return obs.where((F.col("track_id") >= 0) & F.coalesce("in_roi", F.lit(True)))


def _persons(obs: DataFrame) -> DataFrame:
    return tracked(obs).where(F.col("class_name") == "person")


@dataclass(frozen=True)
class Rule:
    """A rule made of candidates, a confirmation and a cooldown per key.

    ``candidates`` maps observations to rows with a boolean ``hit``: one row per observation of the
    key. Subclass or instantiate to add rules; batch plans come from ``run``. Where the confirmation is a column, ``longest`` is
    its largest value.
    """

    name: str
    candidates: Callable[[DataFrame], DataFrame]
    confirm: Setting
    cooldown_s: Setting
    longest: int | None = None
    keys: Sequence[str] = field(default_factory=lambda: list(TRACK))
    order: Sequence[str] = tuple(ORDER)

    def run(self, obs: DataFrame) -> DataFrame:
        held = confirmed(self.candidates(obs), self.keys, self.order, "hit", self.confirm, self.longest).drop("hit")
        return cooldown(held, self.keys, seconds(self.cooldown_s), order=["det_idx"])


def intrusion(obs: DataFrame, confirm: Setting = 5, cooldown_s: Setting = 30.0, longest: int | None = None) -> DataFrame:
    """Foot inside the region in ``confirm`` consecutive processed frames."""
    inside = obs.where((F.col("track_id") >= 0) & F.col("in_roi"))
    return cooldown(confirmed_unbroken(inside, TRACK, confirm, longest=longest), TRACK, seconds(cooldown_s), order=["det_idx"])


def presence(
    obs: DataFrame,
    watch_classes: Sequence[int] = WATCHED_CLASS_IDS,
    cooldown_s: Setting = 10.0,
    min_confidence: Setting = 0.5,
) -> DataFrame:
    """A watched class is seen with enough confidence."""
    seen = tracked(obs).where(F.col("class_id").isin(*watch_classes) & (F.col("confidence") >= min_confidence))
    label = naming.label_of(F.col("class_id"), PRESENCE_LABELS, F.col("class_name"))
    return cooldown(seen, TRACK, seconds(cooldown_s), order=["det_idx"]).withColumn("label", label)


def visibility_spells(obs: DataFrame) -> DataFrame:
    """Tracked observations with the start (``spell_ms``) of their unbroken visibility."""
    return link_rows(tracked(obs), TRACK, ORDER, ["frame_seq", "prev_seq"], same_spell)


def visits(obs: DataFrame) -> DataFrame:
    """``start_ms, end_ms, n_frames`` of each unbroken visibility of a track."""
    spells = visibility_spells(obs).groupBy(*TRACK, F.col("spell_ms").alias("start_ms"))
    return spells.agg(F.max("frame_ms").alias("end_ms"), F.count("*").alias("n_frames"))


def dwell(obs: DataFrame, max_seconds: Setting = 120.0, confirm: Setting = 5, cooldown_s: Setting = 60.0, longest: int | None = None) -> DataFrame:
    """Visible without a break for at least ``max_seconds``."""

    def candidates(o: DataFrame) -> DataFrame:
        stay = F.col("frame_ms") - F.col("spell_ms")
        return (
            visibility_spells(o)
            .drop("prev", "linked")
            .withColumns({"dwell_ms": stay, "hit": stay >= seconds(max_seconds)})
        )

    return Rule("dwell", candidates, confirm, cooldown_s, longest).run(obs)


def steps(obs: DataFrame) -> DataFrame:
    """Tracked observations with the move since the track was last seen, however long ago."""
    s = link_rows(tracked(obs), TRACK, ORDER, ["frame_ms", "cx", "cy"])
    dx, dy = F.col("cx") - F.col("prev.cx"), F.col("cy") - F.col("prev.cy")
    return s.where("prev is not null").withColumns(
        {"dx": dx, "dt_ms": F.col("frame_ms") - F.col("prev.frame_ms"), "moved": F.sqrt(dx * dx + dy * dy)}
    )


def track_speed(obs: DataFrame) -> DataFrame:
    """Pixel speed per step; steps without elapsed time are no observation."""
    return (
        steps(obs)
        .where("dt_ms > 0")
        .withColumn("pixel_speed", F.col("moved") / (F.col("dt_ms") / F.lit(1000.0)))
        .drop("prev")
    )


def wrong_way(
    obs: DataFrame, expected: str | Column = "positive", confirm: Setting = 5, cooldown_s: Setting = 60.0, longest: int | None = None
) -> DataFrame:
    """Moves against the expected x direction by more than five pixels per step."""

    def candidates(o: DataFrame) -> DataFrame:
        right = (expected if isinstance(expected, Column) else F.lit(expected)) == "positive"
        against = F.when(right, F.col("dx") < -5).otherwise(F.col("dx") > 5)
        return steps(o).withColumn("hit", against).drop("prev")

    return Rule("wrong_way", candidates, confirm, cooldown_s, longest).run(obs)


def speed(obs: DataFrame, max_pixel_speed: Setting = 100.0, confirm: Setting = 3, cooldown_s: Setting = 30.0, longest: int | None = None) -> DataFrame:
    return Rule(
        "speed",
        lambda o: track_speed(o).withColumn("hit", F.col("pixel_speed") > max_pixel_speed),
        confirm,
        cooldown_s,
        longest,
    ).run(obs)


def proximity_pairs(obs: DataFrame, min_distance: Setting = 50.0) -> DataFrame:
    """Person and vehicle of one frame whose feet are closer than ``min_distance``."""
    p, v = _pair_sides(obs)
    return near_pairs(p, v, [*FRAME, "frame_ms"], min_distance, ("p_x", "p_y"), ("v_x", "v_y"))


def _pair_sides(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = tracked(obs)
    frame = FRAME

    def side(rows: DataFrame, k: str) -> DataFrame:
        return rows.select(
            *frame,
            "frame_ms",
            F.col("track_id").alias(f"{k}_track"),
            F.col("det_idx").alias(f"{k}_idx"),
            F.col("class_name").alias(f"{k}_class"),
            F.col("cx").alias(f"{k}_x"),
            F.col("y2").alias(f"{k}_y"),
            *_settings(rows),
        )

    return side(t.where("class_name = 'person'"), "p"), side(t.where(F.col("class_name").isin(*VEHICLES)), "v")


def proximity(
    obs: DataFrame, min_distance: Setting = 50.0, confirm: Setting = 3, cooldown_s: Setting = 30.0, longest: int | None = None
) -> DataFrame:
    """A person and a vehicle stay closer than ``min_distance`` over ``confirm`` shared frames in a row.

    A frame in which a pair is apart ends its run. It matters only between two slices in which the pair is close, so pairs meet by slice
    there, and no track brings together all it ever met.
    """
    keys = ["camera_id", "p_track", "v_track"]
    close = proximity_pairs(obs, min_distance)
    if isinstance(confirm, Column) or confirm > 1:
        close = cut(close)
        p, v = _pair_sides(obs)
        v = v.drop(*_settings(v))
        # The slices that can matter to a pair: from one in which it is close up to the next such one.
        again = F.lead(SLICE).over(Window.partitionBy(*keys).orderBy(SLICE))
        near = close.select(*keys, SLICE).distinct().withColumn("_to", F.coalesce(again - 1, F.col(SLICE)))
        near = near.select(*keys, F.explode(F.sequence(SLICE, "_to")).alias(SLICE))
        both = p.join(near, ["camera_id", SLICE, "p_track"]).join(v, [*FRAME, "frame_ms", "v_track"])
        dist = g.distance((F.col("p_x"), F.col("p_y")), (F.col("v_x"), F.col("v_y")))
        both = both.withColumn("dist", dist).withColumn("hit", F.col("dist") < min_distance)
        close = confirmed(both, keys, ["frame_ms", "frame_seq", "p_idx", "v_idx"], "hit", confirm, longest).drop("hit")
    return cooldown(close, keys, seconds(cooldown_s), order=["p_idx", "v_idx"])


def company(persons: DataFrame, radius: Setting, extra: Sequence[str] = ()) -> DataFrame:
    """For each person, how many others of the frame are within ``radius`` and sums of their ``extra``.

    A window ordered by x brings up the persons in a vertical strip around each one; only the strip is
    measured.
    """
    frame = ", ".join(FRAME)
    fields = ", ".join(["det_idx", "cx", "cy", *extra])
    cols = persons.columns
    if isinstance(radius, Column):
        # A strip has one width in a window, so places are counted in radii, and a rounding error more is looked at.
        persons, r = persons.withColumn("_r", radius.cast("double")), "_r"
        span = "order by cx / greatest(_r, 1e-9D) range between 1.000001D preceding and 1.000001D following"
    else:
        r = f"{float(radius)!r}D"
        span = f"order by cx range between {r} preceding and {r} following"
    strip = f"collect_list(struct({fields})) over (partition by {frame} {span})"
    near = (
        f"filter(_strip, o -> o.det_idx <> det_idx and "
        f"sqrt((cx - o.cx) * (cx - o.cx) + (cy - o.cy) * (cy - o.cy)) < {r})"
    )
    sums = [f"aggregate(_near, 0.0D, (s, o) -> s + o.{e}) as sum_{e}" for e in extra]
    return (
        persons.selectExpr("*", f"{strip} as _strip")
        .selectExpr("*", f"{near} as _near")
        .selectExpr(*cols, "size(_near) as others", *sums)
    )


def _with_head_count(persons: DataFrame) -> DataFrame:
    return persons.selectExpr("*", f"count(1) over (partition by {', '.join(FRAME)}) as heads")


def crowd(obs: DataFrame, max_count: Setting = 5, radius: Setting = 200.0, confirm: Setting = 5, cooldown_s: Setting = 60.0) -> DataFrame:
    """More than ``max_count`` persons within ``radius`` of one of them; one firing per frame."""
    full = _with_head_count(_persons(obs)).where(F.col("heads") > max_count)
    flagged = company(full, radius).withColumns(
        {"nearby": F.col("others") + 1, "hit": F.col("others") + 1 > max_count}
    )
    return first_in_frame(flagged, confirm, seconds(cooldown_s))


def person_motion(obs: DataFrame) -> DataFrame:
    """Persons with centre speed, wrist speed and the larger of centre and 0.6 x wrist speed.

    The key points are many times the rest of a row; only the wrists are carried on.
    """
    hands = pose.wrists(F.col("keypoints"))
    p = link_rows(
        _persons(obs).withColumn("hands", hands).drop("keypoints"),
        TRACK,
        ORDER,
        ["frame_seq", "prev_seq", "frame_ms", "cx", "cy"],
        same_spell,
        memo=F.col("hands"),
    )
    dt = (F.col("frame_ms") - F.col("prev.frame_ms")) / F.lit(1000.0)
    timed = F.col("linked") & (dt > 0)
    dx, dy = F.col("cx") - F.col("prev.cx"), F.col("cy") - F.col("prev.cy")
    own = F.coalesce(F.when(timed, F.sqrt(dx * dx + dy * dy) / dt), F.lit(0.0))
    limb = F.coalesce(F.when(timed, pose.max_wrist_move(F.col("hands"), F.col("memo")) / dt), F.lit(0.0))
    return (
        p.withColumns({"own_speed": own, "limb_speed": limb})
        .withColumn("top_speed", F.greatest(F.col("own_speed"), F.col("limb_speed") * 0.6))
        .drop("prev", "linked", "spell_ms", "memo", "hands")
    )


def fight(
    obs: DataFrame,
    radius: Setting = 150.0,
    min_speed: Setting = 60.0,
    min_persons: Setting = 2,
    confirm: Setting = 3,
    cooldown_s: Setting = 30.0,
) -> DataFrame:
    """A fast person with enough others near; one firing per frame."""
    full = _with_head_count(person_motion(obs)).where(F.col("heads") >= min_persons)
    flagged = company(full.withColumn("posed", (F.col("limb_speed") > 0).cast("double")), radius, ["own_speed", "posed"])
    hit = (F.col("others") >= min_persons - 1) & (F.col("top_speed") > min_speed)
    involved = F.col("others") + 1
    flagged = flagged.withColumns(
        {
            "hit": hit,
            "involved_count": involved,
            "avg_speed": (F.col("own_speed") + F.col("sum_own_speed")) / involved,
            "has_pose": F.col("posed") + F.col("sum_posed") > 0,
        }
    ).drop("posed", "sum_posed", "sum_own_speed")
    return first_in_frame(flagged, confirm, seconds(cooldown_s))


def fall_signs(obs: DataFrame, ratio_threshold: Setting = 1.0, min_ratio_change: Setting = 0.5, min_y_drop: Setting = 20.0) -> DataFrame:
    """Person observations that say something about a fall: a static sign, or a frame before to compare with."""
    ratio = g.aspect_ratio(g.box())
    shaped = _persons(obs).withColumn("ratio", ratio)
    before = F.when(F.col("ratio").isNotNull(), F.struct("ratio", "cy"))
    p = link_rows(shaped, TRACK, ORDER, ["frame_seq", "prev_seq"], same_spell, memo=before)
    change, drop = F.col("ratio") - F.col("memo.ratio"), F.col("cy") - F.col("memo.cy")
    fallen = pose.is_fallen(F.col("keypoints"))
    lying = F.col("ratio") > 1.3
    turned = (F.col("ratio") > ratio_threshold) & (change > min_ratio_change) & (drop > min_y_drop)
    sign = F.when(fallen, "pose").when(lying, "lying").when(F.col("memo").isNotNull(), "drop")
    return (
        p.where("ratio is not null")
        .withColumns({"sign": sign, "ratio_change": change, "y_drop": drop})
        .withColumn("hit", F.when(F.col("sign") == "drop", turned).otherwise(F.lit(True)))
        .where("sign is not null")
        .drop("prev", "linked", "spell_ms", "memo")
    )


def fall(
    obs: DataFrame,
    ratio_threshold: Setting = 1.0,
    min_ratio_change: Setting = 0.5,
    min_y_drop: Setting = 20.0,
    confirm: Setting = 2,
    cooldown_s: Setting = 30.0,
    longest: int | None = None,
) -> DataFrame:
    return Rule(
        "fall", lambda o: fall_signs(o, ratio_threshold, min_ratio_change, min_y_drop), confirm, cooldown_s, longest
    ).run(obs)


def track_exits(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """Last observation of a track before a processed frame of its camera in which it is missing.

    Tracks still there in the camera's last processed frame have not gone.
    """
    at = F.struct("frame_ms", "frame_seq")
    last = frames.where("has_motion").groupBy("camera_id").agg(F.max(at).alias("last"))
    t = obs.where("track_id >= 0")
    here = t.select("camera_id", "track_id", F.col("prev_seq").alias("frame_seq")).distinct()
    gone = t.join(here, ["camera_id", "track_id", "frame_seq"], "left_anti")
    return gone.join(last, "camera_id").where(at < F.col("last")).drop("last")
