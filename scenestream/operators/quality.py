"""Validation. Each check yields error text or NULL; a row's errors are the non-NULL ones, exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import review_scores
from ..schema import ANOMALY_TYPES, EVENT_TYPES

# What may be uploaded.
UPLOAD_EXTENSIONS = ("jpg", "jpeg", "png")
BATCH_LIMIT = 100


def errors(df: DataFrame, keys: Sequence[str], checks: Sequence[Column]) -> DataFrame:
    found = F.array_compact(F.array(*checks))
    return df.select(*keys, F.explode(found).alias("error"))


def _when(bad: Column, text: Column | str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(text) if isinstance(text, str) else text)


def annotation_events(docs: DataFrame) -> DataFrame:
    """One row per event of a video annotation given as JSON text (``video``, ``doc``)."""
    wires = F.from_json(F.get_json_object("doc", "$.camera_config.tripwires"), "array<struct<id:string>>")
    events = F.from_json(F.get_json_object("doc", "$.events"), "array<string>")
    return docs.withColumn("wires", F.filter(F.transform(wires, lambda w: w["id"]), lambda i: i.isNotNull())).select(
        "video", "wires", F.posexplode(events).alias("pos", "event")
    )


def annotation_errors(docs: DataFrame) -> DataFrame:
    """All faults of video annotations: (video, error)."""
    top = docs.withColumns(
        {
            "has_path": F.get_json_object("doc", "$.video_path").isNotNull(),
            "events": F.get_json_object("doc", "$.events"),
        }
    )
    is_list = F.substring("events", 1, 1) == "["
    doc_errors = errors(
        top,
        ["video"],
        [
            _when(~F.col("has_path"), "Missing required field: 'video_path'"),
            _when(F.col("events").isNull(), "Missing required field: 'events'"),
            _when(~is_list, "Field 'events' must be a list"),
        ],
    )
    events = annotation_events(docs)

    def field(name: str) -> Column:
        return F.get_json_object("event", f"$.{name}")

    at = F.concat(F.lit("events["), F.col("pos").cast("string"), F.lit("]: "))

    def text(*parts: Column | str) -> Column:
        return F.concat(at, *[F.lit(x) if isinstance(x, str) else x for x in parts])

    is_object = F.substring("event", 1, 1) == "{"
    kind, sub, wire = field("type"), field("sub_type"), field("tripwire_id")
    rng = F.from_json(field("time_range"), "array<string>")
    start, end = F.try_element_at(rng, F.lit(1)).try_cast("double"), F.try_element_at(rng, F.lit(2)).try_cast("double")
    good_kind = is_object & kind.isin(*EVENT_TYPES)
    has_range = good_kind & field("time_range").isNotNull()
    pair = (F.substring(field("time_range"), 1, 1) == "[") & (F.size(rng) == 2)
    event_errors = errors(
        events,
        ["video"],
        [
            _when(~is_object, text("event must be a dict")),
            _when(is_object & kind.isNull(), text("missing required field 'type'")),
            _when(is_object & ~kind.isin(*EVENT_TYPES), text("invalid event type '", kind, "'")),
            _when(good_kind & (kind == "anomaly") & sub.isNull(), text("anomaly event missing required field 'sub_type'")),
            _when(
                good_kind & (kind == "anomaly") & ~sub.isin(*ANOMALY_TYPES), text("invalid anomaly sub_type '", sub, "'")
            ),
            _when(
                good_kind & (kind == "tripwire") & wire.isNull(), text("tripwire event missing required field 'tripwire_id'")
            ),
            _when(
                good_kind & (kind == "tripwire") & (F.size("wires") > 0) & ~F.array_contains("wires", wire),
                text("tripwire_id '", wire, "' not found in camera_config.tripwires"),
            ),
            _when(has_range & pair & (start >= end), text("time_range start must be less than end")),
            _when(has_range & pair & (start.isNull() | end.isNull()), text("time_range values must be numeric")),
            _when(has_range & ~pair, text("time_range must be a list of [start, end]")),
        ],
    )
    return doc_errors.unionByName(event_errors)


def box_errors(boxes: DataFrame, n_classes: Column | int, keys: Sequence[str] = ("sample_id", "pos")) -> DataFrame:
    """Normalised boxes (class_id, cx, cy, w, h): values in [0, 1], class within the list."""
    n = F.lit(n_classes) if isinstance(n_classes, int) else n_classes
    checks = [
        _when((F.col(c) < 0) | (F.col(c) > 1), f"invalid_coordinates: {name}")
        for c, name in (("cx", "center_x"), ("cy", "center_y"), ("w", "width"), ("h", "height"))
    ]
    checks.append(_when((F.col("class_id") < 0) | (F.col("class_id") >= n), "invalid_class_id"))
    return errors(boxes, list(keys), checks)


def upload_errors(files: DataFrame, batch: str, name: str = "filename") -> DataFrame:
    """Files of upload batches: image extensions only, at most 100 per batch."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    bad = files.where(~ext.isin(*UPLOAD_EXTENSIONS)).select(batch, F.concat(F.lit("invalid_format: "), F.col(name)).alias("error"))
    big = files.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BATCH_LIMIT)
    return bad.unionByName(big.select(batch, F.format_string("batch_too_large: %d", "n").alias("error")))


# Allowed ranges of configuration fields (inclusive; None = open).
CONFIG_RANGES = {
    "threshold": (1, 255),
    "contour_area": (10, None),
    "frame_alpha": (0.001, 1.0),
    "frame_height": (50, 500),
    "detect_fps": (1, 30),
    "retain_days": (1, None),
    "segment_seconds": (10, None),
    "quality": (1, 100),
    "confidence": (0.0, 1.0),
}


def config_errors(config: DataFrame, key: str = "camera_id") -> DataFrame:
    checks = []
    for c, (lo, hi) in CONFIG_RANGES.items():
        if c in config.columns:
            bad = F.col(c) < lo
            if hi is not None:
                bad = bad | (F.col(c) > hi)
            checks.append(_when(bad, f"{c} out of range"))
    return errors(config, [key], checks)


def review_records(counts: DataFrame) -> DataFrame:
    """Scores of manual reviews: columns confirmed, false_positive, missed."""
    p, r, f = review_scores(F.col("confirmed"), F.col("false_positive"), F.col("missed"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})
