"""Project the sample star-schema tables onto detections, frames, alerts, truth and metadata.

All arithmetic is on integers or exact doubles, so another SQL engine reaches the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import ntz_millis

START_MS = 1_704_067_200_000
FRAME_MS = 200
NOW_MS = 1_706_659_200_000  # 2024-01-31 00:00 UTC, the "now" of look-back queries

ROI = [(300.0, 150.0), (1000.0, 150.0), (1000.0, 550.0), (300.0, 550.0)]
WIRE = {"id": "tw01", "p1": (200.0, 300.0), "p2": (1100.0, 500.0), "direction": "left_to_right", "cooldown": 2.0}
CAMERAS = ["cam0", "cam1", "cam2", "cam3"]
WIDTH, HEIGHT = 1280, 720


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_CAMERA = "concat('cam', ok % 4)"
_IMAGE = "concat('cam', ok % 4, '_', fs)"


def _idiv(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b))


def _camera(key: Column, n: int = 4) -> Column:
    return F.concat(F.lit("cam"), (key % n).cast("string"))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """One box per line; the boxes of an order are numbered from 1."""
    number = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)"
    items = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey ok", f"cast({number} as bigint) ln", "l_partkey pk", "l_suppkey sk", "l_orderkey div 4 as fs"
    )
    sized = items.selectExpr(
        "*",
        "cast(abs((fs*14 + ln*173 + (ok % 4)*311) % 2560 - 1280) as double) as cx",
        "cast(120 + abs((fs*9 + ln*97) % 1160 - 580) as double) as y2",
        "cast(if(pk % 40 = 0, 45, 18 + pk % 5) as double) as hw",
        "cast(if(pk % 40 = 0, 40, 80 + sk % 10) as double) as h",
        "case when ln <= 3 then 0 when ln in (4, 6) then 2 when ln = 5 then 7 else 3 end as class_id",
    )
    return sized.selectExpr("*", "cx - hw as x1", "y2 - h as y1", "cx + hw as x2")


def detections(spark: SparkSession, sf: str, keypoints: bool = True) -> DataFrame:
    cols = [
        f"{_CAMERA} as camera_id",
        "fs as frame_seq",
        f"{START_MS} + fs * {FRAME_MS} as frame_ms",
        "ln as det_idx",
        "if(ln >= 6, -1L, ln + 10 * (fs div 50)) as track_id",
        "class_id",
        "case class_id when 0 then 'person' when 2 then 'car' when 7 then 'truck' else 'motorcycle' end as class_name",
        "(25 + pk % 75) / 100.0D as confidence",
        "x1",
        "y1",
        "x2",
        "y2",
    ]
    if keypoints:
        cols.append(
            "if(class_id = 0 and sk % 3 = 0, transform(sequence(0, 16), i -> named_struct("
            "'x', if(i % 2 = 1, cx + hw / 2, cx - hw / 2), "
            "'y', if(pk % 40 = 0, y2 - i * h / 16, y1 + i * h / 16), "
            "'conf', ((pk + i) % 10) / 10.0D)), null) as keypoints"
        )
    return _boxes(spark, sf).selectExpr(*cols)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "concat('cam', o_orderkey % 4) as camera_id",
        "o_orderkey div 4 as frame_seq",
        f"{START_MS} + (o_orderkey div 4) * {FRAME_MS} as frame_ms",
        "o_custkey % 10 <> 0 as has_motion",
    )


def gt_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Truth boxes: a few pixels off, some of another class, some far away so that they go unmatched."""
    move = "(sk % 7 - 3) * 3 + if(pk % 8 = 0, 4000, 0)"
    return _boxes(spark, sf).selectExpr(
        f"{_IMAGE} as image_id",
        f"{_CAMERA} as camera_id",
        "fs as frame_seq",
        "ln as gt_idx",
        "if(pk % 31 = 0, 7, class_id) as class_id",
        f"x1 + {move} as x1",
        "y1",
        f"x2 + {move} as x2",
        "y2",
    )


def scored_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Detections used for accuracy evaluation; some are far away so that truths go unmatched."""
    return _boxes(spark, sf).selectExpr(
        f"{_IMAGE} as image_id",
        f"{_CAMERA} as camera_id",
        "fs as frame_seq",
        "ln as det_idx",
        "class_id",
        "(25 + pk % 75) / 100.0D as confidence",
        "x1 - if(pk % 9 = 0, 4000, 0) as x1",
        "y1",
        "x2 - if(pk % 9 = 0, 4000, 0) as x2",
        "y2",
    )


def _rule_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "click", "presence")
        .when(event_type == "view", "tripwire")
        .when(event_type == "error", "intrusion")
        .otherwise("anomaly")
    )


def _sub_of(event_type: Column, event_id: Column) -> Column:
    return (
        F.when(event_type == "purchase", "dwell")
        .when(event_type == "signup", "crowd")
        .when(event_type == "view", F.when(event_id % 2 == 0, "in").otherwise("out"))
        .otherwise("")
    )


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    eid, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return e.select(
        eid.alias("alert_id"),
        _rule_of(kind).alias("type"),
        _sub_of(kind, eid).alias("sub_type"),
        _camera(uid, 8).alias("camera_id"),
        uid.alias("track_id"),
        F.element_at(F.array(*[F.lit(c) for c in ("person", "car", "truck")]), (uid % 3 + 1).cast("int")).alias(
            "class_name"
        ),
        ((eid % 100) / F.lit(100.0)).alias("confidence"),
        F.col("props").alias("extra"),
        ntz_millis("ts").alias("ts_ms"),
    )


def _clip() -> Column:
    return F.concat(F.lit("clip"), (F.col("user_id") % 10).cast("string"))


def _event_seconds() -> Column:
    return (_idiv(ntz_millis("ts"), 1000) - F.lit(START_MS // 1000)).cast("bigint")


def predicted_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event; a third is far off in time so that it finds no truth."""
    e = table(spark, sf, "events")
    eid, kind = F.col("event_id"), F.col("event_type")
    return e.select(
        _clip().alias("video"),
        eid.alias("pred_idx"),
        _rule_of(kind).alias("type"),
        _sub_of(kind, eid).alias("sub_type"),
        F.when(kind == "view", F.concat(F.lit("tw"), (eid % 3).cast("string"))).alias("tripwire_id"),
        F.when(kind == "view", _sub_of(kind, eid)).alias("direction"),
        (_event_seconds() + F.when(eid % 3 == 0, 100_000_000).otherwise(0)).cast("double").alias("t"),
    )


def truth_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event, shifted a little; a quarter is far off so that it finds no prediction."""
    e = table(spark, sf, "events")
    eid, kind = F.col("event_id"), F.col("event_type")
    far = F.when(eid % 4 == 0, 300_000_000).otherwise(0)
    at = (_event_seconds() + (eid % 7 - 3) * 600 + far).cast("double")
    lasting = eid % 5 == 0
    return e.select(
        _clip().alias("video"),
        eid.alias("gt_idx"),
        _rule_of(kind).alias("type"),
        _sub_of(kind, eid).alias("sub_type"),
        F.when(kind == "view", F.concat(F.lit("tw"), (eid % 3).cast("string"))).alias("tripwire_id"),
        F.when(kind == "view", F.when(eid % 11 < 8, _sub_of(kind, eid)).otherwise("in")).alias("direction"),
        F.when(~lasting, at).alias("time_sec"),
        F.when(lasting, at - 300).alias("t_start"),
        F.when(lasting, at + 600).alias("t_end"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stand for images: one sample each, annotated when a label row exists."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang")
    lab = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has_label")).distinct()
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("sample_id"),
        F.concat(
            F.lit("img_"),
            F.col("doc_id").cast("string"),
            F.when(F.col("n_chars") % 11 == 0, ".gif").when(F.col("n_chars") % 3 == 0, ".PNG").otherwise(".jpg"),
        ).alias("filename"),
        F.col("source").alias("dataset_name"),
        F.col("lang"),
        F.coalesce(F.col("has_label"), F.lit(False)).alias("annotated"),
        F.when(F.col("has_label"), F.when(F.col("doc_id") % 2 == 0, "manual").otherwise("auto")).alias(
            "annotation_type"
        ),
        F.col("doc_id").alias("upload_seq"),
    )


def models(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("model_id"),
        F.concat(F.lit("v"), (k % 50 + 1).cast("string")).alias("version"),
        F.when(k > 0, _idiv(k, 2)).alias("parent_id"),
        F.concat(F.lit("job"), _idiv(k, 3).cast("string")).alias("job_id"),
        F.col("p_size").cast("bigint").alias("size"),
    )


def epoch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Training curve rows: the lines of a conversation are the epochs of a job."""
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat(F.lit("job"), F.col("conv_id").cast("string")).alias("job_id"),
        F.col("turn").alias("epoch"),
        ((F.length("text") % 1000) / F.lit(1000.0)).alias("map50"),
        ((F.length("text") * 7 % 1000) / F.lit(1000.0)).alias("box_loss"),
    )
