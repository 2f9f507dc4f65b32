"""Table schemas. Times are BIGINT milliseconds since the epoch, UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DETECTIONS = (
    "camera_id string, frame_seq bigint, frame_ms bigint, det_idx bigint, track_id bigint, "
    "class_id int, class_name string, confidence double, "
    "x1 double, y1 double, x2 double, y2 double, "
    "keypoints array<struct<x:double,y:double,conf:double>>"
)
FRAMES = "camera_id string, frame_seq bigint, frame_ms bigint, has_motion boolean"
ALERTS = (
    "alert_id string, type string, sub_type string, camera_id string, track_id bigint, "
    "class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, "
    "detail string, extra string, ts_ms bigint, is_alert boolean"
)
GT_BOXES = "image_id string, gt_idx bigint, class_id int, x1 double, y1 double, x2 double, y2 double"
GT_EVENTS = (
    "video string, gt_idx bigint, type string, sub_type string, tripwire_id string, direction string, "
    "class_name string, time_sec double, t_start double, t_end double"
)
VIDEO_ANNOTATION = (
    "video_path string, fps_sample double, "
    "camera_config struct<roi:array<array<double>>,tripwires:array<struct<id:string,name:string,"
    "p1:array<double>,p2:array<double>,direction:string,cooldown:double>>,intrusion:string,anomaly:string>, "
    "events array<struct<type:string,sub_type:string,tripwire_id:string,direction:string,class_name:string,"
    "time_sec:double,time_range:array<double>,expected_in:bigint,expected_out:bigint,"
    "by_class:map<string,struct<`in`:bigint,`out`:bigint>>>>"
)
SAMPLES = (
    "sample_id string, filename string, file_path string, dataset_name string, upload_time string, "
    "annotated boolean, annotation_type string"
)
DATASETS = "name string, classes array<string>, created_at string"
EPOCHS = (
    "epoch int, box_loss double, cls_loss double, mAP50 double, mAP50_95 double"
)
JOBS = (
    "job_id string, dataset_name string, status string, created_at string, "
    f"metrics array<struct<{EPOCHS.replace(' int', ':int').replace(' double', ':double')}>>"
)
MODELS = "model_id string, version string, parent_id string, job_id string, created_at string"

BOX = ("x1", "y1", "x2", "y2")

# Class ids and names of the detector's label set that the rules know.
CLASS_NAMES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
VEHICLES = ("car", "truck", "bus", "motorcycle", "bicycle")
AREA_CLASSES = ("person", "car", "truck", "motorcycle", "bicycle", "bus")
WATCHED_CLASS_IDS = (0, 2, 3, 5, 7)
# Sub-type labels of presence alerts by class id.
PRESENCE_LABELS = {0: "人员", 1: "自行车", 2: "汽车", 3: "摩托车", 5: "公交车", 7: "卡车"}
# Event types and anomaly sub-types an annotation may use.
EVENT_TYPES = ("anomaly", "counting", "intrusion", "presence", "tripwire")
ANOMALY_TYPES = ("crowd", "dwell", "fall", "fight", "proximity", "speed", "wrong_way")


def struct_type(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Cast to a schema; absent columns become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_type(ddl)
        ]
    )
