"""Dataset, annotation and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import datasets as ds
from ..operators import quality
from ..sources import projection as p
from ..sources import readers
from ..sources.labels import match_images, stem
from .registry import query
from .views import with_views


@query(
    "page_samples",
    with_views(
        "samples",
        "SELECT sample_id, filename, dataset_name, annotated FROM samples WHERE annotated ORDER BY upload_seq DESC LIMIT 20 OFFSET 40",
    ),
)
def page_samples(spark, sf):
    rows = p.samples(spark, sf).where("annotated")
    return al.page(rows, [F.desc("upload_seq")], 3, 20).select("sample_id", "filename", "dataset_name", "annotated")


@query(
    "page_totals",
    with_views("samples", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM samples WHERE annotated"),
)
def page_totals(spark, sf):
    return al.page_totals(p.samples(spark, sf).where("annotated"), 20)


_JOBS = """jobs AS (SELECT job_id, max(map50) AS best_map50, max(epoch) AS last_epoch, arg_max(map50, epoch) AS last_map50,
  arg_max(box_loss, epoch) AS last_box_loss FROM epochs GROUP BY job_id)"""


@query("training_summary", with_views("epochs", _JOBS + "SELECT * FROM jobs"))
def training_summary(spark, sf):
    return ds.training_summary(p.epoch_metrics(spark, sf))


@query("page_jobs", with_views("epochs", _JOBS + "SELECT job_id, best_map50 FROM jobs ORDER BY best_map50 DESC, job_id LIMIT 10 OFFSET 10"))
def page_jobs(spark, sf):
    jobs = ds.training_summary(p.epoch_metrics(spark, sf))
    return al.page(jobs, [F.desc("best_map50"), F.asc("job_id")], 2, 10).select("job_id", "best_map50")


@query("epoch_metrics", with_views("epochs", "SELECT job_id, epoch, map50, box_loss FROM epochs"))
def epoch_metrics(spark, sf):
    """Epoch lines written and read back as padded CSV text."""
    e = p.epoch_metrics(spark, sf)
    text = e.select("job_id", F.concat_ws(",  ", F.col("epoch").cast("string"), F.col("map50").cast("string"), F.col("box_loss").cast("string")).alias("line"))
    parts = F.split("line", ",")
    raw = text.select("job_id", *[parts[k].alias(n) for k, n in enumerate(("       epoch", "   map50", " box_loss"))])
    t = readers.tidy_headers(raw)
    return t.select("job_id", F.col("epoch").try_cast("bigint").alias("epoch"), *[F.col(c).try_cast("double").alias(c) for c in ("map50", "box_loss")])


_STATS = "st AS (SELECT dataset_name, count(*) AS total, count(*) FILTER (annotated) AS annotated, count(*) FILTER (NOT annotated) AS unannotated FROM samples GROUP BY ALL)"


@query("dataset_stats", with_views("samples", _STATS + "SELECT * FROM st"))
def dataset_stats(spark, sf):
    return ds.dataset_stats(p.samples(spark, sf))


@query("dataset_ready", with_views("samples", _STATS + "SELECT *, annotated >= 20 AS is_ready FROM st"))
def dataset_ready(spark, sf):
    return ds.ready(ds.dataset_stats(p.samples(spark, sf)), 20)


@query(
    "train_val_split",
    with_views(
        "samples",
        """r AS (SELECT sample_id, dataset_name, row_number() OVER (PARTITION BY dataset_name ORDER BY md5('42:' || sample_id)) AS rk,
          count(*) OVER (PARTITION BY dataset_name) AS n FROM samples WHERE annotated)
        SELECT sample_id, dataset_name, CASE WHEN rk <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' ELSE 'val' END AS split FROM r""",
    ),
)
def train_val_split(spark, sf):
    return ds.train_val_split(p.samples(spark, sf)).select("sample_id", "dataset_name", "split")


@query(
    "image_label_match",
    with_views(
        "samples",
        """SELECT filename, regexp_replace(filename, '\\.[^.]*$', '') AS stem, annotated AS matched FROM samples
        WHERE lower(split_part(filename, '.', 2)) IN ('jpg', 'jpeg', 'png', 'bmp')""",
    ),
)
def image_label_match(spark, sf):
    s = p.samples(spark, sf)
    labelled = s.where("annotated").select(stem(F.col("filename")).alias("stem"))
    return match_images(s, labelled).select("filename", "stem", "matched")


def _mapping(spark, sf):
    parts = p.table(spark, sf, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    model = parts.select(brand.alias("class_id"), "p_brand").distinct().select("class_id", F.upper("p_brand").alias("name"))
    classes = parts.groupBy(F.concat(F.lit("set"), (F.col("p_partkey") % 3).cast("string")).alias("dataset_name")).agg(
        F.sort_array(F.collect_set(F.concat(F.lower("p_brand"), F.when(F.col("p_partkey") % 7 == 1, "").otherwise("-old")))).alias("classes")
    )
    return ds.class_mapping(model, classes)


_MAP = """md AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS class_id, upper(p_brand) AS name FROM part),
  dc AS (SELECT 'set' || (p_partkey % 3) AS dataset_name, lower(p_brand) || CASE WHEN p_partkey % 7 = 1 THEN '' ELSE '-old' END AS k FROM part GROUP BY ALL),
  dp AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY k) - 1 AS dataset_class FROM dc)
  SELECT dataset_name, class_id AS model_class, name, dataset_class FROM md JOIN dp ON lower(name) = k"""


@query("class_mapping", "WITH " + _MAP)
def class_mapping(spark, sf):
    return _mapping(spark, sf)


@query(
    "annotate_outcome",
    with_views(
        "samples",
        """SELECT dataset_name, count(*) FILTER (NOT annotated AND sample_id % 9 <> 0) AS success_count,
        count(*) FILTER (NOT annotated AND sample_id % 9 = 0) AS failed_count, count(*) FILTER (annotated) AS skipped_count
        FROM samples GROUP BY dataset_name""",
    ),
)
def annotate_outcome(spark, sf):
    s = p.samples(spark, sf)
    return ds.annotate_outcome(s, s.where("sample_id % 9 = 0"))


@query(
    "auto_annotations",
    with_views(
        "det samples",
        """mp AS (SELECT unnest([0, 2, 7]) AS class_id, unnest([1, 0, 2]) AS dataset_class)
        SELECT s.sample_id, s.dataset_name, d.det_idx, m.dataset_class, round((x1 + x2)/2, 3) AS cx, round((y1 + y2)/2, 3) AS cy, x2 - x1 AS w, y2 - y1 AS h
        FROM (SELECT *, frame_seq * 4 + CAST(substr(camera_id, 4) AS BIGINT) AS sample_id FROM det WHERE confidence > 0.5) d
        JOIN samples s ON s.sample_id = d.sample_id AND NOT s.annotated JOIN mp m ON m.class_id = d.class_id""",
    ),
)
def auto_annotations(spark, sf):
    s = p.samples(spark, sf)
    preds = p.detections(spark, sf, keypoints=False).withColumn(
        "sample_id", F.col("frame_seq") * 4 + F.substring("camera_id", 4, 9).cast("bigint")
    )
    known = preds.select("class_id", "class_name").distinct().withColumnRenamed("class_name", "name")
    sets = s.select("dataset_name").distinct().withColumn("classes", F.array(F.lit("CAR"), F.lit("Person"), F.lit("truck")))
    out = ds.auto_annotations(s, preds, ds.class_mapping(known, sets), p.WIDTH, p.HEIGHT)
    px = {"cx": p.WIDTH, "w": p.WIDTH, "cy": p.HEIGHT, "h": p.HEIGHT}
    return out.select(
        "sample_id", "dataset_name", "det_idx", "dataset_class", *[F.round(F.col(c) * n, 3).alias(c) for c, n in px.items()]
    )


@query(
    "label_summary",
    with_views(
        "det frames",
        """t AS (SELECT * FROM frames WHERE frame_seq % 3 <> 0)
        SELECT 'total' AS name, count(*) AS n FROM frames UNION ALL SELECT 'labelled', count(*) FROM t
        UNION ALL SELECT 'skipped', (SELECT count(*) FROM frames) - (SELECT count(*) FROM t)
        UNION ALL SELECT 'class:' || class_name, count(*) FROM det JOIN t USING (camera_id, frame_seq) GROUP BY class_name""",
    ),
)
def label_summary(spark, sf):
    images = p.frames(spark, sf)
    return ds.label_summary(
        images, images.where("frame_seq % 3 = 0"), p.detections(spark, sf, keypoints=False), ["camera_id", "frame_seq"]
    )


@query(
    "model_lineage",
    with_views(
        "models",
        """up AS (SELECT model_id, parent_id AS ancestor_id, 1 AS steps FROM models WHERE parent_id IS NOT NULL
        UNION ALL SELECT up.model_id, m.parent_id, up.steps + 1 FROM up JOIN models m ON m.model_id = up.ancestor_id WHERE m.parent_id IS NOT NULL)
        SELECT * FROM up""",
        True,
    ),
)
def model_lineage(spark, sf):
    return ds.lineage(p.models(spark, sf))


@query(
    "model_parents",
    with_views(
        "models",
        "SELECT m.model_id, m.version, m.parent_id, q.version AS parent_version, m.job_id FROM models m LEFT JOIN models q ON q.model_id = m.parent_id",
    ),
)
def model_parents(spark, sf):
    return ds.parents(p.models(spark, sf))


# --- validation -------------------------------------------------------------------------------------


@query(
    "box_errors",
    with_views(
        "det",
        """b AS (SELECT camera_id, frame_seq, det_idx, class_id, (x1 + x2)/2/1280 - 0.02 AS cx, (y1 + y2)/2/720 AS cy, (x2 - x1)/80 AS w, (y2 - y1)/720 AS h FROM det)
        SELECT camera_id, frame_seq, det_idx, unnest(list_filter([
          CASE WHEN cx < 0 OR cx > 1 THEN 'invalid_coordinates: center_x' END, CASE WHEN cy < 0 OR cy > 1 THEN 'invalid_coordinates: center_y' END,
          CASE WHEN w < 0 OR w > 1 THEN 'invalid_coordinates: width' END, CASE WHEN h < 0 OR h > 1 THEN 'invalid_coordinates: height' END,
          CASE WHEN class_id < 0 OR class_id >= 3 THEN 'invalid_class_id' END], lambda x: x IS NOT NULL)) AS error FROM b""",
    ),
)
def box_errors(spark, sf):
    b = p.detections(spark, sf, keypoints=False).selectExpr(
        "camera_id", "frame_seq", "det_idx", "class_id", "(x1 + x2) / 2 / 1280 - 0.02D as cx", "(y1 + y2) / 2 / 720 as cy",
        "(x2 - x1) / 80 as w", "(y2 - y1) / 720 as h",
    )
    return quality.box_errors(b, 3, ["camera_id", "frame_seq", "det_idx"])


@query(
    "upload_errors",
    with_views(
        "samples",
        """b AS (SELECT *, dataset_name || '/' || (sample_id % 2) || lang AS batch FROM samples), all_ AS (SELECT *, lang AS big FROM samples)
        SELECT lang AS batch, 'invalid_format: ' || filename AS error FROM samples WHERE filename LIKE '%.gif'
        UNION ALL SELECT lang, 'batch_too_large: ' || count(*) FROM samples GROUP BY lang HAVING count(*) > 100""",
    ),
)
def upload_errors(spark, sf):
    return quality.upload_errors(p.samples(spark, sf).withColumn("batch", F.col("lang")), "batch")


_CFG = """cfg AS (SELECT 'cam' || c_custkey AS camera_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey * 12 END, 40) AS threshold,
  coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 40 END, 200) AS contour_area,
  coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_nationkey / 20.0::DOUBLE END, 0.02) AS frame_alpha,
  coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, 5) AS detect_fps FROM customer)"""


def _config(spark, sf):
    c = p.table(spark, sf, "customer").selectExpr(
        "concat('cam', c_custkey) as camera_id",
        "if(c_custkey % 3 = 0, c_nationkey * 12, null) as threshold",
        "if(c_custkey % 5 = 0, c_custkey % 40, null) as contour_area",
        "if(c_custkey % 4 = 0, c_nationkey / 20.0D, null) as frame_alpha",
        "if(c_custkey % 2 = 0, c_nationkey, null) as detect_fps",
    )
    return readers.with_defaults(c, {"threshold": 40, "contour_area": 200, "frame_alpha": 0.02, "detect_fps": 5})


@query("dim_rules", "WITH " + _CFG + "SELECT * FROM cfg")
def dim_rules(spark, sf):
    return _config(spark, sf)


@query(
    "config_errors",
    "WITH "
    + _CFG
    + """SELECT camera_id, unnest(list_filter([
      CASE WHEN threshold < 1 OR threshold > 255 THEN 'threshold out of range' END, CASE WHEN contour_area < 10 THEN 'contour_area out of range' END,
      CASE WHEN frame_alpha < 0.001 OR frame_alpha > 1 THEN 'frame_alpha out of range' END,
      CASE WHEN detect_fps < 1 OR detect_fps > 30 THEN 'detect_fps out of range' END], lambda x: x IS NOT NULL)) AS error FROM cfg""",
)
def config_errors(spark, sf):
    return quality.config_errors(_config(spark, sf))


@query(
    "config_latest",
    with_views(
        "alerts",
        """c AS (SELECT camera_id || '_' || (alert_id % 40) AS camera_id, alert_id % 10 = 3 AS deleted, CAST(alert_id % 7 AS BIGINT) AS fps, ts_ms AS updated_at FROM alerts)
        SELECT camera_id, updated_at, fps FROM c
        QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY updated_at DESC) = 1 AND NOT deleted""",
    ),
)
def config_latest(spark, sf):
    from ..sources.sinks import latest_config

    log = p.alerts(spark, sf).selectExpr(
        "concat(camera_id, '_', alert_id % 40) as camera_id", "alert_id % 10 = 3 as deleted", "alert_id % 7 as fps", "ts_ms as updated_at"
    )
    return latest_config(log)


@query("src_detections", with_views("det", "SELECT camera_id, frame_seq, frame_ms, det_idx, track_id, class_id, class_name, confidence, x1, y1, x2, y2 FROM det"))
def src_detections(spark, sf):
    from ..schema import DETECTIONS, conform

    return conform(p.detections(spark, sf), DETECTIONS).drop("keypoints")


# Video annotations as JSON text, one per event, with faults planted by event id.
_DOC = """concat('{', case when event_id % 29 <> 0 then concat('"video_path":"/v/clip', event_id, '.mp4",') else '' end,
  case when event_id % 2 = 0 then '"fps_sample":10,' else '' end,
  '"camera_config":{"tripwires":[{"id":"tw0"},{"id":"tw1"}]}',
  case when event_id % 31 = 0 then '' when event_id % 37 = 0 then ',"events":{"a":1}' else concat(',"events":[{',
    case event_type when 'click' then '"type":"presence"' when 'view' then concat('"type":"tripwire"', case when event_id % 3 = 2 then ',"tripwire_id":"tw9"' when event_id % 3 = 1 then ',"tripwire_id":"tw1","direction":"in"' else '' end)
      when 'error' then case when event_id % 5 = 0 then '"type":"break-in"' when event_id % 5 = 1 then '"kind":"x"' else '"type":"intrusion"' end
      else concat('"type":"anomaly"', case when event_id % 4 = 0 then '' when event_id % 4 = 1 then ',"sub_type":"jump"' else ',"sub_type":"dwell"' end) end,
    case event_id % 11 when 0 then ',"time_range":[9.5,2.0]' when 1 then ',"time_range":["a",2]' when 2 then ',"time_range":[1,2,3]' when 3 then ',"time_range":[1.5,4.0]' else ',"time_sec":7.25' end,
    '}]') end, '}')"""


def _docs(spark, sf):
    return p.table(spark, sf, "events").selectExpr("event_id as video", f"{_DOC} as doc")


_NO_EVENTS = "(event_id % 31 = 0 OR event_id % 37 = 0)"
_KIND = """CASE event_type WHEN 'click' THEN 'presence' WHEN 'view' THEN 'tripwire' WHEN 'error' THEN
  CASE event_id % 5 WHEN 0 THEN 'break-in' WHEN 1 THEN NULL ELSE 'intrusion' END ELSE 'anomaly' END"""


@query(
    "annotation_errors",
    f"""WITH e AS (SELECT *, {_KIND} AS kind FROM events), g AS (SELECT * FROM e WHERE NOT {_NO_EVENTS})
    SELECT event_id AS video, 'Missing required field: ''video_path''' AS error FROM e WHERE event_id % 29 = 0
    UNION ALL SELECT event_id, 'Missing required field: ''events''' FROM e WHERE event_id % 31 = 0
    UNION ALL SELECT event_id, 'Field ''events'' must be a list' FROM e WHERE event_id % 37 = 0 AND event_id % 31 <> 0
    UNION ALL SELECT event_id, 'events[0]: missing required field ''type''' FROM g WHERE kind IS NULL
    UNION ALL SELECT event_id, 'events[0]: invalid event type ''break-in''' FROM g WHERE kind = 'break-in'
    UNION ALL SELECT event_id, 'events[0]: anomaly event missing required field ''sub_type''' FROM g WHERE kind = 'anomaly' AND event_id % 4 = 0
    UNION ALL SELECT event_id, 'events[0]: invalid anomaly sub_type ''jump''' FROM g WHERE kind = 'anomaly' AND event_id % 4 = 1
    UNION ALL SELECT event_id, 'events[0]: tripwire event missing required field ''tripwire_id''' FROM g WHERE kind = 'tripwire' AND event_id % 3 = 0
    UNION ALL SELECT event_id, 'events[0]: tripwire_id ''tw9'' not found in camera_config.tripwires' FROM g WHERE kind = 'tripwire' AND event_id % 3 = 2
    UNION ALL SELECT event_id, 'events[0]: time_range start must be less than end' FROM g WHERE kind <> 'break-in' AND event_id % 11 = 0
    UNION ALL SELECT event_id, 'events[0]: time_range values must be numeric' FROM g WHERE kind <> 'break-in' AND event_id % 11 = 1
    UNION ALL SELECT event_id, 'events[0]: time_range must be a list of [start, end]' FROM g WHERE kind <> 'break-in' AND event_id % 11 = 2""",
)
def annotation_errors(spark, sf):
    return quality.annotation_errors(_docs(spark, sf))


@query(
    "gt_events_scan",
    f"""SELECT 'clip' || event_id AS video, CASE WHEN event_id % 2 = 0 THEN 10.0 ELSE 5.0 END::DOUBLE AS fps_sample, {_KIND} AS type,
      CASE WHEN event_id % 11 > 3 THEN 7.25::DOUBLE END AS time_sec, CASE event_id % 11 WHEN 3 THEN 1.5::DOUBLE WHEN 0 THEN 9.5 WHEN 2 THEN 1 END AS t_start
    FROM events WHERE event_id % 29 <> 0 AND NOT {_NO_EVENTS} AND NOT (event_id % 11 IN (1, 2) AND coalesce({_KIND}, 'break-in') <> 'break-in')""",
)
def gt_events_scan(spark, sf):
    from ..schema import VIDEO_ANNOTATION

    every = _docs(spark, sf)
    # Documents whose structure the validator rejects hold nothing to scan; faults of single events stay in.
    broken = quality.annotation_errors(every).where("error rlike '^Missing|^Field|time_range (values|must be a list)'")
    good = every.join(broken.select("video").distinct(), "video", "left_anti")
    docs = good.select(F.from_json("doc", VIDEO_ANNOTATION).alias("a")).select("a.*")
    docs = readers.with_annotation_defaults(docs)
    t = readers.annotation_truth(docs)
    fps = docs.select(F.regexp_extract("video_path", r"(clip\d+)", 1).alias("video"), "fps_sample")
    return t.join(fps, "video").select("video", "fps_sample", "type", "time_sec", "t_start")
