"""Writers. Batch writers append; every one also works inside ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ALERTS, struct_type

# What a missing value is stored as.
_DEFAULTS = {"type": "unknown", "sub_type": "", "camera_id": "", "track_id": -1, "class_name": "", "confidence": 0.0, "detail": ""}


def _date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def alert_rows(events: DataFrame) -> DataFrame:
    """Common alert columns with defaults; any other column goes into ``extra`` as JSON."""
    have = set(events.columns)
    names = [f.name for f in struct_type(ALERTS)]
    known = set(names)
    rest = [c for c in events.columns if c not in known]
    out = []
    for f in struct_type(ALERTS):
        c = F.col(f.name) if f.name in have else F.lit(None)
        if f.name == "extra":
            merged = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
            c = F.coalesce(c, merged) if "extra" in have and not rest else merged
        if f.name == "is_alert":
            c = F.coalesce(c, F.lit(True))
        elif f.name in _DEFAULTS:
            c = F.coalesce(c.cast(f.dataType), F.lit(_DEFAULTS[f.name]))
        out.append(c.cast(f.dataType).alias(f.name))
    if rest and "extra" in have:
        # The keys of an extra that came as a JSON object stand beside the new ones; other text becomes a key.
        old, new = F.trim("extra"), F.to_json(F.struct(*rest))
        wrapped = F.when(old.rlike(r"(?s)^\{.*\}$"), old).otherwise(F.to_json(F.struct("extra")))
        inner = F.trim(F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))
        both = F.concat(F.lit("{"), inner, F.when((inner == "") | (new == "{}"), "").otherwise(","), F.substring(new, F.lit(2), F.length(new)))
        out = [F.when(old.isNull(), new).otherwise(both).alias("extra") if n == "extra" else c for n, c in zip(names, out)]
    return events.select(*out).withColumn("event_date", _date(F.col("ts_ms")))


# Files a date's alerts of one write go to, at most.
FILES_PER_DATE = 16


def write_alerts(events: DataFrame, path: str, mode: str = "append") -> None:
    """Alert store: Parquet by event date, clustered by camera and type inside the files."""
    rows = alert_rows(events).repartition("event_date", F.pmod(F.xxhash64("camera_id", "type"), F.lit(FILES_PER_DATE)))
    rows.sortWithinPartitions("event_date", "camera_id", "type").write.mode(mode).partitionBy("event_date").parquet(path)


def append(rows: DataFrame, path: str, time: str = "ts_ms") -> None:
    """Store of count windows, occupancy, accuracy records or performance figures, by date of ``time``."""
    rows.withColumn("event_date", _date(F.col(time))).write.mode("append").partitionBy("event_date").parquet(path)


def write_camera_log(events: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, one directory per camera."""
    events.write.mode(mode).partitionBy("camera_id").json(path)


def write_count_log(windows: DataFrame, path: str) -> None:
    windows.write.mode("append").json(path)


def search_documents(alerts: DataFrame, prefix: str) -> DataFrame:
    """Documents for a search index, named by month of the event."""
    t = F.timestamp_millis("ts_ms")
    return alerts.withColumns(
        {
            "index_name": F.concat(F.lit(f"{prefix}-"), F.date_format(t, "yyyy.MM")),
            "doc_time": F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        }
    )


def write_documents(alerts: DataFrame, prefix: str, path: str, mode: str = "append") -> None:
    search_documents(alerts, prefix).write.mode(mode).partitionBy("index_name").json(path)


def latest_config(changes: DataFrame, key: str = "camera_id", at: str = "updated_at") -> DataFrame:
    """Current state of a change log: last change per key, deleted keys dropped.

    ``changes`` has a boolean ``deleted``. ``max_by`` combines before the shuffle, so a key changed very
    often is no problem.
    """
    rest = [c for c in changes.columns if c not in (key, at)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_v"), F.max(at).alias(at))
    return last.where("not _v.deleted").select(key, at, *[F.col(f"_v.{c}").alias(c) for c in rest if c != "deleted"])


def drop_old_dates(spark, path: str, before: str) -> list[str]:
    """Delete date partitions older than ``before`` (yyyy-MM-dd); returns their names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for st in fs.listStatus(hadoop):
        name = st.getPath().getName()
        if name.startswith("event_date=") and name.split("=", 1)[1] < before:
            fs.delete(st.getPath(), True)
            gone.append(name)
    return gone
