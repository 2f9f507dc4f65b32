"""State of each camera: today's counts, continued after a restart, and alarms for cameras that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.clock import local_time
from .ordered import STATE_STORE


class DayCounts(StatefulProcessor):
    """In and out of the current day; an earlier day's late rows no longer count, a later day starts from zero."""

    def __init__(self) -> None:
        self.schema = StructType.fromDDL("day string, n_in bigint, n_out bigint")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", self.schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.counts.update((initialState["day"], initialState["today_in"], initialState["today_out"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        day, n = (None, [0, 0]) if not self.counts.exists() else (self.counts.get()[0], list(self.counts.get()[1:]))
        for r in rows:
            if day is None or r["day"] > day:
                day, n = r["day"], [0, 0]
            if r["day"] == day:
                n[0] += r["direction"] == "in"
                n[1] += r["direction"] == "out"
        self.counts.update((day, *n))
        return iter([Row(camera_id=key[0], day=day, today_in=n[0], today_out=n[1])])

    def close(self) -> None:
        pass


def today_counts(crossings: DataFrame, recovered: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
    """Today's in and out of each camera after every batch with crossings (update mode); days change at local midnight.

    ``recovered`` (as of ``flow.recovered_today``, with its ``day``) is where the counts of a new stream start. A stream that
    goes on from its own checkpoint has its counts already and does not read it.
    """
    crossings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    day = F.to_date(local_time(F.col("frame_ms"), zone)).cast("string").alias("day")
    rows = crossings.where("camera_id is not null and frame_ms is not null").select("camera_id", "direction", day)
    start = recovered.select("camera_id", "day", "today_in", "today_out").groupBy("camera_id") if recovered is not None else None
    return rows.groupBy("camera_id").transformWithState(
        statefulProcessor=DayCounts(), outputStructType="camera_id string, day string, today_in bigint, today_out bigint", outputMode="Update", timeMode="None",
        initialState=start,
    )


class Watchdog(StatefulProcessor):
    """A timer of processing time for each camera, wound up by each batch of its rows."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms
        self.schema = StructType.fromDDL("last_ms bigint, due bigint, silent boolean")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", self.schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._wind(None, timerValues)

    def _wind(self, last_ms: int | None, timerValues) -> None:
        due = timerValues.getCurrentProcessingTimeInMs() + self.limit_ms
        self.handle.registerTimer(due)
        self.state.update((last_ms, due, False))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times = [r["frame_ms"] for r in rows]
        last, due, silent = self.state.get() if self.state.exists() else (None, None, False)
        if due is not None and not silent:
            self.handle.deleteTimer(due)
        newest = max([t for t in times if t is not None] + ([last] if last is not None else []), default=None)
        self._wind(newest, timerValues)
        return iter([Row(camera_id=key[0], event="back", last_ms=last)] if silent else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, due, silent = self.state.get()
        if silent or expiredTimerInfo.getExpiryTimeInMs() < due:
            return iter(())
        self.state.update((last, due, True))
        return iter([Row(camera_id=key[0], event="silent", last_ms=last)])

    def close(self) -> None:
        pass


def silent_cameras(rows: DataFrame, limit_s: float = 30.0, expected: DataFrame | None = None) -> DataFrame:
    """``camera_id, event, last_ms``: ``silent`` once when a camera has sent nothing for ``limit_s`` of wall time, ``back`` when it does again.

    A camera that never returns is reported, too, as are ``expected`` cameras (a table of ``camera_id``) that never send at all
    (``last_ms`` NULL). ``last_ms`` is the newest ``frame_ms`` before the silence.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    start = expected.select("camera_id").distinct().groupBy("camera_id") if expected is not None else None
    return rows.where("camera_id is not null").select("camera_id", "frame_ms").groupBy("camera_id").transformWithState(
        statefulProcessor=Watchdog(int(round(limit_s * 1000))), outputStructType="camera_id string, event string, last_ms bigint", outputMode="Update",
        timeMode="ProcessingTime", initialState=start,
    )
