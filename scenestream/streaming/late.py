"""Count of the rows that came too late: those the state operators of a stream dropped because of its watermark."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Late rows by name (or id) of the query, over all its batches.

    For windowed aggregates a row here is a group of a task that was dropped, since Spark sums up rows before it drops them.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = defaultdict(int)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[p.name or str(p.id)] += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def count_late(spark: SparkSession) -> LateRows:
    """Count from now on, for all streams of the session."""
    listener = LateRows()
    spark.streams.addListener(listener)
    return listener


def late_rows(query: StreamingQuery) -> int:
    """Late rows of a query in the batches whose progress the session still keeps (``spark.sql.streaming.numRecentProgressUpdates``)."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
