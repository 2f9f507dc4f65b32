"""Write each micro-batch of alerts to several places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..sources import sinks


def fan_out(alerts: DataFrame, checkpoint: str, store: str | None = None, camera_log: str | None = None, documents: str | None = None, live: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """Alert store, per-camera log, search documents and a live feed from one ``foreachBatch``.

    All events go to the store; log, documents and feed get the alerts only. The batch is cached for its
    own duration, so the rules run once per batch. Each batch has its own folder, which a replay writes anew, so
    nothing is stored twice; the live feed may see a replayed batch again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"/batch_id={batch_id}"
        batch.persist()
        try:
            if store:
                sinks.write_alerts(batch, store + own, "overwrite")
            only = batch.where("is_alert") if "is_alert" in batch.columns else batch
            if camera_log:
                sinks.write_camera_log(only, camera_log + own, "overwrite")
            if documents:
                sinks.write_documents(only, "events", documents + own, "overwrite")
            if live:
                live(only)
        finally:
            batch.unpersist()

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
