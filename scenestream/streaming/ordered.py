"""Keyed, time-ordered processing of streams.

Rows of a key wait in state until the watermark has passed them, then run through a small step function
in time order. So results do not depend on how rows were split into micro-batches or on their order of
arrival within the allowed lateness.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StructField, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# step(state, row) -> (new state, emit?). State and row are dicts; state starts empty.
Step = Callable[[dict, dict], tuple[dict, bool]]


class InOrder(StatefulProcessor):
    """Buffers a key's rows and steps through them once the watermark allows. A key without rows for ``keep_ms`` is forgotten."""

    def __init__(self, columns, row_schema, state_schema, step, time, order, emit, keep_ms):
        self.columns, self.row_schema, self.state_schema = list(columns), row_schema, state_schema
        self.step, self.time, self.order, self.emit, self.keep_ms = step, time, list(order), emit, keep_ms
        self.whole = [isinstance(f.dataType, (IntegerType, LongType)) for f in row_schema]
        # Parsed here: workers have no Spark context to parse them with.
        self.seen_schema = StructType.fromDDL("ms bigint")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.state = handle.getValueState("state", self.state_schema)
        self.seen = handle.getValueState("seen", self.seen_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = []
        for pdf in rows:
            items += [
                tuple(_plain(v, whole) for v, whole in zip(r, self.whole))
                for r in pdf[self.columns].itertuples(index=False, name=None)
            ]
        if items:
            self.waiting.appendList(items)
            self._wake(items)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip(self.columns, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[self.time] <= until), key=lambda r: tuple(r[c] for c in self.order))
        rest = [tuple(r[c] for c in self.columns) for r in rows if r[self.time] > until]
        if rest:
            self.waiting.put(rest)
            self._wake(rest)
        elif rows:
            self.waiting.clear()
        out = self._stepped(ready) if ready else []
        if not rest and self.keep_ms is not None and self.seen.exists() and self.seen.get()[0] + self.keep_ms < until:
            self.state.clear()
            self.seen.clear()
        yield pd.DataFrame(out)

    def _wake(self, items: list[tuple]) -> None:
        """A timer for the earliest of the waiting rows."""
        at = self.columns.index(self.time)
        self.handle.registerTimer(min(i[at] for i in items) + 1)

    def _stepped(self, ready: list[dict]) -> list[dict]:
        names = [f.name for f in self.state_schema]
        state = dict(zip(names, self.state.get())) if self.state.exists() else {}
        out = []
        last = self.seen.get()[0] if self.seen.exists() else None
        for r in ready:
            # A pause ends a key's memory whether or not a batch fell into it.
            if last is not None and self.keep_ms is not None and r[self.time] - last > self.keep_ms:
                state = {}
            last = r[self.time]
            state, fire = self.step(state, r)
            if fire:
                out.append(self.emit(state, r) if self.emit else r)
        self.state.update(tuple(state.get(n) for n in names))
        self.seen.update((last,))
        if self.keep_ms is not None:
            self.handle.registerTimer(last + self.keep_ms + 1)
        return out

    def close(self) -> None:
        pass


def _plain(v, whole: bool):
    """Python value of a pandas cell; pandas turns whole numbers with gaps into floats."""
    if v is None or v != v:
        return None
    if whole:
        return int(v)
    return v.item() if hasattr(v, "item") else v


def in_order(
    stream: DataFrame,
    keys: Sequence[str],
    step: Step,
    state_schema: str,
    time: str = "frame_ms",
    order: Sequence[str] = ("frame_ms", "frame_seq", "det_idx"),
    add: str | None = None,
    emit: Callable[[dict, dict], dict] | None = None,
    keep_ms: int | None = None,
) -> DataFrame:
    """Run ``step`` over each key's rows in time order; rows it accepts come out.

    ``add`` is the schema of columns that ``emit(state, row)`` puts beside the row. The input carries a
    watermark. Rows come out after the watermark passed them, so the output has none of its own: end the
    query here, or write it and start another. Nested columns are dropped (state holds plain values). A key that pauses for
    more than ``keep_ms`` starts anew and leaves no state behind.
    """
    nested = [f.name for f in stream.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    stream = stream.drop(*nested)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    fields = [StructField(f.name, f.dataType, True) for f in stream.schema]
    out = StructType(fields + (list(StructType.fromDDL(add)) if add else []))
    names = [f.name for f in out]

    def shaped(state: dict, row: dict) -> dict:
        full = emit(state, row) if emit else row
        return {n: full.get(n) for n in names}

    proc = InOrder(stream.columns, StructType(fields), StructType.fromDDL(state_schema), step, time, order, shaped, keep_ms)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=out, outputMode="Append", timeMode="EventTime"
    )
