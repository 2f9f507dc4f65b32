"""Streams of frames: the frames of a camera are judged one by one, each with all its detections.

A frame is closed by its marker in the frame log once the watermark has passed it by twice the clock slack; then its detections
are handed to a judge in the order of the batch rules, together with what the judge remembers of tracks, pairs or wires. What was
not touched for ``keep_ms`` of event time is forgotten, also when the camera sends nothing more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructField, StructType,
)

from ..operators.sequence import FRAME_SLACK_MS
from .ordered import STATE_STORE

# Event time judged at a time, rows held before they go to blocks, least rows of a block that others follow, and rows put out at a time.
SPAN_MS = 30_000
HELD_ROWS = 200_000
BLOCK_ROWS = 10_000
OUT_ROWS = 10_000

MEMORY_KEY = "part string, id bigint, name string"
Key = tuple[str, int, str]


@dataclass(frozen=True)
class Frame:
    seq: int
    ms: int
    prev_seq: int | None  # the processed frame before it on its camera
    prev_ms: int | None


class Memory:
    """What a judge remembers of one camera, by (part, id, name). Every entry carries ``seen``, the time of its last change."""

    def __init__(self, entries: dict[Key, dict]):
        self.entries, self.stored, self.changed, self.gone = {}, set(entries), set(), set()
        self.runs: dict[tuple[str, int], set[str]] = {}  # names of the entries with a run, by part and id
        self.parts: dict[str, set[Key]] = {}
        for key, entry in entries.items():
            self._enter(key, entry)

    def _enter(self, key: Key, entry: dict) -> None:
        if key not in self.entries:
            self.parts.setdefault(key[0], set()).add(key)
        self.entries[key] = entry
        if entry.get("run"):
            self.runs.setdefault(key[:2], set()).add(key[2])
        else:
            self._end_run(key)

    def _end_run(self, key: Key) -> None:
        names = self.runs.get(key[:2])
        if names is not None:
            names.discard(key[2])
            if not names:
                del self.runs[key[:2]]

    def get(self, part: str, id: int = 0, name: str = "") -> dict | None:
        return self.entries.get((part, id, name))

    def put(self, ms: int, part: str, id: int = 0, name: str = "", /, **values: Any) -> None:
        key = (part, id, name)
        self._enter(key, {**values, "seen": ms})
        self.changed.add(key)
        self.gone.discard(key)

    def drop(self, key: Key) -> None:
        if self.entries.pop(key, None) is not None:
            self.parts[key[0]].discard(key)
            self._end_run(key)
        self.changed.discard(key)
        if key in self.stored:
            self.gone.add(key)

    def part(self, part: str) -> list[tuple[Key, dict]]:
        return [(k, self.entries[k]) for k in self.parts.get(part, ())]

    def running(self, part: str) -> list[tuple[Key, dict]]:
        """The entries of a part with a run."""
        found = [(*k, name) for k, names in self.runs.items() if k[0] == part for name in names]
        return [(k, self.entries[k]) for k in found]

    def running_names(self, part: str, id: int) -> Iterable[str]:
        return self.runs.get((part, id), ())

    def forget(self, before: int) -> list[tuple[Key, dict]]:
        old = [(k, e) for k, e in self.entries.items() if e["seen"] < before]
        for key, _ in old:
            self.drop(key)
        return old


class Judge:
    """A rule over frames. ``state`` and ``adds`` are DDL: what is remembered of a key, and the columns beside those of a detection."""

    state: str = ""
    adds: str = ""
    keep_ms: int = 60_000

    def frame(self, frame: Frame, rows: list[dict], memory: Memory) -> Iterable[dict]:
        """Rows to put out for a processed frame; ``rows`` are its detections by ``det_idx``, maybe none."""
        raise NotImplementedError

    def frames(self, frames: list[Frame], starts: list[int], rows: pa.RecordBatch, memory: Memory) -> Iterable[dict]:
        """Rows to put out for frames in order; the detections of one are ``rows`` from its start to that of the next."""
        found = _dicts(rows)
        for frame, a, z in zip(frames, starts, starts[1:]):
            yield from self.frame(frame, found[a:z], memory)

    def forgotten(self, key: Key, was: dict) -> Iterable[dict]:
        """Rows to put out when an entry is forgotten."""
        return ()


def _values(column: pa.Array) -> list:
    """Python values of a column, converted all at once; nulls are None."""
    if not column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    missing = column.is_null().to_numpy(zero_copy_only=False).tolist()
    filled = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    return [None if m else v for m, v in zip(missing, filled)]


def _dicts(rows: pa.RecordBatch) -> list[dict]:
    names = rows.schema.names
    return [dict(zip(names, r)) for r in zip(*map(_values, rows.columns))]


class FrameByFrame(StatefulProcessor):
    """Rows wait in blocks sorted by span of event time, each known by its first span, and spans are judged one after the other, as if the watermark had reached their ends
    one by one: neither the rows that wait nor what is remembered meet in memory, however much comes in one batch."""

    def __init__(self, judge: Judge, row_schema: StructType, out_schema: StructType, slack_ms: int, packed: bool = False):
        self.judge, self.slack_ms = judge, slack_ms
        self.columns = row_schema.names
        self.row_schema, self.out_schema = to_arrow_schema(row_schema), to_arrow_schema(out_schema)
        # Parsed here: workers have no Spark context to parse them with.
        self.key_schema = StructType.fromDDL(MEMORY_KEY)
        self.memory_schema = StructType.fromDDL(judge.state + ", seen bigint")
        self.last_schema = StructType.fromDDL("seq bigint, ms bigint")
        self.span_schema, self.parts_schema = StructType.fromDDL("span bigint"), StructType.fromDDL("parts bigint")
        self.block_key, self.block_schema = StructType.fromDDL("span bigint, part bigint"), StructType.fromDDL("rows binary")
        self.slots = _slots(row_schema) if packed else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", self.span_schema, self.parts_schema)
        self.blocks = handle.getMapState("waiting", self.block_key, self.block_schema)
        self.memory = handle.getMapState("memory", self.key_schema, self.memory_schema)
        self.last = handle.getValueState("last", self.last_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n, due = [], 0, None
        for pdf in rows:
            if not len(pdf):
                continue
            if self.slots is not None:
                held.append(_unpacked(pdf, key[0], self.row_schema, self.slots))
            else:
                held.append(pa.RecordBatch.from_pandas(pdf[self.columns], schema=self.row_schema, preserve_index=False))
            n += held[-1].num_rows
            ready = self._ready(held[-1])
            due = ready if due is None else min(due, ready)
            if n >= HELD_ROWS:
                self._wait(held)
                held, n = [], 0
        if held:
            self._wait(held)
        if due is not None:
            self.handle.registerTimer(due)
        yield pd.DataFrame()

    def _ready(self, rows: pa.RecordBatch) -> int:
        """The first time at which something is to be done with some of the rows."""
        ms, det = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("frame_ms", "det_idx"))
        return int((ms + self.slack_ms * np.where(det < 0, 2, 3)).min()) + 1

    def _wait(self, held: list[pa.RecordBatch]) -> None:
        """Put rows into blocks: as many as the rows need, however many spans they are of."""
        rows = pa.Table.from_batches(held).combine_chunks()
        span = rows["frame_ms"].to_numpy() // SPAN_MS
        order = np.argsort(span, kind="stable")
        rows, span = rows.take(pa.array(order)), span[order]
        at = 0
        while at < len(span):
            # A span is not cut, so that a block holds whole spans.
            end = int(np.searchsorted(span, span[min(at + BLOCK_ROWS, len(span)) - 1], side="right"))
            s = int(span[at])
            known = self.spans.getValue((s,)) if self.spans.containsKey((s,)) else None
            part = known[0] if known else 0
            block = rows.slice(at, end - at).combine_chunks().to_batches()[0]
            self.blocks.updateValue((s, part), (block.serialize().to_pybytes(),))
            self.spans.updateValue((s,), (part + 1,))
            at = end

    def _taken(self, span: int, parts: int) -> Iterator[pa.RecordBatch]:
        """The blocks that begin with a span; they leave the state."""
        for part in range(parts):
            yield pa.ipc.read_record_batch(pa.py_buffer(bytes(self.blocks.getValue((span, part))[0])), self.row_schema)
            self.blocks.removeKey((span, part))
        self.spans.removeKey((span,))

    def _begun(self, now: int, pool: list[list]) -> Iterator[tuple[int, list[dict]]]:
        for n, found in self._spans(now, pool):
            yield n, [r for rows in found for r in _dicts(rows)]

    def _spans(self, now: int, pool: list[list]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
        """Spans that have begun, in order, with their rows. ``pool`` holds the open blocks (spans, place reached, rows); what is left
        in it in the end is of later spans."""
        starts, at = sorted((k[0], v[0]) for k, v in self.spans.iterator()), 0
        while True:
            heads = [int(spans[place]) for spans, place, _ in pool] + [s for s, _ in starts[at : at + 1]]
            if not heads or min(heads) * SPAN_MS > now:
                return
            n = min(heads)
            if at < len(starts) and starts[at][0] == n:
                pool += [[b.column("frame_ms").to_numpy() // SPAN_MS, 0, b] for b in self._taken(*starts[at])]
                at += 1
            found = []
            for block in pool:
                end = int(np.searchsorted(block[0], n, side="right"))
                if end > block[1]:
                    found.append(block[2].slice(block[1], end - block[1]))
                    block[1] = end
            pool[:] = [b for b in pool if b[1] < len(b[0])]
            yield n, found

    def _steps(self, now: int, pool: list[list]) -> Iterator[tuple[list[pa.RecordBatch], int]]:
        """Rows of each span that has begun, and the time up to which to judge then."""
        held = None
        for n, rows in self._spans(now, pool):
            if held is not None:
                yield held, min(now, n * SPAN_MS - 1)
            held = rows
        # The end is a step of its own where nothing waits: what is remembered may be old by now.
        yield held or [], now

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = self.last.get() if self.last.exists() else None
        seq, ms = last if last else (None, None)
        names = self.memory_schema.names
        memory = Memory({tuple(k): dict(zip(names, v)) for k, v in self.memory.iterator()})
        own, waiting, out, pool = {"camera_id": key[0]}, None, [], []
        for rows, until in self._steps(now, pool):
            rows = [*([] if waiting is None else [waiting]), *rows]
            if rows:
                closed, starts, dets, waiting = self._closed(pa.concat_batches(rows), until)
                frames = []
                for at in closed:
                    frames.append(Frame(*at, seq, ms))
                    seq, ms = at
                out += self.judge.frames(frames, starts, dets, memory)
            # Frames are judged up to here, so what was seen ``keep_ms`` before cannot be asked for in time.
            for gone, was in sorted(memory.forget(until - 2 * self.slack_ms - self.judge.keep_ms), key=lambda e: e[0]):
                out += self.judge.forgotten(gone, was)
            if len(out) >= OUT_ROWS:
                yield self._rows(out, own)
                out = []
        if pool:
            self._wait([rows.slice(place) for _, place, rows in pool])
        later = min((k[0] for k, _ in self.spans.iterator()), default=None)
        self._store(memory, names, seq, ms, now - 2 * self.slack_ms)
        if waiting is not None and len(waiting):
            self._wait([waiting])
            self.handle.registerTimer(self._ready(waiting))
        if later is not None:
            self.handle.registerTimer(max(later * SPAN_MS + 2 * self.slack_ms, now) + 1)
        yield self._rows(out, own)

    def _rows(self, out: list[dict], own: dict) -> pd.DataFrame:
        shaped = [{n: o.get(n, own.get(n)) for n in self.out_schema.names} for o in out]
        # Whole numbers with gaps stay whole numbers.
        return pa.Table.from_pylist(shaped, schema=self.out_schema).to_pandas(integer_object_nulls=True) if shaped else pd.DataFrame()

    def _closed(self, waiting: pa.RecordBatch, now: int) -> tuple[list[tuple], list[int], pa.RecordBatch, pa.RecordBatch]:
        """Number and time of processed frames that are complete, in order of time; where the detections of each start, and these; the rows that wait on."""
        ms, det = (waiting.column(c).to_numpy(zero_copy_only=False) for c in ("frame_ms", "det_idx"))
        seq = waiting.column("frame_seq").fill_null(NO_SEQ).to_numpy()
        moving = waiting.column("has_motion").fill_null(False).to_numpy(zero_copy_only=False)
        marks, dets = np.flatnonzero(det < 0), np.flatnonzero(~(det < 0))
        by = marks[np.argsort(seq[marks], kind="stable")]
        lo, hi = (np.searchsorted(seq[by], seq[dets], side=side) for side in ("left", "right"))
        home = np.full(len(dets), -1)
        one = np.flatnonzero(hi - lo == 1)
        near = by[lo[one]]
        fits = np.abs(ms[near] - ms[dets[one]]) <= self.slack_ms
        home[one[fits]] = near[fits]
        for d in np.flatnonzero(hi - lo > 1):
            at = ms[dets[d]]
            home[d] = min((m for m in by[lo[d] : hi[d]] if abs(ms[m] - at) <= self.slack_ms), key=lambda m: (abs(ms[m] - at), -ms[m]), default=-1)
        shut = ms + 2 * self.slack_ms <= now
        waits = (det < 0) & ~shut
        waits[dets] = np.where(home >= 0, ~shut[home], ms[dets] + 3 * self.slack_ms > now)
        ended = marks[shut[marks] & moving[marks]]
        ended = ended[np.lexsort([seq[ended], ms[ended]])]
        place = np.full(len(det) + 1, -1)
        place[ended] = np.arange(len(ended))
        place = place[home]
        order = np.lexsort([det[dets], place])
        order = order[place[order] >= 0]
        rows = waiting.take(pa.array(dets[order]))
        i = self.columns.index("frame_ms")
        rows = rows.set_column(i, self.row_schema.field(i), pa.array(ms[home[order]], self.row_schema.field(i).type))
        starts = np.searchsorted(place[order], np.arange(len(ended) + 1)).tolist()
        taken = waiting.take(pa.array(ended))
        closed = list(zip(_values(taken.column("frame_seq")), _values(taken.column("frame_ms"))))
        return closed, starts, rows, waiting.take(pa.array(np.flatnonzero(waits)))

    def _store(self, memory: Memory, names: list[str], seq: int | None, ms: int | None, judged: int) -> None:
        for k in memory.gone:
            self.memory.removeKey(k)
        for k in memory.changed:
            self.memory.updateValue(k, tuple(memory.entries[k].get(n) for n in names))
        until = self.judge.keep_ms + 2 * self.slack_ms + 1
        if memory.entries:
            self.handle.registerTimer(min(e["seen"] for e in memory.entries.values()) + until)
        if ms is not None and (memory.entries or ms + self.judge.keep_ms >= judged):
            self.last.update((seq, ms))
            self.handle.registerTimer(ms + until)
        elif self.last.exists():
            self.last.clear()

    def close(self) -> None:
        pass


def _both(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections and frame markers (``det_idx`` -1) in one stream. Frames without detections matter: they break runs."""
    marks = frames.select("camera_id", "frame_seq", "frame_ms", F.lit(-1).cast("bigint").alias("det_idx"), "has_motion", *(["ts"] if "ts" in frames.columns else []))
    plain = detections.drop("keypoints")
    # Whole numbers without gaps stay whole on their way through pandas.
    missing = [f.name for f in plain.schema if isinstance(f.dataType, (IntegerType, LongType)) and f.name not in marks.columns]
    marks = marks.withColumns({c: F.lit(-1).cast(plain.schema[c].dataType) for c in missing}) if missing else marks
    return plain.withColumn("has_motion", F.lit(None).cast("boolean")).unionByName(marks, allowMissingColumns=True)


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    """Streams without a watermark get one here, over both kinds of rows, so a quiet region or class does not hold up the time."""
    return stream if "ts" in stream.columns else stream.withColumn("ts", F.timestamp_millis("frame_ms")).withWatermark("ts", delay)


def with_markers(detections: DataFrame, frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return _timed(_both(detections, frames), delay)


# Rows of one camera and time that follow each other travel as one, since the way to the state takes its time by row: numbers and
# flags, with the lengths of texts, as records of one width; the texts of each column end to end.

NUMBERS = {ByteType: "i1", ShortType: "<i2", IntegerType: "<i4", LongType: "<i8", FloatType: "<f4", DoubleType: "<f8", BooleanType: "?"}
NO_SEQ = -(1 << 63)


def _slots(schema: StructType) -> np.dtype | None:
    """The record of a row: each value, or the length of a text, beside whether it is missing. None where a column does not fit in."""
    kinds = [NUMBERS.get(type(f.dataType), "<i8" if isinstance(f.dataType, StringType) else None) for f in schema]
    return None if None in kinds else np.dtype([(f"{what}{i}", k) for i, kind in enumerate(kinds) for what, k in (("v", kind), ("m", "?"))])


def _texts(schema: pa.Schema) -> list[int]:
    return [i for i, f in enumerate(schema) if pa.types.is_string(f.type) and f.name != "camera_id"]


def _packed(rows: pa.RecordBatch, slots: np.dtype) -> pa.RecordBatch:
    n = rows.num_rows
    cam = rows.column("camera_id").dictionary_encode().indices.fill_null(-1).to_numpy()
    ms = rows.column("frame_ms").fill_null(NO_SEQ).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (cam[1:] != cam[:-1]) | (ms[1:] != ms[:-1])])[:n])
    ends = np.append(starts, n)
    records, texts = np.zeros(n, slots), []
    for i, c in enumerate(rows.columns):
        records[f"m{i}"] = c.is_null().to_numpy(zero_copy_only=False)
        if not pa.types.is_string(c.type):
            records[f"v{i}"] = c.fill_null(False if pa.types.is_boolean(c.type) else 0).to_numpy(zero_copy_only=False)
        elif i in _texts(rows.schema):
            plain = pa.concat_arrays([c.fill_null("")])
            at = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + n + 1]
            records[f"v{i}"] = np.diff(at)
            texts.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at[ends].copy()), plain.buffers()[2]]))
    width = pa.py_buffer((ends * slots.itemsize).astype(np.int32))
    blob = pa.Array.from_buffers(pa.binary(), len(starts), [None, width, pa.py_buffer(records.tobytes())])
    first = pa.array(starts)
    names = ["camera_id", "frame_ms", "rows", *[f"text{i}" for i in _texts(rows.schema)]]
    return pa.record_batch([rows.column("camera_id").take(first), rows.column("frame_ms").take(first), blob, *texts], names=names)


def _unpacked(pdf: pd.DataFrame, camera: str | None, schema: pa.Schema, slots: np.dtype) -> pa.RecordBatch:
    records, columns = np.frombuffer(b"".join(pdf["rows"]), slots), []
    for i, f in enumerate(schema):
        missing, values = records[f"m{i}"], np.ascontiguousarray(records[f"v{i}"])
        if f.name == "camera_id":
            columns.append(pa.array([camera], f.type).take(pa.array(np.zeros(len(records), np.int64))))
        elif pa.types.is_string(f.type):
            at = pa.py_buffer(np.concatenate([[0], np.cumsum(values)]).astype(np.int32))
            known = pa.array(~missing).buffers()[1]
            columns.append(pa.Array.from_buffers(f.type, len(records), [known, at, pa.py_buffer(b"".join(pdf[f"text{i}"]))]))
        else:
            columns.append(pa.array(values, f.type, mask=missing))
    return pa.record_batch(columns, schema=schema)


def judged(detections: DataFrame, frames: DataFrame, judge: Judge, delay: str = "10 seconds", slack_ms: int = FRAME_SLACK_MS) -> DataFrame:
    """Run a judge over the frames of each camera. Nested columns are dropped; ``frame_ms`` of the output is that of the frame.

    Rows come out after the watermark passed their frame, so the output has none of its own: end the query here, or write it and
    start another.
    """
    stream = _both(detections, frames)
    stream = stream.drop(*[f.name for f in stream.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))])
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    fields = [StructField(f.name, f.dataType, True) for f in stream.schema]
    kept = [f for f in fields if f.name not in ("has_motion", "ts")]
    out = StructType(kept + (list(StructType.fromDDL(judge.adds)) if judge.adds else []))
    held = StructType([f for f in fields if f.name != "ts"])
    # A watermark that the streams have already would be lost on the way.
    packed = "ts" not in stream.columns and _slots(held) is not None
    packed = packed and (held["camera_id"].dataType, held["frame_ms"].dataType) == (StringType(), LongType())
    packed = packed and stream.sparkSession.conf.get("spark.sql.execution.arrow.useLargeVarTypes", "false") == "false"
    proc = FrameByFrame(judge, held, out, slack_ms, packed)
    if packed:
        slots, texts = proc.slots, [f"text{i} binary" for i in _texts(proc.row_schema)]
        stream = stream.mapInArrow(lambda batches: (_packed(b, slots) for b in batches if b.num_rows), ", ".join(["camera_id string, frame_ms bigint, rows binary", *texts]))
    return _timed(stream, delay).groupBy("camera_id").transformWithStateInPandas(statefulProcessor=proc, outputStructType=out, outputMode="Append", timeMode="EventTime")
