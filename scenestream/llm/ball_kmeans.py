"""Vector codes by ball k-means: product codebooks whose assignments skip what the balls of the entries rule out.

Components become integers, so all distances are exact. A part at squared distance d from its entry c can only move to entries
nearer to c than twice that: an entry at squared distance D from c is ruled out where 4 d < D. The radius of an entry's ball
(its farthest part) hence bounds the neighbours that matter; a part nearer than half the way to the next entry lies in the stable
core and is not compared at all; the ring a part lies in says how many of the neighbours, nearest first, are its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_uneven

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Scaled components are held within this bound, so that sums of squares fit 64 bits (vectors up to 1024 components).
BOUND = 1 << 25
FAR = np.iinfo(np.int64).max

Codebook = np.ndarray  # (parts, entries, width) int64


@dataclass
class Codes:
    """``rows``: vec_id, label, code (one byte a part), error; ``codebook``: final entries, (parts, entries, width)."""

    rows: DataFrame
    codebook: Codebook


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, v`` (doubles) of the rows whose vector is there and holds finite components only."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & finite).select("vec_id", "label", v.alias("v"))


def scaled(v: np.ndarray, width: int) -> np.ndarray:
    """Integer components of vectors of one length, as (rows, parts, width); missing trailing components are 0."""
    whole = np.clip(np.floor(SCALE * v), -BOUND, BOUND).astype(np.int64)
    padded = np.zeros((len(v), PARTS * width), np.int64)
    padded[:, : v.shape[1]] = whole
    return padded.reshape(len(v), PARTS, width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).sum(-1)


def full_assignment(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each part (rows, width); ties to the lower index."""
    best, code = np.full(len(x), FAR), np.zeros(len(x), np.int64)
    for j, c in enumerate(entries):
        d = squared(x, c)
        nearer = d < best
        best[nearer], code[nearer] = d[nearer], j
    return code, best


def neighbours(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the others by distance, nearest first, and these squared distances."""
    apart = squared(entries[:, None], entries[None])
    np.fill_diagonal(apart, -1)  # an entry itself comes first, whatever others equal it
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, 1)


def ball_assignment(x: np.ndarray, code: np.ndarray, entries: np.ndarray, old: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``full_assignment``, starting from an earlier ``code``; also counts the distances computed to other entries.

    With the ``old`` entries that ``code`` was nearest to, an entry that has not moved keeps its part against all others that
    have not moved.
    """
    best = squared(x, entries[code])
    out = code.copy()
    order, apart = neighbours(entries)
    if not order.shape[1]:
        return out, best, 0
    if old is not None:
        still = (entries == old).all(-1)
        known = still[:, None] & still[order]
        apart = np.where(known, FAR, apart)
        again = np.argsort(apart, axis=1, kind="stable")
        order, apart = np.take_along_axis(order, again, 1), np.take_along_axis(apart, again, 1)
    # The ring: how many entries lie no farther from the own one than twice the part. The ball's radius bounds all its rings.
    ring = np.zeros(len(x), np.int64)
    by_entry = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[by_entry], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = by_entry[ends[i] : ends[i + 1]]
        if len(ball):
            near = apart[i][: np.searchsorted(apart[i], 4 * best[ball].max(), "right")]
            ring[ball] = np.searchsorted(near, 4 * best[ball], "right")
    outward = np.argsort(-ring, kind="stable")
    outward = outward[: np.count_nonzero(ring)]  # the stable cores end here
    held = np.searchsorted(-ring[outward], -np.arange(1, order.shape[1] + 1), "right")
    work = 0
    for k, n in enumerate(held.tolist()):
        if not n:
            break
        rows = outward[:n]
        j = order[code[rows], k]
        d = squared(x[rows], entries[j])
        nearer = (d < best[rows]) | ((d == best[rows]) & (j < out[rows]))
        best[rows[nearer]], out[rows[nearer]] = d[nearer], j[nearer]
        work += n
    return out, best, work


def _assigned(rows: DataFrame, book: Codebook, old: Codebook | None, has_code: bool) -> DataFrame:
    """``vec_id, label, x, code, error, sums`` for every row, and one row a task whose ``sums`` hold its totals by part and entry."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((book, old))  # parts x entries x width numbers
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, old = shared.value
        totals = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").astype(np.int64).reshape(n, parts, width)
            before = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts) if has_code else None
            code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p])
                if has_code:
                    nearest, best, _ = ball_assignment(part, before[:, p].astype(np.int64), book[p], old[p])
                else:
                    nearest, best = full_assignment(part, book[p])
                code[:, p] = nearest
                error += best
                np.add.at(totals[p], nearest, np.concatenate([part, np.ones((n, 1), np.int64)], 1))
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield _rows(b.column("vec_id"), b.column("label"), b.column("x"), codes, pa.array(error), pa.nulls(n, pa.binary()))
        none = [pa.nulls(1, t) for t in (b.schema.field(c).type for c in ("vec_id", "label", "x"))] if totals.any() or totals[..., -1].any() else None
        if none:
            yield _rows(*none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([totals.tobytes()], pa.binary()))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary, code binary, error long, sums binary")


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["vec_id", "label", "x", "code", "error", "sums"])


def _moved(assigned: DataFrame, book: Codebook) -> Codebook:
    """Entries at the floor of the mean of their parts; those without any stay. Tasks' totals are added up on the cluster."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                t = np.frombuffer(s, np.int64).reshape(parts * entries, width + 1)
                place = np.repeat(np.arange(parts * entries), width + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place), pa.array(np.tile(np.arange(width + 1), parts * entries)), pa.array(t.reshape(-1))], names=["entry", "i", "n"]
                )

    totals = assigned.where("sums is not null").select("sums").mapInArrow(run, "entry long, i long, n long")
    table = np.zeros((parts * entries, width + 1), object)
    # One row for each number of the codebook.
    for r in totals.groupBy("entry", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).toLocalIterator():
        table[r["entry"], r["i"]] = int(r["n"])
    new = book.copy().reshape(parts * entries, width)
    for e in range(parts * entries):
        if table[e, width]:
            new[e] = [s // table[e, width] for s in table[e, :width]]
    return new.reshape(book.shape)


def ball_codes(vectors: DataFrame, vector: str = "embedding") -> Codes:
    """Codes of all usable rows (see ``usable``) of ``vec_id``, ``label`` and a ``vector`` of numbers.

    The codebook of each part starts from the ``ENTRIES`` smallest ids and moves ``ROUNDS`` times. The first
    assignment compares all entries, later ones those that balls and rings leave. Vectors have the length of that of the smallest
    id (rows of one id: the longest, then the greatest vector first); others, and those without components, can't be coded and
    take no part. Where the length is no multiple of ``PARTS``, zeros are appended. Rows without an id are coded but start no entry;
    repeated rows count as often as they occur, and each seeds an entry. Fewer rows than entries give a smaller codebook, none
    give empty rows and an empty codebook. Components beyond ``BOUND`` / ``SCALE`` are held there.
    """
    spark = vectors.sparkSession
    known = usable(vectors, vector)
    first = known.where("vec_id is not null and size(v) > 0").orderBy("vec_id", F.size("v").desc(), F.col("v").desc())
    head = first.select("v").first()
    length = len(head["v"]) if head else 0
    width = max(1, -(-length // PARTS))
    known = known.where(F.size("v") == length) if length else known.where("false")
    seeds = [r["v"] for r in known.where("vec_id is not null").orderBy("vec_id", F.col("v").desc()).limit(ENTRIES).select("v").collect()]
    book = scaled(np.array(seeds, float).reshape(len(seeds), length), width).transpose(1, 0, 2).copy()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = scaled(v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, length), width).astype("<i4").reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "label", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    rows = known.mapInArrow(whole, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary")
    if not seeds:
        empty = rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(empty.where("false"), book)
    old, code = None, False
    for _ in range(ROUNDS):
        done = cut(_assigned(rows, book, old, code))
        old, book = book, _moved(done, book)
        rows, code = done.where("sums is null").select("vec_id", "label", "x", "code"), True
    last = cut(_assigned(rows, book, old, code).where("sums is null").select("vec_id", "label", "code", "error"))
    return Codes(last, book)


def label_errors(codes: Codes) -> DataFrame:
    """The rows of ``codes`` with ``label_error``, the errors of all rows of their label; rows without a label are one group.

    A sum beyond 64 bits is null.
    """
    rows = codes.rows.withColumns({"no_label": F.col("label").isNull(), "group": F.coalesce("label", F.lit(0).cast(codes.rows.schema["label"].dataType))})
    sums = rows.groupBy("no_label", "group").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("uses"))
    sums = cut(sums)
    return join_uneven(rows, sums, ["no_label", "group"], "uses", rows.count()).drop("no_label", "group")
