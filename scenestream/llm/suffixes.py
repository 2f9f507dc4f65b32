"""Repeated byte strings across documents, by merged Burrows-Wheeler transforms of shards.

What can repeat is found first: every 50-byte window is named by its anchor, the smallest gram hash in it, so equal
windows have equal anchors. Windows whose anchor occurs in one document only cannot repeat. The rest are cut into pieces (the
windows of one anchor) and each anchor's pieces meet in one place, where shards of them are turned into
transforms and merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, cut, text_key

SPAN = 50  # bytes in a string
GRAM = 18  # bytes in a gram; a window has SPAN - GRAM + 1 of them
SIDE = (SPAN - GRAM) // 2  # bytes that a window has before its anchor at least, or behind it
STEP = 8  # symbols by which an interleave of shards is refined at a time
# Bytes of text anchored at once, of text for each bucket of anchors, of pieces merged at once, and of pieces in one shard.
BLOCK, PER_BUCKET, CHUNK, SHARD = 1 << 18, 4 << 20, 2 << 20, 1 << 18
# Anchors held before they are dealt to buckets.
HELD = 300_000
POSITION_BITS = 24
NO_ID = (1 << 63) - 1  # orders a null doc_id behind all others

_P = 0x9E3779B97F4A7C15
_POWER = [np.uint64(pow(_P, k, 1 << 64)) for k in range(GRAM + 1)]


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A polynomial hash of the ``GRAM`` bytes from each position, put together from halves, then mixed."""
    two = None
    h = b.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4, 8):
        h = h[:-step] * _POWER[step] + h[step:]
        two = h if step == 1 else two
    h = h[: len(b) - GRAM + 1] * _POWER[2] + two[16 : 16 + len(b) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``text number, first window, windows, anchor hash`` of every run of windows with one anchor, block by block."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= BLOCK):
            size += len(texts[last])
            last += 1
        if size < 1 << (POSITION_BITS - 1):
            yield from _anchored(b"".join(texts[first:last]), np.array([len(t) for t in texts[first:last]]), first, 0)
        else:  # one very long text: blocks that overlap by all but one byte of a window
            step = 1 << (POSITION_BITS - 2)
            for at in range(0, max(1, size - SPAN + 1), step):
                part = texts[first][at : at + step + SPAN - 1]
                yield from _anchored(part, np.array([len(part)]), first, at)
        first = last


def _anchored(whole: bytes, lengths: np.ndarray, number: int, offset: int):
    b = np.frombuffer(whole, np.uint8)
    if len(b) < SPAN:
        return
    h = _gram_hashes(b)
    low = np.uint64((1 << POSITION_BITS) - 1)
    # Least hash, leftmost on a tie: high bits of the hash over the position.
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[:-1], m[1:])
    at = (m & low).astype(np.int64)
    ends = np.cumsum(lengths)
    inside = np.arange(len(at)) + SPAN <= np.repeat(ends, lengths)[: len(at)]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]]) & inside
    lo = np.flatnonzero(new)
    if not len(lo):
        return
    # A run ends where the next window has another anchor or leaves its text.
    stop = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:], [True]]))
    text = np.searchsorted(ends, lo, side="right")
    yield text + number, lo - (ends - lengths)[text] + offset, stop - lo + 1, h[at[lo]]


def _packed(h: np.ndarray, order: np.ndarray, where: np.ndarray) -> bytes:
    """Three columns of numbers as planes of like bytes, which the shuffle's compression takes well."""
    rows = np.stack([h.view(np.uint64), order.view(np.uint64), where.view(np.uint64)])
    return np.ascontiguousarray(rows.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(3, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(3, -1).view(np.uint64)


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """``order, place`` of all pieces whose anchor occurs in two documents or more; a place packs first window, windows, hash bits."""
    shift = np.uint64(65 - buckets.bit_length())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def deal(got: list, order: np.ndarray) -> pa.RecordBatch:
            text, lo, n, h = map(np.concatenate, zip(*got))
            bucket = (h >> shift).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, h, own, where = bucket[by], h[by], order[text[by]], (lo[by] << 8) | n[by]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [_packed(h[s:e], own[s:e], where[s:e]) for s, e in zip(starts, np.append(starts[1:], len(bucket)))]
            return pa.record_batch([pa.array(bucket[starts]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for b in batches:
            order, got, held = b.column(0).to_numpy(), [], 0
            for block in anchors([t.as_py() or b"" for t in b.column(1)]):
                got.append(block)
                held += len(block[0])
                if held > HELD:
                    yield deal(got, order)
                    got, held = [], 0
            if got:
                yield deal(got, order)

    def pick(parts: list[bytes]) -> pa.RecordBatch:
        h, order, where = np.concatenate([_unpacked(p) for p in parts], axis=1)
        by = np.argsort(h, kind="stable")
        h, order, where = h[by], order[by].view(np.int64), where[by].view(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(order, starts) != np.maximum.reduceat(order, starts)
        keep = np.repeat(several, np.diff(np.append(starts, len(h))))
        place = (where[keep] << 16) | (h[keep] & np.uint64(0xFFFF)).astype(np.int64)
        return pa.record_batch([pa.array(order[keep]), pa.array(place)], names=["order", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != current and held:
                    yield pick(held)
                    held = []
                current = bucket
                held.append(blob.as_py())
        if held:
            yield pick(held)

    found = docs.select("order", F.col("text").cast("binary").alias("text")).mapInArrow(find, "bucket long, blob binary")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "order long, place long")


def pieces(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Each shared piece with its bytes and where it stands: ``anchor, piece, least, most, places``.

    A piece that occurs often in one batch of documents is one row. Places are checked against the text at hand.
    """
    place_type = pa.list_(pa.struct([("order", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int64())]))

    def rows(found: dict[tuple[int, bytes], list[tuple[int, int, int]]]) -> pa.RecordBatch:
        places = list(found.values())
        counts = np.cumsum([0, *map(len, places)], dtype=np.int32)
        flat = np.array([p for ps in places for p in ps], np.int64)
        inner = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["order", "text_key", "lo"])
        return pa.record_batch(
            [
                pa.array(np.array([k[0] for k in found], np.uint64).view(np.int64)), pa.array([k[1] for k in found], pa.binary()),
                pa.array(np.minimum.reduceat(flat[:, 0], counts[:-1])), pa.array(np.maximum.reduceat(flat[:, 0], counts[:-1])),
                pa.ListArray.from_arrays(pa.array(counts), inner).cast(place_type),
            ],
            names=["anchor", "piece", "least", "most", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        held = 0
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(2)]
            order, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            wanted = [np.sort(p.values.to_numpy()) for p in b.column(3)]
            for text, lo, n, h in anchors(texts):
                place = (((lo << 8) | n) << 16) | (h & np.uint64(0xFFFF)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                keep = np.concatenate([np.isin(place[s:e], wanted[text[s]]) for s, e in zip(starts, np.append(starts[1:], len(text)))])
                text, lo, n, h = text[keep], lo[keep], n[keep], h[keep]
                for t, s, m, a, o, k in zip(*(x.tolist() for x in (text, lo, n, h, order[text], key[text]))):
                    found.setdefault((a, texts[t][s : s + m + SPAN - 1]), []).append((o, k, s))
                held += len(text)
                if held > HELD:
                    yield rows(found)
                    found, held = {}, 0
        if found:
            yield rows(found)

    per = shared.groupBy("order").agg(F.collect_list("place").alias("places"))  # as long as a document at most
    joined = docs.select("order", "text_key", F.col("text").cast("binary").alias("text")).join(per, "order")
    return joined.mapInArrow(
        run, "anchor long, piece binary, least long, most long, places array<struct<order:bigint,text_key:bigint,lo:bigint>>"
    )


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and suffix order of some texts, each closed by a zero.

    The transform holds the ``STEP`` symbols before each suffix, not one. Suffixes run on around the end and are compared
    to beyond ``SPAN``, by ranks of strings twice as long each time.
    """
    s = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    real = np.ones(len(s), bool)
    real[np.cumsum([len(t) + 1 for t in texts]) - 1] = False
    s = s + real.view(np.uint8)  # UTF-8 has no byte above 0xF4
    windows = np.lib.stride_tricks.sliding_window_view(np.resize(s, len(s) + STEP - 1), STEP)
    grams = np.ascontiguousarray(windows).view(">u8").ravel().astype(np.uint64)
    rank, order = _ranked(grams)
    width = STEP
    while width < SPAN:
        rank, order = _ranked(rank * np.uint64(len(s)) + np.roll(rank, -width))
        width *= 2
    return grams[(order - STEP) % len(s)], order


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each value, equal ones alike, and an order of them."""
    order = np.argsort(values)
    by = values[order]
    rank = np.empty(len(values), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[False], by[1:] != by[:-1]]), dtype=np.uint64)
    return rank, order


def merge(transforms: list[np.ndarray], depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms, and the class of each row: equal numbers, equal first ``depth`` symbols.

    The interleave is refined: from an order by ``t`` symbols, a stable distribution of the ``STEP`` symbols before each row gives
    the order by ``t + STEP``. No suffix is sorted again; each shard's rows keep their own order throughout. Where the
    symbols or the class of the tail change, the common prefix ends.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    classes = np.zeros(len(shard), np.int32)
    grams = np.concatenate(transforms)
    before, _ = _ranked(grams)
    last = grams & np.uint64((1 << 8 * (depth % STEP)) - 1)
    bits = np.uint64(max(1, len(shard) - 1).bit_length())
    place = np.arange(len(shard), dtype=np.uint64)
    for at in range(0, depth, STEP):
        symbols = np.empty(len(shard), np.uint64)
        symbols[np.argsort(shard, kind="stable")] = before if at + STEP <= depth else _ranked(last)[0]
        # The place beside the rank makes the sort stable.
        both = np.sort(symbols << bits | place)
        step = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        symbols, classes, shard = both >> bits, classes[step], shard[step]
        new = (symbols[1:] != symbols[:-1]) | (classes[1:] != classes[:-1])
        classes = np.concatenate([np.zeros(1, np.int32), np.cumsum(new, dtype=np.int32)])
    return shard, classes


def least_in_class(texts: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of ``SPAN`` bytes in ``texts``: its text, offset, and the least of ``least`` over the texts that hold it."""
    shards, size = [[]], 0
    for n, t in enumerate(texts):
        if size > SHARD and len(shards) < 250:
            shards.append([])
            size = 0
        shards[-1].append(n)
        size += len(t)
    built = [transform([texts[n] for n in s]) for s in shards]
    shard, classes = merge([b for b, _ in built])
    # Places in all texts put end to end, each closed by a zero.
    begins = np.cumsum([0, *[len(order) for _, order in built]])
    at = np.empty(len(shard), np.int64)
    at[np.argsort(shard, kind="stable")] = np.concatenate([order + begin for (_, order), begin in zip(built, begins)])
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1)
    text = np.repeat(np.arange(len(texts)), lengths + 1)[at]
    whole = at + SPAN < ends[text]
    at, text, classes = at[whole], text[whole], classes[whole]
    starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    value = np.empty(len(shard), np.int64)
    value[at] = np.repeat(np.minimum.reduceat(least[text], starts), np.diff(np.append(starts, len(classes))))
    at = np.sort(at)
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - lengths - 1)[text], value[at]


def meeting(flat: np.ndarray, lengths: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which pieces may hold a string of ``SPAN`` bytes that another piece of their anchor holds.

    Equal strings have their anchor at one offset, so they agree in ``SIDE`` bytes before it or in as many behind it. Pieces
    that share neither side with another share no string.
    """
    h = _gram_hashes(flat)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # An anchor is where its gram stands first.
    found = np.flatnonzero(h == np.repeat(anchor.view(np.uint64), lengths)[: len(h)])
    at = found[np.searchsorted(found, starts)]
    keys = []
    for side, there in ((-SIDE, at - SIDE >= starts), (SIDE, at + SIDE + GRAM <= ends)):
        key = np.arange(2 * len(at), dtype=np.uint64).reshape(2, -1)[0 if side < 0 else 1]  # of this piece only
        key[there] = (h[at[there] + side] ^ np.uint64(side < 0)) + anchor.view(np.uint64)[there] * np.uint64(_P)
        keys.append(key)
    _, which, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return (n[which] > 1).reshape(2, -1).any(axis=0)


def repeats(found: DataFrame) -> DataFrame:
    """``anchor, piece_id, runs``: for each different piece its runs of strings with the least document that holds them."""
    # Dealt by anchor once; the pieces of an anchor are then made different where they are.
    dealt = found.select("anchor", "piece", "least", "most").repartition("anchor")
    different = dealt.groupBy("anchor", "piece").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    different = different.select("anchor", F.xxhash64("piece").alias("piece_id"), "piece", "least", "most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shaped(anchor, piece_id, n, first, last, least) -> pa.RecordBatch:
            """Pieces with ``n`` runs each."""
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (first, last, least)], ["first", "last", "least"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            return pa.record_batch([pa.array(anchor), pa.array(piece_id), pa.ListArray.from_arrays(offsets, runs)], names=["anchor", "piece_id", "runs"])

        def solve(pieces: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor, piece_id, least, most = (pieces.column(c).to_numpy() for c in (0, 1, 3, 4))
            piece = pieces.column(2).combine_chunks()
            lengths = pc.binary_length(piece).to_numpy().astype(np.int64)
            same = np.concatenate([[False], anchor[1:] == anchor[:-1], [False]])
            met = np.flatnonzero(same[1:] | same[:-1])
            if len(met):
                flat = np.frombuffer(b"".join(piece.take(pa.array(met)).to_pylist()), np.uint8)
                met = met[meeting(flat, lengths[met], anchor[met])]
            # Nothing to merge: all strings of such a piece are in the same documents.
            alone = np.ones(len(anchor), bool)
            alone[met] = False
            alone = np.flatnonzero(alone & (least < most))
            yield shaped(anchor[alone], piece_id[alone], np.ones(len(alone), np.int64), np.zeros(len(alone)), lengths[alone] - SPAN, least[alone])
            if not len(met):
                return
            text, offset, value = least_in_class(piece.take(pa.array(met)).to_pylist(), least[met])
            keep = value < most[met][text]
            text, offset, value = text[keep], offset[keep], value[keep]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1]) | (offset[1:] != offset[:-1] + 1)])[: len(text)]
            at = np.flatnonzero(new)
            if len(at):
                of, n = np.unique(text[at], return_counts=True)
                yield shaped(anchor[met][of], piece_id[met][of], n, offset[at], offset[np.append(at[1:], len(text)) - 1], value[at])

        held, size = [], 0
        for pieces in by_bucket(batches, 1):
            held.append(pieces)
            size += pieces.nbytes
            if size > CHUNK:
                yield from solve(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield from solve(pa.concat_tables(held))

    sorted_ = different.sortWithinPartitions("anchor")
    return sorted_.mapInArrow(run, "anchor long, piece_id long, runs array<struct<first:bigint,last:bigint,least:bigint>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Each byte goes that lies in a string of ``SPAN`` bytes which also starts in a document with a smaller ``doc_id``; strings
    never cross documents and are those of the input. Null texts count as empty; texts shorter than ``SPAN`` are whole. Rows with
    one id do not remove from each other; a null id is larger than all. An empty table gives none; other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("order"),
        F.coalesce(text_key(F.col("text")), F.lit(0)).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"),
    )
    base = cut(rows.select("doc_id", "order", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256")))
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = 1 << max(6, (total // PER_BUCKET).bit_length())
    found = cut(pieces(rows, cut(shared_anchors(rows, buckets))))
    runs = cut(repeats(found))
    hits = found.select("anchor", F.xxhash64("piece").alias("piece_id"), "places").join(runs, ["anchor", "piece_id"])
    placed = hits.select(F.explode("places").alias("p"), "runs").select("p.*", F.explode("runs").alias("r"))
    one = placed.where(F.col("order") > F.col("r.least"))
    spans = one.groupBy("order", "text_key").agg(F.collect_list(F.struct((F.col("lo") + F.col("r.first")).alias("start"), (F.col("lo") + F.col("r.last") + SPAN).alias("end"))).alias("spans"))
    spans = cut(spans)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, n_spans, sha = [], [], []
            for text, listed in zip(b.column(2), b.column(3)):
                raw, kept, at, gone, runs_ = text.as_py(), [], 0, 0, 0
                s = listed.values
                start, end = s.field(0).to_numpy(), s.field(1).to_numpy()
                by = np.argsort(start, kind="stable")
                start, reach = start[by], np.maximum.accumulate(end[by])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                for a, z in zip(start[new].tolist(), reach[np.append(new[1:], len(start)) - 1].tolist()):
                    kept.append(raw[at:a])
                    gone, runs_, at = gone + z - a, runs_ + 1, z
                kept.append(raw[at:])
                removed.append(gone)
                n_spans.append(runs_)
                sha.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)],
                names=["order", "text_key", "n_removed", "n_spans", "kept_sha256"],
            )

    touched = rows.select("order", "text_key", F.col("text").cast("binary").alias("text")).join(spans, ["order", "text_key"]).select("order", "text_key", "text", "spans")
    cleaned = cut(touched.mapInArrow(clean, "order long, text_key long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["order", "text_key"]))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(cleaned, ["order", "text_key"], "left").select(
        "doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")
    )
