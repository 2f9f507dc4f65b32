"""Substring dedup: paragraph MinHash banding, exact verification, removals clustered by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bucket, cut, join_documents, text_key
from .components import roots

SHINGLE, SIMILARITY = 5, 0.8
# Tuned for recall: a pair at similarity 0.8 shares one of 9 bands of 3 minima with probability 1 - (1 - 0.8^3)^9 = 0.998.
BANDS, ROWS = 9, 3
# A passage of 50 words holds 26 pieces of 25 words; the least of any 26 neighbouring pieces is taken, so the same passage
# gives at least one same piece at any offset in any line.
PASSAGE, PIECE = 50, 25
SEED = 42
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _hashes(ws: list[bytes]) -> list[int]:
    return [xxhash.xxh64_intdigest(g, SEED) for g in map(b" ".join, zip(*(ws[i:] for i in range(SHINGLE))))]


def shingle_set(paragraph: bytes) -> np.ndarray:
    """Sorted different hashes of the ``SHINGLE``-word shingles; shorter paragraphs have none."""
    return np.unique(np.array(_hashes(paragraph.lower().split()), np.uint64))


def _bands(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of band numbers for each run of shingle hashes; a band is made of ``ROWS`` minima."""
    out = np.zeros((BANDS, len(starts)), np.uint64)
    for i in range(BANDS * ROWS):
        mixed = hashes * _MUL[i] + _ADD[i]
        mixed ^= mixed >> np.uint64(29)
        band = out[i // ROWS]
        band ^= np.minimum.reduceat(mixed, starts)
        band *= np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(31)
    return out.T.view(np.int64)


def pieces(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the pieces chosen in a line, from its shingle hashes in order; none below ``PASSAGE`` words."""
    n = len(shingles) + SHINGLE - PIECE
    if n <= PASSAGE - PIECE:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for i in range(0, PIECE, SHINGLE):
        mixed = (mixed ^ shingles[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    near = np.lib.stride_tricks.sliding_window_view(mixed, PASSAGE - PIECE + 1)
    at = np.unique(near.argmin(1) + np.arange(len(near)))
    return at.astype(np.int32), mixed[at].view(np.int64)


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, at, p1, p2, bands, pos, piece`` for each paragraph (line) of at least ``SHINGLE`` words.

    ``p1, p2`` are two hashes of its lower-cased words: 128 bits that stand for the text. ``pos, piece``: its chosen pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda c: pa.array(np.array(c, np.uint64).view(np.int64))
        for b in batches:
            row, at, p1, p2, hashes, starts, chosen = [], [], [], [], [], [], []

            def rows() -> pa.RecordBatch:
                flat = _bands(np.array(hashes, np.uint64), np.array(starts)) if row else np.empty((0, BANDS), np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * BANDS, pa.int32()), pa.array(np.ascontiguousarray(flat).ravel()))
                take = pa.array(row, pa.int64())
                cols = [b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int32()), signed(p1), signed(p2), listed]
                cols += [pa.array([c[0] for c in chosen], pa.list_(pa.int32())), pa.array([c[1] for c in chosen], pa.list_(pa.int64()))]
                return pa.record_batch(cols, names=["doc_id", "text_key", "at", "p1", "p2", "bands", "pos", "piece"])

            for r, text in enumerate(b.column(2)):
                for n, p in enumerate(_lines(text.as_py())):
                    ws = p.lower().split()
                    if len(ws) < SHINGLE:
                        continue
                    plain = b" ".join(ws)
                    row.append(r)
                    at.append(n)
                    p1.append(xxhash.xxh64_intdigest(plain, 1))
                    p2.append(xxhash.xxh64_intdigest(plain, 2))
                    starts.append(len(hashes))
                    own = _hashes(ws)
                    hashes.extend(own)
                    chosen.append(pieces(np.array(own, np.uint64)))
                if len(hashes) > 200_000:
                    yield rows()
                    row, at, p1, p2, hashes, starts, chosen = [], [], [], [], [], [], []
            yield rows()

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_key(F.col("text")), F.lit(0)).alias("text_key"), "text")
    return cols.mapInArrow(run, "doc_id long, text_key long, at int, p1 long, p2 long, bands array<long>, pos array<int>, piece array<long>")


def colliding(texts: DataFrame) -> DataFrame:
    """``band, value, p1`` of the buckets that hold more than one text, from ``p1, bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bucket(batches, 2):
            band, value, p1 = (t[c].to_numpy() for c in ("band", "value", "p1"))
            new = np.concatenate([[True], (band[1:] != band[:-1]) | (value[1:] != value[:-1])])
            more = np.bincount(np.cumsum(new) - 1) > 1
            keep = more[np.cumsum(new) - 1]
            yield pa.record_batch([pa.array(band[keep]), pa.array(value[keep]), pa.array(p1[keep])], names=["band", "value", "p1"])

    rows = texts.select(F.posexplode("bands").alias("band", "value"), "p1")
    return rows.repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(run, "band int, value long, p1 long")


def _similar(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
    """Which members of a bucket have a Jaccard similarity of at least ``SIMILARITY`` with member ``i``."""
    own = flat[starts[i] : starts[i] + sizes[i]]
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    shared = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
    return shared >= SIMILARITY * (sizes + sizes[i] - shared) - 1e-9


def bucket_labels(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Components of one bucket under exact similarity. Leaders link what is similar to them; then each member outside the
    largest component meets all. Within one component no further comparison is needed, so a large group costs little
    more than one pass for each leader."""
    label, waiting = np.arange(len(sizes)), np.ones(len(sizes), bool)

    def link(i: int) -> np.ndarray:
        near = _similar(flat, starts, sizes, i)
        ids = np.unique(label[near])
        if len(ids) > 1:
            label[np.isin(label, ids)] = ids[0]
        return near

    while waiting.any():
        i = int(np.argmax(waiting))
        waiting[link(i)] = False
        waiting[i] = False
    ids, n = np.unique(label, return_counts=True)
    for i in np.flatnonzero(label != ids[np.argmax(n)]) if len(ids) > 1 else ():
        link(int(i))
    return label


def similar_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that connect all similar different texts; ``texts``: ``p1, p2, bands, first`` (where each stands first)."""
    buckets = cut(colliding(texts.select("p1", "bands")))
    need = texts.join(buckets.select("p1").distinct(), "p1", "left_semi").select("first.doc_id", "first.text_key", "first.at", "p1", "p2")
    need = need.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "p1", "p2")).alias("wanted"))  # as long as a document at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p1, p2, sets = [], [], []
            for text, wanted in zip(b.column(0), b.column(1)):
                lines = _lines(text.as_py())
                for w in wanted.as_py():
                    p1.append(w["p1"])
                    p2.append(w["p2"])
                    sets.append(shingle_set(lines[w["at"]]).view(np.int64))
            yield pa.record_batch([pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["p1", "p2", "shingles"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(text_key(F.col("text")), F.lit(0)).alias("k"), "text").dropDuplicates(["d", "k"])
    found = keyed.join(need, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))).select("text", "wanted")
    sets = found.mapInArrow(extract, "p1 long, p2 long, shingles array<long>")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bucket(batches, 2):
            t = t.combine_chunks()
            band, value = t["band"].to_numpy(), t["value"].to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (value[1:] != value[:-1])]))
            col = t["shingles"].combine_chunks()
            offsets, flat = col.offsets.to_numpy(), col.values.to_numpy().view(np.uint64)
            label = np.arange(t.num_rows)
            for s, e in zip(begin, np.append(begin[1:], t.num_rows)):
                if e - s > 1:
                    o = offsets[s : e + 1]
                    label[s:e] = s + bucket_labels(flat[o[0] : o[-1]], o[:-1] - o[0], np.diff(o))
            other = np.flatnonzero(label != np.arange(t.num_rows))
            take = lambda c, at: pa.array(t[c].to_numpy()[at])
            yield pa.record_batch(
                [take("p1", other), take("p2", other), take("p1", label[other]), take("p2", label[other])], names=["u1", "u2", "v1", "v2"]
            )

    rows = buckets.join(sets, "p1").select("band", "value", "p1", "p2", "shingles")
    edges = rows.repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(verify, "u1 long, u2 long, v1 long, v2 long")
    return edges.select(node(F.col("u1"), F.col("u2")).alias("u"), node(F.col("v1"), F.col("v2")).alias("v")).distinct()


def node(p1, p2):
    """A text's name: its 128 bits as text."""
    return F.concat(F.lpad(F.hex(p1), 16, "0"), F.lpad(F.hex(p2), 16, "0"))


def passages(lines: DataFrame, every: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_found, n_gone, found_in``: repeated passages inside the lines that stay.

    Pieces are equal or not: one word edited in 25 leaves a similarity below ``SIMILARITY`` but at the ends. The first place
    of a piece by (doc_id, position) stays. Overlapping and adjacent pieces of a line are one passage. Only pieces that occur
    twice among ``every`` paragraph are written.
    """
    spot = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "at", "pos")
    twice = every.select(F.explode("piece").alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece")
    spread = lines.select("doc_id", "text_key", "at", F.explode(F.arrays_zip("pos", "piece")).alias("z")).select("doc_id", "text_key", "at", "z.pos", "z.piece")
    every = cut(spread.join(twice, "piece", "left_semi").select("doc_id", "text_key", "at", "pos", "piece"))
    more = every.groupBy("piece").agg(F.min(spot).alias("kept"), F.max(spot).alias("last")).where("kept != last").drop("last")
    found = every.join(more, "piece").dropDuplicates(["doc_id", "text_key", "at", "pos"]).withColumn("gone", spot != F.col("kept"))
    before = Window.partitionBy("doc_id", "text_key", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    new = lambda last: F.coalesce(F.col("pos") > last + PIECE, F.lit(True)).cast("long")
    found = found.withColumn("starts", new(F.max("pos").over(before)))
    found = found.withColumn("starts_gone", F.when(F.col("gone"), new(F.max(F.when(F.col("gone"), F.col("pos"))).over(before))).otherwise(0))
    return found.groupBy("doc_id", "text_key").agg(
        F.sum("starts").alias("n_found"), F.sum("starts_gone").alias("n_gone"), F.collect_set(F.when(F.col("gone"), F.col("kept.doc_id"))).alias("found_in")
    )


def repeated(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, text_key, n_paragraphs, n_repeated, n_removed, kept_in``.

    Paragraphs whose five-word shingles have a Jaccard similarity of 0.8 or more are linked; equal ones are one text, so
    copies cost nothing. Of each component the first paragraph by (doc_id, position) stays, all others are removed.
    ``n_repeated`` counts paragraphs in components of two or more, ``kept_in`` lists the documents that keep what this one
    loses. Lines that stay are searched for passages of ``PASSAGE`` words or more that stand in an earlier line that stays, at any
    offset; each counts as one more paragraph. Paragraphs of fewer than five words have no shingle and stay; null texts have no paragraphs. Rows that repeat one id
    and text are one document with one result each; a null ``doc_id`` comes last; other columns are not read.
    """
    every = cut(paragraphs(docs).withColumn("spot", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "at")))
    texts = cut(every.groupBy("p1", "p2").agg(F.min("spot").alias("first"), F.max("spot").alias("last"), F.first("bands").alias("bands")))
    root = roots(similar_texts(docs, texts))
    named = texts.withColumn("node", node(F.col("p1"), F.col("p2")))
    named = named.join(root, "node", "left").select("p1", "p2", "first", "last", F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("root").agg(F.min("first").alias("kept"), F.max("last").alias("last")).where("kept != last").drop("last")
    in_groups = cut(named.select("p1", "p2", "root").join(groups, "root"))
    spots = every.select("doc_id", "text_key", "spot", "p1", "p2", "pos", "piece").join(in_groups, ["p1", "p2"], "left")
    gone = F.col("kept").isNotNull() & (F.col("spot") != F.col("kept"))
    # Rows that repeat list each of their lines more than once; the sets are as long as a document at most.
    lines = lambda c: F.size(F.collect_set(c))
    per = spots.groupBy("doc_id", "text_key").agg(
        lines(F.col("spot.at")).alias("n_paragraphs"), lines(F.when(F.col("kept").isNotNull(), F.col("spot.at"))).alias("n_repeated"),
        lines(F.when(gone, F.col("spot.at"))).alias("n_removed"),
        F.array_sort(F.collect_set(F.when(gone, F.col("kept.doc_id")))).alias("kept_in"),
    )
    inside = passages(spots.where(~gone).select("doc_id", "text_key", "spot.at", "pos", "piece"), every)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_key(F.col("text")), F.lit(0)).alias("text_key"))
    out = join_documents(join_documents(rows, per, "left"), inside, "left")
    total = lambda c, more: (F.coalesce(c, F.lit(0)) + F.coalesce(more, F.lit(0))).cast("long").alias(c)
    ids = lambda c: F.coalesce(c, F.array().cast("array<long>"))
    return out.select(
        "doc_id", "text_key", total("n_paragraphs", "n_found"), total("n_repeated", "n_found"), total("n_removed", "n_gone"),
        F.array_sort(F.array_union(ids("kept_in"), ids("found_in"))).alias("kept_in"),
    )
