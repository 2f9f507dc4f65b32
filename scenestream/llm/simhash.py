"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, cut, text_key, unused
from .components import roots

SEED = 42
# Buckets up to this size are compared member by member, all of a batch at once.
SMALL_BUCKET = 64


def fingerprint(text: bytes, k: int) -> int:
    """Majority bits of the XXH64 of all ``k``-word shingles; no words give zero."""
    ws = text.lower().split()
    if not ws:
        return 0
    grams = [b" ".join(ws)] if len(ws) < k else list(map(b" ".join, zip(*(ws[i:] for i in range(k)))))
    counts = np.zeros(64, np.int64)
    for s in range(0, len(grams), 4096):
        part = grams[s : s + 4096]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, text_key, fingerprint`` (a signed long) for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", k) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found)], names=["doc_id", "text_key", "fingerprint"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_key(F.col("text")), F.lit(0)).alias("text_key"), "text")
    return cols.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def _masks(distance: int, blocks: int) -> list[int]:
    """All choices of blocks that close fingerprints may share: of ``blocks``, ``distance`` can differ."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` members the least one of its component under the links ``a``, ``b``."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _lookup_labels(fps: np.ndarray, mask: int, distance: int) -> np.ndarray:
    """Components of one sorted bucket by looking up every fingerprint that is near; time in proportion to the members."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    left, right = [], []
    for n in range(1, distance + 1):
        for c in combinations(free, n):
            other = fps ^ np.uint64(sum(c))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = np.flatnonzero(fps[at] == other)
            left.append(hit)
            right.append(at[hit])
    return _labels(len(fps), np.concatenate(left), np.concatenate(right))


def _leader_labels(fps: np.ndarray, distance: int) -> np.ndarray:
    """Components of one bucket: leaders link what is near them; then what lies outside the largest component meets all."""
    label, waiting = np.arange(len(fps)), np.ones(len(fps), bool)

    def link(i: int) -> np.ndarray:
        near = np.bitwise_count(fps ^ fps[i]) <= distance
        ids = np.unique(label[near])
        if len(ids) > 1:
            label[np.isin(label, ids)] = ids[0]
        return near

    while waiting.any():
        waiting[link(int(np.argmax(waiting)))] = False
    ids, sizes = np.unique(label, return_counts=True)
    for i in np.flatnonzero(label != ids[np.argmax(sizes)]):
        link(int(i))
    return label


def _bucket_links(fps: np.ndarray, mask: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one large bucket: each member and one of its component."""
    fps = np.sort(fps)
    free = 64 - mask.bit_count()
    lookups = sum(comb(free, n) for n in range(1, distance + 1))
    return fps, fps[_lookup_labels(fps, mask, distance) if lookups < len(fps) else _leader_labels(fps, distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Edges ``(u, v)`` between different fingerprints that connect whatever lies within ``distance`` bits.

    Each fingerprint goes to one bucket for each choice of ``blocks - distance`` blocks. The members of a bucket are
    different and share those bits, so a bucket is bounded by the values its other bits can take.
    """
    masks = _masks(distance, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows so far of the bucket still open

        def close(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """``rows``: whole buckets; columns: choice, block bits, fingerprint."""
            choice, fps = rows[0], rows[2].view(np.uint64)
            start = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]))
            size = np.diff(np.append(start, rows.shape[1]))
            bucket = np.repeat(np.arange(len(start)), size)
            large = size > SMALL_BUCKET
            keep = ~large[bucket]
            f, g = fps[keep], bucket[keep]
            left, right = [], []
            for step in range(1, int(size[~large].max(initial=1))):
                same = g[step:] == g[:-step]
                if not same.any():
                    break
                near = np.flatnonzero(same & (np.bitwise_count(f[step:] ^ f[:-step]) <= distance))
                left.append(near + step)
                right.append(near)
            if left:  # a forest, too: no more rows than members
                yield f, f[_labels(len(f), np.concatenate(left), np.concatenate(right))]
            for i in np.flatnonzero(large):
                s = slice(start[i], start[i] + size[i])
                yield _bucket_links(fps[s], masks[int(choice[start[i]])], distance)

        def out(found) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                other = a != b
                yield pa.record_batch([pa.array(a[other].view(np.int64)), pa.array(b[other].view(np.int64))], names=["u", "v"])

        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            if not rows.shape[1]:
                continue
            if held and (rows[:2] == held[-1][:2, -1:]).all():
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows], axis=1)
            tail = (rows[:2] == rows[:2, -1:]).all(0)
            held = [rows[:, tail]]
            if not tail.all():
                yield from out(close(rows[:, ~tail]))
        if held:
            yield from out(close(np.concatenate(held, axis=1)))

    fp = F.col("fingerprint")
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("choice"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    spread = distinct.select(F.explode(keys).alias("k"), "fingerprint").select("k.choice", "k.bits", "fingerprint")
    found = spread.repartition("choice", "bits").sortWithinPartitions("choice", "bits").mapInArrow(run, "u long, v long")
    # A member of many buckets is linked once to each one's root. All its links lead through the least of them, so
    # the roots are linked to that and the member keeps one link; it has few roots in a bucket of any size.
    near = found.groupBy("u").agg(F.collect_set("v").alias("vs"))
    hub = F.least("u", F.array_min("vs"))
    return near.select(F.explode(F.array_append("vs", F.col("u"))).alias("u"), hub.alias("v")).where("u != v").distinct()


def groups(docs: DataFrame, shingle: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """``doc_id, text_key, fingerprint, component_id`` for each row of ``docs``.

    Equal fingerprints are one node, whatever the number of copies; only different ones are compared. Chains count:
    ``component_id`` is the smallest ``doc_id`` that can be reached over links of at most ``distance`` bits.
    Null and blank texts have fingerprint zero. A null ``doc_id`` names no component unless all of it is null.
    Rows may repeat; an empty table gives none; other columns are not read.
    """
    rows = cut(fingerprints(docs, shingle))
    distinct = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    root = roots(links(distinct.select("fingerprint"), distance, blocks))
    member = distinct.join(root, distinct["fingerprint"] == root["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(member.join(least, "root").select("fingerprint", "root", "component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "text_key", "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """One document of each group, the one with the smallest id (then the smallest text key); all columns as they were.

    A null id is larger than all. Rows that repeat one id and text are one document. Null texts are empty ones, an empty table stays empty.
    """
    return _keep_first(docs, groups(docs, shingle, distance, blocks))


def _keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    own_id, own_key, first_id, first_key = (unused(docs, n) for n in ("__id", "__key", "__first", "__first_key"))
    marked = docs.withColumn(own_key, F.coalesce(text_key(F.col("text")), F.lit(0))).withColumn(own_id, F.col("doc_id").cast("long"))
    first = first.withColumnsRenamed({"doc_id": first_id, "text_key": first_key})
    on = F.col(own_id).eqNullSafe(F.col(first_id)) & (F.col(own_key) == F.col(first_key))
    return marked.join(first, on, "left_semi").dropDuplicates([own_id, own_key]).drop(own_id, own_key)


# --- verified by similarity -----------------------------------------------------------------------

# Near copies share this much of their five-word shingles. Their three-word fingerprints then differ in some eight of 64 bits, too many
# for one fingerprint and few blocks: two fingerprints are looked up, each by all choices of two of seven blocks, and members of a bucket
# may differ in up to twelve bits. Similarity decides.
SIMILARITY, WORDS = 0.8, 5
PRINTS, PRINT_DISTANCE, PRINT_BLOCKS, PRINT_BITS = 2, 5, 7, 12
SKETCH = "doc_id long, text_key long, node string, n long, " + ", ".join(f"f{i} long" for i in range(PRINTS))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted different hashes of the five-word shingles; of fewer words the whole sequence, of none nothing."""
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    grams = [b" ".join(ws)] if len(ws) < WORDS else map(b" ".join, zip(*(ws[i:] for i in range(WORDS))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def prints(text: bytes, k: int = 3) -> list[int]:
    """Fingerprints of the same shingles by ``PRINTS`` independent hashes."""
    ws = text.lower().split()
    if not ws:
        return [0] * PRINTS
    grams = [b" ".join(ws)] if len(ws) < k else map(b" ".join, zip(*(ws[i:] for i in range(k))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    out = []
    for _ in range(PRINTS):
        counts = np.zeros(64, np.int64)
        for s in range(0, len(h), 4096):
            counts += np.unpackbits(h[s : s + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0]))
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """Per row its key, the name of its shingle set (``node``, 128 bits), the set's size and the fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, found = [], [], []
            for t in b.column(2).cast(pa.large_binary()):
                text = t.as_py() or b""
                own = shingle_set(text)
                nodes.append(xxhash.xxh3_128_hexdigest(own.tobytes()))
                sizes.append(len(own))
                found.append(prints(text))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(PRINTS)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), *columns], names=[f.split()[0] for f in SKETCH.split(", ")]
            )

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_key(F.col("text")), F.lit(0)).alias("text_key"), "text")
    return cols.mapInArrow(run, SKETCH)


def _small_pairs(start: np.ndarray, size: np.ndarray, fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be similar, by bits and by the sizes of their sets, in all buckets of at most ``SMALL_BUCKET`` members."""
    small = np.flatnonzero(np.repeat(size <= SMALL_BUCKET, size))
    f, n, g = fps[small], sizes[small], np.repeat(np.arange(len(start)), size)[small]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, int(size[size <= SMALL_BUCKET].max(initial=1))):
        same = np.flatnonzero(g[step:] == g[:-step])
        if not len(same):
            break
        near = same[_fitting(f[same + step], n[same + step], f[same], n[same])]
        left.append(small[near + step])
        right.append(small[near])
    return np.concatenate(left), np.concatenate(right)


def _fitting(f: np.ndarray, n: np.ndarray, g: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(f ^ g) <= PRINT_BITS) & (np.minimum(n, m) >= SIMILARITY * np.maximum(n, m))


def _linked(n: int, partners: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of ``n`` members the least one of its component; ``partners(i, at)`` tells which of ``at`` member ``i`` is linked to.

    A member meets those of other components, until all outside the largest component have: no link is left out, and a large component
    costs few passes.
    """
    label, met = np.arange(n), np.zeros(n, bool)
    while True:
        waiting = (label != np.bincount(label).argmax()) & ~met
        i = int(np.argmax(waiting))
        if not waiting[i]:
            return label
        at = np.flatnonzero(label != label[i])
        ids = np.unique(label[np.append(at[partners(i, at)], i)])
        label[np.isin(label, ids)] = ids[0]
        met[i] = True


def near_groups(distinct: DataFrame) -> DataFrame:
    """``node, root``: groups whose members are to be compared, from ``node, n, f0 ...``; a node is in a few of them.

    Each node goes to one bucket for each fingerprint and choice of blocks. There, those within ``PRINT_BITS`` bits whose sets are of a
    fitting size are linked, and a component is named by its least node, under which it meets those of other buckets: two nodes
    that may be similar share a group, and a bucket gives no more rows than it has members.
    """
    masks = _masks(PRINT_DISTANCE, PRINT_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bucket(batches, 2):
            choice, bits = (t[c].to_numpy() for c in ("choice", "bits"))
            fps, sizes = t["fp"].to_numpy().view(np.uint64), t["n"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])]))
            size = np.diff(np.append(start, len(fps)))
            label = _labels(len(fps), *_small_pairs(start, size, fps, sizes))
            for s, n in zip(start[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist()):
                f, m = fps[s : s + n], sizes[s : s + n]
                label[s : s + n] = s + _linked(n, lambda i, at: _fitting(f[i], m[i], f[at], m[at]))  # noqa: B023
            other = np.flatnonzero(label != np.arange(len(fps)))
            both = (t["node"].take(pa.array(x)).combine_chunks() for x in (other, label[other]))
            pairs = pa.table([*both], names=["node", "root"]).group_by(["node", "root"]).aggregate([])
            yield from pairs.combine_chunks().to_batches()

    keys = [
        F.struct(F.lit(i * len(masks) + k).cast("long").alias("choice"), F.col(f"f{i}").bitwiseAND(F.lit(_signed(m))).alias("bits"), F.col(f"f{i}").alias("fp"))
        for i in range(PRINTS) for k, m in enumerate(masks)
    ]
    spread = distinct.select(F.explode(F.array(*keys)).alias("k"), "node", "n").select("k.choice", "k.bits", "k.fp", "node", "n")
    found = spread.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "node").mapInArrow(run, "node string, root string").distinct()
    # The least node of a group may be a member of others; in its own it is one, too.
    return found.select(F.explode(F.array(F.struct("node", "root"), F.struct(F.col("root").alias("node"), "root"))).alias("k")).select("k.*").distinct()


def candidates(distinct: DataFrame) -> DataFrame:
    """``u, v``: the pairs that meet in ``near_groups``, one by one; as many as the square of a group, so for small tables only."""
    members = near_groups(distinct)
    return members.withColumnRenamed("node", "u").join(members.withColumnRenamed("node", "v"), "root").where("u < v").select("u", "v").distinct()


def _similar_labels(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Components of one group under exact similarity; ``flat``: the members' sets one after the other, none empty."""
    sizes = np.diff(np.append(starts, len(flat)))
    words = np.unique(flat, return_inverse=True)[1]
    own = np.zeros(int(words.max(initial=0)) + 1, bool)

    def partners(i: int, at: np.ndarray) -> np.ndarray:
        mine = words[starts[i] : starts[i] + sizes[i]]
        own[mine] = True
        shared = np.add.reduceat(own[words].view(np.int8), starts, dtype=np.int64)[at]
        own[mine] = False
        return shared >= SIMILARITY * (sizes[at] + sizes[i] - shared) - 1e-9

    return _linked(len(starts), partners)


def similar(docs: DataFrame, members: DataFrame, distinct: DataFrame) -> DataFrame:
    """Edges ``u, v`` that connect what has a Jaccard similarity of ``SIMILARITY`` or more in a group of ``members``.

    The sets are made again from one document each. A group is compared in one task, whose rows are its different sets; a forest comes out.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t.as_py() or b"").tobytes() for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["node", "shingles"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bucket(batches, 1):
            t = t.combine_chunks()
            root, node = t["root"].to_numpy(), t["node"].combine_chunks()
            begin = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
            label = np.arange(t.num_rows)
            for s, e in zip(begin.tolist(), np.append(begin[1:], t.num_rows).tolist()):
                own = [np.frombuffer(x.as_buffer() or b"", np.uint64) for x in t["shingles"].slice(s, e - s)]
                label[s:e] = s + _similar_labels(np.concatenate(own), np.cumsum([0, *map(len, own[:-1])]))
            other = np.flatnonzero(label != np.arange(t.num_rows))
            yield pa.RecordBatch.from_arrays([node.take(pa.array(other)), node.take(pa.array(label[other]))], names=["u", "v"])

    asked = members.select("node").distinct()
    places = distinct.join(asked, "node", "left_semi").select("node", "first.doc_id", "first.text_key")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(text_key(F.col("text")), F.lit(0)).alias("k"), "text").dropDuplicates(["d", "k"])
    found = texts.join(places, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))).select("node", "text")
    made = cut(found.mapInArrow(sets, "node string, shingles binary"))
    both = members.join(made, "node").select("root", "node", "shingles")
    return both.repartition("root").sortWithinPartitions("root", "node").mapInArrow(judge, "u string, v string").distinct()


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, root`` for each row: groups of documents connected by pairs of a five-word Jaccard similarity of 0.8 or more.

    SimHash finds the pairs, exact similarity decides. Documents with one set of shingles are one node, whatever the number of copies.
    Texts of fewer than five words are similar to equal ones only, as are texts without words, null ones among them. Rows may repeat; a
    null ``doc_id`` is a document like any other; an empty table gives none; other columns are not read.
    """
    rows = cut(sketches(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    kept = [F.min(c).alias(c) for c in ("n", *(f"f{i}" for i in range(PRINTS)))]
    distinct = cut(rows.groupBy("node").agg(first, *kept))
    members = cut(near_groups(distinct.select("node", "n", *(f"f{i}" for i in range(PRINTS)))))
    named = roots(similar(docs, members, distinct)).withColumnRenamed("node", "member")
    named = cut(distinct.select("node").join(named, F.col("node") == F.col("member"), "left").select("node", F.coalesce("root", "node").alias("root")))
    return rows.select("doc_id", "text_key", "node").join(named, "node").select("doc_id", "text_key", "root")


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """One document of each of the ``similar_groups``, chosen as in ``keep_one``; all columns as they were."""
    return _keep_first(docs, similar_groups(docs))
