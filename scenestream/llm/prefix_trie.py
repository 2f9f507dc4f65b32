"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt to shards by ranges of their id. A shard holds one bitset of conversations for each (position, turn);
walking depth first, the bitset of a node meets the postings of its next position, which gives its children, their popcounts and
the conversations that end in it. Nodes of all shards are merged by the digest of their path; sums over subtrees follow by
doubling the reach over the nodes that two or more conversations share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, cut, join_uneven, word_count

# A shard is closed at so many conversations or turns. A longer conversation goes on in the next shard.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 65_536

ROOT = bytes(16)
KEY, PARENT = ["k1", "k2"], ["p1", "p2"]
PIECES = "k1 long, k2 long, p1 long, p2 long, depth long, words long, n long, conv_id long, ends array<long>"


@dataclass
class Trie:
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and the key ``k1, k2`` of the path.
    ``ends``: ``k1, k2, ids``, the conversations that end in a node, in sorted pieces with separate ranges of ids."""

    nodes: DataFrame
    ends: DataFrame


def digested(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, words`` of rows ``conv_id, turn, role, text``.

    ``pos`` counts a conversation's turns from 0 by ``turn``, null first; turns of one number follow each other by their
    digest, repeated rows all count. The digest (128 bits of SHA-256) names role and text, of which null is empty. Rows without
    a ``conv_id`` belong to no conversation. Texts end here; only digests travel.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.unhex(F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32)))
    known = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", named.alias("digest"), word_count(F.col("text"), SPACED_WORD).alias("words")
    )
    at = "row_number() over (partition by conv_id order by turn nulls first, digest) - 1"
    return known.selectExpr("conv_id", f"cast({at} as long) as pos", "digest", "words")


@dataclass
class Shard:
    """Postings of the conversations read since the last flush."""

    ids: list[int] = field(default_factory=list)
    turns: list[list[bytes]] = field(default_factory=list)
    offset: int = 0  # position at which the first conversation goes on
    carried: tuple | None = None  # (key, parent, words) of the node at which it does
    postings: dict[tuple[int, bytes], int] = field(default_factory=dict)
    ends: dict[int, int] = field(default_factory=dict)
    words: dict[bytes, int] = field(default_factory=dict)
    size: int = 0

    def open(self, conv: int) -> None:
        self.ids.append(conv)
        self.turns.append([])

    def depth(self) -> int:
        """Turns of the open conversation, those of earlier shards included."""
        return len(self.turns[-1]) + (self.offset if len(self.ids) == 1 else 0)

    def add(self, digest: bytes, words: int) -> None:
        at, bit = (self.depth(), digest), 1 << (len(self.ids) - 1)
        self.postings[at] = self.postings.get(at, 0) | bit
        self.turns[-1].append(digest)
        self.words[digest] = words
        self.size += 1

    def close(self) -> None:
        if self.ids:
            d = self.depth()
            self.ends[d] = self.ends.get(d, 0) | 1 << (len(self.ids) - 1)

    def flush(self, open_one: bool = False) -> tuple[pa.RecordBatch, Shard]:
        """The nodes of this shard and the next one; with ``open_one`` the last conversation goes on there."""
        out: list[tuple] = []
        following, last = Shard(), len(self.ids) - 1
        everyone = (1 << len(self.ids)) - 1
        # depth, members, key, parent, words, whether the members are counted here
        stack = []
        if self.carried:
            everyone ^= 1
            stack.append((self.offset, 1, *self.carried, False))
        if everyone:
            stack.append((0, everyone, ROOT, ROOT, 0, True))
        while stack:
            depth, members, key, parent, words, counted = stack.pop()
            ended = members & self.ends.get(depth, 0)
            out.append((key, parent, depth, words, members.bit_count() if counted else 0, self.ids[_lowest(members)], self._ids(ended)))
            rest = members ^ ended
            if open_one and rest >> last & 1 and self._length(last) == depth:
                rest ^= 1 << last
                following = Shard(ids=[self.ids[last]], turns=[[]], offset=depth, carried=(key, parent, words))
            while rest:
                i = _lowest(rest)
                turn = self.turns[i][depth - (self.offset if i == 0 else 0)]
                child = rest & self.postings[depth, turn]
                rest ^= child
                stack.append((depth + 1, child, hashlib.blake2b(key + turn, digest_size=16).digest(), key, self.words[turn], True))
        return _batch(out), following

    def _length(self, i: int) -> int:
        return len(self.turns[i]) + (self.offset if i == 0 else 0)

    def _ids(self, bits: int) -> list[int]:
        found = []
        while bits:
            i = _lowest(bits)
            found.append(self.ids[i])
            bits &= bits - 1
        return found


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _batch(nodes: list[tuple]) -> pa.RecordBatch:
    key, parent, depth, words, n, conv, ends = zip(*nodes) if nodes else ((),) * 7
    halves = [np.frombuffer(b"".join(part), "<i8").reshape(-1, 2)[:, i] for part in (key, parent) for i in (0, 1)]
    arrays = [pa.array(h) for h in halves] + [pa.array(c, pa.int64()) for c in (depth, words, n, conv)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(ends, pa.list_(pa.int64()))], names=[f.split()[0] for f in PIECES.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range of conversations, sorted by (conv_id, pos), in shards of bounded size."""
    shard, current = Shard(), None
    for b in batches:
        for conv, digest, words in zip(*(b.column(i).to_pylist() for i in range(3))):
            if conv != current:
                shard.close()
                if len(shard.ids) >= SHARD_CONVERSATIONS or shard.size >= SHARD_TURNS:
                    found, shard = shard.flush()
                    yield found
                shard.open(conv)
                current = conv
            if digest is not None:
                shard.add(digest, words)
                if shard.size >= 2 * SHARD_TURNS:
                    found, shard = shard.flush(open_one=True)
                    yield found
    shard.close()
    if shard.ids:
        yield shard.flush()[0]


def prefix_trie(turns: DataFrame) -> Trie:
    """The trie of ``conv_id, pos, digest, words`` (see ``digested``).

    A conversation's turns are those rows that have a digest, by ``pos``; a row without one only says that the conversation
    exists, so conversations without turns end in the root. No conversations give no nodes, not even a root. A node is named
    by its smallest member ``conv_id`` and its ``depth``. Conversations of any length: their turns are read as a stream, sorted
    outside of memory; one conversation is read by one task, since each path's digest builds on the one before.
    """
    ordered = turns.select("conv_id", "digest", "words", "pos").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").drop("pos")
    pieces = cut(ordered.mapInArrow(_shards, PIECES))
    least = [F.min(c).alias(c) for c in ("conv_id", "depth", "words", *PARENT)]
    merged = cut(pieces.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), *least))
    below = (
        merged.where("depth > 0")
        .groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        .agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    )
    nodes = cut(merged.join(below, KEY, "left").fillna(0, ["n_children", "lone"]))
    shared = _subtrees(nodes.where("n_convs > 1"))
    # Below a node of one conversation there is one leaf and nothing to save; its parent has the same name or is shared.
    parents = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"), "n_children")
    full = nodes.join(shared.select(*KEY, "n_leaves", "saved_tokens"), KEY, "left").withColumns(
        {"n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_tokens": F.coalesce("saved_tokens", F.lit(0))}
    )
    full = cut(full)
    named = join_uneven(full, parents, PARENT, "n_children", full.count())
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id")
    out = named.select(*KEY, "conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens")
    return Trie(out, pieces.where(F.size("ends") > 0).select(*KEY, F.col("ends").alias("ids")))


def _subtrees(shared: DataFrame) -> DataFrame:
    """Leaves and savings of each subtree. In each round a node adds the sums of those ``reach`` levels below it, and ``reach`` doubles."""
    rows = shared.select(
        *KEY, "conv_id", "depth", "n_children",
        *[F.when(F.col("depth") > 1, F.col(p)).alias(u) for p, u in zip(PARENT, ("u1", "u2"))],
        (F.col("depth") == 1).alias("under_root"),
        (F.col("lone") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    root = np.frombuffer(ROOT, "<i8").tolist()
    rows = cut(rows)
    size = rows.agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    reach = 1
    # The node ``reach`` levels up is (u1, u2), or the root where ``under_root`` says so: most nodes end there, and it has no upper node.
    while size["d"] and reach <= size["d"]:
        up = [F.when(F.col("under_root"), F.lit(r)).otherwise(F.col(u)).alias(k) for r, u, k in zip(root, ("u1", "u2"), KEY)]
        gain = (
            rows.select(*up, "n_leaves", "saved_tokens").where("k1 is not null").groupBy(*KEY)
            .agg(F.sum("n_leaves").alias("g_leaves"), F.sum("saved_tokens").alias("g_saved"), F.count("*").alias("uses"))
        )
        more = cut(rows.join(gain, KEY, "left").fillna(0, ["g_leaves", "g_saved", "uses"]))
        hops = more.where("uses > 0").select(
            F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("h1"), F.col("u2").alias("h2"), F.col("under_root").alias("h_root"), "uses"
        )
        jumped = join_uneven(more.drop("uses"), hops, ["u1", "u2"], "uses", size["n"])
        rows = cut(
            jumped.select(
                *KEY, "conv_id", "depth", "n_children", F.col("h1").alias("u1"), F.col("h2").alias("u2"),
                F.coalesce("h_root", F.lit(False)).alias("under_root"),
                (F.col("n_leaves") + F.col("g_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("g_saved")).alias("saved_tokens"),
            )
        )
        reach *= 2
    return rows


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, empty = None, None, True
    done: list[tuple] = []
    for b in batches:
        k1, k2, ids = (b.column(i) for i in range(3))
        for a, c, piece in zip(k1.to_pylist(), k2.to_pylist(), ids):
            if (a, c) != key:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state, empty = (a, c), hashlib.sha256(), True
            text = ",".join(map(str, piece.as_py()))
            state.update((text if empty else "," + text).encode())
            empty = False
        yield _named(done)
        done = []
    if key:
        yield _named([(*key, state.hexdigest())])


def _named(rows: list[tuple]) -> pa.RecordBatch:
    a, b, s = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], names=[*KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256``: the digest of each node's comma-joined end list.

    The pieces of a node are read one after the other, as the digest asks for; a list is never held whole.
    """
    ordered = ends.withColumn("first", F.col("ids")[0]).repartition(*KEY).sortWithinPartitions(*KEY, "first").drop("first")
    return ordered.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")
