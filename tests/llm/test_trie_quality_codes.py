"""Prefix trie, quality and vector codes on small fixtures beside plain Python: nulls, ties, repeated rows, empty tables, long inputs."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scenestream.llm import ball_kmeans, prefix_trie, quality
from scenestream.llm.q11_prefix_trie import rebuilt
from scenestream.llm.q12_quality import op12_quality
from tests.conftest import SF

TURNS = "conv_id long, turn long, role string, text string"
RNG = random.Random(3)


def conversations():
    """Groups that share beginnings, a hot conversation repeated many times, nulls, ties, repeated rows and one long conversation."""
    rows = []
    for c in range(120):
        for t in range(RNG.randint(1, 6)):
            rows.append((c, t, "user", f"w{RNG.randint(0, 1)} x\t{t}"))
    rows += [(c, t, "user", "same words here") for c in range(200, 260) for t in range(3)]
    rows += [(300, None, None, None), (300, 1, "a", None), (300, 1, None, "a"), (300, 1, None, "a"), (301, None, "", ""), (-5, 0, "user", "below zero"), (-40, 1, "u", "x")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    rows += [(400, t, "user", f"long {t % 7}") for t in range(900)]
    rows += [(505 + i, 0, "user", "nothing to borrow") for i in range(12)]  # their group's first one is absent
    return rows


def brute_trie(sequences):
    """Nodes of {conv_id: [(digest, words), ...]} as dicts by path."""
    nodes = defaultdict(lambda: {"members": [], "ends": [], "words": 0, "kids": set()})
    for c, seq in sequences.items():
        path = ()
        for d in range(len(seq) + 1):
            if d:
                nodes[path]["kids"].add(path + (seq[d - 1][0],))
                path += (seq[d - 1][0],)
                nodes[path]["words"] = seq[d - 1][1]
            nodes[path]["members"].append(c)
        nodes[path]["ends"].append(c)
    totals = {}
    for path in sorted(nodes, key=len, reverse=True):
        n = nodes[path]
        below = [totals[k] for k in n["kids"]]
        totals[path] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(n["members"]) - 1) * n["words"])
    out = set()
    for path, n in nodes.items():
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        parent = min(nodes[path[:-1]]["members"]) if path else None
        out.add((min(n["members"]), len(path), parent, len(n["members"]), len(n["kids"]), *totals[path], ends))
    return out


def sequences_of(rows):
    held = defaultdict(list)
    for c, _, digest, words in sorted(rows, key=lambda r: (r[0], r[1])):
        held[c] += [] if digest is None else [(bytes(digest), words)]
    return held


def answer(trie):
    found = trie.nodes.join(prefix_trie.end_digests(trie.ends), ["k1", "k2"], "left")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    rows = found.select(*cols, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows})
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("borrow", [False, True])
def test_trie(spark, borrow):
    df = spark.createDataFrame(conversations(), TURNS).repartition(5)
    for clash in ("pos", "digest", "words", "k1", "depth"):
        df = df.withColumn(clash, F.lit("x"))
    turns = prefix_trie.digested(df)
    turns = rebuilt(turns) if borrow else turns
    rows = [tuple(r) for r in turns.select("conv_id", "pos", "digest", "words").collect()]
    assert answer(prefix_trie.prefix_trie(turns)) == brute_trie(sequences_of(rows))


def test_rebuilt_turns(spark):
    """Heads come from the group's first conversation, all of them if it is short, none if it is absent."""
    df = spark.createDataFrame(conversations(), TURNS)
    plain, own = {}, prefix_trie.digested(df).collect()
    for r in sorted(own, key=lambda r: (r["conv_id"], r["pos"])):
        plain.setdefault(r["conv_id"], []).append(bytes(r["digest"]))
    import zlib

    want = {}
    for c, seq in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        want[c] = plain.get(base, [])[:h] + seq[h:]
    got = {c: [d for d, _ in seq] for c, seq in sequences_of([tuple(r) for r in rebuilt(prefix_trie.digested(df)).select("conv_id", "pos", "digest", "words").collect()]).items()}
    assert got == want and any(not s for s in want.values())


def test_order_of_turns(spark):
    """Null turns come first, null role and text are empty, turns of one number follow each other by digest, all repeated rows stay."""
    got = prefix_trie.digested(spark.createDataFrame(conversations(), TURNS)).where("conv_id in (300, 301)").orderBy("conv_id", "pos").collect()
    empty = hashlib.sha256(b"0:").digest()[:16]
    assert [bytes(r["digest"]) for r in got if r["conv_id"] == 301] == [empty]
    three = [bytes(r["digest"]) for r in got if r["conv_id"] == 300]
    a, b = hashlib.sha256(b"1:a").digest()[:16], hashlib.sha256(b"0:a").digest()[:16]
    assert three == [empty, *sorted([a, b, b])]


def test_no_conversations(spark):
    trie = prefix_trie.prefix_trie(prefix_trie.digested(spark.createDataFrame([], TURNS)))
    assert trie.nodes.count() == 0 and prefix_trie.end_digests(trie.ends).count() == 0


@pytest.mark.parametrize("conversations_, turns", [(1, 4), (7, 11), (50, 3), (4096, 65536)])
def test_shards_of_any_size_give_one_trie(monkeypatch, conversations_, turns):
    """Conversations longer than a shard go on in the next ones."""
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", conversations_)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    seqs = {c: [(bytes([RNG.randint(0, 1)]) * 16, RNG.randint(0, 1)) for _ in range(RNG.choice([0, 1, 3, 40]))] for c in range(60)}
    seqs = {c: [(d, d[0] + 1) for d, _ in s] for c, s in seqs.items()}  # the words belong to the turn
    rows = [(c, d, w) for c, s in seqs.items() for d, w in ([(None, 0)] + s)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 13]), (pa.int64(), pa.binary(), pa.int64()))], names=["conv_id", "digest", "words"]) for i in range(0, len(rows), 13)]
    merged = {}
    for b in prefix_trie._shards(iter(batches)):
        for r in b.to_pylist():
            n, convs, ends = merged.setdefault((r["k1"], r["k2"], r["p1"], r["p2"], r["depth"], r["words"]), [0, [], []])
            merged[r["k1"], r["k2"], r["p1"], r["p2"], r["depth"], r["words"]] = [n + r["n"], convs + [r["conv_id"]], ends + r["ends"]]
    want = {(c, d, n, e) for c, d, _, n, _, _, _, e in brute_trie(seqs)}
    got = {(min(c), k[4], n, hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()) for k, (n, c, e) in merged.items()}
    assert got == want and len(merged) == len(want)


# --- quality --------------------------------------------------------------------------------------


def test_gradient():
    rng = np.random.default_rng(1)
    x, first, y, weight = rng.normal(size=(30, 5)), np.array([0, 1, 9, 20]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 0.5])
    w = quality.train(x, first, y, weight, width=4, views=3, steps=3)
    _, grad = quality.loss_and_gradient(w, x, first, y, weight)
    for k, t in w.items():
        for i in np.ndindex(t.shape):
            near = []
            for step in (1e-5, -1e-5):
                moved = {n: np.array(v) for n, v in w.items()}
                moved[k][i] += step
                near.append(quality.loss_and_gradient(moved, x, first, y, weight)[0])
            assert abs((near[0] - near[1]) / 2e-5 - grad[k][i]) < 1e-6


def plain_features(words):
    """Word features of one passage the long way."""
    pairs = list(zip(words, words[1:]))
    marks = set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123))
    n = len(words)
    return [
        math.log1p(n) / math.log1p(64), len(set(words)) / n, max(words.count(w) for w in words) / n, sum(a == b for a, b in pairs) / n,
        math.log1p(sum(map(len, words)) / n), sum(len(w) == 1 for w in words) / n, sum(ord(w[-1]) in marks for w in words) / n, sum(len(w) > 20 for w in words) / n,
    ]


def test_encoding():
    text = "\n ".join(RNG.choice(["aa", "b!", "Élan", "x" * 30, "7", "#"]) for _ in range(3000)) + "  "
    x = np.concatenate(list(quality.encode("\t " + text)))
    words = text.split()
    assert x.shape == (-(-len(words) // 64), quality.N_FEATURES)
    for p in (0, 15, 16, len(x) - 1):  # block borders lie between passages 15 and 16
        assert np.allclose(x[p, -8:], plain_features(words[64 * p : 64 * p + 64]))
        chars = x[p, : quality.N_KINDS] ** 2
        assert abs(chars.sum() - 1) < 1e-9
    long = np.concatenate(list(quality.encode("y" * 5000 + " z")))
    assert len(long) == 1 and np.allclose(long[0, -8], math.log1p(6) / math.log1p(64))
    for empty in (None, "", " \n"):
        assert [b.tolist() for b in quality.encode(empty)] == [[[0.0] * quality.N_FEATURES]]


def test_score_of_attention_weights(docs_of):
    rng = np.random.default_rng(2)
    rows = [(i, t) for i, t in enumerate(["plain words stand here", "!! ## $$", None, "", "w " * 200 + "end", "w " * 200 + "end", "long " * 20_000])]
    x = np.concatenate([b for _, t in rows for b in quality.encode(t)])
    w = quality.train(x, np.array([0, 1]), np.array([1.0, 0.0]), np.ones(2), steps=1)
    w = {k: rng.normal(size=v.shape) for k, v in w.items()}
    model = quality.Model(x.mean(0), np.full(quality.N_FEATURES, 2.0), w)
    got = {r["doc_id"]: r for r in quality.score(docs_of(rows).withColumn("quality", F.lit("clash")), model).collect()}
    assert len(got) == len(rows) and got[4]["quality"] == got[5]["quality"]
    for i, t in rows:
        z, s = [], []
        for f in np.concatenate(list(quality.encode(t))):
            h = [math.tanh(sum(model.scaled(f)[a] * w["encoder"][a, b] for a in range(len(f))) + w["encoder_bias"][b]) for b in range(16)]
            view = [math.tanh(sum(h[a] * w["view"][a, b] for a in range(16))) for b in range(8)]
            gate = [1 / (1 + math.exp(-sum(h[a] * w["gate"][a, b] for a in range(16)))) for b in range(8)]
            z.append(h)
            s.append(sum(view[b] * gate[b] * w["attention"][b] for b in range(8)))
            if len(z) == 30:
                break
        if len(z) < 30:
            a = [math.exp(v) / sum(math.exp(u) for u in s) for v in s]
            o = sum(a[k] * sum(z[k][b] * w["score"][b] for b in range(16)) for k in range(len(a))) + float(w["score_bias"])
            assert abs(got[i]["quality"] - 1 / (1 + math.exp(-o))) < 1e-9 and np.allclose(got[i]["passage_weights"], a)
    assert len(got[6]["passage_weights"]) == -(-20_000 // 64) and abs(sum(got[6]["passage_weights"]) - 1) < 1e-9
    assert quality.score(docs_of([]), model).count() == 0


def test_quality_labels_of_one_class_or_none(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None), (None, "c")])
    labels = "doc_id long, quality int"
    for rows, share in (([(1, 1), (2, 1), (2, 1), (None, 0), (7, None)], 0.75), ([(1, 0)], 1 / 3), ([], 0.5)):
        model = quality.fit(docs, spark.createDataFrame(rows, labels), F.lit(True))
        assert {round(r["quality"], 9) for r in quality.score(docs, model).collect()} == {round(share, 9)}


def test_sample_stands_for_all(spark, docs_of):
    docs, labels = docs_of([(i, f"text {i}") for i in range(50)]), spark.createDataFrame([(i, int(i < 40)) for i in range(50)], "doc_id long, quality int")
    rows, n = quality.training_rows(docs, labels, F.col("doc_id") % 2 == 0, per_class=4)
    got = rows.collect()
    assert n == {0: 5, 1: 20} and len(got) == 8 and all(r["doc_id"] % 2 == 0 for r in got)
    assert {r["quality"]: r["stands_for"] for r in got} == {0: 1.25, 1: 5.0}


def test_quality_held_out(spark):
    """Documents outside the fitted folds are told apart; the held-out fold follows the id alone."""
    import zlib

    folder = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op12_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    new = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    for c in (0, 1):
        mine = [p for p, y in new if y == c]
        assert mine and sum(p == c for p in mine) / len(mine) >= 0.95


# --- codes ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [2, 30])
def test_balls_and_rings_change_nothing(spread):
    """Exact with ties and equal entries, from any start, for entries that moved and entries that did not."""
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread, (800, 3))
    old = rng.integers(-spread, spread, (20, 3))
    old[7] = old[3]
    new = old.copy()
    new[::3] += rng.integers(-1, 2, new[::3].shape)
    code, _ = ball_kmeans.full_assignment(x, old)
    want = ball_kmeans.full_assignment(x, new)
    for start, before in ((code, old), (code, None), (rng.integers(0, 20, len(x)), None)):
        got = ball_kmeans.ball_assignment(x, start, new, before)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    near = ball_kmeans.ball_assignment(x, code, new, old)[2]
    assert near < len(x) * 19 * 0.7
    assert ball_kmeans.ball_assignment(x, code, old, old)[2] == 0  # nothing moved, nothing is compared


def brute_codes(rows):
    kept = [(i, [math.floor(256 * c) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    parts = [[v[p * len(v) // 16 : (p + 1) * len(v) // 16] for p in range(16)] for _, v, _ in kept]
    seeds = sorted((n for n in range(len(kept)) if kept[n][0] is not None), key=lambda n: (kept[n][0], [-c for c in kept[n][1]]))[:64]
    book = [[parts[n][p] for n in seeds] for p in range(16)]

    def nearest(part, entries):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(entries))

    for _ in range(2):
        for p in range(16):
            held = defaultdict(list)
            for row in parts:
                held[nearest(row[p], book[p])[1]].append(row[p])
            book[p] = [[sum(c) // len(held[j]) for c in zip(*held[j])] if j in held else e for j, e in enumerate(book[p])]
    out = []
    for (i, _, lab), row in zip(kept, parts):
        best = [nearest(row[p], book[p]) for p in range(16)]
        out.append((i, bytes(j for _, j in best), sum(d for d, _ in best), lab))
    return out, book


@pytest.mark.parametrize("n", [5, 300])
def test_codes(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 0.2, 32)], int(i % 3) if i % 4 else None) for i in range(n)]
    rows += [(n, rows[0][1], 1), (n, rows[1][1], 1), (n, rows[1][1], 1), (None, rows[2][1], None)]
    rows += [(n + 1, None, 1), (n + 2, [None] * 32, 1), (n + 3, [float("nan")] * 32, 2), (n + 4, [float("inf")] + [0.0] * 31, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("code", "error", "x", "sums", "v")})
    codes = ball_kmeans.ball_codes(df.repartition(3))
    want, book = brute_codes(rows)
    assert codes.codebook.tolist() == book
    sums = defaultdict(int)
    for _, _, e, lab in want:
        sums[lab] += e
    got = [(r["vec_id"], bytes(r["code"]), r["error"], r["label"], r["label_error"]) for r in ball_kmeans.label_errors(codes).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted([(*w, sums[w[3]]) for w in want], key=order)


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label string"
    assert ball_kmeans.label_errors(ball_kmeans.ball_codes(spark.createDataFrame([], kind))).count() == 0
    assert ball_kmeans.ball_codes(spark.createDataFrame([(1, [], "a"), (None, [1.0], None), (2, None, None)], kind)).rows.count() == 0
    # Lengths other than that of the smallest id take no part; five components fill five of sixteen parts; huge ones are held.
    rows = [(1, [0.1, 0.2, 0.3, 0.4, 0.5], "a"), (2, [1.0], "a"), (3, [1e300, -1e300, 0.0, 0.0, 0.0], None)]
    codes = ball_kmeans.ball_codes(spark.createDataFrame(rows, kind))
    assert codes.codebook.shape == (16, 2, 1) and sorted(r["vec_id"] for r in codes.rows.collect()) == [1, 3]
    assert codes.codebook[:, 1].reshape(-1).tolist() == [ball_kmeans.BOUND, -ball_kmeans.BOUND] + [0] * 14
