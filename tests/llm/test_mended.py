"""One test for each answer of the text operators that was once wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scenestream.llm import licenses, mixing, simhash, suffixes, toxicity
from scenestream.llm.licenses import Template
from tests.conftest import SF

from . import brute

RNG = random.Random(11)


def spans(docs, **kw):
    return {r["doc_id"]: [(s["label"], s["exact"], s["first"], s["last"], round(s["share"], 2)) for s in r["spans"]] for r in licenses.find_licenses(docs, **kw).collect()}


def test_long_templates_are_found(docs_of):
    ws = [f"w{i}" for i in range(200)]
    text = " ".join(ws)
    gaps = " ".join(w for i, w in enumerate(ws) if i % 20)
    docs = docs_of([(1, "x " + text + " y"), (2, gaps), (3, " ".join(ws[:90])), (4, "x " + text + " y"), (4, "x " + text + " y")])
    both = (Template("exact", text, True), Template("near", text))
    got = spans(docs, templates=both)
    assert got[1] == [("exact", True, 1, 200, 1.0), ("near", False, 1, 200, 1.0)] == got[4]
    assert got[2] == [("near", False, 0, 189, 0.95)] and got[3] == []


def test_chained_grams_hide_no_notice(docs_of):
    notice = "all rights reserved"
    rows = [(1, notice), (2, notice + " rights reserved" * 2), (3, notice + " rights reserved" * 40 + " all rights reserved"), (4, "rights reserved " * 9), (5, notice + " " + notice)]
    got = spans(docs_of(rows), templates=(Template("proprietary", notice),))
    one = ("proprietary", False, 0, 2, 1.0)
    assert got[1] == [one] and got[2] == [one] and got[4] == [] and got[5] == [one, ("proprietary", False, 3, 5, 1.0)]
    assert got[3] == [one, ("proprietary", False, 83, 85, 1.0)]


def test_whole_licenses(docs_of):
    mit = next(t.text for t in licenses.NOTICES if t.label == "mit" and len(t.text.split()) > 100)
    edited = mit.replace("merge ", "").replace("liable", "responsible")
    got = spans(docs_of([(1, edited)]))
    assert ("mit", False, 0, len(edited.split()) - 1) in [s[:4] for s in got[1]]


@pytest.mark.parametrize("labels", [[], [(i, 0) for i in range(200)], [(i, 1) for i in range(200)], [(None, 1), (3, None), (7_000_000, 1)]])
def test_labels_of_one_class_reject_no_document(spark, docs_of, labels):
    """Neither the operator nor the pipeline's stage drops what nothing speaks against."""
    docs = docs_of([(i, f"word{i} is a clean text") for i in range(30)] + [(None, None), (5, "")])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    scores = [r["toxicity"] for r in toxicity.score(docs, model).collect()]
    assert len(scores) == 32 and all(0 < s < 0.5 for s in scores)
    assert toxicity.drop_toxic(docs, model).count() == 32


def test_stage_without_labels_keeps_all(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", F.lit(1).alias("toxicity"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_near_copies_are_verified(docs_of):
    """No document goes without a similar one that stays, by all pairs; of those that should go, nine in ten do.
    Texts that only share a word said many times are not similar."""
    vocabulary = [f"v{i}" for i in range(400)]

    def prose(n):
        return [RNG.choice(vocabulary) for _ in range(n)]

    rows = []
    for base in range(25):
        ws = prose(RNG.randint(60, 200))
        for copy in range(RNG.randint(1, 5)):
            own = list(ws)
            for _ in range(RNG.randint(0, len(ws) // 45)):
                own[RNG.randrange(len(own))] = f"edit{RNG.randint(0, 99)}"
            rows.append((100 * base + copy, " ".join(own).upper() if copy == 2 else " ".join(own)))
    rows += [(9000 + i, " ".join(["same"] * 300 + prose(60))) for i in range(4)]  # one fingerprint, little in common
    rows += [(9100, None), (9101, ""), (9102, " \n"), (9103, "a b"), (9104, "A  b"), (9105, "a b c"), (9106, " ".join(prose(30_000)))]
    docs = docs_of([*rows, rows[0], rows[0]])
    want = brute.similar_groups(rows)
    kept = simhash.keep_one_similar(docs.withColumn("__key", F.lit(1)).withColumn("__id", F.lit(2)))
    assert {"__key", "__id"} <= set(kept.columns)
    left, due = {r["doc_id"] for r in kept.collect()}, set(want.values())
    assert kept.count() == len(left) and due <= left and len(left - due) <= 0.1 * (len(rows) - len(due)) and len(due) < len(rows) - 20
    assert {9100, 9103, 9105, 9106, *range(9000, 9004)} <= left and not {9101, 9102, 9104} & left
    assert simhash.keep_one_similar(docs_of([])).count() == 0
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one_similar(docs_of([(None, "x y"), (None, "z"), (3, "x  y")])).collect()) == ["3", "None"]


def test_rates_are_tilted_by_size(spark, docs_of):
    """Rates differ within a source as exp(b * size), totals meet their targets, saturated sources take three times all."""
    import math

    rows = [(i, "w " * RNG.choice([3, 10, 40, 200]), "abcd"[i % 4] if i % 7 else "d") for i in range(800)] + [(900 + i, "w " * 5, "small") for i in range(4)]
    got = mixing.mix(docs_of(rows), (1, 2, 3)).collect()
    for source in "abcd":
        own = [r for r in got if r["source"] == source]
        rates = {r["size"]: r["rate"] for r in own}
        assert len(rates) == len(set(rates.values())) == 4
        tilts = [math.log(v) / n for n, v in rates.items() if v < 3]
        assert max(tilts) - min(tilts) < 1e-6 * abs(tilts[0]) and abs(tilts[0]) > 1e-6
        target = own[0]["target"]
        assert abs(sum(r["rate"] * r["size"] for r in own) - target) <= 1e-6 * target
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= 300
    small = [r for r in got if r["source"] == "small"]
    assert all(r["rate"] == 3 == r["copies"] for r in small)


def test_a_nearer_partner_hides_no_other(spark):
    rows = spark.createDataFrame([("a", 10, 0, 0), ("b", 10, 1, 1), ("c", 10, 3, 3)], "node string, n long, f0 long, f1 long")
    assert {(r.u, r.v) for r in simhash.candidates(rows).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_a_group_of_near_copies_makes_rows_in_proportion_to_its_members(spark, docs_of):
    """Copies with one edit each are linked by forests, not by all their pairs; outsiders in their bucket are compared and stay."""
    base = [f"w{i}" for i in range(120)]
    near = [(i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]])) for i in range(100)]
    far = [(200 + i, " ".join(w if k % 13 != i else f"far{i}x{k}" for k, w in enumerate(base))) for i in range(12)]
    docs = docs_of([*near, *far])
    rows = simhash.sketches(docs).withColumn("first", F.struct(F.lit(False).alias("no_id"), "doc_id", "text_key")).localCheckpoint()
    members = simhash.near_groups(rows).localCheckpoint()
    edges = simhash.similar(docs, members, rows)
    assert rows.count() < members.count() and members.groupBy("node").count().agg(F.max("count")).first()[0] <= 42
    assert edges.count() <= members.count() < 100 * 99 / 2
    want = brute.similar_groups([*near, *far])
    assert {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()} == set(want.values()) and len(set(want.values())) == 1 + len(far)


def test_components_of_a_bucket_lose_no_link():
    for n, p in ((1, 0.5), (40, 0.02), (40, 0.06), (60, 0.5), (30, 0.0)):
        links = np.triu(np.random.default_rng(n).random((n, n)) < p, 1)
        links |= links.T
        want = simhash._labels(n, *np.nonzero(links))
        assert (simhash._linked(n, lambda i, at: links[i][at]) == want).all()  # noqa: B023


def test_only_pieces_that_may_share_a_string_are_merged(docs_of):
    letters = [bytes(RNG.choices(range(97, 123), k=32)) for _ in range(8)]
    gram = b"an anchor in the m"
    whole = letters[0] + gram + letters[1]
    pieces = [whole, whole[12:], whole[20:70], letters[2] + gram + letters[3], letters[4] + gram + letters[5][:10], letters[6][:17] + gram + letters[7]]
    strings = [{p[i : i + 50] for i in range(len(p) - 49)} for p in pieces]
    share = [any(a & b for j, b in enumerate(strings) if i != j) for i, a in enumerate(strings)]
    anchor = np.repeat(suffixes._gram_hashes(np.frombuffer(gram, np.uint8)).view(np.int64), len(pieces))
    got = suffixes.meeting(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), anchor)
    assert got.tolist() == share == [True, True, True, False, False, False]
    rows = [(RNG.randrange(30), " ".join(RNG.choice([*pieces, p]).decode() for _ in range(RNG.randrange(1, 5)))) for p in pieces * 6]
    rows = list(dict(rows).items())
    assert {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(docs_of(rows)).collect()} == brute.repeats(rows)


def test_transforms_hold_several_symbols_of_each_suffix(monkeypatch):
    """Short and long runs of few letters, whose suffixes are equal far beyond a string, over many shards and refinements of any size."""
    texts = [bytes(RNG.choices(b"ab", [9, 1], k=RNG.randrange(50, 200))) for _ in range(40)] + [b"a" * 300, b"ab" * 90, b"\0" * 60]
    least = np.arange(len(texts))[::-1].copy()
    want = {}
    for n, t in enumerate(texts):
        for s in range(len(t) - 49):
            want[t[s : s + 50]] = min(want.get(t[s : s + 50], 1 << 40), int(least[n]))
    for shard in (1, 300, 1 << 18):
        monkeypatch.setattr(suffixes, "SHARD", shard)
        text, offset, value = (c.tolist() for c in suffixes.least_in_class(texts, least))
        assert list(zip(text, offset)) == [(n, s) for n, t in enumerate(texts) for s in range(len(t) - 49)]
        assert all(want[texts[n][s : s + 50]] == v for n, s, v in zip(text, offset, value))
    grams, order = suffixes.transform(texts[:3])
    assert len({suffixes.STEP, grams.dtype.itemsize}) == 1 and len(grams) == len(order) == sum(len(t) + 1 for t in texts[:3])
