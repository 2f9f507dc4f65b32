"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, WORD, cut

FOLD = str.maketrans(UPPER, LOWER)
FIND = re.compile(WORD).findall

# Bound of the fitting sample: so many labelled documents of each class, those with the smallest hash of their id.
SAMPLE_PER_CLASS = 6000
# A quarter of the sample is kept from the counts and used to calibrate.
CALIBRATION_MOD = 4
# Prefix lengths a word falls back to when it was seen too rarely itself.
PREFIXES = (4, 5, 6, 7)
# Weight of the prior (in tokens) at each step down from all tokens over prefixes to the word.
PRIOR = 10.0
# Standard deviations by which a log-odds must clear zero, and by which it is lowered.
SURE = 2.0
# What one document adds to the count of a word or prefix at most: repetition in one text is no evidence.
PER_DOCUMENT = 3
# Occurrences below which a word or prefix has no node of its own.
LEAST_TOXIC, LEAST_CLEAN = 3, 20
# Fall of the running score over a token without evidence, and the largest rise of one token.
DRIFT, CEILING = 0.1, 6.0
# The highest score where nothing tells toxic texts from clean ones.
UNKNOWN = 0.49


@dataclass
class Model:
    """Token scores and the extreme-value and logistic parameters."""

    weight: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    bias: float = 0.0
    slope: float = 0.0

    def __post_init__(self) -> None:
        self.memo: dict[str, float] = {}

    def token(self, word: str) -> float:
        """Score of a word, else of its longest known prefix, else the drift."""
        s = self.memo.get(word)
        if s is None:
            s = self.weight.get("=" + word)
            for n in reversed(PREFIXES):
                if s is None and len(word) >= n:
                    s = self.weight.get(word[:n])
            s = -DRIFT if s is None else s
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = s
        return s


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(start, end, score)`` in one pass (end exclusive).

    A segment is closed under the usual definition: no longer one has a higher score, and none of its prefixes or
    suffixes has a score of zero or less. Runs without a positive token are skipped by their running sum.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # start, end, sum before start, sum at end, and where the nearest segment below with a smaller sum before lies
    stack: list[list] = []
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, total[i], total[i + 1], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            new[4] = j
            if j < 0 or stack[j][3] >= new[3]:
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append(new)
    return [(s, e, b - a) for s, e, a, b, _ in stack]


def _words(text: str | None) -> list[str]:
    return FIND((text or "").translate(FOLD))


def evidence(model: Model, text: str | None) -> tuple[int, float, list[tuple[int, int, float]]]:
    """Words, summed evidence of the significant segments (in nats beyond chance), and these segments in words."""
    ws = _words(text)
    if not ws:
        return 0, 0.0, []
    token, memo = model.token, model.memo
    scores = np.array([memo[w] if w in memo else token(w) for w in ws])
    chance = model.log_k + math.log(len(ws))
    found = [(s, e, model.lam * x - chance) for s, e, x in segments(scores)]
    found = [f for f in found if f[2] > 0]
    return len(ws), sum(f[2] for f in found), found


def probability(model: Model, excess: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.slope * excess))))


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``doc_id, text, toxic, stands_for`` of a bounded sample of the labelled rows that ``allowed`` admits; several labels of an id:
    toxic if any is. ``stands_for``: labelled rows of the class for each one sampled."""
    known = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = lambda t: F.lit(max(1.0, n.get(t, 0) / per_class))
    picked = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(per_class).withColumn("stands_for", rate(t)) for t in (0, 1)]
    sample = picked[0].union(picked[1])  # at most 2 * per_class rows, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def _counts(rows: DataFrame) -> DataFrame:
    """Occurrences of words and of prefixes by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: Counter = Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen: Counter = Counter()
                for w, n in Counter(_words(text)).items():
                    seen["=" + w] = n
                    for p in PREFIXES:
                        if len(w) >= p:
                            seen[w[:p]] += n
                for f, n in seen.items():
                    rows[f, toxic] += min(n, PER_DOCUMENT)
            yield pa.record_batch(
                [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int64()), pa.array(list(rows.values()), pa.int64())],
                names=["feature", "toxic", "n"],
            )

    pairs = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "feature string, toxic long, n long")
    n = F.sum
    return pairs.groupBy("feature").agg(
        n(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"), n(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean")
    )


def _weights(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds of each node against all tokens, its parent's share being the Dirichlet prior, less ``SURE`` standard deviations."""
    if not toxic or not clean:
        return {}
    base = toxic / (toxic + clean)
    share: dict[str, float] = {}
    logit = lambda p: math.log(p) - math.log1p(-p)
    out = {}
    for f in sorted(counts, key=lambda f: (f[0] == "=", len(f))):
        stem = f[1:] if f[0] == "=" else f[:-1]
        parent = next((share[stem[:p]] for p in reversed(PREFIXES) if len(stem) >= p and stem[:p] in share), base)
        t, c = counts[f]
        a, b = t + PRIOR * parent, c + PRIOR * (1 - parent)
        share[f] = a / (a + b)
        spread = math.sqrt(1 / (t + PRIOR * base) + 1 / (c + PRIOR * (1 - base)))
        rise = logit(share[f]) - logit(base) - SURE * spread
        out[f] = min(CEILING, rise) if rise > 0 else -DRIFT
    return out


def _karlin(scores: Counter) -> float:
    """The positive root of E[exp(lambda * score)] = 1; scores must fall on average."""
    total = sum(scores.values())
    mean = lambda lam: sum(n * math.exp(min(700.0, lam * s)) for s, n in scores.items()) / total - 1
    if not any(s > 0 for s in scores) or sum(n * s for s, n in scores.items()) >= 0:
        return 1.0
    lo, hi = 1e-6, 1e-3
    while mean(hi) < 0 and hi < 100:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 0 else (lo, mid)
    return min(5.0, hi)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Ridge logistic fit on one feature by Newton steps. Rows count by ``weight``, scaled to one on average."""
    w = weight / weight.mean()
    beta, A = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(A @ beta, -30, 30)))
        grad = A.T @ (w * (y - p)) - [1e-3 * beta[0], 1e-2 * beta[1]]
        hess = (A * (w * p * (1 - p))[:, None]).T @ A + np.diag([1e-3, 1e-2])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from at most ``2 * per_class`` labelled documents.

    Three quarters give token counts; the rest gives lambda (Karlin-Altschul, from clean token scores), K (from the
    mean of the clean maxima, whose Gumbel mean is (ln(K n) + Euler's constant) / lambda) and the logistic map, in which each
    row counts for those of its class that the sample leaves out, so a score means the same at every size.

    Several labels of an id count as toxic if one is; rows that repeat count as often. Null ids, texts and labels, and labels without
    a document, teach nothing. With labels of one class only, or none (an empty table), no text is toxic: see ``UNKNOWN``.
    """
    sample = cut(training_rows(docs, labels, allowed, per_class))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(CALIBRATION_MOD))
    nodes = _counts(sample.where(part != 0)).where((F.col("toxic") >= LEAST_TOXIC) | (F.col("clean") >= LEAST_CLEAN))
    # Words count each token once; the totals of both classes are bounded by the sample.
    totals = _counts(sample.where(part != 0)).where(F.col("feature").startswith("=")).agg(F.sum("toxic"), F.sum("clean")).first()
    counts = {r[0]: (r[1], r[2]) for r in nodes.toLocalIterator()}
    model = Model(_weights(counts, totals[0] or 0, totals[1] or 0))
    held, weight = [], []
    for r in sample.where(part == 0).select("toxic", "text", "stands_for").toLocalIterator():
        held.append((r["toxic"], np.array([model.token(w) for w in _words(r["text"])])))
        weight.append(r["stands_for"])
    clean = [s for t, s in held if t == 0 and len(s)]
    if not model.weight or not clean or not any(t for t, _ in held):
        # Without both classes no text can be told from another: all score the share of toxic labels, as not toxic.
        n = sample.agg(F.coalesce(F.sum("stands_for"), F.lit(0.0)), F.coalesce(F.sum(F.col("stands_for") * F.col("toxic")), F.lit(0.0))).first()
        share = min(UNKNOWN, (n[1] + 1) / (n[0] + 2))
        return Model(bias=math.log(share) - math.log1p(-share))
    model.lam = _karlin(Counter(np.round(np.concatenate(clean), 2).tolist()))
    best = lambda s: max((x[2] for x in segments(s)), default=0.0)
    maxima = np.array([model.lam * best(s) - math.log(len(s)) for s in clean])
    model.log_k = float(maxima.mean()) - 0.5772156649
    excess = []
    for _, s in held:
        chance = model.log_k + math.log(max(1, len(s)))
        excess.append(sum(max(0.0, model.lam * x[2] - chance) for x in segments(s)) if len(s) else 0.0)
    model.bias, model.slope = _logistic(np.log1p(np.array(excess)), np.array([t for t, _ in held], float), np.array(weight))
    return model


def score(docs: DataFrame, model: Model, out: str = "toxicity", passages: str = "toxic_passages") -> DataFrame:
    """``docs`` with ``out`` (0 to 1) and ``passages``: ``array<struct<start, end, excess>>`` in words, each significant segment.

    One narrow pass; whole texts of any length. Null and empty texts have no evidence, which has a score too. Equal texts score alike
    and all rows come back, repeated ones as well; an empty table gives none. Other columns pass through, those named like the
    results are replaced.
    """
    docs = docs.drop(out, passages)
    place, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [evidence(m, t.as_py()) for t in b.column(place)]
            scores = [probability(m, math.log1p(f[1])) for f in found]
            spans = [[{"start": s, "end": e, "excess": x} for s, e, x in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*b.schema.names, out, passages])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("excess", T.DoubleType())])
    fields = [*docs.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(passages, T.ArrayType(span))]
    return docs.mapInArrow(run, T.StructType(fields))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``; all columns as they were."""
    return score(docs, model, "__toxicity", "__passages").where(F.col("__toxicity") < threshold).select(*docs.columns)
