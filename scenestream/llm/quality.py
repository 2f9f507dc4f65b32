"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its characters and words, gated attention weighs the encodings,
and a logistic unit scores their weighted sum. Only documents carry labels; the attention finds the passages that matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

# Words of a passage. A run of more than ``LONGEST`` characters without a blank counts as several words.
PASSAGE, LONGEST = 64, 1024
# Whole passages that are encoded at once, so that memory does not grow with a text.
BLOCK = re.compile(rf"(?:[^\x20\x09-\x0D]{{1,{LONGEST}}}+[\x20\x09-\x0D]*+){{1,{16 * PASSAGE}}}+")

# Bounds of the fitting sample: documents of each class, those with the smallest hash of their id, and passages of each of them.
SAMPLE_PER_CLASS, SAMPLE_PASSAGES = 3000, 64

# Kinds of characters: each ASCII character that is no letter, digit or blank has its own.
LOWER_KIND, UPPER_KIND, DIGIT_KIND, BLANK_KIND, BREAK_KIND, WIDE_KIND, CONTROL_KIND, MARKS = 0, 1, 2, 3, 4, 5, 6, 7
PAIR_BUCKETS = 64


def _kinds() -> np.ndarray:
    kinds = np.full(129, CONTROL_KIND, np.int64)
    marks = [i for i in range(33, 127) if not chr(i).isalnum()]
    kinds[marks] = MARKS + np.arange(len(marks))
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = LOWER_KIND, UPPER_KIND, DIGIT_KIND
    kinds[[9, 11, 12, 32]], kinds[[10, 13]], kinds[128] = BLANK_KIND, BREAK_KIND, WIDE_KIND
    return kinds


KINDS = _kinds()
N_KINDS = int(KINDS.max()) + 1
# Pairs of kinds share buckets by a multiplicative hash.
PAIRS = ((np.arange(N_KINDS * N_KINDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)
POWERS = np.cumprod(np.full(LONGEST, 0x100000001B3, np.uint64))
N_WORD_FEATURES = 8
N_FEATURES = N_KINDS + PAIR_BUCKETS + N_WORD_FEATURES


def _encode_block(text: str) -> np.ndarray:
    """Features of the passages of a text that starts with a word: shares of kinds and pairs of characters, and of kinds of words."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = KINDS[np.minimum(code, 128)]
    blank = ((code >= 9) & (code <= 13)) | (code == 32)
    # A word starts after a blank, and anew after so many characters.
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    size = np.add.reduceat((~blank).astype(np.int64), start)
    if size.max() > LONGEST:
        start = np.concatenate([np.arange(s, s + n, LONGEST) for s, n in zip(start.tolist(), size.tolist())])
        size = np.add.reduceat((~blank).astype(np.int64), start)
    n = -(-len(start) // PASSAGE)
    passage = np.arange(len(start)) // PASSAGE
    of_char = np.repeat(passage, np.diff(np.append(start, len(code))))
    words = np.bincount(passage, minlength=n)

    def shares(values: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
        counts = np.bincount(where * width + values, minlength=n * width).reshape(n, width)
        return counts / np.maximum(1, counts.sum(1, keepdims=True))

    chars = shares(kind, of_char, N_KINDS)
    inside = of_char[1:] == of_char[:-1]
    pairs = shares(PAIRS[kind[:-1] * N_KINDS + kind[1:]][inside], of_char[1:][inside], PAIR_BUCKETS)
    # Words are told apart by a rolling hash; 52 bits beside the passage.
    offset = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
    spelled = np.where(blank, 0, code).astype(np.uint64) * POWERS[np.minimum(offset, LONGEST - 1)]
    word = np.add.reduceat(spelled, start)
    word ^= word >> np.uint64(29)
    key = (passage.astype(np.uint64) << np.uint64(52)) | (word * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(12))
    distinct, times = np.unique(key, return_counts=True)
    home = (distinct >> np.uint64(52)).astype(np.int64)
    most = np.maximum.reduceat(times, np.searchsorted(home, np.arange(n)))
    same = np.concatenate([[False], key[1:] == key[:-1]])
    last = code[start + size - 1]

    def share(of: np.ndarray) -> np.ndarray:
        return np.bincount(passage, of, n) / words

    by_word = [
        np.log1p(words) / np.log1p(PASSAGE),
        np.bincount(home, minlength=n) / words,
        most / words,
        share(same),
        np.log1p(share(size)),
        share(size == 1),
        share(KINDS[np.minimum(last, 128)] >= MARKS),
        share(size > 20),
    ]
    return np.concatenate([np.sqrt(chars), np.sqrt(pairs), np.stack(by_word, 1)], 1)


def encode(text: str | None) -> Iterator[np.ndarray]:
    """Features of a whole text's passages, block by block. A text without words is one passage without any."""
    found = False
    for m in BLOCK.finditer(text or ""):
        found = True
        yield _encode_block(m.group())
    if not found:
        yield np.zeros((1, N_FEATURES))


@dataclass
class Model:
    """Scale of the features, the encoder, gated attention and the scoring unit. Without ``encoder`` every text scores ``share``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    share: float = 0.5

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings and attention logits of passages."""
        w = self.weights
        z = np.tanh(self.scaled(x) @ w["encoder"] + w["encoder_bias"])
        return z, (np.tanh(z @ w["view"]) * _sigmoid(z @ w["gate"])) @ w["attention"]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6)

    def score(self, text: str | None) -> tuple[float, np.ndarray]:
        """Probability of label 1 and the attention of each passage."""
        if not self.weights:
            n = sum(len(b) for b in encode(text))
            return self.share, np.full(n, 1 / n)
        parts = [self.passages(b) for b in encode(text)]
        z, s = (np.concatenate(p) for p in zip(*parts))
        a = np.exp(s - s.max())
        a /= a.sum()
        return float(_sigmoid(a @ z @ self.weights["score"] + self.weights["score_bias"])), a


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def loss_and_gradient(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted logistic loss of bags and its gradient. Passages ``x`` of a bag are consecutive and start at ``first``."""
    sizes = np.diff(np.append(first, len(x)))
    z = np.tanh(x @ w["encoder"] + w["encoder_bias"])
    view, gate = np.tanh(z @ w["view"]), _sigmoid(z @ w["gate"])
    s = (view * gate) @ w["attention"]
    a = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
    a /= np.repeat(np.add.reduceat(a, first), sizes)
    bag = np.add.reduceat(a[:, None] * z, first)
    p = _sigmoid(bag @ w["score"] + w["score_bias"])
    total = weight.sum()
    loss = -(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / total
    up = weight * (p - y) / total
    grad = {"score": bag.T @ up, "score_bias": up.sum()}
    to_bag = np.repeat(up[:, None] * w["score"], sizes, 0)
    to_a = (to_bag * z).sum(1)
    to_s = a * (to_a - np.repeat(np.add.reduceat(a * to_a, first), sizes))
    grad["attention"] = (view * gate).T @ to_s
    to_view = to_s[:, None] * w["attention"] * gate * (1 - view**2)
    to_gate = to_s[:, None] * w["attention"] * view * gate * (1 - gate)
    grad["view"], grad["gate"] = z.T @ to_view, z.T @ to_gate
    to_z = (a[:, None] * to_bag + to_view @ w["view"].T + to_gate @ w["gate"].T) * (1 - z**2)
    grad["encoder"], grad["encoder_bias"] = x.T @ to_z, to_z.sum(0)
    return float(loss), grad


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int = 16, views: int = 8, steps: int = 200, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Adam on all bags at once, from fixed starting weights, so that the same sample gives the same model."""
    rng = np.random.default_rng(7)
    start = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {
        "encoder": start(x.shape[1], width), "encoder_bias": np.zeros(width), "view": start(width, views), "gate": start(width, views),
        "attention": start(views), "score": start(width), "score_bias": np.zeros(()),
    }
    m, v = ({k: np.zeros_like(t) for k, t in w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        _, grad = loss_and_gradient(w, x, first, y, weight)
        for k in w:
            g = grad[k] + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = SAMPLE_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, text, quality, stands_for`` of a bounded sample of the labelled documents that ``allowed`` admits, and the classes' sizes.

    Several labels of an id: 1 only if all are above 0. ``stands_for``: labelled ids of the class for each one sampled. Labels without a document or value, and null ids, teach nothing.
    """
    known = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit("quality"))
    picked = [known.where(F.col("quality") == c).orderBy(order, "doc_id").limit(per_class).withColumn("stands_for", F.lit(max(1.0, n.get(c, 0) / per_class))) for c in (0, 1)]
    sample = picked[0].union(picked[1])  # at most 2 * per_class rows, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), n


def _bags(rows: DataFrame) -> DataFrame:
    """Encoded passages of the sample: the whole text where it has at most ``SAMPLE_PASSAGES``, else evenly spaced ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = []
            for t in b.column("text"):
                x = np.concatenate([e.astype(np.float32) for e in encode(t.as_py())])
                if len(x) > SAMPLE_PASSAGES:
                    x = x[np.linspace(0, len(x) - 1, SAMPLE_PASSAGES).astype(np.int64)]
                bags.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("stands_for"), pa.array(bags, pa.binary())], names=["doc_id", "quality", "stands_for", "bag"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, quality int, stands_for double, bag binary")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from the passages of at most ``2 * per_class`` labelled documents; their encoding is done by the executors.

    Each row counts for those of its class that the sample leaves out, so a score means the same at every size. Rows of one id with
    different texts are bags of their own. Without labels of both classes every text scores the (smoothed) share of label 1, without any 0.5.
    """
    rows, n = training_rows(docs, labels, allowed, per_class)
    share = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    sample = cut(_bags(rows)).orderBy("doc_id", F.xxhash64("bag"))
    y, weight, bags = [], [], []
    for r in sample.toLocalIterator():  # bounded by the sample
        y.append(r["quality"])
        weight.append(r["stands_for"])
        bags.append(np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES))
    if len(set(y)) < 2:
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), None, share)
    x = np.concatenate(bags).astype(float)
    spread = x.std(0)
    model = Model(x.mean(0), np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0), None, share)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
    model.weights = train(model.scaled(x), first, np.array(y, float), np.array(weight))
    return model


def score(docs: DataFrame, model: Model, out: str = "quality", attention: str = "passage_weights") -> DataFrame:
    """``docs`` with ``out`` (0 to 1, higher: label 1 likelier) and ``attention`` (``array<double>``: weight of each passage of 64 words).

    One narrow pass over whole texts of any length, a text at a time in blocks of passages. Null and empty texts are one passage without words and
    have a score, too. All rows come back, repeated ones as well; an empty table gives none. Other columns pass through,
    those named like the results are replaced.
    """
    docs = docs.drop(out, attention)
    place, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores, weights = zip(*(m.score(t.as_py()) for t in b.column(place))) if b.num_rows else ((), ())
            kept = pa.array([w.tolist() for w in weights], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), kept], names=[*b.schema.names, out, attention])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(attention, T.ArrayType(T.DoubleType()))]))
