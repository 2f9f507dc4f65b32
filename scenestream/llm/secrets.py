"""Secret scans: rules are reduced to Boolean trigram queries, an inverted index proposes, the rules verify."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as rx
from re import _parser as rx_tree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` is at least ``least`` characters long, otherwise it is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, in their order. Hex needs its length in the pattern: runs are whole, so this is the same.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

# Strings of one place in a pattern are spelled out up to this many; beyond it the place demands nothing.
SPELL_OUT = 64
# Bytes of text in one index segment.
SEGMENT = 1 << 20

Query = list[list[frozenset[bytes]]]  # every clause must hold; a clause holds if all trigrams of one alternative occur


def _spellings(node) -> set[str] | None:
    """All strings the node can stand for (lower-cased), None if too many."""
    op, arg = node
    if op is rx.LITERAL:
        return {chr(arg).lower()}
    if op is rx.IN:
        found: set[str] = set()
        for kind, v in arg:
            if kind is rx.LITERAL:
                found.add(chr(v).lower())
            elif kind is rx.RANGE and v[1] - v[0] < 8:
                found |= {chr(x).lower() for x in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is rx.SUBPATTERN:
        return _joined(arg[-1])
    if op is rx.BRANCH:
        parts = [_joined(b) for b in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op in (rx.MAX_REPEAT, rx.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
        inner = _joined(arg[2])
        return None if inner is None else inner | {""}
    return None


def _joined(seq) -> set[str] | None:
    out = {""}
    for node in seq:
        s = _spellings(node)
        if s is None or len(out) * len(s) > SPELL_OUT:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigram_query(pattern: str) -> Query:
    """What any match must contain, in trigrams of its lower-cased bytes. Empty: no mandatory trigram."""
    clauses: Query = []

    def demand(strings: set[str]) -> None:
        options = []
        for s in strings:
            b = s.encode()
            options.append(frozenset(b[i : i + 3] for i in range(len(b) - 2)))
        if all(options):  # an option that contains another adds nothing
            clauses.append(sorted((o for o in set(options) if not any(x < o for x in options)), key=sorted))

    def visit(seq) -> None:
        run = {""}
        for node in seq:
            s = _spellings(node)
            if s is not None and len(run) * len(s) <= SPELL_OUT:
                run = {a + b for a in run for b in s}
                continue
            demand(run)
            run = {""} if s is None else s
            op, arg = node
            if op is rx.SUBPATTERN:
                visit(arg[-1])
            elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT) and arg[0] > 0:
                visit(arg[2])
        demand(run)

    visit(rx_tree.parse(pattern))
    return clauses


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for clause in q for option in clause for g in option})
    number = {g: i + 1 for i, g in enumerate(grams)}
    slots = np.zeros(1 << 24, np.uint16)
    for g, i in number.items():
        slots[g[0] << 16 | g[1] << 8 | g[2]] = i
    numbered = [[[[number[g] for g in option] for option in clause] for clause in q] for q in queries]
    return [re.compile(r.pattern, re.ASCII) for r in rules], numbered, slots, len(grams)


def _postings(texts: list[bytes], slots: np.ndarray, grams: int) -> list[np.ndarray]:
    """For each trigram number the sorted documents of the segment that hold it."""
    whole = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.uint32)
    if len(whole) < 3:
        return [np.empty(0, np.int64)] * (grams + 1)
    ids = slots[whole[:-2] << 16 | whole[1:-1] << 8 | whole[2:]]
    at = np.flatnonzero(ids)
    doc = np.searchsorted(np.cumsum([len(t) for t in texts]), at, side="right")
    pair = np.unique(ids[at].astype(np.int64) * len(texts) + doc)
    bounds = np.searchsorted(pair, np.arange(grams + 2) * len(texts))
    return [pair[bounds[g] : bounds[g + 1]] - g * len(texts) for g in range(grams + 1)]


def _candidates(query: list, postings: list[np.ndarray], n: int) -> np.ndarray:
    """Documents that satisfy a query; all of them if it demands nothing."""
    docs = np.arange(n)
    for clause in query:
        found = np.empty(0, np.int64)
        for option in clause:
            hit = postings[option[0]]
            for g in option[1:]:
                hit = np.intersect1d(hit, postings[g], assume_unique=True)
            found = np.union1d(found, hit)
        docs = np.intersect1d(docs, found, assume_unique=True)
    return docs


def _scan(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    patterns, queries, slots, grams = _compiled(rules)
    found: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
    first = 0
    while first < len(texts):
        last, size, raw = first, 0, []
        while last < len(texts) and (size < SEGMENT or last == first):
            raw.append(texts[last].encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            last += 1
        postings = _postings(raw, slots, grams)
        for nth, (rule, pattern, q) in enumerate(zip(rules, patterns, queries)):
            for d in _candidates(q, postings, len(raw)):
                for m in pattern.finditer(texts[first + d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[first + d].append((m.start(), nth, rule.kind, m.end()))
        first = last
    return [[(kind, s, e) for s, _, kind, e in sorted(f)] for f in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """``docs`` with a column ``out``: ``array<struct<kind, start, end>>``, ordered by start, then by rule.

    Positions count code points, the end is exclusive; matches of one rule are leftmost and do not overlap. Each task
    indexes its documents in segments of about a megabyte; a rule is run only on the documents its trigram query
    selects, a rule without mandatory trigrams on all. Nothing is shuffled, whatever the sizes of sources or groups.
    Null texts count as empty and have no secrets; a document of any length is scanned whole; all other columns
    pass through; a column named ``out`` is replaced.
    """
    docs = docs.drop(out)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in _scan(texts, rules)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, out])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(span))]))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets; overlapping secrets count as one, named by the first.

    Columns stay as they are, but ``n_chars`` is counted anew. Documents without secrets are unchanged.
    """
    mark = "__secrets"
    found = find_secrets(docs, rules, mark)
    # Runs of overlapping spans: (start, end, kind), folded in order of start.
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
        F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(acc, -1)["kind"].alias("kind"), F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(acc, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))
    runs = F.aggregate(mark, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"), step)
    found = found.withColumn(mark, runs)
    text, m = F.col("text"), F.col(mark)
    parts = F.transform(
        m,
        lambda s, i: F.concat(
            F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.get(m, i - 1)["end"] + 1).cast("int"), (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"])).cast("int")),
            F.lit("["), s["kind"], F.lit("]"),
        ),
    )
    tail = F.substring(text, (F.element_at(m, -1)["end"] + 1).cast("int"), F.length(text))
    found = found.withColumn("text", F.when(F.size(m) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(m) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)
