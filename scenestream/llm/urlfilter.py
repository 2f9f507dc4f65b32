"""URL filters: rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER

ALLOW, BLOCK = "allow", "block"
TOKEN = re.compile(r"[a-z0-9]+").findall


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and all its subdomains where the path starts with ``path``; the longest that fits wins."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased url that contains the literal tokens ``tokens`` whenever it matches.

    A rule without tokens is run on every url.
    """

    pattern: str
    tokens: tuple[str, ...]
    verdict: str = BLOCK


# The site rules, in their order.
SITES = (
    SiteRule("com", "/", ALLOW),
    SiteRule("example.com", "/en/", BLOCK),
    SiteRule("www.example.com", "/en/", ALLOW),
    SiteRule("net", "/es/", BLOCK),
    SiteRule("net", "/fr/", BLOCK),
)
# What is judged by its look where no site rule fits. Any that blocks wins.
PATTERNS = (
    PatternRule(r"(^|[^a-z0-9])spam-farm([^a-z0-9]|$)", ("spam", "farm")),
    PatternRule(r"(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)", ("cheap", "pills")),
    PatternRule(r"^https?://casino\.", ("casino",)),
    PatternRule(r"/(wp-login|wp-admin)(\.php|/|$)", ("wp",)),
    PatternRule(r"^[a-z]+://[0-9]+(\.[0-9]+){3}([:/?#]|$)", ()),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _site_tokens(r: SiteRule) -> tuple[str, ...]:
    return tuple(TOKEN(r.host.lower()))


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """Over all urls, in how many each of the rules' tokens occurs; as many rows as the rules have tokens."""
    tokens = F.array_intersect(F.regexp_extract_all(F.translate("url", UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1)), F.array(*map(F.lit, wanted)))
    rows = urls.where(F.col("url").isNotNull()).select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    return {w: 0 for w in wanted} | {r["t"]: r["n"] for r in rows}


def judge(pages: DataFrame, sites: tuple[SiteRule, ...] = SITES, patterns: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    Both kinds of rule hang on their rarest literal token, counted over all urls. A url's distinct tokens fetch the
    candidate rules; only those are compared or run as regular expressions. Without a site rule that fits, a pattern that
    matches blocks and all else is allowed. Null urls and urls without ``://`` have an empty host and path and no
    rule; patterns see an empty url for null. One narrow pass whatever hosts are frequent; columns named like the
    results are replaced, others pass through.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    literals = [_site_tokens(r) for r in sites] + [r.tokens for r in patterns]
    counts = token_counts(pages.select("url"), sorted({t for ts in literals for t in ts}))
    index: dict[str, list[int]] = {}
    always = []
    for n, ts in enumerate(literals):
        if ts:
            index.setdefault(min(ts, key=lambda t: (counts[t], t)), []).append(n)
        else:
            always.append(n)
    compiled = [re.compile(p.pattern, re.ASCII | re.DOTALL) for p in patterns]
    at = {c: i for i, c in enumerate([*pages.columns, "host", "path"])}
    fold = str.maketrans(UPPER, LOWER)

    def verdict(url: str, host: str, path: str) -> tuple[str | None, str]:
        low = url.translate(fold)
        fetched = {n for t in set(TOKEN(low)) for n in index.get(t, ())}
        best = None
        for n in sorted(n for n in fetched if n < len(sites)):
            r = sites[n]
            if path.startswith(r.path) and (host == r.host or host.endswith("." + r.host)) and (best is None or len(r.name) > len(best.name)):
                best = r
        if best:
            return best.name, best.verdict
        hit = (patterns[n - len(sites)] for n in sorted([*always, *(n for n in fetched if n >= len(sites))]) if compiled[n - len(sites)].search(low))
        return None, next((p.verdict for p in hit), ALLOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [verdict(u or "", h, p) for u, h, p in zip(*(b.column(at[c]).to_pylist() for c in ("url", "host", "path")))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=[*b.schema.names, "rule", "verdict"]
            )

    ready = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return ready.mapInArrow(run, T.StructType([*ready.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
