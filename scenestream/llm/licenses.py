"""License scans: word k-grams joined to template positions vote for diagonals, neighbouring diagonals merge, spans are verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_documents, text_key, word_count, words


@dataclass(frozen=True)
class Template:
    """Words of a notice or a whole license. An exact one must stand word for word, else ``SHARE`` of its words must be found in order."""

    label: str
    text: str
    exact: bool = False


# Phrases that are counted word for word, with their labels.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
# Well-known notices, as lower-cased words.
NOTICES = (
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc0", "to the extent possible under law the author has waived all copyright"),
    Template("proprietary", "all rights reserved"),
    # Whole license texts.
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
        "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
        "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
        "from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this "
        "software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software",
    ),
)

K = 2  # words in a gram: the shortest phrase has two
SHARE = 0.87  # of a notice's words that must be found
NEAR = 2  # diagonals this far apart belong together: words put in or left out
BITS = 60  # grams of a template noted in one number


def _grams(text: str) -> list[str]:
    ws = text.split()
    return [" ".join(ws[i : i + K]) for i in range(len(ws) - K + 1)]


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row for each gram of each template: bounded by the code, so it may be broadcast."""
    rows = [(n, t.label, t.exact, len(t.text.split()), at, g) for n, t in enumerate(templates) for at, g in enumerate(_grams(t.text))]
    table = spark.createDataFrame(rows, "template int, label string, exact boolean, length int, at int, gram string")
    return table.withColumn("hash", F.xxhash64("gram"))


def _covered(ats: set[int]) -> int:
    """Words of the template that its grams at these places hold."""
    return len(ats | {a + 1 for a in ats})


def _spans(length: int, diagonals: list[tuple[int, set[int]]]) -> Iterator[tuple[int, int, float]]:
    """``first, last, share`` of a template's occurrences from its diagonals, in order.

    Diagonals at most ``NEAR`` apart are a run. It is one occurrence if it holds enough of the words and is at most half as long again
    as the template. A longer run, in which stray grams chain on, is searched for occurrences from left to right: diagonals are
    added to the first one while the span stays that short, and the best share so far is kept.
    """
    most = 1.5 * length + 1
    runs: list[list[tuple[int, set[int]]]] = []
    for d in diagonals:
        if not runs or d[0] - runs[-1][-1][0] > NEAR:
            runs.append([])
        runs[-1].append(d)
    for run in runs:
        i, after = 0, None
        while i < len(run):
            ats: set[int] = set()
            first, last, best = None, None, None
            for diagonal, found in run[i:]:
                if after is not None:
                    found = {a for a in found if diagonal + a > after}
                if not found:
                    continue
                lo, hi = diagonal + min(found), diagonal + max(found) + K - 1
                lo, hi = (lo, hi) if first is None else (min(first, lo), max(last, hi))
                if hi - lo + 1 > most:
                    break
                ats, first, last = ats | found, lo, hi
                if best is None or _covered(ats) > best[2]:
                    best = (first, last, _covered(ats))
                if best[2] == length:
                    break
            if best and best[2] >= SHARE * length:
                yield best[0], best[1], min(1.0, best[2] / length)
                after = best[1]
            else:
                i += 1


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, key, label, length, votes in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_key", "label", "length", "votes"))):
            held: dict[int, set[int]] = {}
            for v in votes:
                bits = v["found"]
                held.setdefault(v["diagonal"], set()).update(BITS * v["block"] + i for i in range(BITS) if bits >> i & 1)
            rows += [(doc, key, label, *s) for s in _spans(length, sorted(held.items()))]
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "text_key", "label", "first", "last", "share"])


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """Per row ``doc_id, text_key, n_words, spans``; a span is ``label, exact, first, last, share`` in words.

    All grams of all words are joined to the template positions by hash (and compared as text); each match votes for
    the diagonal ``position - template position``. An exact template counts where one diagonal holds all its grams. For the
    others, near diagonals merge and the spans are verified (see ``_spans``). Templates may have any length. Votes are added up before
    they are shuffled. Spans of different templates may overlap, those of one inexact template do not. Whole texts are read,
    however long. Null and blank texts have no words; rows may repeat; a null ``doc_id`` is a document like any other; an
    empty table gives no rows; other columns are not read.
    """
    w = F.col("w")
    read = docs.select("doc_id", F.coalesce(text_key(F.col("text")), F.lit(0)).alias("text_key"), words(F.col("text")).alias("w"))
    following = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    grams = F.zip_with(w, following, lambda a, b: F.concat_ws(" ", a, b))
    places = read.select("doc_id", "text_key", F.posexplode(grams).alias("pos", "gram")).withColumn("hash", F.xxhash64("gram"))
    known = template_grams(docs.sparkSession, templates)
    key = ["doc_id", "text_key", "template", "label", "exact", "length"]
    votes = places.join(F.broadcast(known), ["hash", "gram"]).select(
        *key, (F.col("pos") - F.col("at")).alias("diagonal"), F.expr(f"at div {BITS}").alias("block"), F.expr(f"shiftleft(1L, int(at % {BITS}))").alias("bit")
    )
    # Rows that repeat share a key and so their votes: bits are or-ed.
    diagonals = cut(votes.groupBy(*key, "diagonal", "block").agg(F.bit_or("bit").alias("found")))
    whole = diagonals.where("exact").groupBy(*key, "diagonal").agg(F.sum(F.expr("bit_count(found)")).alias("n")).where(F.col("n") == F.col("length") - K + 1)
    exact = whole.select(
        "doc_id", "text_key", F.struct("label", "exact", F.col("diagonal").cast("long").alias("first"), (F.col("diagonal") + F.col("length") - 1).cast("long").alias("last"), F.lit(1.0).alias("share")).alias("span")
    )
    # A gram holds K words, so fewer votes than this can't make a span.
    enough = F.sum(F.expr("bit_count(found)")) * K >= SHARE * F.col("length")
    gathered = diagonals.where("not exact").groupBy(*key).agg(F.collect_list(F.struct("diagonal", "block", "found")).alias("votes"), enough.alias("enough")).where("enough")
    kind = docs.schema["doc_id"].dataType.simpleString()
    close = gathered.select("doc_id", "text_key", "label", "length", "votes").mapInArrow(_verified, f"doc_id {kind}, text_key long, label string, first long, last long, share double")
    spans = exact.union(close.select("doc_id", "text_key", F.struct("label", F.lit(False).alias("exact"), "first", "last", "share").alias("span")))
    found = spans.distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    every = docs.select("doc_id", F.coalesce(text_key(F.col("text")), F.lit(0)).alias("text_key"), word_count(F.col("text")).alias("n_words"))
    out = join_documents(every, found, "left")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
