"""Scores from counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp == 0, F.lit(0.0)).otherwise(tp / (tp + fp))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp == 0, F.lit(0.0)).otherwise(tp / (tp + fn))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return F.when(tp == 0, F.lit(0.0)).otherwise(2.0 * p * r / (p + r))


def with_prf(df, tp: str = "tp", fp: str = "fp", fn: str = "fn"):
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return df.withColumns({"precision": precision(t, p), "recall": recall(t, n), "f1": f1(t, p, n)})


def review_scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Scores of a manual review, each rounded to four digits; F1 comes from the rounded pair."""
    p = F.when(tp + fp > 0, F.round(tp / (tp + fp), 4)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, F.round(tp / (tp + fn), 4)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(F.lit(0.0))
    return p, r, f


def count_error(expected: Column, actual: Column) -> tuple[Column, Column]:
    """(absolute, relative). Relative is 0 for 0 of 0 and infinite for x of 0."""
    gap = F.abs(actual - expected)
    rel = (
        F.when(expected > 0, gap / expected)
        .when(actual == 0, F.lit(0.0))
        .otherwise(F.lit(float("inf")))
    )
    return gap, rel
