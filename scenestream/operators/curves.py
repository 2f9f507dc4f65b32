"""Precision-recall curves and average precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sequence import running

# Order of detections along a curve: confidence down, then image, then position in the image.
ORDER = ["neg_conf", "image_id", "det_idx"]


def pr_curve(scored: DataFrame, truth_counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Running precision and recall along falling confidence.

    ``scored``: group, image_id, det_idx, confidence, is_tp. ``truth_counts``: group, gt_count. Classes
    without truth have no curve.
    """
    rows = scored.join(truth_counts.where("gt_count > 0"), list(group)).selectExpr("*", "-confidence as neg_conf")
    summed = running(
        rows, group, ORDER, {"cum_tp": F.col("is_tp").cast("bigint"), "rank": F.lit(1).cast("bigint")}
    )
    return summed.withColumns(
        {"precision": F.col("cum_tp") / F.col("rank"), "recall": F.col("cum_tp") / F.col("gt_count")}
    )


def average_precision(curve: DataFrame, group: Sequence[str]) -> DataFrame:
    """11-point AP: mean over recall 0, 0.1 ... 1 of the best precision at that recall or more."""
    best = [
        F.coalesce(F.max(F.when(F.col("recall") >= i / 10.0, F.col("precision"))), F.lit(0.0)) for i in range(11)
    ]
    total = best[0]
    for b in best[1:]:
        total = total + b
    return curve.groupBy(*group).agg((total / 11.0).alias("ap"))


def average_precision_all_points(curve: DataFrame, group: Sequence[str]) -> DataFrame:
    """Area under the curve after replacing each precision by the best at the same or higher recall.

    A false positive's precision is below that of the true positive before it, so true positives alone are looked at; the first row of each
    curve stays for a group that has none. They are written once: the bounds of their ranges are sampled.
    """
    tops = cut(curve.where(F.col("is_tp") | (F.col("rank") == 1)).select(*group, "rank", "is_tp", "precision", "gt_count"))
    lifted = running(tops, group, ["rank"], {"ceiling": F.col("precision")}, how="max", reverse=True)
    return lifted.groupBy(*group).agg(
        (F.coalesce(F.sum(F.when(F.col("is_tp"), F.col("ceiling"))), F.lit(0.0)) / F.first("gt_count")).alias("ap")
    )


def with_all_classes(ap: DataFrame, truth_counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """AP 0 for a class with truth but no detections."""
    return truth_counts.where("gt_count > 0").join(ap, list(group), "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def mean_ap(ap: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ap.groupBy(*by).agg(F.avg("ap").alias("map"))
