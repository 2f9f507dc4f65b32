"""Pairs of boxes near each other in one frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Point, distance


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    radius: float | Column,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    inclusive: bool = False,
) -> DataFrame:
    """Join rows of a frame that lie closer than ``radius`` (adds ``dist``).

    Both sides meet in grid cells of twice the radius, so only the surroundings of a point are
    compared, not the whole frame. Column names of the two sides must differ outside ``on``, but for the settings (``s_...``) that a
    radius may be made of; both sides have them, and the left one's stay.
    """
    cell = 2.0 * radius

    def lo_hi(c: str) -> Column:
        return F.explode(
            F.sequence(F.floor((F.col(c) - radius) / cell), F.floor((F.col(c) + radius) / cell))
        )

    a = left.withColumn("_gx", lo_hi(left_at[0])).withColumn("_gy", lo_hi(left_at[1]))
    b = right.withColumns({"_gx": F.floor(F.col(right_at[0]) / cell), "_gy": F.floor(F.col(right_at[1]) / cell)})
    b = b.drop(*[c for c in b.columns if c.startswith("s_")])
    p: Point = (F.col(left_at[0]), F.col(left_at[1]))
    q: Point = (F.col(right_at[0]), F.col(right_at[1]))
    pairs = a.join(b, [*on, "_gx", "_gy"]).withColumn("dist", distance(p, q)).drop("_gx", "_gy")
    return pairs.where(F.col("dist") <= radius if inclusive else F.col("dist") < radius)


def touching_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], cell: float = 256.0) -> DataFrame:
    """Join boxes of a frame that overlap or touch. Left box columns are x1..y2, right ones r_x1..r_y2.

    Boxes meet in every grid cell they share; a pair is kept in the first such cell only.
    """

    def span(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))

    a = left.withColumn("_gx", span("x1", "x2")).withColumn("_gy", span("y1", "y2"))
    b = right.withColumn("_gx", span("r_x1", "r_x2")).withColumn("_gy", span("r_y1", "r_y2"))
    first = (F.col("_gx") == F.floor(F.greatest("x1", "r_x1") / cell)) & (
        F.col("_gy") == F.floor(F.greatest("y1", "r_y1") / cell)
    )
    touch = (
        (F.col("x1") <= F.col("r_x2"))
        & (F.col("r_x1") <= F.col("x2"))
        & (F.col("y1") <= F.col("r_y2"))
        & (F.col("r_y1") <= F.col("y2"))
    )
    return a.join(b, [*on, "_gx", "_gy"]).where(first & touch).drop("_gx", "_gy")
