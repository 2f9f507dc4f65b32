"""Label lines: ``class cx cy w h`` with coordinates normalised to the image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Box

LABEL_STRUCT = "struct<class_id:int,cx:double,cy:double,w:double,h:double>"


def is_label_text(line: Column) -> Column:
    text = F.trim(line)
    return (text != "") & ~text.startswith("#")


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _number(parts: Column, k: int, kind: str) -> Column:
    return F.try_element_at(parts, F.lit(k)).try_cast(kind)


def parse_line(line: Column, strict: bool = True) -> Column:
    """Struct of the five values; NULL when the line is malformed.

    ``strict`` also rejects lines that do not hold exactly five fields.
    """
    parts = _fields(line)
    values = [_number(parts, 1, "int")] + [_number(parts, k, "double") for k in range(2, 6)]
    good = values[0].isNotNull()
    for v in values[1:]:
        good = good & v.isNotNull()
    if strict:
        good = good & (F.size(parts) == 5)
    names = ("class_id", "cx", "cy", "w", "h")
    return F.when(good, F.struct(*[v.alias(n) for v, n in zip(values, names)]))


def to_pixels(label: Column, width: Column, height: Column) -> Box:
    cx, cy = label["cx"] * width, label["cy"] * height
    half_w, half_h = label["w"] * width / 2.0, label["h"] * height / 2.0
    return cx - half_w, cy - half_h, cx + half_w, cy + half_h


def to_normalised(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """(cx, cy, w, h) in image units."""
    return (
        (b[0] + b[2]) / 2.0 / width,
        (b[1] + b[3]) / 2.0 / height,
        (b[2] - b[0]) / width,
        (b[3] - b[1]) / height,
    )


def fixed(x: Column, digits: int) -> Column:
    """``%.6f`` and the like with C rounding: by the exact binary value, half to even.

    ``format_string`` rounds the shortest decimal form half up, which differs where that form ends in 5.
    """
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def render_line(class_id: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.concat_ws(" ", class_id.cast("string"), *[fixed(v, 6) for v in (cx, cy, w, h)])


def render_comment(confidence: Column, name: Column) -> Column:
    return F.concat(F.lit("# conf="), fixed(confidence, 2), F.lit(" "), name)
