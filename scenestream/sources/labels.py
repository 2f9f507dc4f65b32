"""Label files: one text file per image, ``class cx cy w h`` per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as fn

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all label files: image_id (file stem), line_no, line.

    Files are read whole, so a line keeps its place; label files are a few kilobytes.
    """
    files = spark.read.option("wholetext", True).text(path).select(
        stem(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("image_id"), "value"
    )
    return files.select("image_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def parse(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Truth boxes in pixels. ``images``: image_id, width, height. Bad lines, blanks and comments are dropped."""
    rows = lines.where(fn.is_label_text(F.col("line"))).withColumn("v", fn.parse_line(F.col("line")))
    rows = rows.where("v is not null").join(images, "image_id")
    px = fn.to_pixels(F.col("v"), F.col("width"), F.col("height"))
    return rows.select(
        "image_id",
        F.col("line_no").cast("bigint").alias("gt_idx"),
        F.col("v.class_id").alias("class_id"),
        *[c.alias(n) for c, n in zip(px, ("x1", "y1", "x2", "y2"))],
    )


def scan_summary(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Per image: boxes read, bad lines skipped, and whether it has no label file at all."""
    text = fn.is_label_text(F.col("line"))
    good = fn.parse_line(F.col("line")).isNotNull()
    per = lines.groupBy("image_id").agg(F.count_if(text & good).alias("boxes"), F.count_if(text & ~good).alias("bad_lines"))
    return images.join(per, "image_id", "left").select(
        "image_id",
        F.coalesce("boxes", F.lit(0)).alias("boxes"),
        F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"),
        F.col("boxes").isNull().alias("skipped"),
    )


def label_files(dets: DataFrame, images: DataFrame, width: int, height: int) -> DataFrame:
    """Body of each image's label file; images without detections get a comment line."""
    w, h = F.lit(float(width)), F.lit(float(height))
    line = fn.render_line(F.col("class_id"), *fn.to_normalised(g.box(), w, h))
    entry = F.concat(fn.render_comment(F.col("confidence"), F.col("class_name")), F.lit("\n"), line)
    key = ["camera_id", "frame_seq"]
    per = dets.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("det_idx", entry.alias("t")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["t"]), "\n")
    return images.join(per, key, "left").select(*key, F.coalesce(body, F.lit("# no detections")).alias("body"))


def label_rows(files: DataFrame) -> DataFrame:
    """One row per label line: camera_id, image_id, line_no, line."""
    image = F.concat_ws("_", "camera_id", F.col("frame_seq").cast("string")).alias("image_id")
    return files.select("camera_id", image, F.posexplode(F.split("body", "\n")).alias("line_no", "line"))


def write_label_rows(files: DataFrame, path: str) -> None:
    """Label lines as JSON rows by camera, many images to a file; ``read_label_rows`` reads them back. Append-only: the
    caller anti-joins what is labelled already (see ``datasets.to_label``)."""
    label_rows(files).repartition("camera_id", "image_id").write.mode("append").partitionBy("camera_id").json(path)


def read_label_rows(spark: SparkSession, path: str) -> DataFrame:
    """image_id, line_no, line as written by ``write_label_rows``: what ``parse`` and ``scan_summary`` take."""
    return spark.read.schema("camera_id string, image_id string, line_no int, line string").json(path).select("image_id", "line_no", "line")


def match_images(files: DataFrame, labelled: DataFrame) -> DataFrame:
    """Image files (by extension) with the flag whether a label of the same stem exists."""
    ext = F.lower(F.element_at(F.split("filename", r"\."), -1))
    images = files.where(ext.isin(*IMAGE_EXTENSIONS)).withColumn("stem", stem(F.col("filename")))
    have = labelled.select("stem").distinct().withColumn("matched", F.lit(True))
    return images.join(have, "stem", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
