"""Samples, label runs, splits, class mapping and model lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels
from ..session import cut
from .sequence import running

MIN_ANNOTATED = 10


def dataset_stats(samples: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Total, annotated and unannotated samples per dataset; datasets without samples count 0."""
    per = samples.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("total"), F.count_if("annotated").alias("annotated"))
    if datasets is not None:
        per = datasets.select("dataset_name").distinct().join(per, "dataset_name", "left").fillna(0, ["total", "annotated"])
    return per.withColumn("unannotated", F.col("total") - F.col("annotated"))


def ready(stats: DataFrame, minimum: int = MIN_ANNOTATED) -> DataFrame:
    return stats.withColumn("is_ready", F.col("annotated") >= minimum)


def train_val_split(samples: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Split each dataset's annotated samples; exactly round-half-even(n * ratio) go to training.

    The order is that of a seeded hash; a large dataset is ranked in ranges of it. The same seed gives the same split.
    """
    a = samples.where("annotated").withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id").cast("string"))))
    n = a.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(a, ["dataset_name"], ["_h", "sample_id"], {"_rank": F.lit(1).cast("bigint")})
    quota = F.bround(F.col("_n") * F.lit(float(ratio)), 0)
    return (
        ranked.join(n, "dataset_name")
        .withColumn("split", F.when(F.col("_rank") <= quota, "train").otherwise("val"))
        .drop("_h", "_n", "_rank")
    )


def class_mapping(model_classes: DataFrame, dataset_classes: DataFrame) -> DataFrame:
    """Model class ids onto dataset class positions by name, ignoring case; other classes drop out.

    ``model_classes``: class_id, name. ``dataset_classes``: dataset_name, classes (array). A name listed
    twice maps to its last position.
    """
    ds = dataset_classes.select("dataset_name", F.posexplode("classes").alias("pos", "n"))
    ds = ds.groupBy("dataset_name", F.lower("n").alias("key")).agg(F.max("pos").alias("dataset_class"))
    return model_classes.withColumn("key", F.lower("name")).join(ds, "key").select(
        "dataset_name", F.col("class_id").alias("model_class"), "name", "dataset_class"
    )


def auto_annotations(
    samples: DataFrame, predictions: DataFrame, mapping: DataFrame, width: int, height: int, threshold: float = 0.5
) -> DataFrame:
    """Labels for samples not annotated yet: surer than the threshold, class known to the dataset."""
    todo = samples.where("not annotated").select("sample_id", "dataset_name")
    kept = predictions.where(F.col("confidence") > threshold)
    m = mapping.select("dataset_name", F.col("model_class").alias("class_id"), "dataset_class")
    norm = labels.to_normalised(g.box(), F.lit(float(width)), F.lit(float(height)))
    return (
        kept.join(todo, "sample_id")
        .join(m, ["dataset_name", "class_id"])
        .select("sample_id", "dataset_name", "det_idx", "dataset_class", *[c.alias(n) for c, n in zip(norm, ("cx", "cy", "w", "h"))])
    )


def annotate_outcome(samples: DataFrame, failed: DataFrame) -> DataFrame:
    """Per dataset: samples labelled, failed, and skipped because they had labels already."""
    bad = failed.select("sample_id", F.lit(True).alias("_f")).distinct()
    s = samples.join(bad, "sample_id", "left")
    open_, broken = ~F.col("annotated"), F.coalesce("_f", F.lit(False))
    return s.groupBy("dataset_name").agg(
        F.count_if(open_ & ~broken).alias("success_count"),
        F.count_if(open_ & broken).alias("failed_count"),
        F.count_if("annotated").alias("skipped_count"),
    )


def to_label(images: DataFrame, existing: DataFrame, key: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Images a labelling run works on: those without a label file, or all when overwriting."""
    return images if overwrite else images.join(existing.select(*key), list(key), "left_anti")


def label_summary(images: DataFrame, existing: DataFrame, dets: DataFrame, key: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Rows (name, n): totals of a run, then boxes per class."""
    todo = to_label(images, existing, key, overwrite)
    classes = dets.join(todo, list(key), "left_semi").groupBy(F.concat(F.lit("class:"), "class_name").alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    marks = images.select(F.lit(1).alias("t"), F.lit(0).alias("l")).unionByName(todo.select(F.lit(0).alias("t"), F.lit(1).alias("l")))
    totals = marks.agg(F.sum("t").alias("total"), F.sum("l").alias("labelled"))
    rows = totals.selectExpr("stack(3, 'total', total, 'labelled', labelled, 'skipped', total - labelled) as (name, n)")
    return rows.unionByName(classes)


def training_summary(epochs: DataFrame) -> DataFrame:
    """Per job: best mAP50, last epoch and its values."""
    return epochs.groupBy("job_id").agg(
        F.max("map50").alias("best_map50"),
        F.max("epoch").alias("last_epoch"),
        F.max_by("map50", "epoch").alias("last_map50"),
        F.max_by("box_loss", "epoch").alias("last_box_loss"),
    )


def parents(models: DataFrame) -> DataFrame:
    """Each model with its parent's version and the job that produced it."""
    p = models.select(F.col("model_id").alias("parent_id"), F.col("version").alias("parent_version"))
    return models.join(p, "parent_id", "left").select("model_id", "version", "parent_id", "parent_version", "job_id")


def lineage(models: DataFrame) -> DataFrame:
    """All ancestors of each model with their distance: models times depth rows, which is what is asked for.

    The reach doubles with every round, so a chain of any length takes few; in a circle each ancestor is listed once, at its
    least distance. What lies beyond the reach is found from the ancestors at its very end, so that each pair is made once for
    each shortest path, not for each way to cut it in two.
    """
    up = cut(models.where("parent_id is not null").select("model_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("steps")).distinct())
    known, reach = -1, 1
    while (n := up.count()) != known:
        known = n
        further = up.select(F.col("model_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"), F.col("steps").alias("more"))
        end = up.where(F.col("steps") == reach)
        reached = end.join(further, "ancestor_id").select("model_id", F.col("next").alias("ancestor_id"), (F.col("steps") + F.col("more")).alias("steps"))
        up = cut(up.union(reached).groupBy("model_id", "ancestor_id").agg(F.min("steps").alias("steps")))
        reach *= 2
    return up
