"""Accuracy evaluation: boxes against truth boxes, rule events against truth events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import count_error, with_prf
from ..operators import curves
from ..operators.matching import THRESHOLDS, match_boxes, match_events, match_levels
from ..operators.sequence import running
from ..schema import EVENT_TYPES
from ..session import cut

BACKGROUND = -1


# --- boxes ----------------------------------------------------------------------------------------


def per_image(dets: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Truth, detection and match counts per image, from one aggregation over the three logs."""
    one = F.lit(1)
    marks = [
        truth.select("image_id", one.alias("gt"), F.lit(0).alias("det"), F.lit(0).alias("tp")),
        dets.select("image_id", F.lit(0).alias("gt"), one.alias("det"), F.lit(0).alias("tp")),
        matches.select("image_id", F.lit(0).alias("gt"), F.lit(0).alias("det"), one.alias("tp")),
    ]
    rows = marks[0].unionByName(marks[1]).unionByName(marks[2])
    return rows.groupBy("image_id").agg(
        F.sum("gt").alias("gt_count"), F.sum("det").alias("det_count"), F.sum("tp").alias("tp_count")
    )


def global_pr(images: DataFrame) -> DataFrame:
    sums = images.agg(
        F.sum("tp_count").alias("tp"),
        F.sum(F.col("det_count") - F.col("tp_count")).alias("fp"),
        F.sum(F.col("gt_count") - F.col("tp_count")).alias("fn"),
    )
    return with_prf(sums)


def confusion_matrix(dets: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts for every pair of truth and predicted class; -1 is the background.

    The classes are those of the truth; any other predicted class counts as background.
    """
    d = dets.join(matches, ["image_id", "det_idx"], "left").select(
        "image_id", "gt_idx", F.col("class_id").alias("pred_class")
    )
    t = truth.select("image_id", "gt_idx", F.col("class_id").alias("gt_class"))
    cells = d.join(t, ["image_id", "gt_idx"], "full_outer")
    counts = cells.groupBy(
        F.coalesce("gt_class", F.lit(BACKGROUND)).alias("gt_class"), F.coalesce("pred_class", F.lit(BACKGROUND)).alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    known = truth.select(F.col("class_id").alias("p"), F.lit(True).alias("known")).distinct()
    folded = (
        counts.join(known, "p", "left")
        .withColumn("pred_class", F.when(F.col("known"), F.col("p")).otherwise(BACKGROUND))
        .groupBy("gt_class", "pred_class")
        .agg(F.sum("n").alias("n"))
    )
    # The grid comes from the class list, one array in one row.
    listed = truth.agg(F.concat(F.collect_set("class_id"), F.array(F.lit(BACKGROUND))).alias("cs"))
    grid = listed.select("cs", F.explode("cs").alias("gt_class")).select("gt_class", F.explode("cs").alias("pred_class"))
    return grid.join(folded, ["gt_class", "pred_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def truth_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("class_id").agg(F.count(F.lit(1)).alias("gt_count"))


def scored(dets: DataFrame, matches: DataFrame) -> DataFrame:
    """Detections with ``is_tp`` under class-aware matching."""
    hit = matches.select("image_id", "class_id", "det_idx", F.lit(True).alias("is_tp"))
    return dets.join(hit, ["image_id", "class_id", "det_idx"], "left").select(
        "class_id", "image_id", "det_idx", "confidence", F.coalesce("is_tp", F.lit(False)).alias("is_tp")
    )


def class_curve(dets: DataFrame, truth: DataFrame) -> DataFrame:
    # Written before the curve's ranges, whose bounds are sampled: boxes are not matched a second time for that.
    marks = cut(scored(dets, match_boxes(dets, truth, 0.5, by_class=True)))
    return curves.pr_curve(marks, truth_counts(truth), ["class_id"])


def class_metrics(dets: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class: AP, precision, recall, counts. A class without truth has NULL AP and only false positives."""
    marks = cut(scored(dets, match_boxes(dets, truth, 0.5, by_class=True)))  # read by the curve and by the counts
    counts = truth_counts(truth)
    ap = curves.average_precision(curves.pr_curve(marks, counts, ["class_id"]), ["class_id"])
    found = marks.groupBy("class_id").agg(F.count_if("is_tp").alias("hit"), F.count_if(~F.col("is_tp")).alias("fp"))
    joined = counts.join(found, "class_id", "full_outer").join(ap, "class_id", "left")
    has = F.col("gt_count") > 0
    filled = joined.select(
        "class_id",
        F.coalesce("gt_count", F.lit(0)).alias("gt_count"),
        F.coalesce("hit", F.lit(0)).alias("tp"),
        F.coalesce("fp", F.lit(0)).alias("fp"),
        "ap",
    )
    return with_prf(
        filled.withColumns(
            {
                "fn": F.col("gt_count") - F.col("tp"),
                "has_samples": has,
                "ap": F.when(has, F.coalesce("ap", F.lit(0.0))),
            }
        )
    ).drop("f1")


def map50(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map50"))


def map_by_threshold(dets: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """mAP at each IoU threshold.

    All thresholds share one order of detections, so their true positives are summed up along one curve. Only a true positive
    can raise a precision; these alone are then looked at threshold by threshold.
    """
    counts = truth_counts(truth)
    hits = match_levels(dets, truth, thresholds)
    rows = cut(dets.select("class_id", "image_id", "det_idx", "confidence").join(hits, ["image_id", "class_id", "det_idx"], "left"))
    marked = rows.join(counts.where("gt_count > 0"), "class_id").selectExpr("*", "-confidence as neg_conf")
    flags = {f"tp_{k}": F.coalesce(F.get("hits", F.lit(k)), F.lit(False)).cast("bigint") for k in range(len(thresholds))}
    curve = running(marked, ["class_id"], curves.ORDER, {**flags, "rank": F.lit(1).cast("bigint")})
    each = [F.struct(F.lit(t).alias("threshold"), F.get("hits", F.lit(k)).alias("hit"), F.col(f"tp_{k}").alias("tp")) for k, t in enumerate(thresholds)]
    points = curve.where("exists(hits, h -> h)").select("class_id", "gt_count", "rank", F.explode(F.filter(F.array(*each), lambda x: x["hit"])).alias("p"))
    key = ["threshold", "class_id"]
    shaped = points.select("p.threshold", "class_id", (F.col("p.tp") / F.col("rank")).alias("precision"), (F.col("p.tp") / F.col("gt_count")).alias("recall"))
    ap = curves.average_precision(shaped, key)
    by_level = counts.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return curves.mean_ap(curves.with_all_classes(ap, by_level, key), ["threshold"])


def map50_95(by_threshold: DataFrame) -> DataFrame:
    return by_threshold.agg(F.avg("map").alias("map50_95"))


# --- events ---------------------------------------------------------------------------------------

EVENT_KEYS = ["video", "type", "sub_type"]
TWO_PART = ("anomaly",)


def _scoped(events: DataFrame) -> DataFrame:
    """Only anomalies are told apart by sub-type."""
    return events.withColumn("sub_type", F.when(F.col("type").isin(*TWO_PART), F.col("sub_type")).otherwise(F.lit("")))


def evaluate_rules(
    pred: DataFrame, truth: DataFrame, tolerance: float, types: Sequence[str] = ("intrusion", "presence", "anomaly")
) -> DataFrame:
    """Scores per video, rule and sub-type. A rule without truth in a video scores nothing there."""
    p = _scoped(pred.where(F.col("type").isin(*types)))
    t = _scoped(truth.where(F.col("type").isin(*types)))
    return _event_scores(p, t, EVENT_KEYS, match_events(p, t, EVENT_KEYS, tolerance), truth, types)


def _event_scores(p, t, keys, matches, truth, types):
    one = {"gt": 0, "pred": 0, "tp": 0}

    def marks(df: DataFrame, which: str) -> DataFrame:
        return df.select(*keys, *[F.lit(int(k == which)).alias(k) for k in one])

    counts = (
        marks(t, "gt")
        .unionByName(marks(p, "pred"))
        .unionByName(marks(matches, "tp"))
        .groupBy(*keys)
        .agg(*[F.sum(k).alias(k) for k in one])
        .where("gt > 0")
        .selectExpr(*keys, "tp", "pred - tp as fp", "gt - tp as fn", "true as has_samples")
    )
    # Rules a video has no truth for.
    listed = F.array(*[F.lit(x) for x in types])
    have = truth.groupBy("video").agg(F.collect_set("type").alias("ts"))
    none = have.select("video", F.explode(F.array_except(listed, F.col("ts"))).alias("type")).selectExpr(
        "video", "type", "'' as sub_type", "0L as tp", "0L as fp", "0L as fn", "false as has_samples"
    )
    return with_prf(counts.unionByName(none))


def unmatched(rows: DataFrame, matches: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """False positives (``idx`` pred_idx) or false negatives (gt_idx)."""
    return rows.join(matches.select(*keys, idx), [*keys, idx], "left_anti")


def event_misses(
    pred: DataFrame, truth: DataFrame, tolerance: float, types: Sequence[str] = ("intrusion", "presence", "anomaly")
) -> DataFrame:
    """Events without a partner: video, type, sub_type, ``kind`` (``fp`` or ``fn``), ``idx`` (pred_idx or gt_idx) and their time ``t``.

    As in the scores, predictions of a rule without truth in a video are no false positives.
    """
    p = _scoped(pred.where(F.col("type").isin(*types)))
    t = _scoped(truth.where(F.col("type").isin(*types)))
    m = cut(match_events(p, t, EVENT_KEYS, tolerance))
    extra = unmatched(p.join(t.select(*EVENT_KEYS).distinct(), EVENT_KEYS, "left_semi"), m, EVENT_KEYS, "pred_idx")
    missed = unmatched(t, m, EVENT_KEYS, "gt_idx")
    at = F.coalesce("t_start", "time_sec")
    return extra.select(*EVENT_KEYS, F.lit("fp").alias("kind"), F.col("pred_idx").alias("idx"), "t").unionByName(
        missed.select(*EVENT_KEYS, F.lit("fn").alias("kind"), F.col("gt_idx").alias("idx"), at.alias("t"))
    )


def evaluate_tripwire(pred: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """Scores per video and wire, with direction accuracy, and per video over its wires ("overall")."""
    keys = ["video", "tripwire_id"]
    named = "type = 'tripwire' and tripwire_id is not null"
    t = truth.where(named)
    p = pred.where(named).join(t.select("video").distinct(), "video", "left_semi")
    m = match_events(p, t, keys, tolerance)
    pd_ = p.select(*keys, "pred_idx", F.coalesce("direction", "sub_type").alias("pd"))
    td = t.select(*keys, "gt_idx", F.col("direction").alias("gd"))
    right = m.join(pd_, [*keys, "pred_idx"]).join(td, [*keys, "gt_idx"]).withColumn("ok", F.col("pd") == F.col("gd"))
    zero = F.lit(0)

    def mark(df: DataFrame, **on) -> DataFrame:
        return df.select(*keys, *[on.get(k, zero).alias(k) for k in ("gt", "pred", "tp", "good")])

    one = F.lit(1)
    rows = (
        mark(t, gt=one)
        .unionByName(mark(p, pred=one))
        .unionByName(mark(right, tp=one, good=F.coalesce(F.col("ok"), F.lit(False)).cast("int")))
    )
    sums = rows.rollup(*keys).agg(*[F.sum(k).alias(k) for k in ("gt", "pred", "tp", "good")]).where("video is not null")
    shaped = sums.selectExpr(
        "video",
        "coalesce(tripwire_id, 'overall') as sub_type",
        "tp",
        "pred - tp as fp",
        "gt - tp as fn",
        "good as direction_correct",
        "if(tp > 0, good / tp, 0D) as direction_accuracy",
    )
    return with_prf(shaped)


def evaluate_counting(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("video", "class_name")) -> DataFrame:
    """Expected against counted crossings: columns total_in, total_out on both sides."""
    e = expected.select(*keys, F.col("total_in").alias("expected_in"), F.col("total_out").alias("expected_out"))
    a = actual.select(*keys, F.col("total_in").alias("actual_in"), F.col("total_out").alias("actual_out"))
    j = e.join(a, list(keys), "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("actual_in", "actual_out")}
    )
    cols = {}
    for side in ("in", "out"):
        gap, rel = count_error(F.col(f"expected_{side}"), F.col(f"actual_{side}"))
        cols[f"abs_error_{side}"], cols[f"rel_error_{side}"] = gap, rel
    return j.withColumns(cols)


def aggregate_metrics(metrics: DataFrame, kind: str = "type") -> DataFrame:
    """Over videos: counts summed, scores recomputed."""
    sums = metrics.groupBy(kind, "sub_type").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.bool_or("has_samples").alias("has_samples")
    )
    return with_prf(sums)


def report_overview(metrics: DataFrame, types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    """One line per rule type: its first metric and whether it was evaluated at all."""
    names = metrics.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in types])).alias("type"))
    first = metrics.groupBy("type").agg(F.min_by(F.struct("precision", "recall", "f1", "has_samples"), "sub_type").alias("m"))
    status = F.when(F.col("m").isNull(), "not evaluated").when(~F.col("m.has_samples"), "no samples").otherwise("evaluated")
    return names.join(first, "type", "left").select(
        "type", status.alias("status"), F.col("m.precision").alias("precision"), F.col("m.recall").alias("recall"), F.col("m.f1").alias("f1")
    )


def detail_items(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = 20) -> DataFrame:
    """First ``limit`` detail rows of each metric (a report shows no more), numbered by ``rank``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def report_json(class_rows: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Report data as one JSON document. Both inputs are aggregates: a row per class, a row per rule."""
    shape = ["class_id", "type", "sub_type", "tp", "fp", "fn"]
    rows = class_rows.unionByName(rule_rows, allowMissingColumns=True).select(*shape)
    kept = rows.agg(
        F.sort_array(F.collect_list(F.when(F.col("type").isNull(), F.struct("class_id", "tp", "fp", "fn")))).alias("classes"),
        F.sort_array(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "sub_type", "tp", "fp", "fn")))).alias("rules"),
    )
    return kept.select(F.to_json(F.struct("classes", "rules")).alias("report"))


def evaluate_all(dets: DataFrame, truth: DataFrame, pred_events: DataFrame, truth_events: DataFrame, tolerance: float) -> DataFrame:
    """Detection scores and rule scores of one evaluation run, as rows (scope, name, value)."""
    images = per_image(dets, truth, match_boxes(dets, truth, 0.5))
    boxes = global_pr(images).selectExpr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (name, value)")
    maps = map_by_threshold(dets, truth).agg(
        F.max(F.when(F.col("threshold") == THRESHOLDS[0], F.col("map"))).alias("map50"), F.avg("map").alias("map50_95")
    )
    maps = maps.selectExpr("stack(2, 'map50', map50, 'map50_95', map50_95) as (name, value)")
    rules = evaluate_rules(pred_events, truth_events, tolerance).select("type", "sub_type", "tp", "fp", "fn", "has_samples")
    wires = evaluate_tripwire(pred_events, truth_events, tolerance).selectExpr(
        "'tripwire' as type", "sub_type", "tp", "fp", "fn", "true as has_samples"
    )
    scores = aggregate_metrics(rules.unionByName(wires)).selectExpr(
        "concat_ws('/', type, nullif(sub_type, '')) as scope", "stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (name, value)"
    )
    return boxes.unionByName(maps).selectExpr("'detection' as scope", "name", "value").unionByName(scores)
