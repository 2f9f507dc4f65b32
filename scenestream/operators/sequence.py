"""Ordered-sequence operators that never need one key, or one camera, in one task.

Rows are clustered by (key, slice), a slice being a fixed stretch of time. Windows run inside a slice;
what a slice needs from earlier ones travels through a small table with one row per (key, slice).
Every key may therefore be as long as the data without a task growing beyond a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut
from ..session import slice_ms as session_slice_ms

SLICE = "slice"


def with_slice(df: DataFrame, ms: str = "frame_ms", width: int | None = None) -> DataFrame:
    width = width or session_slice_ms(df.sparkSession)
    return df.withColumn(SLICE, F.floor(F.col(ms) / F.lit(width)))


def pieces(keys: Sequence[str]) -> list[str]:
    """Partitioning columns for work per key."""
    return [*keys, SLICE]


FRAME = ["camera_id", SLICE, "frame_seq"]
# Order of rows along a key: by time, since a camera's frame counter may start again.
ORDER = ["frame_ms", "frame_seq", "det_idx"]


# --- frames ---------------------------------------------------------------------------------------


# A detection's clock and that of its frame differ by at most this. A detection without a frame of its number so near has none.
FRAME_SLACK_MS = 2_000


# Frames of a task, on average, whose detections are looked at in one go.
FRAMES_PER_TASK = 40_000


def shares(frames: DataFrame) -> list[int]:
    """Number of tasks for work by camera and slice, where the session's own number would make them grow with the log; else empty."""
    n = -(-frames.count() // FRAMES_PER_TASK)
    return [n] if n > int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def processed_frames(frames: DataFrame) -> DataFrame:
    """Frames the rules see (those with motion), each with its slice and the frame seen before it on its camera.

    Adds ``prev_seq`` (NULL for a camera's first frame).
    """
    f = with_slice(frames.where("has_motion").select("camera_id", "frame_seq", "frame_ms")).repartition("camera_id", SLICE)
    return _with_previous(f)


def _with_previous(f: DataFrame) -> DataFrame:
    lag = f"lag(frame_seq) over (partition by camera_id, {SLICE} order by frame_ms, frame_seq) as prev_seq"
    last = f.groupBy("camera_id", SLICE).agg(F.max_by("frame_seq", F.struct("frame_ms", "frame_seq")).alias("last_seq"))
    before = last.selectExpr("camera_id", SLICE, f"lag(last_seq) over (partition by camera_id order by {SLICE}) as before_seq")
    return (
        f.selectExpr("*", lag)
        .join(before, ["camera_id", SLICE], "left")
        .withColumn("prev_seq", F.coalesce("prev_seq", "before_seq"))
        .drop("before_seq")
    )


def framed(frames: DataFrame, tasks: Sequence[int] = ()) -> DataFrame:
    """Processed frames (see ``processed_frames``) with the span of detection times that are theirs: from ``lo`` until before ``hi``.

    A camera's counter may start again, so several frames have one number. A detection belongs to the nearest of
    them, frames without motion included, and to none beyond the clock slack. Frames near the border of a slice are shown to
    the next slice for that; a detection is then looked up in the slice of its frame.
    """
    width, reach = session_slice_ms(frames.sparkSession), 2 * FRAME_SLACK_MS
    ms = F.col("frame_ms")
    span = F.sequence(F.floor((ms - reach) / F.lit(width)), F.floor((ms + reach) / F.lit(width)))
    shown = frames.select("camera_id", "frame_seq", "frame_ms", "has_motion", F.explode(span).alias(SLICE)).repartition(*tasks, "camera_id", SLICE)
    same = f"over (partition by camera_id, {SLICE}, frame_seq order by frame_ms)"
    edges = shown.selectExpr("*", f"lag(frame_ms) {same} as _was", f"lead(frame_ms) {same} as _next").where(
        f"has_motion and floor(frame_ms / {width}) = {SLICE}"
    )
    near = _with_previous(edges.drop("has_motion"))
    # Halfway between two frames the later one has the detection.
    return near.selectExpr(
        "camera_id", SLICE, "frame_seq", "frame_ms", "prev_seq",
        f"greatest(frame_ms - {FRAME_SLACK_MS}, coalesce((_was + frame_ms + 1) div 2, frame_ms - {FRAME_SLACK_MS})) as _lo",
        f"least(frame_ms + {FRAME_SLACK_MS} + 1, coalesce((frame_ms + _next + 1) div 2, frame_ms + {FRAME_SLACK_MS} + 1)) as _hi",
    )


def observe(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections on processed frames, with the time of their frame and its ``prev_seq``.

    The frame decides on time and slice: a detection whose own clock is a little off stays with its frame (see ``framed``). All that
    follows, per frame, per track and slice, is clustered by (camera_id, slice) once, here. A detection near the border of
    a slice goes to both and finds its frame in one; a detection without a time has no frame. A long log is cut into more tasks, not
    into larger ones.
    """
    cols, tasks = detections.columns, shares(frames)
    width, ms = session_slice_ms(detections.sparkSession), F.col("frame_ms")
    homes = F.sequence(*[F.floor((ms + d) / F.lit(width)) for d in (-FRAME_SLACK_MS, FRAME_SLACK_MS)])
    sent = detections.withColumn(SLICE, F.explode(homes)).withColumnRenamed("frame_ms", "_own_ms").repartition(*tasks, "camera_id", SLICE)
    seen = framed(frames, tasks)
    return sent.join(seen, ["camera_id", SLICE, "frame_seq"]).where("_own_ms >= _lo and _own_ms < _hi").select(*cols, "prev_seq", SLICE)


# --- numbering ------------------------------------------------------------------------------------


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    how: str = "sum",
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running sum or max over each group in the given order (no two rows alike), optionally from the end.

    Rows are cut into ranges of (group, order), so neither a large group nor one value shared by most rows meets
    in a single task. Only a range is sorted; what precedes it in its group comes from the totals of ranges.
    The ranges are written once, since their numbers must not change between the two uses.
    """
    group = list(group)
    fn = {"sum": F.sum, "max": F.max}[how]
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    ranged = cut(df.repartitionByRange(*group, *sort).withColumn("_piece", F.spark_partition_id()))
    part, end = [*group, "_piece"], -1 if exclusive else 0
    inside = Window.partitionBy(*part).orderBy(*sort).rowsBetween(Window.unboundedPreceding, end)
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*part).agg(*[fn(v).alias(f"_t_{n}") for n, v in values.items()])
    before = totals.select(*part, *[fn(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in values])
    merge = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if how == "sum" else F.greatest
    return (
        ranged.withColumns({f"_i_{n}": fn(v).over(inside) for n, v in values.items()})
        .join(before, part)
        .withColumns({n: merge(F.col(f"_i_{n}"), F.col(f"_o_{n}")) for n in values})
        .drop("_piece", *[f"_i_{n}" for n in values], *[f"_o_{n}" for n in values])
    )


# --- neighbours in time ---------------------------------------------------------------------------

Link = Callable[[Column, Column], Column]


def same_spell(prev: Column, cur: Column) -> Column:
    """The key was also seen in the previous processed frame of its camera."""
    return prev["frame_seq"] == cur["prev_seq"]


def gap_at_most(ms: int, time: str = "frame_ms") -> Link:
    return lambda prev, cur: cur[time] - prev[time] <= ms


def link_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    link: Link | None = None,
    time: str = "frame_ms",
    memo: Column | None = None,
) -> DataFrame:
    """Attach to each row the row before it in its key.

    Adds ``prev`` (struct of ``carry``; NULL on a key's first row). With ``link`` it also adds
    ``linked`` (link holds between the previous row and this one) and ``spell_ms`` (time of the first
    row of the unbroken chain this row belongs to). With ``memo`` (an expression that may be NULL) it
    adds ``memo``: its last non-NULL value on an earlier row of the same chain.
    """
    keys, order = list(keys), list(order)
    row = F.struct(*[F.col(c) for c in carry])
    part = [*keys, SLICE]
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumn("_prev", F.lag(row).over(w)).withColumn("_head", F.col("_prev").isNull())
    if link is not None:
        # No row is linked to nothing, whatever ``link`` says.
        inner = inner.withColumn("_broken", F.col("_head") | ~F.coalesce(link(F.col("_prev"), row), F.lit(False)))
        # The first row of a slice starts a chain for now; the small table below may extend it backwards.
        start = F.when(F.col("_broken"), F.struct(F.col(time).alias("ms"), F.col("_head").alias("head")))
        inner = inner.withColumn("_start", F.last(start, True).over(upto))
    if memo is not None:
        nothing = F.when(F.lit(False), memo)
        # A break forgets the memo; at the head of a slice it is not yet known whether there was one.
        marked = F.when(memo.isNotNull(), F.struct(memo.alias("v"), F.lit(True).alias("set"))).when(
            F.col("_broken"), F.struct(nothing.alias("v"), (~F.col("_head")).alias("set"))
        )
        inner = inner.withColumn("_mark", marked)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        inner = inner.withColumn("_memo", F.when(~F.col("_broken"), F.last("_mark", True).over(before)))

    at = F.struct(*[F.col(c) for c in order])
    aggs = [F.max_by(row, at).alias("_last"), F.min_by(row, at).alias("_first")]
    if link is not None:
        aggs.append(F.max_by("_start", at).alias("_last_start"))
    if memo is not None:
        aggs.append(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), at)).alias("_last_mark"))
    by_key = Window.partitionBy(*keys).orderBy(SLICE)
    edge = inner.groupBy(*part).agg(*aggs).withColumn("_before", F.lag("_last").over(by_key))
    out = ["_before"]
    if link is not None:
        earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.withColumn("_joined", F.col("_before").isNotNull() & F.coalesce(link(F.col("_before"), F.col("_first")), F.lit(False)))
        # A slice that is one chain and continues the slice before it has no start of its own.
        own = F.when(~(F.col("_last_start.head") & F.col("_joined")), F.col("_last_start.ms"))
        edge = edge.withColumn("_from", F.last(own, True).over(earlier))
        out += ["_joined", "_from"]
        if memo is not None:
            through = F.col("_last_start.head") & F.col("_joined")
            state = F.when(F.coalesce(F.col("_last_mark.set"), F.lit(False)), F.struct(F.col("_last_mark.v").alias("v"))).when(
                ~through, F.struct(F.when(F.lit(False), F.col("_last_mark.v")).alias("v"))
            )
            edge = edge.withColumn("_memo_from", F.last(state, True).over(earlier)["v"])
            out.append("_memo_from")
    carried = edge.where("_before is not null").select(*part, *out)

    res = inner.join(carried, part, "left").withColumn("prev", F.coalesce("_prev", "_before"))
    drop = ["_prev", "_before", "_head"]
    if link is not None:
        in_first_chain = F.col("_start.head") & F.coalesce(F.col("_joined"), F.lit(False))
        if memo is not None:
            known = F.coalesce(F.col("_memo.set"), F.lit(False))
            res = res.withColumn(
                "memo", F.when(known, F.col("_memo.v")).when(in_first_chain, F.col("_memo_from"))
            )
            drop += ["_memo", "_mark", "_memo_from"]
        res = res.withColumns(
            {
                "linked": F.when(F.col("_head"), F.coalesce(F.col("_joined"), F.lit(False))).otherwise(~F.col("_broken")),
                "spell_ms": F.when(in_first_chain, F.col("_from")).otherwise(F.col("_start.ms")),
            }
        )
        drop += ["_broken", "_start", "_joined", "_from"]
    return res.drop(*drop)


# --- confirmation ---------------------------------------------------------------------------------


def seamed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], depth: int, fn: Callable[[DataFrame, WindowSpec], DataFrame]
) -> DataFrame:
    """Apply a window function that looks back at most ``depth`` rows per key.

    Inside a slice the window is complete except for its first ``depth`` rows. Those are recomputed
    over the rows next to the seams only, in true key order.
    """
    keys, order = list(keys), list(order)
    part = [*keys, SLICE]
    w = Window.partitionBy(*part).orderBy(*order)
    whole = Window.partitionBy(*part)
    n = df.withColumn("_rn", F.row_number().over(w)).withColumn("_left", F.count(F.lit(1)).over(whole) - F.col("_rn"))
    main = fn(n, w).where(F.col("_rn") > depth)
    near = n.where((F.col("_rn") <= depth) | (F.col("_left") < depth))
    edge = fn(near, Window.partitionBy(*keys).orderBy(*order)).where(F.col("_rn") <= depth)
    return main.unionByName(edge).drop("_rn", "_left")


def run_length(cond: Column, win: WindowSpec) -> Column:
    """Number of rows up to this one on which ``cond`` has held without a break."""
    at = F.row_number().over(win)
    broken = F.max(F.when(~cond, F.col("_at"))).over(win.rowsBetween(Window.unboundedPreceding, 0))
    return at - F.coalesce(broken, F.lit(0))


def confirmed(obs: DataFrame, keys: Sequence[str], order: Sequence[str], cond: str, n: int | Column, longest: int | None = None) -> DataFrame:
    """Rows at which ``cond`` has held on the last ``n`` observations of the key in a row.

    ``n`` may be a column, the same on all rows of a key and ``longest`` at most.
    """
    if isinstance(n, Column):
        return _confirmed_by(obs, list(keys), list(order), cond, n, longest)
    if n <= 1:
        return obs.where(F.col(cond))
    keys, order = list(keys), list(order)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    # A false observation matters only directly after a true one (it ends a run).
    thin = obs.withColumn("_after", F.lag(cond).over(w)).where(F.col(cond) | F.coalesce("_after", F.lit(True)))
    thin = thin.drop("_after").repartition(*keys, SLICE)

    def runs(df: DataFrame, win: WindowSpec) -> DataFrame:
        held = F.count_if(F.col(cond)).over(win.rowsBetween(-(n - 1), 0))
        return df.withColumn("_held", held).where(F.col("_held") == n).drop("_held")

    return seamed(thin, keys, order, n - 1, runs)


def _confirmed_by(obs: DataFrame, keys: list[str], order: list[str], cond: str, n: Column, longest: int | None) -> DataFrame:
    def runs(df: DataFrame, win: WindowSpec) -> DataFrame:
        counted = df.withColumn("_at", F.row_number().over(win))
        return counted.withColumn("_run", run_length(F.col(cond), win)).where(F.col(cond) & (F.col("_run") >= n)).drop("_run", "_at")

    # Beyond ``longest`` rows back nothing matters, and a run that seems longer across a gap in the rows near a seam is long enough.
    return seamed(obs.repartition(*keys, SLICE), keys, order, max(1, (longest or 1) - 1), runs)


def confirmed_unbroken(
    hits: DataFrame, keys: Sequence[str], n: int | Column, frame: str = "frame_seq", prev: str = "prev_seq", longest: int | None = None
) -> DataFrame:
    """Rows at which the key has been a hit in ``n`` consecutive processed frames.

    ``hits`` holds hit rows only; a frame without a hit row of the key breaks the run. ``n`` may be a column as in ``confirmed``.
    """
    if isinstance(n, Column):
        return _unbroken_by(hits, list(keys), n, frame, prev, longest)
    if n <= 1:
        return hits
    keys = list(keys)
    pinned = hits.repartition(*keys, SLICE)

    def runs(df: DataFrame, win: WindowSpec) -> DataFrame:
        joined = df.withColumn("_link", F.lag(frame).over(win) == F.col(prev))
        links = F.count_if(F.col("_link")).over(win.rowsBetween(-(n - 2), 0))
        return joined.withColumn("_links", links).where(F.col("_links") == n - 1).drop("_link", "_links")

    return seamed(pinned, keys, ["frame_ms", frame], n - 1, runs)


def _unbroken_by(hits: DataFrame, keys: list[str], n: Column, frame: str, prev: str, longest: int | None) -> DataFrame:
    def runs(df: DataFrame, win: WindowSpec) -> DataFrame:
        linked = F.coalesce(F.lag(frame).over(win) == F.col(prev), F.lit(False))
        counted = df.withColumns({"_at": F.row_number().over(win), "_link": linked})
        # A row without a link starts a run of one.
        return counted.withColumn("_run", run_length(F.col("_link"), win) + 1).where(F.col("_run") >= n).drop("_run", "_at", "_link")

    return seamed(hits.repartition(*keys, SLICE), keys, ["frame_ms", frame], max(1, (longest or 1) - 1), runs)


# --- cooldown -------------------------------------------------------------------------------------

# Slices of one key that are followed in one go.
STRETCH = 256


def cooldown(
    candidates: DataFrame,
    keys: Sequence[str],
    wait_ms: int | Column,
    time: str = "frame_ms",
    order: Sequence[str] = (),
    slice_width: int | None = None,
) -> DataFrame:
    """Greedy spacing: keep a candidate when at least ``wait_ms`` passed since the last kept one of its key.

    The wait may be a column, the same on all rows of a key; without a wait every candidate stays.

    A slice's candidates form one sorted array. Each knows the position of the first candidate it no
    longer blocks, so keeping is a walk of at most slice/wait steps. Where a slice can be affected by
    the one before, it publishes which last firing follows from each possible entry; chaining these
    short tables gives every slice its starting state. Candidates themselves are never gathered per key. The arrays are
    written once, since they are read twice.
    """
    if not isinstance(wait_ms, Column) and wait_ms <= 0:
        return candidates
    keys = list(keys)
    part = [*keys, SLICE]
    width = slice_width or session_slice_ms(candidates.sparkSession)
    cols = candidates.columns
    c = candidates if SLICE in cols and slice_width is None else with_slice(candidates, time, width)
    payload = [x for x in cols if x not in part]
    key_sql = ", ".join(part)
    wait = wait_ms.cast("bigint") if isinstance(wait_ms, Column) else F.lit(wait_ms).cast("bigint")
    # Time in waits since the slice began: a range frame has one length for all rows. Just under one wait, by less than a
    # millisecond is of any wait.
    waits = f"double({time} - {SLICE} * {width}L) / greatest(_w, 1L)"
    by_waits = f"partition by {key_sql} order by _u"
    c = c.withColumn("_w", wait).repartition(*part).selectExpr("*", f"{waits} as _u").selectExpr(
        "*",
        f"row_number() over (partition by {key_sql} order by {', '.join([time, *order])}) as _i",
        f"rank() over ({by_waits}) + count(1) over ({by_waits} range between current row and 0.999999999D following) as _nx",
    )
    row = ", ".join(f"'{x}', {x}" for x in payload)
    item = f"named_struct('i', _i, 'nx', int(if(_w > 0, _nx, _i + 1)), 't', {time}, 'row', named_struct({row}))"
    piece = cut(c.groupBy(*part).agg(F.expr(f"sort_array(collect_list({item}))").alias("c"), F.max("_w").alias("w")))

    # Position of the next candidate that a firing at i does not block; NULL past the end.
    budget = f"sequence(1, if(w > 0, int(least({width} div greatest(w, 1L) + 2, size(c))), size(c)))"
    hop = "if(element_at(c, {i}).nx <= size(c), element_at(c, {i}).nx, null)"
    last_fire = f"element_at(c, aggregate({budget}, int(x.i), (s, k) -> coalesce({hop.format(i='s')}, s))).t"
    # Only a slice's first candidates can be the first to fire in it: those an earlier firing may still block,
    # and the one after them.
    entries = f"slice(c, 1, size(filter(c, x -> x.t < {SLICE} * {width}L + w)) + 1)"
    by_key = f"partition by {', '.join(keys)} order by {SLICE}"
    table = (
        piece.selectExpr(
            *part,
            "w",
            "c[0].t as first_t",
            "element_at(c, -1).t as last_t",
            f"transform({entries}, x -> named_struct('t', x.t, 'last', {last_fire})) as map",
        )
        .selectExpr("*", f"coalesce(first_t - lag(last_t) over ({by_key}) < w, false) as tied")
        .selectExpr("*", f"sum(int(not tied)) over ({by_key}) as chain")
    )
    chains = (
        table.groupBy(*keys, "chain")
        .agg(F.expr(f"sort_array(collect_list(named_struct('{SLICE}', {SLICE}, 'map', map)))").alias("m"), F.max("w").alias("w"))
        .where("size(m) > 1")
    )
    # The chain is followed in stretches, so that no growing array is copied for every slice.
    steps = f"cast(array() as array<struct<{SLICE}:bigint,s:bigint>>)"
    stretch = (
        f"aggregate(q, named_struct('s', a.s, 'out', {steps}), (b, p) -> named_struct("
        f"'s', coalesce(get(filter(p.map, e -> b.s is null or e.t >= b.s + w), 0).last, b.s), "
        f"'out', array_append(b.out, named_struct('{SLICE}', p.{SLICE}, 's', b.s))))"
    )
    follow = (
        f"flatten(aggregate(transform(sequence(0, (size(m) - 1) div {STRETCH}), j -> slice(m, j * {STRETCH} + 1, {STRETCH})), "
        f"named_struct('s', cast(null as bigint), 'out', cast(array() as array<array<struct<{SLICE}:bigint,s:bigint>>>)), "
        f"(a, q) -> aggregate(array({stretch}), a, (c, x) -> named_struct('s', x.s, 'out', array_append(c.out, x.out)))).out)"
    )
    states = (
        chains.selectExpr(*keys, f"explode({follow}) as o")
        .selectExpr(*keys, f"o.{SLICE} as {SLICE}", "o.s as state")
        .where("state is not null")
    )
    first = "int(get(filter(c, x -> state is null or x.t >= state + w), 0).i)"
    walk = (
        f"aggregate({budget}, named_struct('at', {first}, 'out', cast(array() as array<int>)), (a, k) -> "
        f"if(a.at is null, a, named_struct('at', {hop.format(i='a.at')}, 'out', array_append(a.out, a.at)))).out"
    )
    kept = piece.join(states, part, "left").selectExpr(*part, f"explode(transform({walk}, i -> element_at(c, i).row)) as r")
    return kept.selectExpr(*[x if x in part else f"r.{x} as {x}" for x in cols])
