"""The frame timeline: signals, clocks, shots, sampling and checks.

Order-dependent values come from the blocked forms of `skew`: a video is cut into blocks of frame ids, so a video with most
of the rows is spread over many tasks. Frames must be distinct in (video_id, original_frame_id); `distinct` takes repeated rows
out within the exchange of the scan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.operators.skew import previous_in_entity, scan_entity
from kinolith.operators.temporal import stab
from kinolith.session import width

VIDEO, FRAME = ["video_id"], "original_frame_id"


def change_signals(frames: DataFrame, value: str, text: str | None = None, distinct: bool = False) -> DataFrame:
    """Absolute change against the previous frame, 0 for the first; scene change as min(1, motion / 64); with `text`, its change too."""
    asked = {"before_": ("lag", F.col(value))} | ({"text_before_": ("lag", F.col(text))} if text else {})
    f = scan_entity(frames, VIDEO, FRAME, asked, distinct=distinct)
    motion = F.coalesce(F.abs(F.col(value) - F.col("before_")), F.lit(0.0))
    f = f.withColumn("motion", motion).withColumn("scene", F.least(F.lit(1.0), F.col("motion") / 64)).drop("before_")
    return f.withColumn("text_change", F.coalesce(F.abs(F.col(text) - F.col("text_before_")), F.lit(0.0))).drop("text_before_") if text else f


def neighbour_average(frames: DataFrame, value: str, distinct: bool = False) -> DataFrame:
    """Mean of the pair values before and after a frame (those that exist)."""
    g = scan_entity(frames, VIDEO, FRAME, {"a_": ("lag", F.col(value)), "b_": ("lead", F.col(value))}, distinct=distinct)
    before, after = F.abs(F.col(value) - F.col("a_")), F.abs(F.col("b_") - F.col(value))
    mean = F.when(before.isNull(), after).when(after.isNull(), before).otherwise((before + after) / 2)
    return g.withColumn("motion_avg", mean).drop("a_", "b_")


def minmax(df: DataFrame, value: str, partition: list[str], name: str) -> DataFrame:
    """Scaled to 0..1 in its partition; a constant gives 0. The bounds combine before the exchange and join back."""
    bounds = df.groupBy(*partition).agg(F.min(value).alias("low_"), F.max(value).alias("high_"))
    d = df.join(bounds, partition)
    return d.withColumn(name, F.when(F.col("high_") > F.col("low_"), (F.col(value) - F.col("low_")) / (F.col("high_") - F.col("low_"))).otherwise(F.lit(0.0))).drop("low_", "high_")


def clock(frames: DataFrame) -> DataFrame:
    """Time and its source: pts, else the constant-rate clock, else unavailable."""
    source = F.when(F.col("pts_timestamp_ms").isNotNull(), "pts").when(F.col("cfr_timestamp_ms").isNotNull(), "cfr").otherwise("unavailable")
    return frames.withColumn("clock_ms", F.coalesce("pts_timestamp_ms", "cfr_timestamp_ms")).withColumn("clock_source", source)


def tolerant_clock(frames: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """pts, but the constant-rate clock where they differ by more than the tolerance or pts is missing."""
    off = F.abs(F.col("pts_timestamp_ms") - F.col("cfr_timestamp_ms")) > tolerance
    return frames.withColumn("clock_ms", F.when(off, F.col("cfr_timestamp_ms")).otherwise(F.coalesce("pts_timestamp_ms", "cfr_timestamp_ms")))


def pts_origin(frames: DataFrame) -> DataFrame:
    """Raw pts minus constant-rate time at the first frame of a video that has both."""
    both = F.col("raw_pts_timestamp_ms").isNotNull() & F.col("cfr_timestamp_ms").isNotNull()
    return frames.filter(both).groupBy("video_id").agg(F.min_by(F.col("raw_pts_timestamp_ms") - F.col("cfr_timestamp_ms"), "original_frame_id").alias("origin_ms"))


def interpolate(frames: DataFrame, value: str, name: str, distinct: bool = False) -> DataFrame:
    """Missing values on the line between their known neighbours; the ends hold the nearest known value."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(FRAME).alias("i"), F.col(value).alias("v")))
    f = scan_entity(frames, VIDEO, FRAME, {"a_": ("last", known), "b_": ("next", known)}, distinct=distinct)
    line = F.col("a_.v") + (F.col("b_.v") - F.col("a_.v")) * (F.col(FRAME) - F.col("a_.i")) / F.nullif(F.col("b_.i") - F.col("a_.i"), F.lit(0))
    return f.withColumn(name, F.coalesce(F.col(value), line, F.col("a_.v"), F.col("b_.v"))).drop("a_", "b_")


def last_key_frame(frames: DataFrame, distinct: bool = False) -> DataFrame:
    """The codec keyframe at or before each frame."""
    return scan_entity(frames, VIDEO, FRAME, {"key_frame_id": ("last", F.when(F.col("is_codec_keyframe"), F.col(FRAME)))}, distinct=distinct)


def shots(frames: DataFrame, value: str, threshold: float, distinct: bool = False) -> DataFrame:
    """Shots from cut probabilities: each maximal run above the threshold gives one boundary at its middle (s+e+1)//2.

    One scan gives a frame its place and the number of frames above the threshold up to it; their difference is the same
    for all of a run. One combining aggregate makes a row per run (and one per video for the rest), and only these go on."""
    hard = F.coalesce(F.col(value) > threshold, F.lit(False))
    pos = scan_entity(frames.select("video_id", FRAME, value), VIDEO, FRAME, {"i_": ("sum", F.lit(1)), "hard_": ("sum", hard.cast("long"))}, distinct=distinct)
    pos = pos.select("video_id", (F.col("i_") - 1).alias("i_"), F.when(hard, F.col("i_") - F.col("hard_")).alias("run_"))
    runs = pos.groupBy("video_id", "run_").agg(F.min("i_").alias("low_"), F.max("i_").alias("high_"))
    start = F.when(F.col("run_").isNull(), F.lit(0)).otherwise(F.floor((F.col("low_") + F.col("high_") + 1) / 2)).cast("long")
    whole = Window.partitionBy("video_id")
    starts = runs.select("video_id", start.alias("start_frame"), (F.max("high_").over(whole) + 1).alias("n_frames")).filter("start_frame < n_frames")
    # a video of hard frames only has no row for the rest, and a run at its start may give 0 again
    starts = starts.withColumn("low_", F.min("start_frame").over(whole))
    lacks = (F.col("low_") > 0) & (F.col("start_frame") == F.col("low_"))
    starts = starts.withColumn("start_frame", F.explode(F.when(lacks, F.array(F.lit(0).cast("long"), F.col("start_frame"))).otherwise(F.array("start_frame"))))
    starts = starts.select("video_id", "start_frame", "n_frames").dropDuplicates(["video_id", "start_frame"])
    w2 = whole.orderBy("start_frame")
    end = F.coalesce(F.lead("start_frame").over(w2), F.col("n_frames")) - 1
    return starts.withColumn("end_frame", end).withColumn("shot_id", F.row_number().over(w2) - 1).select("video_id", "shot_id", "start_frame", "end_frame")


def merge_short(table: DataFrame, least: int) -> DataFrame:
    """Shots shorter than `least` join the one before; a short first shot joins the second.

    A fold over the sorted shots that holds one open shot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None  # video, number, start, end of the open shot

        for b in batches:
            out = []
            for v, s, e in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != v:
                    if now is not None:
                        out.append(now)
                    now = (v, 0, s, e)
                elif e - s + 1 < least or (now[1] == 0 and now[3] - now[2] + 1 < least):
                    now = (v, now[1], now[2], e)
                else:
                    out.append(now)
                    now = (v, now[1] + 1, s, e)
            if out:
                yield _shot_batch(out)
        if now is not None:
            yield _shot_batch([now])

    rows = table.select("video_id", F.col("start_frame").cast("long"), F.col("end_frame").cast("long")).repartition(width(table.sparkSession), "video_id").sortWithinPartitions("video_id", "start_frame")
    return rows.mapInArrow(run, "video_id string, shot_id int, start_frame long, end_frame long")


def _shot_batch(rows: list[tuple]) -> pa.RecordBatch:
    v, i, s, e = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(i, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["video_id", "shot_id", "start_frame", "end_frame"])


def shot_targets(start: Column, end: Column, short: float = 3.0, medium: float = 4.0, period: float = 1.0) -> Column:
    """Times at which a shot is sampled: middle; 25/50/75 %; or every period from half a period."""
    d = end - start
    n = F.greatest(F.ceil((d - period / 2) / period), F.lit(1)).cast("int")
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + period / 2 + i * period)
    return F.when(d <= 0, F.array(start)).when(d < short, F.array(start + d / 2)).when(d <= medium, F.array(start + d * 0.25, start + d * 0.5, start + d * 0.75)).otherwise(every)


def frames_in_shots(frames: DataFrame, table: DataFrame, block: int = 512) -> DataFrame:
    """Frames with the shot that holds them, bounds included: an equi-join over blocks of frame ids."""
    t = table.withColumn("blk_", F.explode(F.sequence(F.floor(F.col("start_frame") / block), F.floor(F.col("end_frame") / block))))
    f = frames.withColumn("blk_", F.floor(F.col("original_frame_id") / block))
    return f.join(t, ["video_id", "blk_"]).filter(F.col("original_frame_id").between(F.col("start_frame"), F.col("end_frame"))).drop("blk_")


def best_in_radius(targets: DataFrame, frames: DataFrame, radius: int, bounds: tuple[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """For each target frame the best frame within the radius: passing first, then blur, contrast, nearness, lowest id.

    bounds: columns of targets with the first and last frame to look at (the target's shot); keep: further columns of a target."""
    low, high = F.col("original_frame_id") - radius, F.col("original_frame_id") + radius
    if bounds:
        low, high = F.greatest(low, F.col(bounds[0])), F.least(high, F.col(bounds[1]))
    keys = ["video_id", "target_id", *(keep or [])]
    asked = targets.filter(low <= high).select("video_id", F.col("original_frame_id").alias("target_id"), *(keep or []), F.explode(F.sequence(low, high)).alias("original_frame_id"))
    j = asked.join(frames, ["video_id", "original_frame_id"])
    best = F.struct("ok", "blur_score", "contrast_score", (-F.abs(F.col("original_frame_id") - F.col("target_id"))).alias("near"), (-F.col("original_frame_id")).alias("id"))
    return j.groupBy(*keys).agg(F.max_by("original_frame_id", best).alias("chosen_id"))


def weighted_choice(df: DataFrame, group: list[str], weights: dict[str, float]) -> DataFrame:
    """One frame per group by the weighted sum of min-max scaled signals; missing signals' weights are shared out.

    Ties: each signal in the given order, then the lowest frame id. `target` is not scaled."""
    total = sum(weights.values())
    d = df
    for c in weights:
        d = d.withColumn(f"{c}_n", F.coalesce(c, F.lit(0.0))) if c == "target" else minmax(d, c, group, f"{c}_n")
    score = F.round(sum((F.col(f"{c}_n") * (x / total) for c, x in weights.items()), F.lit(0.0)), 9)
    d = d.withColumn("total", score)
    w = Window.partitionBy(*group).orderBy(F.col("total").desc(), *[F.round(f"{c}_n", 9).desc() for c in weights], "original_frame_id")
    return d.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def timeline_violations(frames: DataFrame) -> DataFrame:
    """Rows that break a timeline: an id that is not its position, a time that goes back, a pts that comes twice."""
    twice = frames.filter("pts is not null").groupBy("video_id", "pts").agg(F.count("*").alias("same_")).filter("same_ > 1")
    f = scan_entity(frames, VIDEO, FRAME, {"nth_": ("sum", F.lit(1)), "before_": ("lag", F.col("timestamp_ms")), "first_": ("first", F.col(FRAME))}, ties=["decoded_frame_index"])
    f = f.join(twice, ["video_id", "pts"], "left")
    kinds = F.array_compact(F.array(F.when(F.col("nth_") - 1 + F.col("first_") != F.col(FRAME), "position"), F.when(F.col("timestamp_ms") < F.col("before_"), "time"), F.when(F.col("same_").isNotNull(), "pts")))
    return f.select("video_id", FRAME, F.explode(kinds).alias("violation"))


def shot_violations(table: DataFrame) -> DataFrame:
    """Shots that are not contiguous: wrong number, a gap or overlap against the one before, or an end before the start."""
    w = Window.partitionBy("video_id").orderBy("start_frame")
    t = table.withColumn("want", F.coalesce(F.lag("end_frame").over(w) + 1, F.lit(0))).withColumn("nth", F.row_number().over(w) - 1)
    return t.filter("start_frame <> want or shot_id <> nth or end_frame < start_frame").select("video_id", "shot_id", "start_frame", "want")


def coverage(keyframes: DataFrame, videos: DataFrame, limit_s: float = 10.0) -> DataFrame:
    """Per video the widest gap between kept times (both ends count) and the gaps beyond the limit."""
    edges = videos.select("video_id", F.explode(F.array(F.lit(0.0), F.col("duration_s"))).alias("t"))
    all_ = keyframes.select("video_id", "t").join(videos.select("video_id"), "video_id", "left_semi").unionByName(edges)
    g = previous_in_entity(all_, VIDEO, "t", F.col("t"), "p_", block=3600).withColumn("gap", F.col("t") - F.col("p_"))
    return g.groupBy("video_id").agg(F.round(F.max("gap"), 2).alias("max_gap_s"), F.sum(F.when(F.col("gap") > limit_s, 1).otherwise(0)).alias("n_wide"))


def snap_targets(targets: DataFrame, frames: DataFrame, group: list[str], at: str, target: str, block: int = 65_536) -> DataFrame:
    """The frame nearest in time to each target of its group (a shot), ties to the smaller id; null where the group has no frame.

    Both are put in order of time, and a target looks at the frame before and the one after it."""
    f = frames.filter(F.col(at).isNotNull() & F.col(FRAME).isNotNull()).groupBy(*group, F.col(at).cast("double").alias("t_")).agg(F.min(FRAME).alias("f_")).withColumn("ask_", F.lit(0))
    t = targets.filter(F.col(target).isNotNull()).select(*group, F.col(target).cast("double").alias("t_")).distinct().withColumn("f_", F.lit(None).cast("long")).withColumn("ask_", F.lit(1))
    held = F.when(F.col("ask_") == 0, F.struct("t_", "f_"))
    u = scan_entity(f.unionByName(t), group, "t_", {"a_": ("last", held), "b_": ("next", held)}, block, ["ask_"]).filter("ask_ = 1")
    near = F.least(*[F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(x)["t_"] - F.col("t_")).alias("d"), F.col(x)["f_"].alias("f"))) for x in ("a_", "b_")])
    return u.select(*group, F.col("t_").alias(target), near["f"].alias(FRAME))


def event_scores(windows: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores of the windows that have each frame exactly once; violations: `missing` or `duplicate` frames of the others).

    windows: event_window_id, video_id, start_frame, end_frame (not included); scores: event_window_id, video_id, frame, score."""
    keys = ["event_window_id", "video_id", FRAME]
    want = windows.filter("start_frame < end_frame").select(*keys[:2], F.explode(F.sequence(F.col("start_frame"), F.col("end_frame") - 1)).alias(FRAME))
    have = scores.groupBy(*keys).agg(F.count("*").alias("n_"), F.first("score").alias("score"))
    j = want.join(have, keys, "left")
    bad = j.filter("n_ is null or n_ > 1").select(*keys, F.when(F.col("n_").isNull(), "missing").otherwise("duplicate").alias("violation"))
    return j.select(*keys, "score").join(bad.select(*keys[:2]).distinct(), keys[:2], "left_anti"), bad


def hit_windows(hits: DataFrame, frames: DataFrame, radius_ms: float) -> DataFrame:
    """Each hit with the frames within the radius of its time: start and end frame (not included), start and end time.

    The end is the time of the end frame, or after the last frame of a video the last time plus the last step. Hits of
    unknown frames, or of frames without a time, keep null bounds. hits: video_id, frame and further columns."""
    f = frames.select("video_id", FRAME, F.col("timestamp_ms").cast("double").alias("t_")).filter(F.col("t_").isNotNull() & F.col(FRAME).isNotNull())
    asked = hits.select("video_id", FRAME).distinct().join(f.withColumnRenamed("t_", "hit_"), ["video_id", FRAME])
    span = asked.select("video_id", F.col(FRAME).alias("of_"), F.greatest(F.lit(0.0), F.col("hit_") - radius_ms).alias("low_"), (F.col("hit_") + radius_ms).alias("high_"))
    band = stab(span, f, "video_id", "low_", "high_", "t_", closed=True).select("video_id", "of_", FRAME, "t_")
    band = band.unionByName(asked.filter(F.col("hit_") < 0).select("video_id", F.col(FRAME).alias("of_"), FRAME, F.col("hit_").alias("t_")).join(band.select("video_id", "of_").distinct(), ["video_id", "of_"], "left_anti"))
    ends = band.groupBy("video_id", "of_").agg(F.min(FRAME).alias("start_frame"), (F.max(FRAME) + 1).alias("end_frame"), F.min_by("t_", FRAME).alias("start_ms"), F.max_by("t_", FRAME).alias("inside_"))
    last = F.max(F.struct(FRAME, "t_"))
    tail = f.groupBy("video_id").agg(last.alias("x_"), F.count("*").alias("n_"))
    before = f.join(tail.select("video_id", F.col(f"x_.{FRAME}").alias("last_")), "video_id").filter(F.col(FRAME) < F.col("last_")).groupBy("video_id").agg(last.alias("y_"))
    tail = tail.join(before, "video_id", "left").select("video_id", F.when(F.col("n_") > 1, F.col("x_.t_") + F.greatest(F.col("x_.t_") - F.col("y_.t_"), F.lit(0.0))).alias("after_"))
    at_end = f.select("video_id", F.col(FRAME).alias("end_frame"), F.col("t_").alias("end_"))
    out = ends.join(at_end, ["video_id", "end_frame"], "left").join(tail, "video_id", "left").select("video_id", F.col("of_").alias(FRAME), "start_frame", "end_frame", "start_ms", F.coalesce("end_", "after_", "inside_").alias("end_ms"))
    return hits.join(out, ["video_id", FRAME], "left")


def at_place(asked: DataFrame, frames: DataFrame, place: str) -> DataFrame:
    """Rows with the frame that stands at a place (from 0) of their video's timeline; null outside of it."""
    p = scan_entity(frames.select("video_id", FRAME), VIDEO, FRAME, {"i_": ("sum", F.lit(1))}).select("video_id", (F.col("i_") - 1).alias(place), FRAME)
    return asked.join(p, ["video_id", place], "left")
