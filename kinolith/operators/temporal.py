"""Look-ups and folds in time: stabbing, nearest frames, suppression of near-duplicates.

Sequential folds run per *island*: a stretch of an entity whose neighbours lie within the fold's reach. Events of
different islands cannot meet, so islands fold independently and an entity with most of the rows spreads over them. A fold
streams over a sorted partition; its state is what it kept, never the rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.operators.skew import scan_entity
from kinolith.session import width


def stab(spans: DataFrame, points: DataFrame, entity: str, start: str, end: str, at: str, block: int = 10_000, closed: bool = False) -> DataFrame:
    """Pairs of point and span with start <= t < end (<= if closed), as an equi-join over blocks of time.

    Blocks come in levels, each 16 times as wide as the one below. A span goes to the level on which it covers at most two
    blocks beyond its own, so even one with a corrupt end has at most 17 rows; a point looks into the levels that hold spans,
    and each pair comes out once. Spans without length hold nothing unless closed; null bounds match nothing."""
    width_ = F.col(end) - F.col(start)
    level = F.when(width_ <= block, 0).otherwise(F.ceil(F.log(16.0, width_.cast("double") / block) - 1e-12) - 1).cast("int")
    s = spans.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).withColumn("lvl_", F.greatest(level, F.lit(0)))
    size = lambda: F.lit(float(block)) * F.pow(F.lit(16.0), F.col("lvl_"))
    s = s.withColumn("blk_", F.explode(F.sequence(F.floor(F.col(start) / size()), F.floor(F.col(end) / size()))))
    levels = s.select("lvl_").distinct()  # at most 16 rows
    p = points.filter(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("blk_", F.floor(F.col(at) / size()))
    inside = (F.col(start) <= F.col(at)) & ((F.col(end) >= F.col(at)) if closed else (F.col(end) > F.col(at)))
    return p.join(s, [entity, "lvl_", "blk_"]).filter(inside).drop("blk_", "lvl_")


def nearest_row(left: DataFrame, right: DataFrame, entity: str, left_at: str, right_at: str, ties: list[str], take: list[str], reach: float | None = None, block: int = 65_536) -> DataFrame:
    """Each left row with its nearest right row (within `reach`, if given), ties by the given columns; unmatched rows keep nulls.

    Both sides are put in one order per entity and scanned in blocks: a left row looks at the right row before and the one
    after it, however far. Of right rows with one time the first by the ties counts. A null time matches nothing."""
    r = right.filter(F.col(right_at).isNotNull() & F.col(entity).isNotNull()).groupBy(F.col(entity), F.col(right_at).alias("t_"))
    r = r.agg(F.min(F.struct(*[F.col(c).alias(f"x{i}") for i, c in enumerate(ties)], *[F.col(c).alias(f"y{i}") for i, c in enumerate(take)])).alias("r_"))
    both = left.withColumn("t_", F.col(left_at)).withColumn("ask_", F.lit(1)).unionByName(r.withColumn("ask_", F.lit(0)), allowMissingColumns=True)
    held = F.when(F.col("ask_") == 0, F.struct("t_", "r_"))
    u = scan_entity(both, [entity], "t_", {"a_": ("last", held), "b_": ("next", held)}, block, ["ask_"]).filter("ask_ = 1")
    one = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t_"] - F.col("t_")).alias("d"), F.col(c)["r_"].alias("r")))
    u = u.withColumn("x_", F.least(one("a_"), one("b_")))
    if reach is not None:
        u = u.withColumn("x_", F.when(F.col("x_.d") <= reach, F.col("x_")))
    return u.select(*left.columns, *[F.col(f"x_.r.y{i}").alias(f"near_{c}") for i, c in enumerate(take)], F.col("x_.d").alias("distance"))


def neighbours(frames: DataFrame, targets: DataFrame, entity: str, at: str, centre: str, k: int, key: str, block: int = 65_536) -> DataFrame:
    """The k frames nearest to each target's centre, ties to the smaller id, numbered in time order; frames are distinct.

    Frames get their place in the entity, a target the number of frames up to its centre; the frames at the k places before and
    the k after are looked up, so a target meets 2k frames, whatever the entity's size."""
    f = frames.select(entity, F.col(at).alias("t_"), F.lit(1).alias("n_"))
    t = targets.select(entity, F.col(centre).alias("t_"), F.lit(0).alias("n_"), F.col(key))
    order = f.unionByName(t, allowMissingColumns=True).withColumn("tie_", -F.col("n_"))
    p = scan_entity(order, [entity], "t_", {"i_": ("sum", F.col("n_"))}, block, ["tie_"])
    at_place = p.filter("n_ = 1").select(entity, "i_", F.col("t_").alias(at))
    asks = p.filter("n_ = 0").select(entity, key, F.col("t_").alias(centre), F.explode(F.sequence(F.col("i_") - k + 1, F.col("i_") + k)).alias("i_"))
    j = asks.join(at_place, [entity, "i_"])
    near = j.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.col(at) - F.col(centre)), at))).filter(F.col("n_") <= k)
    return near.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(at))).drop("n_", "i_")


def islands(df: DataFrame, entity: str, at: str, reach: float | Column, block: int = 600_000, distinct: bool = False) -> DataFrame:
    """Adds island_: rows of an entity whose times follow each other within the reach."""
    gap = F.col(at) - F.col("before_")
    d = scan_entity(df, [entity], at, {"before_": ("lag", F.col(at))}, block, distinct=distinct, keep_block=True)
    d = d.withColumn("new_", F.when(gap.isNull() | (gap > reach), 1).otherwise(0)).withColumn("tie_", -F.col("new_"))
    return scan_entity(d, [entity], at, {"island_": ("sum", F.col("new_"))}, block, ["tie_"]).drop("new_", "before_", "tie_")  # of equal times the opening row comes first


def fold(rows: DataFrame, group: list[str], order: list[Column | str], at: str, start: Callable[[], object], keep: Callable[[object, object], bool]) -> DataFrame:
    """Rows of each group that `keep(state, at)` wants, in the order; `start` makes a group's state and `keep` changes it.

    Streams over a partition sorted by group and order: no task holds a group's rows."""
    names = rows.columns
    cols = [names.index(c) for c in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: object = None
        for b in batches:
            take = []
            for i, (t, *g) in enumerate(zip(b.column(names.index(at)).to_pylist(), *(b.column(c).to_pylist() for c in cols))):
                if g != now:
                    now, state = g, start()
                if keep(state, t):
                    take.append(i)
            if take:
                yield b.take(pa.array(take))

    return rows.repartition(width(rows.sparkSession), *group).sortWithinPartitions(*group, *order).mapInArrow(run, rows.schema)


def _apart(window: float) -> Callable[[list, float], bool]:
    """Keeps a time if no kept one lies within the window; the state is the sorted list of kept times."""

    def keep(kept: list, t: float) -> bool:
        i = bisect_left(kept, t)
        if (i < len(kept) and kept[i] - t <= window) or (i and t - kept[i - 1] <= window):
            return False
        insort(kept, t)
        return True

    return keep


def suppress_near(df: DataFrame, entity: str, at: str, score: str, frame: str, start: str, window_ms: int) -> DataFrame:
    """Greedy suppression: in order (score desc, frame with null last, start) a row stays if no kept row lies within the window.

    window_ms <= 0 keeps all. Rows of equal order keys are ranked by their time. The kept times of an island are a sorted list
    of at most its length over the window, so a row costs one binary search."""
    if window_ms <= 0:
        return df
    order = [F.col(score).desc(), F.col(frame).asc_nulls_last(), F.col(start), F.col(at)]
    return fold(islands(df, entity, at, window_ms), [entity, "island_"], order, at, list, _apart(window_ms)).select(*df.columns)


def top_peaks(df: DataFrame, group: list[str], at: str, score: str, minimum: float, distance: int, limit: int) -> DataFrame:
    """Greedy peaks of each group, at most `limit`: in order (score desc, at) a row stays if its score is at least `minimum`
    and no kept row lies nearer than `distance`. A null or NaN score counts as 0; rows with a null `at` are no peaks."""
    s = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0))
    apart = _apart(distance - 1)
    rows = df.filter(F.col(at).isNotNull() & (s >= minimum))
    return fold(rows, group, [s.desc(), F.col(at)], at, list, lambda kept, t: len(kept) < limit and apart(kept, t))


def spaced_boundaries(df: DataFrame, entity: str, at: str, least: int, distinct: bool = False) -> DataFrame:
    """Fold over a sorted sequence: a row stays if it lies at least `least` after the last one that stayed."""

    def keep(last: list, t: int) -> bool:
        if last and t - last[0] < least:
            return False
        last[:] = [t]
        return True

    return fold(islands(df.select(entity, at), entity, at, least - 1, distinct=distinct), [entity, "island_"], [F.col(at)], at, list, keep).select(entity, at)


def merge_windows(hits: DataFrame, entity: str, start: str, end: str, gap: int, score: str, peak: str, block: int = 600_000) -> DataFrame:
    """Windows merged while start <= running end + gap: bounds, members, best score and its first frame."""
    order = [end, peak, score]
    m = scan_entity(hits, [entity], start, {"reach_": ("before", F.col(end))}, block, order, keep_block=True)
    m = m.withColumn("new_", F.when(F.col("reach_").isNull() | (F.col(start) > F.col("reach_") + gap), 1).otherwise(0))
    m = scan_entity(m, [entity], start, {"grp_": ("sum", F.col("new_"))}, block, order)
    best = F.struct(F.coalesce(score, F.lit(float("-inf"))).alias("s"), (-F.col(start)).alias("a"), (-F.col(peak)).alias("p"))
    out = m.groupBy(entity, "grp_").agg(F.min(start).alias("start_ms"), F.max(end).alias("end_ms"), F.count("*").alias("n_members"), F.max(score).alias("score"), F.max_by(peak, best).alias("peak_frame"))
    return out.drop("grp_")


def cap_windows(windows: DataFrame, entity: str, most: int, prefix: str = "") -> DataFrame:
    """The best `most` windows of an entity by (score desc with null last, start), numbered in time from 0."""
    w = Window.partitionBy(entity).orderBy(F.col("score").desc_nulls_last(), "start_ms")
    kept = windows.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= most).drop("n_")
    ordinal = F.row_number().over(Window.partitionBy(entity).orderBy("start_ms")) - 1
    return kept.withColumn("ordinal", ordinal).withColumn("window_id", F.format_string(f"{prefix}%s_event_%04d", F.col(entity), F.col("ordinal")))
