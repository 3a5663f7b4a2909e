"""Checks and normal forms of records: what a row must satisfy, as violations rather than exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.functions import num
from kinolith.operators.skew import scan_entity


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule of each row that breaks a rule; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def interval_rules(start: str, end: str) -> dict[str, Column]:
    """Half-open intervals: not negative and not empty."""
    return {"start": F.col(start) >= 0, "interval": F.col(end) > F.col(start)}


def strictly_rising(values: str | Column) -> Column:
    """Whether an array has 1 to 20 strictly rising elements and no null (frames of an answer); a null array is none."""
    v = F.col(values) if isinstance(values, str) else values
    ok = F.forall(F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: a < b), lambda x: x)
    return F.coalesce(F.size(v).between(1, 20) & ~F.exists(v, lambda x: x.isNull()) & ok, F.lit(False))


def evidence_lines(df: DataFrame, by: list[str], order: list[str], kind: str, key: str, snippet: str, rows: int = 20, chars: int = 500, total: int = 8_000) -> DataFrame:
    """by, key, line, nth: the evidence that goes into a prompt, as lines `[kind][key] snippet`.

    Of the first `rows` of a group those with a text, each cut to `chars`, until the next line would bring the prompt beyond `total`."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("i_", F.row_number().over(w)).filter(F.col("i_") <= rows)
    x = x.withColumn("s_", F.substring(F.trim(snippet), 1, chars)).filter(F.length("s_") > 0)
    x = x.withColumn("line", F.concat(F.lit("["), F.coalesce(kind, F.lit("")), F.lit("]["), F.coalesce(key, F.lit("")), F.lit("] "), "s_"))
    held = F.sum(F.length("line") + 1).over(Window.partitionBy(*by).orderBy("i_"))  # a line and its break
    return x.withColumn("held_", held).filter(F.col("held_") - F.when(F.col("held_") == F.length("line") + 1, 0).otherwise(1) <= total).select(*by, key, "line", F.row_number().over(Window.partitionBy(*by).orderBy("i_")).alias("nth"))


def ocr_records(df: DataFrame, group: list[str], order: str, text: str, score: str) -> DataFrame:
    """One record per group: its texts (single blanks, empty ones left out) in order as one, the mean of their scores within 0 and 1, and their number."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0))))
    x = df.select(*group, order, t.alias("t_"), c.alias("c_")).filter("t_ <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "t_"))), lambda s: s["t_"]), " ")
    return x.groupBy(*group).agg(joined.alias("text"), F.avg("c_").alias("confidence"), F.count("*").alias("n_boxes"))


def merged_lists(a: Column, b: Column, kind: str, key: str) -> Column:
    """Items of two arrays of structs: those of `a`, and of the kinds `a` has none of those of `b`; the first of each (kind, key) counts."""
    kinds = F.transform(F.coalesce(a, F.filter(b, lambda x: F.lit(False))), lambda x: x[kind])
    both = F.concat(F.coalesce(a, F.filter(b, lambda x: F.lit(False))), F.filter(F.coalesce(b, F.filter(a, lambda x: F.lit(False))), lambda x: ~F.array_contains(kinds, x[kind])))
    keys = F.transform(both, lambda x: F.concat_ws("\x1f", x[kind], x[key]))
    return F.filter(both, lambda x, i: F.array_position(keys, F.concat_ws("\x1f", x[kind], x[key])) == i + 1)


def ordinals_complete(df: DataFrame, group: list[str], ordinal: str) -> DataFrame:
    """Groups whose ordinals are not 1..n without repeats."""
    g = df.groupBy(*group).agg(F.count("*").alias("n"), F.countDistinct(ordinal).alias("n_distinct"), F.min(ordinal).alias("low"), F.max(ordinal).alias("high"))
    return g.filter("low <> 1 or high <> n or n_distinct <> n").select(*group, "n", "low", "high")


def order_respected(df: DataFrame, group: list[str], ordinal: str, value: str) -> DataFrame:
    """Rows whose value does not rise with the ordinal."""
    w = Window.partitionBy(*group).orderBy(ordinal)
    return df.withColumn("before_", F.lag(value).over(w)).filter(F.col(value) <= F.col("before_")).drop("before_")


def normal_manifest(df: DataFrame) -> DataFrame:
    """Video manifest with exact rate, seconds and frame counts derived where they are missing."""
    rate = num.fps_fraction("fps_str")
    d = df.withColumn("rate_", F.coalesce(rate, F.when(F.col("fps") > 0, F.struct(F.round(F.col("fps") * 1000).cast("long").alias("num"), F.lit(1000).cast("long").alias("den")))))
    frames = F.coalesce(F.col("frame_count").cast("long"), F.bround(F.col("duration_ms") * F.col("rate_.num") / (F.col("rate_.den") * 1000.0)).cast("long"))
    return d.withColumn("fps_num", F.col("rate_.num")).withColumn("fps_den", F.col("rate_.den")).withColumn("duration_s", F.col("duration_ms") / 1000.0).withColumn("n_frames", frames).drop("rate_")


def clamp_shots(shots: DataFrame, timelines: DataFrame) -> DataFrame:
    """Shots cut to their video's frames; what lies outside goes. timelines: video_id, first_id, last_id."""
    j = shots.join(timelines, "video_id")
    j = j.withColumn("start_frame", F.greatest("start_frame", "first_id")).withColumn("end_frame", F.least("end_frame", "last_id"))
    return j.filter("start_frame <= end_frame").drop("first_id", "last_id")


def window_around(df: DataFrame, group: list[str], order: str, anchor: str, size: int) -> DataFrame:
    """At most `size` rows of a group around the row nearest to the anchor column, moved inwards at the ends. `order` is a number.

    Places come from a scan in blocks, the nearest place and the size of a group from a combining aggregate that joins back."""
    n = scan_entity(df, group, order, {"i_": ("sum", F.lit(1))})
    near = n.groupBy(*group).agg(F.max("i_").alias("n_"), F.min_by("i_", F.struct(F.abs(F.col(order) - F.col(anchor)), F.col(order))).alias("at_"))
    n = n.join(near, group).withColumn("from_", F.greatest(F.lit(1), F.least(F.col("at_") - F.lit(size // 2), F.col("n_") - size + 1)))
    return n.filter((F.col("i_") >= F.col("from_")) & (F.col("i_") < F.col("from_") + size)).drop("i_", "n_", "from_", "at_")


def reading_order(boxes: str | Column) -> Column:
    """Polygons (arrays of [x, y]) with at least three corners, top to bottom, then left to right."""
    p = F.col(boxes) if isinstance(boxes, str) else boxes
    ok = F.filter(p, lambda q: F.size(q) >= 3)
    keyed = F.transform(ok, lambda q: F.struct(F.array_min(F.transform(q, lambda c: c[1])).alias("y"), F.array_min(F.transform(q, lambda c: c[0])).alias("x"), q.alias("q")))
    return F.transform(F.array_sort(keyed), lambda s: s["q"])


def normal_source_map(df: DataFrame, names: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a map from keyframes to source frames: columns found under any of their names, cast to numbers.

    names: column -> names it may have; the first that exists is taken. A row with a null number is a violation."""
    of = {c: next((F.col(x) for x in options if x in df.columns), F.lit(None)) for c, options in names.items()}
    d = df.select(*[(v.cast("string") if c == "video_id" else v.cast("string").try_cast("long")).alias(c) for c, v in of.items()])
    bad = F.lit(False)
    for c in names:
        bad = bad | F.col(c).isNull()
    return d.filter(~bad), d.filter(bad)


def dense_candidates(df: DataFrame, key: list[str], quality: list[str], evidence: list[str]) -> DataFrame:
    """Candidates with their signals as structs."""
    return df.select(*key, F.struct(*quality).alias("quality_scores"), F.struct(*evidence).alias("evidence"))


def match_by_clock(decoded: DataFrame, manifest: DataFrame, entity: str, pts: str, order: str) -> DataFrame:
    """Decoded rows with their manifest row: by a pts that is unique on both sides, else by place in decode order.

    Result: entity, decoded_at and manifest_at (the order columns) and how (pts or order)."""
    unique = lambda x: x.filter(F.col(pts).isNotNull()).groupBy(entity, pts).agg(F.count("*").alias("n_"), F.min(order).alias("o_")).filter("n_ = 1").drop("n_")
    a = unique(decoded).withColumnRenamed("o_", "decoded_at")
    b = unique(manifest).withColumnRenamed("o_", "manifest_at")
    by_pts = a.join(b, [entity, pts]).select(entity, "decoded_at", "manifest_at", F.lit("pts").alias("how"))
    open_a = decoded.select(entity, F.col(order).alias("decoded_at")).join(by_pts.select(entity, "decoded_at"), [entity, "decoded_at"], "left_anti")
    open_b = manifest.select(entity, F.col(order).alias("manifest_at")).join(by_pts.select(entity, "manifest_at"), [entity, "manifest_at"], "left_anti")
    place = lambda x, c: x.withColumn("i_", F.row_number().over(Window.partitionBy(entity).orderBy(c)))
    by_order = place(open_a, "decoded_at").join(place(open_b, "manifest_at"), [entity, "i_"]).select(entity, "decoded_at", "manifest_at", F.lit("order").alias("how"))
    return by_pts.unionByName(by_order)


def result_rows(df: DataFrame, display: int) -> DataFrame:
    """Ranked candidates as results: at most `display`, start not below 0, end after it, a preview (own, the video's, or none), and the
    frame they stand for. Columns used: rank, video_id, original_frame_id, start_ms, end_ms, preview_uri, object_key, and timestamp_ms and keyframe_no if there."""
    have = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    x = df.filter(F.col("rank") <= display).withColumn("start_ms", F.greatest(F.coalesce(have("timestamp_ms", "long"), F.col("start_ms"), F.lit(0)), F.lit(0)))
    x = x.withColumn("end_ms", F.greatest(F.coalesce("end_ms", F.lit(0)), F.col("start_ms") + 1))
    x = x.withColumn("preview_uri", F.coalesce("preview_uri", F.concat(F.lit("r2://media/"), "object_key"), F.concat(F.lit("r2://unavailable/"), "video_id")))
    shown = F.struct(have("keyframe_no", "long").alias("keyframe_no"), F.col("original_frame_id"), F.col("start_ms").alias("timestamp_ms"))
    return x.withColumn("representative", F.when(F.col("original_frame_id").isNotNull(), shown))


def detections(df: DataFrame, column: str, width: str, height: str) -> DataFrame:
    """The detections of a picture (array of label, confidence, box in pixels) as rows with their place and the box over the picture's
    size; a box that does not fit, no label or a confidence outside 0..1 leaves the row out."""
    rest = [c for c in df.columns if c != column]
    x = df.select(*rest, F.posexplode(column).alias("ordinal", "x"))
    x = x.select(*rest, "ordinal", F.trim("x.label").alias("label"), F.col("x.confidence").alias("confidence"), num.normalised_box("x.box", width, height).alias("box"))
    return x.filter((F.length("label") > 0) & F.col("confidence").between(0, 1) & F.col("box").isNotNull())
