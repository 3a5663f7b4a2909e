"""Queries over the frame timeline: clocks, signals, shots, sampling, windows and neighbours in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.functions import num, vector
from kinolith.operators import selection, temporal, timeline
from kinolith.operators.skew import scan_entity
from kinolith.plans.catalog import Catalog
from kinolith.plans.evidence import speech_spans
from kinolith.plans.evidence_sql import _SPANS
from kinolith.session import clean_id, table

CATALOG = Catalog()
query = CATALOG.query
_FR = "fr AS (SELECT DISTINCT * FROM frame_manifest WHERE original_frame_id IS NOT NULL)"
_V = "WINDOW w AS (PARTITION BY video_id ORDER BY original_frame_id)"


def frames(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Distinct frames with the columns asked for; only these reach the exchange."""
    return raw_frames(spark, d, *cols).distinct()


def raw_frames(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Frames with the columns asked for, repeats included, for scans that take them out in their own exchange."""
    return table(spark, d, "frame_manifest").filter("original_frame_id is not null").select("video_id", "original_frame_id", *cols)


@query(f"""WITH {_FR} SELECT video_id, original_frame_id, coalesce(abs(brightness_score::DOUBLE - lag(brightness_score::DOUBLE) OVER w), 0) motion,
 least(1.0, coalesce(abs(brightness_score::DOUBLE - lag(brightness_score::DOUBLE) OVER w), 0) / 64)::DOUBLE scene FROM fr WHERE NOT isnan(brightness_score) {_V}""")
def lag_signals(spark: SparkSession, d: str) -> DataFrame:
    f = raw_frames(spark, d, "brightness_score").filter("not isnan(brightness_score)").withColumn("b", F.col("brightness_score").cast("double"))
    return timeline.change_signals(f, "b", distinct=True).select("video_id", "original_frame_id", "motion", "scene")


@query(f"""WITH {_FR}, p AS (SELECT video_id, original_frame_id, abs(motion_score::DOUBLE - lag(motion_score::DOUBLE) OVER w) d FROM fr WHERE NOT isnan(motion_score) {_V})
SELECT video_id, original_frame_id, round(avg(d) OVER (PARTITION BY video_id ORDER BY original_frame_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 9)::DOUBLE motion_avg FROM p""")
def neighbour_motion(spark: SparkSession, d: str) -> DataFrame:
    f = raw_frames(spark, d, "motion_score").filter("not isnan(motion_score)").withColumn("m", F.col("motion_score").cast("double"))
    return timeline.neighbour_average(f, "m", distinct=True).select("video_id", "original_frame_id", F.round("motion_avg", 9).alias("motion_avg"))


@query(f"""WITH {_FR}, x AS (SELECT video_id, original_frame_id, entropy_score::DOUBLE e, min(entropy_score::DOUBLE) OVER (PARTITION BY video_id) lo, max(entropy_score::DOUBLE) OVER (PARTITION BY video_id) hi FROM fr WHERE NOT isnan(entropy_score))
SELECT video_id, original_frame_id, round(CASE WHEN hi > lo THEN (e - lo) / (hi - lo) ELSE 0 END, 9)::DOUBLE scaled FROM x""")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "entropy_score").filter("not isnan(entropy_score)").withColumn("e", F.col("entropy_score").cast("double"))
    return timeline.minmax(f, "e", ["video_id"], "scaled").select("video_id", "original_frame_id", F.round("scaled", 9).alias("scaled"))


@query(f"""WITH {_FR} SELECT video_id, clock_source, count(*) n, round(min(clock_ms), 3)::DOUBLE first_ms, round(max(clock_ms), 3)::DOUBLE last_ms, count(*) FILTER (off) n_off FROM (SELECT video_id, coalesce(pts_timestamp_ms, cfr_timestamp_ms) clock_ms,
 CASE WHEN pts_timestamp_ms IS NOT NULL THEN 'pts' WHEN cfr_timestamp_ms IS NOT NULL THEN 'cfr' ELSE 'unavailable' END clock_source, abs(pts_timestamp_ms - cfr_timestamp_ms) > 5 off FROM fr) GROUP BY 1, 2""")
def clock_sources(spark: SparkSession, d: str) -> DataFrame:
    f = timeline.clock(frames(spark, d, "pts_timestamp_ms", "cfr_timestamp_ms")).withColumn("off", F.abs(F.col("pts_timestamp_ms") - F.col("cfr_timestamp_ms")) > 5)
    return f.groupBy("video_id", "clock_source").agg(F.count("*").alias("n"), F.round(F.min("clock_ms"), 3).alias("first_ms"), F.round(F.max("clock_ms"), 3).alias("last_ms"), F.count_if("off").alias("n_off"))


@query(f"""WITH {_FR} SELECT video_id, round(arg_min(raw_pts_timestamp_ms - cfr_timestamp_ms, original_frame_id), 6)::DOUBLE origin_ms FROM fr WHERE raw_pts_timestamp_ms IS NOT NULL AND cfr_timestamp_ms IS NOT NULL GROUP BY 1""")
def pts_origin(spark: SparkSession, d: str) -> DataFrame:
    f = timeline.pts_origin(frames(spark, d, "raw_pts_timestamp_ms", "cfr_timestamp_ms"))
    return f.withColumn("origin_ms", F.round("origin_ms", 6))


@query(f"""WITH {_FR}, k AS (SELECT video_id, original_frame_id i, pts_timestamp_ms v,
  last_value(CASE WHEN pts_timestamp_ms IS NOT NULL THEN original_frame_id END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY original_frame_id ROWS UNBOUNDED PRECEDING) ai,
  last_value(pts_timestamp_ms IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY original_frame_id ROWS UNBOUNDED PRECEDING) av,
  first_value(CASE WHEN pts_timestamp_ms IS NOT NULL THEN original_frame_id END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY original_frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) bi,
  first_value(pts_timestamp_ms IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY original_frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) bv FROM fr)
SELECT video_id, i original_frame_id, round(coalesce(av + (bv - av) * (i - ai) / nullif(bi - ai, 0), av, bv), 6)::DOUBLE pts_ms FROM k WHERE v IS NULL""")
def interpolate_pts(spark: SparkSession, d: str) -> DataFrame:
    """Frames without a pts, on the line between their neighbours."""
    f = timeline.interpolate(raw_frames(spark, d, "pts_timestamp_ms"), "pts_timestamp_ms", "pts_ms", distinct=True)
    return f.filter("pts_timestamp_ms is null").select("video_id", "original_frame_id", F.round("pts_ms", 6).alias("pts_ms"))


@query(f"""WITH {_FR} SELECT video_id, original_frame_id, last_value(CASE WHEN is_codec_keyframe THEN original_frame_id END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY original_frame_id ROWS UNBOUNDED PRECEDING) key_frame_id FROM fr""")
def preceding_keyframe(spark: SparkSession, d: str) -> DataFrame:
    return timeline.last_key_frame(raw_frames(spark, d, "is_codec_keyframe"), distinct=True).select("video_id", "original_frame_id", "key_frame_id")


_SHOTS = f"""{_FR}, p AS (SELECT video_id, row_number() OVER w - 1 i, coalesce(scene_change_score > 0.9 AND NOT isnan(scene_change_score), false) OR coalesce(isnan(scene_change_score), false) hard FROM fr {_V}),
r AS (SELECT *, sum(CASE WHEN hard AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY i) run FROM (SELECT *, lag(hard) OVER (PARTITION BY video_id ORDER BY i) prev FROM p)),
n AS (SELECT video_id, count(*) n FROM p GROUP BY 1),
st AS (SELECT video_id, (min(i) + max(i) + 1) // 2 s FROM r WHERE hard GROUP BY video_id, run UNION SELECT video_id, 0 FROM n),
shots AS (SELECT st.video_id, row_number() OVER (PARTITION BY st.video_id ORDER BY s) - 1 shot_id, s start_frame, coalesce(lead(s) OVER (PARTITION BY st.video_id ORDER BY s), n) - 1 end_frame FROM st JOIN n USING (video_id) WHERE s < n)"""


def _shots(spark: SparkSession, d: str) -> DataFrame:
    return timeline.shots(raw_frames(spark, d, "scene_change_score"), "scene_change_score", 0.9, distinct=True)


@query(f"WITH {_SHOTS} SELECT * FROM shots")
def shot_partition(spark: SparkSession, d: str) -> DataFrame:
    return _shots(spark, d)


@query(f"WITH {_SHOTS} SELECT count(*) n_shots, sum(end_frame - start_frame + 1)::BIGINT n_frames, count(*) FILTER (end_frame < start_frame) n_broken FROM shots")
def shot_totals(spark: SparkSession, d: str) -> DataFrame:
    s = _shots(spark, d)
    return s.agg(F.count("*").alias("n_shots"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("n_frames"), F.count_if(F.col("end_frame") < F.col("start_frame")).alias("n_broken"))


@query(f"""WITH RECURSIVE {_SHOTS}, m AS (
  SELECT video_id, shot_id i, start_frame s, end_frame e, 0::BIGINT k, end_frame - start_frame + 1 < 8 short0 FROM shots WHERE shot_id = 0
  UNION ALL
  SELECT m.video_id, x.shot_id, CASE WHEN x.end_frame - x.start_frame + 1 < 8 OR (k = 0 AND m.e - m.s + 1 < 8) THEN m.s ELSE x.start_frame END, x.end_frame, CASE WHEN x.end_frame - x.start_frame + 1 < 8 OR (k = 0 AND m.e - m.s + 1 < 8) THEN k ELSE k + 1 END, false
  FROM m JOIN shots x ON x.video_id = m.video_id AND x.shot_id = m.i + 1)
SELECT video_id, k::INT shot_id, min(s) start_frame, max(e) end_frame FROM m GROUP BY 1, 2""")
def merge_short_shots(spark: SparkSession, d: str) -> DataFrame:
    return timeline.merge_short(_shots(spark, d), 8)


@query(f"""WITH {_SHOTS} SELECT shots.video_id, shot_id, count(*) n_frames, min(original_frame_id) first_id, max(original_frame_id) last_id FROM fr JOIN shots ON fr.video_id = shots.video_id AND original_frame_id BETWEEN start_frame AND end_frame GROUP BY 1, 2""")
def frames_in_shots(spark: SparkSession, d: str) -> DataFrame:
    """Range join of frames and shots as an equi-join over blocks."""
    j = timeline.frames_in_shots(frames(spark, d), _shots(spark, d))
    return j.groupBy("video_id", "shot_id").agg(F.count("*").alias("n_frames"), F.min("original_frame_id").alias("first_id"), F.max("original_frame_id").alias("last_id"))


@query(f"""WITH {_FR}, g AS (SELECT *, CASE WHEN brightness_score < 0.05 OR brightness_score > 0.95 OR brightness_score IS NULL THEN 'brightness' WHEN NOT coalesce(contrast_score >= 0.1, false) THEN 'low_info' WHEN NOT coalesce(blur_score >= 1, false) THEN 'blur' ELSE 'ok' END reason FROM fr)
SELECT video_id, reason, CASE WHEN reason = 'ok' THEN 'retrieval_embedding' ELSE 'temporal_only' END route, count(*) n FROM g GROUP BY 1, 2, 3""")
def quality_routes(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "brightness_score", "contrast_score", "blur_score").withColumn("reason", num.quality_gate("brightness_score", "contrast_score", "blur_score", 0.05, 0.95, 0.1, 1.0))
    return f.groupBy("video_id", "reason").agg(F.count("*").alias("n")).withColumn("route", F.when(F.col("reason") == "ok", "retrieval_embedding").otherwise("temporal_only"))


@query(f"""WITH {_FR}, t AS (SELECT DISTINCT upper(trim(video_id)) video_id, original_frame_id target_id FROM frame_aliases WHERE original_frame_id IS NOT NULL),
j AS (SELECT t.video_id, target_id, original_frame_id id, row_number() OVER (PARTITION BY t.video_id, target_id ORDER BY coalesce(blur_score >= 1, false) DESC, blur_score DESC, contrast_score DESC, abs(original_frame_id - target_id), original_frame_id) n
  FROM t JOIN fr ON fr.video_id = t.video_id AND original_frame_id BETWEEN target_id - 3 AND target_id + 3 WHERE NOT isnan(blur_score))
SELECT video_id, target_id, id chosen_id FROM j WHERE n = 1""")
def best_in_radius(spark: SparkSession, d: str) -> DataFrame:
    """The best frame within three of each keyframe."""
    t = table(spark, d, "frame_aliases").select(clean_id("video_id").alias("video_id"), "original_frame_id").filter("original_frame_id is not null").distinct()
    f = frames(spark, d, "blur_score", "contrast_score").filter("not isnan(blur_score)").withColumn("ok", F.col("blur_score") >= 1)
    return timeline.best_in_radius(t, f, 3)


@query(f"""WITH {_FR}, g AS (SELECT video_id, original_frame_id // 50 win, original_frame_id, text_change_score::DOUBLE ext, motion_score::DOUBLE mot, blur_score::DOUBLE qual, 1 / (1 + abs(original_frame_id % 50 - 25)) target FROM fr WHERE NOT isnan(text_change_score) AND NOT isnan(motion_score) AND NOT isnan(blur_score)),
s AS (SELECT *, min(ext) OVER p e0, max(ext) OVER p e1, min(mot) OVER p m0, max(mot) OVER p m1, min(qual) OVER p q0, max(qual) OVER p q1 FROM g WINDOW p AS (PARTITION BY video_id, win)),
n AS (SELECT video_id, win, original_frame_id, CASE WHEN e1 > e0 THEN (ext - e0) / (e1 - e0) ELSE 0 END e, CASE WHEN q1 > q0 THEN (qual - q0) / (q1 - q0) ELSE 0 END q, CASE WHEN m1 > m0 THEN (mot - m0) / (m1 - m0) ELSE 0 END m, target t FROM s),
r AS (SELECT *, round(0.65 * e + 0.15 * q + 0.10 * m + 0.10 * t, 9) total FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id, win ORDER BY total DESC, round(e, 9) DESC, round(q, 9) DESC, round(m, 9) DESC, round(t, 9) DESC, original_frame_id) i FROM r)
SELECT video_id, win, original_frame_id, round(total, 6)::DOUBLE total FROM k WHERE i = 1""")
def semantic_choice(spark: SparkSession, d: str) -> DataFrame:
    """One frame per window of 50 by weighted, scaled signals."""
    f = frames(spark, d, "text_change_score", "motion_score", "blur_score").filter("not isnan(text_change_score) and not isnan(motion_score) and not isnan(blur_score)")
    f = f.select("video_id", "original_frame_id", F.floor(F.col("original_frame_id") / 50).alias("win"), F.col("text_change_score").cast("double").alias("ext"), F.col("motion_score").cast("double").alias("mot"), F.col("blur_score").cast("double").alias("qual"))
    f = f.withColumn("target", num.target_proximity(F.pmod("original_frame_id", F.lit(50)) - 25))
    return timeline.weighted_choice(f, ["video_id", "win"], {"ext": 0.65, "qual": 0.15, "mot": 0.10, "target": 0.10}).select("video_id", "win", "original_frame_id", F.round("total", 6).alias("total"))


@query(f"""WITH {_FR}, p AS (SELECT video_id, original_frame_id, row_number() OVER (PARTITION BY video_id ORDER BY original_frame_id, decoded_frame_index) - 1 + min(original_frame_id) OVER (PARTITION BY video_id) pos,
  timestamp_ms < lag(timestamp_ms) OVER (PARTITION BY video_id ORDER BY original_frame_id, decoded_frame_index) back, count(pts) OVER (PARTITION BY video_id, pts) > 1 twice FROM fr)
SELECT video_id, original_frame_id, 'position' violation FROM p WHERE pos <> original_frame_id UNION ALL SELECT video_id, original_frame_id, 'time' FROM p WHERE back UNION ALL SELECT video_id, original_frame_id, 'pts' FROM p WHERE twice""")
def timeline_checks(spark: SparkSession, d: str) -> DataFrame:
    return timeline.timeline_violations(frames(spark, d, "decoded_frame_index", "timestamp_ms", "pts"))


@query("""WITH v AS (SELECT DISTINCT video_id, duration_ms / 1000.0 dur FROM videos_manifest), k AS (SELECT DISTINCT upper(trim(video_id)) video_id, keyframe_no, timestamp_ms / 1000.0 t FROM frame_aliases WHERE timestamp_ms IS NOT NULL),
a AS (SELECT video_id, t FROM k SEMI JOIN v USING (video_id) UNION ALL SELECT video_id, 0 FROM v UNION ALL SELECT video_id, dur FROM v),
g AS (SELECT video_id, t - lag(t) OVER (PARTITION BY video_id ORDER BY t) gap FROM a)
SELECT video_id, round(max(gap), 2)::DOUBLE max_gap_s, count(*) FILTER (gap > 10) n_wide FROM g GROUP BY 1""")
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos_manifest").select("video_id", (F.col("duration_ms") / 1000.0).alias("duration_s")).distinct()
    k = table(spark, d, "frame_aliases").filter("timestamp_ms is not null").select(clean_id("video_id").alias("video_id"), "keyframe_no", (F.col("timestamp_ms") / 1000.0).alias("t")).distinct()
    return timeline.coverage(k, v)


@query(f"""WITH {_SPANS}, k AS (SELECT DISTINCT upper(trim(video_id)) video_id, keyframe_no, timestamp_ms t FROM frame_aliases WHERE timestamp_ms IS NOT NULL)
SELECT k.video_id, keyframe_no, source_span_index FROM k JOIN sp ON sp.video_id = k.video_id AND s <= t AND e > t""")
def interval_stab(spark: SparkSession, d: str) -> DataFrame:
    """Speech spans that hold the time of a keyframe."""
    k = table(spark, d, "frame_aliases").filter("timestamp_ms is not null").select(clean_id("video_id").alias("video_id"), "keyframe_no", F.col("timestamp_ms").alias("t")).distinct()
    return temporal.stab(speech_spans(spark, d), k, "video_id", "start_ms", "end_ms", "t").select("video_id", "keyframe_no", "source_span_index")


@query("""WITH t AS (SELECT DISTINCT alignment_id, event_ordinal, upper(trim(video_id)) video_id, original_frame_id c FROM trake_alignment WHERE original_frame_id IS NOT NULL),
k AS (SELECT DISTINCT upper(trim(video_id)) video_id, original_frame_id f FROM frame_aliases WHERE original_frame_id IS NOT NULL),
j AS (SELECT alignment_id, event_ordinal, f, abs(f - c) d, row_number() OVER (PARTITION BY alignment_id, event_ordinal ORDER BY abs(f - c), f) n FROM t JOIN k USING (video_id))
SELECT alignment_id, event_ordinal, f near_frame, d distance FROM j WHERE n = 1""")
def nearest_keyframe(spark: SparkSession, d: str) -> DataFrame:
    """The keyframe nearest by frame id, however far, ties to the smaller id."""
    t = table(spark, d, "trake_alignment").filter("original_frame_id is not null").select("alignment_id", "event_ordinal", clean_id("video_id").alias("video_id"), F.col("original_frame_id").alias("c")).distinct()
    k = table(spark, d, "frame_aliases").filter("original_frame_id is not null").select(clean_id("video_id").alias("video_id"), F.col("original_frame_id").alias("f")).distinct()
    near = temporal.nearest_row(t, k, "video_id", "c", "f", ["f"], ["f"])
    return near.filter("near_f is not null").select("alignment_id", "event_ordinal", F.col("near_f").alias("near_frame"), "distance")


@query("""WITH t AS (SELECT alignment_id, min(video_id) video_id, min(c) c FROM (SELECT alignment_id, upper(trim(video_id)) video_id, original_frame_id c FROM trake_alignment WHERE event_ordinal = 1 AND original_frame_id IS NOT NULL) GROUP BY 1),
k AS (SELECT DISTINCT upper(trim(video_id)) video_id, original_frame_id f FROM frame_aliases WHERE original_frame_id IS NOT NULL),
j AS (SELECT alignment_id, f, row_number() OVER (PARTITION BY alignment_id ORDER BY abs(f - c), f) n FROM t JOIN k USING (video_id))
SELECT alignment_id, f, row_number() OVER (PARTITION BY alignment_id ORDER BY f) AS position FROM j WHERE n <= 5""")
def knn_frames(spark: SparkSession, d: str) -> DataFrame:
    """The five keyframes around the first event of each alignment, in time order."""
    t = table(spark, d, "trake_alignment").filter("event_ordinal = 1 and original_frame_id is not null").select("alignment_id", clean_id("video_id").alias("video_id"), F.col("original_frame_id").alias("c"))
    t = t.groupBy("alignment_id").agg(F.min("video_id").alias("video_id"), F.min("c").alias("c"))
    k = table(spark, d, "frame_aliases").filter("original_frame_id is not null").select(clean_id("video_id").alias("video_id"), F.col("original_frame_id").alias("f")).distinct()
    return temporal.neighbours(k, t, "video_id", "f", "c", 5, "alignment_id").select("alignment_id", "f", "position")


_WIN = """h AS (SELECT DISTINCT video_id, start_ms s, end_ms e, original_frame_id f, confidence c FROM evidence WHERE original_frame_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms > start_ms),
r AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e, f, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM h),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e, f, c) grp FROM r),
win AS (SELECT video_id, min(s) start_ms, max(e) end_ms, count(*) n_members, max(c) score, arg_max(f, {'a': coalesce(c, -1e308), 'b': -s, 'c': -f}) peak_frame FROM g GROUP BY video_id, grp)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "evidence").filter("original_frame_id is not null and start_ms is not null and end_ms > start_ms").select("video_id", "start_ms", "end_ms", "original_frame_id", "confidence").distinct()
    return temporal.merge_windows(h, "video_id", "start_ms", "end_ms", 500, "confidence", "original_frame_id")


@query(f"WITH {_WIN} SELECT * FROM win")
def merge_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


@query(f"""WITH {_WIN}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC NULLS LAST, start_ms) i FROM win), o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) - 1 ordinal FROM k WHERE i <= 3)
SELECT video_id, start_ms, end_ms, score, ordinal, 'q1_' || video_id || '_event_' || lpad(ordinal::VARCHAR, 4, '0') window_id FROM o""")
def cap_windows(spark: SparkSession, d: str) -> DataFrame:
    return temporal.cap_windows(_windows(spark, d), "video_id", 3, "q1_").select("video_id", "start_ms", "end_ms", "score", "ordinal", "window_id")


@query(f"""WITH RECURSIVE {_FR}, p AS (SELECT video_id, original_frame_id f, row_number() OVER w n FROM fr WHERE scene_change_score >= 0.35 AND isfinite(scene_change_score) {_V}),
m AS (SELECT video_id, f, n, f last, true keep FROM p WHERE n = 1 UNION ALL SELECT p.video_id, p.f, p.n, CASE WHEN p.f - last >= 8 THEN p.f ELSE last END, p.f - last >= 8 FROM m JOIN p ON p.video_id = m.video_id AND p.n = m.n + 1)
SELECT video_id, f original_frame_id FROM m WHERE keep""")
def light_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries by score at least eight frames apart."""
    f = raw_frames(spark, d, "scene_change_score").filter("scene_change_score >= 0.35 and not isnan(scene_change_score)")
    return temporal.spaced_boundaries(f, "video_id", "original_frame_id", 8, distinct=True)


@query(f"""WITH {_FR}, a AS (SELECT DISTINCT upper(trim(video_id)) video_id, keyframe_no, original_frame_id FROM frame_aliases WHERE original_frame_id IS NOT NULL)
SELECT a.video_id, keyframe_no, original_frame_id, round_even(original_frame_id * fps_den * 1000.0 / fps_num, 3)::DOUBLE frame_ms, round_even((original_frame_id * fps_den * 1000.0 / fps_num), 0)::BIGINT ms,
 bit_count(xor(original_frame_id, keyframe_no))::INT bits FROM a JOIN fr USING (video_id, original_frame_id) WHERE fps_num > 0""")
def frame_clock(spark: SparkSession, d: str) -> DataFrame:
    """Exact frame times from rational rates."""
    a = table(spark, d, "frame_aliases").filter("original_frame_id is not null").select(clean_id("video_id").alias("video_id"), "keyframe_no", "original_frame_id").distinct()
    j = a.join(frames(spark, d, "fps_num", "fps_den"), ["video_id", "original_frame_id"]).filter("fps_num > 0")
    raw = F.col("original_frame_id") * F.col("fps_den") * 1000.0 / F.col("fps_num")
    return j.select("video_id", "keyframe_no", "original_frame_id", num.frame_to_ms("original_frame_id", "fps_num", "fps_den").alias("frame_ms"), F.bround(raw).cast("long").alias("ms"), vector.hamming("original_frame_id", "keyframe_no").alias("bits"))


_AL3 = """c AS (SELECT query_id, upper(trim(video_id)) v, original_frame_id f, min(timestamp_ms)::DOUBLE t, arg_max([CASE WHEN event_ordinal % 3 = 1 THEN selection_score ELSE selection_score / 4 END, CASE WHEN event_ordinal % 3 = 2 THEN selection_score ELSE selection_score / 4 END, CASE WHEN event_ordinal % 3 = 0 THEN selection_score ELSE selection_score / 4 END], event_ordinal) s
 FROM (SELECT DISTINCT query_id, video_id, original_frame_id, timestamp_ms, selection_score, event_ordinal FROM trake_alignment) WHERE original_frame_id IS NOT NULL AND selection_score IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT query_id, v, f, coalesce(t, f * 40.0) t, s FROM c), j AS (SELECT b.query_id, b.v, b.f, a.f pf, b.s, CASE WHEN d < 400 THEN 0.5 WHEN d BETWEEN 1000 AND 120000 THEN 1.2 WHEN d > 900000 THEN 0.8 ELSE 1.0 END::DOUBLE m FROM p b JOIN p a ON a.query_id = b.query_id AND a.v = b.v AND a.f < b.f, LATERAL (SELECT greatest(1, b.t - a.t) d)),
d1 AS (SELECT query_id, v, f, s[1] b FROM p WHERE s[1] > 0),
d2 AS (SELECT * FROM (SELECT j.query_id, j.v, j.f, j.pf, d1.b + j.s[2] * m b, row_number() OVER (PARTITION BY j.query_id, j.v, j.f ORDER BY d1.b + j.s[2] * m DESC, j.pf) n FROM j JOIN d1 ON d1.query_id = j.query_id AND d1.v = j.v AND d1.f = j.pf WHERE j.s[2] > 0) WHERE n = 1),
d3 AS (SELECT * FROM (SELECT j.query_id, j.v, j.f, j.pf, d2.pf ppf, d2.b + j.s[3] * m b, row_number() OVER (PARTITION BY j.query_id, j.v, j.f ORDER BY d2.b + j.s[3] * m DESC, j.pf) n FROM j JOIN d2 ON d2.query_id = j.query_id AND d2.v = j.v AND d2.f = j.pf WHERE j.s[3] > 0) WHERE n = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY b DESC, f) i FROM d3) WHERE i = 1),
path AS (SELECT query_id, v, b, unnest([ppf, pf, f]) f, unnest([1, 2, 3]) place FROM top)"""


@query(f"""WITH {_AL3} SELECT path.query_id, path.v video_id, path.f original_frame_id, place, round(list_max(s) + b / 3, 6)::DOUBLE score FROM path JOIN p USING (query_id, v, f)
UNION ALL SELECT query_id, v, f, NULL, round(list_max(s), 6)::DOUBLE FROM p WHERE query_id NOT IN (SELECT query_id FROM path)""")
def sequence_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Best path over three variants for each video of a query; queries without a path keep their candidates."""
    t = table(spark, d, "trake_alignment").filter("original_frame_id is not null and selection_score is not null").select("query_id", clean_id("video_id").alias("video_id"), "original_frame_id", "timestamp_ms", "selection_score", "event_ordinal").distinct()
    scores = F.array(*[F.when(F.pmod("event_ordinal", F.lit(3)) == i, F.col("selection_score")).otherwise(F.col("selection_score") / 4) for i in (1, 2, 0)])
    one = t.groupBy("query_id", "video_id", "original_frame_id").agg(F.min("timestamp_ms").cast("double").alias("t"), F.max_by(scores, "event_ordinal").alias("scores")).withColumn("score", F.array_max("scores"))
    return selection.align_sequences(one, ["query_id"], "video_id", "original_frame_id", "t", "scores", "score").withColumn("score", F.round("score", 6))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embedding_result").filter(F.size("vector") == F.col("embedding_dim")).filter(vector.is_finite("vector") & (vector.norm("vector") > 0))
    return e.select("model_name", "embedding_dim", "video_id", "embedding_id", "original_frame_id", "vector").distinct()


_VG = """e AS (SELECT DISTINCT model_name, embedding_dim, video_id, embedding_id, original_frame_id f, vector FROM embedding_result WHERE len(vector) = embedding_dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
g AS (SELECT *, vector::DOUBLE[] v, row_number() OVER (PARTITION BY model_name, embedding_dim, video_id ORDER BY f NULLS LAST, embedding_id) n FROM e)"""
_GREEDY = """k AS (SELECT model_name, embedding_dim, video_id, n, [v] kept, true keep, embedding_id FROM g WHERE n = 1 UNION ALL
 SELECT g.model_name, g.embedding_dim, g.video_id, g.n, CASE WHEN far THEN list_append(kept, g.v) ELSE kept END, far, g.embedding_id FROM k JOIN g ON g.model_name = k.model_name AND g.embedding_dim = k.embedding_dim AND g.video_id = k.video_id AND g.n = k.n + 1,
 LATERAL (SELECT len(list_filter(kept, lambda w: round(list_cosine_similarity(w, g.v), 9) {op} {least})) = 0 far))"""


@query(f"""WITH RECURSIVE {_VG}, pr AS (SELECT a.model_name, a.embedding_dim, a.video_id, a.n i, b.n j FROM g a JOIN g b ON a.model_name = b.model_name AND a.embedding_dim = b.embedding_dim AND a.video_id = b.video_id AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.8),
r AS (SELECT model_name, embedding_dim, video_id, n i, n root FROM g UNION SELECT r.model_name, r.embedding_dim, r.video_id, j, root FROM r JOIN pr USING (model_name, embedding_dim, video_id, i)),
c AS (SELECT model_name, embedding_dim, video_id, i n, min(root) comp FROM r GROUP BY 1, 2, 3, 4), m AS (SELECT g.*, comp FROM g JOIN c USING (model_name, embedding_dim, video_id, n)),
x AS (SELECT a.embedding_id, a.model_name, a.embedding_dim, a.video_id, a.comp, a.n, avg(list_cosine_similarity(a.v, b.v)) mean FROM m a JOIN m b ON a.model_name = b.model_name AND a.embedding_dim = b.embedding_dim AND a.video_id = b.video_id AND a.comp = b.comp GROUP BY ALL)
SELECT embedding_id FROM (SELECT *, row_number() OVER (PARTITION BY model_name, embedding_dim, video_id, comp ORDER BY round(mean, 9) DESC, n) k FROM x) WHERE k = 1""")
def embedding_medoids(spark: SparkSession, d: str) -> DataFrame:
    """A medoid per similarity component within each video and model; vectors without a frame come last in time."""
    return selection.medoid_vectors(_vectors(spark, d), ["model_name", "embedding_dim", "video_id"], "vector", "original_frame_id", "embedding_id", 0.8).select("embedding_id")


@query(f"WITH RECURSIVE {_VG}, {_GREEDY.format(op='>=', least=0.9)} SELECT embedding_id FROM k WHERE keep")
def embedding_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Greedy de-duplication (cosine >= 0.9) within each video and model; vectors without a frame come last in time."""
    return selection.distinct_vectors(_vectors(spark, d), ["model_name", "embedding_dim", "video_id"], "vector", "original_frame_id", "embedding_id", 0.9).select("embedding_id")


@query(f"WITH RECURSIVE {_VG}, {_GREEDY.format(op='>', least=0.3)} SELECT embedding_id FROM k WHERE keep")
def embedding_spread(spark: SparkSession, d: str) -> DataFrame:
    """Greedy de-duplication by a cosine above 0.3: what is kept is spread out."""
    return selection.distinct_vectors(_vectors(spark, d), ["model_name", "embedding_dim", "video_id"], "vector", "original_frame_id", "embedding_id", 0.3, inclusive=False).select("embedding_id")


@query("""WITH v AS (SELECT DISTINCT video_id, codec, duration_ms FROM videos_manifest WHERE codec IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY codec ORDER BY video_id) turn FROM v),
s AS (SELECT *, coalesce(sum(duration_ms) OVER (ORDER BY turn, codec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) bef FROM n)
SELECT video_id, codec, turn FROM s WHERE bef < 3600000""")
def round_robin_subset(spark: SparkSession, d: str) -> DataFrame:
    """One video of each codec in turn until an hour is reached."""
    v = table(spark, d, "videos_manifest").filter("codec is not null").select("video_id", "codec", "duration_ms").distinct()
    return selection.round_robin_subset(v, "codec", "video_id", "duration_ms", 3_600_000).select("video_id", "codec", "turn")


@query(f"""WITH RECURSIVE {_SHOTS}, pl AS (SELECT video_id, original_frame_id f, row_number() OVER w - 1 place, CASE WHEN isnan(motion_score) THEN 0 ELSE motion_score END m FROM fr {_V}),
o AS (SELECT pl.video_id, shot_id, f, row_number() OVER (PARTITION BY pl.video_id, shot_id ORDER BY m DESC, f) n FROM pl JOIN shots ON shots.video_id = pl.video_id AND place BETWEEN start_frame AND end_frame WHERE m >= 0.25),
k AS (SELECT video_id, shot_id, n, f, [f] kept, true keep FROM o WHERE n = 1 UNION ALL SELECT o.video_id, o.shot_id, o.n, o.f, CASE WHEN far THEN list_append(kept, o.f) ELSE kept END, far
 FROM k JOIN o ON o.video_id = k.video_id AND o.shot_id = k.shot_id AND o.n = k.n + 1, LATERAL (SELECT len(kept) < 3 AND len(list_filter(kept, lambda x: abs(x - o.f) < 8)) = 0 far))
SELECT video_id, shot_id, f original_frame_id FROM k WHERE keep""")
def shot_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Up to three motion peaks of each shot, of at least 0.25 and at least eight frames apart."""
    f = frames(spark, d, "scene_change_score")
    place = scan_entity(f, ["video_id"], "original_frame_id", {"i_": ("sum", F.lit(1))}).groupBy("video_id", "original_frame_id").agg((F.min("i_") - 1).alias("place"))
    j = frames(spark, d, "motion_score").join(place, ["video_id", "original_frame_id"]).withColumnRenamed("original_frame_id", "frame").withColumnRenamed("place", "original_frame_id")  # shots count places
    j = timeline.frames_in_shots(j, _shots(spark, d)).select("video_id", "shot_id", F.col("frame").alias("original_frame_id"), "motion_score")
    return temporal.top_peaks(j, ["video_id", "shot_id"], "original_frame_id", "motion_score", 0.25, 8, 3).select("video_id", "shot_id", "original_frame_id")
