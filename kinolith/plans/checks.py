"""Contract checks and normal forms over the evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.operators import contracts, timeline
from kinolith.plans.catalog import Catalog
from kinolith.plans.ingest import aliases
from kinolith.plans.timeline import frames
from kinolith.session import clean_id, table

CATALOG = Catalog()
query = CATALOG.query
_T = "t AS (SELECT DISTINCT * REPLACE (upper(trim(video_id)) AS video_id) FROM trake_alignment)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trake_alignment").withColumn("video_id", clean_id("video_id")).distinct()


@query("""WITH e AS (SELECT DISTINCT * FROM evidence) SELECT evidence_id, 'start' "rule" FROM e WHERE NOT coalesce(start_ms >= 0, false) UNION ALL SELECT evidence_id, 'interval' FROM e WHERE NOT coalesce(end_ms > start_ms, false)
 UNION ALL SELECT evidence_id, 'confidence' FROM e WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false)""")
def evidence_contract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence").distinct()
    return contracts.violations(e, ["evidence_id"], contracts.interval_rules("start_ms", "end_ms") | {"confidence": F.col("confidence").between(0, 1)})


@query(f"WITH {_T} SELECT alignment_id, count(*) n, min(event_ordinal) low, max(event_ordinal) high FROM t GROUP BY 1 HAVING min(event_ordinal) <> 1 OR max(event_ordinal) <> count(*) OR count(DISTINCT event_ordinal) <> count(*)")
def ordinal_contract(spark: SparkSession, d: str) -> DataFrame:
    return contracts.ordinals_complete(_events(spark, d), ["alignment_id"], "event_ordinal")


@query(f"""WITH {_T}, x AS (SELECT alignment_id, event_ordinal, original_frame_id f, lag(original_frame_id) OVER (PARTITION BY alignment_id ORDER BY event_ordinal) b FROM t) SELECT alignment_id, event_ordinal FROM x WHERE f <= b""")
def order_contract(spark: SparkSession, d: str) -> DataFrame:
    return contracts.order_respected(_events(spark, d), ["alignment_id"], "event_ordinal", "original_frame_id").select("alignment_id", "event_ordinal")


@query(f"""WITH {_T}, a AS (SELECT alignment_id, list(original_frame_id ORDER BY event_ordinal, original_frame_id) fs FROM t GROUP BY 1)
SELECT alignment_id, len(fs)::INT n, len(fs) BETWEEN 1 AND 20 AND len(list_filter(fs, lambda x: x IS NULL)) = 0 AND len(list_filter(range(1, len(fs)), lambda i: fs[i] >= fs[i + 1])) = 0 valid FROM a""")
def answer_shape(spark: SparkSession, d: str) -> DataFrame:
    """Answers as frame lists: one to twenty, none missing, strictly rising."""
    a = _events(spark, d).groupBy("alignment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_ordinal", "original_frame_id"))), lambda x: x["original_frame_id"]).alias("fs"))
    return a.select("alignment_id", F.size("fs").alias("n"), contracts.strictly_rising("fs").alias("valid"))


@query("""WITH v AS (SELECT DISTINCT * FROM videos_manifest), r AS (SELECT *, try_cast(split_part(fps_str, '/', 1) AS BIGINT) a, coalesce(try_cast(nullif(split_part(fps_str, '/', 2), '') AS BIGINT), 1) b FROM v)
SELECT video_id, a fps_num, b fps_den, duration_ms / 1000.0 duration_s, coalesce(frame_count, round_even(duration_ms * a / (b * 1000.0), 0)::BIGINT) n_frames FROM r""")
def normal_manifest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos_manifest").select("video_id", "fps_str", "fps", "frame_count", "duration_ms", "created_at").distinct()
    return contracts.normal_manifest(v).select("video_id", "fps_num", "fps_den", "duration_s", "n_frames")


@query("""WITH a AS (SELECT DISTINCT upper(trim(video_id)) video_id, keyframe_no, original_frame_id FROM frame_aliases WHERE original_frame_id IS NOT NULL), c AS (SELECT video_id, quantile_disc(original_frame_id, 0.5) mid FROM a GROUP BY 1),
k AS (SELECT a.video_id, keyframe_no, original_frame_id, row_number() OVER (PARTITION BY a.video_id ORDER BY keyframe_no) i, count(*) OVER (PARTITION BY a.video_id) n FROM a),
m AS (SELECT video_id, arg_min(i, {'d': abs(keyframe_no - 10), 'k': keyframe_no}) pos, max(n) n FROM k GROUP BY 1)
SELECT k.video_id, keyframe_no FROM k JOIN m USING (video_id) WHERE i >= greatest(1, least(pos - 4, m.n - 7)) AND i < greatest(1, least(pos - 4, m.n - 7)) + 8""")
def frame_window(spark: SparkSession, d: str) -> DataFrame:
    """Eight keyframes around number ten of each video."""
    a = aliases(spark, d).filter("original_frame_id is not null").select("video_id", "keyframe_no").distinct().withColumn("anchor", F.lit(10))
    return contracts.window_around(a, ["video_id"], "keyframe_no", "anchor", 8).select("video_id", "keyframe_no")


@query("""WITH f AS (SELECT video_id, min(original_frame_id) lo, max(original_frame_id) hi FROM frame_manifest GROUP BY 1),
s AS (SELECT DISTINCT evidence_id, video_id, original_frame_id - 5 a, original_frame_id + 5 b FROM evidence WHERE original_frame_id IS NOT NULL)
SELECT evidence_id, video_id, greatest(a, lo) start_frame, least(b, hi) end_frame FROM s JOIN f USING (video_id) WHERE greatest(a, lo) <= least(b, hi)""")
def clamped_shots(spark: SparkSession, d: str) -> DataFrame:
    """Frame ranges around evidence, cut to the timeline."""
    t = frames(spark, d).groupBy("video_id").agg(F.min("original_frame_id").alias("first_id"), F.max("original_frame_id").alias("last_id"))
    e = table(spark, d, "evidence").filter("original_frame_id is not null").select("evidence_id", "video_id", (F.col("original_frame_id") - 5).alias("start_frame"), (F.col("original_frame_id") + 5).alias("end_frame")).distinct()
    return contracts.clamp_shots(e, t).select("evidence_id", "video_id", "start_frame", "end_frame")


@query("""WITH k AS (SELECT DISTINCT upper(trim(video_id)) video_id, timestamp_ms t FROM frame_aliases WHERE timestamp_ms IS NOT NULL), g AS (SELECT video_id, t, lag(t) OVER (PARTITION BY video_id ORDER BY t) p FROM k)
SELECT video_id, p from_ms, t to_ms FROM g WHERE t - p > 10000""")
def coverage_violations(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of more than ten seconds between keyframes."""
    from kinolith.operators.skew import previous_in_entity

    k = aliases(spark, d).filter("timestamp_ms is not null").select("video_id", F.col("timestamp_ms").alias("t")).distinct()
    g = previous_in_entity(k, ["video_id"], "t", F.col("t"), "p", block=600_000)
    return g.filter("t - p > 10000").select("video_id", F.col("p").alias("from_ms"), F.col("t").alias("to_ms"))


@query("""WITH f AS (SELECT DISTINCT video_id, original_frame_id o, pts FROM frame_manifest WHERE original_frame_id IS NOT NULL), a AS (SELECT video_id, o, CASE WHEN o % 11 = 0 THEN NULL ELSE pts END pts FROM f),
ua AS (SELECT video_id, pts, min(o) decoded_at FROM a WHERE pts IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1), ub AS (SELECT video_id, pts, min(o) manifest_at FROM f WHERE pts IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
p AS (SELECT video_id, decoded_at, manifest_at, 'pts' how FROM ua JOIN ub USING (video_id, pts)),
oa AS (SELECT video_id, o decoded_at, row_number() OVER (PARTITION BY video_id ORDER BY o) i FROM a WHERE (video_id, o) NOT IN (SELECT video_id, decoded_at FROM p)),
ob AS (SELECT video_id, o manifest_at, row_number() OVER (PARTITION BY video_id ORDER BY o) i FROM f WHERE (video_id, o) NOT IN (SELECT video_id, manifest_at FROM p)),
m AS (SELECT * FROM p UNION ALL SELECT video_id, decoded_at, manifest_at, 'order' FROM oa JOIN ob USING (video_id, i))
SELECT video_id, how, count(*) n, count(*) FILTER (decoded_at = manifest_at) n_same FROM m GROUP BY 1, 2""")
def clock_matching(spark: SparkSession, d: str) -> DataFrame:
    """Decoded frames against the manifest by pts, and by decode order where the pts is missing or not unique."""
    f = frames(spark, d, "pts")
    decoded = f.withColumn("pts", F.when(F.pmod("original_frame_id", F.lit(11)) != 0, F.col("pts")))
    m = contracts.match_by_clock(decoded, f, "video_id", "pts", "original_frame_id")
    return m.groupBy("video_id", "how").agg(F.count("*").alias("n"), F.count_if(F.col("decoded_at") == F.col("manifest_at")).alias("n_same"))
