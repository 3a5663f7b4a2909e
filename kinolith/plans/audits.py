"""Audits and look-ups: what exists, what resolves, what is missing, per video or record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinolith.operators import contracts, mapping, temporal, timeline
from kinolith.operators.skew import scan_entity
from kinolith.plans.catalog import Catalog
from kinolith.plans.evidence import speech_spans
from kinolith.plans.evidence_sql import _SPANS
from kinolith.plans.ingest import _AL, aliases
from kinolith.plans.timeline import _FR, _SHOTS, frames
from kinolith.session import clean_id, latest, table

CATALOG = Catalog()
query = CATALOG.query
_TR = "tr AS (SELECT DISTINCT alignment_id, event_ordinal, upper(trim(video_id)) video_id, original_frame_id, timestamp_ms FROM trake_alignment)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trake_alignment")
    return t.select("alignment_id", "event_ordinal", clean_id("video_id").alias("video_id"), "original_frame_id", "timestamp_ms").distinct()


def _evidence(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "evidence").select("evidence_id", *cols).distinct()


@query(f"""WITH {_AL}, e AS (SELECT DISTINCT embedding_id, video_id, embedding_dim, len(vector) n FROM embedding_result), x AS (SELECT video_id, count(*) n_vectors, count(DISTINCT embedding_id) n_ids, count(*) FILTER (n IS NULL OR n <> embedding_dim) n_bad FROM e GROUP BY 1),
k AS (SELECT video_id, count(*) n_keyframes FROM al GROUP BY 1)
SELECT video_id, coalesce(n_vectors, 0) n_vectors, coalesce(n_keyframes, 0) n_keyframes, coalesce(n_bad, 0) n_bad, coalesce(n_vectors <> n_ids, false) repeated FROM x FULL JOIN k USING (video_id)""")
def embedding_audit(spark: SparkSession, d: str) -> DataFrame:
    """Vectors against keyframes per video."""
    e = table(spark, d, "embedding_result").select("embedding_id", "video_id", "embedding_dim", F.size("vector").alias("n")).distinct()
    x = e.groupBy("video_id").agg(F.count("*").alias("n_vectors"), F.countDistinct("embedding_id").alias("n_ids"), F.count_if(F.col("n").isNull() | (F.col("n") != F.col("embedding_dim"))).alias("n_bad"))
    k = aliases(spark, d).groupBy("video_id").agg(F.count("*").alias("n_keyframes"))
    j = x.join(k, "video_id", "full")
    return j.select("video_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_vectors", "n_keyframes", "n_bad")], F.coalesce(F.col("n_vectors") != F.col("n_ids"), F.lit(False)).alias("repeated"))


@query("""WITH e AS (SELECT DISTINCT video_id, embedding_uri, embedding_id, embedding_dim FROM embedding_result) SELECT video_id, min(embedding_uri) first_uri, count(DISTINCT embedding_uri) n_files, count(DISTINCT embedding_id) n_vectors, sum(embedding_dim * 4)::BIGINT n_bytes FROM e GROUP BY 1""")
def artifact_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Files, vectors and bytes per video."""
    e = table(spark, d, "embedding_result").select("video_id", "embedding_uri", "embedding_id", "embedding_dim").distinct()
    return e.groupBy("video_id").agg(F.min("embedding_uri").alias("first_uri"), F.countDistinct("embedding_uri").alias("n_files"), F.countDistinct("embedding_id").alias("n_vectors"), F.sum(F.col("embedding_dim") * 4).alias("n_bytes"))


@query(f"""WITH {_TR}, {_FR}, e AS (SELECT DISTINCT evidence_id, evidence_type, video_id, original_frame_id, confidence FROM evidence WHERE deleted_at IS NULL AND original_frame_id IS NOT NULL),
a AS (SELECT video_id, original_frame_id, count(*) n, string_agg(evidence_type, ',' ORDER BY evidence_type, evidence_id) kinds FROM e GROUP BY 1, 2)
SELECT alignment_id, event_ordinal, round(coalesce(fr.timestamp_ms, tr.timestamp_ms), 3)::DOUBLE at_ms, fr.video_id IS NOT NULL known, coalesce(n, 0) n_evidence, coalesce(kinds, '') kinds
FROM tr LEFT JOIN fr USING (video_id, original_frame_id) LEFT JOIN a ON a.video_id = tr.video_id AND a.original_frame_id = tr.original_frame_id""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    """Events with their exact frame and its live evidence, where there are any."""
    e = _evidence(spark, d, "evidence_type", "video_id", "original_frame_id", "confidence", "deleted_at").filter("deleted_at is null and original_frame_id is not null")
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_type", "evidence_id"))), lambda x: x["evidence_type"]), ",")
    a = e.groupBy("video_id", "original_frame_id").agg(F.count("*").alias("n"), kinds.alias("kinds"))
    f = frames(spark, d, "timestamp_ms").select("video_id", "original_frame_id", F.col("timestamp_ms").alias("frame_ms"), F.lit(True).alias("found"))
    j = _events(spark, d).join(f, ["video_id", "original_frame_id"], "left").join(a, ["video_id", "original_frame_id"], "left")
    at = F.round(F.coalesce("frame_ms", F.col("timestamp_ms").cast("double")), 3)
    return j.select("alignment_id", "event_ordinal", at.alias("at_ms"), F.col("found").isNotNull().alias("known"), F.coalesce("n", F.lit(0)).alias("n_evidence"), F.coalesce("kinds", F.lit("")).alias("kinds"))


@query(f"""WITH {_TR}, {_FR} SELECT DISTINCT tr.video_id, tr.original_frame_id, CASE WHEN fr.video_id IS NULL THEN 'missing' ELSE 'found' END outcome, fr.timestamp_ms IS NULL AND fr.video_id IS NOT NULL untimed
FROM tr LEFT JOIN fr USING (video_id, original_frame_id) WHERE tr.original_frame_id IS NOT NULL""")
def exact_frame_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Requested frames, each once; missing ones are reported, not lost."""
    want = _events(spark, d).filter("original_frame_id is not null").select("video_id", "original_frame_id").distinct()
    j = want.join(frames(spark, d, "timestamp_ms").withColumn("ok", F.lit(True)), ["video_id", "original_frame_id"], "left")
    return j.select("video_id", "original_frame_id", F.when(F.col("ok").isNull(), "missing").otherwise("found").alias("outcome"), (F.col("timestamp_ms").isNull() & F.col("ok").isNotNull()).alias("untimed"))


@query(f"""WITH {_TR}, {_FR}, x AS (SELECT alignment_id, count(*) n, count(fr.video_id) n_known FROM tr LEFT JOIN fr USING (video_id, original_frame_id) GROUP BY 1) SELECT alignment_id, n FROM x WHERE n = n_known""")
def resolved_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers all of whose frames exist."""
    j = _events(spark, d).join(frames(spark, d).withColumn("ok", F.lit(1)), ["video_id", "original_frame_id"], "left")
    return j.groupBy("alignment_id").agg(F.count("*").alias("n"), F.count("ok").alias("k")).filter("n = k").select("alignment_id", "n")


@query(f"""WITH {_AL}, g AS (SELECT video_id, count(*) n, count(DISTINCT keyframe_no) n_distinct, min(keyframe_no) low, max(keyframe_no) high FROM al GROUP BY 1) SELECT *, low = 1 AND high = n AND n = n_distinct complete FROM g""")
def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether a video's keyframe numbers are exactly 1..n."""
    g = aliases(spark, d).groupBy("video_id").agg(F.count("*").alias("n"), F.countDistinct("keyframe_no").alias("n_distinct"), F.min("keyframe_no").alias("low"), F.max("keyframe_no").alias("high"))
    return g.withColumn("complete", (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("n") == F.col("n_distinct")))


@query(f"""WITH {_AL}, e AS (SELECT DISTINCT video_id, original_frame_id FROM embedding_result), k AS (SELECT video_id, keyframe_no, original_frame_id, row_number() OVER (PARTITION BY video_id ORDER BY keyframe_no) - 1 AS position FROM al WHERE original_frame_id IS NOT NULL)
SELECT k.video_id, keyframe_no, position FROM k ANTI JOIN e USING (video_id, original_frame_id)""")
def pending_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes whose frame has no vector yet, with the place where it belongs."""
    k = scan_entity(aliases(spark, d).filter("original_frame_id is not null"), ["video_id"], "keyframe_no", {"position": ("sum", F.lit(1))}).withColumn("position", F.col("position") - 1)
    return mapping.missing_keys(k, table(spark, d, "embedding_result").select("video_id", "original_frame_id"), ["video_id", "original_frame_id"]).select("video_id", "keyframe_no", "position")


@query("""WITH a AS (SELECT upper(trim(video_id)) video_id, source_span_index, confidence, row_number() OVER (PARTITION BY upper(trim(video_id)), source_span_index ORDER BY ingested_at DESC) k FROM asr_result), b AS (SELECT * FROM a WHERE k = 1)
SELECT video_id, source_span_index, round(coalesce(confidence, avg(confidence) OVER (PARTITION BY video_id), avg(confidence) OVER ()), 6)::DOUBLE confidence FROM b""")
def span_confidence(spark: SparkSession, d: str) -> DataFrame:
    """A span's own confidence, else its video's mean, else the mean of all; the means are aggregates that join back."""
    a = table(spark, d, "asr_result").select(clean_id("video_id").alias("video_id"), "source_span_index", "confidence", "ingested_at")
    a = latest(a, ["video_id", "source_span_index"], "ingested_at")
    mean, whole = a.groupBy("video_id").agg(F.avg("confidence").alias("m")), a.agg(F.avg("confidence").alias("w"))
    j = a.join(mean, "video_id", "left").crossJoin(F.broadcast(whole))  # one row
    return j.select("video_id", "source_span_index", F.round(F.coalesce("confidence", "m", "w"), 6).alias("confidence"))


@query("""WITH x AS (SELECT DISTINCT doc_id, video_id, trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g')) t, greatest(0, least(1, (doc_id % 130 - 10) / 100.0)) c FROM documents WHERE source = 'ocr' AND video_id IS NOT NULL)
SELECT video_id, md5(string_agg(t, ' ' ORDER BY doc_id, t)) text_key, round(avg(c), 6)::DOUBLE confidence, count(*) n_boxes FROM x WHERE t <> '' GROUP BY 1""")
def ocr_frames(spark: SparkSession, d: str) -> DataFrame:
    """Read texts of a video as one record with their mean confidence."""
    x = table(spark, d, "documents").filter("source = 'ocr' and video_id is not null").select("doc_id", "video_id", "text").distinct()
    r = contracts.ocr_records(x.withColumn("c", (F.col("doc_id") % 130 - 10) / 100.0), ["video_id"], "doc_id", "text", "c")
    return r.select("video_id", F.md5("text").alias("text_key"), F.round("confidence", 6).alias("confidence"), "n_boxes")


@query(f"""WITH {_SPANS}, {_TR} SELECT alignment_id, event_ordinal, count(*) n_spans, min(s) first_ms, max(e) last_ms FROM tr JOIN sp ON sp.video_id = tr.video_id AND s <= timestamp_ms AND e >= timestamp_ms GROUP BY 1, 2""")
def visible_speech(spark: SparkSession, d: str) -> DataFrame:
    """Speech visible at an event's time; both ends count."""
    j = temporal.stab(speech_spans(spark, d), _events(spark, d), "video_id", "start_ms", "end_ms", "timestamp_ms", closed=True)
    return j.groupBy("alignment_id", "event_ordinal").agg(F.count("*").alias("n_spans"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


@query(f"""WITH {_SHOTS}, q AS (SELECT DISTINCT video_id, original_frame_id, blur_score::DOUBLE + contrast_score::DOUBLE + entropy_score::DOUBLE v FROM frame_manifest WHERE original_frame_id IS NOT NULL AND NOT isnan(blur_score) AND NOT isnan(contrast_score) AND NOT isnan(entropy_score)),
c AS (SELECT shots.video_id, shot_id, q.original_frame_id, v, row_number() OVER (PARTITION BY shots.video_id, shot_id ORDER BY v DESC, q.original_frame_id) n FROM shots JOIN q ON q.video_id = shots.video_id AND q.original_frame_id BETWEEN start_frame AND least(end_frame, start_frame + 2))
SELECT video_id, shot_id, original_frame_id FROM c WHERE n = 1""")
def first_three_best(spark: SparkSession, d: str) -> DataFrame:
    """The best of a shot's first three frames."""
    s = timeline.shots(frames(spark, d, "scene_change_score"), "scene_change_score", 0.9)
    s = s.withColumn("end_frame", F.least("end_frame", F.col("start_frame") + 2))
    f = frames(spark, d, "blur_score", "contrast_score", "entropy_score").filter("not isnan(blur_score) and not isnan(contrast_score) and not isnan(entropy_score)")
    f = f.withColumn("v", F.col("blur_score").cast("double") + F.col("contrast_score").cast("double") + F.col("entropy_score").cast("double"))
    j = timeline.frames_in_shots(f, s)
    return j.groupBy("video_id", "shot_id").agg(F.max_by("original_frame_id", F.struct(F.col("v"), -F.col("original_frame_id"))).alias("original_frame_id"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) n FROM events) SELECT user_id, event_id, n AS position FROM r WHERE n <= 20""")
def recent_items(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty items of each user."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "ts").withColumn("position", F.row_number().over(w)).filter("position <= 20").select("user_id", "event_id", "position")


@query("""WITH h AS (SELECT query_id, upper(trim(video_id)) video_id, preview_uri, result_no, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response),
o AS (SELECT query_id, video_id, preview_uri, result_no, row_number() OVER (PARTITION BY query_id, preview_uri ORDER BY result_no) i FROM h WHERE k = 1) SELECT query_id, result_no, coalesce(preview_uri, 'r2://media/' || video_id) preview FROM o WHERE i = 1""")
def preview_distinct(spark: SparkSession, d: str) -> DataFrame:
    """One result per preview and query, with a fallback address."""
    r = latest(table(spark, d, "search_response").select("query_id", "result_no", "video_id", "preview_uri", "ingested_at"), ["query_id", "result_no"], "ingested_at").withColumn("video_id", clean_id("video_id"))
    one = r.groupBy("query_id", "preview_uri").agg(F.min_by(F.struct("result_no", "video_id"), "result_no").alias("x"))
    return one.select("query_id", "x.result_no", F.coalesce("preview_uri", F.concat(F.lit("r2://media/"), "x.video_id")).alias("preview"))


@query(f"""WITH {_AL}, {_FR}, {_SPANS}, e AS (SELECT DISTINCT * FROM evidence)
SELECT 'frame_aliases' table_name, 'null_frame' problem, count(*) n FROM al WHERE original_frame_id IS NULL UNION ALL SELECT 'frame_manifest', 'no_clock', count(*) FROM fr WHERE timestamp_ms IS NULL
UNION ALL SELECT 'frame_manifest', 'failed', count(*) FROM fr WHERE decode_status <> 'ok' UNION ALL SELECT 'evidence', 'no_confidence', count(*) FROM e WHERE confidence IS NULL UNION ALL SELECT 'evidence', 'deleted', count(*) FROM e WHERE deleted_at IS NOT NULL
UNION ALL SELECT 'asr_result', 'usable', count(*) FROM sp""")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what is wrong, per table."""
    al, e = aliases(spark, d), _evidence(spark, d, "confidence", "deleted_at", "evidence_type", "video_id", "original_frame_id", "start_ms", "end_ms", "producer", "created_at")
    fr = frames(spark, d, "timestamp_ms", "decode_status")
    rows = [("frame_aliases", "null_frame", al.filter("original_frame_id is null")), ("frame_manifest", "no_clock", fr.filter("timestamp_ms is null")), ("frame_manifest", "failed", fr.filter("decode_status <> 'ok'")), ("evidence", "no_confidence", e.filter("confidence is null")), ("evidence", "deleted", e.filter("deleted_at is not null")), ("asr_result", "usable", speech_spans(spark, d))]
    out = None
    for t, problem, df in rows:
        one = df.agg(F.lit(t).alias("table_name"), F.lit(problem).alias("problem"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
