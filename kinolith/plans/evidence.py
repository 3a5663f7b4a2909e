"""Queries of problems 1, 4 and 7 over the tables of video evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.operators import drift, intervals, orphans
from kinolith.session import clean_id, latest, stage, table

STATS_TARGET = {
    "n_after_cosine": "bigint", "n_frames_manifest": "bigint", "n_frames_raw_est": "bigint", "n_shots": "bigint", "n_candidates": "bigint",
    "n_after_quality": "bigint", "n_after_phash": "bigint", "n_keyframes": "bigint", "duration_s": "double", "elapsed_s": "double",
    "fps": "string", "sbd_method": "string", "embedded": "boolean",
}


def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null reference of frame_aliases and search_response, in the shape of the orphan store."""
    alias = table(spark, d, "frame_aliases").select(clean_id("video_id").alias("v"), "keyframe_no", "original_frame_id", F.col("created_at").cast("timestamp").alias("at"))
    key = F.concat_ws("/", F.coalesce("v", F.lit("")), F.col("keyframe_no").cast("string"))
    to_video = alias.filter("v is not null").select(
        F.lit("frame_aliases").alias("ref_table"), key.alias("ref_key"), F.lit("video_id").alias("ref_field"), F.lit("videos_manifest").alias("parent_table"), F.col("v").alias("target_key"), F.col("at").alias("ref_at")
    )
    video = table(spark, d, "videos_manifest").select(clean_id("video_id").alias("v")).distinct()
    to_frame = alias.filter("v is not null and original_frame_id is not null").join(video, "v", "left_semi").select(
        F.lit("frame_aliases").alias("ref_table"), key.alias("ref_key"), F.lit("original_frame_id").alias("ref_field"), F.lit("frame_manifest").alias("parent_table"),
        F.concat_ws("/", "v", F.col("original_frame_id").cast("string")).alias("target_key"), F.col("at").alias("ref_at"),
    )
    result = latest(table(spark, d, "search_response").select("query_id", "result_no", "evidence_ids", "created_at", "ingested_at"), ["query_id", "result_no"], "ingested_at")
    to_evidence = result.select(
        F.lit("search_response").alias("ref_table"), F.concat_ws("/", "query_id", F.col("result_no").cast("string")).alias("ref_key"), F.lit("evidence_ids").alias("ref_field"), F.lit("evidence").alias("parent_table"),
        F.explode(F.array_distinct("evidence_ids")).alias("target_key"), F.col("created_at").cast("timestamp").alias("ref_at"),
    )
    return to_video.unionByName(to_frame).unionByName(to_evidence).filter("target_key is not null")


def parent_rows(spark: SparkSession, d: str) -> DataFrame:
    """Births and deletions of videos and evidence; frames have no time, so they were always there."""
    ts = lambda c: F.col(c).cast("timestamp")
    video = table(spark, d, "videos_manifest").select(F.lit("videos_manifest").alias("parent_table"), clean_id("video_id").alias("target_key"), ts("created_at").alias("born_at"), ts("deleted_at").alias("gone_at"))
    evidence = table(spark, d, "evidence").select(F.lit("evidence").alias("parent_table"), F.col("evidence_id").alias("target_key"), ts("created_at").alias("born_at"), ts("deleted_at").alias("gone_at"))
    none = F.lit(None).cast("timestamp")
    frame = table(spark, d, "frame_manifest").filter("original_frame_id is not null").select(
        F.lit("frame_manifest").alias("parent_table"), F.concat_ws("/", clean_id("video_id"), F.col("original_frame_id").cast("string")).alias("target_key"), none.alias("born_at"), none.alias("gone_at")
    )
    return video.unionByName(evidence).unionByName(frame)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    store = orphans.replay(spark, reference_rows(spark, d), parent_rows(spark, d))
    return store.orphans().select("ref_table", "ref_key", "ref_field", "target_key")  # a field has one parent table


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot: references and orphans by kind, per table, field and month of the referring row."""
    return orphans.replay(spark, reference_rows(spark, d), parent_rows(spark, d)).snapshot()


def p1_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots of a history that comes in four deltas of time: what was open after each, per table, field and month."""
    s = orphans.replay(spark, reference_rows(spark, d), parent_rows(spark, d), epochs=4).snapshots()
    return s.drop("batch")


def speech_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans that count: video_id, source_span_index, start_ms, end_ms."""
    cols = ["source_span_index", "start_ms", "end_ms", "asr_start_ms", "asr_end_ms", "ingested_at"]
    rows = table(spark, d, "asr_result").select(clean_id("video_id").alias("video_id"), *cols)
    rows = latest(rows, ["video_id", "source_span_index"], "ingested_at")
    rows = rows.select("video_id", "source_span_index", F.coalesce("start_ms", "asr_start_ms").alias("start_ms"), F.coalesce("end_ms", "asr_end_ms").alias("end_ms"))
    return rows.filter("video_id is not null and end_ms > start_ms")


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    """Every speech period of a video with its spans and the silence before it."""
    p = intervals.merge_intervals(speech_spans(spark, d), "video_id", "start_ms", "end_ms")
    return p.select("video_id", "start_ms", "end_ms", "n_spans", "prev_end_ms")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    p = intervals.merge_intervals(speech_spans(spark, d), "video_id", "start_ms", "end_ms")
    gap = F.col("start_ms") - F.col("prev_end_ms")
    rows = F.array(
        F.when(F.col("n_spans") >= 2, F.struct(F.lit("period").alias("kind"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))),
        F.when(gap.between(1, 600_000), F.struct(F.lit("gap").alias("kind"), F.col("prev_end_ms").alias("a"), F.col("start_ms").alias("b"))),
    )
    x = p.select("video_id", F.explode(F.array_compact(rows)).alias("x"))
    return x.select(F.col("x.kind").alias("kind"), "video_id", F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms"))


def _stats(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return drift.load(rows, "payload", STATS_TARGET, drift.spelling_blocks(table(spark, d, "stats_names")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stats_raw").select("producer", "file_no", "file_id", "payload")
    layouts = stage(drift.file_layouts(_stats(spark, d, rows), ["producer", "file_no", "file_id"]), "layouts")  # used twice
    return drift.layout_changes(layouts, "producer", "file_no", "file_id").select("file_id", "field_name", "change")


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """All records in one typed table, with what is left in the rescue."""
    rows = latest(table(spark, d, "stats_raw").select("file_id", "producer", "file_no", "record_no", "written_at", "payload"), ["file_id", "record_no"], "written_at")
    return _stats(spark, d, rows).drop("payload", "seen")


def p7_typed(spark: SparkSession, d: str) -> DataFrame:
    """The typed columns of all records."""
    return p7_table(spark, d).select("file_id", "record_no", "readable", *STATS_TARGET)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_counts, p1_snapshots, p4_found, p4_periods, p7_found, p7_table, p7_typed)}
