"""Registered queries of problems 2, 3, 5, 6, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.llm import bpe, canonical, knn, leaks, nearest, runs, sql, topn
from kinolith.plans.evidence import speech_spans
from kinolith.session import clean_id, latest, table


def results_that_count(spark: SparkSession, d: str) -> DataFrame:
    cols = ["dataset_version", "video_id", "original_frame_id", "score"]
    rows = latest(table(spark, d, "search_response").select("query_id", "result_no", *cols, "ingested_at"), ["query_id", "result_no"], "ingested_at")
    rows = rows.withColumn("video_id", clean_id("video_id"))
    return rows.filter(F.col("video_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    order = [topn.By("score", descending=True), topn.By("original_frame_id"), topn.By("query_id"), topn.By("result_no")]
    top = topn.top_n_per_group(results_that_count(spark, d), ["dataset_version", "video_id"], order, 5)
    return top.select("dataset_version", "video_id", "rank_no", "query_id", "result_no")


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "frame_manifest"), "video_id", "original_frame_id", "scene_change_score", "timestamp_ms", 0.002, least=least)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 5).select("video_id", F.col("first_id").alias("first_frame_id"), F.col("last_id").alias("last_frame_id"))


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run, also of one frame, with its count and duration."""
    out = _runs(spark, d, 1)
    return out.select("video_id", F.col("first_id").alias("first_frame_id"), F.col("last_id").alias("last_frame_id"), F.col("n_events").alias("n_frames"), F.round("duration", 3).alias("duration_ms"))


def p3_levels(spark: SparkSession, d: str) -> DataFrame:
    """Runs that follow the level of the score: neighbours within 0.05, and a boundary where it saves more than 0.0005 of squared distance."""
    out = runs.collapse_runs(table(spark, d, "frame_manifest"), "video_id", "original_frame_id", "scene_change_score", "timestamp_ms", 0.05, penalty=0.0005, weight=1.0)
    return out.select("video_id", F.col("first_id").alias("first_frame_id"), F.col("last_id").alias("last_frame_id"), F.col("n_events").alias("n_frames"), F.round("duration", 3).alias("duration_ms"))


def timed_events(spark: SparkSession, d: str) -> DataFrame:
    """video_id, alignment_id, event_ordinal and the event's time; only events without a time of their own look for their frame."""
    cols = ["original_frame_id", "timestamp_ms"]
    events = table(spark, d, "trake_alignment").select("alignment_id", "event_ordinal", clean_id("video_id").alias("video_id"), *cols).distinct()
    timed = events.filter("timestamp_ms is not null").select("video_id", "alignment_id", "event_ordinal", F.col("timestamp_ms").cast("double").alias("t"))
    open_ = events.filter("timestamp_ms is null and original_frame_id is not null").drop("timestamp_ms")
    frames = table(spark, d, "frame_manifest").select("video_id", "original_frame_id", F.col("timestamp_ms").alias("t")).filter("t is not null and original_frame_id is not null")
    clock = open_.join(frames, ["video_id", "original_frame_id"]).groupBy("video_id", "alignment_id", "event_ordinal").agg(F.min("t").alias("t"))
    return timed.unionByName(clock)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest.nearest_in_time(timed_events(spark, d), speech_spans(spark, d), "video_id", "t", "start_ms", "source_span_index", 1500, keep=["alignment_id", "event_ordinal"])
    return near.select("alignment_id", "event_ordinal", "source_span_index")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest_vectors(table(spark, d, "embedding_result"), "embedding_id", "vector", "model_name", "embedding_dim", 10, least=0.9)
    pair = near.groupBy(F.least("embedding_id", "neighbour_id").alias("embedding_id_a"), F.greatest("embedding_id", "neighbour_id").alias("embedding_id_b")).agg(F.count("*").alias("n"))
    return pair.filter("n = 2").drop("n")


def p6_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of every vector whose number is divisible by 50, against all vectors."""
    asks = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 50 == 0
    near = knn.nearest_vectors(table(spark, d, "embedding_result"), "embedding_id", "vector", "model_name", "embedding_dim", 10, queries=asks, probes=0.03, list_rows=96)
    return near.select("embedding_id", "neighbour_id", "rank_no", F.round("cosine", 5).alias("cosine"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents").select("doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_item").select("item_id", "text"))
    return found.filter("kind = 'verbatim'").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim and paraphrased leaks with their evidence."""
    found = leaks.find_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_item").select("item_id", "text"), cosine=0.9, paraphrases=True)
    return found.withColumn("cosine", F.round("cosine", 4))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alikes(table(spark, d, "documents").select("doc_id", "text"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of texts that look the same, per document."""
    return canonical.look_alike_classes(table(spark, d, "documents").select("doc_id", "text"))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return table(spark, d, "documents").select("doc_id", "text").distinct().select("doc_id", canonical.consistent("text").alias("form"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p3_found, p3_runs, p3_levels, p5_found, p6_found, p6_knn, p8_ids, p9_found, p9_leaks, p10_found, p10_classes, p10_texts)}


def oracle_sql() -> dict[str, str]:
    return sql.SQL
