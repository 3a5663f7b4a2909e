"""Keys between tables, loads, counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinolith.functions import num, text
from kinolith.operators import mapping
from kinolith.plans.catalog import Catalog
from kinolith.plans.evidence import speech_spans
from kinolith.plans.evidence_sql import _SPANS
from kinolith.plans.timeline import frames
from kinolith.session import clean_id, latest, table
from kinolith.sources import writers

CATALOG = Catalog()
query = CATALOG.query
TABLES = ("videos_manifest", "frame_manifest", "frame_aliases", "evidence", "search_response", "asr_result", "trake_alignment", "embedding_result", "stats_raw", "documents")
_AL = "al AS (SELECT DISTINCT upper(trim(video_id)) video_id, keyframe_no, original_frame_id, timestamp_ms, thumbnail_object_key, metadata, created_at FROM frame_aliases)"


def aliases(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "frame_aliases")
    return a.select(clean_id("video_id").alias("video_id"), "keyframe_no", "original_frame_id", "timestamp_ms", "thumbnail_object_key", "metadata", "created_at").distinct()


@query(" UNION ALL ".join(f"SELECT '{t}' table_name, count(*) n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) n_distinct FROM {t}" for t in TABLES))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and different rows of every table; vectors count by value."""
    out = None
    for t in TABLES:
        df = table(spark, d, t)
        one = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.lit(t).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT status, count(*) n, count(DISTINCT alignment_id) n_alignments FROM (SELECT DISTINCT * REPLACE (upper(trim(video_id)) AS video_id) FROM trake_alignment) GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trake_alignment").withColumn("video_id", clean_id("video_id")).distinct()
    return t.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("alignment_id").alias("n_alignments"))


@query(f"""WITH {_AL} SELECT video_id, original_frame_id, min(keyframe_no) representative, count(*) alias_count, string_agg(DISTINCT keyframe_no, ',' ORDER BY keyframe_no) numbers FROM al WHERE original_frame_id IS NOT NULL GROUP BY 1, 2""")
def alias_groups(spark: SparkSession, d: str) -> DataFrame:
    return mapping.alias_groups(aliases(spark, d).filter("original_frame_id is not null"), ["video_id", "original_frame_id"], "keyframe_no")


@query(f"""WITH {_AL}, g AS (SELECT video_id, original_frame_id, count(*) n FROM al WHERE original_frame_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
SELECT video_id, count(*) n_groups, sum(n)::BIGINT n_rows, (sum(n) - count(*))::BIGINT n_extra FROM g GROUP BY 1""")
def dup_stats(spark: SparkSession, d: str) -> DataFrame:
    g = mapping.repeated_keys(aliases(spark, d).filter("original_frame_id is not null"), ["video_id", "original_frame_id"])
    return g.groupBy("video_id").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_extra"))


@query(f"""WITH {_AL} SELECT video_id, keyframe_no, row_number() OVER (PARTITION BY video_id, original_frame_id ORDER BY keyframe_no) ordinal, count(*) OVER (PARTITION BY video_id, original_frame_id) group_size FROM al WHERE original_frame_id IS NOT NULL""")
def alias_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return mapping.with_ordinals(aliases(spark, d).filter("original_frame_id is not null"), ["video_id", "original_frame_id"], "keyframe_no").select("video_id", "keyframe_no", "ordinal", "group_size")


@query(f"""WITH {_AL} SELECT video_id, keyframe_no, original_frame_id FROM al ANTI JOIN (SELECT DISTINCT video_id, original_frame_id FROM frame_manifest) f USING (video_id, original_frame_id) WHERE original_frame_id IS NOT NULL""")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    a = aliases(spark, d).filter("original_frame_id is not null").select("video_id", "keyframe_no", "original_frame_id")
    return mapping.missing_keys(a, table(spark, d, "frame_manifest").select("video_id", "original_frame_id"), ["video_id", "original_frame_id"]).select("video_id", "keyframe_no", "original_frame_id")


@query(f"""WITH {_AL}, f AS (SELECT DISTINCT video_id, original_frame_id, round(timestamp_ms)::BIGINT ms FROM frame_manifest WHERE timestamp_ms IS NOT NULL)
SELECT DISTINCT video_id, original_frame_id, al.timestamp_ms left_value, ms right_value FROM al JOIN f USING (video_id, original_frame_id) WHERE al.timestamp_ms <> ms""")
def clock_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes whose time differs from their frame's."""
    f = frames(spark, d, "timestamp_ms").filter("timestamp_ms is not null").withColumn("timestamp_ms", F.round("timestamp_ms").cast("long"))
    return mapping.conflicts(aliases(spark, d), f, ["video_id", "original_frame_id"], "timestamp_ms")


@query("""WITH a AS (SELECT DISTINCT video_id FROM frame_manifest), b AS (SELECT DISTINCT video_id FROM videos_manifest)
SELECT video_id, 'missing' side FROM b ANTI JOIN a USING (video_id) UNION ALL SELECT video_id, 'extra' FROM a ANTI JOIN b USING (video_id)""")
def video_set_difference(spark: SparkSession, d: str) -> DataFrame:
    return mapping.set_difference(table(spark, d, "frame_manifest"), table(spark, d, "videos_manifest"), "video_id")


@query(f"""WITH {_AL}, e AS (SELECT DISTINCT embedding_id, video_id FROM embedding_result), a AS (SELECT video_id, count(*) a FROM al GROUP BY 1), b AS (SELECT video_id, count(*) b FROM e GROUP BY 1)
SELECT video_id, coalesce(a, 0) n_left, coalesce(b, 0) n_right FROM a FULL JOIN b USING (video_id) WHERE coalesce(a, 0) <> coalesce(b, 0)""")
def count_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return mapping.reconcile_counts(aliases(spark, d), table(spark, d, "embedding_result").select("embedding_id", "video_id").distinct(), "video_id")


@query("""WITH s AS (SELECT o_orderkey, o_custkey, 'R' o_orderstatus, round(o_totalprice * 2, 2) o_totalprice FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 100 = 7)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT * FROM s""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Insert or replace by key."""
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = t.filter("o_orderkey % 10 = 3").withColumn("o_orderstatus", F.lit("R")).withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    fresh = t.filter("o_orderkey % 100 = 7").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000).withColumn("o_orderstatus", F.lit("N"))
    return mapping.upsert(t, changed.unionByName(fresh), ["o_orderkey"])


@query("""WITH t AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT * FROM t UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderkey NOT IN (SELECT o_orderkey FROM t)""")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return mapping.insert_absent(o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), o.filter("o_totalprice > 200000").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) revision FROM orders)
SELECT o_custkey, max(revision) + 1 next_revision, arg_max(o_orderkey, revision) latest_key FROM o GROUP BY 1""")
def revisions(spark: SparkSession, d: str) -> DataFrame:
    """The latest revision of each group and the next number."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey").withColumn("revision", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    last = mapping.latest_revision(o, ["o_custkey"]).select("o_custkey", F.col("o_orderkey").alias("latest_key"))
    return mapping.next_revision(o, ["o_custkey"]).join(last, "o_custkey")


@query("""SELECT DISTINCT file_id, producer, file_no FROM stats_raw WHERE file_no > 2 AND (file_id, md5(producer)) NOT IN (SELECT file_id, md5(producer) FROM stats_raw WHERE file_no % 2 = 0)""")
def pending_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs without a finished run of the same fingerprint."""
    s = table(spark, d, "stats_raw").select("file_id", "producer", "file_no").distinct().withColumn("fp", F.md5("producer"))
    return mapping.pending(s.filter("file_no > 2"), s.filter("file_no % 2 = 0"), ["file_id"], "fp").select("file_id", "producer", "file_no")


@query("""SELECT video_id, count(DISTINCT fps_num * 1000000 + fps_den) n_values FROM frame_manifest GROUP BY 1 HAVING count(DISTINCT fps_num * 1000000 + fps_den) > 1""")
def single_value_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Videos with more than one frame rate."""
    f = table(spark, d, "frame_manifest").select("video_id", (F.col("fps_num") * 1_000_000 + F.col("fps_den")).alias("rate"))
    return mapping.single_value(f, ["video_id"], "rate")


@query(f"""WITH {_AL}, e AS (SELECT DISTINCT evidence_id, evidence_type, video_id, original_frame_id FROM evidence WHERE deleted_at IS NULL AND original_frame_id IS NOT NULL)
SELECT al.video_id, keyframe_no, count(*) FILTER (evidence_type = 'caption') n_captions, count(*) FILTER (evidence_type = 'ocr') n_ocr, count(*) FILTER (evidence_type = 'object') n_objects, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id), '') ids
FROM al LEFT JOIN e ON e.video_id = al.video_id AND e.original_frame_id = al.original_frame_id GROUP BY 1, 2""")
def nest_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes with their annotations by kind."""
    e = table(spark, d, "evidence").filter("deleted_at is null and original_frame_id is not null").select("evidence_id", "evidence_type", "video_id", "original_frame_id").distinct()
    by = e.groupBy("video_id", "original_frame_id").agg(*[F.count_if(F.col("evidence_type") == k).alias(n) for k, n in (("caption", "n_captions"), ("ocr", "n_ocr"), ("object", "n_objects"))], F.array_join(F.array_sort(F.collect_list("evidence_id")), ",").alias("ids"))
    j = aliases(spark, d).select("video_id", "keyframe_no", "original_frame_id").join(by, ["video_id", "original_frame_id"], "left")
    return j.select("video_id", "keyframe_no", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_captions", "n_ocr", "n_objects")], F.coalesce("ids", F.lit("")).alias("ids"))


@query("""WITH f AS (SELECT DISTINCT video_id, original_frame_id, timestamp_ms, timestamp_source FROM frame_manifest)
SELECT video_id, count(*) n_frames, min(original_frame_id) first_id, max(original_frame_id) last_id, count(DISTINCT timestamp_source) n_sources, round(min(timestamp_ms), 3)::DOUBLE first_ms, round(max(timestamp_ms), 3)::DOUBLE last_ms FROM f GROUP BY 1""")
def timeline_index(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frame_manifest").select("video_id", "original_frame_id", "timestamp_ms", "timestamp_source").distinct()
    return f.groupBy("video_id").agg(F.count("*").alias("n_frames"), F.min("original_frame_id").alias("first_id"), F.max("original_frame_id").alias("last_id"), F.countDistinct("timestamp_source").alias("n_sources"), F.round(F.min("timestamp_ms"), 3).alias("first_ms"), F.round(F.max("timestamp_ms"), 3).alias("last_ms"))


@query("""WITH f AS (SELECT DISTINCT video_id, original_frame_id, timestamp_source FROM frame_manifest WHERE timestamp_source IS NOT NULL), c AS (SELECT video_id, timestamp_source, count(*) n FROM f GROUP BY 1, 2)
SELECT video_id, arg_max(timestamp_source, {'n': n, 's': timestamp_source}) source_mode FROM c GROUP BY 1""")
def source_mode(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent clock source; the later name wins ties."""
    f = table(spark, d, "frame_manifest").filter("timestamp_source is not null").select("video_id", "original_frame_id", "timestamp_source").distinct()
    c = f.groupBy("video_id", "timestamp_source").agg(F.count("*").alias("n"))
    return c.groupBy("video_id").agg(F.max_by("timestamp_source", F.struct("n", "timestamp_source")).alias("source_mode"))


@query("""WITH v AS (SELECT DISTINCT * FROM videos_manifest), k AS (SELECT upper(trim(video_id)) video_id, count(DISTINCT keyframe_no) n FROM frame_aliases GROUP BY 1), f AS (SELECT video_id, count(DISTINCT original_frame_id) n FROM frame_manifest GROUP BY 1)
SELECT codec, count(*) n_videos, sum(duration_ms)::BIGINT duration_ms, coalesce(sum(f.n), 0)::BIGINT n_frames, coalesce(sum(k.n), 0)::BIGINT n_keyframes, round(coalesce(sum(k.n), 0) / (sum(duration_ms) / 3600000.0), 3)::DOUBLE per_hour,
 round(1 - coalesce(sum(k.n), 0) / nullif(coalesce(sum(f.n), 0), 0), 6)::DOUBLE removed FROM v LEFT JOIN k USING (video_id) LEFT JOIN f USING (video_id) GROUP BY 1""")
def funnel_report(spark: SparkSession, d: str) -> DataFrame:
    """Frames, keyframes and their density per codec."""
    v = table(spark, d, "videos_manifest").select("video_id", "codec", "duration_ms", "created_at").distinct()
    k = table(spark, d, "frame_aliases").select(clean_id("video_id").alias("video_id"), "keyframe_no").distinct().groupBy("video_id").agg(F.count("*").alias("k"))
    f = table(spark, d, "frame_manifest").filter("original_frame_id is not null").select("video_id", "original_frame_id").distinct().groupBy("video_id").agg(F.count("*").alias("f"))
    g = v.join(k, "video_id", "left").join(f, "video_id", "left").groupBy("codec").agg(F.count("*").alias("n_videos"), F.sum("duration_ms").alias("duration_ms"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_frames"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_keyframes"))
    return g.withColumn("per_hour", F.round(F.col("n_keyframes") / (F.col("duration_ms") / 3600000.0), 3)).withColumn("removed", F.round(1 - F.col("n_keyframes") / F.nullif("n_frames", F.lit(0)), 6))


@query("""WITH d AS (SELECT lang, n_chars FROM (SELECT DISTINCT doc_id, lang, n_chars FROM documents))
SELECT lang, round(avg(n_chars), 6)::DOUBLE mean_chars, quantile_cont(n_chars, 0.5)::DOUBLE p50, quantile_cont(n_chars, 0.95)::DOUBLE p95 FROM d GROUP BY 1""")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and percentiles with linear interpolation."""
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars").distinct()
    return x.groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.percentile("n_chars", F.lit(0.5)).alias("p50"), F.percentile("n_chars", F.lit(0.95)).alias("p95"))


@query(f"""WITH {_AL}, t AS (SELECT DISTINCT alignment_id, event_ordinal, upper(trim(video_id)) video_id, timestamp_ms t FROM trake_alignment WHERE timestamp_ms IS NOT NULL),
m AS (SELECT video_id, alignment_id, event_ordinal, min(abs(al.timestamp_ms - t)) d FROM t LEFT JOIN al USING (video_id) GROUP BY 1, 2, 3)
SELECT video_id, count(*) n, round(avg(CASE WHEN d <= 2000 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE covered FROM m GROUP BY 1""")
def coverage_at_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Share of events with a keyframe within two seconds, by blocks of the tolerance."""
    from kinolith.operators.temporal import nearest_row

    t = table(spark, d, "trake_alignment").filter("timestamp_ms is not null").select("alignment_id", "event_ordinal", clean_id("video_id").alias("video_id"), F.col("timestamp_ms").alias("t")).distinct()
    a = aliases(spark, d).select("video_id", F.col("timestamp_ms").alias("k")).distinct()
    near = nearest_row(t, a, "video_id", "t", "k", ["k"], ["k"], 2000, block=600_000)
    return near.groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("distance").isNotNull(), 1.0).otherwise(0.0)), 6).alias("covered"))


@query("""WITH m AS (SELECT model_version, producer, count(*) n, count(*) FILTER (coalesce(end_ms, asr_end_ms) <= coalesce(start_ms, asr_start_ms)) n_no_length, count(*) FILTER (coalesce(end_ms, asr_end_ms) IS NULL) n_open, count(*) FILTER (start_ms IS NULL) n_old_form,
  round(avg(confidence), 6)::DOUBLE mean_confidence FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upper(trim(video_id)), source_span_index ORDER BY ingested_at DESC) k FROM asr_result) WHERE k = 1) GROUP BY 1, 2) SELECT * FROM m""")
def speech_anomalies(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "asr_result").withColumn("video_id", clean_id("video_id")).select("video_id", "source_span_index", "start_ms", "end_ms", "asr_start_ms", "asr_end_ms", "confidence", "model_version", "producer", "ingested_at")
    a = latest(a, ["video_id", "source_span_index"], "ingested_at").withColumn("s", F.coalesce("start_ms", "asr_start_ms")).withColumn("e", F.coalesce("end_ms", "asr_end_ms"))
    return a.groupBy("model_version", "producer").agg(F.count("*").alias("n"), F.count_if(F.col("e") <= F.col("s")).alias("n_no_length"), F.count_if(F.col("e").isNull()).alias("n_open"), F.count_if(F.col("start_ms").isNull()).alias("n_old_form"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"WITH {_SPANS} SELECT video_id, count(*) n, sum(e - s)::BIGINT total_ms, min(s) first_ms, max(e) last_ms FROM sp GROUP BY 1")
def speech_index(spark: SparkSession, d: str) -> DataFrame:
    s = speech_spans(spark, d)
    return s.groupBy("video_id").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


@query("""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND trim(text) <> ''), n AS (SELECT md5(trim(regexp_replace(text, '[\\s\\x0b\\x{A0}\\x{3000}]+', ' ', 'g'))) h, doc_id FROM d)
SELECT min(doc_id) first_doc, count(*) n_docs FROM n GROUP BY h HAVING count(*) > 1""")
def text_groups(spark: SparkSession, d: str) -> DataFrame:
    """One translation job per distinct caption text: groups of documents with equal text."""
    x = table(spark, d, "documents").select("doc_id", "text").filter("text is not null and trim(text) <> ''").distinct()
    return x.groupBy(F.md5(text.collapse("text")).alias("h")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs")).filter("n_docs > 1").drop("h")


@query(f"""WITH {_AL} SELECT video_id, keyframe_no, 'kf_' || substr(sha256(video_id || chr(31) || keyframe_no || chr(31) || coalesce(original_frame_id::VARCHAR, '')), 1, 32) stable_id,
 json_extract_string(metadata, '$.selected_by') selected_by, try_cast(json_extract_string(metadata, '$.shot_id') AS BIGINT) shot_id FROM al""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic ids and fields of the JSON metadata."""
    a = aliases(spark, d)
    return a.select("video_id", "keyframe_no", num.stable_id("kf", "video_id", "keyframe_no", "original_frame_id").alias("stable_id"), F.get_json_object("metadata", "$.selected_by").alias("selected_by"), F.get_json_object("metadata", "$.shot_id").try_cast("long").alias("shot_id"))


@query(f"""WITH {_AL}, k AS (SELECT video_id, keyframe_no, list_transform(regexp_extract_all(lower(thumbnail_object_key), '([0-9]+|[^0-9]+)', 1), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN chr(1) || lpad(length(ltrim(p, '0'))::VARCHAR, 10, '0') || ltrim(p, '0') || chr(1) ELSE p END) ps
 FROM al WHERE thumbnail_object_key IS NOT NULL) SELECT video_id, keyframe_no, array_to_string(ps, '') sort_key FROM k""")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Object keys in natural order."""
    a = aliases(spark, d).filter("thumbnail_object_key is not null")
    return a.select("video_id", "keyframe_no", text.natural_key("thumbnail_object_key").alias("sort_key"))


@query("""WITH v AS (SELECT DISTINCT original_filename, duration_ms, codec FROM videos_manifest)
SELECT CASE WHEN regexp_matches(original_filename, '^[=+\\-@]') THEN '''' || original_filename ELSE original_filename END || ',' || duration_ms || ',' || coalesce(codec, '') line FROM v""")
def submission_csv(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos_manifest").select("original_filename", "duration_ms", "codec").distinct()
    return writers.submission_csv(v, ["original_filename", "duration_ms", "codec"])


@query("""SELECT query_id, count(*) n, min(rank) first_rank, max(rank) last_rank FROM (SELECT query_id, unnest(range(1, len(evidence_ids) + 1)) rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1) GROUP BY 1""")
def run_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a run in array order."""
    r = latest(table(spark, d, "search_response").select("query_id", "result_no", "evidence_ids", "ingested_at"), ["query_id", "result_no"], "ingested_at")
    x = r.select("query_id", F.transform("evidence_ids", lambda e: F.struct(e.alias("evidence_id"))).alias("items"))
    return writers.run_snapshot(x, "items").groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


@query("""SELECT video_id, CASE WHEN bool_and(ok) THEN 'completed' ELSE 'partial' END status, string_agg(task, ',' ORDER BY task) FILTER (ok) available, string_agg(task, ',' ORDER BY task) FILTER (NOT ok) failed FROM (
 SELECT v.video_id, t.task, EXISTS (SELECT 1 FROM evidence e WHERE e.video_id = v.video_id AND e.evidence_type = t.task AND e.deleted_at IS NULL) ok FROM (SELECT DISTINCT video_id FROM videos_manifest) v, (SELECT unnest(['asr', 'caption', 'object', 'ocr']) task) t) GROUP BY 1""")
def feature_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Features a video has and lacks."""
    tasks = ["asr", "caption", "object", "ocr"]
    v = table(spark, d, "videos_manifest").select("video_id").distinct()
    e = table(spark, d, "evidence").filter("deleted_at is null").filter(F.col("evidence_type").isin(tasks)).groupBy("video_id").agg(F.array_sort(F.collect_set("evidence_type")).alias("has"))
    j = v.join(e, "video_id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    lacks = F.array_except(F.array(*[F.lit(t) for t in tasks]), F.col("has"))
    return j.select("video_id", F.when(F.size("has") == 4, "completed").otherwise("partial").alias("status"), F.when(F.size("has") > 0, F.array_join("has", ",")).alias("available"), F.when(F.size(lacks) > 0, F.array_join(lacks, ",")).alias("failed"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[{text.VIETNAMESE}]') THEN 'vi' WHEN regexp_matches(lower(text), '[a-z]') THEN 'en' ELSE 'unknown' END detected,
 len(regexp_extract_all(text, '["“”'']([^"“”'']{{1,200}})["“”'']', 1)) n_quoted FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)""")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "text").filter("text is not null").distinct()
    return x.select("doc_id", text.language("text").alias("detected"), F.size(text.quoted_phrases("text")).alias("n_quoted"))


@query("""SELECT doc_id, array_to_string(list_slice(list_distinct_ordered, 1, 16), ' ') concepts FROM (SELECT doc_id, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]) list_distinct_ordered
 FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1), lambda t: length(t) > 2 AND NOT list_contains(['the', 'and', 'with', 'that'], t)) w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)))""")
def concept_tokens(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "text").filter("text is not null").distinct()
    return x.select("doc_id", F.array_join(text.concept_tokens("text", ["the", "and", "with", "that"]), " ").alias("concepts"))


@query("""SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '[\\s\\x0b\\x{A0}\\x{3000}]+', ' ', 'g'))) speech_key FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)""")
def speech_normal(spark: SparkSession, d: str) -> DataFrame:
    """NFC with collapsed blanks."""
    x = table(spark, d, "documents").select("doc_id", "text").filter("text is not null").distinct()
    return x.select("doc_id", F.md5(text.speech_text("text")).alias("speech_key"))


@query("""SELECT doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(text)), 'đ', 'd'), '[^\\p{L}\\p{N}]+', ' ', 'g'))) folded FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)""")
def folded_labels(spark: SparkSession, d: str) -> DataFrame:
    """Marks stripped, d-stroke as d, lower case, letters and digits only."""
    x = table(spark, d, "documents").select("doc_id", "text").filter("text is not null").distinct()
    return x.select("doc_id", F.md5(text.fold("text")).alias("folded"))


@query()
def folded_text(spark: SparkSession, d: str) -> DataFrame:
    """Marks stripped, letters and digits only, and the other normal forms as digests."""
    x = table(spark, d, "documents").select("doc_id", "text").filter("text is not null").distinct()
    return x.select("doc_id", F.md5(text.fold("text")).alias("folded"), F.md5(text.ocr_text("text")).alias("ocr"), F.md5(text.retrieval_text("text")).alias("retrieval"))


@query("""SELECT query_id, result_no, round(greatest(0.1, 1 + ((score * 100 - 50) / 50) * 0.4), 6)::DOUBLE rerank, CASE WHEN end_ms - start_ms < 400 THEN 0.5 WHEN end_ms - start_ms BETWEEN 1000 AND 120000 THEN 1.2 WHEN end_ms - start_ms > 900000 THEN 0.8 ELSE 1.0 END::DOUBLE step,
 round(greatest(0.0, least(100.0, coalesce(start_ms / nullif(end_ms, 0) * 100, 0.0))), 6)::DOUBLE pct FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1 AND isfinite(score)""")
def score_functions(spark: SparkSession, d: str) -> DataFrame:
    r = latest(table(spark, d, "search_response").select("query_id", "result_no", "score", "start_ms", "end_ms", "ingested_at"), ["query_id", "result_no"], "ingested_at").filter("score is not null and not isnan(score) and abs(score) < double('inf')")
    return r.select("query_id", "result_no", F.round(num.rerank_multiplier(F.col("score") * 100, 0.4), 6).alias("rerank"), num.transition_multiplier(F.col("end_ms") - F.col("start_ms")).alias("step"), F.round(num.percent("start_ms", "end_ms"), 6).alias("pct"))


@query("""SELECT s_suppkey, (ntile(7) OVER (ORDER BY s_suppkey) - 1)::INT batch, ((row_number() OVER (ORDER BY s_suppkey) - 1) % 7)::INT turn FROM supplier""")
def contiguous_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt to seven batches as stretches and in turn."""
    s = table(spark, d, "supplier").select("s_suppkey")
    turn = mapping.deal(s, "s_suppkey", 7, False).withColumnRenamed("batch", "turn")
    return mapping.deal(s, "s_suppkey", 7, True).join(turn, "s_suppkey")


@query("""WITH b AS (SELECT s_suppkey pos, 1 n, s_name FROM supplier UNION ALL SELECT s_suppkey, 0, 'new ' || s_name FROM supplier WHERE s_suppkey % 9 = 4) SELECT s_name, row_number() OVER (ORDER BY pos, n) - 1 place FROM b""")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """New rows put before those that hold their position, all numbered again."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    new = s.filter("s_suppkey % 9 = 4").withColumn("s_name", F.concat(F.lit("new "), "s_name"))
    return mapping.insert_at(s, new, "s_suppkey").select("s_name", "place")


@query("""SELECT query_id, confidence_rank, video_id FROM (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY best, first_no, video_id)::INT confidence_rank FROM (SELECT query_id, upper(trim(video_id)) video_id, min(-score) best, arg_min(result_no, {'s': -score, 'r': result_no}) first_no FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1 AND video_id IS NOT NULL AND isfinite(score) GROUP BY 1, 2)) WHERE confidence_rank <= 3""")
def queue_fill(spark: SparkSession, d: str) -> DataFrame:
    """The first three different videos of each query, by score and then result number."""
    r = latest(table(spark, d, "search_response").select("query_id", "result_no", "video_id", "score", "ingested_at"), ["query_id", "result_no"], "ingested_at").withColumn("video_id", clean_id("video_id"))
    r = r.filter("video_id is not null and score is not null and not isnan(score) and abs(score) < double('inf')").withColumn("below", -F.col("score"))
    q = mapping.ordered_distinct(r, ["query_id"], "video_id", ["below", "result_no"], 3)
    return q.select("query_id", F.col("place").alias("confidence_rank"), "video_id")
