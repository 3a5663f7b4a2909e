"""Queries that write a table in a format and read it back: every reader and sink meets the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.functions import text, vector
from kinolith.operators import mapping
from kinolith.plans.catalog import Catalog
from kinolith.plans.ingest import _AL, aliases
from kinolith.plans.retrieval import _TRGM, PROBE_TEXT, _trigrams
from kinolith.plans.timeline import _FR, frames
from kinolith.session import latest, own_dir, stage, table
from kinolith.sources import files, readers, vectors, writers

CATALOG = Catalog()
query = CATALOG.query


def _at(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("""WITH v AS (SELECT DISTINCT video_id, codec, duration_ms, fps FROM videos_manifest), k AS (SELECT unnest(['parquet', 'csv', 'json', 'jsonl']) kind) SELECT kind, video_id, codec, duration_ms, fps FROM v, k""")
def table_formats(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as Parquet, CSV, JSON array and JSON lines, each read by the one reader."""
    v = table(spark, d, "videos_manifest").select("video_id", "codec", "duration_ms", "fps").distinct()
    ddl, root, out = "video_id string, codec string, duration_ms long, fps double", _at(spark, "formats"), []
    writers.write_table(v, f"{root}/v.parquet")
    writers.write_table(v, f"{root}/v.csv", "csv")
    writers.write_table(v, f"{root}/v.jsonl", "json")
    rows = v.withColumn("b", F.pmod(F.xxhash64("video_id"), F.lit(8))).groupBy("b").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*v.columns))), ","), F.lit("]")).alias("value"))
    files.put_named(rows.select(F.concat(F.col("b").cast("string"), F.lit(".json")).alias("name"), "value"), "name", "value", f"{root}/v.json").count()
    for kind in ("parquet", "csv", "json", "jsonl"):
        out.append(readers.read_table(spark, f"{root}/v.{kind}", ddl, ["video_id", "codec", "duration_ms", "fps"]).withColumn("kind", F.lit(kind)))
    return mapping.union_all(out)


@query("WITH v AS (SELECT DISTINCT video_id, codec, duration_ms FROM videos_manifest) SELECT video_id, codec, duration_ms FROM v")
def video_list(spark: SparkSession, d: str) -> DataFrame:
    """A manifest whose rows lie in one list of a JSON object."""
    v = table(spark, d, "videos_manifest").select("video_id", "codec", "duration_ms").distinct()
    root = _at(spark, "videos")
    doc = v.withColumn("b", F.pmod(F.xxhash64("video_id"), F.lit(4))).groupBy("b").agg(F.to_json(F.struct(F.collect_list(F.struct(*v.columns)).alias("videos"))).alias("value"))
    files.put_named(doc.select(F.concat(F.col("b").cast("string"), F.lit(".json")).alias("name"), "value"), "name", "value", f"{root}.json").count()
    return readers.read_videos(spark, f"{root}.json").select("video_id", "codec", "duration_ms")


@query(f"""WITH {_FR}, k AS (SELECT video_id, original_frame_id, row_number() OVER (PARTITION BY video_id ORDER BY original_frame_id) - 1 nth, coalesce(is_codec_keyframe, false) OR original_frame_id = 0 is_key, count(pts) OVER (PARTITION BY video_id, pts) same, pts FROM fr)
SELECT video_id, count(*) n, count(*) FILTER (is_key) n_key, count(*) FILTER (nth <> original_frame_id) n_position, count(*) FILTER (pts IS NOT NULL AND same > 1) n_pts FROM k GROUP BY 1""")
def manifest_reading(spark: SparkSession, d: str) -> DataFrame:
    """The frame manifest from CSV, typed, with what breaks the timeline."""
    f = frames(spark, d, "pts", "is_codec_keyframe", "timestamp_ms").withColumnRenamed("is_codec_keyframe", "key_frame")
    path = f"{_at(spark, 'manifest')}.csv"
    writers.write_table(f, path, "csv")
    m = stage(readers.read_manifest(spark, path), "manifest")
    bad = readers.manifest_violations(m).groupBy("video_id").agg(F.count_if(F.col("violation") == "position").alias("p"), F.count_if(F.col("violation") == "pts").alias("t"))
    n = m.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if("is_codec_keyframe").alias("n_key"))
    return n.join(bad, "video_id", "left").select("video_id", "n", "n_key", F.coalesce("p", F.lit(0)).alias("n_position"), F.coalesce("t", F.lit(0)).alias("n_pts"))


@query(f"WITH {_AL} SELECT video_id, keyframe_no, original_frame_id source_frame_idx, count(*) OVER (PARTITION BY video_id) n_rows FROM al")
def source_map_files(spark: SparkSession, d: str) -> DataFrame:
    """A map file per video in one of six forms, read as one table."""
    a = aliases(spark, d).select("video_id", "keyframe_no", "original_frame_id")
    root = _at(spark, "maps")
    row = F.to_json(F.struct(F.col("keyframe_no").alias("n"), F.col("original_frame_id").alias("frame_idx")))
    own = F.concat(F.lit('"'), F.col("keyframe_no").cast("string"), F.lit('":'), F.to_json(F.struct(F.col("original_frame_id").alias("source_frame_idx"))))
    g = a.groupBy("video_id").agg(F.concat_ws(",", F.collect_list(row)).alias("rows"), F.concat_ws(",", F.collect_list(own)).alias("own"), F.concat_ws("\n", F.collect_list(F.concat_ws(",", F.col("keyframe_no").cast("string"), F.coalesce(F.col("original_frame_id").cast("string"), F.lit(""))))).alias("lines"))
    form = F.pmod(F.xxhash64("video_id"), F.lit(5))
    body = F.when(form == 0, F.concat(F.lit("["), "rows", F.lit("]"))).when(form == 1, F.concat(F.lit('{"version": 1, "frames": ['), "rows", F.lit("]}"))).when(form == 2, F.concat(F.lit('{"'), "video_id", F.lit('": ['), "rows", F.lit("]}"))).when(form == 3, F.concat(F.lit("{"), "own", F.lit("}"))).otherwise(F.concat(F.lit("n,frame_idx\n"), "lines", F.lit("\n")))
    named = g.select(F.concat("video_id", F.when(form == 4, ".csv").otherwise(".json")).alias("name"), body.alias("body"))
    files.put_named(named, "name", "body", root).count()
    m = readers.read_source_maps(spark, root)
    n = m.groupBy("video_id").agg(F.count("*").alias("n_rows"))
    return m.select("video_id", "keyframe_no", "source_frame_idx").join(n, "video_id")


@query("""WITH e AS (SELECT DISTINCT evidence_id, video_id, original_frame_id, confidence FROM evidence WHERE evidence_type = 'ocr' AND original_frame_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY video_id, original_frame_id ORDER BY evidence_id) - 1 i FROM e)
SELECT video_id, original_frame_id keyframe_no, i detection_index, evidence_id AS text, round(confidence, 6)::DOUBLE confidence FROM n WHERE CASE WHEN original_frame_id % 7 = 0 THEN i % 2 = 0 ELSE confidence >= 0.5 END""")
def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    """OCR records as JSON lines, one row per accepted detection."""
    e = table(spark, d, "evidence").filter("evidence_type = 'ocr' and original_frame_id is not null").select("evidence_id", "video_id", "original_frame_id", "confidence").distinct()
    g = e.groupBy("video_id", F.col("original_frame_id").alias("keyframe_no")).agg(F.array_sort(F.collect_list(F.struct("evidence_id", "confidence"))).alias("xs"))
    said = lambda i: F.when(F.col("keyframe_no") % 7 == 0, i % 2 == 0)
    rows = g.select("video_id", "keyframe_no", F.transform("xs", lambda x, i: F.struct(x["evidence_id"].alias("text"), x["confidence"].alias("confidence"), said(i).alias("accepted"))).alias("texts"))
    path = _at(spark, "ocr")
    writers.write_table(rows, path, "json")
    return readers.read_ocr(spark, path).withColumn("confidence", F.round("confidence", 6))


_SP = """a AS (SELECT upper(trim(video_id)) video_id, source_span_index i, coalesce(start_ms, asr_start_ms) s, coalesce(end_ms, asr_end_ms) e, coalesce(text_raw, text) t, row_number() OVER (PARTITION BY upper(trim(video_id)), source_span_index ORDER BY ingested_at DESC) rn FROM asr_result),
sp AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 n FROM a WHERE rn = 1), du AS (SELECT video_id, max(e) - 50 dur FROM sp GROUP BY 1),
tr AS (SELECT sp.video_id, n, s, CASE WHEN e > dur AND e <= dur + 100 THEN dur ELSE e END e, dur, CASE WHEN coalesce(trim(regexp_replace(t, '[\\s\\x0b]+', ' ', 'g')), '') = '' THEN 'empty_text' WHEN e > dur + 100 THEN 'duration_mismatch'
 WHEN NOT coalesce(CASE WHEN e > dur AND e <= dur + 100 THEN dur ELSE e END > s, false) THEN 'invalid_interval' WHEN e > dur THEN 'timestamp_clip' END problem FROM sp JOIN du USING (video_id))"""


def _transcripts(spark: SparkSession, d: str) -> str:
    from kinolith.session import clean_id

    cols = ["start_ms", "end_ms", "asr_start_ms", "asr_end_ms", "text_raw", "text"]
    a = latest(table(spark, d, "asr_result").select(clean_id("video_id").alias("video_id"), "source_span_index", *cols, "ingested_at"), ["video_id", "source_span_index"], "ingested_at")
    a = a.select("video_id", "source_span_index", F.coalesce("start_ms", "asr_start_ms").alias("s"), F.coalesce("end_ms", "asr_end_ms").alias("e"), F.coalesce("text_raw", "text").alias("text"))
    seconds = F.col("source_span_index") % 2 == 0
    chunk = F.struct("source_span_index", F.when(~seconds, F.col("s")).alias("start_ms"), F.when(~seconds, F.col("e")).alias("end_ms"), F.when(seconds, F.col("s") / 1000.0).alias("start"), F.when(seconds, F.col("e") / 1000.0).alias("end"), "text")
    g = a.groupBy("video_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"), (F.max("e") - 50).alias("duration_ms")).withColumn("model_version", F.concat(F.lit("m"), F.substring("video_id", -1, 1)))
    path = _at(spark, "asr")
    files.put_named(g.select(F.concat("video_id", F.lit(".asr.json")).alias("name"), F.to_json(F.struct("video_id", "model_version", "duration_ms", "chunks")).alias("body")), "name", "body", path).count()
    return f"{path}/*.asr.json"


@query(f"WITH {_SP} SELECT video_id, n source_span_index, s start_ms, e end_ms FROM tr WHERE problem IS NULL OR problem = 'timestamp_clip'")
def transcript_files(spark: SparkSession, d: str) -> DataFrame:
    """Speech files with times in milliseconds or seconds as spans; an end a little beyond the video is cut."""
    return readers.read_transcripts(spark, _transcripts(spark, d)).select("video_id", "source_span_index", "start_ms", "end_ms").withColumn("source_span_index", F.col("source_span_index").cast("long"))


@query(f"""WITH {_SP}, m AS (SELECT *, 'm' || right(video_id, 1) model_version FROM tr) SELECT model_version, count(DISTINCT video_id) n_files, count(*) n_spans, count(*) FILTER (problem IS NULL OR problem = 'timestamp_clip') n_kept, (SELECT sum(dur)::BIGINT FROM (SELECT DISTINCT video_id, dur, 'm' || right(video_id, 1) mv FROM tr) z WHERE mv = m.model_version) duration_ms,
 count(*) FILTER (problem = 'empty_text') n_empty_text, count(*) FILTER (problem = 'invalid_interval') n_invalid_interval, count(*) FILTER (problem = 'duration_mismatch') n_duration_mismatch, count(*) FILTER (problem = 'timestamp_clip') n_timestamp_clip FROM m GROUP BY 1""")
def transcript_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a conversion of speech files per model."""
    return readers.transcript_report(readers.transcript_spans(spark, _transcripts(spark, d)))


@query(f"WITH {_AL} SELECT video_id, keyframe_no n, round(timestamp_ms / 1000.0, 3)::DOUBLE pts_time, original_frame_id frame_idx FROM al WHERE timestamp_ms IS NOT NULL AND original_frame_id IS NOT NULL")
def frame_map_files(spark: SparkSession, d: str) -> DataFrame:
    """The organiser's CSV of each video."""
    a = aliases(spark, d).filter("timestamp_ms is not null and original_frame_id is not null")
    line = F.concat_ws(",", F.col("keyframe_no").cast("string"), F.round(F.col("timestamp_ms") / 1000.0, 3).cast("string"), F.lit("25.0"), F.col("original_frame_id").cast("string"))
    path = _at(spark, "framemaps")
    g = a.groupBy("video_id").agg(F.concat(F.lit("n,pts_time,fps,frame_idx\n"), F.concat_ws("\n", F.collect_list(line))).alias("body"))
    files.put_named(g.select(F.concat("video_id", F.lit(".csv")).alias("name"), "body"), "name", "body", path).count()
    return readers.read_frame_map(spark, path).select("video_id", "n", "pts_time", "frame_idx")


@query("""WITH t AS (SELECT DISTINCT alignment_id, event_ordinal, upper(trim(video_id)) v, original_frame_id f FROM trake_alignment) SELECT alignment_id, event_ordinal, CASE WHEN event_ordinal = 2 THEN 'broken' ELSE 'row' END kind, CASE WHEN event_ordinal <> 2 THEN f END frame FROM t WHERE f IS NOT NULL""")
def answer_files(spark: SparkSession, d: str) -> DataFrame:
    """Answers as CSV with quoted names; lines that break the schema are reported."""
    from kinolith.session import clean_id

    t = table(spark, d, "trake_alignment").filter("original_frame_id is not null").select("alignment_id", "event_ordinal", clean_id("video_id").alias("v"), "original_frame_id").distinct()
    key = F.concat("alignment_id", F.lit(", "), F.col("event_ordinal").cast("string"))
    line = F.concat(F.lit('"'), key, F.lit('",'), F.when(F.col("event_ordinal") == 2, F.lit("none")).otherwise(F.col("original_frame_id").cast("string")))
    path = _at(spark, "answers")
    writers.write_table(t.select(line.alias("value")), path, "text")
    good, bad = readers.read_answers(spark, path, "key string, frame long")
    parts = lambda c: (F.regexp_extract(c, r"(al[^,]*), (\d+)", 1).alias("alignment_id"), F.regexp_extract(c, r"(al[^,]*), (\d+)", 2).cast("int").alias("event_ordinal"))
    return good.select(*parts("key"), F.lit("row").alias("kind"), "frame").unionByName(bad.select(*parts("_broken"), F.lit("broken").alias("kind"), F.lit(None).cast("long").alias("frame")))


@query("""WITH e AS (SELECT DISTINCT embedding_id, model_name, vector FROM embedding_result WHERE len(vector) = embedding_dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT model_name, len(vector)::INT dim, count(*) n, round(sum(list_sum(list_transform(vector, lambda x: x::DOUBLE))), 3)::DOUBLE total FROM e GROUP BY 1, 2""")
def matrix_files(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as float32 matrices of each model and dimension, read back in slices."""
    e = table(spark, d, "embedding_result").filter(F.size("vector") == F.col("embedding_dim")).filter(vector.is_finite("vector")).select("embedding_id", "model_name", "vector").distinct()
    path = _at(spark, "matrices")
    files.put_matrices(e.select(F.concat_ws("__", "model_name", F.size("vector").cast("string")).alias("name"), "embedding_id", "vector"), path).count()
    m = readers.read_vectors(spark, path, rows=100)
    name = F.regexp_extract("path", r"([^/]+)__(\d+)\.npy$", 1)
    g = m.select(name.alias("model_name"), F.size("vector").alias("dim"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("t"))
    return g.groupBy("model_name", "dim").agg(F.count("*").alias("n"), F.round(F.sum("t"), 3).alias("total"))


@query(f"WITH {_AL}, k AS (SELECT DISTINCT video_id, keyframe_no FROM al WHERE keyframe_no % 3 = 0) SELECT video_id, keyframe_no, 'copied' status, 'skipped' again, row_number() OVER (PARTITION BY video_id ORDER BY keyframe_no) - 1 AS position FROM k")
def image_files(spark: SparkSession, d: str) -> DataFrame:
    """Keyframe images found by their path, in natural order, copied under another prefix, and copied again."""
    k = aliases(spark, d).filter("keyframe_no % 3 = 0").select("video_id", "keyframe_no").distinct()
    root = _at(spark, "images")
    name = F.concat("video_id", F.lit("/kf_"), F.col("keyframe_no").cast("string"), F.lit(".jpg"))
    files.put_named(k.select(name.alias("name"), name.alias("body")), "name", "body", f"{root}/a").count()
    listed = stage(readers.list_images(spark, f"{root}/a"), "listed")
    base = listed.agg(F.min(F.regexp_extract("path", "^(.*/a/)", 1))).first()[0]
    pairs = files.moved_prefix(listed, base, base[:-2] + "b/")
    first, second = stage(files.copy_verified(pairs), "first"), stage(files.copy_verified(pairs), "second")
    found = readers.index_keyframes(spark, f"{root}/b")
    j = found.join(first.select(F.col("target").alias("object_key"), "status"), "object_key").join(second.select(F.col("target").alias("object_key"), F.col("status").alias("again")), "object_key")
    at = listed.select(F.concat(F.lit(base[:-2] + "b/"), F.substring("path", len(base) + 1, 10_000)).alias("object_key"), F.col("position").alias("p"))
    j = j.join(at, "object_key")
    low = j.groupBy("video_id").agg(F.min("p").alias("low"))
    return j.join(low, "video_id").select("video_id", "keyframe_no", "status", "again", (F.col("p") - F.col("low")).alias("position"))


@query("""WITH v AS (SELECT DISTINCT video_id, duration_ms FROM videos_manifest) SELECT video_id, CASE WHEN duration_ms % 5 = 0 THEN NULL ELSE length(video_id) END n_bytes, CASE WHEN duration_ms % 5 = 0 THEN 'failed' ELSE 'ok' END outcome FROM v""")
def probed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files probed in tasks; those that are not there become failures."""
    v = table(spark, d, "videos_manifest").select("video_id", "duration_ms").distinct()
    root = _at(spark, "probe")
    files.put_named(v.filter("duration_ms % 5 <> 0").select("video_id", F.col("video_id").alias("body")), "video_id", "body", root).count()
    good, bad = readers.probe_files(v.select(F.concat(F.lit(f"{root}/"), "video_id").alias("path")), lambda p: {"n_bytes": len(files.read_bytes(p))}, "n_bytes long")
    vid = lambda c: F.regexp_extract(c, r"([^/]+)$", 1).alias("video_id")
    return good.select(vid("path"), "n_bytes", F.lit("ok").alias("outcome")).unionByName(bad.select(vid("source"), F.lit(None).cast("long").alias("n_bytes"), F.lit("failed").alias("outcome")))


@query("""WITH x AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), k AS (SELECT sha256(text) h, octet_length(encode(text)) n FROM x) SELECT 'sha256/' || substr(h, 1, 2) || '/' || h AS key, n size_bytes FROM k""")
def content_store(spark: SparkSession, d: str) -> DataFrame:
    """Texts in a store by content, equal ones once; what is in the store is read again."""
    x = table(spark, d, "documents").filter("text is not null").select(F.encode("text", "UTF-8").alias("raw"))
    put = stage(files.put_content(x, "raw", _at(spark, "store")), "put")
    good, _ = readers.probe_files(put.select(F.col("target").alias("path")), lambda p: {"size_bytes": len(files.read_bytes(p))}, "size_bytes long")
    keys = x.select(writers.content_key("raw").alias("key")).distinct()
    return good.select(F.regexp_extract("path", r"(sha256/../\w+)$", 1).alias("key"), "size_bytes").join(keys, "key", "left_semi")


@query(f"WITH {_AL}, x AS (SELECT video_id, keyframe_no, timestamp_ms FROM al) SELECT video_id, keyframe_no, CASE WHEN keyframe_no % 4 = 1 THEN coalesce(timestamp_ms, 0) + 1 ELSE timestamp_ms END timestamp_ms FROM x UNION ALL SELECT video_id, keyframe_no + 100000, timestamp_ms FROM x WHERE keyframe_no % 10 = 2")
def bucket_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A stored table after two upserts (one of them twice), each of its own buckets."""
    a = aliases(spark, d).select("video_id", "keyframe_no", "timestamp_ms")
    t = writers.VersionedTable(spark, _at(spark, "upserts"))
    t.upsert(a, ["video_id", "keyframe_no"])
    changed = a.filter("keyframe_no % 4 = 1").withColumn("timestamp_ms", F.coalesce("timestamp_ms", F.lit(0)) + 1)
    for _ in range(2):
        t.upsert(stage(changed, "changed"), ["video_id", "keyframe_no"])
    t.insert_absent(a.withColumn("keyframe_no", F.when(F.col("keyframe_no") % 10 == 2, F.col("keyframe_no") + 100_000).otherwise(F.col("keyframe_no"))), ["video_id", "keyframe_no"])
    return t.current()


@query("""WITH v AS (SELECT DISTINCT video_id, codec, duration_ms FROM videos_manifest), s AS (SELECT CASE WHEN duration_ms % 11 = 0 THEN NULL WHEN duration_ms % 3 = 1 THEN video_id || 'x' ELSE video_id END video_id, CASE WHEN duration_ms % 2 = 0 THEN 'new' ELSE codec END codec FROM v),
c AS (SELECT count(*) n_seen, count(*) FILTER (s.video_id IS NOT NULL AND v.video_id IS NULL) n_inserted, count(*) FILTER (v.video_id IS NOT NULL AND s.codec IS DISTINCT FROM v.codec) n_updated, count(*) FILTER (s.video_id IS NULL) n_failed FROM s LEFT JOIN v ON v.video_id = s.video_id)
SELECT 'ingestion_' || substr(sha256('file:///v' || chr(31) || 'videos'), 1, 32) ingestion_id, n_seen, n_inserted, n_updated, n_seen - n_inserted - n_updated - n_failed n_skipped, n_failed, CASE WHEN n_failed = 0 THEN 'completed' WHEN n_failed = n_seen THEN 'failed' ELSE 'partial' END status FROM c""")
def import_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger row of an upsert, recorded twice under one identity."""
    v = table(spark, d, "videos_manifest").select("video_id", "codec", "duration_ms").distinct()
    s = v.select(F.when(F.col("duration_ms") % 11 == 0, F.lit(None)).when(F.col("duration_ms") % 3 == 1, F.concat("video_id", F.lit("x"))).otherwise(F.col("video_id")).alias("video_id"), F.when(F.col("duration_ms") % 2 == 0, "new").otherwise(F.col("codec")).alias("codec"))
    n = writers.merge_counters(v.select("video_id", "codec"), s, ["video_id"]).withColumns({"source_uri": F.lit("file:///v"), "source_checksum": F.lit("c"), "target_table": F.lit("videos")})
    ledger = writers.VersionedTable(spark, _at(spark, "ledger"), buckets=1)
    for _ in range(2):
        ledger.upsert(writers.ledger_rows(n), writers.LEDGER_KEY)
    return ledger.current().select("ingestion_id", "n_seen", "n_inserted", "n_updated", "n_skipped", "n_failed", "status")


@query("""WITH v AS (SELECT DISTINCT codec, video_id, duration_ms FROM videos_manifest WHERE codec IS NOT NULL), g AS (SELECT codec, count(*) n, sum(duration_ms)::BIGINT ms FROM v GROUP BY 1) SELECT '| ' || codec || ' | ' || n || ' | ' || ms || ' |' line FROM g UNION ALL SELECT '| codec | n | ms |' UNION ALL SELECT '|---|---|---|'""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """A report as Markdown lines."""
    v = table(spark, d, "videos_manifest").filter("codec is not null").select("codec", "video_id", "duration_ms").distinct()
    g = v.groupBy("codec").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))
    return writers.markdown_table(g).select("line")


@query("""WITH v AS (SELECT DISTINCT video_id, storage_uri, codec FROM videos_manifest) SELECT regexp_replace(storage_uri, '://', '://') || '?***' source, 'cannot open ' || storage_uri || '?***' error FROM v""")
def failure_lines(spark: SparkSession, d: str) -> DataFrame:
    """A failure log without passwords and query strings."""
    v = table(spark, d, "videos_manifest").select("video_id", "storage_uri", "codec").distinct()
    uri = F.concat(F.regexp_replace("storage_uri", "://", "://user:pw@"), F.lit("?sig=1"))
    return writers.failure_log(v.select(uri.alias("s"), F.concat(F.lit("cannot open "), uri).alias("e")), "s", "e")


@query("""WITH e AS (SELECT DISTINCT embedding_id, vector v, model_name m FROM embedding_result WHERE len(vector) = embedding_dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
q AS (SELECT v qv, m qm FROM e ORDER BY embedding_id LIMIT 1) SELECT embedding_id, round(list_cosine_similarity(v::DOUBLE[], qv::DOUBLE[]), 4) score FROM e, q WHERE m = qm AND len(v) = len(qv) ORDER BY list_cosine_similarity(v::DOUBLE[], qv::DOUBLE[]) DESC, embedding_id LIMIT 12""")
def flat_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """A stored index of unit vectors, searched by inner product."""
    e = table(spark, d, "embedding_result").filter(F.size("vector") == F.col("embedding_dim")).select("embedding_id", "vector", "model_name").filter(vector.unit("vector").isNotNull()).distinct()
    path = _at(spark, "index")
    vectors.build_index(e, path, "embedding_id", "vector", "model_name")
    q = e.select(F.min_by(F.struct("vector", "model_name"), "embedding_id")).first()[0]
    return vectors.search_index(spark, path, [float(x) for x in q["vector"]], q["model_name"], 12).select(F.col("id").alias("embedding_id"), F.round("score", 4).alias("score"))


_W = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1)"
_A, _B = _TRGM.format(x="lower(text)"), _TRGM.format(x="'lighthouse'")


@query(f"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, text, {_A} a, {_B} b, len(list_filter({_W}, lambda w: w = 'lighthouse')) n FROM d),
s AS (SELECT *, len(list_intersect(a, b)) i FROM t), r AS (SELECT doc_id, n, CASE WHEN len(a) + len(b) - i > 0 THEN i / (len(a) + len(b) - i) ELSE 0 END sim, contains(lower(text), 'lighthouse') hit FROM s)
SELECT doc_id, round(greatest(0.1 * n, sim) + CASE WHEN hit THEN 0.25 ELSE 0 END, 6)::DOUBLE score FROM r WHERE n > 0 OR sim > 0.15 ORDER BY round(greatest(0.1 * n, sim) + CASE WHEN hit THEN 0.25 ELSE 0 END, 6) DESC, doc_id LIMIT 100""")
def text_branch(spark: SparkSession, d: str) -> DataFrame:
    """The text branch in one predicate: words match or trigrams are alike; scored by the better of both and the phrase."""
    x = table(spark, d, "documents").select("doc_id", "text").filter("text is not null").distinct()
    return text.text_branch(x, "doc_id", "text", "lighthouse", 100)


_P = _TRGM.format(x=f"'{PROBE_TEXT}'")


@query(f"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, {_TRGM.format(x="text")} a, {_P} b FROM d), s AS (SELECT doc_id, len(list_intersect(a, b)) i, len(a) la, len(b) lb FROM t)
SELECT doc_id, round(i / (la + lb - i), 6)::DOUBLE sim FROM s WHERE i > 0 AND i / (la + lb - i) > 0.15""")
def trigram_postings(spark: SparkSession, d: str) -> DataFrame:
    """Trigram similarity from stored postings: only those of the probe's trigrams are read."""
    path = _at(spark, "postings")
    text.write_postings(table(spark, d, "documents").select("doc_id", "text").filter("text is not null").distinct(), "doc_id", "text", path)
    return text.search_postings(spark, path, _trigrams(PROBE_TEXT), 0.15).select(F.col("id").alias("doc_id"), F.round("sim", 6).alias("sim"))


@query("""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1), u AS (SELECT query_id, result_no, unnest(evidence_ids) e, unnest(range(1, len(evidence_ids) + 1)) rank FROM r)
SELECT query_id, result_no, rank::INT rank, e evidence_id FROM u""")
def ranked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lists of a JSON column as rows with their place."""
    r = latest(table(spark, d, "search_response").select("query_id", "result_no", "evidence_ids", "ingested_at"), ["query_id", "result_no"], "ingested_at").filter("evidence_ids is not null")
    doc = F.to_json(F.transform("evidence_ids", lambda e: F.struct(e.alias("evidence_id"))))
    return readers.ranked_json(r.select("query_id", "result_no", doc.alias("items")), "items", "struct<evidence_id:string>")
