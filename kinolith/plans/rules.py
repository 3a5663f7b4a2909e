"""Queries over single records: clocks, scores, boxes, words, addresses and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.functions import num, text, vector
from kinolith.operators import contracts, timeline
from kinolith.plans.catalog import Catalog
from kinolith.plans.timeline import _FR, frames
from kinolith.session import clean_id, latest, table

CATALOG = Catalog()
query = CATALOG.query
_SR = "sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1)"
_ASR = "sp AS (SELECT * FROM (SELECT *, upper(trim(video_id)) v, row_number() OVER (PARTITION BY upper(trim(video_id)), source_span_index ORDER BY ingested_at DESC) k FROM asr_result) WHERE k = 1)"


def _results(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "search_response").select("query_id", "result_no", *cols, "ingested_at"), ["query_id", "result_no"], "ingested_at")


def _spans(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    a = table(spark, d, "asr_result").select(clean_id("video_id").alias("video_id"), "source_span_index", *cols, "ingested_at")
    return latest(a, ["video_id", "source_span_index"], "ingested_at")


@query(f"""WITH {_FR} SELECT video_id, original_frame_id, floor(((pts * time_base_num) * 2000 + time_base_den) / (time_base_den * 2))::BIGINT nearest_ms, round(original_frame_id / nullif(fps_num / fps_den, 0) * 1000)::BIGINT frame_ms,
 round_even(timestamp_ms / 1000.0 * 1000, 0)::BIGINT clock_ms, greatest(0, least(round_even(timestamp_ms * fps_num / (fps_den * 1000.0), 0)::BIGINT, 4999)) frame FROM fr WHERE pts IS NOT NULL AND timestamp_ms IS NOT NULL AND fps_num > 0""")
def media_clocks(spark: SparkSession, d: str) -> DataFrame:
    """A frame's time by its pts, by its number and by its clock, and back."""
    f = frames(spark, d, "pts", "time_base_num", "time_base_den", "fps_num", "fps_den", "timestamp_ms").filter("pts is not null and timestamp_ms is not null and fps_num > 0")
    return f.select(
        "video_id", "original_frame_id", num.half_up_ms(F.col("pts") * F.col("time_base_num"), F.col("time_base_den")).alias("nearest_ms"),
        num.frame_ms_rounded("original_frame_id", F.col("fps_num") / F.col("fps_den")).alias("frame_ms"), num.seconds_to_ms(F.col("timestamp_ms") / 1000.0).alias("clock_ms"),
        num.ms_to_frame("timestamp_ms", "fps_num", "fps_den", F.lit(5000)).alias("frame"),
    )


@query(f"""WITH {_FR} SELECT video_id, original_frame_id, round(CASE WHEN abs(pts_timestamp_ms - cfr_timestamp_ms) > 5 THEN cfr_timestamp_ms ELSE coalesce(pts_timestamp_ms, cfr_timestamp_ms) END, 6)::DOUBLE clock_ms FROM fr""")
def tolerant_clocks(spark: SparkSession, d: str) -> DataFrame:
    """The pts, but the constant-rate clock where both differ by more than 5 ms."""
    f = timeline.tolerant_clock(frames(spark, d, "pts_timestamp_ms", "cfr_timestamp_ms"))
    return f.select("video_id", "original_frame_id", F.round("clock_ms", 6).alias("clock_ms"))


@query(f"""WITH {_FR} SELECT video_id, original_frame_id, round(ln(1 + blur_score::DOUBLE) + ln(1 + contrast_score::DOUBLE) + entropy_score::DOUBLE, 6)::DOUBLE quality, CASE WHEN b < 10 OR b > 245 OR c < 5 THEN 'low' WHEN s < 30 THEN 'medium' ELSE 'high' END tier
 FROM (SELECT *, brightness_score::DOUBLE * 255 b, contrast_score::DOUBLE * 100 c, blur_score::DOUBLE * 10 s FROM fr WHERE NOT isnan(blur_score) AND NOT isnan(contrast_score) AND NOT isnan(entropy_score) AND NOT isnan(brightness_score))""")
def quality_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Quality value and tier of each frame."""
    cols = ["blur_score", "contrast_score", "entropy_score", "brightness_score"]
    f = frames(spark, d, *cols).filter(" and ".join(f"not isnan({c})" for c in cols)).withColumns({c: F.col(c).cast("double") for c in cols})
    tier = num.quality_tier(F.col("brightness_score") * 255, F.col("blur_score") * 10, F.col("contrast_score") * 100)
    return f.select("video_id", "original_frame_id", F.round(num.quality_value("blur_score", "contrast_score", "entropy_score"), 6).alias("quality"), tier.alias("tier"))


@query(f"""WITH {_ASR}, x AS (SELECT v video_id, source_span_index, confidence c, CASE WHEN (1 - no_speech_probability) * 5 BETWEEN 0 AND 5 THEN (1 - no_speech_probability) * 5 END m FROM sp)
SELECT video_id, source_span_index, CASE WHEN c IS NOT NULL THEN c >= 0.60 AND coalesce(m >= 2.5, true) END ready, concat_ws('; ', CASE WHEN c < 0.60 THEN 'confidence thấp' END, CASE WHEN m < 2.5 THEN 'chất lượng âm thanh thấp' END) suggestions,
 round(greatest(0.0, least(1.0, exp(c - 1))), 6)::DOUBLE by_log FROM x""")
def audio_flags(spark: SparkSession, d: str) -> DataFrame:
    """Readiness of spans by confidence and sound quality, and a confidence from a log probability."""
    s = _spans(spark, d, "confidence", "no_speech_probability").withColumn("x", num.audio_ready("confidence", (1 - F.col("no_speech_probability")) * 5))
    return s.select("video_id", "source_span_index", F.col("x.ready").alias("ready"), F.array_join("x.suggestions", "; ").alias("suggestions"), F.round(num.log_confidence(F.col("confidence") - 1), 6).alias("by_log"))


@query(f"""WITH {_ASR}, t AS (SELECT v video_id, source_span_index, confidence, list_filter(regexp_split_to_array(coalesce(text_raw, text), ' '), lambda w: true) ws, coalesce(start_ms, asr_start_ms) s FROM sp WHERE coalesce(text_raw, text) IS NOT NULL AND coalesce(start_ms, asr_start_ms) IS NOT NULL),
w AS (SELECT video_id, source_span_index, confidence, list_filter(list_transform(range(1, len(ws) + 1), lambda i: {{'t': trim(ws[i]), 'a': round_even((s + i * 200) / 1000.0 * 1000, 0)::BIGINT, 'b': round_even((s + i * 200 + (length(ws[i]) - 2) * 50) / 1000.0 * 1000, 0)::BIGINT, 'c': length(ws[i]) / 10.0}}), lambda x: x.t <> '' AND x.b > x.a) v FROM t)
SELECT video_id, source_span_index, len(v)::INT n_words, list_min(list_transform(v, lambda x: x.a)) first_ms, list_max(list_transform(v, lambda x: x.b)) last_ms, round(coalesce(CASE WHEN source_span_index % 2 = 0 THEN confidence END, list_avg(list_transform(v, lambda x: x.c)), 0.5), 6)::DOUBLE confidence FROM w""")
def word_timings(spark: SparkSession, d: str) -> DataFrame:
    """Timed words of a span, those that hold nothing left out, and the span's confidence."""
    s = _spans(spark, d, "confidence", "text_raw", "text", "start_ms", "asr_start_ms").withColumn("s", F.coalesce("start_ms", "asr_start_ms")).withColumn("body", F.coalesce("text_raw", "text")).filter("s is not null and body is not null")
    ws = F.transform(F.split("body", " "), lambda w, i: F.struct(w.alias("text"), ((F.col("s") + (i + 1) * 200) / 1000.0).alias("start"), ((F.col("s") + (i + 1) * 200 + (F.length(w) - 2) * 50) / 1000.0).alias("end"), (F.length(w) / 10.0).alias("prob")))
    x = s.withColumn("w", num.valid_words(ws))
    own = F.when(F.col("source_span_index") % 2 == 0, F.col("confidence"))
    return x.select("video_id", "source_span_index", F.size("w").alias("n_words"), F.array_min(F.transform("w", lambda w: w["start_ms"])).alias("first_ms"), F.array_max(F.transform("w", lambda w: w["end_ms"])).alias("last_ms"), F.round(num.span_confidence(own, "w", F.lit(0.5)), 6).alias("confidence"))


@query("""WITH x AS (SELECT DISTINCT doc_id, trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g')) t, (doc_id % 100) / 100.0 s, CASE WHEN doc_id % 3 = 0 THEN trim(regexp_replace(lang || ' ', '\\s+', ' ', 'g')) END o FROM documents WHERE source = 'ocr')
SELECT doc_id, CASE WHEN t <> '' AND s >= 0.5 THEN md5(t) WHEN o <> '' THEN md5(o) WHEN t <> '' THEN md5(t) END text_key, CASE WHEN t <> '' AND s >= 0.5 THEN 'paddle' WHEN o <> '' THEN 'vlm' WHEN t <> '' THEN 'paddle' END source,
 CASE WHEN t <> '' AND s >= 0.5 THEN true WHEN o <> '' THEN true WHEN t <> '' THEN false END accepted FROM x""")
def box_routes(spark: SparkSession, d: str) -> DataFrame:
    """Read texts accepted by their score, else by the second reader."""
    x = table(spark, d, "documents").filter("source = 'ocr'").select("doc_id", "text", "lang").distinct()
    b = x.withColumn("b", num.box_route("text", F.pmod("doc_id", F.lit(100)) / 100.0, 0.5, F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat("lang", F.lit(" ")))))
    return b.select("doc_id", F.md5("b.text").alias("text_key"), F.col("b.source").alias("source"), F.col("b.accepted").alias("accepted"))


@query("""WITH v AS (SELECT DISTINCT video_id, width w, height h FROM videos_manifest WHERE width IS NOT NULL AND height IS NOT NULL), b AS (SELECT *, h % 7 * 100 x1, 10 y1, w - h % 5 * 200 x2, h + 20 - h % 3 * 30 y2 FROM v)
SELECT video_id, round(CASE WHEN x1 >= 0 AND x1 < x2 AND y1 < y2 AND x2 <= w AND y2 <= h THEN (x2 - x1) / w::DOUBLE END, 6)::DOUBLE share, round(CASE WHEN h % 64 <= 0 OR h % 64 >= 32 THEN 1.0 ELSE least(4.0, greatest(1.0, 32 / (h % 64)::DOUBLE, 1.5)) END, 6)::DOUBLE scale FROM b""")
def normal_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes over the picture's size (null if they do not fit), and how much a crop is enlarged."""
    v = table(spark, d, "videos_manifest").filter("width is not null and height is not null").select("video_id", "width", "height").distinct()
    h, w = F.col("height"), F.col("width")
    box = num.normalised_box(F.array(h % 7 * 100, F.lit(10).cast("long"), w - h % 5 * 200, h + 20 - h % 3 * 30), "width", "height")
    return v.select("video_id", F.round(box[2] - box[0], 6).alias("share"), F.round(num.upscale_factor(h % 64, 32, 1.5, 4), 6).alias("scale"))


@query("""WITH e AS (SELECT DISTINCT evidence_id, start_ms s, end_ms e FROM evidence WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL), p AS (SELECT evidence_id, unnest([{'i': 0, 'x': s % 97, 'y': e % 89}, {'i': 1, 'x': s % 53 + 40, 'y': e % 31}, {'i': 2, 'x': s % 11, 'y': s % 71 + 9}, {'i': 3, 'x': e % 101, 'y': s % 43 + 50}]) q FROM e)
SELECT evidence_id, concat_ws(' ', arg_min(q.x || ',' || q.y, {'k': q.x + q.y, 'i': q.i}), arg_min(q.x || ',' || q.y, {'k': q.y - q.x, 'i': q.i}), arg_min(q.x || ',' || q.y, {'k': -(q.x + q.y), 'i': q.i}), arg_min(q.x || ',' || q.y, {'k': q.x - q.y, 'i': q.i})) quad FROM p GROUP BY 1""")
def corner_order(spark: SparkSession, d: str) -> DataFrame:
    """Corners of quadrilaterals in order."""
    e = table(spark, d, "evidence").filter("start_ms is not null and end_ms is not null").select("evidence_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).distinct()
    s, t = F.col("s"), F.col("e")
    quad = num.ordered_quad(F.array(F.array(s % 97, t % 89), F.array(s % 53 + 40, t % 31), F.array(s % 11, s % 71 + 9), F.array(t % 101, s % 43 + 50)))
    return e.select("evidence_id", F.array_join(F.transform(quad, lambda q: F.concat_ws(",", q[0].cast("string"), q[1].cast("string"))), " ").alias("quad"))


@query("""WITH e AS (SELECT DISTINCT video_id, evidence_id, start_ms x, end_ms y FROM evidence WHERE original_frame_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL)
SELECT video_id, string_agg(x % 1000 || ':' || y % 700, ' ' ORDER BY least(y % 700, y % 700 + 5), least(x % 1000, x % 1000 + 9), evidence_id) reading FROM e WHERE y % 4 <> 0 GROUP BY 1""")
def reading_orders(spark: SparkSession, d: str) -> DataFrame:
    """Text polygons of a video from top to bottom and left to right; those with too few corners are left out."""
    e = table(spark, d, "evidence").filter("original_frame_id is not null and start_ms is not null and end_ms is not null").select("video_id", "evidence_id", "start_ms", "end_ms").distinct()
    x, y = F.col("start_ms") % 1000, F.col("end_ms") % 700
    box = F.when(F.col("end_ms") % 4 == 0, F.array(F.array(x, y), F.array(x, y))).otherwise(F.array(F.array(x + 9, y), F.array(x, y + 5), F.array(x, y)))
    boxes = e.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", box.alias("b")))), lambda s: s["b"]).alias("bs"))
    out = boxes.select("video_id", contracts.reading_order("bs").alias("o")).filter(F.size("o") > 0)
    return out.select("video_id", F.array_join(F.transform("o", lambda q: F.concat_ws(":", q[2][0].cast("string"), q[2][1].cast("string"))), " ").alias("reading"))


@query(f"""WITH {_SR} SELECT query_id, result_no, coalesce(array_to_string(list_filter(matched_modalities, lambda m: m NOT IN ('embedding', 'visual')), ' · '), NULL) label,
 array_to_string(CASE WHEN len(matched_modalities) > 1 THEN list_concat(matched_modalities[len(matched_modalities):], matched_modalities[:len(matched_modalities) - 1]) ELSE matched_modalities END, ',') last_first FROM sr WHERE matched_modalities IS NOT NULL""")
def modality_labels(spark: SparkSession, d: str) -> DataFrame:
    """What a result shows as matched, and its list with the last item moved to the front."""
    r = _results(spark, d, "matched_modalities").filter("matched_modalities is not null")
    return r.select("query_id", "result_no", num.shown_modalities("matched_modalities").alias("label"), F.array_join(num.moved("matched_modalities", F.size("matched_modalities") - 1, F.lit(0)), ",").alias("last_first"))


@query("""WITH e AS (SELECT DISTINCT embedding_id, vector FROM embedding_result WHERE vector IS NOT NULL) SELECT embedding_id, md5('[' || array_to_string(list_transform(vector, lambda x: format('{:.9g}', x::DOUBLE)), ',') || ']') literal_key FROM e WHERE len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0""")
def vector_literals(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as text with nine digits."""
    e = table(spark, d, "embedding_result").select("embedding_id", "vector").filter("vector is not null").distinct()
    return e.select("embedding_id", F.md5(vector.literal("vector")).alias("literal_key")).filter("literal_key is not null")


@query(f"""WITH {_SR}, x AS (SELECT query_id, result_no, result_no % 4 kind, round(score * 130, 3) s FROM sr WHERE isfinite(score))
SELECT query_id, result_no, CASE kind WHEN 3 THEN 50 WHEN 2 THEN 50 ELSE greatest(0, least(100, floor(s + 0.5)))::INT END score, CASE kind WHEN 3 THEN false WHEN 2 THEN true WHEN 1 THEN false ELSE floor(s + 0.5) >= 50 END AS match,
 CASE kind WHEN 3 THEN 'Failed to parse VLM response' WHEN 1 THEN 'no' ELSE 'Evaluated by VLM' END reason FROM x""")
def relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers about relevance, also ill ones, as score, match and reason."""
    r = _results(spark, d, "score").filter("score is not null and not isnan(score) and abs(score) < double('inf')")
    s, kind = F.round(F.col("score") * 130, 3).cast("string"), F.col("result_no") % 4
    answer = F.when(kind == 0, F.concat(F.lit('```json\n{"score": '), s, F.lit("}\n```"))).when(kind == 1, F.concat(F.lit('{"score": '), s, F.lit(', "match": false, "reason": " no "}'))).when(kind == 2, F.lit('{"reason": " "}')).otherwise(F.lit("not sure"))
    return r.withColumn("x", num.relevance(answer)).select("query_id", "result_no", "x.score", "x.match", "x.reason")


@query("""WITH v AS (SELECT DISTINCT video_id, storage_uri, object_key, duration_ms, width, height FROM videos_manifest)
SELECT video_id, regexp_extract(storage_uri, '^(\\w+)://([^/]*)/?(.*)$', 1) scheme, regexp_extract(storage_uri, '^(\\w+)://([^/]*)/?(.*)$', 2) bucket, regexp_extract(storage_uri, '^(\\w+)://([^/]*)/?(.*)$', 3) AS key, regexp_full_match(video_id, '[A-Za-z0-9][A-Za-z0-9._-]*') AND NOT contains(video_id, '..') safe,
 CASE WHEN duration_ms % 3 = 0 THEN NULL ELSE duration_ms END range_start, CASE WHEN duration_ms % 3 = 1 THEN NULL ELSE duration_ms + 1 END range_end, array_to_string(list_sort(list_distinct([width, height, 7])), ' ') members FROM v WHERE regexp_matches(storage_uri, '^(file|r2|s3)://')""")
def address_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of addresses, safe ids, byte ranges and lists of member ids."""
    v = table(spark, d, "videos_manifest").select("video_id", "storage_uri", "object_key", "duration_ms", "width", "height").distinct()
    a, b = F.when(F.col("duration_ms") % 3 == 0, "").otherwise(F.col("duration_ms").cast("string")), F.when(F.col("duration_ms") % 3 == 1, "").otherwise((F.col("duration_ms") + 1).cast("string"))
    v = v.withColumn("u", text.uri_parts("storage_uri")).withColumn("r", text.byte_range(F.concat(F.lit("bytes="), a, F.lit("-"), b))).filter("u is not null")
    members = F.when(F.col("duration_ms") % 2 == 0, F.concat(F.lit("["), F.concat_ws(", ", "width", "height", F.lit("7")), F.lit("]"))).otherwise(F.concat_ws(" , ", "height", "width", F.lit("7"), F.lit("x")))
    return v.select("video_id", "u.scheme", "u.bucket", "u.key", text.safe_id("video_id").alias("safe"), F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"), F.array_join(num.member_ids(members), " ").alias("members"))


@query("""WITH t AS (SELECT unnest(['clip', 'visual', 'ocr_lexical', 'ocr_semantic', 'asr_lexical', 'caption', 'object', 'temporal', 'audio']) branch)
SELECT branch, CASE WHEN branch = 'clip' THEN 'embedding' WHEN starts_with(branch, 'ocr_') THEN 'ocr' WHEN starts_with(branch, 'asr_') THEN 'asr' ELSE branch END modality FROM t""")
def branch_modalities(spark: SparkSession, d: str) -> DataFrame:
    """The modality of each branch; the branches are a term array."""
    from kinolith.sources.readers import terms

    names = ["clip", "visual", "ocr_lexical", "ocr_semantic", "asr_lexical", "caption", "object", "temporal", "audio"]
    return terms(spark, names).select(F.col("term").alias("branch"), num.modality("term").alias("modality"))


@query("""WITH v AS (SELECT DISTINCT codec, video_id, duration_ms FROM videos_manifest WHERE codec IS NOT NULL), c AS (SELECT *, sum(duration_ms / 1000.0 * 0.5904 / 3600) OVER (PARTITION BY codec ORDER BY video_id) cost FROM v)
SELECT codec, video_id, round(cost, 6)::DOUBLE cost, cost > 0.05 over_budget FROM c""")
def captioning_cost(spark: SparkSession, d: str) -> DataFrame:
    """Running cost of each codec's videos and whether it has passed the budget."""
    from kinolith.operators.skew import numbered

    v = table(spark, d, "videos_manifest").filter("codec is not null").select("codec", "video_id", "duration_ms").distinct()
    n = numbered(v, [F.col("codec"), F.col("video_id")], "i", F.col("duration_ms"))
    first = n.groupBy("codec").agg(F.min("before_").alias("from_"))
    cost = num.running_cost((F.col("before_") - F.col("from_") + F.col("duration_ms")) / 1000.0, 0.5904)
    return n.join(first, "codec").select("codec", "video_id", F.round(cost, 6).alias("cost"), num.over_budget(cost, 0.05).alias("over_budget"))


@query("""WITH x AS (SELECT DISTINCT doc_id, lang FROM documents WHERE lang IS NOT NULL), c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN upper(lang) ELSE NULL END a FROM x) SELECT doc_id, a answer, CASE WHEN doc_id % 3 = 2 THEN 'none' WHEN doc_id % 3 = 1 THEN 'label' ELSE 'json' END how FROM c""")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model: JSON in fences, a labelled line, or neither."""
    x = table(spark, d, "documents").filter("lang is not null").select("doc_id", "lang").distinct()
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('Sure:\n```json\n{"answer": "'), F.col("lang"), F.lit('"}\n```'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Reason: x\nAnswer:  "), F.upper("lang"), F.lit(" \n"))).otherwise(F.lit("I do not know"))
    a = text.model_answer(raw, "answer")
    return x.select("doc_id", a["value"].alias("answer"), a["how"].alias("how"))


@query("""WITH x AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) >= 16)
SELECT doc_id, octet_length(encode(text)) // 16 n_rows, regexp_full_match(text, '[\\x00-\\x7F]*') ascii FROM x""")
def gray_rows(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of texts as pictures of 16 columns: how many rows have metrics, and whether all are dark enough to be ASCII."""
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", "text").distinct().withColumn("raw", F.encode("text", "UTF-8"))
    m = x.withColumn("m", num.gray_metrics("raw", F.lit(16))).filter("m is not null")
    return m.select("doc_id", F.floor(F.octet_length("raw") / 16).alias("n_rows"), (F.octet_length("raw") == F.length("text")).alias("ascii"))
