"""Whole retrieval branches and look-ups of a request: release, live dimensions, score, order and limit in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.functions import num, text, vector
from kinolith.operators import contracts, curation, timeline
from kinolith.plans.catalog import Catalog
from kinolith.plans.curation import _REL, _releases
from kinolith.plans.ingest import _AL, aliases
from kinolith.plans.retrieval import _TRGM
from kinolith.plans.timeline import _FR, frames, raw_frames
from kinolith.session import clean_id, latest, table

CATALOG = Catalog()
query = CATALOG.query
_SR = "sr AS (SELECT * REPLACE (upper(trim(video_id)) AS video_id) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1)"
_GOOD = "len(vector) = embedding_dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(vector, lambda x: abs(x))) > 0"


@query(f"""WITH {_REL}, {_SR}, {_FR}, h AS (SELECT query_id, result_no, video_id, original_frame_id, start_ms, score, unnest(evidence_ids) evidence_id, index_version, dataset_version FROM sr WHERE isfinite(score)),
ev AS (SELECT DISTINCT evidence_id, evidence_type FROM evidence WHERE deleted_at IS NULL), vm AS (SELECT DISTINCT video_id, object_key FROM videos_manifest WHERE deleted_at IS NULL),
j AS (SELECT query_id, result_no, h.video_id, evidence_id, evidence_type, object_key, round(fr.timestamp_ms, 3)::DOUBLE timestamp_ms, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, h.video_id, start_ms, evidence_id, result_no) rank
 FROM h SEMI JOIN (SELECT * FROM rel WHERE status = 'active') a USING (index_version, dataset_version) JOIN ev USING (evidence_id) JOIN vm ON vm.video_id = h.video_id LEFT JOIN fr ON fr.video_id = h.video_id AND fr.original_frame_id = h.original_frame_id)
SELECT * FROM j WHERE rank <= 20""")
def release_branch(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the active release with live evidence, live video and their frame, the best twenty of a query."""
    cols = ["video_id", "original_frame_id", "start_ms", "score", "evidence_ids", "index_version", "dataset_version"]
    h = latest(table(spark, d, "search_response").select("query_id", "result_no", *cols, "ingested_at"), ["query_id", "result_no"], "ingested_at").withColumn("video_id", clean_id("video_id"))
    h = curation.active(h, _releases(spark, d)).filter("score is not null and not isnan(score) and abs(score) < double('inf')").withColumn("evidence_id", F.explode("evidence_ids")).drop("evidence_ids")
    ev = table(spark, d, "evidence").filter("deleted_at is null").select("evidence_id", "evidence_type").distinct()
    vm = table(spark, d, "videos_manifest").filter("deleted_at is null").select("video_id", "object_key").distinct()
    j = h.join(ev, "evidence_id").join(vm, "video_id").join(frames(spark, d, "timestamp_ms"), ["video_id", "original_frame_id"], "left")
    from kinolith.operators.fusion import ranked

    top = ranked(j, [F.col("score").desc(), F.col("video_id"), F.col("start_ms"), F.col("evidence_id"), F.col("result_no")], ["query_id"]).filter("rank <= 20")
    return top.select("query_id", "result_no", "video_id", "evidence_id", "evidence_type", "object_key", F.round("timestamp_ms", 3).alias("timestamp_ms"), "rank")


@query(f"""WITH e AS (SELECT DISTINCT embedding_id, video_id, original_frame_id f, timestamp_ms t, model_name, model_version, vector v FROM embedding_result WHERE {_GOOD}), q AS (SELECT v qv, model_name qm, model_version qr FROM e ORDER BY embedding_id LIMIT 1),
vm AS (SELECT DISTINCT video_id, object_key FROM videos_manifest WHERE deleted_at IS NULL), al AS (SELECT upper(trim(video_id)) video_id, original_frame_id f, min(keyframe_no) keyframe_no FROM frame_aliases GROUP BY 1, 2)
SELECT embedding_id, e.video_id, object_key, keyframe_no, round(list_cosine_similarity(v::DOUBLE[], qv::DOUBLE[]), 5) score FROM e JOIN q ON model_name = qm AND len(v) = len(qv) JOIN vm USING (video_id) LEFT JOIN al ON al.video_id = e.video_id AND al.f = e.f
ORDER BY list_cosine_similarity(v::DOUBLE[], qv::DOUBLE[]) DESC, e.video_id, t, embedding_id LIMIT 25""")
def vector_branch(spark: SparkSession, d: str) -> DataFrame:
    """The vector branch: one model and dimension, live videos, keyframe where there is one, best 25; the best are found before the joins to wide rows."""
    e = table(spark, d, "embedding_result").filter(F.size("vector") == F.col("embedding_dim")).select("embedding_id", "video_id", "original_frame_id", "timestamp_ms", "model_name", "vector").filter(vector.unit("vector").isNotNull()).distinct()
    q = e.select(F.min_by(F.struct("vector", "model_name"), "embedding_id")).first()[0]
    score = vector.cosine("vector", F.array(*[F.lit(float(x)).cast("float") for x in q["vector"]]))
    live = table(spark, d, "videos_manifest").filter("deleted_at is null").select("video_id", "object_key").distinct()
    s = e.filter(F.col("model_name") == q["model_name"]).select("embedding_id", "video_id", "original_frame_id", "timestamp_ms", score.alias("s")).filter("s is not null")
    top = s.join(live, "video_id").orderBy(F.col("s").desc(), "video_id", "timestamp_ms", "embedding_id").limit(25)
    k = aliases(spark, d).groupBy("video_id", "original_frame_id").agg(F.min("keyframe_no").alias("keyframe_no"))
    return top.join(k, ["video_id", "original_frame_id"], "left").select("embedding_id", "video_id", "object_key", "keyframe_no", F.round("s", 5).alias("score"))


@query(f"""WITH {_AL}, e AS (SELECT DISTINCT embedding_id, video_id, original_frame_id, model_name, embedding_dim FROM embedding_result WHERE {_GOOD} AND original_frame_id IS NOT NULL), f AS (SELECT video_id, original_frame_id, min(embedding_id) embedding_id FROM e WHERE embedding_dim = 48 OR embedding_dim = (SELECT min(embedding_dim) FROM e) GROUP BY 1, 2)
SELECT DISTINCT al.video_id, original_frame_id, embedding_id FROM al JOIN f USING (video_id, original_frame_id)""".replace("embedding_dim = 48 OR ", ""))
def indexed_frames(spark: SparkSession, d: str) -> DataFrame:
    """The vector indexed for each keyframe's frame, the first by id among those of the smallest dimension."""
    e = table(spark, d, "embedding_result").filter(F.size("vector") == F.col("embedding_dim")).filter(vector.is_finite("vector") & (vector.norm("vector") > 0) & F.col("original_frame_id").isNotNull()).select("embedding_id", "video_id", "original_frame_id", "embedding_dim").distinct()
    least = e.agg(F.min("embedding_dim").alias("embedding_dim"))
    f = e.join(least, "embedding_dim").groupBy("video_id", "original_frame_id").agg(F.min("embedding_id").alias("embedding_id"))
    return aliases(spark, d).select("video_id", "original_frame_id").distinct().join(f, ["video_id", "original_frame_id"])


@query(f"""WITH {_AL}, {_FR}, p AS (SELECT video_id, original_frame_id, row_number() OVER (PARTITION BY video_id ORDER BY original_frame_id) - 1 pos FROM fr), n AS (SELECT video_id, max(pos) top FROM p GROUP BY 1)
SELECT al.video_id, keyframe_no, p.original_frame_id frame, CASE WHEN al.original_frame_id < 0 OR al.original_frame_id > coalesce(top, -1) THEN 'outside' ELSE 'found' END outcome FROM al LEFT JOIN n USING (video_id) LEFT JOIN p ON p.video_id = al.video_id AND p.pos = al.original_frame_id WHERE al.original_frame_id IS NOT NULL""")
def frames_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Frame ids of keyframes taken as places on the timeline; those outside of it are told."""
    a = aliases(spark, d).filter("original_frame_id is not null").select("video_id", "keyframe_no", F.col("original_frame_id").alias("pos"))
    return timeline.at_place(a, frames(spark, d), "pos").select("video_id", "keyframe_no", F.col("original_frame_id").alias("frame"), F.when(F.col("original_frame_id").isNull(), "outside").otherwise("found").alias("outcome"))


@query("""WITH x AS (SELECT DISTINCT doc_id, source, lang FROM documents) SELECT doc_id, source FROM x WHERE source <> 'caption' OR lang = 'en'""")
def shown_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are shown: captions in English only; those of unknown language are not."""
    return table(spark, d, "documents").select("doc_id", "source", "lang").distinct().filter("source <> 'caption' or lang = 'en'").select("doc_id", "source")


_LT, _LL = _TRGM.format(x="term"), _TRGM.format(x="event_label")


@query(f"""WITH t AS (SELECT DISTINCT alignment_id, event_ordinal, upper(trim(video_id)) video_id, event_label, original_frame_id f, selection_score s FROM trake_alignment WHERE selection_score >= 0.25), q AS (SELECT unnest(['film', 'surround']) term),
m AS (SELECT t.*, CASE WHEN event_label = term THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END sim FROM t, q, LATERAL (SELECT {_LL} a, {_LT} b)),
g AS (SELECT alignment_id, event_ordinal, video_id, event_label, max(sim * (0.75 + 0.25 * s)) sc FROM m WHERE sim > 0.2 GROUP BY 1, 2, 3, 4) SELECT alignment_id, event_ordinal, video_id, event_label, round(sc, 6)::DOUBLE score FROM g ORDER BY round(sc, 6) DESC, video_id, alignment_id, event_ordinal LIMIT 60""")
def object_branch(spark: SparkSession, d: str) -> DataFrame:
    """The label branch: exact labels, and as there are none, those that are alike; the best sixty."""
    t = table(spark, d, "trake_alignment").filter("selection_score >= 0.25").select("alignment_id", "event_ordinal", clean_id("video_id").alias("video_id"), "event_label", "selection_score").distinct()
    return text.label_branch(t, "event_label", "selection_score", ["film", "surround"], ["alignment_id", "event_ordinal", "video_id", "event_label"], ["video_id", "alignment_id", "event_ordinal"], 60)


@query(f"""WITH {_SR}, ev AS (SELECT DISTINCT evidence_id, evidence_type, producer, video_id FROM evidence), h AS (SELECT query_id, result_no, video_id, unnest(evidence_ids) evidence_id FROM sr),
own AS (SELECT query_id, result_no, evidence_type k, producer p FROM h JOIN ev USING (evidence_id)), vid AS (SELECT DISTINCT video_id, evidence_type k, producer p FROM ev),
alt AS (SELECT s.query_id, s.result_no, k, p FROM (SELECT query_id, result_no, video_id FROM sr) s JOIN vid USING (video_id) WHERE (s.query_id, s.result_no, k) NOT IN (SELECT (query_id, result_no, k) FROM own)),
u AS (SELECT DISTINCT query_id, result_no, k || '/' || p x FROM (SELECT * FROM own UNION ALL SELECT * FROM alt)) SELECT query_id, result_no, string_agg(x, ',' ORDER BY x) evidence FROM u GROUP BY 1, 2""")
def merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A result's own evidence, and of the kinds it lacks that of its video; each kind and producer once."""
    ev = table(spark, d, "evidence").select("evidence_id", "evidence_type", "producer", "video_id").distinct()
    r = latest(table(spark, d, "search_response").select("query_id", "result_no", "video_id", "evidence_ids", "ingested_at"), ["query_id", "result_no"], "ingested_at").withColumn("video_id", clean_id("video_id"))
    item = F.struct(F.col("evidence_type").alias("k"), F.col("producer").alias("p"))
    own = r.select("query_id", "result_no", F.explode("evidence_ids").alias("evidence_id")).join(ev, "evidence_id").groupBy("query_id", "result_no").agg(F.array_sort(F.collect_list(item)).alias("own"))
    vid = ev.groupBy("video_id").agg(F.array_sort(F.collect_set(item)).alias("alt"))
    j = r.select("query_id", "result_no", "video_id").join(own, ["query_id", "result_no"], "left").join(vid, "video_id", "left").filter("own is not null or alt is not null")
    m = contracts.merged_lists(F.col("own"), F.col("alt"), "k", "p")
    return j.select("query_id", "result_no", F.array_join(F.array_sort(F.transform(m, lambda x: F.concat_ws("/", x["k"], x["p"]))), ",").alias("evidence"))


@query(f"""WITH {_FR} SELECT video_id, original_frame_id, blur_score IS NULL OR isnan(blur_score) no_blur, CASE WHEN timestamp_ms IS NOT NULL AND NOT isnan(timestamp_ms) THEN round(timestamp_ms, 3)::DOUBLE END t FROM fr""")
def clean_records(spark: SparkSession, d: str) -> DataFrame:
    """Frames as JSON without NaN, read back."""
    j = frames(spark, d, "blur_score", "timestamp_ms").select("video_id", "original_frame_id", text.clean_json("blur_score", "timestamp_ms").alias("j"))
    return j.select("video_id", "original_frame_id", F.get_json_object("j", "$.blur_score").isNull().alias("no_blur"), F.round(F.get_json_object("j", "$.timestamp_ms").cast("double"), 3).alias("t"))


@query("""WITH t AS (SELECT * FROM (VALUES (NULL, 100, 500, 100), (20, 20, 500, 100), (700, 700, 700, 700), (5000, 5000, 5000, 1000), (20000, 10000, 10000, 1000)) v(asked, display, fusion, branch)) SELECT asked::INT asked, display, fusion, branch FROM t""")
def request_limits(spark: SparkSession, d: str) -> DataFrame:
    """How the limits of a request widen."""
    from kinolith.plans.planner import limits

    return spark.createDataFrame([(a, *limits(a)) for a in (None, 20, 700, 5_000, 20_000)], "asked int, display int, fusion int, branch int")


@query("""WITH l AS (SELECT DISTINCT event_label x FROM trake_alignment WHERE event_label IS NOT NULL) SELECT x alias, row_number() OVER (ORDER BY length(x) DESC, x)::INT place FROM l WHERE regexp_full_match(x, '[a-z0-9]+')""")
def alias_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Labels in the order in which a text is searched for them: longest first."""
    from kinolith.plans.planner import fold

    labels = [r[0] for r in table(spark, d, "trake_alignment").select("event_label").filter(F.col("event_label").rlike("^[a-z0-9]+$")).distinct().collect()]  # the ontology is small
    order = sorted({fold(x) for x in labels}, key=lambda x: (-len(x), x))
    return spark.createDataFrame([(x, i) for i, x in enumerate(order, 1)], "alias string, place int")


@query("""WITH v AS (SELECT DISTINCT video_id, codec FROM videos_manifest), n AS (SELECT video_id, 'scan' stage, true ok FROM v UNION ALL SELECT video_id, 'index', codec IS NOT NULL FROM v) SELECT video_id, CASE WHEN bool_and(ok) THEN 'completed' WHEN bool_or(ok) THEN 'partial' ELSE 'failed' END status FROM n GROUP BY 1""")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    """Status of each video's run from its stages."""
    v = table(spark, d, "videos_manifest").select("video_id", "codec").distinct()
    n = v.select("video_id", F.lit(True).alias("ok")).unionByName(v.select("video_id", F.col("codec").isNotNull().alias("ok")))
    return n.groupBy("video_id").agg(num.run_status("ok").alias("status"))


@query(f"""WITH {_SR} SELECT query_id, result_no, greatest(coalesce(start_ms, 0), 0) start_ms, greatest(coalesce(end_ms, 0), greatest(coalesce(start_ms, 0), 0) + 1) end_ms, coalesce(preview_uri, 'r2://unavailable/' || video_id) preview_uri, CASE WHEN original_frame_id IS NOT NULL THEN original_frame_id || '@' || greatest(coalesce(start_ms, 0), 0) END frame FROM sr WHERE result_no <= 10""")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results as they are answered: times within bounds, a preview, and the frame they stand for."""
    r = latest(table(spark, d, "search_response").select("query_id", "result_no", "video_id", "original_frame_id", "start_ms", "end_ms", "preview_uri", "ingested_at"), ["query_id", "result_no"], "ingested_at").withColumn("video_id", clean_id("video_id"))
    x = contracts.result_rows(r.withColumn("rank", F.col("result_no")).withColumn("object_key", F.lit(None).cast("string")), 10)
    return x.select("query_id", "result_no", "start_ms", "end_ms", "preview_uri", F.concat_ws("@", F.col("representative.original_frame_id").cast("string"), F.col("representative.timestamp_ms").cast("string")).alias("frame")).withColumn("frame", F.nullif("frame", F.lit("")))


@query(f"WITH {_AL} SELECT video_id, count(*) n_images, min(keyframe_no) first_no, max(keyframe_no) last_no FROM al WHERE keyframe_no % 5 = 0 GROUP BY 1")
def images_by_video(spark: SparkSession, d: str) -> DataFrame:
    """Keyframe images discovered below a folder, per video."""
    import uuid

    from kinolith.session import own_dir
    from kinolith.sources import files, readers

    k = aliases(spark, d).filter("keyframe_no % 5 = 0").select(F.concat("video_id", F.lit("/kf_"), F.lpad(F.col("keyframe_no").cast("string"), 6, "0"), F.lit(".webp")).alias("name"))
    root = f"{own_dir(spark)}/found-{uuid.uuid4().hex[:12]}"
    files.put_named(k.withColumn("body", F.col("name")), "name", "body", root).count()
    found = readers.index_keyframes(spark, root)
    return found.groupBy("video_id").agg(F.count("*").alias("n_images"), F.min("keyframe_no").alias("first_no"), F.max("keyframe_no").alias("last_no"))




@query(f"""WITH {_FR}, p AS (SELECT video_id, original_frame_id, text_change_score::DOUBLE s, brightness_score::DOUBLE b FROM fr WHERE NOT isnan(brightness_score) AND NOT isnan(text_change_score))
SELECT video_id, original_frame_id, round(coalesce(abs(b - lag(b) OVER w), 0), 9)::DOUBLE motion, round(coalesce(abs(s - lag(s) OVER w), 0), 9)::DOUBLE text_change FROM p WINDOW w AS (PARTITION BY video_id ORDER BY original_frame_id)""")
def text_signals(spark: SparkSession, d: str) -> DataFrame:
    """Change of picture and of text against the frame before, in one scan."""
    f = raw_frames(spark, d, "brightness_score", "text_change_score").filter("not isnan(brightness_score) and not isnan(text_change_score)")
    f = f.select("video_id", "original_frame_id", F.col("brightness_score").cast("double").alias("b"), F.col("text_change_score").cast("double").alias("s"))
    return timeline.change_signals(f, "b", "s", distinct=True).select("video_id", "original_frame_id", F.round("motion", 9).alias("motion"), F.round("text_change", 9).alias("text_change"))


@query(f"""WITH e AS (SELECT DISTINCT model_name, embedding_dim, video_id, embedding_id, vector::DOUBLE[] v FROM embedding_result WHERE {_GOOD})
SELECT a.embedding_id embedding_id_a, b.embedding_id embedding_id_b FROM e a JOIN e b ON a.model_name = b.model_name AND a.embedding_dim = b.embedding_dim AND a.video_id = b.video_id AND a.embedding_id < b.embedding_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.6""")
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of a video and model that are alike, by pairs of blocks."""
    from kinolith.operators import selection

    e = table(spark, d, "embedding_result").filter(F.size("vector") == F.col("embedding_dim")).filter(vector.is_finite("vector") & (vector.norm("vector") > 0)).select("model_name", "embedding_dim", "video_id", "embedding_id", "vector").distinct()
    rows = selection.placed(e, ["model_name", "embedding_dim", "video_id"], "vector", "embedding_id", "embedding_id")
    near = selection.similar_places(rows, "vector", 0.6, True, False, 2048).select("grp_", "pos_", F.explode("earlier").alias("before_"))
    at = rows.select("grp_", F.col("pos_"), F.col("embedding_id").alias("embedding_id_b"))
    j = near.join(at, ["grp_", "pos_"]).join(at.select("grp_", F.col("pos_").alias("before_"), F.col("embedding_id_b").alias("embedding_id_a")), ["grp_", "before_"])
    return j.select("embedding_id_a", "embedding_id_b")


@query(f"""WITH {_AL}, k AS (SELECT video_id, keyframe_no, thumbnail_object_key path, keyframe_no % 4 <> 0 eligible, keyframe_no % 6 <> 1 selected FROM al) SELECT video_id, keyframe_no, path FROM k WHERE eligible AND selected AND path IS NOT NULL""")
def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes that are to be embedded: eligible, selected and with an image, from their manifest."""
    import uuid

    from kinolith.session import own_dir
    from kinolith.sources import readers, writers

    a = aliases(spark, d).select("video_id", "keyframe_no", F.col("thumbnail_object_key").alias("path"), (F.col("keyframe_no") % 4 != 0).alias("eligible_for_embedding"), (F.col("keyframe_no") % 6 != 1).alias("selected_for_retrieval"))
    at = f"{own_dir(spark)}/keyframes-{uuid.uuid4().hex[:12]}.parquet"
    writers.write_table(a, at)
    return readers.read_keyframes(spark, at).select("video_id", "keyframe_no", "path")


@query(f"""WITH t AS (SELECT DISTINCT alignment_id, event_ordinal, upper(trim(video_id)) video_id, timestamp_ms t FROM trake_alignment WHERE timestamp_ms IS NOT NULL), {_FR}, f AS (SELECT video_id, original_frame_id, timestamp_ms ms FROM fr WHERE timestamp_ms IS NOT NULL),
j AS (SELECT alignment_id, event_ordinal, original_frame_id, row_number() OVER (PARTITION BY alignment_id, event_ordinal ORDER BY abs(ms - t), ms, original_frame_id) n FROM t JOIN f USING (video_id)) SELECT alignment_id, event_ordinal, original_frame_id near_frame FROM j WHERE n = 1""")
def frame_at_time(spark: SparkSession, d: str) -> DataFrame:
    """The frame nearest in time to each event, ties to the earlier."""
    from kinolith.operators import temporal

    t = table(spark, d, "trake_alignment").filter("timestamp_ms is not null").select("alignment_id", "event_ordinal", clean_id("video_id").alias("video_id"), F.col("timestamp_ms").cast("double").alias("t")).distinct()
    f = frames(spark, d, "timestamp_ms").select("video_id", "original_frame_id", F.col("timestamp_ms").alias("ms"))
    near = temporal.nearest_row(t, f, "video_id", "t", "ms", ["ms", "original_frame_id"], ["original_frame_id"], block=600_000)
    return near.filter("near_original_frame_id is not null").select("alignment_id", "event_ordinal", F.col("near_original_frame_id").alias("near_frame"))


@query("""WITH e AS (SELECT DISTINCT * FROM evidence), x AS (SELECT 'caption' m UNION ALL SELECT 'ocr' UNION ALL SELECT 'asr' UNION ALL SELECT 'object')
SELECT m modality, count(evidence_id) n_seen, count(*) FILTER (deleted_at IS NULL AND confidence BETWEEN 0 AND 1 AND end_ms > start_ms) n_good, count(*) FILTER (evidence_id IS NOT NULL AND confidence IS NULL) n_no_confidence, count(*) FILTER (evidence_id IS NOT NULL AND NOT coalesce(end_ms > start_ms, false)) n_no_interval,
 count(DISTINCT producer) n_producers, count(DISTINCT video_id) n_videos FROM x LEFT JOIN e ON evidence_type = m GROUP BY 1""")
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    """What an import of each modality would bring: rows, good ones, what is wrong, producers and videos."""
    e = table(spark, d, "evidence").distinct()
    good = F.col("deleted_at").isNull() & F.col("confidence").between(0, 1) & (F.col("end_ms") > F.col("start_ms"))
    g = e.groupBy(F.col("evidence_type").alias("modality")).agg(
        F.count("*").alias("n_seen"), F.count_if(good).alias("n_good"), F.count_if(F.col("confidence").isNull()).alias("n_no_confidence"),
        F.count_if(~F.coalesce(F.col("end_ms") > F.col("start_ms"), F.lit(False))).alias("n_no_interval"), F.countDistinct("producer").alias("n_producers"), F.countDistinct("video_id").alias("n_videos"),
    )
    names = spark.createDataFrame([(m,) for m in ("caption", "ocr", "asr", "object")], "modality string")
    counts = [c for c in g.columns if c != "modality"]
    return names.join(g, "modality", "left").select("modality", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


@query("""SELECT DISTINCT model_name || ':' || model_version feature_set, embedding_dim FROM embedding_result WHERE embedding_dim IS NOT NULL""")
def feature_sets(spark: SparkSession, d: str) -> DataFrame:
    """The different feature sets of the vectors."""
    return table(spark, d, "embedding_result").filter("embedding_dim is not null").select(F.concat("model_name", F.lit(":"), "model_version").alias("feature_set"), "embedding_dim").distinct()


@query("""WITH v AS (SELECT DISTINCT video_id, width w, height h FROM videos_manifest WHERE width IS NOT NULL AND height IS NOT NULL), b AS (SELECT video_id, w, h, unnest(range(0, 3)) i FROM v),
x AS (SELECT *, i * 100 x1, i * 50 y1, CASE WHEN i = 2 THEN w + 1 ELSE w // 2 + i END x2, h // 2 y2 FROM b)
SELECT video_id, i::INT ordinal, 'label' || i "label", round(x1 / w::DOUBLE, 6)::DOUBLE x, round(x2 / w::DOUBLE, 6)::DOUBLE x_end FROM x WHERE x1 >= 0 AND x1 < x2 AND y1 >= 0 AND y1 < y2 AND x2 <= w AND y2 <= h""")
def detection_records(spark: SparkSession, d: str) -> DataFrame:
    """Detections as evidence with boxes over the picture's size; boxes that do not fit are left out."""
    v = table(spark, d, "videos_manifest").filter("width is not null and height is not null").select("video_id", "width", "height").distinct()
    item = lambda i: F.struct(F.concat(F.lit("label"), i.cast("string")).alias("label"), F.lit(0.9).alias("confidence"), F.array((i * 100).cast("double"), (i * 50).cast("double"), F.when(i == 2, F.col("width") + 1).otherwise(F.floor(F.col("width") / 2) + i).cast("double"), F.floor(F.col("height") / 2).cast("double")).alias("box"))
    x = v.withColumn("detections", F.transform(F.sequence(F.lit(0), F.lit(2)), item))
    out = contracts.detections(x, "detections", "width", "height")
    return out.select("video_id", "ordinal", "label", F.round(F.col("box")[0], 6).alias("x"), F.round(F.col("box")[2], 6).alias("x_end"))
