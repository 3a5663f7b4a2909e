"""Queries over keyframe curation, mapping jobs and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.operators import contracts, curation, fusion, mapping, selection, temporal, timeline
from kinolith.plans.catalog import Catalog
from kinolith.plans.ingest import _AL, aliases
from kinolith.plans.timeline import _FR, _SHOTS, _shots, frames
from kinolith.session import clean_id, latest, table

CATALOG = Catalog()
query = CATALOG.query
_T = "t AS (SELECT DISTINCT * REPLACE (upper(trim(video_id)) AS video_id) FROM trake_alignment)"

_TARGETS = """tg AS (SELECT video_id, shot_id, start_frame, end_frame, unnest(CASE WHEN d < 3 THEN [a + d / 2] WHEN d <= 4 THEN [a + d * 0.25, a + d * 0.5, a + d * 0.75]
   ELSE list_transform(range(0, greatest(ceil(d - 0.5), 1)::BIGINT), lambda i: a + 0.5 + i) END) * 1000 target FROM (SELECT *, start_frame / 25.0::DOUBLE a, (end_frame + 1) / 25.0::DOUBLE - start_frame / 25.0::DOUBLE d FROM shots)),
q AS (SELECT DISTINCT video_id, original_frame_id o, timestamp_ms t, blur_score b, contrast_score c, blur_score >= 1 ok FROM frame_manifest WHERE original_frame_id IS NOT NULL AND timestamp_ms IS NOT NULL AND NOT isnan(blur_score) AND NOT isnan(contrast_score)),
i AS (SELECT q.*, shot_id, start_frame, end_frame FROM q JOIN shots ON q.video_id = shots.video_id AND o BETWEEN start_frame AND end_frame),
sn AS (SELECT i.video_id, i.shot_id, target, arg_min(o, {'d': abs(t - target), 'o': o}) f FROM tg JOIN i USING (video_id, shot_id) GROUP BY 1, 2, 3)"""


def _frames(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "timestamp_ms", "blur_score", "contrast_score").filter("timestamp_ms is not null and not isnan(blur_score) and not isnan(contrast_score)")
    return f.withColumn("t", F.col("timestamp_ms")).withColumn("ok", F.col("blur_score") >= 1)


@query(f"WITH {_SHOTS}, {_TARGETS} SELECT video_id, shot_id, round(target, 3)::DOUBLE target, f original_frame_id FROM sn")
def snapped_targets(spark: SparkSession, d: str) -> DataFrame:
    """The frame nearest in time to each target of its shot."""
    s = _shots(spark, d)
    t = s.select("video_id", "shot_id", F.explode(timeline.shot_targets(F.col("start_frame") / 25.0, (F.col("end_frame") + 1) / 25.0)).alias("s")).withColumn("target", F.col("s") * 1000)
    x = timeline.snap_targets(t, timeline.frames_in_shots(_frames(spark, d), s), ["video_id", "shot_id"], "t", "target")
    return x.filter("original_frame_id is not null").withColumn("target", F.round("target", 3))


@query(f"""WITH {_SHOTS}, {_TARGETS}, ca AS (SELECT video_id, shot_id, f, 'anchor' r FROM sn UNION SELECT video_id, shot_id, min(o), 'first' FROM i GROUP BY 1, 2 UNION SELECT video_id, shot_id, max(o), 'last' FROM i GROUP BY 1, 2),
cr AS (SELECT video_id, shot_id, f, list(DISTINCT r) roles FROM ca GROUP BY 1, 2, 3),
ch AS (SELECT cr.video_id, cr.shot_id, f, any_value(roles) roles, arg_max(q.o, {{'k': ok, 'b': b, 'c': c, 'd': -abs(q.o - f), 'o': -q.o}}) o FROM cr JOIN shots USING (video_id, shot_id) JOIN q ON q.video_id = cr.video_id AND q.o BETWEEN greatest(f - 3, start_frame) AND least(f + 3, end_frame) GROUP BY 1, 2, 3),
un AS (SELECT ch.video_id, ch.o, ch.shot_id, ch.f, unnest(roles) r FROM ch JOIN q ON q.video_id = ch.video_id AND q.o = ch.o AND q.ok)
SELECT video_id, o original_frame_id, string_agg(DISTINCT shot_id, ',' ORDER BY shot_id) shot_ids, string_agg(DISTINCT r, ',' ORDER BY r) roles, count(DISTINCT shot_id * 10000000 + f) n_targets FROM un GROUP BY 1, 2""")
def selected_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames chosen around a shot's targets and ends, with the shots and reasons that asked for them."""
    f = _frames(spark, d)
    causes = curation.shot_causes(_shots(spark, d), f, {})
    x = curation.selected_frames(causes, f, 3)
    return x.select("video_id", "original_frame_id", F.array_join("shot_ids", ",").alias("shot_ids"), F.array_join("roles", ",").alias("roles"), "n_targets")


@query(f"WITH {_SHOTS} SELECT video_id, shot_id, round(unnest(CASE WHEN d < 3 THEN [a + d / 2] WHEN d <= 4 THEN [a + d * 0.25, a + d * 0.5, a + d * 0.75] ELSE list_transform(range(0, greatest(ceil(d - 0.5), 1)::BIGINT), lambda i: a + 0.5 + i) END), 3)::DOUBLE t FROM (SELECT *, start_frame / 25.0::DOUBLE a, (end_frame + 1) / 25.0::DOUBLE - start_frame / 25.0::DOUBLE d FROM shots)")
def shot_sample_times(spark: SparkSession, d: str) -> DataFrame:
    """Target times of every shot."""
    t = timeline.shot_targets(F.col("start_frame") / 25.0, (F.col("end_frame") + 1) / 25.0)
    return _shots(spark, d).select("video_id", "shot_id", F.explode(t).alias("t")).withColumn("t", F.round("t", 3))


@query(f"""WITH {_FR}, p AS (SELECT video_id, original_frame_id, row_number() OVER (PARTITION BY video_id ORDER BY original_frame_id) - 1 place FROM fr), n AS (SELECT video_id, max(place) // 50 top FROM p GROUP BY 1),
w AS (SELECT video_id, unnest(range(0, top + 1)) window_id FROM n)
SELECT w.video_id, window_id, count(*) n_seen, count(*) FILTER (place + 25 - window_id * 50 BETWEEN 25 AND 74) n_kept, min(original_frame_id) first_id, max(original_frame_id) last_id FROM w JOIN p ON p.video_id = w.video_id AND place + 25 - window_id * 50 BETWEEN 0 AND 99 GROUP BY 1, 2""")
def inference_windows(spark: SparkSession, d: str) -> DataFrame:
    """What a shot model sees and keeps per window of 100 frames."""
    w = curation.inference_windows(frames(spark, d))
    return w.groupBy("video_id", "window_id").agg(F.count("*").alias("n_seen"), F.count_if("kept").alias("n_kept"), F.min("original_frame_id").alias("first_id"), F.max("original_frame_id").alias("last_id"))


_MANIFEST = f"""{_AL}, m AS (SELECT video_id, keyframe_no, original_frame_id f, CASE WHEN keyframe_no % 17 = 0 THEN original_frame_id + 1 WHEN keyframe_no % 2 = 0 THEN original_frame_id END cand, timestamp_ms, video_id || '.csv' map_file, keyframe_no row_index, thumbnail_object_key k0 FROM al),
im AS (SELECT video_id, keyframe_no, min(thumbnail_object_key) k FROM al WHERE keyframe_no % 19 <> 0 AND thumbnail_object_key IS NOT NULL GROUP BY 1, 2), mm AS (SELECT m.*, k, count(*) OVER (PARTITION BY video_id, keyframe_no) n FROM m LEFT JOIN im USING (video_id, keyframe_no)),
good AS (SELECT * FROM mm WHERE n = 1 AND f >= 0 AND keyframe_no >= 1 AND (cand IS NULL OR cand = f) AND k IS NOT NULL AND video_id <> ''),
ar AS (SELECT *, count(*) OVER (PARTITION BY video_id, f) size, row_number() OVER (PARTITION BY video_id, f ORDER BY keyframe_no, row_index) place FROM good)"""


def _alias_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = aliases(spark, d)
    f = F.col("original_frame_id")
    m = a.select("video_id", "keyframe_no", f.alias("source_frame_idx"), F.when(F.col("keyframe_no") % 17 == 0, f + 1).when(F.col("keyframe_no") % 2 == 0, f).alias("candidate_id"), "timestamp_ms", F.concat("video_id", F.lit(".csv")).alias("source_map_file"), F.col("keyframe_no").alias("source_row_index"))
    images = a.filter("keyframe_no % 19 <> 0 and thumbnail_object_key is not null").select("video_id", "keyframe_no", F.col("thumbnail_object_key").alias("object_key"))
    return curation.alias_rows(m, images, "media")


@query(f"""WITH {_MANIFEST} SELECT video_id, keyframe_no, f original_frame_id, timestamp_ms, 'r2://media/' || k storage_uri, size duplicate_group_size, place duplicate_occurrence_ordinal, md5(json_object('duplicate_group_size', size, 'duplicate_occurrence_ordinal', place, 'source_frame_idx', f, 'source_map_file', map_file, 'source_row_index', row_index)::VARCHAR) metadata_key FROM ar""")
def alias_table(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of a keyframe manifest with address, place among those of their frame, and metadata."""
    rows, _ = _alias_rows(spark, d)
    n = lambda c: F.get_json_object("metadata", f"$.{c}").cast("long").alias(c)
    return rows.select("video_id", "keyframe_no", "original_frame_id", "timestamp_ms", "storage_uri", n("duplicate_group_size"), n("duplicate_occurrence_ordinal"), F.md5("metadata").alias("metadata_key"))


@query(f"""WITH {_MANIFEST}, v AS (SELECT video_id, keyframe_no, unnest(['repeated', 'source_frame_idx', 'candidate', 'image']) r, unnest([n > 1, coalesce(f < 0, true), CASE WHEN cand IS NULL THEN false ELSE coalesce(cand <> f, true) END, k IS NULL]) bad FROM mm) SELECT video_id, keyframe_no, r violation FROM v WHERE bad""")
def alias_violations(spark: SparkSession, d: str) -> DataFrame:
    """What keeps a manifest row from being an alias."""
    return _alias_rows(spark, d)[1]


@query(f"""WITH {_MANIFEST} SELECT video_id, f original_frame_id, min(keyframe_no) keyframe_no, arg_min(timestamp_ms, keyframe_no) timestamp_ms, arg_min(k, keyframe_no) thumbnail_object_key, count(*) alias_count, string_agg(DISTINCT map_file, ',') source_map_files FROM ar GROUP BY 1, 2""")
def canonical_frames(spark: SparkSession, d: str) -> DataFrame:
    """One row per frame from its aliases."""
    c = curation.canonical_rows(_alias_rows(spark, d)[0])
    return c.select("video_id", "original_frame_id", "keyframe_no", "timestamp_ms", "thumbnail_object_key", "alias_count", F.array_join("source_map_files", ",").alias("source_map_files"))


_RES = f"""{_AL}, {_FR}, rs AS (SELECT al.*, round(fr.timestamp_ms)::BIGINT ms FROM al JOIN fr USING (video_id, original_frame_id))"""


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(aliases whose frame exists, frames)."""
    f = frames(spark, d, "timestamp_ms")
    return aliases(spark, d).join(f.select("video_id", "original_frame_id"), ["video_id", "original_frame_id"], "left_semi"), f


@query(f"""WITH {_RES} SELECT video_id, keyframe_no, original_frame_id, ms timestamp_ms, json_extract_string(metadata, '$.selected_by') selected_by, timestamp_ms old_ms, 'resolved' status FROM rs""")
def alias_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Aliases with the time of their frame; the old time stays in the metadata."""
    a, f = _resolved(spark, d)
    found = a.select("video_id", "keyframe_no", F.col("original_frame_id").alias("frame")).join(f.select("video_id", F.col("original_frame_id").alias("frame"), F.round("timestamp_ms").cast("long").alias("ms")), ["video_id", "frame"])
    x = curation.refresh_aliases(a, found.select("video_id", "keyframe_no", "frame", "ms"))
    j = lambda k: F.get_json_object("metadata", f"$.{k}")
    return x.select("video_id", "keyframe_no", "original_frame_id", "timestamp_ms", j("selected_by").alias("selected_by"), j("source_timestamp_ms_candidate").cast("long").alias("old_ms"), j("mapping_status").alias("status"))


@query(f"""WITH {_RES}, x AS (SELECT video_id, count(*) n, count(DISTINCT original_frame_id) n_frames, min(original_frame_id) first_id, max(original_frame_id) last_id, min(ms) first_ms, max(ms) last_ms FROM rs GROUP BY 1) SELECT *, n n_images, last_id last_image FROM x""")
def resolved_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """All artifacts brought to the frames of a map, and the map's index per video."""
    a, f = _resolved(spark, d)
    source = a.select("video_id", "keyframe_no", F.col("original_frame_id").alias("source_frame_idx"))
    out, index = curation.resolve_artifacts(source, f, {"images": a.select("video_id", "keyframe_no", "thumbnail_object_key")}, a)
    images = out["images"].groupBy("video_id").agg(F.count("*").alias("n_images"), F.max("original_frame_id").alias("last_image"))
    return index.join(images, "video_id")


_REL = """r0 AS (SELECT DISTINCT index_version, dataset_version FROM search_response), rel AS (SELECT *, CASE WHEN index_version = (SELECT max(index_version) FROM r0) THEN 'active' ELSE 'retired' END status FROM r0)"""


def _releases(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_response").select("index_version", "dataset_version").distinct()
    top = r.agg(F.max("index_version").alias("top"))
    j = r.join(top, F.col("index_version") == F.col("top"), "left")
    return j.select("index_version", "dataset_version", F.when(F.col("top").isNotNull(), "active").otherwise("retired").alias("status"))


@query(f"""WITH {_REL}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1)
SELECT query_id, result_no, index_version, dataset_version FROM h SEMI JOIN (SELECT * FROM rel WHERE status = 'active') a USING (index_version, dataset_version)""")
def active_release_hits(spark: SparkSession, d: str) -> DataFrame:
    """Results that belong to the active release."""
    h = latest(table(spark, d, "search_response").select("query_id", "result_no", "index_version", "dataset_version", "ingested_at"), ["query_id", "result_no"], "ingested_at")
    return curation.active(h, _releases(spark, d)).select("query_id", "result_no", "index_version", "dataset_version")


@query(f"""WITH {_REL}, f AS (SELECT DISTINCT evidence_type modality, producer || '-1' feature_set_id FROM evidence), o AS (SELECT index_version, modality, dataset_version, min(feature_set_id) feature_set_id FROM rel, f GROUP BY 1, 2, 3),
n AS (SELECT 'next' index_version, modality, 'd9' dataset_version, max(feature_set_id) || 'b' feature_set_id FROM f GROUP BY 2)
SELECT index_version, modality, o.dataset_version, feature_set_id, rel.status FROM o JOIN rel USING (index_version) WHERE rel.dataset_version = o.dataset_version UNION ALL SELECT index_version, modality, dataset_version, feature_set_id, 'staged' FROM n""")
def staged_release(spark: SparkSession, d: str) -> DataFrame:
    """Releases and their features after a new one was staged twice."""
    rel = _releases(spark, d)
    f = table(spark, d, "evidence").select(F.col("evidence_type").alias("modality"), F.concat("producer", F.lit("-1")).alias("feature_set_id")).distinct()
    versions = rel.agg(F.collect_list(F.struct("index_version", "dataset_version")).alias("rs"))  # releases are few
    held = f.groupBy("modality").agg(F.min("feature_set_id").alias("feature_set_id"))
    features = held.join(versions, F.lit(True)).select(F.explode("rs").alias("r"), "modality", "feature_set_id").select("r.index_version", "modality", "r.dataset_version", "feature_set_id")
    sets = f.groupBy("modality").agg(F.concat(F.max("feature_set_id"), F.lit("b")).alias("feature_set_id"))
    for _ in range(2):
        rel, features = curation.staged_release(rel, features, "next", "d9", sets)
    return features.join(rel, ["index_version", "dataset_version"]).select("index_version", "modality", "dataset_version", "feature_set_id", "status")


@query(f"""WITH {_FR}, h AS (SELECT DISTINCT upper(trim(video_id)) video_id, original_frame_id f FROM trake_alignment WHERE original_frame_id IS NOT NULL), tf AS (SELECT video_id, original_frame_id o, timestamp_ms t FROM fr WHERE timestamp_ms IS NOT NULL),
a AS (SELECT h.*, t FROM h JOIN tf ON tf.video_id = h.video_id AND o = f WHERE t >= 0), b AS (SELECT a.video_id, f, min(o) s, max(o) + 1 e, arg_min(tf.t, o) st, arg_max(tf.t, o) inside FROM a JOIN tf ON tf.video_id = a.video_id AND tf.t BETWEEN greatest(0, a.t - 500) AND a.t + 500 GROUP BY 1, 2),
l AS (SELECT video_id, arg_max(t, o) t1, count(*) n, max(o) m FROM tf GROUP BY 1), l2 AS (SELECT tf.video_id, arg_max(t, o) t2 FROM tf JOIN l ON l.video_id = tf.video_id AND o < m GROUP BY 1)
SELECT b.video_id, f original_frame_id, s start_frame, e end_frame, round(st, 3)::DOUBLE start_ms, round(coalesce(n.t, CASE WHEN l.n > 1 THEN t1 + greatest(t1 - t2, 0) END, inside), 3)::DOUBLE end_ms FROM b LEFT JOIN tf n ON n.video_id = b.video_id AND n.o = e LEFT JOIN l ON l.video_id = b.video_id LEFT JOIN l2 ON l2.video_id = b.video_id""")
def hit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Half a second around each event's frame, as frames and times."""
    h = table(spark, d, "trake_alignment").filter("original_frame_id is not null").select(clean_id("video_id").alias("video_id"), "original_frame_id").distinct()
    w = timeline.hit_windows(h, frames(spark, d, "timestamp_ms"), 500.0).filter("start_frame is not null")
    return w.select("video_id", "original_frame_id", "start_frame", "end_frame", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"))


_EV = f"""{_T}, {_FR}, w AS (SELECT DISTINCT alignment_id || '/' || event_ordinal wid, video_id, original_frame_id - 2 a, original_frame_id + 3 b FROM t WHERE original_frame_id IS NOT NULL),
x AS (SELECT wid, video_id, unnest(range(a, b)) f FROM w), s AS (SELECT x.wid, x.video_id, f, scene_change_score::DOUBLE sc FROM x JOIN fr ON fr.video_id = x.video_id AND original_frame_id = f WHERE isfinite(scene_change_score)),
bad AS (SELECT x.wid, x.video_id, x.f FROM x LEFT JOIN s USING (wid, video_id, f) WHERE sc IS NULL)"""


def _event_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "trake_alignment").filter("original_frame_id is not null").select("alignment_id", "event_ordinal", clean_id("video_id").alias("video_id"), "original_frame_id").distinct()
    w = t.select(F.concat_ws("/", "alignment_id", F.col("event_ordinal").cast("string")).alias("event_window_id"), "video_id", (F.col("original_frame_id") - 2).alias("start_frame"), (F.col("original_frame_id") + 3).alias("end_frame"))
    f = frames(spark, d, "scene_change_score").filter("not isnan(scene_change_score)").select("video_id", "original_frame_id", F.col("scene_change_score").cast("double").alias("score"))
    asked = w.withColumn("original_frame_id", F.explode(F.sequence(F.col("start_frame"), F.col("end_frame") - 1))).select("event_window_id", "video_id", "original_frame_id")
    return w, asked.join(f, ["video_id", "original_frame_id"]).select("event_window_id", "video_id", "original_frame_id", "score")


@query(f"WITH {_EV} SELECT wid event_window_id, video_id, f original_frame_id, 'missing' violation FROM bad UNION ALL SELECT wid, video_id, f, 'covered' FROM s WHERE wid NOT IN (SELECT wid FROM bad)")
def event_cover(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the event windows that have each frame once, and what the others lack."""
    good, bad = timeline.event_scores(*_event_windows(spark, d))
    keys = ["event_window_id", "video_id", "original_frame_id"]
    return bad.select(*keys, "violation").unionByName(good.select(*keys, F.lit("covered").alias("violation")))


@query(f"""WITH {_EV}, g AS (SELECT s.*, 1 / (1 + abs(f - (a + b - 1) / 2)) tp FROM s JOIN w USING (wid, video_id) WHERE wid NOT IN (SELECT wid FROM bad) AND hash_skip = 0), n AS (SELECT *, min(sc) OVER p lo, max(sc) OVER p hi FROM g WINDOW p AS (PARTITION BY wid, video_id)),
k AS (SELECT *, CASE WHEN hi > lo THEN (sc - lo) / (hi - lo) ELSE 0 END e FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY wid, video_id ORDER BY round(0.8 * e + 0.2 * tp, 9) DESC, round(e, 9) DESC, round(tp, 9) DESC, f) i FROM k)
SELECT wid event_window_id, video_id, f original_frame_id FROM r WHERE i = 1""".replace(" AND hash_skip = 0", " AND wid NOT LIKE '%/2'"))
def dense_choice(spark: SparkSession, d: str) -> DataFrame:
    """One frame per covered event window by score and nearness to the middle; windows done before (the second events) are skipped."""
    w, scores = _event_windows(spark, d)
    w = w.withColumn("fingerprint", F.md5(F.concat_ws(":", "event_window_id", "start_frame", "end_frame")))
    done = w.filter(F.col("event_window_id").endswith("/2")).select("event_window_id", "fingerprint")
    chosen, _ = curation.dense_windows(w, scores, frames(spark, d), {"external": 0.8, "target": 0.2}, done)
    return chosen.select("event_window_id", "video_id", "original_frame_id")


@query("""WITH s AS (SELECT DISTINCT evidence_id, evidence_type, producer, video_id FROM evidence), g AS (SELECT evidence_type, producer, video_id, count(*) n FROM s GROUP BY 1, 2, 3),
f AS (SELECT *, 'd1:fs_' || substr(sha256(evidence_type || chr(31) || producer || chr(31) || 'p1'), 1, 32) fs FROM g) SELECT fs feature_set_id, evidence_type modality, producer, sum(n)::BIGINT n_records, count(*) n_artifacts, min('artifact_' || substr(sha256(evidence_type || chr(31) || 'file:///' || video_id), 1, 32)) first_artifact FROM f GROUP BY 1, 2, 3""")
def provenance_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Feature sets and artifacts of an import with ids that depend on their content only."""
    e = table(spark, d, "evidence").select("evidence_id", "evidence_type", "producer", "video_id").distinct()
    s = e.groupBy(F.col("evidence_type").alias("modality"), "producer", "video_id").agg(F.count("*").alias("n_records"))
    s = s.select(F.lit("d1").alias("dataset_version"), "modality", "producer", F.lit("p1").alias("pipeline_version"), F.concat(F.lit("file:///"), "video_id").alias("uri"), "n_records", F.lit(0).alias("size_bytes"), F.lit("").alias("checksum"))
    sets, artifacts = curation.provenance(s, "i1")
    first = artifacts.groupBy("feature_set_id").agg(F.min("artifact_id").alias("first_artifact"))
    return sets.join(first, "feature_set_id").select("feature_set_id", "modality", "producer", "n_records", "n_artifacts", "first_artifact")


@query("""WITH v AS (SELECT DISTINCT video_id, duration_ms / 1000.0 dur FROM videos_manifest), k AS (SELECT DISTINCT upper(trim(video_id)) video_id, keyframe_no, timestamp_ms / 1000.0 t FROM frame_aliases WHERE timestamp_ms IS NOT NULL),
a AS (SELECT video_id, t FROM k SEMI JOIN v USING (video_id) UNION ALL SELECT video_id, 0 FROM v UNION ALL SELECT video_id, dur FROM v), g AS (SELECT video_id, t - lag(t) OVER (PARTITION BY video_id ORDER BY t) gap FROM a), c AS (SELECT video_id, round(max(gap), 2)::DOUBLE max_gap_s FROM g GROUP BY 1)
SELECT 'widest' list, video_id, max_gap_s FROM (SELECT * FROM c ORDER BY max_gap_s DESC, video_id LIMIT 5) UNION ALL SELECT 'tightest', video_id, max_gap_s FROM (SELECT * FROM c ORDER BY max_gap_s, video_id LIMIT 10)""")
def worst_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The five videos with the widest gap and the ten with the least."""
    v = table(spark, d, "videos_manifest").select("video_id", (F.col("duration_ms") / 1000.0).alias("duration_s")).distinct()
    k = table(spark, d, "frame_aliases").filter("timestamp_ms is not null").select(clean_id("video_id").alias("video_id"), "keyframe_no", (F.col("timestamp_ms") / 1000.0).alias("t")).distinct()
    c = timeline.coverage(k, v)
    return curation.worst(c, "max_gap_s", 5, "video_id").select(F.lit("widest").alias("list"), "video_id", "max_gap_s").unionByName(curation.worst(c, "max_gap_s", 10, "video_id", False).select(F.lit("tightest").alias("list"), "video_id", "max_gap_s"))


@query(f"""WITH {_T}, x AS (SELECT video_id, alignment_id, event_ordinal, CASE WHEN event_ordinal % 3 = 0 THEN NULL ELSE event_label END a, row_number() OVER (PARTITION BY video_id ORDER BY alignment_id, event_ordinal) seen FROM t),
c AS (SELECT video_id, a, count(*) n, min(seen) f FROM x WHERE a IS NOT NULL GROUP BY 1, 2), m AS (SELECT video_id, arg_max(a, {{'n': n, 'f': -f}}) best FROM c GROUP BY 1) SELECT video_id, alignment_id, event_ordinal, coalesce(a, best) answer FROM x LEFT JOIN m USING (video_id)""")
def filled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Open answers filled with the most frequent one of their video, the first seen winning ties."""
    from pyspark.sql import Window

    t = table(spark, d, "trake_alignment").withColumn("video_id", clean_id("video_id")).distinct()
    seen = F.row_number().over(Window.partitionBy("video_id").orderBy("alignment_id", "event_ordinal"))
    x = t.select("video_id", "alignment_id", "event_ordinal", F.when(F.col("event_ordinal") % 3 != 0, F.col("event_label")).alias("answer"), seen.alias("seen"))
    return fusion.backfill_majority(x, ["video_id"], "answer", "seen").select("video_id", "alignment_id", "event_ordinal", "answer")


@query(f"WITH {_AL}, v AS (SELECT DISTINCT video_id, codec, fps_str FROM videos_manifest) SELECT video_id, keyframe_no, codec, fps_str FROM al JOIN v USING (video_id)")
def merged_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases with their video's codec: a merge that fails on videos that repeat or lack."""
    v = table(spark, d, "videos_manifest").select("video_id", "codec", "fps_str").distinct()
    a = aliases(spark, d).select("video_id", "keyframe_no").join(v.select("video_id"), "video_id", "left_semi")
    return mapping.merge_checked(a, v, ["video_id"]).select("video_id", "keyframe_no", "codec", "fps_str")


@query(f"WITH {_SHOTS}, m AS (SELECT video_id, shot_id, CASE WHEN shot_id % 5 = 3 THEN start_frame + 1 ELSE start_frame END s, end_frame e FROM shots), x AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY video_id ORDER BY s) + 1, 0) want FROM m) SELECT video_id, shot_id, s start_frame, want FROM x WHERE s <> want OR e < s")
def shot_table_checks(spark: SparkSession, d: str) -> DataFrame:
    """Shots that do not follow each other (some starts are moved by one)."""
    s = _shots(spark, d).withColumn("start_frame", F.when(F.col("shot_id") % 5 == 3, F.col("start_frame") + 1).otherwise(F.col("start_frame")))
    return timeline.shot_violations(s)


@query(f"""WITH {_AL} SELECT video_id, keyframe_no, CASE WHEN keyframe_no % 13 = 0 THEN NULL ELSE original_frame_id END source_frame_idx, CASE WHEN keyframe_no % 13 = 0 OR original_frame_id IS NULL THEN 'violation' ELSE 'row' END kind FROM al""")
def source_map_rows(spark: SparkSession, d: str) -> DataFrame:
    """A source map under other column names, as rows and violations."""
    a = aliases(spark, d).select(F.col("video_id").alias("video"), F.col("keyframe_no").cast("string").alias("n"), F.when(F.col("keyframe_no") % 13 == 0, "x").otherwise(F.col("original_frame_id").cast("string")).alias("frame_idx"))
    good, bad = contracts.normal_source_map(a, {"video_id": ["video_id", "video"], "keyframe_no": ["keyframe_no", "n"], "source_frame_idx": ["source_frame_idx", "frame_idx"]})
    return good.withColumn("kind", F.lit("row")).unionByName(bad.withColumn("kind", F.lit("violation")))


@query(f"WITH {_FR} SELECT video_id, original_frame_id, round(blur_score::DOUBLE, 6)::DOUBLE blur, round(motion_score::DOUBLE, 6)::DOUBLE motion FROM fr WHERE NOT isnan(blur_score) AND NOT isnan(motion_score)")
def dense_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their scores and evidence as structs, read back."""
    f = frames(spark, d, "blur_score", "contrast_score", "motion_score").filter("not isnan(blur_score) and not isnan(motion_score)")
    c = contracts.dense_candidates(f, ["video_id", "original_frame_id"], ["blur_score", "contrast_score"], ["motion_score"])
    return c.select("video_id", "original_frame_id", F.round(F.col("quality_scores.blur_score").cast("double"), 6).alias("blur"), F.round(F.col("evidence.motion_score").cast("double"), 6).alias("motion"))


@query(f"""WITH {_T}, {_AL}, e AS (SELECT DISTINCT evidence_id, evidence_type, video_id, original_frame_id FROM evidence WHERE deleted_at IS NULL AND original_frame_id IS NOT NULL), g AS (SELECT video_id, original_frame_id, string_agg(evidence_type, ',' ORDER BY evidence_type, evidence_id) kinds FROM e GROUP BY 1, 2),
c AS (SELECT DISTINCT video_id, original_frame_id f FROM al WHERE original_frame_id IS NOT NULL), j AS (SELECT alignment_id, event_ordinal, t.video_id, f, row_number() OVER (PARTITION BY alignment_id, event_ordinal ORDER BY abs(f - original_frame_id), f) n FROM t JOIN c USING (video_id) WHERE original_frame_id IS NOT NULL)
SELECT alignment_id, event_ordinal, f near_frame, coalesce(kinds, '') kinds FROM j LEFT JOIN g ON g.video_id = j.video_id AND g.original_frame_id = f WHERE n = 1""")
def nearest_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The keyframe nearest to each event with its live annotations."""
    t = table(spark, d, "trake_alignment").filter("original_frame_id is not null").select("alignment_id", "event_ordinal", clean_id("video_id").alias("video_id"), F.col("original_frame_id").alias("c")).distinct()
    k = aliases(spark, d).filter("original_frame_id is not null").select("video_id", F.col("original_frame_id").alias("f")).distinct()
    near = temporal.nearest_row(t, k, "video_id", "c", "f", ["f"], ["f"]).filter("near_f is not null")
    e = table(spark, d, "evidence").filter("deleted_at is null and original_frame_id is not null").select("evidence_id", "evidence_type", "video_id", F.col("original_frame_id").alias("near_f")).distinct()
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_type", "evidence_id"))), lambda x: x["evidence_type"]), ",")
    g = e.groupBy("video_id", "near_f").agg(kinds.alias("kinds"))
    return near.join(g, ["video_id", "near_f"], "left").select("alignment_id", "event_ordinal", F.col("near_f").alias("near_frame"), F.coalesce("kinds", F.lit("")).alias("kinds"))


_HASH = f"""{_FR}, hf AS (SELECT video_id, original_frame_id f, (1::BIGINT << (trunc(brightness_score * 31))::INT) + (1::BIGINT << (trunc(entropy_score * 7)::INT + 32)) - 1 h, blur_score b FROM fr WHERE NOT isnan(blur_score)),
ho AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f) n FROM hf),
hk AS (SELECT video_id, n, f, h, b, 1 slot FROM ho WHERE n = 1 UNION ALL
  SELECT o.video_id, o.n, CASE WHEN near AND NOT o.b > k.b THEN k.f ELSE o.f END, CASE WHEN near AND NOT o.b > k.b THEN k.h ELSE o.h END, CASE WHEN near AND NOT o.b > k.b THEN k.b ELSE o.b END, CASE WHEN near THEN slot ELSE slot + 1 END
  FROM hk k JOIN ho o ON o.video_id = k.video_id AND o.n = k.n + 1, LATERAL (SELECT bit_count(xor(o.h, k.h)) < 5 near))"""


@query(f"WITH RECURSIVE {_HASH} SELECT video_id, arg_max(f, n) original_frame_id FROM hk GROUP BY video_id, slot")
def hash_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Sequential compaction by the distance to the last kept frame."""
    kept = selection.compact_frames(_hashed(spark, d), "video_id", "original_frame_id", "hash", "blur_score", 5)
    return kept.select("video_id", "original_frame_id")


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "brightness_score", "entropy_score", "blur_score").filter("not isnan(blur_score)")
    bits = F.expr("shiftleft(1L, cast(brightness_score * 31 as int)) + shiftleft(1L, cast(entropy_score * 7 as int) + 32)")
    return f.select("video_id", "original_frame_id", "blur_score", (bits - 1).alias("hash"))


@query(f"WITH RECURSIVE {_HASH}, s AS (SELECT video_id, slot FROM hk GROUP BY 1, 2), c AS (SELECT (SELECT count(*) FROM hf) n_raw, (SELECT count(*) FROM s) n_kept) SELECT n_raw, n_kept, round(100 * (1 - n_kept / n_raw), 2)::DOUBLE reduction_pct FROM c")
def compaction_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many images a de-duplication manifest keeps."""
    images = _hashed(spark, d).withColumn("name", F.format_string("%012d.jpg", "original_frame_id"))
    return curation.distinct_manifest(images, "video_id", "name", "hash", "blur_score")[1]


@query("""WITH RECURSIVE v AS (SELECT DISTINCT video_id, size_bytes s FROM videos_manifest), o AS (SELECT video_id, coalesce(s, 500000000) s, row_number() OVER (ORDER BY video_id) n FROM v),
k AS (SELECT video_id, n, s held, 1 cnt, 0::BIGINT batch FROM o WHERE n = 1 UNION ALL SELECT o.video_id, o.n, CASE WHEN cut THEN o.s ELSE held + o.s END, CASE WHEN cut THEN 1 ELSE cnt + 1 END, CASE WHEN cut THEN batch + 1 ELSE batch END
 FROM k JOIN o ON o.n = k.n + 1, LATERAL (SELECT cnt >= 8 OR held + o.s > 500000000 cut)) SELECT video_id, batch FROM k""")
def bounded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Videos in batches of at most 500 MB and eight; one without a size fills a batch."""
    v = table(spark, d, "videos_manifest").select("video_id", "size_bytes").distinct()
    return curation.bounded_batches(v, [F.col("video_id")], F.col("size_bytes"), 500_000_000, 8).select("video_id", "batch")


@query("""WITH RECURSIVE v AS (SELECT DISTINCT video_id, duration_ms / 1000.0::DOUBLE dur FROM videos_manifest WHERE duration_ms IS NOT NULL), k AS (SELECT DISTINCT upper(trim(video_id)) video_id, timestamp_ms / 1000.0::DOUBLE t FROM frame_aliases WHERE timestamp_ms IS NOT NULL AND keyframe_no % 5 = 0),
c AS (SELECT DISTINCT f.video_id, timestamp_ms / 1000.0::DOUBLE t, blur_score::DOUBLE blur, blur_score >= 1 ok FROM frame_manifest f SEMI JOIN v USING (video_id) WHERE timestamp_ms IS NOT NULL AND NOT isnan(blur_score) AND original_frame_id IS NOT NULL),
p AS (SELECT video_id, t FROM k SEMI JOIN v USING (video_id) UNION SELECT video_id, 0 FROM v UNION SELECT video_id, dur FROM v), g AS (SELECT video_id, lag(t) OVER (PARTITION BY video_id ORDER BY t) a, t b FROM p),
r AS (SELECT video_id, a, b, t FROM (SELECT g.*, c.t, row_number() OVER (PARTITION BY g.video_id, a, b ORDER BY ok DESC, blur DESC, c.t) n FROM g JOIN c ON c.video_id = g.video_id AND c.t > a AND c.t < b WHERE b - a > 3.000001) WHERE n = 1 UNION ALL
 SELECT video_id, a, b, t FROM (SELECT x.video_id, x.a, x.b, c.t, row_number() OVER (PARTITION BY x.video_id, x.a, x.b ORDER BY ok DESC, blur DESC, c.t) n FROM (SELECT video_id, a, t b FROM r UNION ALL SELECT video_id, t, b FROM r) x JOIN c ON c.video_id = x.video_id AND c.t > x.a AND c.t < x.b WHERE x.b - x.a > 3.000001) WHERE n = 1)
SELECT video_id, round(t, 6)::DOUBLE added FROM r""")
def coverage_repair(spark: SparkSession, d: str) -> DataFrame:
    """Frames added where every fifth keyframe leaves gaps of more than three seconds: the widest gap first takes its best frame."""
    v = table(spark, d, "videos_manifest").filter("duration_ms is not null").select("video_id", (F.col("duration_ms") / 1000.0).alias("t_end")).distinct()
    k = aliases(spark, d).filter("timestamp_ms is not null and keyframe_no % 5 = 0").select("video_id", (F.col("timestamp_ms") / 1000.0).alias("t")).distinct()
    c = frames(spark, d, "timestamp_ms", "blur_score").filter("timestamp_ms is not null and not isnan(blur_score)")
    c = c.select("video_id", (F.col("timestamp_ms") / 1000.0).alias("t"), F.col("blur_score").cast("double").alias("blur"), (F.col("blur_score") >= 1).alias("ok")).distinct().withColumn("kept", F.lit(False))
    kept = k.select("video_id", "t", F.lit(0.0).alias("blur"), F.lit(True).alias("ok"), F.lit(True).alias("kept"))
    both = c.unionByName(kept).join(v, "video_id").withColumn("t_start", F.lit(0.0))
    return selection.repair(both, ["video_id"], 3.0).withColumn("added", F.round("added", 6))
