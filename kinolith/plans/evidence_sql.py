"""DuckDB counterparts of the queries of problems 1, 4 and 7."""

_REFS = """
al AS (SELECT DISTINCT upper(trim(video_id)) v, keyframe_no, original_frame_id f, created_at FROM frame_aliases),
sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) rn FROM search_response) WHERE rn = 1),
fr AS (SELECT DISTINCT upper(trim(video_id)) v, original_frame_id f FROM frame_manifest),
vm AS (SELECT upper(trim(video_id)) v, min(created_at) born, max(deleted_at) gone FROM videos_manifest GROUP BY 1),
ev AS (SELECT evidence_id, min(created_at) born, max(deleted_at) gone FROM evidence GROUP BY 1),
refs AS (
  SELECT 'frame_aliases' ref_table, v || '/' || keyframe_no ref_key, 'video_id' ref_field, v target_key, created_at ref_at,
    CASE WHEN vm.v IS NULL THEN 'missing' WHEN gone IS NOT NULL THEN 'deleted' WHEN born > created_at THEN 'late' ELSE 'ok' END state
  FROM al LEFT JOIN vm USING (v) WHERE v IS NOT NULL
  UNION ALL
  SELECT 'frame_aliases', v || '/' || keyframe_no, 'original_frame_id', v || '/' || f, created_at, CASE WHEN fr.v IS NULL THEN 'missing' ELSE 'ok' END
  FROM al SEMI JOIN vm USING (v) LEFT JOIN fr USING (v, f) WHERE f IS NOT NULL
  UNION ALL
  SELECT 'search_response', query_id || '/' || result_no, 'evidence_ids', e, created_at,
    CASE WHEN evidence_id IS NULL THEN 'missing' WHEN gone IS NOT NULL THEN 'deleted' WHEN born > created_at THEN 'late' ELSE 'ok' END
  FROM (SELECT DISTINCT query_id, result_no, created_at, unnest(evidence_ids) e FROM sr) LEFT JOIN ev ON e = evidence_id WHERE e IS NOT NULL)
"""

_HISTORY = """
al AS (SELECT DISTINCT upper(trim(video_id)) v, keyframe_no, original_frame_id f, created_at FROM frame_aliases),
sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) rn FROM search_response) WHERE rn = 1),
rf AS (SELECT 'frame_aliases' t, v || '/' || keyframe_no k, 'video_id' fd, 'videos_manifest' pt, v tk, created_at at_ FROM al WHERE v IS NOT NULL
  UNION ALL SELECT 'frame_aliases', v || '/' || keyframe_no, 'original_frame_id', 'frame_manifest', v || '/' || f, created_at FROM al WHERE f IS NOT NULL AND v IN (SELECT upper(trim(video_id)) FROM videos_manifest)
  UNION ALL SELECT 'search_response', query_id || '/' || result_no, 'evidence_ids', 'evidence', e, created_at FROM (SELECT DISTINCT query_id, result_no, created_at, unnest(evidence_ids) e FROM sr) WHERE e IS NOT NULL),
b AS (SELECT min(epoch_us(at_)) lo, max(epoch_us(at_)) hi FROM rf),
r1 AS (SELECT t, k, fd, pt, tk, at_, CASE WHEN at_ IS NULL THEN 0 ELSE greatest(0, least(3, floor((epoch_us(at_) - lo) * 4 / (hi - lo + 1)::DOUBLE))) END::INT ep FROM rf, b), rg AS (SELECT t, k, fd, pt, tk, min(at_) at_, min(ep) ep FROM r1 GROUP BY 1, 2, 3, 4, 5),
pr AS (SELECT 'videos_manifest' pt, upper(trim(video_id)) tk, created_at born, deleted_at gone FROM videos_manifest UNION ALL SELECT 'evidence', evidence_id, created_at, deleted_at FROM evidence
  UNION ALL SELECT 'frame_manifest', upper(trim(video_id)) || '/' || original_frame_id, NULL, NULL FROM frame_manifest WHERE original_frame_id IS NOT NULL),
pe AS (SELECT pt, tk, born, NULL::TIMESTAMP gone, CASE WHEN born IS NULL THEN 0 ELSE greatest(0, least(3, floor((epoch_us(born) - lo) * 4 / (hi - lo + 1)::DOUBLE))) END::INT ep FROM pr, b
  UNION ALL SELECT pt, tk, born, gone, CASE WHEN gone IS NULL THEN 0 ELSE greatest(0, least(3, floor((epoch_us(gone) - lo) * 4 / (hi - lo + 1)::DOUBLE))) END::INT FROM pr, b WHERE gone IS NOT NULL),
es AS (SELECT unnest(range(0, 4)) e), px AS (SELECT e, pt, tk, CASE WHEN bool_or(born IS NULL) THEN NULL ELSE min(born) END born, max(gone) gone FROM es JOIN pe ON ep <= e GROUP BY 1, 2, 3),
st AS (SELECT es.e, t, fd, strftime(at_, '%Y-%m') period, CASE WHEN px.tk IS NULL THEN 'missing' WHEN gone IS NOT NULL THEN 'deleted' WHEN born > at_ THEN 'late' ELSE 'ok' END state FROM es JOIN rg ON rg.ep <= es.e LEFT JOIN px ON px.e = es.e AND px.pt = rg.pt AND px.tk = rg.tk)
"""

_SPANS = """
a AS (SELECT upper(trim(video_id)) video_id, source_span_index, coalesce(start_ms, asr_start_ms) s, coalesce(end_ms, asr_end_ms) e,
        row_number() OVER (PARTITION BY upper(trim(video_id)), source_span_index ORDER BY ingested_at DESC) rn FROM asr_result),
sp AS (SELECT * FROM a WHERE rn = 1 AND video_id IS NOT NULL AND e > s),
c AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, source_span_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM sp),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, source_span_index) grp FROM c),
per AS (SELECT video_id, min(s) start_ms, max(e) end_ms, count(*) n_spans FROM i GROUP BY video_id, grp),
p AS (SELECT *, lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms) prev_end_ms FROM per)
"""

_LAYOUT = """
r AS (SELECT DISTINCT producer, file_no, file_id, try_cast(payload AS JSON) j FROM stats_raw WHERE payload <> ''),
ok AS (SELECT * FROM r WHERE json_type(j) = 'OBJECT'),
files AS (SELECT producer, file_no, file_id, lag(file_id) OVER (PARTITION BY producer ORDER BY file_no) prev_id
          FROM (SELECT DISTINCT producer, file_no, file_id FROM ok)),
names AS (SELECT raw_name, field_name, '$."' || replace(raw_name, '.', '"."') || '"' path FROM stats_names),
has AS (SELECT DISTINCT file_id, field_name, raw_name,
          CASE json_type(j, path) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' ELSE 'integer' END t
        FROM ok, names WHERE json_type(j, path) NOT IN ('NULL')),
pair AS (SELECT f.file_id, h.field_name, h.raw_name now_raw, h.t now_t, NULL was_raw, NULL was_t FROM files f JOIN has h USING (file_id) WHERE prev_id IS NOT NULL
         UNION ALL
         SELECT f.file_id, h.field_name, NULL, NULL, h.raw_name, h.t FROM files f JOIN has h ON h.file_id = f.prev_id),
x AS (SELECT file_id, field_name, max(now_raw) nr, max(now_t) nt, max(was_raw) wr, max(was_t) wt FROM pair GROUP BY ALL)
"""

_INTEGERS = ["n_after_cosine", "n_frames_manifest", "n_frames_raw_est", "n_shots", "n_candidates", "n_after_quality", "n_after_phash", "n_keyframes"]
_CASTS = {f: f"CASE WHEN try_cast({{t}} AS DECIMAL(38, 10)) = floor(try_cast({{t}} AS DECIMAL(38, 10))) THEN try_cast(try_cast({{t}} AS DECIMAL(38, 10)) AS BIGINT) END" for f in _INTEGERS} | {
    "duration_s": "try_cast({t} AS DOUBLE)", "elapsed_s": "try_cast({t} AS DOUBLE)", "fps": "{t}", "sbd_method": "{t}", "embedded": "try_cast({t} AS BOOLEAN)",
}
_FIELDS = ", ".join(c.format(t=f"max(t) FILTER (field_name = '{f}')") + f" AS {f}" for f, c in _CASTS.items())

SQL = {
    "p1_snapshots": f"""WITH {_HISTORY} SELECT (e + 1)::INT "version", t ref_table, fd ref_field, period, count(*) n_refs, count(*) FILTER (state = 'missing') n_missing, count(*) FILTER (state = 'deleted') n_deleted, count(*) FILTER (state = 'late') n_late FROM st GROUP BY 1, 2, 3, 4""",
    "p7_typed": f"""WITH r AS (SELECT DISTINCT file_id, record_no, CASE WHEN payload <> '' THEN try_cast(payload AS JSON) END j FROM stats_raw),
        names AS (SELECT field_name, '$."' || replace(raw_name, '.', '"."') || '"' path FROM stats_names),
        v AS (SELECT file_id, record_no, field_name, json_extract_string(j, path) t FROM r, names WHERE json_type(j) = 'OBJECT' AND json_type(j, path) <> 'NULL'),
        p AS (SELECT file_id, record_no, {_FIELDS} FROM v GROUP BY 1, 2)
        SELECT r.file_id, r.record_no, coalesce(json_type(j) = 'OBJECT', false) readable, p.* EXCLUDE (file_id, record_no) FROM r LEFT JOIN p USING (file_id, record_no)""",
    "p1_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_key, ref_field, target_key FROM refs WHERE state <> 'ok'",
    "p1_counts": f"""WITH {_REFS} SELECT ref_table, ref_field, strftime(ref_at, '%Y-%m') period, count(*) n_refs,
        count(*) FILTER (state = 'missing') n_missing, count(*) FILTER (state = 'deleted') n_deleted, count(*) FILTER (state = 'late') n_late
        FROM refs GROUP BY ALL""",
    "p4_found": f"""WITH {_SPANS} SELECT 'period' kind, video_id, start_ms, end_ms FROM p WHERE n_spans >= 2
        UNION ALL SELECT 'gap', video_id, prev_end_ms, start_ms FROM p WHERE start_ms - prev_end_ms BETWEEN 1 AND 600000""",
    "p4_periods": f"WITH {_SPANS} SELECT video_id, start_ms, end_ms, n_spans, prev_end_ms FROM p",
    "p7_found": f"""WITH {_LAYOUT} SELECT file_id, field_name, 'added' change FROM x WHERE wr IS NULL
        UNION ALL SELECT file_id, field_name, 'removed' FROM x WHERE nr IS NULL
        UNION ALL SELECT file_id, field_name, 'renamed' FROM x WHERE nr <> wr
        UNION ALL SELECT file_id, field_name, 'retyped' FROM x WHERE nt <> wt""",
}
