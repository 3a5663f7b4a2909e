"""DuckDB counterparts of the subpackage's queries, where SQL can express them over whole tables."""

_STRETCH = """
f AS (SELECT DISTINCT video_id, original_frame_id o, scene_change_score::DOUBLE x, timestamp_ms t FROM frame_manifest WHERE original_frame_id IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY video_id, o ORDER BY x, t) k FROM f),
h AS (SELECT *, lag(o) OVER w po, lag(x) OVER w px FROM g WHERE k = 1 WINDOW w AS (PARTITION BY video_id ORDER BY o)),
i AS (SELECT *, sum(CASE WHEN o = po + 1 AND NOT isnan(x) AND NOT isnan(px) AND abs(x - px) <= 0.002 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY o) grp FROM h),
s AS (SELECT video_id, min(o) first_frame_id, max(o) last_frame_id, count(*) n_frames, round(max(t) - min(t), 3) duration_ms
      FROM i WHERE isfinite(x) GROUP BY video_id, grp)
"""

SQL = {
    "p2_found": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response),
c AS (SELECT dataset_version, upper(trim(video_id)) video_id, query_id, result_no, score, original_frame_id FROM r WHERE k = 1 AND video_id IS NOT NULL AND score IS NOT NULL AND isfinite(score)),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset_version, video_id ORDER BY score DESC, original_frame_id ASC NULLS LAST, query_id, result_no)::INT rank_no FROM c)
SELECT dataset_version, video_id, rank_no, query_id, result_no FROM n WHERE rank_no <= 5""",
    "p3_found": f"WITH {_STRETCH} SELECT video_id, first_frame_id, last_frame_id FROM s WHERE n_frames >= 5",
    "p3_runs": f"WITH {_STRETCH} SELECT video_id, first_frame_id, last_frame_id, n_frames, duration_ms FROM s",
    "p5_found": """
WITH a AS (SELECT upper(trim(video_id)) v, source_span_index k, coalesce(start_ms, asr_start_ms) s, coalesce(end_ms, asr_end_ms) e,
        row_number() OVER (PARTITION BY upper(trim(video_id)), source_span_index ORDER BY ingested_at DESC) rn FROM asr_result),
sp AS (SELECT * FROM a WHERE rn = 1 AND e > s),
ev AS (SELECT DISTINCT alignment_id, event_ordinal, upper(trim(t.video_id)) v, coalesce(t.timestamp_ms::DOUBLE, f.timestamp_ms) t
       FROM trake_alignment t LEFT JOIN frame_manifest f ON f.video_id = upper(trim(t.video_id)) AND f.original_frame_id = t.original_frame_id),
m AS (SELECT alignment_id, event_ordinal, k, row_number() OVER (PARTITION BY alignment_id, event_ordinal ORDER BY abs(s - t), s, k) rn
      FROM ev JOIN sp USING (v) WHERE abs(s - t) <= 1500)
SELECT alignment_id, event_ordinal, k source_span_index FROM m WHERE rn = 1""",
}
