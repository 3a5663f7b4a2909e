"""Hand-written cases with exact results, one per operator rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolith.functions import num, text, vector
from kinolith.operators import fusion, mapping, selection, temporal, timeline
from kinolith.plans import planner
from kinolith.plans import timeline as plans
from kinolith.session import latest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_greedy_and_medoids():
    v = np.array([[1, 0], [0, 1], [0.99, 0.01], [-1, 0]], float)
    order = [3, 1, 0, 2]
    t = [30, 20, 10, 40]
    order = sorted(range(4), key=lambda i: (t[i], i))
    assert selection.greedy_distinct(v, order, 0.95, True) == [2, 1, 3]
    assert selection.greedy_distinct(np.array([[1, 0], [1, 0], [0, 1]], float), [2, 0, 1], 1.0, True) == [2, 0]
    m = np.array([[1, 0], [0.8, 0.6], [0.28, 0.96], [-1, 0]], float)
    assert selection.medoids(m, [20, 30, 40, 10], 0.70) == [3, 1]
    two = np.array([[1, 0], [0.9, 0.1]], float)
    assert selection.medoids(two, [8, 7], 0.9) == [1] and selection.medoids(two, [7, 7], 0.9) == [0]
    assert selection.medoids(np.zeros((0, 2)), [], 0.9) == []


def test_vectors_of_a_whole_group(spark):
    rng = np.random.default_rng(4)
    rows, want_distinct, want_medoids = [], set(), set()
    for g, n in (("a", 41), (None, 9), ("c", 1)):
        centre = rng.standard_normal((5, 6))
        v = (centre[rng.integers(0, 5, n)] + 0.25 * rng.standard_normal((n, 6))).astype(np.float32)
        at = [None if i % 10 == 7 else int(x) for i, x in enumerate(rng.integers(0, 3000, n))]
        ids = [f"{g}{i:03}" for i in range(n)]
        rows += [(g, i, t, x.tolist()) for i, t, x in zip(ids, at, v)]
        order = sorted(range(n), key=lambda i: (at[i] is None, at[i] or 0, ids[i]))
        want_distinct |= {ids[i] for i in selection.greedy_distinct(v.astype(float), order, 0.9, True)}
        want_medoids |= {ids[order[i]] for i in selection.medoids(v[order].astype(float), list(range(n)), 0.95)}
    df = spark.createDataFrame(rows, "g string, id string, at long, v array<float>")
    for block in (4, 2048):
        assert {r.id for r in selection.distinct_vectors(df, ["g"], "v", "at", "id", 0.9, block=block).collect()} == want_distinct
        assert {r.id for r in selection.medoid_vectors(df, ["g"], "v", "at", "id", 0.95, block=block).collect()} == want_medoids
    assert 8 < len(want_distinct) < 51 and len(want_medoids) < 51
    assert selection.distinct_vectors(df.limit(0), ["g"], "v", "at", "id", 0.9).count() == selection.medoid_vectors(df.limit(0), ["g"], "v", "at", "id", 0.9).count() == 0


def test_similar_vectors_far_apart_in_a_video(spark, tmp_path):
    rows = [("m", 2, "V", i, f, v) for i, f, v in (("a", 499, [1.0, 0.0]), ("b", 500, [1.0, 0.01]), ("c", 700, [0.0, 1.0]), ("d", 5000, [1.0, 0.0]), ("e", None, [0.0, 2.0]))]
    spark.createDataFrame(rows, "model_name string, embedding_dim int, video_id string, embedding_id string, original_frame_id long, vector array<float>").write.parquet(f"{tmp_path}/embedding_result.parquet")
    assert sorted(r.embedding_id for r in plans.embedding_distinct(spark, str(tmp_path)).collect()) == ["a", "c"]
    assert sorted(r.embedding_id for r in plans.embedding_medoids(spark, str(tmp_path)).collect()) == ["a", "c"]


def test_coverage_repair():
    c = [(2.0, 1.0, True), (8.0, 1.0, True), (12.0, 2.0, True), (18.0, 1.0, True)]
    added = selection.repair_coverage(c, [2.0, 18.0], (0.0, 20.0), 10.0)
    times = sorted([0.0, 2.0, 18.0, 20.0, *added])
    assert max(b - a for a, b in zip(times, times[1:])) <= 10
    assert selection.repair_coverage([(10.0, 5.0, True), (9.0, 500.0, False)], [2.0, 18.0], (0.0, 20.0), 10.0) == [10.0]
    assert selection.repair_coverage([], [], (0.0, 100.0), 10.0) == []
    assert selection.repair_coverage(c, [], (0.0, 100.0), 0.0) == []


def test_repair_gap_by_gap(spark):
    rng = np.random.default_rng(8)
    rows = []
    for v in ("a", "b", "c"):
        t = np.unique(np.round(rng.random(60) * 100, 2))
        rows += [(v, float(x), float(rng.integers(0, 5)), bool(rng.random() < 0.7), bool(v != "c" and rng.random() < 0.15), 0.0, 100.0) for x in t]
    df = spark.createDataFrame(rows, "v string, t double, blur double, ok boolean, kept boolean, t_start double, t_end double")
    want = {(v, x) for v in "abc" for x in selection.repair_coverage([q[1:4] for q in rows if q[0] == v and not q[4]], [q[1] for q in rows if q[0] == v and q[4]], (0.0, 100.0), 6.0)}
    for block in (10, 3_600):
        assert {(r.v, r.added) for r in selection.repair(df, ["v"], 6.0, block).collect()} == want
    assert len(want) > 10 and selection.repair(df, ["v"], 0.0).count() == 0


def test_compaction(spark):
    assert selection.compact([0, 1, 255, 254], [1.0, 2.0, 1.0, 1.0]) == [1, 2]
    rows = [("a", i, h, s) for i, (h, s) in enumerate([(0, 1.0), (1, 2.0), (255, 1.0), (254, 1.0), (-1, 1.0)])] + [("b", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "v string, i int, h long, s double")
    assert sorted((r.v, r.i) for r in selection.compact_frames(df, "v", "i", "h", "s").collect()) == [("a", 1), ("a", 2), ("a", 4), ("b", 0)]


def test_alignment(spark):
    score, path = selection.align([1, 2, 3], [0.0, 2000.0, 4000.0], [[0.9, 0.1], [0.5, 0.8], [0.1, 0.2]])
    assert path == [0, 1] and score == pytest.approx(0.9 + 0.8 * 1.2)
    assert selection.align([], [], []) is None and selection.align([1], [0.0], [[0.5, 0.5]]) is None
    rows = [("q", "v", 1, 0.0, [0.9, 0.1], 0.5), ("q", "v", 2, 2000.0, [0.5, 0.8], 0.4), ("q", "w", 7, None, [0.0, 0.9], 0.3), ("r", "v", 3, None, [0.0, 0.0], 0.2)]
    df = spark.createDataFrame(rows, "q string, v string, f long, t double, s array<double>, score double")
    got = {(r.q, r.v, r.f): (r.place, round(r.score, 6)) for r in selection.align_sequences(df, ["q"], "v", "f", "t", "s", "score").collect()}
    boost = (0.9 + 0.8 * 1.2) / 2
    assert got == {("q", "v", 1): (1, round(0.5 + boost, 6)), ("q", "v", 2): (2, round(0.4 + boost, 6)), ("r", "v", 3): (None, 0.2)}


HITS = "query_id string, branch string, key string, video_id string, original_frame_id long, start_ms long, end_ms long, rank int, raw_score double, evidence_id string"


def test_fusion(spark):
    rows = [("q", "caption", "v:10", "v", 10, 400, 500, 1, 0.9, "e1"), ("q", "caption", "v:10", "v", 10, 400, 500, 2, 0.7, "e2"), ("q", "object", "v:10", "v", 10, 400, 500, 1, 0.9, "e3")]
    hits = spark.createDataFrame(rows, HITS)
    agg = {r.branch: r for r in fusion.branch_aggregate(hits, 10).collect()}
    assert agg["caption"]["rank"] == 1 and agg["caption"].n_hits == 2 and agg["caption"].evidence_ids == ["e1", "e2"]
    assert agg["caption"].raw == pytest.approx(0.7 * 0.9 + 0.3 * 0.8 + 0.02)
    fused = fusion.weighted_rrf(fusion.branch_aggregate(hits, 10), {"caption": 1.0, "object": 2.0}, 10).collect()
    assert len(fused) == 1 and fused[0].score == pytest.approx(3 / 11) and fused[0].trace == "object,caption" and fused[0].evidence_ids == ["e3", "e1", "e2"]
    assert fusion.weighted_rrf(fusion.branch_aggregate(hits, 10), {"caption": 0.0, "object": 0.0}).count() == 0


def test_queries_are_kept_apart(spark):
    rows = [(q, "ocr", f"v:{f}", "v", f, 0, 1, r, 1.0 - r / 10, f"e{q}{f}") for q in ("q1", "q2") for r, f in enumerate((10, 11, 12), 1)]
    hits = spark.createDataFrame(rows, HITS)
    agg = fusion.branch_aggregate(hits, 2)
    assert sorted((r.query_id, r.key, r.n_hits, r["rank"]) for r in agg.collect()) == [(q, f"v:{9 + i}", 1, i) for q in ("q1", "q2") for i in (1, 2)]
    fused = fusion.weighted_rrf(agg, {}, 60, 1).collect()
    assert sorted((r.query_id, r.key, r["rank"]) for r in fused) == [("q1", "v:10", 1), ("q2", "v:10", 1)]
    assert fusion.merge_variants(hits, 2).count() == 4
    head = fusion.rerank_head(fused_frame(spark), spark.createDataFrame([("q1", "a", 0.0), ("q1", "b", 100.0)], "query_id string, key string, model_score double"), 2, 1.0)
    assert sorted((r.query_id, r.new_rank, r.key) for r in head.collect()) == [("q1", 1, "b"), ("q1", 2, "a"), ("q1", 3, "c"), ("q2", 1, "a")]


def fused_frame(spark):
    return spark.createDataFrame([("q1", "a", 1, 0.9), ("q1", "b", 2, 0.8), ("q1", "c", 3, 0.7), ("q2", "a", 1, 0.5)], "query_id string, key string, rank int, score double")


def test_suppression(spark):
    df = spark.createDataFrame([("v", 10, 1000, 0.9), ("v", 11, 1500, 0.8), ("v", 12, 2201, 0.7), ("w", 11, 1500, 0.1)], "video_id string, f long, t long, score double")
    got = temporal.suppress_near(df, "video_id", "t", "score", "f", "t", 1000)
    assert sorted((r.video_id, r.f) for r in got.collect()) == [("v", 10), ("v", 12), ("w", 11)]
    assert temporal.suppress_near(df, "video_id", "t", "score", "f", "t", 0).count() == 4


def test_peaks_by_distance(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(g, int(i), float(x)) for g in ("a", "b") for i, x in enumerate(np.round(rng.random(90), 1))] + [("c", 99, 0.9), ("c", 100, 0.8), ("c", 160, 0.7), ("c", 170, None), ("c", 180, float("nan")), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, f long, s double")
    for limit in (2, 100):
        want = set()
        for g in "abc":
            kept = []
            for f, s in sorted(((f, s) for h, f, s in rows if h == g and f is not None and s is not None and s >= 0.3), key=lambda x: (-x[1], x[0])):
                if len(kept) < limit and all(abs(f - k) >= 8 for k in kept):
                    kept.append(f)
            want |= {(g, f) for f in kept}
        got = [(r.g, r.f) for r in temporal.top_peaks(df, ["g"], "f", "s", 0.3, 8, limit).collect()]
        assert sorted(got) == sorted(want) and {f for g, f in got if g == "c"} == {99, 160}
    ids = [*range(90, 170), 300]
    spark.createDataFrame([("V", i, 0.0, {99: 0.5, 100: 0.4, 160: 0.3, 300: 0.26, 120: 0.2}.get(i, 0.0)) for i in ids], "video_id string, original_frame_id long, scene_change_score float, motion_score float").write.parquet(f"{tmp_path}/frame_manifest.parquet")
    assert sorted((r.shot_id, r.original_frame_id) for r in plans.shot_peaks(spark, str(tmp_path)).collect()) == [(0, 99), (0, 160), (0, 300)]


def test_snapped_targets(spark):
    frames = spark.createDataFrame([("v", 0, i, t) for i, t in ((5, 0.0), (6, 40.0), (7, 80.0), (8, 80.0), (9, None))] + [("v", 1, 20, 1000.0)], "video_id string, shot_id int, original_frame_id long, t double")
    targets = spark.createDataFrame([("v", 0, x) for x in (-9.0, 20.0, 61.0, 80.0, 900.0)] + [("v", 1, 70.0), ("w", 0, 1.0)], "video_id string, shot_id int, target double")
    for block in (50, 65_536):
        got = timeline.snap_targets(targets, frames, ["video_id", "shot_id"], "t", "target", block).collect()
        assert {(r.video_id, r.shot_id, r.target): r.original_frame_id for r in got} == {("v", 0, -9.0): 5, ("v", 0, 20.0): 5, ("v", 0, 61.0): 7, ("v", 0, 80.0): 7, ("v", 0, 900.0): 7, ("v", 1, 70.0): 20, ("w", 0, 1.0): None}


def test_event_scores(spark):
    windows = spark.createDataFrame([("e1", "v", 3, 6), ("e2", "v", 0, 2), ("e3", "v", 0, 2)], "event_window_id string, video_id string, start_frame long, end_frame long")
    rows = [("e1", "v", i, i / 10) for i in (2, 3, 4, 5, 6)] + [("e2", "v", 0, 0.1), ("e3", "v", 0, 0.1), ("e3", "v", 1, 0.1), ("e3", "v", 1, 0.1)]
    good, bad = timeline.event_scores(windows, spark.createDataFrame(rows, "event_window_id string, video_id string, original_frame_id long, score double"))
    assert sorted((r.event_window_id, r.original_frame_id, r.score) for r in good.collect()) == [("e1", 3, 0.3), ("e1", 4, 0.4), ("e1", 5, 0.5)]
    assert sorted((r.event_window_id, r.original_frame_id, r.violation) for r in bad.collect()) == [("e2", 1, "missing"), ("e3", 1, "duplicate")]


def test_windows_around_hits(spark):
    frames = spark.createDataFrame([("v", i, i * 1000.0) for i in range(10)] + [("w", 4, 70.0), ("v", 50, None)], "video_id string, original_frame_id long, timestamp_ms double")
    hits = spark.createDataFrame([("v", 5, 0.5), ("v", 9, 0.9), ("v", 0, 0.1), ("w", 4, 0.2), ("v", 77, 0.3), ("v", 50, 0.3)], "video_id string, original_frame_id long, score double")
    got = {(r.video_id, r.original_frame_id): (r.start_frame, r.end_frame, r.start_ms, r.end_ms) for r in timeline.hit_windows(hits, frames, 2000.0).collect()}
    assert got == {("v", 5): (3, 8, 3000.0, 8000.0), ("v", 9): (7, 10, 7000.0, 10000.0), ("v", 0): (0, 3, 0.0, 3000.0), ("w", 4): (4, 5, 70.0, 70.0), ("v", 77): (None,) * 4, ("v", 50): (None,) * 4}


def test_tiers_and_readiness(spark):
    tier = lambda *x: one(spark, num.quality_tier(*(F.lit(v).cast("double") for v in x)))
    assert [tier(9.9, 99, 9), tier(245.5, 99, 9), tier(10, 99, 4.9), tier(10, 29.9, 5), tier(245, 30, 5), tier(float("nan"), 99, 9), tier(None, 30, 5)] == ["low", "low", "low", "medium", "high", "low", None]
    ready = lambda c, m: tuple(one(spark, num.audio_ready(F.lit(c).cast("double"), F.lit(m).cast("double"))))
    assert ready(0.6, None) == (True, []) and ready(0.6, 2.4) == (False, ["chất lượng âm thanh thấp"]) and ready(0.59, 2.5) == (False, ["confidence thấp"])
    assert ready(0.7, 9.0) == (True, []) and ready(None, 1.0) == (None, ["chất lượng âm thanh thấp"])


def test_majority(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4), ("g", "unknown", 5), ("g", None, 6), ("h", None, 1)], "g string, a string, i int")
    assert [(r.g, r.a, r.n_votes) for r in fusion.majority(df, ["g"], "a", "i").collect()] == [("g", "b", 2)]
    assert sorted((r.i, r.a) for r in fusion.backfill_majority(df, ["g"], "a", "i").filter("g = 'g'").collect())[-1] == (6, "b")


def test_shots(spark):
    values = [0, 0, 0.9, 0.9, 0, 0, 0, 0.9, 0, 0]
    df = spark.createDataFrame([("v", i, float(x)) for i, x in enumerate(values)], "video_id string, original_frame_id long, p double")
    s = timeline.shots(df, "p", 0.5)
    assert [(r.start_frame, r.end_frame) for r in s.orderBy("shot_id").collect()] == [(0, 2), (3, 6), (7, 9)]
    assert timeline.shot_violations(s).count() == 0
    m = timeline.merge_short(s, 4)
    assert [(r.start_frame, r.end_frame) for r in m.orderBy("shot_id").collect()] == [(0, 9)]
    targets = {1.0: [0.5], 3.5: [0.875, 1.75, 2.625], 5.0: [0.5, 1.5, 2.5, 3.5, 4.5], 0.0: [0.0]}
    for end, want in targets.items():
        assert one(spark, timeline.shot_targets(F.lit(0.0), F.lit(end))) == pytest.approx(want)


def test_text_rules(spark):
    assert one(spark, text.fold(F.lit("Đường  PHỐ, số-1"))) == "duong pho so 1"
    assert one(spark, text.natural_key(F.lit("a10.jpg"))) > one(spark, text.natural_key(F.lit("a9.jpg")))
    assert one(spark, text.csv_cell(F.lit("=1+1"))) == "'=1+1" and one(spark, text.csv_cell(F.lit('a "b"'))) == '"a ""b"""'
    assert one(spark, text.similarity(text.trigrams(F.lit("cat")), text.trigrams(F.lit("cat")))) == 1.0
    assert one(spark, text.similarity(text.trigrams(F.lit("")), text.trigrams(F.lit("!")))) == 0.0
    assert text.cover_density(["a", "x", "b", "a"], ["a", "b"]) == pytest.approx(0.1 / 2 + 0.1)
    assert text.cover_density(["a"], ["a", "b"]) == 0.0
    lex = text.tokens(F.lit("Red car on the road"))
    for q, want in (("red car", True), ('"car red"', False), ('"red car"', True), ("red -road", False), ("blue or road", True), ("", False)):
        assert one(spark, text.matches(lex, text.parse_web_query(q))) is want, q
    assert one(spark, text.without_secrets(F.lit("s3://u:p@host/k?sig=1"))) == "s3://host/k?***"
    assert one(spark, text.byte_range(F.lit("bytes=5-")))["start"] == 5
    assert one(spark, text.model_json(F.lit('```json\n{"a": 1}\n```'), "a int"))["a"] == 1


def test_number_rules(spark):
    assert one(spark, num.frame_to_ms(F.lit(1), F.lit(30000), F.lit(1001))) == pytest.approx(33.367)
    assert one(spark, num.ms_to_frame(F.lit(10_000.0), F.lit(25), F.lit(1), F.lit(100))) == 99
    assert tuple(one(spark, num.fps_fraction(F.lit("30000/1001")))) == (30000, 1001) and one(spark, num.fps_fraction(F.lit("x"))) is None
    assert one(spark, num.member_ids(F.lit("[3, 1, 3]"))) == [1, 3] and one(spark, num.member_ids(F.lit("2,1,x"))) == [1, 2]
    assert one(spark, num.normalised_box(F.array(*map(F.lit, (0.0, 0.0, 5.0, 5.0))), F.lit(10), F.lit(10))) == [0.0, 0.0, 0.5, 0.5]
    assert one(spark, num.quality_gate(F.lit(100.0), F.lit(5.0), F.lit(500.0))) == "low_info"
    assert one(spark, vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, vector.hamming(F.lit(255), F.lit(0))) == 8
    assert one(spark, num.half_up_ms(F.lit(1), F.lit(2000))) == 1


def test_mapping_rules(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    with pytest.raises(mapping.KeyViolation):
        mapping.merge_checked(a, b, ["k"])
    with pytest.raises(mapping.KeyViolation):
        mapping.merge_checked(a, b.limit(1), ["k"])
    assert mapping.merge_checked(a, b.limit(1), ["k"], required=False).count() == 2
    up = mapping.upsert(a, spark.createDataFrame([(2, "z"), (3, "n")], "k int, x string"), ["k"])
    assert sorted((r.k, r.x) for r in up.collect()) == [(1, "a"), (2, "z"), (3, "n")]
    assert sorted((r.k, r.side) for r in mapping.set_difference(a, spark.createDataFrame([(2,), (5,)], "k int"), "k").collect()) == [(1, "extra"), (5, "missing")]


ONTOLOGY = {"bicycle": ["bicycle", "xe đạp"], "bottle": ["bottle", "chai"], "person": ["person", "người"], "traffic light": ["traffic light"]}


def test_planner():
    p = planner.plan_query("two bicycles beside three bottles", ONTOLOGY)
    assert p.objects.counts == {"bicycle": 2, "bottle": 3} and "object" in p.branches and p.language == "en"
    o = planner.find_objects("hai người đứng bên trái một chiếc xe đạp và cầm chai nước", ONTOLOGY)
    assert set(o.labels) == {"person", "bicycle", "bottle"} and o.counts["person"] == 2 and "left" in o.places
    q = planner.plan_query("một căn phòng không có người", ONTOLOGY)
    assert q.objects.excluded == ("person",) and q.language == "vi" and q.objects.labels == () and ("negative", "person") in {(a.kind, a.value) for a in q.atoms}
    assert planner.plan_query("một vận động viên chạy qua vạch đích", ONTOLOGY).branches == ("clip", "caption")
    r = planner.plan_query('a sign "EXIT" then a traffic light', ONTOLOGY, {"object": 0.0})
    assert r.visible == ("EXIT",) and "ocr_lexical" in r.branches and "object" not in r.branches and r.relations == ("sequence",) and r.weights["ocr_lexical"] == 1.25
    t = planner.plan_query('người đàn ông cầm chai trước bảng hiệu có chữ "HỘI THI AI" và nói "xin chào"', ONTOLOGY)
    assert set(t.branches) == {"clip", "caption", "ocr_lexical", "asr_lexical", "object"} and planner.text_for(t, "object", ONTOLOGY) == "person bottle"
    assert "HỘI THI AI" in planner.text_for(t, "ocr_lexical", ONTOLOGY) and "xin chào" in planner.text_for(t, "asr_lexical", ONTOLOGY)
    u = planner.plan_query("người mở cửa trước khi đặt chai xuống bàn, sau đó rời đi", ONTOLOGY)
    assert set(u.relations) >= {"before", "after", "sequence"} and ("temporal", "before") in {(a.kind, a.value) for a in u.atoms}
    assert not planner.signalled("bờ biển", planner.SIGNALS["ocr"]) and planner.signalled("a logo", planner.SIGNALS["ocr"]) and planner.signalled("the audio", planner.SIGNALS["asr"])
    assert planner.plan_query("x", ONTOLOGY, available=["tags"]).branches == ("tags",)
    assert planner.limits() == (100, 500, 100) and planner.limits(700) == (700, 700, 700)
    with pytest.raises(ValueError):
        planner.plan_query("x", ONTOLOGY, {"ocr_lexical": 9.0})
    with pytest.raises(ValueError):
        planner.check_request({}, 9, 0)
    assert planner.fan_out({"visual": 0.5, "ocr": 2.0, "object": 1.0}) == {"visual": 0.5, "clip": 0.5, "ocr_lexical": 2.0, "ocr_semantic": 2.0, "object": 1.0}
    assert planner.variants("Scene\nQuestion: who?", "vqa") == ["Scene", "who?"] and planner.variants("main text\n1. a\n2) b", "trake") == ["main text"] and planner.variants(" a  b ") == ["a b"]
    assert planner.same_events(["a", "b"], ["x", "y"], None, "o") == "o\n1. x\n2. y" and planner.same_events(["a"], ["x", "y"], None, None) is None and planner.same_events(["a"], ["x"], "o", None) is None
    assert planner.closure({"c": ["b"], "b": ["a"]}, ["c"]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        planner.closure({"a": ["b"], "b": ["a"]}, ["a"])
    status = planner.run_stages({"b": ["a"]}, {"a": lambda: 1 / 0, "b": lambda: None}, ["b"])
    assert status["a"] == "failed" and status["b"] == "blocked"
    held: dict = {}
    run = lambda prints: planner.run_stages({"b": ["a"]}, {"a": lambda: None, "b": lambda: None}, ["b"], prints=prints, checkpoint=held)
    assert run({"a": "1", "b": "1"}) == {"a": "completed", "b": "completed"} and run({"a": "1", "b": "1"}) == {"a": "skipped", "b": "skipped"}
    assert run({"a": "1", "b": "2"}) == {"a": "skipped", "b": "completed"} and run({"a": "2", "b": "2"}) == {"a": "completed", "b": "completed"}
    rules = {"n": (int, lambda n: n > 0), "on": (bool, lambda _: True)}
    assert planner.check_config({"n": 0, "x": 1}, rules, {"a": ["b"]}) == ["unknown: x", "invalid: n", "missing: on", "unknown node: b in a"]
    assert planner.check_config({"n": 1, "on": True}, rules, {"a": ["b"], "b": ["a"]}) == ["cycle at a"]


def test_branches_fail_alone(spark):
    def slow():
        return spark.range(1).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L) x")

    def broken():
        raise RuntimeError("no index")

    got = {r.branch: (r.status, r.rows and len(r.rows)) for r in planner.run_branches(spark, {"ok": lambda: spark.range(3), "slow": slow, "broken": broken, "none": None}, 6000)}
    assert got == {"ok": ("completed", 3), "slow": ("timed_out", None), "broken": ("failed", None), "none": ("unavailable", None)}


def test_latest_keeps_maps(spark):
    df = spark.createDataFrame([(1, 1, {"a": 1}, "x"), (1, 2, {"a": 2}, "y"), (1, 2, {"a": 3}, "y"), (2, None, None, "z")], "k int, t int, m map<string,int>, s string")
    assert sorted((r.k, r.t, r.m, r.s) for r in latest(df, ["k"], "t").collect()) == [(1, 2, {"a": 3}, "y"), (2, None, None, "z")]


def test_natural_keys_of_any_length(spark):
    names = ["f1234567890129.jpg", "f9.jpg", "f10.jpg", "f007.jpg", "f1234567890123.jpg", "e-1", "e1", "2", "10"]
    df = spark.createDataFrame([(x,) for x in names], "x string")
    got = [r.x for r in df.orderBy(text.natural_key("x")).collect()]
    assert got == ["2", "10", "e1", "e-1", "f007.jpg", "f9.jpg", "f10.jpg", "f1234567890123.jpg", "f1234567890129.jpg"]


def test_stabbing_spans_of_any_length(spark):
    spans = spark.createDataFrame([("v", 0, 10, "a"), ("v", 5, 9_000_000_000_000, "b"), ("v", 100_000, 400_000, "c"), ("v", 7, 7, "d"), ("v", None, 9, "e"), ("w", 0, 100, "f")], "v string, s long, e long, n string")
    points = spark.createDataFrame([("v", 5), ("v", 7), ("v", 150_000), ("v", 8_000_000_000_000), ("w", 99), ("w", 100), ("w", None)], "v string, t long")
    got = sorted((r.v, r.t, r.n) for r in temporal.stab(spans, points, "v", "s", "e", "t").collect())
    assert got == [("v", 5, "a"), ("v", 5, "b"), ("v", 7, "a"), ("v", 7, "b"), ("v", 150_000, "b"), ("v", 150_000, "c"), ("v", 8_000_000_000_000, "b"), ("w", 99, "f")]
    assert ("w", 100, "f") in {(r.v, r.t, r.n) for r in temporal.stab(spans, points, "v", "s", "e", "t", closed=True).collect()}


def test_nearest_at_any_distance(spark):
    rng = np.random.default_rng(3)
    right = [(v, int(t), int(i)) for v in "ab" for i, t in enumerate(rng.integers(0, 10**6, 40))] + [("a", None, 1), ("c", 5, 7), ("c", 5, 3)]
    left = [(v, None if i % 9 == 0 else int(t), i) for i, (v, t) in enumerate(zip("abcd" * 10, rng.integers(0, 10**6, 40)))]
    a, b = spark.createDataFrame(left, "v string, t long, i int"), spark.createDataFrame(right, "v string, s long, k int")
    for reach in (None, 9000):
        want = {}
        for v, t, i in left:
            near = [(abs(s - t), s, k) for w, s, k in right if w == v and s is not None and t is not None and (reach is None or abs(s - t) <= reach)]
            want[i] = (min(near)[2], min(near)[0]) if near else (None, None)
        got = {r.i: (r.near_k, r.distance) for r in temporal.nearest_row(a, b, "v", "t", "s", ["s", "k"], ["k"], reach, block=1000).collect()}
        assert got == want
