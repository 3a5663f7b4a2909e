"""Search: branches over text, labels and vectors, their fusion, and look-ups around a candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinolith.functions import num, text, vector
from kinolith.operators import contracts, fusion, temporal
from kinolith.plans.catalog import Catalog
from kinolith.session import clean_id, latest, table

CATALOG = Catalog()
query = CATALOG.query
PROBE_TEXT = "the green basket enters the rusty lighthouse"
LABELS = ["film", "surround", "unload", "repairs", "weigh"]

#: DuckDB text of the same trigram rule.
_TRGM = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
_A, _B = _TRGM.format(x="text"), _TRGM.format(x=f"'{PROBE_TEXT}'")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").filter("text is not null").distinct()


@query("""
WITH q AS (SELECT embedding qv FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 5) score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact cosine top k of one query vector (the query is one row: a literal, not a join)."""
    e = table(spark, d, "embeddings")
    qv = e.filter("vec_id = 0").first()["embedding"]
    score = vector.cosine("embedding", F.array(*[F.lit(float(x)).cast("float") for x in qv]))
    return e.select("vec_id", "label", score.alias("s")).orderBy(F.col("s").desc(), "vec_id").limit(20).select("vec_id", "label", F.round("s", 5).alias("score"))


@query("""
WITH q AS (SELECT embedding qv FROM embeddings WHERE vec_id = 1)
SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], qv::DOUBLE[]), 5) score FROM embeddings, q ORDER BY list_inner_product(embedding::DOUBLE[], qv::DOUBLE[]) DESC, vec_id LIMIT 15""")
def inner_product_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    qv = e.filter("vec_id = 1").first()["embedding"]
    score = vector.dot("embedding", F.array(*[F.lit(float(x)).cast("float") for x in qv]))
    return e.select("vec_id", score.alias("s")).orderBy(F.col("s").desc(), "vec_id").limit(15).select("vec_id", F.round("s", 5).alias("score"))


@query("""
WITH e AS MATERIALIZED (SELECT DISTINCT * FROM embedding_result WHERE len(vector) = embedding_dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
q AS MATERIALIZED (SELECT vector qv, model_name qm FROM e ORDER BY embedding_id LIMIT 1)
SELECT embedding_id, video_id, original_frame_id, round(list_cosine_similarity(vector::DOUBLE[], qv::DOUBLE[]), 5) score FROM e, q WHERE model_name = qm
ORDER BY list_cosine_similarity(vector::DOUBLE[], qv::DOUBLE[]) DESC, embedding_id LIMIT 10""")
def frame_query_topk(spark: SparkSession, d: str) -> DataFrame:
    """The vector indexed for a frame as the query, against all vectors of its model."""
    e = table(spark, d, "embedding_result").select("embedding_id", "video_id", "original_frame_id", "embedding_dim", "model_name", "vector").filter(F.size("vector") == F.col("embedding_dim"))
    e = e.filter(vector.is_finite("vector") & (vector.norm("vector") > 0)).distinct()
    q = e.orderBy("embedding_id").select("vector", "model_name").first()
    score = vector.cosine("vector", F.array(*[F.lit(float(x)).cast("float") for x in q["vector"]]))
    top = e.filter(F.col("model_name") == q["model_name"]).select("embedding_id", "video_id", "original_frame_id", score.alias("s")).orderBy(F.col("s").desc(), "embedding_id").limit(10)
    return top.select("embedding_id", "video_id", "original_frame_id", F.round("s", 5).alias("score"))


@query("""
SELECT model_name, count(*) n, min(len(vector)) min_dims, max(len(vector)) max_dims, bool_and(normalized) all_normalized, count(DISTINCT model_name || ':' || model_version) n_versions,
  count(*) FILTER (abs(sqrt(list_inner_product(vector, vector)) - 1) <= 2e-3) n_unit
FROM (SELECT DISTINCT * FROM embedding_result) GROUP BY 1""")
def vector_health(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embedding_result").distinct()
    dims = F.size("vector")
    return e.groupBy("model_name").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("vector").isNotNull(), dims)).alias("min_dims"), F.max(F.when(F.col("vector").isNotNull(), dims)).alias("max_dims"), F.bool_and("normalized").alias("all_normalized"),
        F.countDistinct(F.concat_ws(":", "model_name", "model_version")).alias("n_versions"), F.count_if(vector.is_unit("vector")).alias("n_unit"),
    )


@query(f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, text, {_A} a, {_B} b FROM d),
s AS (SELECT doc_id, len(list_intersect(a, b)) i, len(a) la, len(b) lb, text FROM t),
r AS (SELECT doc_id, CASE WHEN la + lb - i > 0 THEN i / (la + lb - i) ELSE 0 END sim, CASE WHEN contains(lower(text), 'green basket') THEN 0.25 ELSE 0 END bonus FROM s)
SELECT doc_id, round(sim + bonus, 6)::DOUBLE score FROM r WHERE sim > 0.15 ORDER BY round(sim + bonus, 6) DESC, doc_id LIMIT 50""")
def text_trgm_topk(spark: SparkSession, d: str) -> DataFrame:
    """Trigram similarity above 0.15 plus 0.25 where the phrase occurs, best 50."""
    probe = F.array(*[F.lit(t) for t in _trigrams(PROBE_TEXT)])
    sim = text.similarity(text.trigrams("text"), probe)
    hits = _docs(spark, d).select("doc_id", "text", sim.alias("sim")).filter("sim > 0.15")
    score = F.round(F.col("sim") + F.when(F.contains(F.lower("text"), F.lit("green basket")), 0.25).otherwise(0.0), 6)
    return hits.select("doc_id", score.alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(50)


def _trigrams(s: str) -> list[str]:
    out: dict[str, None] = {}
    for w in s.lower().split():
        for i in range(len(w) + 1):
            out[f"  {w} "[i : i + 3]] = None
    return list(out)


@query("""
WITH t AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1) w FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM t WHERE (list_contains(w, 'basket') AND contains(' ' || array_to_string(w, ' ') || ' ', ' in slow motion ') AND NOT list_contains(w, 'diver')) OR list_contains(w, 'accordion')""")
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    """Web-search syntax: required words, an adjacent phrase, an exclusion and an alternative."""
    q = text.parse_web_query('basket "in slow motion" -diver or accordion')
    return _docs(spark, d).filter(text.matches(text.tokens("text"), q)).select("doc_id")


@query("""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1) ws FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, unnest(ws) w, unnest(range(1, len(ws) + 1)) p FROM d),
h AS (SELECT *, lag(w) OVER x pw, lag(p) OVER x pp FROM w WHERE w IN ('basket', 'lighthouse') WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, round(sum(0.1::DOUBLE / (p - pp)), 6)::DOUBLE score FROM h WHERE pw <> w GROUP BY 1) SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 50""")
def fts_rank(spark: SparkSession, d: str) -> DataFrame:
    """Cover-density rank of two terms, best 50."""
    score = F.round(text.rank_cd(text.tokens("text"), ["basket", "lighthouse"]), 6)
    return _docs(spark, d).select("doc_id", score.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(50)


def _trake(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trake_alignment").withColumn("video_id", clean_id("video_id")).distinct()


@query("""
SELECT event_label, video_id, round(max(1.0 * (0.75 + 0.25 * selection_score)), 6)::DOUBLE score, count(*) n FROM (SELECT DISTINCT * REPLACE (upper(trim(video_id)) AS video_id) FROM trake_alignment)
WHERE event_label IN ('films', 'surrounds', 'unloads') AND selection_score >= 0.25 GROUP BY 1, 2""")
def label_exact(spark: SparkSession, d: str) -> DataFrame:
    """Label in the terms and confidence of at least 0.25; best weighted score per label and video."""
    t = _trake(spark, d).filter(F.col("event_label").isin("films", "surrounds", "unloads") & (F.col("selection_score") >= 0.25))
    return t.groupBy("event_label", "video_id").agg(F.round(F.max(1.0 * (0.75 + 0.25 * F.col("selection_score"))), 6).alias("score"), F.count("*").alias("n"))


_LA, _LT = _TRGM.format(x="event_label"), _TRGM.format(x="term")


@query(f"""
WITH l AS (SELECT event_label, count(*) n FROM (SELECT DISTINCT * REPLACE (upper(trim(video_id)) AS video_id) FROM trake_alignment) GROUP BY 1),
t AS (SELECT unnest(['film', 'surround', 'unload', 'repairs', 'weigh']) term),
p AS (SELECT event_label, term, n, {_LA} a, {_LT} b FROM l, t), s AS (SELECT *, len(list_intersect(a, b)) i FROM p)
SELECT event_label, term, n, round(i / (len(a) + len(b) - i), 6)::DOUBLE sim FROM s WHERE i / (len(a) + len(b) - i) > 0.2 OR event_label = term""")
def label_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Labels like a term by trigrams (> 0.2): distinct labels meet terms on a shared trigram, then the rule is checked."""
    labels = _trake(spark, d).filter("event_label is not null").groupBy("event_label").agg(F.count("*").alias("n")).withColumn("a", text.trigrams("event_label"))
    terms = spark.createDataFrame([(t,) for t in LABELS], "term string").withColumn("b", text.trigrams("term"))
    pairs = labels.withColumn("g", F.explode("a")).join(terms.withColumn("g", F.explode("b")), "g").groupBy("event_label", "term").agg(F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    s = pairs.withColumn("s", text.similarity(F.col("a"), F.col("b")))
    return s.filter((F.col("s") > 0.2) | (F.col("event_label") == F.col("term"))).select("event_label", "term", "n", F.round("s", 6).alias("sim"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(table(spark, d, "search_response").select("query_id", "result_no", "video_id", "original_frame_id", "start_ms", "end_ms", "score", "evidence_ids", "ingested_at"), ["query_id", "result_no"], "ingested_at")
    rows = rows.withColumn("video_id", clean_id("video_id"))
    return rows.withColumn("evidence_id", F.explode("evidence_ids")).filter("evidence_id is not null and video_id is not null and score is not null and not isnan(score) and abs(score) < double('inf')")


_HITS = """
sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1),
h AS (SELECT query_id, result_no, upper(trim(video_id)) video_id, original_frame_id, start_ms, end_ms, score, unnest(evidence_ids) evidence_id FROM sr),
hits AS (SELECT * FROM h WHERE evidence_id IS NOT NULL AND video_id IS NOT NULL AND isfinite(score)),
ev AS (SELECT DISTINCT * FROM evidence), vm AS (SELECT DISTINCT * FROM videos_manifest)
"""


@query(f"""
WITH {_HITS} SELECT query_id, result_no, evidence_id, hits.video_id, evidence_type, producer, dataset_version, 'r2://media/' || object_key preview_uri
FROM hits JOIN ev USING (evidence_id) JOIN vm ON vm.video_id = hits.video_id WHERE ev.deleted_at IS NULL AND vm.deleted_at IS NULL AND confidence >= 0.5""")
def release_star_join(spark: SparkSession, d: str) -> DataFrame:
    """Hits with live evidence and live video; dimensions join by size, filters reach the scans."""
    ev = table(spark, d, "evidence").filter("deleted_at is null and confidence >= 0.5").select("evidence_id", "evidence_type", "producer").distinct()
    vm = table(spark, d, "videos_manifest").filter("deleted_at is null").select("video_id", "dataset_version", "object_key").distinct()
    j = _hits(spark, d).join(ev, "evidence_id").join(vm, "video_id")
    return j.select("query_id", "result_no", "evidence_id", "video_id", "evidence_type", "producer", "dataset_version", F.concat(F.lit("r2://media/"), "object_key").alias("preview_uri"))


@query(f"WITH {_HITS} SELECT evidence_id, evidence_type FROM ev WHERE evidence_id IN (SELECT evidence_id FROM hits) AND (evidence_type <> 'caption' OR confidence >= 0.7)")
def cited_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Semi join: evidence that any result cites."""
    ev = table(spark, d, "evidence").distinct().filter("evidence_type <> 'caption' or confidence >= 0.7")
    return ev.join(_hits(spark, d).select("evidence_id"), "evidence_id", "left_semi").select("evidence_id", "evidence_type")


@query(f"""
WITH {_HITS} SELECT query_id, result_no, count(*) n_cited, count(ev.evidence_id) n_known, coalesce(string_agg(DISTINCT evidence_type, ',' ORDER BY evidence_type), '') kinds
FROM hits LEFT JOIN ev USING (evidence_id) GROUP BY 1, 2""")
def evidence_hydration(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "evidence").select("evidence_id", "evidence_type").distinct().withColumn("known", F.lit(1))
    j = _hits(spark, d).join(ev, "evidence_id", "left")
    return j.groupBy("query_id", "result_no").agg(F.count("*").alias("n_cited"), F.count("known").alias("n_known"), F.array_join(F.array_sort(F.collect_set("evidence_type")), ",").alias("kinds"))


def _branch_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits as branch rows: the branch is the evidence's kind, the key its frame or time range."""
    ev = table(spark, d, "evidence").select("evidence_id", F.col("evidence_type").alias("branch")).distinct()
    h = _hits(spark, d).join(ev, "evidence_id").filter("start_ms is not null and end_ms is not null")
    return h.select("query_id", "branch", num.candidate_key("video_id", "original_frame_id", "start_ms", "end_ms").alias("key"), "video_id", "original_frame_id", "start_ms", "end_ms", F.col("result_no").alias("rank"), F.col("score").alias("raw_score"), "evidence_id")


_BRANCH = f"""{_HITS}, bh AS (SELECT query_id, evidence_type branch, video_id, original_frame_id, start_ms, end_ms, result_no rank, score raw_score, evidence_id,
  CASE WHEN original_frame_id IS NOT NULL THEN video_id || ':frame:' || original_frame_id ELSE video_id || ':time:' || start_ms || ':' || end_ms END AS key
  FROM (SELECT hits.*, evidence_type FROM hits JOIN ev USING (evidence_id) WHERE hits.start_ms IS NOT NULL AND hits.end_ms IS NOT NULL)),
bn AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch, key ORDER BY raw_score DESC, rank, evidence_id) n FROM bh),
ba AS (SELECT query_id, branch, key, max(video_id) video_id, round(0.7 * max(raw_score) + 0.3 * avg(raw_score) FILTER (n <= 3) + least(0.10, 0.02 * (count(*) - 1)), 9) raw, count(*) n_hits,
  min(start_ms) start_ms, greatest(max(end_ms), min(start_ms) + 1) end_ms, list_sort(list(DISTINCT evidence_id)) evidence_ids FROM bn GROUP BY query_id, branch, key),
br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY raw DESC, key) rank FROM ba) WHERE rank <= 100)"""


@query(f"WITH {_BRANCH} SELECT query_id, branch, key, video_id, round(raw, 6)::DOUBLE raw, n_hits, start_ms, end_ms, len(evidence_ids) n_evidence, rank FROM br")
def branch_aggregate(spark: SparkSession, d: str) -> DataFrame:
    a = fusion.branch_aggregate(_branch_hits(spark, d), 100)
    return a.select("query_id", "branch", "key", "video_id", F.round("raw", 6).alias("raw"), "n_hits", "start_ms", "end_ms", F.size("evidence_ids").alias("n_evidence"), "rank")


@query(f"""
WITH {_BRANCH}, c AS (SELECT *, CASE branch WHEN 'object' THEN 1.2 WHEN 'ocr' THEN 1.25 WHEN 'asr' THEN 1.25 ELSE 1.0 END / (60 + rank) c FROM br WHERE branch <> 'frame'),
g AS (SELECT query_id, key, sum(c) s, max(video_id) video_id, min(start_ms) start_ms, max(end_ms) end_ms, count(*) n_branches, string_agg(branch, ',' ORDER BY c DESC, branch) trace FROM c GROUP BY query_id, key),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, key) rank FROM g)
SELECT query_id, rank, key, round(s, 6)::DOUBLE score, video_id, start_ms, end_ms, n_branches, trace FROM n WHERE rank <= 500""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: each query's branches aggregated per frame or time, cut to their best, fused by weighted reciprocal rank."""
    branches = fusion.branch_aggregate(_branch_hits(spark, d), 100)
    fused = fusion.weighted_rrf(branches, {"object": 1.2, "ocr": 1.25, "asr": 1.25, "frame": 0.0})
    return fused.select("query_id", "rank", "key", F.round("score", 6).alias("score"), "video_id", "start_ms", "end_ms", "n_branches", "trace")


@query(f"""
WITH {_BRANCH}, o AS (SELECT query_id, branch, key, min(rank) least_rank, max(raw_score) raw_score, min(start_ms) start_ms, max(end_ms) end_ms FROM bh GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY least_rank, raw_score DESC, key) rank FROM o)
SELECT query_id, branch, key, least_rank, raw_score, start_ms, end_ms, rank FROM n WHERE rank <= 5""")
def variant_merge(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a query's variants merged per branch, the best five kept."""
    return fusion.merge_variants(_branch_hits(spark, d), 5).select("query_id", "branch", "key", "least_rank", "raw_score", "start_ms", "end_ms", "rank")


@query("""
WITH m AS (SELECT r_regionkey, n_nationkey, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_regionkey, arg_max(n_nationkey, n * 1000 - n_nationkey)::INT answer, max(n) n_votes FROM m GROUP BY 1""")
def majority_answer(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent answer per group, the first seen winning ties (customers' nation per region)."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return fusion.majority(j.select("r_regionkey", F.col("n_nationkey").alias("answer"), F.col("n_nationkey").alias("seen")), ["r_regionkey"], "answer", "seen", unknown="-1")


@query(f"""
WITH {_BRANCH}, s AS (SELECT query_id, key, video_id, rank, round(raw, 6) score FROM br WHERE branch = 'ocr'),
x AS (SELECT *, rank <= 3 head, CASE WHEN rank <= 3 THEN score * greatest(0.1, 1 + ((rank % 7 * 15.0 - 50) / 50) * 0.3) ELSE score END s2 FROM s)
SELECT query_id, key, round(s2, 6)::DOUBLE score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN head THEN 0 ELSE 1 END, CASE WHEN head THEN -s2 ELSE rank END, key) new_rank FROM x""")
def rerank_head(spark: SparkSession, d: str) -> DataFrame:
    """A scored head before the untouched tail."""
    b = fusion.branch_aggregate(_branch_hits(spark, d), 100).filter("branch = 'ocr'").select("query_id", "key", "rank", F.round("raw", 6).alias("score"))
    scores = b.select("query_id", "key", (F.col("rank") % 7 * 15.0).alias("model_score"))
    return fusion.rerank_head(b, scores, 3, 0.3).select("query_id", "key", F.round("score", 6).alias("score"), "new_rank")


@query("""
SELECT doc_id, lang, count(*) OVER () total FROM (SELECT DISTINCT doc_id, lang FROM documents WHERE source = 'ocr') ORDER BY doc_id LIMIT 25 OFFSET 25""")
def page_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A page with the total over all rows; the total is an aggregate of its own, so no row gathers in one window task."""
    x = table(spark, d, "documents").filter("source = 'ocr'").select("doc_id", "lang").distinct()
    page = x.orderBy("doc_id").offset(25).limit(25)
    return page.crossJoin(F.broadcast(x.agg(F.count("*").alias("total")))).select("doc_id", "lang", "total")


@query("""
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1)
SELECT query_id, max(CASE WHEN isfinite(score) THEN score END) top_score, (CASE WHEN max(CASE WHEN isfinite(score) THEN score END) * 10 > 1 THEN 1.0 ELSE max(CASE WHEN isfinite(score) THEN score END) * 10 END)::DOUBLE confidence, bool_or(degraded) degraded,
  CASE WHEN bool_and(degraded) THEN 'failed' WHEN bool_or(degraded) THEN 'degraded' ELSE 'completed' END status FROM r GROUP BY 1""")
def response_flags(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of a ranking and status of a run from its rows."""
    r = latest(table(spark, d, "search_response").select("query_id", "result_no", "score", "degraded", "ingested_at"), ["query_id", "result_no"], "ingested_at")
    finite = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    g = r.groupBy("query_id").agg(F.max(finite).alias("top_score"), F.bool_or("degraded").alias("degraded"), F.bool_and("degraded").alias("all_"))
    status = F.when(F.col("all_"), "failed").when(F.col("degraded"), "degraded").otherwise("completed")
    return g.select("query_id", "top_score", F.when(F.col("top_score").isNotNull(), F.least(F.lit(1.0), F.col("top_score") * 10)).alias("confidence"), "degraded", status.alias("status"))


@query(f"""WITH {_HITS}, x AS (SELECT query_id, hits.evidence_id, evidence_type, trim(substr(trim(repeat(hits.video_id || ' ' || evidence_type || ' ', 5 + result_no % 3 * 40)), 1, 500)) s, row_number() OVER (PARTITION BY query_id ORDER BY result_no, hits.evidence_id) i FROM hits JOIN ev USING (evidence_id)),
l AS (SELECT *, '[' || evidence_type || '][' || evidence_id || '] ' || substr(trim(repeat(video_id || ' ' || evidence_type || ' ', 5 + result_no % 3 * 40)), 1, 500) line FROM (SELECT query_id, hits.evidence_id, evidence_type, hits.video_id, result_no, row_number() OVER (PARTITION BY query_id ORDER BY result_no, hits.evidence_id) i FROM hits JOIN ev USING (evidence_id)) WHERE i <= 20),
c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY i) upto, row_number() OVER (PARTITION BY query_id ORDER BY i) n FROM l)
SELECT query_id, count(*) n_kept, sum(length(line))::BIGINT n_chars FROM c WHERE upto - CASE WHEN n = 1 THEN 0 ELSE 1 END <= 8000 GROUP BY 1""")
def compact_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence lines of a query's prompt: 20 rows, 500 characters each, until 8,000 would be passed."""
    ev = table(spark, d, "evidence").select("evidence_id", "evidence_type").distinct()
    h = _hits(spark, d).join(ev, "evidence_id")
    snippet = F.repeat(F.concat("video_id", F.lit(" "), "evidence_type", F.lit(" ")), 5 + F.col("result_no") % 3 * 40)
    lines = contracts.evidence_lines(h.withColumn("snippet", snippet), ["query_id"], ["result_no", "evidence_id"], "evidence_type", "evidence_id", "snippet")
    return lines.groupBy("query_id").agg(F.count("*").alias("n_kept"), F.sum(F.length("line")).alias("n_chars"))


@query("""
WITH RECURSIVE r AS (SELECT upper(trim(video_id)) video_id, start_ms t, original_frame_id f, max(round(score, 6)) score FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id, result_no ORDER BY ingested_at DESC) k FROM search_response) WHERE k = 1 AND video_id IS NOT NULL AND start_ms IS NOT NULL AND isfinite(score) GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, f IS NULL, f, t) i FROM r),
fold AS (SELECT video_id, i, t, f, score, [t] kept, true keep FROM o WHERE i = 1
  UNION ALL
  SELECT o.video_id, o.i, o.t, o.f, o.score, CASE WHEN len(list_filter(kept, lambda y: abs(y - o.t) <= 2000)) = 0 THEN list_append(kept, o.t) ELSE kept END, len(list_filter(kept, lambda y: abs(y - o.t) <= 2000)) = 0
  FROM fold JOIN o ON o.video_id = fold.video_id AND o.i = fold.i + 1)
SELECT video_id, t start_ms, f original_frame_id, score FROM fold WHERE keep""")
def temporal_nms(spark: SparkSession, d: str) -> DataFrame:
    """Greedy suppression of results closer than two seconds in a video, best first."""
    r = latest(table(spark, d, "search_response").select("query_id", "result_no", "video_id", "original_frame_id", "start_ms", "score", "ingested_at"), ["query_id", "result_no"], "ingested_at").withColumn("video_id", clean_id("video_id"))
    r = r.filter("video_id is not null and start_ms is not null and score is not null and not isnan(score) and abs(score) < double('inf')")
    m = r.groupBy("video_id", "start_ms", "original_frame_id").agg(F.max(F.round("score", 6)).alias("score")).withColumn("at_ms", F.col("start_ms"))
    return temporal.suppress_near(m, "video_id", "at_ms", "score", "original_frame_id", "start_ms", 2000).drop("at_ms")


@query("""
WITH v AS (SELECT DISTINCT * FROM frame_aliases), n AS (SELECT upper(trim(video_id)) video_id, keyframe_no, row_number() OVER (PARTITION BY upper(trim(video_id)) ORDER BY keyframe_no) i FROM v)
SELECT video_id, string_agg(keyframe_no, '-' ORDER BY keyframe_no) answer FROM n WHERE i <= 4 GROUP BY 1 HAVING count(*) = 4""")
def first_four(spark: SparkSession, d: str) -> DataFrame:
    """The first four keyframes of each video that has four, as an answer."""
    a = table(spark, d, "frame_aliases").select(clean_id("video_id").alias("video_id"), "keyframe_no", "created_at", "metadata", "original_frame_id").distinct()
    n = a.withColumn("i", F.row_number().over(Window.partitionBy("video_id").orderBy("keyframe_no"))).filter("i <= 4")
    return n.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list("keyframe_no")), "-").alias("answer"), F.count("*").alias("n")).filter("n = 4").drop("n")
