"""Branch aggregation, weighted reciprocal-rank fusion and the merge of query variants.

Hits carry: the columns of their query (`by`), branch, video_id, original_frame_id, start_ms, end_ms, rank, raw_score,
evidence_id, and the key column made by `candidate_key`. Hits of different queries never meet: the query is part of every
group, rank and limit. Sums are over the few hits of a key; the aggregates combine before the exchange, and the top k of
a query is a window with a group limit, so a query with most of the hits is cut before it gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.functions import num

QUERY = ["query_id"]


def ranked(df: DataFrame, by: list[Column], partition: list[str], name: str = "rank") -> DataFrame:
    """Rank 1.. by the order within the partition columns."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*by)))


def in_order(items: str, order: Column) -> Column:
    """Aggregate: the distinct values of a column in the order of their first place."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(items).alias("x")))), lambda s: s["x"]))


def branch_aggregate(hits: DataFrame, k: int, by: list[str] = QUERY) -> DataFrame:
    """One row per (query, branch, key): 0.7 best + 0.3 mean of the best three + at most 0.10 for repeats; the k best per query and branch."""
    group = [*by, "branch", "key"]
    n = hits.withColumn("n_", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("raw_score").desc(), "rank", "evidence_id")))
    agg = n.groupBy(*group).agg(
        F.max("raw_score").alias("best"),
        F.avg(F.when(F.col("n_") <= 3, F.col("raw_score"))).alias("mean3"),
        F.count("*").alias("n_hits"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_"),
        F.min_by(F.struct("video_id", "original_frame_id"), "n_").alias("rep"),
        in_order("evidence_id", F.struct("rank", "evidence_id")).alias("evidence_ids"),
    )
    raw = 0.7 * F.col("best") + 0.3 * F.col("mean3") + F.least(F.lit(0.10), 0.02 * (F.col("n_hits") - 1))
    out = agg.select(*group, "rep.video_id", "rep.original_frame_id", F.round(raw, 9).alias("raw"), "n_hits", "start_ms", F.greatest("end_", F.col("start_ms") + 1).alias("end_ms"), "evidence_ids")
    return ranked(out, [F.col("raw").desc(), F.col("key")], [*by, "branch"]).filter(F.col("rank") <= k)


def weighted_rrf(branches: DataFrame, weights: dict[str, float], rrf_k: int = 60, k: int = 500, by: list[str] = QUERY) -> DataFrame:
    """Per query: score = sum of weight / (rrf_k + rank) over branches with a positive weight (1 if not given); the k best keys."""
    weight = F.lit(1.0)
    for name, x in weights.items():
        weight = F.when(F.col("branch") == name, F.lit(float(x))).otherwise(weight)
    part = branches.withColumn("w_", weight).filter("w_ > 0").withColumn("c_", F.col("w_") / (F.lit(rrf_k) + F.col("rank")))
    trace = F.array_sort(F.collect_list(F.struct((-F.col("c_")).alias("c"), F.col("branch").alias("b"), F.col("rank").alias("r"), F.col("evidence_ids").alias("e"))))
    fused = part.groupBy(*by, "key").agg(
        F.round(F.sum("c_"), 9).alias("score"),
        F.first("video_id").alias("video_id"),
        F.first("original_frame_id", ignorenulls=True).alias("original_frame_id"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.count("*").alias("n_branches"),
        trace.alias("t_"),
        F.array_sort(F.collect_set(num.modality("branch"))).alias("modalities"),
    )
    out = fused.select(
        *by, "key", "score", "video_id", "original_frame_id", "start_ms", "end_ms", "n_branches", F.array_join(F.transform("t_", lambda x: x["b"]), ",").alias("trace"),
        "modalities", F.array_distinct(F.flatten(F.transform("t_", lambda x: x["e"]))).alias("evidence_ids"),
    )
    return ranked(out, [F.col("score").desc(), F.col("key")], by).filter(F.col("rank") <= k)


def merge_variants(hits: DataFrame, k: int, by: list[str] = QUERY) -> DataFrame:
    """Hits of a query's variants to one per (query, branch, key): least rank, best score; ranked again, the k best of a branch."""
    one = hits.groupBy(*by, "branch", "key").agg(
        F.min("rank").alias("least_rank"), F.max("raw_score").alias("raw_score"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.min("original_frame_id").alias("original_frame_id"), F.min("video_id").alias("video_id"), in_order("evidence_id", F.struct("rank", "evidence_id")).alias("evidence_ids"),
    )
    return ranked(one, [F.col("least_rank"), F.col("raw_score").desc(), F.col("key")], [*by, "branch"]).filter(F.col("rank") <= k)


def rerank_head(df: DataFrame, scores: DataFrame, head: int, weight: float, by: list[str] = QUERY) -> DataFrame:
    """A query's first `head` candidates take model scores (50 where missing) and are ordered again; the tail follows as it was."""
    j = df.join(scores, [*by, "key"], "left").withColumn("in_head", F.col("rank") <= head)
    new = F.when(F.col("in_head"), F.col("score") * num.rerank_multiplier(F.coalesce("model_score", F.lit(50.0)), weight)).otherwise(F.col("score"))
    j = j.withColumn("score", new)
    return ranked(j, [F.when(F.col("in_head"), 0).otherwise(1), F.when(F.col("in_head"), -F.col("score")).otherwise(F.col("rank")), F.col("key")], by, "new_rank")


def majority(df: DataFrame, group: list[str], answer: str, order: str, unknown: str = "unknown") -> DataFrame:
    """Most frequent answer of a group; the first seen wins ties; unknown does not count."""
    n = df.filter((F.col(answer) != unknown) & F.col(answer).isNotNull()).groupBy(*group, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*group).agg(F.max_by(F.struct(answer, "n"), F.struct(F.col("n"), -F.col("first"))).alias("x")).select(*group, F.col(f"x.{answer}").alias(answer), F.col("x.n").alias("n_votes"))


def backfill_majority(df: DataFrame, group: list[str], answer: str, order: str) -> DataFrame:
    """Open answers filled with their group's majority."""
    m = majority(df, group, answer, order).withColumnRenamed(answer, "majority_").drop("n_votes")
    return df.join(m, group, "left").withColumn(answer, F.coalesce(answer, "majority_")).drop("majority_")
