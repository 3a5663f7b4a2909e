"""A stored flat index of unit vectors with its table and meta row, and searches over it.

The index is a folder: `vectors` (unit vectors, by model) and `meta` (a row per model: size, dimension, unit length). A search
reads the vectors of its model only, scores them where they lie, and only the best k of each task move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.functions import vector


def build_index(rows: DataFrame, path: str, vec_id: str, column: str, model: str, eligible: Column | None = None) -> DataFrame:
    """Write the index of the eligible rows; vectors that are null, zero or not finite are left out. Returns its meta rows."""
    usable = rows if eligible is None else rows.filter(eligible)
    u = usable.select(F.col(model).alias("model"), F.col(vec_id).alias("id"), F.transform(vector.unit(column), lambda x: x.cast("float")).alias("vector")).filter("vector is not null")
    u.repartition("model").write.mode("errorifexists").partitionBy("model").parquet(f"{path}/vectors")
    held = rows.sparkSession.read.parquet(f"{path}/vectors")
    meta = held.groupBy("model").agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("min_dim"), F.max(F.size("vector")).alias("max_dim"), F.bool_and(vector.is_unit("vector")).alias("unit"))
    meta.coalesce(1).write.parquet(f"{path}/meta")
    return rows.sparkSession.read.parquet(f"{path}/meta")


def search_index(spark: SparkSession, path: str, query: list[float], model: str, k: int) -> DataFrame:
    """id and score of the k rows with the greatest inner product with the query at unit length, ties to the smaller id."""
    size = sum(x * x for x in query) ** 0.5
    if not size:
        raise ValueError("the query is zero")
    q = F.array(*[F.lit(x / size) for x in query])
    rows = spark.read.parquet(f"{path}/vectors").filter(F.col("model") == model)
    return rows.select("id", vector.dot("vector", q).alias("score")).filter("score is not null").orderBy(F.col("score").desc(), "id").limit(k)
