"""Keys between tables: validated merges, constraint checks, alias groups, upserts and append-only revisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolith.operators.skew import numbered
from kinolith.session import stage


class KeyViolation(ValueError):
    """A merge that must be one-to-one or many-to-one is not."""


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name."""
    return reduce(DataFrame.unionByName, frames)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def merge_checked(left: DataFrame, right: DataFrame, keys: list[str], one_to_one: bool = False, required: bool = True) -> DataFrame:
    """Left join that fails on repeated right keys, (one_to_one) repeated left keys, or (required) missing partners."""
    if repeated_keys(right, keys).take(1) or (one_to_one and repeated_keys(left, keys).take(1)):
        raise KeyViolation(f"keys {keys} repeat")
    if required and missing_keys(left, right, keys).take(1):
        raise KeyViolation(f"keys {keys} without a partner")
    return left.join(right, keys, "left")


def conflicts(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys on which both sides hold a value of the column and differ."""
    a, b = left.select(*keys, F.col(column).alias("left_value")), right.select(*keys, F.col(column).alias("right_value"))
    return a.join(b, keys).filter("left_value <> right_value").distinct()


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: key, side (missing: not in left; extra: not in right)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("extra")))


def reconcile_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose row counts differ between two tables; absent means 0."""
    a, b = left.groupBy(key).agg(F.count("*").alias("a")), right.groupBy(key).agg(F.count("*").alias("b"))
    return a.join(b, key, "full").select(key, F.coalesce("a", F.lit(0)).alias("n_left"), F.coalesce("b", F.lit(0)).alias("n_right")).filter("n_left <> n_right")


def with_ordinals(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Place within the group and the group's size."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*group).orderBy(order))).withColumn("group_size", F.count("*").over(Window.partitionBy(*group)))


def alias_groups(df: DataFrame, group: list[str], number: str) -> DataFrame:
    """One row per canonical frame: representative (lowest number), count and all numbers."""
    return df.groupBy(*group).agg(F.min(number).alias("representative"), F.count("*").alias("alias_count"), F.array_join(F.array_sort(F.collect_set(number)), ",").alias("numbers"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace or extend the target's; of repeated source keys the caller keeps one."""
    return target.join(source.select(*keys), keys, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target and the source rows whose key it lacks."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def pending(source: DataFrame, done: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Inputs not yet processed with their present fingerprint."""
    return source.join(done.select(*keys, fingerprint).distinct(), [*keys, fingerprint], "left_anti")


def next_revision(revisions: DataFrame, group: list[str], revision: str = "revision") -> DataFrame:
    """The number the next revision of each group gets."""
    return revisions.groupBy(*group).agg((F.coalesce(F.max(revision), F.lit(0)) + 1).alias("next_revision"))


def latest_revision(revisions: DataFrame, group: list[str], revision: str = "revision") -> DataFrame:
    rest = [c for c in revisions.columns if c not in group]
    return revisions.groupBy(*group).agg(F.max_by(F.struct(*rest), revision).alias("x")).select(*group, *[F.col(f"x.{c}").alias(c) for c in rest])


def single_value(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Groups in which a column that must be constant holds several values."""
    return df.groupBy(*group).agg(F.countDistinct(column).alias("n_values")).filter("n_values > 1")


def ordered_distinct(queues: DataFrame, group: list[str], key: str, position: list[str], most: int) -> DataFrame:
    """Union of queues without repeats, per group: the first place of a key counts, at most `most` rows; numbered from 1 as `place`."""
    first = queues.groupBy(*group, key).agg(F.min(F.struct(*position)).alias("p_"))
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*[f"p_.{p}" for p in position], key))
    return first.withColumn("place", n).filter(F.col("place") <= most).select(*group, key, *[F.col(f"p_.{p}").alias(p) for p in position], "place")


def insert_at(rows: DataFrame, new: DataFrame, position: str) -> DataFrame:
    """New rows put before the row that holds their position; positions are numbered again from 0 in `place`. Positions tell rows apart."""
    both = rows.withColumn("new_", F.lit(1)).unionByName(new.withColumn("new_", F.lit(0)))
    return numbered(both, [F.col(position), F.col("new_")], "place").drop("new_")


def deal(df: DataFrame, order: str, n: int, contiguous: bool) -> DataFrame:
    """Rows dealt to n batches, in turn or as near-equal stretches (the first ones get the rows left over); `order` tells rows apart."""
    i = numbered(df, [F.col(order)], "i_")
    if not contiguous:
        return i.withColumn("batch", F.pmod("i_", F.lit(n)).cast("int")).drop("i_")
    i = stage(i, "numbered")
    total = i.count()  # from the Parquet footers
    size, more = divmod(total, n)
    cut = more * (size + 1)
    batch = F.when(F.col("i_") < cut, F.floor(F.col("i_") / max(size + 1, 1))).otherwise(more + F.floor((F.col("i_") - cut) / max(size, 1)))
    return i.withColumn("batch", batch.cast("int")).drop("i_")
