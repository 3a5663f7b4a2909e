"""Joins and ordered look-ups that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.session import stage

HOT_ROWS = 2_000_000


def hot_counts(left: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of `left` with more than hot_rows rows and the number of salts each needs.

    At most rows/hot_rows keys come out, so the table stays small at any size; counts combine before the exchange. It is
    written once, so that the joins that use it do not count again."""
    n = left.groupBy(*on).agg(F.count("*").alias("n_"))
    return stage(n.filter(F.col("n_") > hot_rows).withColumn("salts_", F.ceil(F.col("n_") / hot_rows).cast("int")).drop("n_"), "hot")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", hot: DataFrame | None = None, spread: Column | None = None) -> DataFrame:
    """Equi-join of a large `left` with a `right` that has few rows per key.

    Rows of `left` under a hot key are dealt to its salts, the key's `right` rows are copied once per salt; other keys
    join as usual, and without hot keys the whole join does. Spark picks broadcast or sort-merge by the size it measures.
    Null keys match nothing. how: inner or left."""
    hot = hot if hot is not None else hot_counts(left, on)
    if hot.isEmpty():
        return left.join(right, on, how)
    spread = spread if spread is not None else F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes if not t.startswith("map")])
    a = left.join(hot, on, "left").withColumn("salt_", F.pmod(spread, F.coalesce("salts_", F.lit(1))).cast("int")).drop("salts_")
    b = right.join(hot, on, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce("salts_", F.lit(1)) - 1))).drop("salts_")
    return a.join(b, [*on, "salt_"], how).drop("salt_")


def scan_entity(df: DataFrame, entity: list[str], order: str, values: dict[str, tuple[str, Column]], block: int = 65_536, ties: list[str] | None = None, distinct: bool = False, keep_block: bool = False) -> DataFrame:
    """Several running values over entity by `order` in one pass, without sorting a whole entity in one task.

    An entity is cut into blocks of the order column. All values of a block come from one sort, and what the other blocks
    add comes from one row per block that joins back, so the rows themselves move once. values: name -> (kind, value).

    kind: `lag`, `lead` (value of the row before, after, also if null), `last` (last value that is not null, up to the row),
    `next` (first from the row on), `first` (value of the entity's first row), `max`, `sum` (up to the row), `before`
    (maximum of the rows before the row). ties: further columns that fix the order of rows with equal `order`.
    distinct: rows that repeat count once, in the same exchange. A column blk_ that is there already is used as it is, so
    scans of one order follow each other without another exchange (keep_block)."""
    d = df if "blk_" in df.columns else df.withColumn("blk_", F.floor(F.col(order) / block))
    if distinct:
        d = d.repartition(*entity, "blk_").distinct()
    by = [F.col(c) for c in [order, *(ties or [])]]
    inside = Window.partitionBy(*entity, "blk_").orderBy(*by)
    blocks = Window.partitionBy(*entity).orderBy("blk_")
    upto, rest, past = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing), inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier, later = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
    place = F.struct(*by)
    d = d.withColumns({f"v{i}_": v for i, (_, v) in enumerate(values.values())})
    edges, carries, heres, results = [], [], [], []
    for i, (name, (kind, _)) in enumerate(values.items()):
        v, e, here, carry = F.col(f"v{i}_"), F.col(f"e{i}_"), F.col(f"h{i}_"), F.col(f"c{i}_")
        held = F.when(v.isNotNull(), F.struct(v.alias("x")))
        unwrap = lambda a, b: F.when(a.isNotNull(), a["x"]).otherwise(b["x"])
        edge, inner, over, both = {
            "lag": lambda: (F.max_by(F.struct(v.alias("x")), place), F.lag(F.struct(v.alias("x"))).over(inside), F.lag(e).over(blocks), unwrap(here, carry)),
            "lead": lambda: (F.min_by(F.struct(v.alias("x")), place), F.lead(F.struct(v.alias("x"))).over(inside), F.lead(e).over(blocks), unwrap(here, carry)),
            "first": lambda: (F.min_by(F.struct(v.alias("x")), place), F.first(F.struct(v.alias("x"))).over(upto), F.first(e).over(earlier), unwrap(carry, here)),
            "last": lambda: (F.max_by(held, F.when(held.isNotNull(), place)), F.last(held, ignorenulls=True).over(upto), F.last(e, ignorenulls=True).over(earlier), unwrap(here, carry)),
            "next": lambda: (F.min_by(held, F.when(held.isNotNull(), place)), F.first(held, ignorenulls=True).over(rest), F.first(e, ignorenulls=True).over(later), unwrap(here, carry)),
            "max": lambda: (F.max(v), F.max(v).over(upto), F.max(e).over(earlier), F.greatest(here, carry)),
            "before": lambda: (F.max(v), F.max(v).over(past), F.max(e).over(earlier), F.greatest(here, carry)),
            "sum": lambda: (F.sum(v), F.sum(v).over(upto), F.sum(e).over(earlier), F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))),
        }[kind]()
        edges.append(edge.alias(f"e{i}_"))
        carries.append(over.alias(f"c{i}_"))
        heres.append(inner.alias(f"h{i}_"))
        results.append(both.alias(name))
    carried = d.groupBy(*entity, "blk_").agg(*edges).select(*entity, "blk_", *carries)
    out = d.select("*", *heres).join(carried, [*entity, "blk_"], "left")
    keep = [c for c in df.columns if c not in values and c != "blk_"] + (["blk_"] if keep_block else [])
    return out.select(*[F.col(f"`{c}`") for c in keep], *results)


def previous_in_entity(df: DataFrame, entity: list[str], order: str, value: Column, name: str, block: int = 65_536) -> DataFrame:
    """`lag(value)` over entity by the integer `order`; rows tied in `order` have no fixed order."""
    return scan_entity(df, entity, order, {name: ("lag", value)}, block)


def numbered(df: DataFrame, order: list[Column], name: str, total: Column | None = None) -> DataFrame:
    """Place of each row (from 0) in a global order, and the sum of `total` over the rows before it (`before_`).

    The rows are cut into ranges of the order; a range is numbered in its own task from what the ranges before it hold, one
    row per range. The order must tell rows apart, else equal rows meet in one task."""
    value = F.lit(0) if total is None else F.coalesce(total, F.lit(0))
    r = stage(df.withColumn("size_", value).repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = r.groupBy("part_").agg(F.count("*").alias("n_"), F.sum("size_").alias("s_"))
    starts = starts.select("part_", F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("n_"), F.coalesce(F.sum("s_").over(ahead), F.lit(0)).alias("s_"))
    w = Window.partitionBy("part_").orderBy(*order)
    d = r.withColumn("i_", F.row_number().over(w) - 1).withColumn("b_", F.coalesce(F.sum("size_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(starts, "part_")
    before = [] if total is None else [(F.col("b_") + F.col("s_")).alias("before_")]
    return d.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("i_") + F.col("n_")).alias(name), *before)
