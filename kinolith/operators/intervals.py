"""Problem 4: overlapping and gapped time intervals, as a mergeable aggregate over a reduction tree.

The aggregate's state is a sorted list of disjoint intervals with the number of spans in each. Two states combine by one
linear merge of their sorted lists, so any grouping of the partial states gives the same list. Time is cut into blocks
and a state belongs to (entity, block of the start): it cannot hold more than block/2 intervals of integer times, however
many rows an entity has, and a hot entity spreads over its blocks.

  leaf    each batch of a map task becomes states (before any exchange)
  tree    states of (entity, block, salt) combine, then those of (entity, block)
  edges   one row per block carries the end and the start of the period still open when a block begins
  result  lists and their complements: one row per period, with the end of the period before it

Defined results: intervals that touch belong together; rows with a null bound or end <= start are no intervals; a null
entity is an entity of its own; repeated rows count as often as they come; empty input gives an empty table; further
columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolith.session import stage, width

BLOCK_MS = 600_000
LISTS = "starts array<long>, ends array<long>, ns array<long>"


def disjoint(g: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted disjoint intervals of each group: (group, start, end, count). Input that is a few sorted runs merges in linear time."""
    if not len(g):
        return g, s, e, n
    wide = int(s.max()) - int(s.min()) + 1
    if (int(g.max()) + 1) * wide < 1 << 62:  # one key, one merge: the stable sort merges the sorted runs it finds
        order = np.argsort(g * wide + (s - s.min()), kind="stable")
    else:
        order = np.lexsort((s, g))
    g, s, e, n = g[order], s[order], e[order], n[order]
    fresh = np.empty(len(g), bool)
    fresh[0] = True
    low, span = int(e.min()), int(e.max()) - int(e.min()) + 1
    if (int(g[-1]) + 1) * span < 1 << 62:
        shift = g * span
        reach = np.maximum.accumulate(e - low + shift) - shift + low
    else:
        reach = e.copy()
        cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            np.maximum.accumulate(e[a:b], out=reach[a:b])
    fresh[1:] = (g[1:] != g[:-1]) | (s[1:] > reach[:-1])
    at = np.flatnonzero(fresh)
    return g[at], s[at], np.maximum.reduceat(e, at), np.add.reduceat(n, at)


def _rows(keys: list[pa.Array], names: list[str], g: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """One row per group: its keys (taken at row first[group]) and its lists."""
    cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    offsets = pa.array(np.r_[cuts, len(g)].astype(np.int32))
    take = pa.array(first[g[cuts]] if len(g) else np.zeros(0, np.int64))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (s, e, n)]
    return pa.RecordBatch.from_arrays([*[k.take(take) for k in keys], *lists], names)


def _leaf(block: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        for b in batches:
            s, e = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            ent = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            blk = np.floor_divide(s, block)
            _, first, g = np.unique(np.stack([ent, blk]), axis=1, return_index=True, return_inverse=True)
            keys = [b.column(0), pa.array(blk), pa.array(np.full(len(s), salt, np.int32))]
            yield _rows(keys, ["ent", "blk", "salt", "starts", "ends", "ns"], *disjoint(g.reshape(-1).astype(np.int64), s, e, np.ones(len(s), np.int64)), first)

    return run


def _combine(n_keys: int):
    """Merge the states of each run of equal keys; rows come sorted by the keys, and a run may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        names: list[str] = []

        def merged(t: pa.Table) -> pa.RecordBatch:
            b = t.combine_chunks().to_batches(max_chunksize=None)[0]
            keys = [b.column(i) for i in range(n_keys)]
            change = np.zeros(b.num_rows, bool)
            for k in keys:
                code = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            of_row = np.cumsum(change)
            first = np.flatnonzero(np.r_[True, change[1:]])
            sizes = np.diff(b.column(n_keys).offsets.to_numpy())
            g = np.repeat(of_row, sizes)
            s, e, n = (b.column(n_keys + i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
            return _rows(keys, names, *disjoint(g.astype(np.int64), s, e, n), first)

        for b in batches:
            if not b.num_rows:
                continue
            names = b.schema.names
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            last = t.slice(t.num_rows - 1).select(range(n_keys)).to_pylist()[0]
            cut = t.num_rows - 1
            keys = t.select(range(n_keys))
            while cut and keys.slice(cut - 1, 1).to_pylist()[0] == last:
                cut -= 1
            if cut:
                yield merged(t.slice(0, cut))
            rest = t.slice(cut)
            if rest.num_rows > 64:  # a long run of states of one key shrinks as it comes
                rest = pa.Table.from_batches([merged(rest)])
        if rest is not None and rest.num_rows:
            yield merged(rest)

    return run


def interval_states(df: DataFrame, entity: str, start: str, end: str, block: int = BLOCK_MS, salts: int = 8) -> DataFrame:
    """The merged states: ent, blk, starts, ends, ns."""
    kind = df.schema[entity].dataType.simpleString()
    src = df.select(F.col(f"`{entity}`").alias("ent"), F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"))
    src = src.filter("s is not null and e is not null and e > s")
    n = width(df.sparkSession)
    states = src.mapInArrow(_leaf(block, salts), f"ent {kind}, blk long, salt int, {LISTS}")
    if salts > 1:
        states = states.repartition(n, "ent", "blk", "salt").sortWithinPartitions("ent", "blk", "salt").mapInArrow(_combine(3), states.schema)
    states = states.drop("salt")
    return states.repartition(n, "ent", "blk").sortWithinPartitions("ent", "blk").mapInArrow(_combine(2), states.schema)


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, block: int = BLOCK_MS, salts: int = 8) -> DataFrame:
    """Continuous periods: entity, start_ms, end_ms, n_spans, and prev_end_ms, where the period before it ended (null for the first)."""
    states = stage(interval_states(df, entity, start, end, block, salts), "intervals")
    before = Window.partitionBy("ent").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    edges = states.select("ent", "blk", F.element_at("ends", -1).alias("last_end"), F.element_at("starts", -1).alias("last_start"))
    edges = edges.withColumn("carry_end", F.max("last_end").over(before))
    opened = F.when(F.col("carry_end").isNull() | (F.col("last_start") > F.col("carry_end")), F.col("last_start"))
    edges = edges.withColumn("opened", opened).withColumn("carry_start", F.last("opened", ignorenulls=True).over(before))
    edges = edges.select(F.col("ent").alias("ent_"), F.col("blk").alias("blk_"), "carry_end", "carry_start")
    all_ = states.join(edges, F.col("ent").eqNullSafe(F.col("ent_")) & (F.col("blk") == F.col("blk_")))
    parts = all_.select("ent", "carry_end", "carry_start", "ends", F.posexplode(F.arrays_zip("starts", "ends", "ns")).alias("pos", "x"))
    prev_end = F.greatest("carry_end", F.when(F.col("pos") > 0, F.element_at("ends", F.greatest("pos", F.lit(1)))))
    parts = parts.select("ent", F.col("x.starts").alias("s"), F.col("x.ends").alias("e"), F.col("x.ns").alias("n"), "carry_start", prev_end.alias("prev_end"), "carry_end")
    fresh = F.col("carry_end").isNull() | (F.col("s") > F.col("carry_end"))
    parts = parts.select("ent", F.when(fresh, F.col("s")).otherwise(F.col("carry_start")).alias("start_ms"), "e", "n", F.when(fresh, F.col("prev_end")).alias("p"))
    out = parts.groupBy("ent", "start_ms").agg(F.max("e").alias("end_ms"), F.sum("n").alias("n_spans"), F.max("p").alias("prev_end_ms"))
    return out.withColumnRenamed("ent", entity)


def gaps(periods: DataFrame, entity: str) -> DataFrame:
    """The complement between the periods of an entity: entity, start_ms, end_ms."""
    return periods.filter("prev_end_ms is not null").select(F.col(entity), F.col("prev_end_ms").alias("start_ms"), F.col("start_ms").alias("end_ms"))
