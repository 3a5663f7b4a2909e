"""Problem 5: records of two tables paired by nearest time, through x-fast tries.

The times of an entity form a binary trie of bit prefixes. Its top bits are the exchange's hash key: the time is cut into
blocks of 2**BITS units and (entity, block) meets in one task. Below, an `XFastTrie` has one hash table per prefix length,
from prefix to its least and greatest time; a query binary-searches the length of the longest prefix that is present
(log2(BITS) look-ups), and that node's least or greatest time and the linked list of times give predecessor and successor.

A block holds at most 2**BITS distinct times, whatever an entity's share of the rows, as equal times fall to the smallest
id before the exchange. Points are copied to the neighbour block when they lie within the tolerance of its edge; events
stream past the trie and are never gathered. A block with very many events is dealt to salts, each with the block's trie.

Defined results: times may be fractional on the left, points are whole units; on equal distance the earlier point wins,
then the smaller id; a null or NaN time, a null entity or a null id matches nothing and gives no row; repeated rows count
as often as they come on the left; empty tables give an empty table; left columns named like the result's are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinolith.operators.skew import HOT_ROWS, hot_counts
from kinolith.session import stage, width

BITS = 17


class XFastTrie:
    """Times 0 <= t < 2**bits, given in ascending order without repeats."""

    def __init__(self, times: list[int], bits: int = BITS):
        self.bits = bits
        self.before = dict(zip(times, [None, *times]))
        self.after = dict(zip(times, [*times[1:], None]))
        self.least: list[dict[int, int]] = []
        self.most: list[dict[int, int]] = []
        for length in range(bits + 1):
            shift = bits - length
            prefixes = [t >> shift for t in times]
            self.most.append(dict(zip(prefixes, times)))  # the last of equal prefixes stays
            self.least.append(dict(zip(reversed(prefixes), reversed(times))))

    def neighbours(self, q: int) -> tuple[int | None, int | None]:
        """(greatest time <= q, least time > q)."""
        if not self.before:
            return None, None
        low, high = 0, self.bits  # the longest present prefix of q
        while low < high:
            mid = (low + high + 1) // 2
            if q >> (self.bits - mid) in self.most[mid]:
                low = mid
            else:
                high = mid - 1
        if low == self.bits:
            return q, self.after[q]
        node = q >> (self.bits - low)
        if q >> (self.bits - low - 1) & 1:  # q would go right, where nothing is: all of the node lies before q
            p = self.most[low][node]
            return p, self.after[p]
        s = self.least[low][node]
        return self.before[s], s


def _answer(bits: int, block_units: int, tolerance: float, n_left: int, out: pa.Schema, batch: int = 10_000):
    """Rows come sorted by entity, block, salt, kind (points first), time. Points: time and id; events: their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, times, ids, trie, base = None, [], {}, None, 0
        held: list[list] = [[] for _ in range(n_left + 2)]
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            # ent, blk, salt, kind, t, id, left columns...
            for i in range(b.num_rows):
                key = (cols[0][i], cols[1][i], cols[2][i])
                if key != group:
                    group, times, ids, trie, base = key, [], {}, None, (key[1] - 1) * block_units
                t = cols[4][i]
                if cols[3][i] == 0:
                    at = int(t) - base
                    if at not in ids:  # ascending by id within a time
                        times.append(at)
                        ids[at] = cols[5][i]
                    continue
                if not times:
                    continue
                if trie is None:
                    trie = XFastTrie(times, bits + 2)
                q = t - base
                p, s = trie.neighbours(math.floor(q))
                if p is None or (s is not None and s - q < q - p):
                    p = s
                if p is None or abs(p - q) > tolerance:
                    continue
                for j in range(n_left):
                    held[j].append(cols[6 + j][i])
                held[n_left].append(ids[p])
                held[n_left + 1].append(p + base)
            if len(held[0]) >= batch:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, out)], schema=out)
                held = [[] for _ in range(n_left + 2)]
        if held[n_left]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, out)], schema=out)

    return run


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, right_id: str, tolerance: int, keep: list[str] | None = None, bits: int = BITS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left columns `keep` (all by default) with right_id and nearest_time of the nearest point within the tolerance."""
    keep = keep or left.columns
    if {right_id, "nearest_time"} & set(keep):
        raise ValueError("a left column has the name of a result column")
    bits = max(bits, math.ceil(math.log2(max(1, tolerance))))  # a block is at least as long as the tolerance
    units = 1 << bits
    spark = left.sparkSession
    rid = right.schema[right_id]
    ent = left.schema[entity].dataType
    events = left.select(F.col(f"`{entity}`").alias("ent"), F.col(f"`{left_time}`").cast("double").alias("t"), *[F.col(f"`{c}`").alias(f"l{i}_") for i, c in enumerate(keep)])
    events = events.filter("ent is not null and t is not null and not isnan(t)").withColumn("blk", F.floor(F.col("t") / units))
    points = right.select(F.col(f"`{entity}`").cast(ent).alias("ent"), F.col(f"`{right_time}`").cast("long").alias("p"), F.col(f"`{right_id}`").alias("id"))
    points = points.filter("ent is not null and p is not null and id is not null").groupBy("ent", "p").agg(F.min("id").alias("id"))
    # a point serves its own block and a neighbour within reach
    at = lambda shift: F.floor((F.col("p") + F.lit(shift)) / units)
    points = points.withColumn("blk", F.explode(F.array_distinct(F.array(at(-tolerance), at(0), at(tolerance)))))
    events = stage(events, "events")
    hot = hot_counts(events, ["ent", "blk"], hot_rows)
    none = [F.lit(None).cast(left.schema[c].dataType).alias(f"l{i}_") for i, c in enumerate(keep)]
    salts = F.coalesce("salts_", F.lit(1))
    e = events.join(hot, ["ent", "blk"], "left").select("ent", "blk", F.pmod(F.xxhash64(*[f"l{i}_" for i in range(len(keep))]), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "t", F.lit(None).cast(rid.dataType).alias("id"), *[f"l{i}_" for i in range(len(keep))])
    p = points.join(hot, ["ent", "blk"], "left").select("ent", "blk", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("p").cast("double").alias("t"), "id", *none)
    both = p.unionByName(e).repartition(width(spark), "ent", "blk", "salt").sortWithinPartitions("ent", "blk", "salt", "kind", "t", "id")
    out = T.StructType([*[T.StructField(c, left.schema[c].dataType) for c in keep], T.StructField(right_id, rid.dataType), T.StructField("nearest_time", T.LongType())])
    return both.mapInArrow(_answer(bits, units, float(tolerance), len(keep), to_arrow_schema(out)), out)
