"""Problem 2: the N first items of every group, by a merge of sorted runs with a loser tree.

  runs    each task sorts its rows by group and order (Tungsten sort, spills) and keeps the first N of a group; what is
          left is packed into blocks, one per (bucket, run) and at most `block_rows` rows, and stored in the shared folder
  merge   at most `fan_in` runs of a bucket meet in a task; a loser tree over them yields rows in order, and after N rows
          of a group every run seeks to its next group by its directory. While a bucket has more runs, merges make longer
          runs of them, level by level; the last level gives the ranks

A run never holds more than N rows of a group, so a group with most of the rows costs a task at most N rows per run, that
is N times the fan-in, whatever the number of map tasks. Blocks are decoded a few thousand rows at a time as the merge
comes to them. Buckets follow the session's partitions, so a task's blocks stay small as the data and the cluster grow.

Defined results: the order must end in columns that tell rows apart; rows equal in every order column are equal to the
operator and come out in any of their orders; repeated rows count as often as they come; nulls sort as asked (last by
default), NaN before null and above every number; -0.0 equals 0.0; null groups are groups; empty input gives an empty
table; columns named like the operator's own (`rank_no`) are an error; further columns are carried only if asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinolith.session import stage, width

FAN_IN, PART = 64, 4096


@dataclass(frozen=True)
class By:
    """One column of the order."""

    column: str
    descending: bool = False
    nulls_last: bool = True

    def spark(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


class _Down:
    """A value that compares the other way round."""

    __slots__ = ("v",)

    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return other.v < self.v

    def __eq__(self, other):
        return other.v == self.v


def _part(v, by: By):
    """A comparable that sorts as Spark sorts the value: NaN is the greatest number, nulls at the end asked for."""
    if v is None:
        return (1 if by.nulls_last else -1,)
    if isinstance(v, float):
        v = (1, 0.0) if math.isnan(v) else (0, v + 0.0)
    return (0, _Down(v) if by.descending else v)


class Run:
    """A sorted run, decoded part by part: the rows of the present part, the start of each of its groups, and a cursor."""

    __slots__ = ("parts", "n_group", "rows", "groups", "starts", "at", "group", "key")

    def __init__(self, parts: Iterator[list[tuple]], n_group: int):
        self.parts, self.n_group = parts, n_group
        self.rows: list[tuple] = []
        self.at, self.key = 0, None

    def _next_part(self) -> bool:
        rows = next((p for p in self.parts if p), None)
        if rows is None:
            return False
        n = self.n_group
        heads = [r[:n] for r in rows]
        self.starts = [0] + [i for i in range(1, len(rows)) if heads[i] != heads[i - 1]]
        self.groups = [tuple(_part(v, By("")) for v in heads[i]) for i in self.starts]
        self.starts.append(len(rows))
        self.rows, self.at, self.group = rows, 0, 0
        return True

    def head(self, order: list[By]) -> tuple | None:
        """The key of the row at the cursor."""
        if self.at >= len(self.rows) and not self._next_part():
            self.rows, self.key = [], None
        else:
            if self.at >= self.starts[self.group + 1]:
                self.group += 1
            row = self.rows[self.at]
            self.key = (self.groups[self.group], tuple(_part(row[self.n_group + i], b) for i, b in enumerate(order)))
        return self.key

    def seek(self, group: tuple) -> bool:
        """Leave `group` if the cursor is in it: the directory gives the next group's first row."""
        if self.key is not None and self.key[0] == group:
            self.at = self.starts[self.group + 1]
            return True
        return False


class LoserTree:
    """Tournament over runs: each inner node holds the loser of its match, node 0 the winner; a replay takes log2(runs) matches."""

    def __init__(self, keys: list[tuple | None]):
        self.k = len(keys)
        self.keys = keys
        self.node = [-1] * max(1, self.k)
        for i in range(self.k):
            self._seed(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return x < y if x != y else a < b

    def _seed(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self.node[at] < 0:
                self.node[at] = i
                return
            if self._beats(self.node[at], i):
                self.node[at], i = i, self.node[at]
            at //= 2
        self.node[0] = i

    def winner(self) -> int:
        return self.node[0]

    def replay(self, i: int, key: tuple | None) -> None:
        """Run i has a new head; play its path to the root again."""
        self.keys[i] = key
        at = (i + self.k) // 2
        while at > 0:
            if self._beats(self.node[at], i):
                self.node[at], i = i, self.node[at]
            at //= 2
        self.node[0] = i


def merge_runs(runs: list[Run], order: list[By], n: int) -> Iterator[tuple[int, tuple]]:
    """(rank, row) of the first n rows of every group, group by group."""
    if not runs:
        return
    tree = LoserTree([r.head(order) for r in runs])
    current, rank = None, 0
    while (key := tree.keys[w := tree.winner()]) is not None:
        if key[0] != current:
            current, rank = key[0], 0
        run = runs[w]
        if rank < n:
            rank += 1
            yield rank, run.rows[run.at]
            run.at += 1
        else:  # the group is full: this run, and each that comes up with the same group, seeks past it
            run.seek(current)
        tree.replay(w, run.head(order))


BLOCKS = "bucket int, run int, nth int, block binary"
BLOCK_SCHEMA = pa.schema([("bucket", pa.int32()), ("run", pa.int32()), ("nth", pa.int32()), ("block", pa.binary())])


def _packed(body: pa.Table) -> bytes:
    """A block: rows in parts of PART, so that a reader decodes one part at a time."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(body, max_chunksize=PART)
    return sink.getvalue().to_pybytes()


def _parts(blocks: list[bytes]) -> Iterator[list[tuple]]:
    """The rows of a run's blocks, part by part; a block is let go once it is read."""
    for i, raw in enumerate(blocks):
        for b in pa.ipc.open_stream(raw):
            yield list(zip(*[c.to_pylist() for c in b.columns]))
        blocks[i] = b""


def _cut(n: int, n_group: int, block_rows: int):
    """Keep the first n rows of each group of a sorted partition and pack them into blocks per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id = TaskContext.get().partitionId()
        last, seen, nth = None, 0, 0
        held: list[pa.Table] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).combine_chunks()
            bucket = t.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            body = t.drop_columns([t.column_names[0]])
            blocks = [_packed(body.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([run_id] * k, pa.int32()), pa.array([nth] * k, pa.int32()), pa.array(blocks, pa.binary())], schema=BLOCK_SCHEMA)

        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for i in range(1, n_group + 1):
                code = b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            first = tuple(b.column(i)[0].as_py() for i in range(1, n_group + 1))
            same = first == last
            change[0] = not same
            starts = np.flatnonzero(np.r_[True, change[1:]])
            pos = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.r_[starts, b.num_rows]))
            lead = starts[1] if len(starts) > 1 else b.num_rows
            if same:
                pos[:lead] += seen
            tail = int(pos[-1]) + 1
            last, seen = tuple(b.column(i)[b.num_rows - 1].as_py() for i in range(1, n_group + 1)), tail
            kept = pa.Table.from_batches([b]).filter(pa.array(pos < n))
            held.append(kept)
            rows += kept.num_rows
            if rows >= block_rows:
                yield from flush()
                held, rows, nth = [], 0, nth + 1
        if rows:
            yield from flush()

    return run


def _merge(n: int, n_group: int, order: list[By], out: pa.Schema, fan_in: int, last: bool, block_rows: int, batch: int = 20_000):
    """The blocks of each (bucket, run // fan_in) come together, sorted by run and place in it; yield the first n rows of the
    bucket's groups, with ranks on the last level, else as blocks of a longer run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [f for f in out if f.name != "rank_no"]

        def data(rows: list[tuple]) -> list[pa.Array]:
            return [pa.array([r[1][i] for r in rows], f.type) for i, f in enumerate(cols)]

        def emit(key: tuple, rows: list[tuple], nth: int) -> pa.RecordBatch:
            if last:
                return pa.RecordBatch.from_arrays([*data(rows), pa.array([r[0] for r in rows], pa.int32())], schema=out)
            body = pa.Table.from_arrays(data(rows), schema=pa.schema(cols))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([nth], pa.int32()), pa.array([_packed(body)], pa.binary())], schema=BLOCK_SCHEMA)

        def merged(key: tuple, blocks: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
            held, nth = [], 0
            for x in merge_runs([Run(_parts(b), n_group) for b in blocks.values()], order, n):
                held.append(x)
                if len(held) >= (batch if last else block_rows):
                    yield emit(key, held, nth)
                    held, nth = [], nth + 1
            if held:
                yield emit(key, held, nth)

        now, blocks = None, {}
        for b in batches:
            for bucket, run_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                key = (bucket, run_id // fan_in)
                if key != now and blocks:
                    yield from merged(now, blocks)
                    blocks = {}
                now = key
                blocks.setdefault(run_id, []).append(raw)
        if blocks:
            yield from merged(now, blocks)

    return run


def top_n_per_group(df: DataFrame, groups: list[str], order: list[By], n: int, keep: list[str] | None = None, buckets: int | None = None, block_rows: int = 200_000, fan_in: int = FAN_IN) -> DataFrame:
    """groups, order columns and `keep`, with rank_no 1..n within each group."""
    order = [b for b in order if b.column not in groups]  # constant within a group
    carried = [*groups, *[b.column for b in order]]
    carried += [c for c in keep or [] if c not in carried]
    if "rank_no" in carried:
        raise ValueError("rank_no is a column of the result")
    spark = df.sparkSession
    buckets = buckets or 4 * width(spark)
    src = df.select(*[F.col(f"`{c}`") for c in carried])
    bucket = F.pmod(F.xxhash64(*groups), F.lit(buckets)).cast("int")
    sorted_ = src.select(bucket.alias("bucket_"), *carried).sortWithinPartitions("bucket_", *[F.col(g).asc_nulls_last() for g in groups], *[b.spark() for b in order])
    blocks = stage(sorted_.mapInArrow(_cut(n, len(groups), block_rows), BLOCKS), "runs")
    runs = (blocks.agg(F.max("run")).first()[0] or 0) + 1
    out = T.StructType([*src.schema.fields, T.StructField("rank_no", T.IntegerType())])
    shape = to_arrow_schema(out)
    while True:
        last = runs <= fan_in
        group = (F.col("run") / fan_in).cast("int")
        together = blocks.withColumn("to", group).repartition(min(buckets, 2 * width(spark)), "bucket", "to").sortWithinPartitions("bucket", "to", "run", "nth").select("bucket", "run", "block")
        if last:
            return together.mapInArrow(_merge(n, len(groups), order, shape, fan_in, True, block_rows), out)
        blocks = stage(together.mapInArrow(_merge(n, len(groups), order, shape, fan_in, False, block_rows), BLOCKS), "runs")
        runs = -(-runs // fan_in)
