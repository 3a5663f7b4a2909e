"""Sinks: files committed as a whole, idempotent tables, run snapshots and submission CSV."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinolith.functions.num import stable_id
from kinolith.functions.text import csv_cell, without_secrets
from kinolith.operators.mapping import insert_absent, next_revision, upsert


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write beside and swap: what was there stays until the new files are whole, and a failed write leaves it as it was.

    The swap is two renames; where readers must never miss the table between them, use `VersionedTable`."""
    spark = df.sparkSession
    path = path.rstrip("/")
    mark = uuid.uuid4().hex[:8]
    fresh, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    fs, p = _fs(spark, path)
    w = df.write.format(kind)
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        (w.option("header", True) if kind == "csv" else w).save(fresh)
    except Exception:
        fs.delete(p(fresh), True)
        raise
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(fresh), p(path))
    fs.delete(p(old), True)


class VersionedTable:
    """A table of immutable versions, cut into buckets of its keys; `current` is the last committed one. One writer at a time.

    A version is a list of bucket folders. An upsert reads and writes the buckets of its own keys only, all others are the
    folders of the version before. A version counts once its list is there, so readers see one version or the next."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def versions(self) -> list[dict]:
        """The lists of all versions, oldest first."""
        fs, p = _fs(self.spark, self.root)
        at = p(f"{self.root}/_versions")
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        return [json.loads(self.spark.read.text(f"{self.root}/_versions/{n}", wholetext=True).first().value) for n in names]

    def _last(self) -> dict | None:
        fs, p = _fs(self.spark, self.root)
        at = p(f"{self.root}/_versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []
        return json.loads(self.spark.read.text(f"{self.root}/_versions/{names[-1]}", wholetext=True).first().value) if names else None

    def _read(self, held: dict, buckets: list[int] | None = None) -> DataFrame:
        at = [f"{self.root}/{d}" for b, d in held["parts"].items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame | None:
        held = self._last()
        return self._read(held) if held else None

    def _bucket(self, keys: list[str], n: int):
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(n)).cast("int")

    def _commit(self, rows: DataFrame, keys: list[str], held: dict | None, touched: list[int] | None) -> DataFrame:
        """Write rows as the buckets `touched` (all, if None) of the next version."""
        n = held["buckets"] if held else self.buckets
        name = f"d-{uuid.uuid4().hex[:12]}"
        rows.withColumn("b_", self._bucket(keys, n)).repartition("b_").write.partitionBy("b_").parquet(f"{self.root}/{name}")
        fs, p = _fs(self.spark, self.root)
        fresh = {s.getPath().getName()[3:]: f"{name}/{s.getPath().getName()}" for s in fs.listStatus(p(f"{self.root}/{name}")) if s.getPath().getName().startswith("b_=")}
        kept = {b: d for b, d in held["parts"].items() if int(b) not in touched} if held and touched is not None else {}
        entry = {"version": held["version"] + 1 if held else 1, "keys": keys, "buckets": n, "parts": kept | fresh, "schema": json.loads(rows.schema.json())}
        out = fs.create(p(f"{self.root}/_versions/{entry['version']:08d}.json"), False)  # another writer's version is not replaced
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return self._read(entry)

    def _change(self, source: DataFrame, keys: list[str], change: Callable[[DataFrame, DataFrame], DataFrame], first: DataFrame) -> DataFrame:
        held = self._last()
        if held is None:
            return self._commit(first, keys, None, None)
        if held["keys"] != keys:  # other keys lie in other buckets
            return self._commit(change(self._read(held), source), keys, held, None)
        touched = sorted(r.b for r in source.select(self._bucket(keys, held["buckets"]).alias("b")).distinct().collect())  # at most the buckets
        return self._commit(change(self._read(held, touched), source), keys, held, touched)

    def upsert(self, source: DataFrame, keys: list[str]) -> DataFrame:
        """Insert or replace by key; the same source twice gives the same table."""
        return self._change(source, keys, lambda old, new: upsert(old, new, keys), source)

    def insert_absent(self, source: DataFrame, keys: list[str]) -> DataFrame:
        return self._change(source, keys, lambda old, new: insert_absent(old, new, keys), source)

    def append_revision(self, source: DataFrame, group: list[str]) -> DataFrame:
        """Append rows under the next revision of their group."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            numbered = new.join(next_revision(old, group), group, "left").withColumn("revision", F.coalesce("next_revision", F.lit(1)).cast(old.schema["revision"].dataType)).drop("next_revision")
            return old.unionByName(numbered)

        return self._change(source, group, change, source.withColumn("revision", F.lit(1)))


def run_snapshot(candidates: DataFrame, array: str) -> DataFrame:
    """A run's candidates in their order: rank is the place in the array."""
    rest = [c for c in candidates.columns if c != array]
    return candidates.select(*rest, F.posexplode(array).alias("pos", "x")).select(*rest, (F.col("pos") + 1).alias("rank"), "x.*")


def submission_csv(df: DataFrame, columns: list[str]) -> DataFrame:
    """One `line` per row, cells guarded against formulas."""
    return df.select(F.concat_ws(",", *[csv_cell(c) for c in columns]).alias("line"))


def failure_log(df: DataFrame, source: str, error: str) -> DataFrame:
    """Source and error without secrets."""
    return df.select(without_secrets(source).alias("source"), without_secrets(error).alias("error"))


def content_key(content: str | Column) -> Column:
    """Address of an artifact by its content."""
    d = F.sha2(F.col(content) if isinstance(content, str) else content, 256)
    return F.concat(F.lit("sha256/"), d.substr(1, 2), F.lit("/"), d)


def ledger_row(df: DataFrame, run_id: str, checksum: list[str]) -> DataFrame:
    """One row for the ingestion ledger: rows and an order-free checksum of the key columns."""
    return df.agg(F.lit(run_id).alias("run_id"), F.count("*").alias("n_rows"), F.sum(F.xxhash64(*checksum).cast("decimal(38,0)")).cast("string").alias("checksum"))


LEDGER_KEY = ["source_uri", "source_checksum", "target_table"]


def ledger_rows(loads: DataFrame) -> DataFrame:
    """Rows of the ingestion ledger, one per source, its checksum and target (upsert by LEDGER_KEY).

    loads: LEDGER_KEY, n_seen, n_inserted, n_updated, n_failed; what is neither inserted, updated nor failed was skipped."""
    done = F.col("n_inserted") + F.col("n_updated") + F.col("n_failed")
    status = F.when(F.col("n_failed") == 0, "completed").when(F.col("n_failed") == F.col("n_seen"), "failed").otherwise("partial")
    return loads.select(stable_id("ingestion", "source_uri", "target_table").alias("ingestion_id"), *LEDGER_KEY, "n_seen", "n_inserted", "n_updated", (F.col("n_seen") - done).alias("n_skipped"), "n_failed", status.alias("status"))


def merge_counters(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """n_seen, n_inserted, n_updated and n_failed (null keys) of an upsert before it is made; unchanged rows are neither."""
    rest = [c for c in source.columns if c not in keys]
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    old = target.select(*keys, F.struct(*rest).alias("old_"), F.lit(True).alias("there_"))
    j = source.withColumn("new_", F.struct(*rest)).join(old, keys, "left")
    return j.agg(
        F.count("*").alias("n_seen"), F.count_if(~null & F.col("there_").isNull()).alias("n_inserted"), F.count_if(~null & F.col("there_").isNotNull() & ~F.col("old_").eqNullSafe(F.col("new_"))).alias("n_updated"), F.count_if(null).alias("n_failed")
    )


def markdown_table(df: DataFrame) -> DataFrame:
    """Report lines of a small result: a header, a rule, and a row each."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, "|" + "---|" * len(df.columns))], "n int, line string")
    return head.unionByName(df.select(F.lit(2).alias("n"), cells.alias("line")))
