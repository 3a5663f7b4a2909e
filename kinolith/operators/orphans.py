"""Problem 1: references to records that do not exist, kept as keyed pending-orphan state.

The store is a folder of versions that only grow. A version holds what one delta changed, each part in directories by the
bucket of the target key:

  parents   births and deletions of the delta, one row per parent
  refs      new references: `open` ones (orphans: they wait, came too early, or their parent went) apart from `settled` ones
  moves     references of earlier versions whose state the delta's parents changed, and those that were withdrawn
  counts    the snapshot after the delta: references per table, field, month and state

`advance` takes one delta. New references probe the parent index, arriving parents resolve what waits in `open`, deletions
reopen `settled` references; only the buckets of the delta's own keys are read, and nothing that is there is written again.
The new snapshot is the last one plus the changes. A version counts once its commit file is there, so a run that was
cut off leaves nothing behind, a store is opened again by its folder, and a batch that comes twice (`batch`) changes nothing.
After `compact_every` versions one more is written that holds the whole state, and the older ones are no longer read.

States of a reference: `ok`; `missing` (no parent yet: it waits); `late` (its parent came after it: resolved, still
reported); `deleted` (its parent went: open again). Defined results: a reference is its table, key, field and target; null
targets are no references; of a reference that comes several times the earliest time counts, in one delta as over several; a
null ref_at never makes a parent late; a null born_at means the parent was always there; of parents that come twice the
earliest birth and any deletion count; a withdrawn reference is no longer counted, and may come again; a revised one is
withdrawn under its old target and new under the other; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import json
import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.operators.skew import HOT_ROWS, hot_counts, salted_join
from kinolith.session import own_dir, stage

REF = ["ref_table", "ref_key", "ref_field", "parent_table", "target_key", "ref_at"]
PARENT = ["parent_table", "target_key", "born_at", "gone_at"]
KEY = ["parent_table", "target_key"]
WHO = ["ref_table", "ref_key", "ref_field", *KEY]
REF_DDL = "ref_table string, ref_key string, ref_field string, parent_table string, target_key string, ref_at timestamp, state string, v int"
MOVE_DDL = f"{REF_DDL}, was string"
PARENT_DDL = "parent_table string, target_key string, born_at timestamp, gone_at timestamp, v int"
STATES = ("missing", "deleted", "late")
COUNT_DDL = "ref_table string, ref_field string, period string, n_refs long, n_missing long, n_deleted long, n_late long"


def _index(parents: DataFrame) -> DataFrame:
    always = F.max(F.col("born_at").isNull())
    born = F.when(~always, F.min("born_at"))
    return parents.filter(F.col("target_key").isNotNull()).groupBy(*KEY).agg(born.alias("born_at"), F.max("gone_at").alias("gone_at"))


def _state() -> Column:
    """The state of a reference joined to its parent's row."""
    return (
        F.when(F.col("found_").isNull(), "missing")
        .when(F.col("gone_at").isNotNull(), "deleted")
        .when(F.col("born_at") > F.col("ref_at"), "late")
        .otherwise("ok")
    )


def _meet(refs: DataFrame, index: DataFrame, hot: DataFrame) -> DataFrame:
    """References with the row of their parent, if the index has one."""
    return salted_join(refs, index.withColumn("found_", F.lit(True)), KEY, "left", hot, F.xxhash64("ref_key", "ref_field"))


class OrphanStore:
    """Pending-orphan state in a folder; an existing one is opened. One writer at a time (threads of one driver take turns)."""

    def __init__(self, spark: SparkSession, root: str | None = None, hot_rows: int = HOT_ROWS, buckets: int | None = None, compact_every: int = 16):
        self.spark, self.hot_rows, self.compact_every = spark, hot_rows, compact_every
        self.root = (root or f"{own_dir(spark)}/orphans-{uuid.uuid4().hex}").rstrip("/")
        self.lock = threading.RLock()
        self.commits = self._load()
        # as many buckets as an exchange has partitions: with the same hash a task writes few of them
        self.buckets = self.commits[0]["buckets"] if self.commits else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # files

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _load(self) -> list[dict]:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/_commits")):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/_commits")))
        lines = [self.spark.read.text(f"{self.root}/_commits/{n}", wholetext=True).first().value for n in names if n.endswith(".json")]
        return [json.loads(x) for x in lines]

    def _commit(self, entry: dict) -> None:
        fs, path = self._fs()
        out = fs.create(path(f"{self.root}/_commits/{entry['version']:08d}.json"), False)  # a version is committed once
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self.commits.append(entry)

    def _live(self) -> list[dict]:
        """The versions that are read: the last whole one and those after it."""
        base = max((i for i, c in enumerate(self.commits) if c["base"]), default=0)
        return self.commits[base:]

    def _read(self, part: str, ddl: str, buckets: list[int] | None = None, among: list[dict] | None = None) -> DataFrame:
        """A part of all versions; of the buckets asked for only."""
        frames = [self.spark.read.schema(f"{ddl}, b int").parquet(f"{self.root}/{c['path']}/{part}") for c in (self._live() if among is None else among) if part in c["parts"]]
        out = reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], f"{ddl}, b int")
        return out if buckets is None else out.filter(F.col("b").isin(buckets) if buckets else F.lit(False))

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*KEY), F.lit(self.buckets)).cast("int").alias("b")

    def _write(self, df: DataFrame, at: str, by: list[str]) -> bool:
        """Write a part; false if it has no rows."""
        df.write.partitionBy(*by).parquet(f"{self.root}/{at}")
        return bool(self._held(at))

    def _held(self, at: str) -> list[str]:
        fs, path = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/{at}")) if "=" in s.getPath().getName()]

    def _buckets_of(self, df: DataFrame) -> list[int]:
        return df.agg(F.collect_set(self._bucket())).first()[0]

    # state

    def batches(self) -> set[str]:
        return {c["batch"] for c in self.commits if c["batch"] is not None}

    def _open(self, buckets: list[int] | None = None) -> DataFrame:
        """References that are or were open, with their present state (also ok, and gone for a withdrawn one)."""
        rows = self._read("refs/kind=open", REF_DDL, buckets).unionByName(self._read("moves", MOVE_DDL, buckets).drop("was"))
        if not any("moves" in c["parts"] for c in self._live()):
            return rows.select(*REF, "state")
        last = rows.groupBy(*WHO).agg(F.max_by(F.struct("ref_at", "state"), "v").alias("x"))
        return last.select(*WHO, "x.ref_at", "x.state")

    def _settled(self, buckets: list[int] | None = None) -> DataFrame:
        """References that were ok when they came, but for those that have moved since (these are in `_open`)."""
        rows = self._read("refs/kind=settled", REF_DDL, buckets)
        if any("moves" in c["parts"] for c in self._live()):
            moved = self._read("moves", MOVE_DDL, buckets).groupBy(*WHO).agg(F.max("v").alias("moved_"))
            rows = rows.join(moved, WHO, "left").filter("moved_ is null or moved_ < v")
        return rows.select(*REF, "state")

    @property
    def refs(self) -> DataFrame:
        """Every reference with its state."""
        return self._settled().unionByName(self._open().filter("state <> 'gone'"))

    def orphans(self) -> DataFrame:
        """Every reference that is or was without its parent, with its state."""
        return self._open().filter("state not in ('ok', 'gone')")

    def snapshot(self, version: int | None = None) -> DataFrame:
        """Counts per table, field, month of the reference and state, after the given version (the last)."""
        held = [c for c in self.commits if version is None or c["version"] == version]
        return self.spark.read.schema(COUNT_DDL).parquet(f"{self.root}/{held[-1]['path']}/counts") if held else self.spark.createDataFrame([], COUNT_DDL)

    def snapshots(self) -> DataFrame:
        """All snapshots, with their version and batch."""
        frames = [self.snapshot(c["version"]).withColumns({"version": F.lit(c["version"]), "batch": F.lit(c["batch"])}) for c in self.commits]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], f"{COUNT_DDL}, version int, batch string")

    # deltas

    def advance(self, refs: DataFrame | None = None, parents: DataFrame | None = None, hot: DataFrame | None = None, batch: str | None = None, withdrawn: DataFrame | None = None) -> "OrphanStore":
        """Take in one delta: new references, parent events (births and deletions) and withdrawn references (columns WHO).

        hot: keys to salt and their salts, if the caller has counted them. batch: a name that is taken in once."""
        with self.lock:
            if batch is not None and batch in self.batches():
                return self
            v = len(self.commits) + 1
            path, first, parts, changes = f"v{v:08d}-{uuid.uuid4().hex[:8]}", not self.commits, [], []
            entry = {"version": v, "batch": batch, "path": path, "base": first, "parts": parts, "buckets": self.buckets}
            moves = []
            if withdrawn is not None and not first:
                moves.append(self._withdrawn(withdrawn))
            if parents is not None:
                rows = _index(parents.select(*PARENT)).withColumn("v", F.lit(v)).withColumn("b", self._bucket())
                if self._write(rows, f"{path}/parents", ["b"]):
                    parts.append("parents")
                    if not first:
                        moves.append(self._moved(entry, [int(n[2:]) for n in self._held(f"{path}/parents")], hot))
            if moves:
                rows = reduce(DataFrame.unionByName, moves)
                if len(moves) > 1:  # a reference that is withdrawn does not move otherwise
                    rows = rows.groupBy(*WHO).agg(F.max_by(F.struct("ref_at", "state", "was"), F.col("state") == "gone").alias("x")).select(*WHO, "x.*")
                if self._write(rows.withColumn("v", F.lit(v)).withColumn("b", self._bucket()), f"{path}/moves", ["b"]):
                    parts.append("moves")
                    moved = self._read("moves", MOVE_DDL, None, [entry])
                    changes += [moved.select(*REF, "state", F.lit(1).alias("n")), moved.select(*REF, F.col("was").alias("state"), F.lit(-1).alias("n"))]
            if refs is not None:
                new = refs.select(*REF).filter(F.col("target_key").isNotNull()).groupBy(*WHO).agg(F.min("ref_at").alias("ref_at"))
                touched = None if first else self._buckets_of(refs.filter(F.col("target_key").isNotNull()))
                if not first:
                    known = self._read("refs/kind=open", REF_DDL, touched).unionByName(self._read("refs/kind=settled", REF_DDL, touched)).select(*WHO)
                    gone = self._open(touched).filter("state = 'gone'").select(*WHO) if any("moves" in c["parts"] for c in self._live()) else None
                    new = new.join(known if gone is None else known.join(gone, WHO, "left_anti"), WHO, "left_anti")
                index = self._read("parents", PARENT_DDL, touched, [*(self._live() if not first else []), entry])
                index = _index(index) if not first else index.select(*PARENT)
                hot = hot if hot is not None else hot_counts(refs.select(*KEY), KEY, self.hot_rows)
                rows = _meet(new, index, hot).select(*REF, _state().alias("state")).withColumn("v", F.lit(v)).withColumn("b", self._bucket())
                rows = rows.withColumn("kind", F.when(F.col("state") == "ok", "settled").otherwise("open"))
                self._write(rows, f"{path}/refs", ["kind", "b"])
                kinds = [f"refs/{k}" for k in self._held(f"{path}/refs")]
                parts += kinds
                changes += [self._read(k, REF_DDL, None, [entry]).select(*REF, "state", F.lit(1).alias("n")) for k in kinds]
            self._count(changes).write.parquet(f"{self.root}/{path}/counts")
            self._commit(entry)
            if len(self._live()) > self.compact_every:
                self.compact()
            return self

    def _moved(self, entry: dict, touched: list[int], hot: DataFrame | None) -> DataFrame:
        """Earlier references whose state the parents of this version change; only the buckets of these parents are read."""
        changed = self._read("parents", PARENT_DDL, None, [entry])
        index = _index(self._read("parents", PARENT_DDL, touched, [*self._live(), entry]).join(changed.select(*KEY), KEY, "left_semi"))
        went = changed.filter("gone_at is not null")
        waiting = self._open(touched).filter("state <> 'gone'").join(changed.select(*KEY), KEY, "left_semi")
        settled = self._settled(touched).join(went.select(*KEY), KEY, "left_semi")  # a birth changes nothing that is settled
        old = waiting.unionByName(settled).withColumnRenamed("state", "was")
        hot = hot if hot is not None else hot_counts(old, KEY, self.hot_rows)
        return _meet(old, index, hot).select(*REF, _state().alias("state"), "was").filter("state <> was")

    def _withdrawn(self, rows: DataFrame) -> DataFrame:
        asked = rows.select(*WHO).filter(F.col("target_key").isNotNull()).distinct()
        touched = self._buckets_of(asked)
        now = self._settled(touched).unionByName(self._open(touched).filter("state <> 'gone'"))
        return now.join(asked, WHO, "left_semi").select(*REF, F.lit("gone").alias("state"), F.col("state").alias("was"))

    def _count(self, changes: list[DataFrame]) -> DataFrame:
        """The last snapshot plus the changes (a row per table, field and month)."""
        empty = self.spark.createDataFrame([], COUNT_DDL)
        last = self.snapshot() if self.commits else empty
        n = {s: F.sum(F.when(F.col("state") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in STATES}
        by = ["ref_table", "ref_field", F.date_format("ref_at", "yyyy-MM").alias("period")]
        new = [c.groupBy(*by).agg(F.sum(F.when(F.col("state") != "gone", F.col("n")).otherwise(0)).alias("n_refs"), *n.values()) for c in changes]
        names = ["n_refs", *[f"n_{s}" for s in STATES]]
        out = reduce(DataFrame.unionByName, [last, *new]).groupBy("ref_table", "ref_field", "period").agg(*[F.sum(c).alias(c) for c in names])
        return out.filter("n_refs > 0").coalesce(1)

    def compact(self) -> "OrphanStore":
        """Write the whole state as one version; the older ones are no longer read."""
        with self.lock:
            v = len(self.commits) + 1
            path, parts = f"v{v:08d}-{uuid.uuid4().hex[:8]}", []
            parents = _index(self._read("parents", PARENT_DDL)).withColumn("v", F.lit(v)).withColumn("b", self._bucket())
            if self._write(parents, f"{path}/parents", ["b"]):
                parts.append("parents")
            kind = F.when(F.col("state") == "ok", "settled").otherwise("open").alias("kind")
            rows = self.refs.select(*REF, "state", F.lit(v).alias("v"), kind, self._bucket())
            self._write(rows.repartition(*KEY), f"{path}/refs", ["kind", "b"])
            parts += [f"refs/{k}" for k in self._held(f"{path}/refs")]
            self.snapshot().coalesce(1).write.parquet(f"{self.root}/{path}/counts")
            self._commit({"version": v, "batch": None, "path": path, "base": True, "parts": parts, "buckets": self.buckets})
            return self


def replay(spark: SparkSession, refs: DataFrame, parents: DataFrame, epochs: int = 2, hot_rows: int = HOT_ROWS) -> OrphanStore:
    """Bring a whole history into a store in time order: each epoch is one delta, undated parents come with the first.

    A parent is handed over at its birth and again at its deletion, so references do wait, resolve and reopen."""
    refs = stage(refs.select(*REF), "history")
    lo, hi = refs.agg(F.min(F.unix_micros("ref_at")), F.max(F.unix_micros("ref_at"))).first()
    store = OrphanStore(spark, hot_rows=hot_rows)
    if epochs <= 1 or lo is None:
        return store.advance(refs, parents)
    hot = hot_counts(refs, KEY, hot_rows)

    def epoch(at):
        pos = F.floor((F.unix_micros(at) - F.lit(lo)) * epochs / F.lit(hi - lo + 1))
        return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(epochs - 1), pos)), F.lit(0))

    still = parents.filter("born_at is null and gone_at is null")  # known from the start; never part of a later delta
    timed = parents.filter("born_at is not null or gone_at is not null")
    births = timed.select("parent_table", "target_key", "born_at", F.lit(None).cast("timestamp").alias("gone_at"), epoch(F.col("born_at")).alias("epoch_"))
    deaths = timed.filter(F.col("gone_at").isNotNull()).select("parent_table", "target_key", "born_at", "gone_at", epoch(F.col("gone_at")).alias("epoch_"))
    dated = refs.withColumn("epoch_", epoch(F.col("ref_at")))
    events = births.unionByName(deaths)
    for e in range(epochs):
        delta = events.filter(F.col("epoch_") == e).select(*PARENT)
        store.advance(dated.filter(F.col("epoch_") == e), delta if e else delta.unionByName(still.select(*PARENT)), hot, f"epoch-{e}")
    return store
