"""Structured Streaming forms: windows with late data, sessions, de-duplication, compaction and live orphan state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinolith.operators.orphans import OrphanStore
from kinolith.session import own_dir


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet table of the data folder as a stream; its schema is read from the files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a table may be one file or a folder of files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parquet*")


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """The time column with a zone, as watermarks need it."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed(df: DataFrame, ts: str, by: list[str], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling or sliding window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = event_time(df, ts, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def sessions(df: DataFrame, ts: str, by: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """Point hits merged while the next comes within the gap."""
    g = event_time(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    return g.select(*by, "first_at", "last_at", "n")


def distinct_within(df: DataFrame, ts: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first of rows that repeat within the watermark's delay; state is dropped behind it."""
    return event_time(df, ts, delay).dropDuplicatesWithinWatermark(keys)


def keep_spaced(df: DataFrame, key: str, at: str, least: int) -> DataFrame:
    """Stateful fold: a row of a key stays if it lies at least `least` after the last one that stayed; rows of a batch in order."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(at)
        out = []
        for x in rows[at].tolist():
            if last is None or x - last >= least:
                out.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), at: out})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(at).cast("long").alias(at)).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} long", "last long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there (availableNow) into a table of the shared folder and return the table."""
    spark = df.sparkSession
    root = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/out").start()
    else:
        query = writer.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{root}/out")).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def follow(store: OrphanStore, stream: DataFrame, kind: str, name: str | None = None):
    """A stream kept in an orphan store: `refs`, `parents` (births and deletions) or `withdrawn` references. One stream for each
    may run at once. Every batch is one delta with its snapshot; a batch that is tried again changes nothing."""
    if kind not in ("refs", "parents", "withdrawn"):
        raise ValueError(f"unknown kind: {kind}")

    def advance(batch: DataFrame, number: int) -> None:
        store.advance(**{kind: batch}, batch=f"{name or kind}-{number}")

    return stream.writeStream.foreachBatch(advance)


def micro_batches(df: DataFrame, every: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream in micro-batches: what has come within the interval, as far as `maxFilesPerTrigger` lets in, goes to `handle` at once."""
    return df.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(handle).start()


def until(query, seconds: float) -> bool:
    """Wait for a stream, at most so long; one beyond its deadline is stopped. Whether it ended by itself."""
    done = query.awaitTermination(seconds)
    if not done:
        query.stop()
    return bool(done)
