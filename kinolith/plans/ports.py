"""Ports: what a user plugs in. Models run inside tasks, once loaded per worker; without one a port is unavailable, not an error."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolith.plans.planner import Plan, fingerprint


class Branch(Protocol):
    """A retrieval branch: candidates (video_id, original_frame_id, start_ms, end_ms, rank, raw_score, evidence_id) for a text."""

    name: str

    def search(self, text: str, plan: Plan) -> DataFrame: ...


@dataclass(frozen=True)
class UnavailableBranch:
    """A branch whose index is not there."""

    name: str
    available: bool = False


def searches(branches: list, plan: Plan, text_for: Callable[[str], str]) -> dict[str, Callable | None]:
    """What `planner.run_branches` takes: a call per branch of the plan, None for one that is unavailable or not registered."""
    of = {b.name: b for b in branches}
    return {n: (lambda b=of[n], n=n: b.search(text_for(n), plan)) if n in of and getattr(of[n], "available", True) else None for n in plan.branches}


class Registry:
    """Executors by task."""

    def __init__(self):
        self.held: dict[str, Callable] = {}

    def register(self, task: str, execute: Callable) -> None:
        if task in self.held:
            raise ValueError(f"{task} is registered already")
        self.held[task] = execute

    def resolve(self, task: str) -> Callable:
        if task not in self.held:
            raise KeyError(f"no executor for {task}; known: {', '.join(self.names())}")
        return self.held[task]

    def names(self) -> list[str]:
        return sorted(self.held)


@dataclass(frozen=True)
class Node:
    """A stage of a pipeline: its needs, what it runs, and what its outcome depends on."""

    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()
    depends: tuple = ()

    def fingerprint(self, context: dict) -> str:
        return fingerprint([self.name, {k: context.get(k) for k in self.depends}])


def run_nodes(nodes: list[Node], context: dict, targets: list[str], checkpoint: dict[str, str] | None = None) -> dict[str, str]:
    """Run nodes in order of their needs; finished ones with an equal fingerprint are skipped."""
    from kinolith.plans.planner import run_stages

    of = {n.name: n for n in nodes}
    return run_stages({n: list(x.needs) for n, x in of.items()}, {n: (lambda x=x: x.run(context)) for n, x in of.items()}, targets, prints={n: x.fingerprint(context) for n, x in of.items()}, checkpoint=checkpoint)


def hash_embedder(dim: int = 64) -> Callable[[], Callable[[list], np.ndarray]]:
    """A loader of a deterministic stand-in for an embedding model: unit vectors from the digest of each item (text or bytes)."""

    def load() -> Callable[[list], np.ndarray]:
        def embed(items: list) -> np.ndarray:
            out = np.zeros((len(items), dim), np.float32)
            for i, x in enumerate(items):
                raw = x.encode() if isinstance(x, str) else bytes(x)
                seed = int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")
                v = np.random.default_rng(seed).standard_normal(dim)
                out[i] = v / np.linalg.norm(v)
            return out

        return embed

    return load


def embedded(column: str | Column, loader: Callable[[], Callable[[list], np.ndarray]]) -> Column:
    """Vectors of a text or image column by a model that each worker loads once; null in, null out."""
    held: list = []

    @F.arrow_udf("array<float>")
    def run(x: pa.Array) -> pa.Array:
        if not held:
            held.append(loader())
        items = x.to_pylist()
        known = [i for i, v in enumerate(items) if v is not None]
        out: list = [None] * len(items)
        for i, v in zip(known, held[0]([items[i] for i in known]) if known else []):
            out[i] = v.tolist()
        return pa.array(out, pa.list_(pa.float32()))

    return run(F.col(column) if isinstance(column, str) else column)


def asked(prompts: DataFrame, column: str, loader: Callable[[], Callable[[str], str]] | None, answer: str = "answer") -> DataFrame:
    """Prompts with a model's answer and its status: answered, failed or, without a model, unavailable. A failure stays with its row."""
    if loader is None:
        return prompts.withColumn(answer, F.lit(None).cast("string")).withColumn("status", F.lit("unavailable"))
    schema = prompts.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{answer}` string, status string"
    at = prompts.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loader()
        for b in batches:
            said, status = [], []
            for x in b.column(at).to_pylist():
                try:
                    said.append(model(x))
                    status.append("answered")
                except Exception:  # one prompt must not end the others
                    said.append(None)
                    status.append("failed")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(status, pa.string())], [*b.schema.names, answer, "status"])

    return prompts.mapInArrow(run, ddl)


def bounded(df: DataFrame, workers: int, most: int = 8) -> DataFrame:
    """Rows dealt to at most so many tasks, so that a service behind `asked` sees no more callers; the order is a column of the rows."""
    if not 1 <= workers <= most:
        raise ValueError(f"1 to {most} workers")
    return df.repartition(workers)


def answered_from_evidence(prompts: DataFrame, vision: Callable | None, language: Callable | None) -> DataFrame:
    """The vision model first; where it does not answer, the language model over the evidence text; else abstained. prompts: image_prompt, text_prompt."""
    first = asked(prompts, "image_prompt", vision, "seen").withColumnRenamed("status", "seen_status")
    second = asked(first, "text_prompt", language, "read").withColumnRenamed("status", "read_status")
    bare = lambda c: F.nullif(F.trim(c), F.lit(""))
    answer, how = F.coalesce(bare("seen"), bare("read")), F.when(bare("seen").isNotNull(), "vision").when(bare("read").isNotNull(), "language").otherwise("abstained")
    return second.withColumn("answer", answer).withColumn("how", how).drop("seen", "seen_status", "read", "read_status")


def rewritten(queries: DataFrame, column: str, model: Callable | None, keep: Callable[[str, str], bool]) -> DataFrame:
    """Queries with a model's rewrite where there is one that `keep(original, rewrite)` accepts, else the query itself; `rewrite_used` tells."""
    ok = F.udf(lambda a, b: bool(b and b.strip() and keep(a, b)), "boolean")
    x = asked(queries, column, model, "rewrite_")
    x = x.withColumn("rewrite_used", F.when(F.col("rewrite_").isNull(), F.lit(False)).otherwise(ok(F.col(column), F.col("rewrite_"))))
    return x.withColumn("rewrite", F.when(F.col("rewrite_used"), F.trim("rewrite_")).otherwise(F.col(column))).drop("rewrite_", "status")


def shot_scores(windows: DataFrame, pixels: str, loader: Callable[[], Callable[[list], list[float]]]) -> DataFrame:
    """video_id, original_frame_id, score: a shot model over the windows of `curation.inference_windows` joined to pixels; the kept
    places of each window count. A task holds one window at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        p = loader()(pdf[pixels].tolist())
        kept = pdf["kept"].to_numpy()
        return pd.DataFrame({"video_id": pdf["video_id"][kept], "original_frame_id": pdf["original_frame_id"][kept], "score": np.asarray(p, float)[kept]})

    return windows.groupBy("video_id", "window_id").applyInPandas(run, "video_id string, original_frame_id long, score double")


def recognised(files: DataFrame, column: str, loader: Callable[[], Callable[[object], list[dict]]], ddl: str) -> DataFrame:
    """What a recogniser (speech, text, objects, captions) finds in each row: the row's other columns and one row per finding."""
    fields = [x.strip().split(" ")[0].strip("`") for x in ddl.split(",")]
    at = files.columns.index(column)
    rest = [f for f in files.schema if f.name != column]
    names = [f.name for f in rest]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "findings string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        model = loader()
        for b in batches:
            found = [json.dumps([{k: r.get(k) for k in fields} for r in model(x)]) if x is not None else "[]" for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(n)) for n in names], pa.array(found, pa.string())], [*names, "findings"])

    rows = files.mapInArrow(run, out)
    return rows.select(*names, F.explode(F.from_json("findings", f"array<struct<{', '.join(f'{x.strip().split(' ')[0]}:{x.strip().split(' ')[1]}' for x in ddl.split(','))}>>")).alias("x")).select(*names, "x.*")
