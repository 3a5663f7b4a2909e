"""Selections whose next step depends on what was kept: compaction, greedy de-duplication, repair, medoids, alignment.

The pure functions hold the rules; the DataFrame forms run them per group. A fold with constant state streams over a
sorted partition; those over vectors compare all pairs of a group in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolith.operators.skew import numbered, scan_entity
from kinolith.session import stage, width


def compact(hashes: list[int], sharpness: list[float], most: int = 5) -> list[int]:
    """Kept positions: an item nearer than `most` bits to the last kept one is dropped, or replaces it if strictly sharper."""
    kept: list[int] = []
    for i, h in enumerate(hashes):
        if kept and ((hashes[kept[-1]] ^ h) & (2**64 - 1)).bit_count() < most:
            if sharpness[i] > sharpness[kept[-1]]:
                kept[-1] = i
        else:
            kept.append(i)
    return kept


def greedy_distinct(vectors: np.ndarray, order: list[int], threshold: float, inclusive: bool) -> list[int]:
    """Positions kept in the order: one too similar to any kept (>= if inclusive, else >) is dropped."""
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    kept: list[int] = []
    for i in order:
        s = v[kept] @ v[i] if kept else np.zeros(0)
        if not ((s >= threshold) if inclusive else (s > threshold)).any():
            kept.append(i)
    return kept


def repair_coverage(candidates: list[tuple[float, float, bool]], kept: list[float], span: tuple[float, float], most: float) -> list[float]:
    """Times added until no gap exceeds `most` or nothing fits: the widest gap first takes its best (quality, blur) candidate."""
    added: list[float] = []
    if most <= 0:
        return added
    hopeless: set[tuple[float, float]] = set()
    while True:
        points = sorted([span[0], *kept, *added, span[1]])
        gaps = [(b - a, a, b) for a, b in zip(points, points[1:]) if b - a > most + 1e-6 and (a, b) not in hopeless]
        if not gaps:
            return added
        _, a, b = max(gaps, key=lambda g: (g[0], -g[1]))
        inside = [c for c in candidates if a < c[0] < b]
        if not inside:
            hopeless.add((a, b))
        else:
            added.append(max(inside, key=lambda c: (c[2], c[1], -c[0]))[0])


def medoids(vectors: np.ndarray, times: list[float], threshold: float) -> list[int]:
    """One position per connected component of cosine >= threshold: most similar on average, then earliest, in time order."""
    if not len(vectors):
        return []
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = v @ v.T
    n, label = len(v), list(range(len(v)))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(s >= threshold, 1))):
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    out = []
    for r in {root(i) for i in range(n)}:
        members = [i for i in range(n) if root(i) == r]
        mean = s[np.ix_(members, members)].mean(axis=1)
        ties = [m for m, x in zip(members, mean) if np.isclose(x, mean.max(), rtol=1e-10, atol=1e-12)]
        out.append(min(ties, key=lambda m: (times[m], m)))
    return sorted(out, key=lambda m: (times[m], m))


#: How plausible a step is, by its milliseconds: (less than, weight), then the weight beyond all.
STEPS = [(400, 0.5), (1_000, 1.0), (120_001, 1.2), (900_001, 1.0)]
FAR = 0.8


def step_weights(ms: np.ndarray) -> np.ndarray:
    """How plausible steps between two events of a sequence are."""
    return np.select([ms < most for most, _ in STEPS], [w for _, w in STEPS], FAR)


def align(frames: list[int], times: list[float], scores: list[list[float]]) -> tuple[float, list[int]] | None:
    """Best path of one frame per variant with rising frames: (score, positions), or None. Rows come sorted by frame."""
    f, t = np.array(frames), np.array(times, float)
    s = np.array(scores, float) if len(scores) else np.zeros((0, 0))
    if not len(f) or not s.shape[1]:
        return None
    before = np.searchsorted(f, f, "left")  # the rows with a smaller frame come first
    best, backs = np.where(s[:, 0] > 0, s[:, 0], 0.0), []
    for v in range(1, s.shape[1]):
        now, back = np.zeros(len(f)), np.full(len(f), -1)
        for i in np.flatnonzero(s[:, v] > 0):
            p = best[: before[i]]
            if not (p > 0).any():
                continue
            ms = np.maximum(1.0, t[i] - t[: before[i]])
            x = np.where(p > 0, p + s[i, v] * step_weights(ms), -1.0)
            back[i] = int(x.argmax())  # the first of equals
            now[i] = x[back[i]]
        best = now
        backs.append(back)
    if not best.max() > 0:
        return None
    path = [int(best.argmax())]
    for back in backs[::-1]:
        path.append(int(back[path[-1]]))
    return float(best.max()), path[::-1]


def compact_frames(df: DataFrame, entity: str, at: str, hash_: str, sharpness: str, most: int = 5) -> DataFrame:
    """Rows kept by `compact` in order of `at`; the state is one row, so any length of sequence streams through a task."""
    names = df.columns
    cols = {c: names.index(c) for c in (entity, hash_, sharpness)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        state: tuple | None = None
        for b in batches:
            ent, h, sharp = (b.column(cols[c]).to_pylist() for c in (entity, hash_, sharpness))
            take = []
            for i in range(b.num_rows):
                if state is not None and state[0] == ent[i] and h[i] is not None and state[1] is not None and ((state[1] ^ h[i]) & (2**64 - 1)).bit_count() < most:
                    if (sharp[i] or 0.0) > (state[2] or 0.0):
                        state = (ent[i], h[i], sharp[i])
                        if held is None and take:
                            take[-1] = i
                        else:
                            held = b.slice(i, 1)
                    continue
                if held is not None:
                    yield held
                    held = None
                state = (ent[i], h[i], sharp[i])
                take.append(i)
            if take:
                if len(take) > 1:
                    yield b.take(pa.array(take[:-1]))
                held = b.slice(take[-1], 1)
        if held is not None:
            yield held

    one = df.repartition(width(df.sparkSession), entity).sortWithinPartitions(entity, at)
    return one.mapInArrow(run, df.schema)


def placed(df: DataFrame, group: list[str], vector: str, at: str, key: str) -> DataFrame:
    """Adds grp_ (the group as one string), pos_ (place in the group by (at with null last, key, vector), from 0) and size_; staged.

    The rows are numbered over ranges of (group, order), so no task sorts a whole group."""
    n = numbered(df.withColumn("grp_", F.to_json(F.struct(*group))), [F.col("grp_"), F.col(at).asc_nulls_last(), F.col(key).asc_nulls_last(), F.col(vector)], "n_")
    first = n.groupBy("grp_").agg(F.min("n_").alias("first_"), F.count("*").alias("size_"))
    return stage(n.join(first, "grp_").withColumn("pos_", (F.col("n_") - F.col("first_")).cast("long")).drop("n_", "first_"), "placed")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric matrix of neighbours connects, at most one less than its rows."""
    free, edges = near.any(axis=1), []
    for first in np.flatnonzero(free):
        if not free[first]:
            continue
        free[first], todo = False, [int(first)]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & free)
            free[new] = False
            edges += [(i, j) for j in new.tolist()]
            todo += new.tolist()
    return edges


def similar_places(rows: DataFrame, vector: str, threshold: float, inclusive: bool, connect: bool, block: int) -> DataFrame:
    """grp_, pos_ and earlier: places of the group before pos_ whose cosine reaches the threshold; from `placed` rows.

    A group is cut into blocks of places and every pair of its blocks is a task of its own, so all pairs are compared and a
    long group spreads. A place has a row per pair of blocks. connect: only as many pairs as keep the components of the pair of blocks."""
    one = rows.filter("size_ > 1").select("grp_", "pos_", F.floor(F.col("pos_") / block).alias("blk_"), "size_", F.col(vector).alias("v_"))
    other = one.withColumn("other_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size_") - 1) / block))))
    tiles = other.select("grp_", F.least("blk_", "other_").alias("low_"), F.greatest("blk_", "other_").alias("high_"), "blk_", "pos_", "v_")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos_")
        pos, v = pdf["pos_"].to_numpy(), np.stack(pdf["v_"].to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        low, high = pdf["blk_"].to_numpy() == pdf["low_"].iloc[0], pdf["blk_"].to_numpy() == pdf["high_"].iloc[0]
        s = v[high] @ v[low].T
        near = ((s >= threshold) if inclusive else (s > threshold)) & (pos[high][:, None] > pos[low])
        later: list[int] = []
        earlier: list[np.ndarray] = []
        if connect and near.any():
            square = np.zeros((len(pos), len(pos)), bool)
            square[np.ix_(high, low)] = near
            for i, j in forest(square | square.T):
                later.append(pos[max(i, j)])
                earlier.append(pos[[min(i, j)]])
        elif near.any():
            for i in np.flatnonzero(near.any(axis=1)):
                later.append(pos[high][i])
                earlier.append(pos[low][near[i]])
        return pd.DataFrame({"grp_": pd.Series([pdf["grp_"].iloc[0]] * len(later), dtype=object), "pos_": pd.Series(later, dtype="int64"), "earlier": pd.Series(earlier, dtype=object)})

    return tiles.groupBy("grp_", "low_", "high_").applyInPandas(run, "grp_ string, pos_ long, earlier array<long>")


def distinct_vectors(df: DataFrame, group: list[str], vector: str, at: str, key: str, threshold: float, inclusive: bool = True, block: int = 2048) -> DataFrame:
    """Greedy de-duplication of each whole group in order of (at with null last, key); vectors of a group have one length.

    The fold streams over the similar pairs in order; its state is the group's dropped places."""
    rows = placed(df, group, vector, at, key)
    pairs = similar_places(rows, vector, threshold, inclusive, False, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dropped = None, set()
        for b in batches:
            out: list[tuple[str, int]] = []
            for g, p, earlier in zip(*(c.to_pylist() for c in b.columns)):
                if g != now:
                    now, dropped = g, set()
                if p not in dropped and not dropped.issuperset(earlier):
                    dropped.add(p)
                    out.append((g, p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out]), pa.array([p for _, p in out], pa.int64())], ["grp_", "pos_"])

    inorder = pairs.repartition(width(df.sparkSession), "grp_").sortWithinPartitions("grp_", "pos_")
    return rows.join(inorder.mapInArrow(run, "grp_ string, pos_ long"), ["grp_", "pos_"], "left_anti").select(*df.columns)


def medoid_vectors(df: DataFrame, group: list[str], vector: str, at: str, key: str, threshold: float, block: int = 2048) -> DataFrame:
    """The medoid of each similarity component of each whole group, null `at` last; vectors of a group have one length.

    The mean similarity of a member is its product with the sum of the members, so a component needs no matrix of pairs."""
    rows = placed(df, group, vector, at, key)
    edges = similar_places(rows, vector, threshold, True, True, block)

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        label: dict[int, int] = {}

        def root(i: int) -> int:
            while label.setdefault(i, i) != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        for p, earlier in zip(pdf["pos_"].tolist(), pdf["earlier"]):
            for e in earlier.tolist():
                a, b = root(p), root(e)
                label[max(a, b)] = min(a, b)
        return pd.DataFrame({"grp_": pdf["grp_"].iloc[0], "pos_": list(label), "of_": [root(i) for i in list(label)]})

    def others(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos_")
        v = np.stack(pdf["v_"].to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        mean = v @ v.sum(axis=0) / len(v)
        first = np.flatnonzero(np.isclose(mean, mean.max(), rtol=1e-10, atol=1e-12))[0]
        return pdf[["grp_", "pos_"]].drop(pdf.index[first])

    of = edges.groupBy("grp_").applyInPandas(components, "grp_ string, pos_ long, of_ long")
    members = rows.select("grp_", "pos_", F.col(vector).alias("v_")).join(of, ["grp_", "pos_"])
    rest = members.groupBy("grp_", "of_").applyInPandas(others, "grp_ string, pos_ long")
    return rows.join(rest, ["grp_", "pos_"], "left_anti").select(*df.columns)


def align_sequences(df: DataFrame, query: list[str], video: str, frame: str, time: str, scores: str, score: str) -> DataFrame:
    """A query's candidates after alignment: those on the best path of each of its videos, with their place, the score raised by
    the path's score over the number of variants; a query without any path keeps its candidates as they are (place null).

    Candidates without a frame take no part. A missing time is 40 ms a frame. A query's candidates are few (its fusion limit)."""
    group = [*query, video]
    ddl = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group) + f", {frame} long, place int, {score} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame, kind="stable").reset_index(drop=True)
        t = pdf[time].fillna(pdf[frame] * 40.0).tolist()
        found = align(pdf[frame].tolist(), t, [list(x) for x in pdf[scores]])
        out = pdf.iloc[found[1] if found else []][[*group, frame, score]].copy()
        out["place"] = range(1, len(out) + 1)
        out[score] = out[score] + (found[0] / len(found[1]) if found else 0.0)
        return out[[*group, frame, "place", score]]

    aligned = stage(df.filter(F.col(frame).isNotNull()).groupBy(*group).applyInPandas(run, ddl), "aligned")
    rest = df.join(aligned.select(*query).distinct(), query, "left_anti").select(*group, frame, F.lit(None).cast("int").alias("place"), score)
    return aligned.unionByName(rest)


def repair(df: DataFrame, group: list[str], most: float, block: float = 3_600) -> DataFrame:
    """group and added: the times that close the gaps of more than `most`; columns t, blur, ok, kept (boolean), t_start, t_end.

    Gaps between kept times do not touch each other, so each is repaired alone from the candidates inside of it: a scan in
    blocks gives a candidate its gap, and only candidates of gaps that are too wide go on."""
    if most <= 0:
        return df.select(*group, F.col("t").alias("added")).limit(0)
    held = F.when(F.col("kept"), F.col("t"))
    g = scan_entity(df, group, "t", {"a_": ("last", held), "b_": ("next", held)}, block)
    g = g.withColumn("a_", F.coalesce("a_", "t_start")).withColumn("b_", F.coalesce("b_", "t_end")).filter(~F.col("kept") & (F.col("b_") - F.col("a_") > most + 1e-6) & (F.col("t") > F.col("a_")) & (F.col("t") < F.col("b_")))
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group) + ", added double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times = repair_coverage(list(zip(pdf.t, pdf.blur, pdf.ok)), [], (pdf.a_.iloc[0], pdf.b_.iloc[0]), most)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(times) for c in group}, "added": times})

    return g.groupBy(*group, "a_", "b_").applyInPandas(run, ddl)


def round_robin_subset(df: DataFrame, batch: str, order: str, size: str, target: float) -> DataFrame:
    """One of each batch in turn until the sizes reach the target; the row that reaches it is the last."""
    n = df.withColumn("turn", F.row_number().over(Window.partitionBy(batch).orderBy(order)))
    return numbered(n, [F.col("turn"), F.col(batch)], "nth_", F.col(size)).withColumnRenamed("before_", "before").filter(F.col("before") < target).drop("nth_")
