"""Problem 6: the most similar vectors of every vector, by an adaptive dimension scan within probed lists.

  classes   exact copies of a vector fall to one representative before the index is built, and come back at the end
  index     per group (model, dimension) lists in two levels: coarse cells by spherical k-means on a bounded sample, then the
            lists of each cell by k-means on the cell's own sample, a task per cell; every vector is put into its nearest list
            and those nearly as near (`SPILL`, `MARGIN`). A vector meets the coarse centres and the lists of its nearest cells
            only, so the number of lists follows the number of rows (`list_rows` each) up to `MAX_LISTS` a group
  scan      a list's vectors, unit length and randomly rotated, lie in column blocks. A block at a time adds to the partial
            squared distances, and a hypothesis test drops a pair as soon as the partial distance is too large for the
            query's k-th best so far, or for the least cosine asked for. Rotation makes a partial distance of d of D
            dimensions concentrate around d/D of the whole, so the test's error is set by `EPSILON`
  merge     the lists' answers of a vector meet, repeats fall away and the best k stay

Two vectors are compared in every list that holds both, so a pair is lost only if their lists do not meet at all. A list
that would be too large for a task (estimated from the sample) is cut into S blocks and every pair of blocks is a task of
its own: all pairs are still compared. Sizes: a task holds at most two blocks of about `BLOCK_ROWS` vectors.

Defined results: cosine ties go to the smaller id; a null vector, one of the wrong length, with a null, NaN or infinite
element or all zero takes no part; repeated rows count once; equal vectors under different ids are neighbours with cosine
1; a null model is a group of its own; groups of one vector and empty tables give no rows; further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinolith.operators.skew import HOT_ROWS, hot_counts, salted_join
from kinolith.session import stage, width

LIST_ROWS, MAX_LISTS, SAMPLE = 1024, 1 << 16, 32
FLAT, CELL_LISTS, CELLS = 512, 128, 6  # lists in one level up to FLAT, then cells of about CELL_LISTS; cells a vector looks into
SPILL, MARGIN, COPIES, LEAST_PROBES = 6, 0.07, 3, 8  # COPIES: lists of a vector where only some vectors ask, each in LEAST_PROBES lists or more
COLUMNS, EPSILON = 16, 2.1
BLOCK_ROWS = 8192
QUERIES, FIRST = 256, 256


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def adaptive_scan(q: np.ndarray, x: np.ndarray, reach: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) that survive the tests against each query's squared distance `reach`."""
    dim = q.shape[1]
    a, b = q[:, :columns], x[:, :columns]
    part = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    share = lambda d: 1.0 if d >= dim else d / dim * (1 + epsilon / math.sqrt(d)) ** 2
    slack = reach.astype(np.float32) + np.float32(1e-5)
    rows, cols = np.nonzero(part <= (slack * share(columns))[:, None])
    part = part[rows, cols]
    for d in range(columns, dim, columns):
        if not len(rows):
            break
        diff = q[rows, d : d + columns] - x[cols, d : d + columns]
        part = part + np.einsum("ij,ij->i", diff, diff)
        keep = part <= slack[rows] * share(min(dim, d + columns))
        rows, cols, part = rows[keep], cols[keep], part[keep]
    return rows, cols


def nearest_in_list(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, least: float, step: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, x row, cosine) of the k best of each query with a cosine of at least `least`; ids rank ties and differ.

    The k-th best among the first rows of the list bounds a query's test from the start; then the list is scanned in
    steps, and what a query has found so far tightens its test for the next step."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), QUERIES):
        part, ids = q[a : a + QUERIES], q_id[a : a + QUERIES]
        reach = np.full(len(part), 2 - 2 * least)
        if len(x) > FIRST > k:
            near = part @ x[:FIRST].T
            near[ids[:, None] == x_id[None, :FIRST]] = -2
            reach = np.minimum(reach, 2 - 2 * np.partition(near, FIRST - k, axis=1)[:, FIRST - k].astype(float) + 1e-5)
        r = c = np.zeros(0, np.int64)
        s = np.zeros(0)
        for b in range(0, len(x), step):
            rows, cols = adaptive_scan(part, x[b : b + step], reach)
            cols = cols + b
            differ = ids[rows] != x_id[cols]
            rows, cols = rows[differ], cols[differ]
            cos = np.einsum("ij,ij->i", part[rows].astype(float), x[cols].astype(float))
            keep = cos >= least
            r, c, s = np.r_[r, rows[keep]], np.r_[c, cols[keep]], np.r_[s, cos[keep]]
            order = np.lexsort((x_id[c], -s, r))
            r, c, s = r[order], c[order], s[order]
            fresh = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
            start = np.flatnonzero(fresh)
            nth = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
            top = nth < k
            r, c, s, nth = r[top], c[top], s[top], nth[top]
            full = nth == k - 1
            reach[r[full]] = np.minimum(reach[r[full]], 2 - 2 * s[full] + 1e-6)
        out.append((r + a, c, s))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))  # type: ignore[return-value]


@dataclass
class Lists:
    """The lists of one group: coarse cells, the centroids of all lists in order of their cell, and into how many blocks each is cut."""

    cells: np.ndarray
    centres: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def nearest(self, v: np.ndarray, k: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
        """(lists, similarities) of the k nearest lists of each row, best first; -1 where a row's cells hold fewer."""
        if len(self.cells) == 1:
            sim = v @ self.centres.T
            k = min(k, sim.shape[1])
            at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        else:
            coarse = v @ self.cells.T
            n = min(cells, coarse.shape[1])
            mine = np.argpartition(-coarse, n - 1, axis=1)[:, :n]
            lists = np.full((len(v), n * k), -1)
            sims = np.full((len(v), n * k), -np.inf, np.float32)
            for c in np.unique(mine):
                row, nth = np.nonzero(mine == c)
                low, high = self.first[c], self.first[c + 1]
                part = v[row] @ self.centres[low:high].T
                m = min(k, high - low)
                best = np.argpartition(-part, m - 1, axis=1)[:, :m]
                where = nth[:, None] * k + np.arange(m)
                lists[row[:, None], where] = best + low
                sims[row[:, None], where] = np.take_along_axis(part, best, 1)
            k = min(k, lists.shape[1])
            at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            sim, found = sims, np.take_along_axis(lists, at, 1)
        near = np.take_along_axis(sim, at, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        found = at if len(self.cells) == 1 else found
        return np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)


def _kmeans(v: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    c = v[np.random.default_rng(seed).permutation(len(v))[:k]].copy()
    for _ in range(rounds):
        of = (v @ c.T).argmax(1)
        order = np.argsort(of, kind="stable")
        at = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
        total = np.add.reduceat(v[order], at, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c[of[order][at]] = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c[of[order][at]])
    return c


def fit_lists(rows: DataFrame, list_rows: int, block_rows: int, spill: int = SPILL) -> dict[str, Lists]:
    """The lists of each group, fitted on its sample: about SAMPLE rows a list, at most MAX_LISTS lists; what comes to the driver are
    the centroids (16 MB a group of 64 dimensions at most)."""
    counts = {r.grp: r.n for r in rows.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    lists = {g: int(min(MAX_LISTS, max(1, n // list_rows))) for g, n in counts.items()}
    cells = {g: 1 if n <= FLAT else -(-n // CELL_LISTS) for g, n in lists.items()}

    def sample(share: dict[str, float], seed: int) -> DataFrame:
        chance = F.element_at(F.create_map(*[F.lit(x) for g in share for x in (g, share[g])]), F.col("grp"))
        return rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < chance * 1_000_000).select("grp", "id", "vector")

    def coarse(pdf: pd.DataFrame) -> pd.DataFrame:
        g, pdf = pdf["grp"].iloc[0], pdf.sort_values("id")  # the same sample gives the same centroids
        c = _kmeans(unit(np.stack(pdf["vector"].to_numpy())).astype(np.float32), cells[g])
        return pd.DataFrame({"grp": [g], "centres": [c.tobytes()], "dim": [c.shape[1]]})

    several = {g: min(1.0, 1.2 * 8 * SAMPLE * cells[g] / counts[g]) for g in counts if cells[g] > 1}
    tops: dict[str, np.ndarray] = {}
    if several:
        for r in sample(several, 7).filter(F.col("grp").isin(list(several))).groupBy("grp").applyInPandas(coarse, "grp string, centres binary, dim int").collect():
            tops[r.grp] = np.frombuffer(r.centres, np.float32).reshape(-1, r.dim)
    share = {g: min(1.0, 1.2 * SAMPLE * lists[g] / counts[g]) for g in counts}

    def in_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cell"] = 0
            for g in pdf["grp"].unique():
                if g in tops:
                    at = pdf["grp"] == g
                    pdf.loc[at, "cell"] = (unit(np.stack(pdf.loc[at, "vector"].to_numpy())).astype(np.float32) @ tops[g].T).argmax(1)
            yield pdf

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g, pdf = pdf["grp"].iloc[0], pdf.sort_values("id")
        v = unit(np.stack(pdf["vector"].to_numpy())).astype(np.float32)
        c = _kmeans(v, max(1, min(len(v), round(lists[g] * len(v) / (share[g] * counts[g])))))
        near = np.sort(v @ c.T, axis=1)[:, ::-1][:, :spill]
        copies = (near >= near[:, :1] - MARGIN).sum(1).mean()
        size = np.bincount((v @ c.T).argmax(1), minlength=len(c)) / share[g] * copies
        return pd.DataFrame({"grp": [g], "cell": [int(pdf["cell"].iloc[0])], "centres": [c.tobytes()], "dim": [c.shape[1]], "blocks": [np.maximum(1, np.ceil(size / block_rows)).astype(np.int64).tobytes()]})

    placed = sample(share, 3).mapInPandas(in_cell, "grp string, id string, vector array<float>, cell int")
    out: dict[str, Lists] = {}
    by_group: dict[str, list] = {}
    for r in placed.groupBy("grp", "cell").applyInPandas(fit, "grp string, cell int, centres binary, dim int, blocks binary").collect():
        by_group.setdefault(r.grp, []).append(r)
    for g, held in by_group.items():
        held.sort(key=lambda r: r.cell)  # a cell without a sample row has no list and goes
        parts = [np.frombuffer(r.centres, np.float32).reshape(-1, r.dim) for r in held]
        top = tops[g][[r.cell for r in held]] if g in tops else parts[0][:1]
        out[g] = Lists(top, np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])], np.concatenate([np.frombuffer(r.blocks, np.int64) for r in held]))
    return out


def _assign(lists: dict[str, Lists], probes: float):
    """Rows of each list: grp, list, tile (a pair of blocks), side (0 and 1: the blocks; 2: a query only), id, vector."""
    names = ["grp", "list", "tile", "side", "id", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for b in batches:
            grp = np.array(b.column(0).to_pylist(), object)
            ids, vectors = b.column(1), b.column(2)
            offsets = vectors.offsets.to_numpy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            query = b.column(3).to_numpy(zero_copy_only=False)
            salt = b.column(4).to_numpy(zero_copy_only=False)
            for g in sorted(set(grp.tolist())):
                at = np.flatnonzero(grp == g)
                held = lists.get(g)
                dim = int(offsets[at[0] + 1] - offsets[at[0]])
                v = unit(flat[offsets[at][:, None] - offsets[0] + np.arange(dim)])
                if held is None:
                    held = Lists(np.zeros((1, dim), np.float32), np.zeros((1, dim), np.float32), np.array([0, 1]), np.ones(1, np.int64))
                blocks, total = held.blocks, len(held.centres)
                v32 = v.astype(np.float32)
                near, sim = held.nearest(v32, min(total, COPIES if probes else SPILL))
                use = (near >= 0) & (np.ones(near.shape, bool) if probes else sim >= sim[:, :1] - MARGIN)
                row, nth = np.nonzero(use)
                lst = near[row, nth]
                own = salt[at][row] % blocks[lst]
                n = blocks[lst]
                other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row, lst, own = np.repeat(row, n), np.repeat(lst, n), np.repeat(own, n)
                low, high = np.minimum(own, other), np.maximum(own, other)
                tile, side = high * (high + 1) // 2 + low, (own > other).astype(np.int8)
                if probes:
                    keep = own == other
                    row, lst, tile, side = row[keep], lst[keep], tile[keep], side[keep]
                    asked = np.flatnonzero(query[at])
                    m = max(LEAST_PROBES, math.ceil(probes * total))
                    per = total / len(held.cells)
                    probe, _ = held.nearest(v32[asked], min(m, total), max(CELLS, math.ceil(2 * m / per)))
                    q_row, q_list = np.repeat(asked, probe.shape[1]), probe.reshape(-1)
                    q_row, q_list = q_row[q_list >= 0], q_list[q_list >= 0]
                    n = blocks[q_list]
                    block = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    q_row, q_list = np.repeat(q_row, n), np.repeat(q_list, n)
                    row, lst, tile = np.r_[row, q_row], np.r_[lst, q_list], np.r_[tile, block * (block + 1) // 2 + block]
                    side = np.r_[side, np.full(len(q_row), 2, np.int8)]
                if dim not in turn:
                    turn[dim] = rotation(dim)
                w = np.ascontiguousarray(v32 @ turn[dim])
                vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(w), [None, pa.py_buffer(w)]).cast(pa.binary())
                for a in range(0, len(row), 20_000):
                    r = row[a : a + 20_000]
                    cut = slice(a, a + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * len(r)), pa.array(lst[cut].astype(np.int32)), pa.array(tile[cut].astype(np.int32)), pa.array(side[cut].astype(np.int32)), ids.take(pa.array(at[r])), vec.take(pa.array(r))], names
                    )

    return run


def _scan(k: int, least: float, self_join: bool):
    """The answers of each (group, list, tile); rows come sorted by these."""
    names = ["a", "b", "cosine"]

    def answers(ids: list, sides: list, vecs: list) -> Iterator[pa.RecordBatch]:
        dim = len(vecs[0]) // 4
        v = np.frombuffer(b"".join(vecs), np.float32).reshape(-1, dim)
        side, key = np.array(sides), np.array(ids, object)
        _, rank = np.unique(key.astype(str), return_inverse=True)
        x = side < 2
        if not self_join:
            jobs = [(side == 2, x)]
        elif (side == 1).any():
            jobs = [(side == 0, side == 1), (side == 1, side == 0)]
        else:
            jobs = [(x, x)]
        for qm, xm in jobs:
            qi, xi = np.flatnonzero(qm), np.flatnonzero(xm)
            if len(qi) and len(xi):
                r, c, s = nearest_in_list(v[qi], rank[qi], v[xi], rank[xi], k, least)
                for a in range(0, len(r), 50_000):
                    cut = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(key[qi[r[cut]]].tolist()), pa.array(key[xi[c[cut]]].tolist()), pa.array(s[cut])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sides, vecs = None, [], [], []
        for b in batches:
            g, lst, tile, side, i, vec = (c.to_pylist() for c in b.columns)
            for n in range(b.num_rows):
                at = (g[n], lst[n], tile[n])
                if at != now:
                    if ids:
                        yield from answers(ids, sides, vecs)
                    now, ids, sides, vecs = at, [], [], []
                ids.append(i[n])
                sides.append(side[n])
                vecs.append(vec[n])
        if ids:
            yield from answers(ids, sides, vecs)

    return run


def _best(rows: DataFrame, of: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(of).orderBy(F.col("cosine").desc(), F.col(tie))
    return rows.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= k)


def nearest_vectors(
    df: DataFrame, vec_id: str, vector: str, model: str, dim: str, k: int, least: float = -1.0, queries: Column | None = None, probes: float = 0.0, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """vec_id, neighbour_id, rank_no and cosine of the k most similar other vectors with a cosine of at least `least`.

    queries: a condition on vec_id; then only those rows ask, each in the share `probes` of the lists, against all rows."""
    c = lambda x: F.col(f"`{x}`")
    src = df.select(c(vec_id).cast("string").alias("id"), c(vector).cast("array<float>").alias("vector"), F.concat_ws("\x1f", F.coalesce(c(model).cast("string"), F.lit("")), c(dim).cast("string")).alias("grp"), c(dim).alias("dim_"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = src.filter((F.size("vector") == F.col("dim_")) & (F.col("dim_") > 0) & F.col("id").isNotNull() & ~odd & F.exists("vector", lambda v: v != 0))
    asks = F.lit(True) if queries is None else queries
    rows = rows.select("grp", "id", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.reverse("vector"), F.lit(1)).alias("k2"), asks.alias("asks"))
    spark = df.sparkSession
    classes = rows.groupBy("grp", "k1", "k2").agg(F.min("id").alias("id"), F.first("vector").alias("vector"), F.max("asks").alias("asks"))
    classes = stage(classes.select("grp", "id", "vector", "asks", F.pmod("k1", F.lit(1 << 30)).alias("salt")), "classes")
    lists = fit_lists(classes, list_rows, block_rows)
    placed = classes.mapInArrow(_assign(lists, probes if queries is not None else 0.0), "grp string, list int, tile int, side int, id string, vec binary")
    together = placed.repartition(4 * width(spark), "grp", "list", "tile").sortWithinPartitions("grp", "list", "tile")
    found = together.mapInArrow(_scan(k, least, queries is None), "a string, b string, cosine double")
    found = stage(_best(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "a", k, "b").drop("rank_no"), "neighbours")
    # copies: ids of classes with more than one, from ids and digests only; a class with very many is dealt to salts
    slim = stage(rows.select("grp", "k1", "k2", "id", "asks").distinct(), "ids")
    key = ["grp", "k1", "k2"]
    several = slim.groupBy(*key).agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last").drop("last")
    members = stage(salted_join(slim, several, key, "inner", _hot(slim, key, hot_rows)).select("rep", "id", "asks"), "copies")
    first = members.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("nth") <= k + 1).select(F.col("rep").alias("b"), F.col("id").alias("target"))
    own = first.select(F.col("b").alias("a"), "target", F.lit(1.0).alias("cosine"))
    to = salted_join(found, first, ["b"], "left", _hot(found, ["b"], hot_rows)).select("a", F.coalesce("target", "b").alias("target"), "cosine").unionByName(own)
    to = _best(to, "a", k + 1, "target").drop("rank_no")
    of = members.select(F.col("rep").alias("a"), F.col("id").alias("member"), "asks")
    one = to.join(of.select("a").distinct(), "a", "left_anti").withColumn("member", F.col("a"))
    many = salted_join(of.filter("asks").select("a", "member"), to, ["a"], "inner", _hot(members, ["rep"], hot_rows).withColumnRenamed("rep", "a"))
    out = one.unionByName(many).select(F.col("member").alias(vec_id), F.col("target").alias("neighbour_id"), "cosine")
    return _best(out.filter(F.col(vec_id) != F.col("neighbour_id")), vec_id, k, "neighbour_id")


def _hot(staged: DataFrame, key: list[str], hot_rows: int) -> DataFrame:
    """The hot keys of a staged table; none are looked for where the whole has too few rows for one."""
    if staged.count() > hot_rows:  # from the Parquet footers
        return hot_counts(staged, key, hot_rows)
    return staged.sparkSession.createDataFrame([], T.StructType([*[staged.schema[c] for c in key], T.StructField("salts_", T.IntegerType())]))
