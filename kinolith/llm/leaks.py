"""Problem 9: evaluation texts inside training texts, by latent semantic retrieval of passages.

  words     texts in their consistent form (`canonical`), lower case, as runs of letters or digits, hashed to 64 bits
  weights   document frequency of each hashed term over all documents -> inverse document frequency
  space     randomised SVD of the TF-IDF matrix of all corpus passages: every task adds A'(A Omega) over its passages, the
            sums meet per block of terms, and the driver finishes on a matrix of fixed size (terms x sketch) by Nystrom
  search    each corpus passage against all item passages by cosine in that space; item passages lie in clusters, and a
            cluster is left out only where the angle to its centre proves it holds nothing above the threshold
  checks    the words of each candidate pair: longest common run
  paraphrases  every stretch of a document that holds one of the rarest answer words of an item's stretch, whatever its
            cosine: longest common subsequence and answer words (`WindowIndex`)

A passage is 8 words. Items are cut at every word, documents at every fifth: any 12 words in a row hold a whole passage
of the document, equal to one of the item, whose cosine is 1. So no verbatim case is lost by the search, whatever the rank
of the space. No paraphrase that passes the checks at these passages is lost either. The items are read in blocks of at most
`BLOCK_WORDS` words (or one item), and the corpus streams past each block's index; it is never grouped or gathered. The index of
a block is all that a task holds beside its batch, so it is bounded whatever the number of items.

Defined results: null and empty texts and texts of fewer than 12 words hold no case; an item of fewer than 12 words cannot
leak; a pair comes out once however often the passage or the row is repeated; an empty corpus or no items give no rows;
further columns are left out; texts of any length are read whole, passage by passage. An item may bring the text of its answer:
then a paraphrase counts only in a document that holds all words of the answer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolith.llm.canonical import form_function
from kinolith.session import stage, width

PASSAGE, STRIDE, RUN = 8, 5, 12
TERMS, SKETCH, RANK = 1 << 14, 48, 40
COSINE = 0.97
BLOCK_WORDS = 1 << 18
SLICE = 4096
SLACK, PAIRS, CELLS = 4, 1 << 20, 1 << 25


def word_function():
    """A function from a text to the hashes of its words."""
    form, words, seen = form_function(), [], {}

    def run(text: str | None) -> list[int]:
        if not text:
            return []
        if not words:
            words.append(re.compile(r"[^\W_]+").findall)
        out = []
        for w in words[0](form(text).lower()):
            h = seen.get(w)
            if h is None:
                if len(seen) >= 200_000:
                    seen.clear()
                h = seen[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            out.append(h)
        return out

    return run


def word_hashes(text: str | Column) -> Column:
    """The words of a text column as 64-bit hashes."""
    words = word_function()

    @F.arrow_udf("array<long>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([words(t) for t in x.to_pylist()], pa.list_(pa.int64()))

    return run(F.col(text) if isinstance(text, str) else text)


def passages(sizes: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each passage and its first word's place in the concatenated words; only whole passages."""
    n = np.maximum(0, (sizes - PASSAGE) // stride + 1)
    row = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (np.cumsum(sizes) - sizes)[row] + nth * stride


def bins(words: np.ndarray) -> np.ndarray:
    return words & (TERMS - 1)


@dataclass
class Space:
    """Latent space: a row per term, already weighted; the vector of a passage is the sum of its words' rows."""

    rows: np.ndarray

    def vectors(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        v = self.rows[bins(words[starts[:, None] + np.arange(PASSAGE)])].sum(axis=1)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.maximum(norm, 1e-30)


def _flat(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    lists = b.column(i)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def inverse_frequencies(words: DataFrame) -> np.ndarray:
    """Weight of each hashed term, from its number of documents among all; the result has TERMS rows at any size."""
    one = F.array_distinct(F.transform("words", lambda w: w.bitwiseAND(TERMS - 1)))
    counts = words.select(F.explode(F.array_append(one, F.lit(-1).cast("long"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).toPandas()
    df = np.zeros(TERMS)
    held = counts[counts.term >= 0]
    df[held.term.to_numpy()] = held.n.to_numpy()
    total = int(counts.n[counts.term < 0].sum())
    return np.log((1 + total) / (1 + df)) + 1


def latent_space(words: DataFrame, idf: np.ndarray, seed: int = 7) -> Space:
    """Randomised SVD over all corpus passages."""
    omega = np.random.default_rng(seed).standard_normal((TERMS, SKETCH))
    weighted = (omega * idf[:, None]).astype(np.float32)
    parts, per = 16, TERMS // 16

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SKETCH, TERMS))
        any_ = False
        for b in batches:
            flat, sizes = _flat(b, 0)
            _, starts = passages(sizes, STRIDE)
            for a in range(0, len(starts), SLICE):
                at = bins(flat[starts[a : a + SLICE, None] + np.arange(PASSAGE)])
                y = weighted[at].sum(axis=1).astype(float)
                at, any_ = at.reshape(-1), True
                for j in range(SKETCH):
                    total[j] += np.bincount(at, np.repeat(y[:, j], PASSAGE), TERMS)
        if any_:
            blocks = [np.ascontiguousarray(total[:, p * per : (p + 1) * per]).tobytes() for p in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blocks, pa.binary())], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw).reshape(SKETCH, per)
                sums[p] = sums[p] + x if p in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "sums"])

    rows = words.select("words").mapInArrow(sketch, "part int, sums binary").repartition(parts, "part").mapInArrow(add, "part int, sums binary").collect()
    b = np.zeros((TERMS, SKETCH))
    for r in rows:  # 16 blocks, 6 MB, whatever the corpus
        b[r.part * per : (r.part + 1) * per] = np.frombuffer(r.sums).reshape(SKETCH, per).T
    b *= idf[:, None]
    return Space((idf[:, None] * nystrom(omega, b, RANK)).astype(np.float32))


def nystrom(omega: np.ndarray, b: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of A from a sketch b = A'A omega."""
    if not b.any():
        return omega[:, :rank] / np.sqrt(len(omega))
    core = omega.T @ b
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    ok = values > values.max() * 1e-10
    u, _, _ = np.linalg.svd(b @ (vectors[:, ok] / np.sqrt(values[ok])), full_matrices=False)
    return u[:, :rank]


class ItemIndex:
    """Passages of the items, in clusters of near directions."""

    def __init__(self, space: Space, ids: list[int], words: list[list[int]], threshold: float, clusters: int = 1024, seed: int = 7):
        self.space, self.threshold = space, threshold
        self.ids = np.array(ids)
        self.words = np.array([w for x in words for w in x], np.int64)
        self.sizes = np.array([len(x) for x in words], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.row, self.starts = passages(self.sizes, 1)
        v = space.vectors(self.words, self.starts)
        k = max(1, min(clusters, len(v) // 32))
        c = v[np.random.default_rng(seed).permutation(len(v))[:k]] if len(v) else np.zeros((1, space.rows.shape[1]), np.float32)
        for _ in range(8 if len(v) else 0):
            of = (v @ c.T).argmax(axis=1)
            for j in range(k):
                if (of == j).any():
                    m = v[of == j].sum(axis=0)
                    c[j] = m / max(np.linalg.norm(m), 1e-30)
        of = (v @ c.T).argmax(axis=1) if len(v) else np.zeros(0, int)
        self.centres = c
        self.members = [np.flatnonzero(of == j) for j in range(k)]
        self.vectors = [v[m] for m in self.members]
        reach = [np.arccos(np.clip((x @ c[j]).min(), -1, 1)) if len(x) else 0 for j, x in enumerate(self.vectors)]
        self.least = np.cos(np.minimum(np.pi, np.array(reach) + np.arccos(threshold))) - 1e-5

    def candidates(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of z, item passage, cosine) of all pairs of at least the threshold."""
        near = z @ self.centres.T >= self.least
        found: list[tuple] = []
        for j, members in enumerate(self.members):
            if not len(members):
                continue
            rows = np.flatnonzero(near[:, j])
            if len(rows):
                cos = z[rows] @ self.vectors[j].T
                r, c = np.nonzero(cos >= self.threshold)
                if len(r):
                    found.append((rows[r], members[c], cos[r, c]))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


class WindowIndex:
    """Stretches of three passages of the items, by answer words (the stretch's rarest); a document's stretch is as long and SLACK more.

    A paraphrase holds `share` of the m answer words, so at least one of any m - need + 1 of them: only the rarest so many of
    a stretch are looked up, and no pair that passes the checks is left out."""

    def __init__(self, index: ItemIndex, idf: np.ndarray, share: float):
        if share <= 0:
            raise ValueError("share must be above 0")
        self.share, n = share, len(index.row)
        self.vocabulary, word = np.unique(index.words, return_inverse=True)
        self.word, weight = word.astype(np.int32), idf[bins(index.words)]
        first, s = index.first[index.row], index.starts - index.first[index.row]
        self.low = first + np.maximum(0, s - PASSAGE)
        self.size = first + np.minimum(index.sizes[index.row], s + 2 * PASSAGE) - self.low
        self.answer, self.need = np.zeros((n, 3 * PASSAGE), bool), np.zeros(n, np.int64)
        words, windows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for size in np.unique(self.size):
            of = np.flatnonzero(self.size == size)
            for c in range(0, len(of), SLICE):
                k = of[c : c + SLICE]
                at = self.low[k][:, None] + np.arange(size)
                b, w = self.word[at], weight[at]
                repeat = (np.tril(np.ones((size, size), bool), -1) & (b[:, :, None] == b[:, None, :])).any(axis=2)
                answer = (w >= np.quantile(w, 0.75, axis=1)[:, None]) & ~repeat
                m = answer.sum(axis=1)
                self.answer[k, :size], self.need[k] = answer, np.ceil(share * m)
                order = np.argsort(np.where(answer, -w, np.inf), axis=1, kind="stable")
                use, nth = np.nonzero(np.arange(size) < (m - self.need[k] + 1)[:, None])
                words.append(b[use, order[use, nth]])
                windows.append(k[use])
        held = np.concatenate(words)
        self.windows = np.concatenate(windows)[np.argsort(held, kind="stable")]
        self.at = np.r_[0, np.cumsum(np.bincount(held, minlength=len(self.vocabulary)))]
        # a stretch's words and its answer words, filled up with a word that no document has
        place, none = np.arange(3 * PASSAGE), len(self.vocabulary)
        inside = place < self.size[:, None]
        self.words = np.where(inside, self.word[np.minimum(self.low[:, None] + place, max(0, len(self.word) - 1))], none).astype(np.int32) if n else np.zeros((0, 3 * PASSAGE), np.int32)
        most = int(self.answer.sum(axis=1).max()) if n else 0
        first = np.argsort(~self.answer, axis=1, kind="stable")[:, :most]
        self.answers = np.where(np.take_along_axis(self.answer, first, 1), np.take_along_axis(self.words, first, 1), none)

    def known(self, flat: np.ndarray) -> np.ndarray:
        """Place of each word in the items' vocabulary, or -1."""
        i = np.minimum(np.searchsorted(self.vocabulary, flat), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[i] == flat, i, -1).astype(np.int32)

    def paraphrases(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of a, item passage, common subsequence) of all pairs that pass the checks; a: known words, -1 for others.

        Which words a row holds is a table of bits, so the first checks of a pair are a few look-ups."""
        step = max(1, min(len(a), CELLS // (len(self.vocabulary) + 1)))
        for top in range(0, len(a), step):
            part = a[top : top + step]
            holds = np.zeros((len(part), len(self.vocabulary) + 1), bool)
            holds[np.arange(len(part))[:, None], part] = True  # unknown words fall into the last column
            holds[:, -1] = False
            n = np.where(part >= 0, self.at[part + 1] - self.at[part], 0)
            upto = np.cumsum(n.sum(axis=1))
            cut = 0
            while cut < len(part):
                end = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + PAIRS, "right")))
                r, j = np.nonzero(n[cut:end])
                r += cut
                m = n[r, j]
                nth = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                row, k = np.repeat(r, m), self.windows[np.repeat(self.at[part[r, j]], m) + nth]
                ok = holds[row[:, None], self.answers[k]].sum(axis=1) >= self.need[k]
                pair = np.unique(row[ok] * len(self.low) + k[ok])
                for c in range(0, len(pair), SLICE):
                    rows, windows, size = self._checked(part, holds, *np.divmod(pair[c : c + SLICE], len(self.low)))
                    yield rows + top, windows, size
                cut = end

    def _checked(self, a: np.ndarray, holds: np.ndarray, r: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = holds[r[:, None], self.words[k]].sum(axis=1) >= self.share * self.size[k]
        r, k = r[ok], k[ok]
        n = common_subsequences(self.words[k][:, :, None] == a[r][:, None, :])
        ok = (n >= self.share * self.size[k]) & (self.size[k] >= RUN)
        return r[ok], k[ok], n[ok]


def common_subsequences(same: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of many pairs at once; same[i, x, y]: words x and y of pair i are equal, at most 32 y."""
    bits = np.packbits(same, axis=2, bitorder="little").astype(np.uint64)
    mask = (bits << (8 * np.arange(bits.shape[2], dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    open_ = np.full(len(same), 2**32 - 1, np.uint64)  # a word of y is closed when one more word of x is matched up to it
    for x in range(same.shape[1]):
        use = open_ & mask[:, x]
        open_ = ((open_ + use) | (open_ & ~mask[:, x])) & np.uint64(2**32 - 1)
    return 32 - np.bitwise_count(open_).astype(np.int64)


def common_run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """Start and end in a of the words in a row that a around i and b around j have in common; a[i] == b[j]."""
    start, end = i, i + 1
    while start > 0 and j - (i - start) > 0 and a[start - 1] == b[j - (i - start) - 1]:
        start -= 1
    while end < len(a) and j + end - i < len(b) and a[end] == b[j + end - i]:
        end += 1
    return start, end


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            row[j], diagonal = (diagonal + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@dataclass
class Evidence:
    """What a document holds of an item; shift and end tell which run is known already."""

    kind: str
    n: int
    cosine: float
    shift: int = 0
    end: int = -1


def _matches(index: ItemIndex, stretches: WindowIndex | None, answers: list[np.ndarray]):
    """Documents with the items they hold: verbatim runs, and paraphrases if there are stretches to look for."""
    names = ["doc_id", "item_id", "kind", "n_words", "cosine"]
    w = np.arange(PASSAGE)

    def check(flat: np.ndarray, doc_at: np.ndarray, sizes: np.ndarray, row: np.ndarray, start: np.ndarray, found: dict[tuple[int, int], Evidence]) -> None:
        doc, item, cos = index.candidates(index.space.vectors(flat, start))
        if not len(doc):
            return
        same = (flat[start[doc][:, None] + w] == index.words[index.starts[item][:, None] + w]).all(axis=1)
        for d, q, c in zip(doc[same], item[same], cos[same]):
            r, i = int(row[d]), int(index.row[q])
            held = found.get((r, i))
            p, s = int(start[d] - doc_at[r]), int(index.starts[q] - index.first[i])
            if held and held.kind == "verbatim" and held.shift == p - s and p < held.end:
                continue  # a passage of the run that is known
            a, z = common_run(flat[doc_at[r] : doc_at[r] + sizes[r]], p, index.words[index.first[i] : index.first[i] + index.sizes[i]], s)
            if z - a >= RUN and not (held and held.kind == "verbatim" and held.n >= z - a):
                found[r, i] = Evidence("verbatim", z - a, float(c), p - s, z)

    def rephrased(flat: np.ndarray, known: np.ndarray, doc_at: np.ndarray, sizes: np.ndarray, row: np.ndarray, start: np.ndarray, found: dict[tuple[int, int], Evidence]) -> None:
        at = start[:, None] - PASSAGE - SLACK + np.arange(3 * PASSAGE + 2 * SLACK)
        inside = (at >= doc_at[row][:, None]) & (at < (doc_at + sizes)[row][:, None])
        a = np.where(inside, known[np.clip(at, 0, len(known) - 1)], -1)
        for d, q, n in stretches.paraphrases(a):
            if not len(d):
                continue
            cos = (index.space.vectors(flat, start[d]) * index.space.vectors(index.words, index.starts[q])).sum(axis=1)
            for r, i, m, c in zip(row[d].tolist(), index.row[q].tolist(), n.tolist(), cos.tolist()):
                held = found.get((r, i))
                if not held and len(answers[i]) and not np.isin(answers[i], flat[doc_at[r] : doc_at[r] + sizes[r]]).all():
                    continue
                if not held or held.kind != "verbatim" and (held.cosine, held.n) < (c, m):
                    found[r, i] = Evidence("paraphrase", m, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = _flat(b, 1)
            doc_at = np.cumsum(sizes) - sizes
            row, start = passages(sizes, STRIDE)
            long_ = sizes[row] >= RUN
            row, start = row[long_], start[long_]
            found: dict[tuple[int, int], Evidence] = {}
            for a in range(0, len(start), SLICE):
                check(flat, doc_at, sizes, row[a : a + SLICE], start[a : a + SLICE], found)
            known = stretches.known(flat) if stretches else flat
            for a in range(0, len(start) if stretches else 0, SLICE):
                rephrased(flat, known, doc_at, sizes, row[a : a + SLICE], start[a : a + SLICE], found)
            if found:
                docs = b.column(0).take(pa.array([r for r, _ in found]))
                items = pa.array([int(index.ids[i]) for _, i in found], pa.int64())
                kinds, n = pa.array([e.kind for e in found.values()]), pa.array([e.n for e in found.values()], pa.int32())
                yield pa.RecordBatch.from_arrays([docs, items, kinds, n, pa.array([e.cosine for e in found.values()])], names)

    return run


def item_blocks(items: DataFrame, item_id: str, item_text: str, answer: str | None, most: int) -> Iterator[list[tuple[int, list[int], list[int]]]]:
    """Items (id, words, words of the answer) of at least RUN words in order of their id, in blocks of at most `most` words or one item."""
    c = lambda x: F.col(f"`{x}`")
    rows = items.select(c(item_id).cast("long").alias("i"), c(item_text).cast("string").alias("t"), (c(answer).cast("string") if answer else F.lit(None).cast("string")).alias("a"))
    words_of = word_function()
    block, size = [], 0
    for r in rows.filter("i is not null and t is not null").distinct().orderBy("i", "t", "a").toLocalIterator():
        words = words_of(r.t)
        if len(words) < RUN:
            continue
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        block.append((r.i, words, words_of(r.a)))
        size += len(words)
    if block:
        yield block


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE, paraphrases: bool = False, share: float = 0.7,
    answer: str | None = None, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, item_id, kind (verbatim or paraphrase), n_words (longest run, or subsequence) and cosine, once per pair.

    answer: a column of items with the text of the answer, if they have one."""
    kind = docs.schema[doc_id].dataType.simpleString()
    spark = docs.sparkSession
    ddl = f"doc_id {kind}, item_id long, kind string, n_words int, cosine double"
    words, idf, space, out = None, None, None, None
    for block in item_blocks(items, item_id, item_text, answer, block_words):
        if words is None:
            texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text_")).filter("text_ is not null").repartition(width(spark), "doc_id")
            words = stage(texts.select("doc_id", word_hashes("text_").alias("words")), "words")
            idf = inverse_frequencies(words)
            space = latent_space(words, idf)
        index = ItemIndex(space, [i for i, _, _ in block], [w for _, w, _ in block], cosine)
        answers = [np.array(a, np.int64) for _, _, a in block]
        part = words.mapInArrow(_matches(index, WindowIndex(index, idf, share) if paraphrases else None, answers), ddl)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], ddl)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("kind") == "verbatim", "n_words", "cosine", "kind")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.kind").alias("kind"), F.col("x.n_words").alias("n_words"), F.col("x.cosine").alias("cosine"))
