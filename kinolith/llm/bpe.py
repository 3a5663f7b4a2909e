"""Problem 8: encoding of a corpus with a public byte-level BPE vocabulary, by a hierarchical-bitmap rank queue.

The text is split by the vocabulary's pattern; the bytes of a pre-token form a linked list of symbols. Every neighbouring
pair that has a merge stands in the bucket of its merge rank as the position of its left symbol, and a bitmap of three
levels (64-way) tells by find-first-set which rank comes next. A bucket is taken whole and worked from left to right;
entries whose symbols have changed since are stale and skipped. A merge only makes pairs of higher rank, so a bucket never
fills again after it was taken. The work is O(n log n) in a pre-token's length with small constants, whatever its length.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; ill
parts cannot occur, as Spark's strings are UTF-8; documents repeated as whole rows come out once; the order is the text's.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolith.session import width

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 100_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k as the installed package gives it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character by which a byte-level vocabulary writes each byte: itself if visible, else from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class BitmapQueue:
    """Set of ranks with find-first-set, and a bucket of positions per rank.

    Two levels of 64-bit words; the top one has a bit per 4096 ranks, as many as there are, in one integer."""

    def __init__(self, size: int):
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.bucket.get(rank)
        if held is not None:
            held.append(position)
            return
        self.bucket[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank with its positions, or None."""
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) + (word & -word).bit_length() - 1
        word = self.low[b]
        rank = (b << 6) + (word & -word).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= top - 1
        return rank, self.bucket.pop(rank)


class Encoder:
    """Byte-level BPE from a vocabulary file with `model.vocab` and `model.merges`."""

    def __init__(self, path: str, pattern: str = PATTERN, cache: int = CACHE):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.of_byte = [vocab[s] for s in byte_symbols()]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.queue = BitmapQueue(len(pairs))
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}
        self.most = cache

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(data)
        sym = [self.of_byte[b] for b in data]
        if n < 2:
            return sym
        rank, queue = self.rank, self.queue
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            r = rank.get((sym[i], sym[i + 1]))
            if r is not None:
                queue.push(r, i)
        while (least := queue.pop()) is not None:
            r, positions = least
            left, right, made = self.left[r], self.right[r], self.made[r]
            positions.sort()
            for i in positions:
                if sym[i] != left:
                    continue  # stale: merged or gone
                j = after[i]
                if j >= n or sym[j] != right:
                    continue  # stale: its neighbour has changed
                sym[i], sym[j] = made, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    x = rank.get((made, sym[k]))
                    if x is not None:
                        queue.push(x, i)
                h = before[i]
                if h >= 0:
                    x = rank.get((sym[h], made))
                    if x is not None:
                        queue.push(x, h)
        return [s for s in sym if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for p in self.split(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8"))
                if len(p) <= 64:
                    if len(cache) >= self.most:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out


def _lists(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def token_ids(text: str | Column, path: str | None = None) -> Column:
    """The list of token ids of a text column. path: the vocabulary file, readable on every executor."""
    path = path or default_vocabulary()
    held: list[Encoder] = []

    @F.arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        if not held:
            held.append(Encoder(path))
        return _lists([held[0].encode(t) for t in x.to_pylist()])

    return run(F.col(text) if isinstance(text, str) else text)


def encode_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids of every document; whole rows that repeat count once. One exchange spreads the texts evenly by id."""
    docs = df.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias("text_")).repartition(width(df.sparkSession), doc_id).distinct()
    return docs.select(doc_id, token_ids("text_", path).alias("ids"))
