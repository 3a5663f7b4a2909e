"""Files by address, read and copied inside tasks: slices, content addresses, verified copies."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.functions.text import without_secrets


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address; `file:` with one slash and plain paths are local."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def open_file(uri: str) -> pa.NativeFile:
    fs, path = located(uri)
    return fs.open_input_file(path)


def read_bytes(uri: str) -> bytes:
    with open_file(uri) as f:
        return f.read()


class RangeReader:
    """Slices of one file through a cache of chunks; a file that changes between two reads is an error."""

    def __init__(self, uri: str, chunk: int = 1 << 20, chunks: int = 16):
        self.fs, self.path = located(uri)
        self.chunk, self.chunks = chunk, chunks
        self.pin = self._stamp()
        self.size = self.pin[0]
        self.held: OrderedDict[int, bytes] = OrderedDict()

    def _stamp(self) -> tuple:
        info = self.fs.get_file_info(self.path)
        return info.size, info.mtime_ns

    def _chunk(self, i: int) -> bytes:
        if i in self.held:
            self.held.move_to_end(i)
            return self.held[i]
        if self._stamp() != self.pin:
            raise OSError("the file has changed")
        with self.fs.open_input_file(self.path) as f:
            data = f.read_at(min(self.chunk, self.size - i * self.chunk), i * self.chunk)
        self.held[i] = data
        if len(self.held) > self.chunks:
            self.held.popitem(last=False)
        return data

    def read(self, start: int, length: int) -> bytes:
        """The bytes from start on, fewer at the end of the file."""
        end = min(self.size, start + length)
        if start < 0 or start >= end:
            return b""
        parts = [self._chunk(i) for i in range(start // self.chunk, (end - 1) // self.chunk + 1)]
        skip = start - start // self.chunk * self.chunk
        return b"".join(parts)[skip : skip + end - start]


def digest_of(uri: str) -> str:
    h = hashlib.sha256()
    with open_file(uri) as f:
        while data := f.read(1 << 20):
            h.update(data)
    return h.hexdigest()


def _copy(source: str, target: str) -> str:
    """Copy one file unless the target is equal already; written beside and moved, then read again: copied or skipped."""
    want = digest_of(source)
    fs, path = located(target)
    if fs.get_file_info(path).type == pafs.FileType.File and digest_of(target) == want:
        return "skipped"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    beside = f"{path}.part-{want[:12]}"
    with open_file(source) as f, fs.open_output_stream(beside) as out:
        while data := f.read(1 << 20):
            out.write(data)
    fs.move(beside, path)
    if digest_of(target) != want:
        raise OSError("the copy differs")
    return "copied"


RESULT = "source string, target string, status string, error string"


def copy_verified(paths: DataFrame, delete: bool = False) -> DataFrame:
    """Copy files (columns source and target) in tasks and compare their SHA-256: source, target, status (copied, skipped or
    failed) and error. delete: a source goes once its copy is known to be equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for s, t in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    fs, path = located(s)
                    gone = delete and fs.get_file_info(path).type == pafs.FileType.NotFound and digest_of(t)  # a task that is run again
                    status = "skipped" if gone else _copy(s, t)
                    if delete and not gone:
                        fs.delete_file(path)
                    out.append((s, t, status, None))
                except Exception as e:  # one file must not end the others
                    out.append((s, t, "failed", f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], ["source", "target", "status", "error"])

    done = paths.select("source", "target").mapInArrow(run, RESULT)
    return done.select(without_secrets("source").alias("source"), without_secrets("target").alias("target"), "status", without_secrets("error").alias("error"))


def moved_prefix(paths: DataFrame, old: str, new: str) -> DataFrame:
    """source and target of paths below one prefix under another."""
    return paths.filter(F.col("path").startswith(old)).select(F.col("path").alias("source"), F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 20)).alias("target"))


def by_content(paths: DataFrame, root: str) -> DataFrame:
    """source and target of files in a store by content (root/sha256/ab/abcd...): equal files have one target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            keys = [digest_of(n) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([f"{root.rstrip('/')}/sha256/{k[:2]}/{k}" for k in keys])], ["source", "target"])

    return paths.select("path").mapInArrow(run, "source string, target string")


def put_content(df: DataFrame, column: str, root: str) -> DataFrame:
    """Write each value of a binary column to the store by content: target and size of what was written; equal values once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            targets, sizes = [], []
            for data in b.column(0).to_pylist():
                k = hashlib.sha256(data).hexdigest()
                target = f"{root.rstrip('/')}/sha256/{k[:2]}/{k}"
                fs, path = located(target)
                if fs.get_file_info(path).type != pafs.FileType.File:
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with fs.open_output_stream(f"{path}.part") as f:
                        f.write(data)
                    fs.move(f"{path}.part", path)
                targets.append(target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(sizes, pa.int64())], ["target", "size_bytes"])

    one = df.select(column).filter(F.col(column).isNotNull()).dropDuplicates([column])
    return one.mapInArrow(run, "target string, size_bytes long")


def put_named(df: DataFrame, name: str, body: str, root: str) -> DataFrame:
    """Write each row's text (or binary) as a file root/name in tasks: target and size; each file is written beside and moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            targets, sizes = [], []
            for n, data in zip(*(c.to_pylist() for c in b.columns)):
                data = data.encode() if isinstance(data, str) else data
                fs, path = located(f"{root.rstrip('/')}/{n}")
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{path}.part") as f:
                    f.write(data)
                fs.move(f"{path}.part", path)
                targets.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(sizes, pa.int64())], ["target", "size_bytes"])

    return df.select(name, body).mapInArrow(run, "target string, size_bytes long")


def put_matrices(df: DataFrame, root: str, part_rows: int = 1 << 16) -> DataFrame:
    """Write vectors (columns name, an order column, vector) as float32 .npy matrices root/part/name.npy of at most `part_rows` rows:
    target and rows. A name with many rows gives many parts; vectors of a name have one length."""
    order = next(c for c in df.columns if c not in ("name", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def flush(name: str, nth: int, rows: list) -> pa.RecordBatch:
            fs, path = located(f"{root.rstrip('/')}/{TaskContext.get().partitionId()}-{nth}/{name}.npy")
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            m = np.array(rows, np.float32)
            with fs.open_output_stream(path) as f:
                np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(m))
                f.write(m.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(rows)], pa.int64())], ["target", "n_rows"])

        now, nth, rows = None, 0, []
        for b in batches:
            for name, v in zip(*(c.to_pylist() for c in b.columns)):
                if rows and (name != now or len(rows) >= part_rows):
                    yield flush(now, nth, rows)
                    nth, rows = nth + 1, []
                now = name
                rows.append(v)
        if rows:
            yield flush(now, nth, rows)

    return df.sortWithinPartitions("name", order).select("name", "vector").mapInArrow(run, "target string, n_rows long")
