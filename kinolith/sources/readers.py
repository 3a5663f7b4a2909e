"""Readers: one call for each format and shape of file the pipeline meets."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinolith.functions.text import natural_key, without_secrets
from kinolith.operators.skew import numbered, scan_entity
from kinolith.session import stage
from kinolith.sources import files as files_io

FRAME_MAP = "n long, pts_time double, fps double, frame_idx long"


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet, CSV, JSON (object or array) or JSON lines by suffix; asked-for columns that lack are an error."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("", ".parquet"):
        df = reader.parquet(path)
    elif kind == ".csv":
        df = reader.csv(path, header=True, inferSchema=schema is None)
    elif kind in (".jsonl", ".ndjson"):
        df = reader.json(path)
    elif kind == ".json":
        df = reader.json(path, multiLine=True)
    else:
        raise ValueError(f"unknown kind of table: {path}")
    if columns:
        if absent := [c for c in columns if c not in df.columns]:
            raise ValueError(f"columns {absent} are missing in {path}")
        df = df.select(*columns)
    return df


def scores_from_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {id: score} as rows of id and score."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("id", "score")).select(F.col("id").cast("long").alias("id"), "score")


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """A video manifest as a table, a JSON array or object, or JSON lines; an object that holds one list of rows gives its rows."""
    df = read_table(spark, path)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    return df.select(F.explode(lists[0]).alias("x")).select("x.*") if len(lists) == 1 and "video_id" not in df.columns else df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A frame manifest with ids and times in their types, and `is_codec_keyframe` under that name (the first frame always is one);
    rows without an id are left out. What breaks the timeline comes from `manifest_violations`."""
    df = read_table(spark, path)
    whole = lambda c: F.when(F.col(c).cast("double") % 1 == 0, F.col(c).cast("double").cast("long"))
    df = df.select(*[whole(c).alias(c) if c in ("original_frame_id", "pts") else F.col(c).cast("double").alias(c) if c.endswith("_ms") else F.col(c) for c in df.columns])
    if "pts" not in df.columns:
        df = df.withColumn("pts", F.lit(None).cast("long"))
    key = next((c for c in ("is_codec_keyframe", "key_frame") if c in df.columns), None)
    flag = F.coalesce(F.col(key).cast("boolean"), F.lit(False)) if key else F.lit(False)
    return df.withColumn("is_codec_keyframe", flag | (F.col("original_frame_id") == 0)).filter("original_frame_id is not null")


def manifest_violations(df: DataFrame) -> DataFrame:
    """video_id, original_frame_id, violation of a manifest that is no whole timeline from 0: `position` or `pts` (comes twice)."""
    f = scan_entity(df, ["video_id"], "original_frame_id", {"nth_": ("sum", F.lit(1))})
    twice = df.filter("pts is not null").groupBy("video_id", "pts").agg(F.count("*").alias("same_")).filter("same_ > 1")
    f = f.join(twice, ["video_id", "pts"], "left")
    kinds = F.array_compact(F.array(F.when(F.col("nth_") - 1 != F.col("original_frame_id"), "position"), F.when(F.col("same_").isNotNull(), "pts")))
    return f.select("video_id", "original_frame_id", F.explode(kinds).alias("violation"))


MAP_NAMES = {"video_id": ["video_id", "video"], "keyframe_no": ["keyframe_no", "n", "keyframe"], "source_frame_idx": ["source_frame_idx", "frame_idx", "original_frame_id"]}
ROW_KEYS = ("keyframes", "frames", "data", "items", "map")


def map_rows(doc: object) -> list[dict]:
    """The rows of a JSON map: a list; a list under a known key; lists by video; objects by keyframe number; or one row."""
    if isinstance(doc, list):
        return [r for r in doc if isinstance(r, dict)]
    if not isinstance(doc, dict):
        return []
    known = next((doc[k] for k in ROW_KEYS if isinstance(doc.get(k), list)), None)
    if known is not None:
        return map_rows(known)
    if doc and all(isinstance(v, list) for v in doc.values()):
        return [{"video_id": k} | r for k, v in doc.items() for r in v if isinstance(r, dict)]
    if doc and all(isinstance(v, dict) for v in doc.values()):
        return [{"keyframe_no": k} | v for k, v in doc.items()]
    return [doc]


def read_source_maps(spark: SparkSession, root: str, videos: list[str] | None = None) -> DataFrame:
    """All maps below a folder (CSV with n,frame_idx or JSON in any of five shapes); a file without video_id takes its own stem.

    videos: only files named after one of them. Values that are no numbers are null."""
    files = list_files(spark, root, (".csv", ".json"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    if videos is not None:
        files = files.filter(stem.isin(videos))
    texts = files.select("path").withColumn("stem", stem)

    def run(batches):
        import csv
        import io
        import json

        import pyarrow as pa

        for b in batches:
            out = {"video_id": [], "keyframe_no": [], "source_frame_idx": [], "source_map_file": [], "source_row_index": []}
            for path, name in zip(*(c.to_pylist() for c in b.columns)):
                text = files_io.read_bytes(path).decode("utf-8-sig")
                rows = list(csv.DictReader(io.StringIO(text))) if path.lower().endswith(".csv") else map_rows(json.loads(text))
                for i, r in enumerate(rows):
                    value = {c: next((r[n] for n in names if r.get(n) not in (None, "")), None) for c, names in MAP_NAMES.items()}
                    out["video_id"].append(str(value["video_id"] or name))
                    for c in ("keyframe_no", "source_frame_idx"):
                        try:
                            out[c].append(int(str(value[c])))
                        except ValueError:
                            out[c].append(None)
                    out["source_map_file"].append(path.rsplit("/", 1)[-1])
                    out["source_row_index"].append(i)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("video_id", pa.string()), ("keyframe_no", pa.int64()), ("source_frame_idx", pa.int64()), ("source_map_file", pa.string()), ("source_row_index", pa.int64())]))

    return texts.mapInArrow(run, "video_id string, keyframe_no long, source_frame_idx long, source_map_file string, source_row_index long")


def read_ocr(spark: SparkSession, path: str, least: float = 0.5) -> DataFrame:
    """OCR records as JSON lines, one row per accepted detection."""
    schema = "video_id string, keyframe_no long, texts array<struct<text:string,confidence:double,accepted:boolean>>"
    d = spark.read.schema(schema).json(path).select("video_id", "keyframe_no", F.posexplode("texts").alias("detection_index", "x"))
    return d.filter(F.coalesce("x.accepted", F.col("x.confidence") >= least)).select("video_id", "keyframe_no", "detection_index", "x.text", "x.confidence")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Speech JSON (`chunks` with times in ms or seconds) as spans with a fresh index; blank texts are left out."""
    d = transcript_spans(spark, path)
    return d.filter("problem is null or problem = 'timestamp_clip'").select("video_id", "source_span_index", "start_ms", "end_ms", "text_raw")


def transcript_spans(spark: SparkSession, path: str, tolerance_ms: int = 100) -> DataFrame:
    """All spans with their `problem`: empty_text, invalid_interval, duration_mismatch, or timestamp_clip (an end beyond the video by at most the tolerance, cut)."""
    schema = "video_id string, model_version string, duration_ms long, chunks array<struct<start_ms:long,end_ms:long,start:double,end:double,text:string>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select("video_id", "model_version", "duration_ms", F.posexplode("chunks").alias("source_span_index", "x"))
    start = F.coalesce("x.start_ms", F.bround(F.col("x.start") * 1000).cast("long"))
    end = F.coalesce("x.end_ms", F.bround(F.col("x.end") * 1000).cast("long"))
    over = end - F.col("duration_ms")
    clipped = F.when((over > 0) & (over <= tolerance_ms), F.col("duration_ms")).otherwise(end)
    text = F.trim(F.regexp_replace("x.text", r"\s+", " "))
    problem = F.when(F.coalesce(text, F.lit("")) == "", "empty_text").when(over > tolerance_ms, "duration_mismatch").when(~F.coalesce(clipped > start, F.lit(False)), "invalid_interval").when(over > 0, "timestamp_clip")
    return d.select("video_id", "model_version", "duration_ms", "source_span_index", start.alias("start_ms"), clipped.alias("end_ms"), text.alias("text_raw"), problem.alias("problem"))


def transcript_report(spans: DataFrame) -> DataFrame:
    """Counters of a conversion per model: files, spans, spans kept, spans with each problem, whole duration."""
    kept = F.col("problem").isNull() | (F.col("problem") == "timestamp_clip")
    per = spans.groupBy("model_version", "video_id").agg(F.max("duration_ms").alias("ms"), F.count("*").alias("n"), F.count_if(kept).alias("k"), *[F.count_if(F.col("problem") == p).alias(p) for p in PROBLEMS])
    return per.groupBy("model_version").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_spans"), F.sum("k").alias("n_kept"), F.sum("ms").alias("duration_ms"), *[F.sum(p).alias(f"n_{p}") for p in PROBLEMS])


PROBLEMS = ("empty_text", "invalid_interval", "duration_mismatch", "timestamp_clip")


def read_frame_map(spark: SparkSession, path: str) -> DataFrame:
    """The organiser's CSV n,pts_time,fps,frame_idx; video from the file name."""
    return spark.read.schema(FRAME_MAP).csv(path, header=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)\.csv$", 1).alias("video_id"), "*")


def read_answers(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken rows with their text) of an answer CSV."""
    df = spark.read.schema(f"{schema}, _broken string").csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", quote='"', escape='"')
    rows = stage(df, "answers")  # Spark refuses to read the column of broken rows alone from raw files
    return rows.filter("_broken is null").drop("_broken"), rows.filter("_broken is not null").select("_broken")


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Path, size and time of all files below a folder with one of the suffixes; contents are not read."""
    ok = F.lower("path").rlike(r"\.(" + "|".join(s.lstrip(".") for s in suffixes) + ")$")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime").filter(ok)


def index_keyframes(spark: SparkSession, root: str) -> DataFrame:
    """Keyframe images: video and number from the path, key; numbers that come twice are kept for `repeated_keys`."""
    f = list_files(spark, root, (".jpg", ".webp", ".png"))
    part = lambda i: F.regexp_extract("path", r"([^/]+)/(?:kf_)?0*(\d+)\.\w+$", i)
    return f.select(part(1).alias("video_id"), part(2).cast("long").alias("keyframe_no"), F.col("path").alias("object_key"))


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Images below a folder with their place in natural order of the path."""
    f = list_files(spark, root, (".jpg", ".jpeg", ".png", ".webp"))
    return numbered(f.select("path", "length"), [natural_key("path"), F.col("path")], "position")


def probe_files(paths: DataFrame, probe: Callable[[str], dict], ddl: str) -> tuple[DataFrame, DataFrame]:
    """(what `probe` says of each path, failures): paths has a column path; a probe that raises gives a failure without secrets."""
    fields = T._parse_datatype_string(ddl).fieldNames()

    def run(batches):
        import json

        import pyarrow as pa

        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                try:
                    out.append((path, json.dumps({k: v for k, v in probe(path).items() if k in fields}), None))
                except Exception as e:  # a file that cannot be read must not end the others
                    out.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["path", "doc", "error"])

    rows = stage(paths.select("path").mapInArrow(run, "path string, doc string, error string"), "probes")
    good = rows.filter("error is null").select("path", F.from_json("doc", ddl).alias("x")).select("path", "x.*")
    return good, rows.filter("error is not null").select(without_secrets("path").alias("source"), without_secrets("error").alias("error"))


def read_vectors(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """Matrices as .npy files: path, row and float32 vector. A task reads its file in slices of rows, so a matrix may be of any size."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name in b.column(0).to_pylist():
                with files_io.open_file(name) as f:
                    version = np.lib.format.read_magic(f)
                    shape, by_column, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                    if by_column or len(shape) != 2 or kind.hasobject:
                        raise ValueError(f"no matrix in rows: {name}")
                    step = shape[1] * kind.itemsize
                    for at in range(0, shape[0], rows):
                        n = min(rows, shape[0] - at)
                        m = np.frombuffer(f.read(n * step), kind).reshape(n, shape[1]).astype(np.float32)
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * shape[1], pa.int32()), pa.array(m.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), flat], ["path", "embedding_row_index", "vector"])

    files = list_files(spark, path, (".npy",)).select("path")
    return files.mapInArrow(run, "path string, embedding_row_index long, vector array<float>")


def ranked_json(df: DataFrame, column: str, element: str) -> DataFrame:
    """A JSON array column as rows with their 1-based rank."""
    rest = [c for c in df.columns if c != column]
    x = df.select(*rest, F.posexplode(F.from_json(column, f"array<{element}>")).alias("pos", "x"))
    return x.select(*rest, (F.col("pos") + 1).alias("rank"), "x.*")


def terms(spark: SparkSession, words: list[str]) -> DataFrame:
    """A term array as rows."""
    return spark.createDataFrame([(w,) for w in words], "term string")


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """A keyframe manifest for embedding: rows with an image that are eligible and selected, where it says so."""
    df = read_table(spark, path)
    for flag in ("eligible_for_embedding", "selected_for_retrieval"):
        if flag in df.columns:
            df = df.filter(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    return df.filter(F.col("video_id").isNotNull() & (F.length(F.trim("path")) > 0))
