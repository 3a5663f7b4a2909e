"""Keyframe curation and mapping jobs: targets to frames, alias tables, map-based refresh, releases, provenance, inference windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.functions import num
from kinolith.operators import mapping, selection, temporal, timeline
from kinolith.operators.skew import scan_entity
from kinolith.session import stage, width

FRAME = "original_frame_id"


def shot_causes(shots: DataFrame, frames: DataFrame, signals: dict[str, tuple[float, int, int]], rate: float = 25.0) -> DataFrame:
    """video_id, shot_id, target_id, roles: why a frame is asked for, with the shot's bounds start_frame and end_frame.

    Roles: `anchor` (the frame nearest to each target time of the shot), `first` and `last` frame of the shot, and
    `peak_<signal>` (greedy peaks: least score, number, distance). frames: video_id, original_frame_id, t (ms), signals."""
    bounds = ["start_frame", "end_frame"]
    inside = stage(timeline.frames_in_shots(frames, shots), "inside")
    times = timeline.shot_targets(F.col("start_frame") / rate, (F.col("end_frame") + 1) / rate)
    targets = shots.select("video_id", "shot_id", F.explode(times).alias("s")).select("video_id", "shot_id", (F.col("s") * 1000).alias("target"))
    snapped = timeline.snap_targets(targets, inside, ["video_id", "shot_id"], "t", "target").filter(f"{FRAME} is not null")
    parts = [snapped.select("video_id", "shot_id", F.col(FRAME).alias("target_id"), F.lit("anchor").alias("role"))]
    edges = inside.groupBy("video_id", "shot_id").agg(F.min(FRAME).alias("first"), F.max(FRAME).alias("last"))
    parts += [edges.select("video_id", "shot_id", F.col(r).alias("target_id"), F.lit(r).alias("role")) for r in ("first", "last")]
    for name, (least, limit, distance) in signals.items():
        peaks = temporal.top_peaks(inside.select("video_id", "shot_id", FRAME, name), ["video_id", "shot_id"], FRAME, name, least, distance, limit)
        parts.append(peaks.select("video_id", "shot_id", F.col(FRAME).alias("target_id"), F.lit(f"peak_{name}").alias("role")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("video_id", "shot_id", "target_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return out.join(shots.select("video_id", "shot_id", *bounds), ["video_id", "shot_id"])


def selected_frames(causes: DataFrame, frames: DataFrame, radius: int) -> DataFrame:
    """The frames chosen around the targets, passing ones only: video_id, original_frame_id, shot_ids, roles and the number of targets.

    frames: video_id, original_frame_id, ok, blur_score, contrast_score."""
    chosen = timeline.best_in_radius(causes.select("video_id", F.col("target_id").alias(FRAME), "shot_id", "roles", "start_frame", "end_frame"), frames, radius, bounds=("start_frame", "end_frame"), keep=["shot_id", "roles"])
    good = chosen.join(frames.filter("ok").select("video_id", F.col(FRAME).alias("chosen_id")), ["video_id", "chosen_id"], "left_semi")
    return good.groupBy("video_id", F.col("chosen_id").alias(FRAME)).agg(
        F.array_sort(F.collect_set("shot_id")).alias("shot_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("roles"), F.count("*").alias("n_targets")
    )


def inference_windows(frames: DataFrame, size: int = 100, keep: int = 50) -> DataFrame:
    """Which frames a shot model sees at once and what it keeps: video_id, original_frame_id, place, window_id, offset, kept.

    Windows of `size` start every `keep` places on a timeline with `(size - keep) / 2` repeated frames before and after it, and
    the middle `keep` predictions count, so each frame is kept by exactly one window."""
    pad = (size - keep) // 2
    p = scan_entity(frames.select("video_id", FRAME), ["video_id"], FRAME, {"place": ("sum", F.lit(1))}).withColumn("place", F.col("place") - 1)
    first = F.greatest(F.lit(0), F.floor((F.col("place") + pad - size) / keep) + 1)
    n = p.groupBy("video_id").agg((F.floor(F.max("place") / keep)).alias("last_"))
    w = p.join(n, "video_id").withColumn("window_id", F.explode(F.sequence(first, F.least(F.col("last_"), F.floor((F.col("place") + pad) / keep)))))
    offset = F.col("place") + pad - F.col("window_id") * keep
    return w.select("video_id", FRAME, "place", "window_id", offset.alias("offset"), ((offset >= pad) & (offset < pad + keep)).alias("kept"))


def alias_rows(manifest: DataFrame, images: DataFrame, bucket: str) -> tuple[DataFrame, DataFrame]:
    """(alias rows, violations) of a keyframe manifest.

    manifest: video_id, keyframe_no, source_frame_idx, candidate_id, timestamp_ms, source_map_file, source_row_index; images:
    video_id, keyframe_no, object_key. Violations: `repeated` key, `video`, `keyframe_no` below 1, `source_frame_idx` below 0,
    `candidate` (differs from the source), `image` (none). Good rows get their address, place among the aliases of their
    frame, and the metadata as JSON with sorted keys."""
    m = manifest.withColumn("video_id", F.trim("video_id")).withColumn("rows_", F.count("*").over(Window.partitionBy("video_id", "keyframe_no")))
    m = m.join(images.groupBy("video_id", "keyframe_no").agg(F.min("object_key").alias("object_key")), ["video_id", "keyframe_no"], "left")
    rules = {
        "repeated": F.col("rows_") == 1, "video": F.length("video_id") > 0, "keyframe_no": F.col("keyframe_no") >= 1, "source_frame_idx": F.col("source_frame_idx") >= 0,
        "candidate": F.col("candidate_id").isNull() | (F.col("candidate_id") == F.col("source_frame_idx")), "image": F.col("object_key").isNotNull(),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    m = m.withColumn("broken_", broken)
    good = m.filter(F.size("broken_") == 0)
    w = Window.partitionBy("video_id", "source_frame_idx")
    good = good.withColumn("duplicate_group_size", F.count("*").over(w)).withColumn("duplicate_occurrence_ordinal", F.row_number().over(w.orderBy("keyframe_no", "source_row_index")))
    names = sorted(["duplicate_group_size", "duplicate_occurrence_ordinal", "source_frame_idx", "source_map_file", "source_row_index"])
    out = good.select(
        "video_id", "keyframe_no", F.col("source_frame_idx").alias(FRAME), "timestamp_ms", F.col("object_key").alias("thumbnail_object_key"),
        F.concat(F.lit(f"r2://{bucket}/"), "object_key").alias("storage_uri"), F.to_json(F.struct(*names)).alias("metadata"),
    )
    return out, m.select("video_id", "keyframe_no", F.explode("broken_").alias("violation"))


def canonical_rows(aliases: DataFrame) -> DataFrame:
    """One row per frame from its aliases: that of the lowest keyframe number, the number of aliases and their source maps."""
    rest = ["keyframe_no", "timestamp_ms", "thumbnail_object_key", "storage_uri"]
    maps = F.array_sort(F.collect_set(F.get_json_object("metadata", "$.source_map_file")))
    g = aliases.groupBy("video_id", FRAME).agg(F.min_by(F.struct(*rest), "keyframe_no").alias("x"), F.count("*").alias("alias_count"), maps.alias("source_map_files"))
    return g.select("video_id", FRAME, *[f"x.{c}" for c in rest], "alias_count", "source_map_files")


def with_fields(text: str | Column, fields: dict[str, Column]) -> Column:
    """A JSON object with further fields, keys sorted; null or no object counts as empty."""

    @F.arrow_udf("string")
    def run(old: pa.Array, new: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(old.to_pylist(), new.to_pylist()):
            try:
                held = json.loads(a or "{}")
            except ValueError:
                held = {}
            out.append(json.dumps((held if isinstance(held, dict) else {}) | b, ensure_ascii=False, sort_keys=True))
        return pa.array(out, pa.string())

    return run(F.col(text) if isinstance(text, str) else text, F.struct(*[v.alias(k) for k, v in fields.items()]))


def refresh_aliases(aliases: DataFrame, resolved: DataFrame, status: str = "resolved") -> DataFrame:
    """Aliases with the frame and time of a map (video_id, keyframe_no, frame, ms), one to one; the old time goes to the metadata."""
    j = mapping.merge_checked(aliases, resolved, ["video_id", "keyframe_no"], one_to_one=True)
    meta = with_fields("metadata", {"source_timestamp_ms_candidate": F.col("timestamp_ms"), "canonical_timestamp_ms": F.col("ms"), "mapping_status": F.lit(status)})
    return j.withColumn("metadata", meta).withColumn(FRAME, F.col("frame")).withColumn("timestamp_ms", F.col("ms")).select(*aliases.columns)


def resolve_artifacts(source_map: DataFrame, frames: DataFrame, artifacts: dict[str, DataFrame], aliases: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(artifacts and aliases with the frames of a source map, index of the map per video).

    source_map: video_id, keyframe_no, source_frame_idx; frames: video_id, original_frame_id, timestamp_ms. Every mapped
    frame must exist and every artifact row (video_id, keyframe_no) must be mapped, else `KeyViolation`."""
    f = frames.select("video_id", F.col(FRAME).alias("source_frame_idx"), F.round("timestamp_ms").cast("long").alias("ms"))
    resolved = stage(mapping.merge_checked(source_map, f, ["video_id", "source_frame_idx"]).select("video_id", "keyframe_no", F.col("source_frame_idx").alias("frame"), "ms"), "resolved")
    index = resolved.groupBy("video_id").agg(
        F.count("*").alias("n"), F.countDistinct("frame").alias("n_frames"), F.min("frame").alias("first_id"), F.max("frame").alias("last_id"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")
    )
    out = {}
    for name, a in artifacts.items():
        j = mapping.merge_checked(a.drop(FRAME, "timestamp_ms"), resolved, ["video_id", "keyframe_no"])
        out[name] = j.withColumnsRenamed({"frame": FRAME, "ms": "timestamp_ms"})
    out["aliases"] = refresh_aliases(aliases, resolved)
    return out, index


def staged_release(releases: DataFrame, features: DataFrame, version: str, dataset: str, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(releases, features) with a release in state `staged`: an existing one stays as it is; its features are replaced by modality.

    releases: index_version, dataset_version, status; features: index_version, modality, dataset_version, feature_set_id; sets: modality, feature_set_id."""
    new = releases.sparkSession.createDataFrame([(version, dataset, "staged")], "index_version string, dataset_version string, status string")
    rows = sets.select(F.lit(version).alias("index_version"), "modality", F.lit(dataset).alias("dataset_version"), "feature_set_id")
    return mapping.insert_absent(releases, new, ["index_version"]), mapping.upsert(features, rows, ["index_version", "modality"])


def active(rows: DataFrame, releases: DataFrame, version: str | None = None) -> DataFrame:
    """Rows of active releases (of one, if given): a semi join on index and dataset version; releases are few and joined by size."""
    live = releases.filter("status = 'active'")
    live = live if version is None else live.filter(F.col("index_version") == version)
    return rows.join(live.select("index_version", "dataset_version").distinct(), ["index_version", "dataset_version"], "left_semi")


def dense_windows(windows: DataFrame, scores: DataFrame, signals: DataFrame, weights: dict[str, float], done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen frame per event window, violations): scores must cover each window's frames once, then the weighted choice.

    windows: event_window_id, video_id, start_frame, end_frame (not included), fingerprint; done: event_window_id and
    fingerprint of windows that need no work. signals: video_id, original_frame_id and the further weighted columns."""
    todo = windows if done is None else mapping.pending(windows, done, ["event_window_id"], "fingerprint")
    good, bad = timeline.event_scores(todo, scores)
    j = good.withColumnRenamed("score", "external").join(signals, ["video_id", FRAME])
    mid = todo.select("event_window_id", "video_id", ((F.col("start_frame") + F.col("end_frame") - 1) / 2).alias("mid_"))
    j = j.join(mid, ["event_window_id", "video_id"]).withColumn("target", num.target_proximity(F.col(FRAME) - F.col("mid_"))).drop("mid_")
    return timeline.weighted_choice(j, ["event_window_id", "video_id"], weights), bad


def provenance(sources: DataFrame, importer: str) -> tuple[DataFrame, DataFrame]:
    """(feature sets, artifacts) of an import. sources: dataset_version, modality, producer, pipeline_version, uri, n_records, size_bytes, checksum."""
    s = sources.withColumn("feature_set_id", F.concat_ws(":", "dataset_version", num.stable_id("fs", "modality", "producer", "pipeline_version")))
    sets = s.groupBy("feature_set_id", "dataset_version", "modality", "producer", "pipeline_version").agg(F.sum("n_records").alias("n_records"), F.count("*").alias("n_artifacts"))
    artifacts = s.select(num.stable_id("artifact", "modality", "uri").alias("artifact_id"), "feature_set_id", "modality", "uri", "n_records", "size_bytes", "checksum", F.lit(importer).alias("importer"))
    return sets, artifacts


def distinct_manifest(images: DataFrame, video: str, name: str, hash_: str, sharpness: str, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(kept images in order of video and name, totals): compaction of each video's images in the order of their names."""
    kept = selection.compact_frames(images.select(video, name, hash_, sharpness), video, name, hash_, sharpness, most)
    kept = stage(kept.select(video, F.col(name).alias("filename"), F.concat_ws("/", video, name).alias("relative_path"), F.round(sharpness, 2).alias("blur_score")), "kept")
    totals = images.agg(F.count("*").alias("n_raw")).crossJoin(kept.agg(F.count("*").alias("n_kept")))  # a row each
    return kept, totals.withColumn("reduction_pct", F.when(F.col("n_raw") > 0, F.round(100 * (1 - F.col("n_kept") / F.col("n_raw")), 2)).otherwise(F.lit(0.0)))


def worst(df: DataFrame, by: str, n: int, key: str, greatest: bool = True) -> DataFrame:
    """The n rows with the greatest (or least) value, ties by the key."""
    return df.orderBy(F.col(by).desc_nulls_last() if greatest else F.col(by).asc_nulls_last(), key).limit(n)


def bounded_batches(df: DataFrame, order: list[Column], size: Column, most_bytes: int, most_rows: int) -> DataFrame:
    """Adds `batch`: rows in order, a batch closes before the row that would bring it over the bytes, or when it has its rows.

    A row larger than the bound is a batch of its own; a null size counts as the whole bound. The rows are cut into ranges of
    the order. Where the first batch border of a range lies depends on the ranges before it, but it is within its first
    `most_rows` + 1 rows, so each range tells for every such place how its last batch ends; one small fold over the ranges then
    fixes the borders, and each range is numbered in its own task."""
    if most_bytes < 1 or most_rows < 1:
        raise ValueError("bounds must be at least 1")
    spark = df.sparkSession
    r = df.withColumn("size_", F.coalesce(size.cast("long"), F.lit(most_bytes).cast("long"))).repartitionByRange(*order).sortWithinPartitions(*order)
    r = stage(r.withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id()), "ranges")
    slim = r.select("part_", "at_", "size_").repartition(width(spark), "part_").sortWithinPartitions("part_", "at_")

    def borders(sizes: list[int]) -> list[int]:
        """For each row the first row of the batch after the one that starts there."""
        out, end, held = [0] * len(sizes), 0, 0
        for i, s in enumerate(sizes):
            if end <= i:
                end, held = i + 1, s
            while end < len(sizes) and end - i < most_rows and held + sizes[end] <= most_bytes:
                held += sizes[end]
                end += 1
            out[i] = end
            held -= s
        return out

    def entry(sizes: list[int], n: int, held: int) -> int:
        """The first border in a range that begins with an open batch of n rows and so many bytes."""
        i = 0
        while n and i < len(sizes) and n < most_rows and held + sizes[i] <= most_bytes:
            n, held, i = n + 1, held + sizes[i], i + 1
        return i

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[int]]]:
        now, at, sizes = None, [], []
        for b in batches:
            for p, a, s in zip(*(c.to_pylist() for c in b.columns)):
                if p != now:
                    if now is not None:
                        yield now, at, sizes
                    now, at, sizes = p, [], []
                at.append(a)
                sizes.append(s)
        if now is not None:
            yield now, at, sizes

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, _, sizes in ranges(batches):
            after, n = borders(sizes), len(sizes)
            tail: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # from a border: batches begun, rows and bytes of the last
            for i in range(n - 1, -1, -1):
                if after[i] >= n:
                    tail[i] = (1, n - i, sum(sizes[i:]))
                else:
                    c, k, x = tail[after[i]]
                    tail[i] = (c + 1, k, x)
            head = sizes[: most_rows + 1]
            ends = tail[: len(head) + 1]
            yield pa.RecordBatch.from_pydict({"part_": [p], "n": [n], "total": [sum(sizes)], "head": [head], "ends": [[y for e in ends for y in e]]}, pa.schema([("part_", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("head", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, rows, held = 0, 0, 0  # batches begun so far, rows and bytes of the open one
        for b in batches:
            for p, n, total, head, ends in zip(*(c.to_pylist() for c in b.columns)):
                first = entry(head, rows, held)
                yield pa.RecordBatch.from_pydict({"part_": [p], "first": [first], "done": [done]}, pa.schema([("part_", pa.int32()), ("first", pa.int64()), ("done", pa.int64())]))
                if first >= n:
                    rows, held, done = rows + n, held + total, max(done, 1)
                else:
                    c, rows, held = ends[3 * first : 3 * first + 3]
                    done += c

    tops = slim.mapInArrow(summaries, "part_ int, n long, total long, head array<long>, ends array<long>")
    starts = stage(tops.repartition(1).sortWithinPartitions("part_").mapInArrow(fold, "part_ int, first long, done long"), "starts")  # a row per range

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, at, sizes, first, done in with_start(batches):
            after, batch, border = borders(sizes), done - 1, first
            out = []
            for i in range(len(sizes)):
                if i == border:
                    batch, border = batch + 1, after[i]
                out.append(batch)
            yield pa.RecordBatch.from_pydict({"part_": [p] * len(at), "at_": at, "batch": out}, pa.schema([("part_", pa.int32()), ("at_", pa.int64()), ("batch", pa.int64())]))

    def with_start(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        kept: dict[int, tuple[int, int]] = {}

        def plain() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p, f, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    kept[p] = (f, n)
                yield b.select(["part_", "at_", "size_"])

        for p, at, sizes in ranges(plain()):
            yield p, at, sizes, *kept[p]

    numbered = slim.join(starts, "part_").select("part_", "at_", "size_", "first", "done").repartition(width(spark), "part_").sortWithinPartitions("part_", "at_")
    return r.join(numbered.mapInArrow(number, "part_ int, at_ long, batch long"), ["part_", "at_"]).drop("part_", "at_", "size_")
