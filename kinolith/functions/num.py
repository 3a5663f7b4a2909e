"""Clocks, scores and ids: exact rational time and the small formulas of ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fps_fraction(c: str | Column) -> Column:
    """num and den of '30000/1001' or '25'; null if it is neither or not positive."""
    c = F.trim(_col(c))
    num = F.regexp_extract(c, r"^(\d+)(?:/(\d+))?$", 1).try_cast("long")
    den = F.coalesce(F.nullif(F.regexp_extract(c, r"^(\d+)(?:/(\d+))?$", 2), F.lit("")).try_cast("long"), F.lit(1).cast("long"))
    return F.when((num > 0) & (den > 0), F.struct(num.alias("num"), den.alias("den")))


def frame_to_ms(frame: str | Column, num: str | Column, den: str | Column) -> Column:
    """Exact time of a frame, 3 places, half to even; integers until the last division."""
    return F.bround(_col(frame) * _col(den) * 1000.0 / _col(num), 3)


def ms_to_frame(ms: str | Column, num: str | Column, den: str | Column, frames: str | Column) -> Column:
    """Nearest frame of a time, clamped to the timeline."""
    at = F.bround(_col(ms) * _col(num) / (_col(den) * 1000.0)).cast("long")
    return F.greatest(F.lit(0), F.least(at, _col(frames) - 1))


def frame_ms_rounded(frame: str | Column, fps: str | Column) -> Column:
    """round(frame / fps * 1000), null at 0 fps."""
    return F.round(_col(frame) / F.nullif(_col(fps), F.lit(0.0)) * 1000).cast("long")


def half_up_ms(num: Column, den: Column) -> Column:
    """num*1000/den to the nearest millisecond, half up, in integers."""
    return F.floor((num * 2000 + den) / (den * 2)).cast("long")


def seconds_to_ms(s: str | Column) -> Column:
    return F.bround(_col(s) * 1000).cast("long")


def quality_value(blur: str | Column, contrast: str | Column, entropy: str | Column) -> Column:
    return F.log1p(_col(blur)) + F.log1p(_col(contrast)) + _col(entropy)


def target_proximity(distance: str | Column) -> Column:
    return 1 / (1 + F.abs(_col(distance)))


def log_confidence(c: str | Column) -> Column:
    """exp of a log probability, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(_col(c))))


def rerank_multiplier(score: str | Column, weight: float) -> Column:
    return F.greatest(F.lit(0.1), 1 + ((_col(score) - 50) / 50) * weight)


def transition_multiplier(ms: str | Column) -> Column:
    """How plausible a step between two events of a sequence is."""
    m = _col(ms)
    return F.when(m < 400, 0.5).when(m.between(1_000, 120_000), 1.2).when(m > 900_000, 0.8).otherwise(1.0)


def percent(at: str | Column, whole: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(_col(at) / F.nullif(_col(whole), F.lit(0)) * 100, F.lit(0.0))))


def stable_id(prefix: str, *parts: str | Column) -> Column:
    """prefix_ and 32 hex digits of the SHA-256 of the parts joined by the unit separator; null parts are empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, 32))


def candidate_key(video: str | Column, frame: str | Column, start: str | Column, end: str | Column) -> Column:
    """Frame key, or time key where no frame is known."""
    time = F.concat_ws(":", _col(video), F.lit("time"), _col(start).cast("string"), _col(end).cast("string"))
    return F.when(_col(frame).isNotNull(), F.concat_ws(":", _col(video), F.lit("frame"), _col(frame).cast("string"))).otherwise(time)


def modality(branch: str | Column) -> Column:
    """What a branch searches: clip is the embedding, ocr_ and asr_ branches are text and speech, others are what they are called."""
    b = _col(branch)
    return F.when(b == "clip", "embedding").when(b.startswith("ocr_"), "ocr").when(b.startswith("asr_"), "asr").otherwise(b)


def quality_gate(brightness: str | Column, contrast: str | Column, blur: str | Column, low: float = 15, high: float = 240, least_contrast: float = 10, least_blur: float = 100) -> Column:
    """Why a frame fails, in the order brightness, information, blur; 'ok' if it does not."""
    b = _col(brightness)
    return F.when((b < low) | (b > high) | b.isNull(), "brightness").when(~(_col(contrast) >= least_contrast), "low_info").when(~(_col(blur) >= least_blur), "blur").otherwise("ok")


def quality_tier(brightness: str | Column, blur: str | Column, contrast: str | Column) -> Column:
    """low, medium or high by brightness, contrast and sharpness; NaN counts as 0, null where one is null."""
    b, s, c = (F.nanvl(_col(x).cast("double"), F.lit(0.0)) for x in (brightness, blur, contrast))
    tier = F.when((b < 10) | (b > 245) | (c < 5), "low").when(s < 30, "medium").otherwise("high")
    return F.when(b.isNotNull() & s.isNotNull() & c.isNotNull(), tier)


def audio_ready(confidence: str | Column, mos: str | Column) -> Column:
    """ready (confidence >= 0.60 and a mean opinion score, where there is one from 0 to 5, >= 2.5; null without a confidence) and suggestions."""
    c, m = _col(confidence), F.when(_col(mos).between(0, 5), _col(mos))
    says = F.array(F.when(c < 0.60, "confidence thấp"), F.when(m < 2.5, "chất lượng âm thanh thấp"))
    return F.struct((F.when(c.isNotNull(), (c >= 0.60) & F.coalesce(m >= 2.5, F.lit(True)))).alias("ready"), F.array_compact(says).alias("suggestions"))


def normalised_box(box: str | Column, width: str | Column, height: str | Column) -> Column:
    """[x1,y1,x2,y2] over the image's size; null unless 0 <= x1 < x2 <= width and likewise for y."""
    b = _col(box)
    w, h = _col(width), _col(height)
    ok = (F.size(b) == 4) & (b[0] >= 0) & (b[1] >= 0) & (b[0] < b[2]) & (b[1] < b[3]) & (b[2] <= w) & (b[3] <= h)
    return F.when(ok, F.array(b[0] / w, b[1] / h, b[2] / w, b[3] / h))


def running_cost(seconds: str | Column, rate_per_hour: float) -> Column:
    return _col(seconds) * rate_per_hour / 3600


def member_ids(c: str | Column) -> Column:
    """Sorted distinct ids of a JSON array, a comma list or a single number."""
    c = F.trim(_col(c))
    parts = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, r"\s*,\s*"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: x.try_cast("long")), lambda x: x.isNotNull())))


def over_budget(cost: str | Column, budget: float) -> Column:
    """Whether a running cost has passed the budget."""
    return _col(cost) > budget


def upscale_factor(height: str | Column, least: float, factor: float, most: float) -> Column:
    """How much a small crop is enlarged: 1 from `least` pixels on, else what is needed or asked for, at most `most`."""
    h = _col(height)
    return F.when((h <= 0) | (h >= least), 1.0).otherwise(F.least(F.lit(float(most)), F.greatest(F.lit(1.0), least / h, F.lit(float(factor)))))


def relevance(answer: str | Column) -> Column:
    """score (0 to 100, 50 where there is none), match (from 50 on, unless said) and reason of a model's JSON answer."""
    from kinolith.functions.text import model_json

    x = model_json(answer, "score double, match boolean, reason string")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(F.coalesce(F.nanvl(x["score"], F.lit(50.0)), F.lit(50.0)) + 0.5)))
    said = F.nullif(F.trim(x["reason"]), F.lit(""))
    ok = F.struct(score.cast("int").alias("score"), F.coalesce(x["match"], score >= 50).alias("match"), F.coalesce(said, F.lit("Evaluated by VLM")).alias("reason"))
    return F.when(x.isNull(), F.struct(F.lit(50).alias("score"), F.lit(False).alias("match"), F.lit("Failed to parse VLM response").alias("reason"))).otherwise(ok)


def valid_words(words: str | Column) -> Column:
    """Timed words (text, start and end in seconds, prob) as text, start_ms, end_ms, confidence; without text or length they go."""
    ms = lambda s: F.bround(F.coalesce(s, F.lit(0.0)) * 1000).cast("long")
    timed = F.transform(_col(words), lambda w: F.struct(F.trim(w["text"]).alias("text"), ms(w["start"]).alias("start_ms"), ms(w["end"]).alias("end_ms"), F.coalesce(w["prob"], F.lit(0.0)).alias("confidence")))
    return F.filter(timed, lambda w: (F.coalesce(F.length(w["text"]), F.lit(0)) > 0) & (w["end_ms"] > w["start_ms"]))


def span_confidence(own: str | Column, words: str | Column, fallback: str | Column) -> Column:
    """A span's own confidence, else the mean of its words, else the one of all, else 0."""
    w = _col(words)
    mean = F.when(F.size(w) > 0, F.aggregate(w, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size(w))
    return F.coalesce(_col(own), mean, _col(fallback), F.lit(0.0))


def ordered_quad(points: str | Column) -> Column:
    """Four corners as top left, top right, bottom right, bottom left: least and greatest sums and differences, first of ties."""
    p = _col(points)
    of = lambda key: F.array_sort(F.transform(p, lambda q, i: F.struct(key(q).alias("k"), i.alias("i"), q.alias("q"))))[0]["q"]
    return F.array(of(lambda q: q[0] + q[1]), of(lambda q: q[1] - q[0]), of(lambda q: -(q[0] + q[1])), of(lambda q: q[0] - q[1]))


def box_route(text: str | Column, score: str | Column, least: float, second: str | Column) -> Column:
    """What a read box becomes: accepted by its score; else the second reader's text; else the first text, not accepted; null without text."""
    bare = lambda c: F.nullif(F.trim(F.regexp_replace(_col(c), r"\s+", " ")), F.lit(""))
    first, other, s = bare(text), bare(second), F.round(_col(score), 6)
    box = lambda t, source, accepted, confidence: F.struct(t.alias("text"), F.lit(source).alias("source"), F.lit(accepted).alias("accepted"), confidence.cast("double").alias("confidence"))
    return F.when(first.isNotNull() & (s >= least), box(first, "paddle", True, s)).when(other.isNotNull(), box(other, "vlm", True, F.lit(None))).when(first.isNotNull(), box(first, "paddle", False, s))


#: Signals that are not shown.
HIDDEN_MODALITIES = ["embedding", "visual"]


def shown_modalities(names: str | Column) -> Column:
    """Matched modalities as a label."""
    return F.array_join(F.filter(_col(names), lambda m: ~m.isin(HIDDEN_MODALITIES)), " · ")


def moved(items: str | Column, source: str | Column, target: str | Column) -> Column:
    """An array with the item at one place (from 0) put at another; as it is if a place does not exist."""
    a, s, t = _col(items), _col(source), _col(target)
    ok = (s >= 0) & (s < F.size(a)) & (t >= 0) & (t < F.size(a)) & (s != t)
    rest = F.filter(a, lambda x, i: i != s)
    return F.when(ok, F.concat(F.slice(rest, 1, t), F.array(F.get(a, s)), F.slice(rest, t + 1, F.size(a)))).otherwise(a)


def gray_metrics(pixels: str | Column, width: str | Column) -> Column:
    """brightness, contrast, entropy (bits) and blur (variance of the Laplacian, edges mirrored) of an 8-bit gray image in rows;
    null without a whole row. Runs as an Arrow function on the image bytes."""
    kind = pa.struct([(c, pa.float64()) for c in ("brightness", "contrast", "entropy", "blur")])

    def one(raw: bytes | None, w: int | None) -> dict | None:
        if not raw or not w or w < 1 or len(raw) < w:
            return None
        g = np.frombuffer(raw, np.uint8)[: len(raw) // w * w].reshape(-1, w).astype(float)
        p = np.bincount(g.astype(np.uint8).ravel(), minlength=256) / g.size
        p = p[p > 0]
        m = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
        lap = m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:] - 4 * g
        return {"brightness": g.mean(), "contrast": g.std(), "entropy": float(-(p * np.log2(p)).sum()), "blur": lap.var()}

    @F.arrow_udf("struct<brightness:double,contrast:double,entropy:double,blur:double>")
    def run(x: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array([one(a, b) for a, b in zip(x.to_pylist(), w.to_pylist())], kind)

    return run(_col(pixels), _col(width))


def run_status(ok: str | Column) -> Column:
    """Aggregate: completed, partial or failed, from whether each stage succeeded."""
    o = F.coalesce(_col(ok), F.lit(False))
    return F.when(F.bool_and(o), "completed").when(F.bool_or(o), "partial").otherwise("failed")


def dhash(pixels: str | Column, width: str | Column) -> Column:
    """64-bit difference hash of an 8-bit gray image in rows: means of 8 x 9 areas, a bit where the right one is brighter; null if smaller."""

    def one(raw: bytes | None, w: int | None) -> int | None:
        if not raw or not w or w < 9 or len(raw) < 8 * w:
            return None
        g = np.frombuffer(raw, np.uint8)[: len(raw) // w * w].reshape(-1, w).astype(float)
        rows, cols = np.linspace(0, g.shape[0], 9).astype(int)[:-1], np.linspace(0, w, 10).astype(int)[:-1]
        sums = np.add.reduceat(np.add.reduceat(g, rows, axis=0), cols, axis=1)
        size = np.diff(np.r_[rows, g.shape[0]])[:, None] * np.diff(np.r_[cols, w])[None, :]
        m = sums / size
        bits = (m[:, 1:] > m[:, :-1]).ravel()
        n = int("".join("1" if b else "0" for b in bits), 2)
        return n - (1 << 64) if n >> 63 else n

    @F.arrow_udf("long")
    def run(x: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array([one(a, b) for a, b in zip(x.to_pylist(), w.to_pylist())], pa.int64())

    return run(_col(pixels), _col(width))
