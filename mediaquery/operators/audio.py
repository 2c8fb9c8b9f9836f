"""Audio features over (key, idx, sample) rows.

Samples are reduced to hop-sized partial sums before the first shuffle; every later step runs on
frames, in chunks with halos, so a single long track spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaquery.functions import scoring
from mediaquery.functions.ordered import BIN, exact_percentiles, ordered_scan, with_halo
from mediaquery.session import cut_lineage

CHUNK = 65_536
#: Rows gathered, and frames laid out, before the chunks among them are walked at once.
BLOCK = 1 << 16
CELLS = 1 << 20
# Bounds of the audio types, and needles (substring match) behind each tag group.
FAINT_MUSIC, CLEAR_MUSIC, SPEECH_ALONE, SPEECH_OVER_MUSIC, RAPPED, SUNG, DENSE_TEXT, LYRIC_DISCOUNT = 0.12, 0.20, 0.25, 0.30, 0.15, 0.15, 0.8, 0.8
TAG_GROUPS = {
    "music": ("music", "musical instrument"),
    "singing": ("singing", "choir", "vocal music"),
    "rap": ("rap", "hip hop"),
    "speech": ("speech", "narration", "conversation"),
}


@dataclass(frozen=True)
class Framing:
    """Sample rate with frame and hop length; the defaults are those of full-rate analysis."""

    sample_rate: int = 22_050
    frame_seconds: float = 0.093
    hop_seconds: float = 0.023

    @property
    def frame(self) -> int:
        return max(1, int(self.frame_seconds * self.sample_rate))

    @property
    def hop(self) -> int:
        return max(1, int(self.hop_seconds * self.sample_rate))

    @property
    def frame_rate(self) -> float:
        return self.sample_rate / self.hop

    @property
    def lags(self) -> tuple[int, int]:
        low = max(1, int(self.frame_rate * 60.0 / 180.0))
        return low, max(low + 1, int(self.frame_rate * 60.0 / 60.0))


def loudness(samples: DataFrame, keys: Sequence[str], max_amp: float = 1.0) -> DataFrame:
    x = F.col("sample") / max_amp
    return samples.groupBy(*keys).agg(
        (20 * F.log10(F.sqrt(F.avg(x * x)))).alias("mean_db"), (20 * F.log10(F.max(F.abs(x)))).alias("peak_db"))


def adaptive_mix(
    voice: DataFrame, music: DataFrame, on: Sequence[str], *, voice_target: float = -16.0, peak_ceiling: float = -1.0,
    music_target: float = -20.0, margin: float = 12.0,
) -> DataFrame:
    """Gains of a voice and a music bed from their loudness rows, with the ducking below the voice."""
    v = voice.select(*on, F.col("mean_db").alias("vm"), F.col("peak_db").alias("vp"))
    m = music.select(*on, F.col("mean_db").alias("mm"))
    voice_gain = F.least(voice_target - F.col("vm"), peak_ceiling - F.col("vp"))
    music_gain = F.least(F.lit(0.0), music_target - F.col("mm"))
    duck = F.least(F.lit(0.0), F.col("vm") + voice_gain - margin - (F.col("mm") + music_gain))
    return v.join(m, list(on)).select(
        *on, F.round(voice_gain, 3).alias("voice_gain_db"), F.round(scoring.gain_to_volume(voice_gain), 6).alias("voice_volume"),
        F.round(music_gain, 3).alias("music_gain_db"), F.round(scoring.gain_to_volume(music_gain), 6).alias("music_volume"),
        F.round(duck, 3).alias("ducking_db"), F.round(scoring.gain_to_volume(music_gain + duck), 6).alias("ducked_volume"))


def hop_sums(samples: DataFrame, keys: Sequence[str], framing: Framing, max_amp: float = 1.0) -> DataFrame:
    """Sums of squares and counts of hop blocks (``frame_idx``) and of the block heads that end a frame (map-side combined)."""
    square = (F.col("sample") / max_amp) * (F.col("sample") / max_amp)
    head = F.col("idx") % framing.hop < framing.frame % framing.hop
    return samples.groupBy(*keys, F.floor(F.col("idx") / framing.hop).alias("frame_idx")).agg(
        F.sum(square).alias("__s"), F.count(F.lit(1)).alias("__n"),
        F.sum(F.when(head, square).otherwise(0.0)).alias("__hs"), F.sum(F.when(head, 1).otherwise(0)).alias("__hn"))


def frames_of_hops(blocks: DataFrame, keys: Sequence[str], framing: Framing, chunk: int = CHUNK) -> DataFrame:
    """Root mean square of the frames that start at each hop block: a run of whole blocks plus the head of the next one."""
    whole = framing.frame // framing.hop
    haloed = with_halo(blocks, "frame_idx", chunk, after=whole)
    order = W.partitionBy(*keys, BIN).orderBy("frame_idx")
    run = order.rowsBetween(0, whole - 1)
    total = (F.sum("__s").over(run) if whole else F.lit(0.0)) + F.coalesce(F.lead("__hs", whole).over(order), F.lit(0.0))
    count = (F.sum("__n").over(run) if whole else F.lit(0)) + F.coalesce(F.lead("__hn", whole).over(order), F.lit(0))
    framed = haloed.select(*keys, "frame_idx", "__own", total.alias("__t"), count.alias("__c"))
    return framed.where(F.col("__own") & ((F.col("__c") == framing.frame) | (F.col("frame_idx") == 0))).select(
        *keys, "frame_idx", F.sqrt(F.col("__t") / F.col("__c")).alias("rms"))


def frame_rms(samples: DataFrame, keys: Sequence[str], framing: Framing, max_amp: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """Root mean square of hopping frames.

    Each hop block is summed once; frames are runs of blocks, so no sample is copied to its overlapping frames.
    """
    return frames_of_hops(hop_sums(samples, keys, framing, max_amp), keys, framing, chunk)


def smooth(rows: DataFrame, keys: Sequence[str], column: str, radius: int, idx: str = "frame_idx", chunk: int = CHUNK) -> DataFrame:
    """Centred moving mean that shrinks at the ends of a track."""
    if radius <= 0:
        return rows
    haloed = with_halo(rows, idx, chunk, before=radius, after=radius)
    around = W.partitionBy(*keys, BIN).orderBy(idx).rowsBetween(-radius, radius)
    return haloed.withColumn(column, F.avg(column).over(around)).where("__own").select(*rows.columns)


def onset(frames: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Rise of log energy, smoothed over three frames."""
    haloed = with_halo(frames, "frame_idx", chunk, before=2, after=1)
    order = W.partitionBy(*keys, BIN).orderBy("frame_idx")
    energy = F.log1p(F.col("rms") * 100.0)
    rise = F.when(F.col("frame_idx") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), energy - F.lag(energy).over(order)))
    raw = haloed.withColumn("__r", F.when((F.col("frame_idx") == 0) | F.lag(F.lit(1)).over(order).isNotNull(), rise))
    return raw.withColumn("onset", F.avg("__r").over(order.rowsBetween(-1, 1))).where("__own").select(*frames.columns, "onset")


def estimate_bpm(onsets: DataFrame, keys: Sequence[str], framing: Framing, chunk: int = CHUNK) -> DataFrame:
    """Tempo from the first best positive lag of the centred autocorrelation, one row per key."""
    keys = list(keys)
    low, high = framing.lags
    means = onsets.groupBy(*keys).agg(F.avg("onset").alias("__m"), F.count(F.lit(1)).alias("n_frames"))
    centred = onsets.join(means, keys).select(*keys, "frame_idx", "n_frames", (F.col("onset") - F.col("__m")).alias("__x"))
    haloed = with_halo(centred, "frame_idx", max(chunk, high), after=high)
    order = W.partitionBy(*keys, BIN).orderBy("frame_idx")
    lags = range(low, high + 1)
    shifted = haloed.select(*keys, "n_frames", "__own", "__x", *[F.lead("__x", lag).over(order).alias(f"__l{lag}") for lag in lags])
    sums = shifted.where("__own").groupBy(*keys).agg(
        F.max("n_frames").alias("n_frames"), *[F.sum(F.col("__x") * F.col(f"__l{lag}")).alias(f"__c{lag}") for lag in lags])
    scored = F.array(*[F.struct(F.col(f"__c{lag}").alias("score"), F.lit(-lag).alias("back")) for lag in lags])
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))
    lag = F.when((F.col("n_frames") >= 4) & best.isNotNull(), -best["back"]).otherwise(0)
    found = sums.select(*keys, "n_frames", lag.alias("lag"), F.when(lag > 0, best["score"]).otherwise(0.0).alias("strength"))
    return found.withColumn("bpm", F.when(F.col("lag") > 0, 60.0 * framing.frame_rate / F.col("lag")).otherwise(0.0))


def local_peaks(onsets: DataFrame, keys: Sequence[str], quantile: float = 0.75, chunk: int = CHUNK) -> DataFrame:
    """Interior frames not below either neighbour nor below the track's percentile."""
    keys = list(keys)
    threshold = exact_percentiles(onsets, keys, "onset", {"__th": quantile})
    haloed = with_halo(onsets, "frame_idx", chunk, before=1, after=1)
    order = W.partitionBy(*keys, BIN).orderBy("frame_idx")
    near = haloed.withColumns({"__p": F.lag("onset").over(order), "__q": F.lead("onset").over(order)}).where("__own")
    shaped = near.where((F.col("onset") >= F.col("__p")) & (F.col("onset") >= F.col("__q")))
    return shaped.join(threshold, keys).where(F.col("onset") >= F.col("__th")).select(*onsets.columns)


def _next_beats(at: np.ndarray, value: np.ndarray, size: int, period: int, tolerance: int) -> np.ndarray:
    """For positions 0..size-1: the strongest peak around one period later, else that position itself."""
    strength = np.full(size + period + tolerance + 1, -1.0)
    strength[at] = value
    windows = np.lib.stride_tricks.sliding_window_view(strength, 2 * tolerance + 1)
    first = np.arange(size) + period - tolerance
    picked = windows[first]
    best = picked.argmax(axis=1)
    return np.where(picked.max(axis=1) >= 0, first + best, np.arange(size) + period)


def _walk_chunks(table: pa.Table, keys: Sequence[str], chunk: int) -> Iterator[pa.RecordBatch]:
    """Beats of a block of whole chunks, each from its entry; rows of a chunk are adjacent and ``__rn`` of its first is 1."""
    column = {c: table[c].to_numpy() for c in table.column_names if c not in keys}
    heads = np.flatnonzero(column["__rn"] == 1)
    ends = np.append(heads[1:], table.num_rows)
    base, p, total, entry = (column[c][heads].astype(np.int64) for c in (BIN, "period", "n_frames", "entry"))
    base = base * chunk
    tol, size = np.maximum(2, p // 3), np.minimum(chunk, total - base)
    cells = size + p + 2 * tol + 1  # positions a walk may look at, from ``tol`` before the chunk on
    block = (np.cumsum(cells) - 1) // CELLS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(heads)]
    for low, high in zip(cuts, cuts[1:]):
        part = slice(low, high)
        zero = np.cumsum(cells[part]) - cells[part] + tol[part]
        strength = np.full(int(cells[part].sum()), -1.0)
        rows = slice(heads[low], ends[high - 1])
        owner = np.repeat(np.arange(high - low), ends[part] - heads[part])
        at, value = column["frame_idx"][rows] - base[part][owner], column["onset"][rows]
        kept = (value >= 0) & (at < (size + p + tol)[part][owner])
        strength[zero[owner[kept]] + at[kept]] = value[kept]
        reach = np.arange(-int(tol[part].max()), int(tol[part].max()) + 1)
        live, where = np.arange(low, high), entry[part] - base[part]
        found_in, found_at = [], []
        while True:
            inside = (where >= 0) & (where < size[live])
            live, where = live[inside], where[inside]
            found_in.append(live)
            found_at.append(base[live] + where)
            on = base[live] + where + p[live] < total[live]
            live, target = live[on], where[on] + p[live[on]]
            if not len(live):
                break
            spots = np.clip((zero[live - low] + target)[:, None] + reach, 0, len(strength) - 1)
            near = np.where(np.abs(reach) <= tol[live][:, None], strength[spots], -1.0)
            where = np.where(near.max(axis=1) >= 0, target + reach[near.argmax(axis=1)], target)
        found = pa.array(heads[np.concatenate(found_in)])
        yield from table.select(keys).take(found).append_column("frame_idx", pa.array(np.concatenate(found_at), pa.int64())).to_batches()


def track_beats(onsets: DataFrame, tempo: DataFrame, keys: Sequence[str], framing: Framing, chunk: int = CHUNK) -> DataFrame:
    """Beat frames: from the first peak, one period at a time, snapped to the strongest peak nearby.

    ``onsets`` and ``tempo`` should be stage tables: both are read more than once. The walk is
    sequential, so each chunk is summarised as an entry-to-exit map in parallel, the small
    maps are chained per track, and the chunks are then walked in parallel from their true entries.
    A task walks its chunks a block at a time, so thousands of short tracks cost no Python call each.
    """
    keys = list(keys)
    high = framing.lags[1]
    reach = high + max(2, high // 3) + 2
    chunk = max(chunk, 4 * reach)
    period = F.greatest(F.lit(1), F.bround(framing.frame_rate * 60.0 / F.col("bpm")).cast("int"))
    tracks = tempo.where(F.col("bpm") > 0).select(*keys, "n_frames", period.alias("period"))
    peaks = cut_lineage(local_peaks(onsets.select(*keys, "frame_idx", "onset"), keys, chunk=chunk))
    first = peaks.groupBy(*keys).agg(F.min("frame_idx").alias("first_peak"))
    tracks = cut_lineage(tracks.join(first, keys))
    near = with_halo(peaks.join(tracks, keys), "frame_idx", chunk, after=reach)
    types = {f.name: f.dataType.simpleString() for f in onsets.schema.fields}
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        """Where the walk leaves a chunk, for each entry."""
        base = int(group[BIN].iloc[0]) * chunk
        p = int(group["period"].iloc[0])
        total = int(group["n_frames"].iloc[0])
        size = min(chunk, total - base)
        peaks_here = group[group["onset"] >= 0].sort_values("frame_idx")
        at = peaks_here["frame_idx"].to_numpy() - base
        tol = max(2, p // 3)
        keep = at < size + p + tol
        step = _next_beats(at[keep], peaks_here["onset"].to_numpy()[keep], size, p, tol)
        step = np.where(np.arange(size) + p + base < total, step, -1)
        out = np.empty(size, dtype=np.int64)
        for i in range(size - 1, -1, -1):
            j = step[i]
            out[i] = -1 if j < 0 else (out[j] if j < size else base + j)
        begin = int(group["first_peak"].iloc[0]) - base
        entries = sorted(set(range(min(size, p + tol + 1))) | ({begin} if 0 <= begin < size else set()))
        head = {k: group[k].iloc[0] for k in keys}
        return pd.DataFrame({**head, BIN: int(group[BIN].iloc[0]), "entry": [base + e for e in entries],
                             "exit": [int(out[e]) for e in entries], "first_peak": base + begin})

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        table = dict(zip(group["entry"], group["exit"]))
        at, found = int(group["first_peak"].iloc[0]), []
        while at in table:
            found.append(at)
            at = table[at]
        return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, BIN: [f // chunk for f in found], "entry": found})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                table = pa.Table.from_batches(held)
                end = int(np.flatnonzero(table["__rn"].to_numpy() == 1)[-1])  # the last chunk may go on in the next batch
                if end:
                    yield from _walk_chunks(table.slice(0, end), keys, chunk)
                held = table.slice(end).to_batches()
                size = table.num_rows - end
        if size:
            yield from _walk_chunks(pa.Table.from_batches(held), keys, chunk)

    # Chunks without a peak still pass the walk on: one marker row (onset -1) per chunk of a track.
    marks = tracks.select(*keys, "n_frames", "period", "first_peak", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("n_frames") - 1) / chunk))).alias(BIN)).withColumns({"frame_idx": F.lit(-1).cast("long"), "onset": F.lit(-1.0)})
    rows = near.select(*keys, "n_frames", "period", "first_peak", BIN, "frame_idx", "onset").unionByName(marks)
    long = rows.where(F.col("n_frames") > chunk)
    maps = long.groupBy(*keys, BIN).applyInPandas(summarise, f"{key_schema}, {BIN} long, entry long, exit long, first_peak long")
    entries = maps.groupBy(*keys).applyInPandas(chain, f"{key_schema}, {BIN} long, entry long")
    single = tracks.where(F.col("n_frames") <= chunk).select(*keys, F.lit(0).cast("long").alias(BIN), F.col("first_peak").alias("entry"))
    started = rows.join(entries.unionByName(single), [*keys, BIN])
    # a window's order is the order in which a task's rows arrive
    numbered = started.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, BIN).orderBy("frame_idx")))
    return numbered.select(*keys, BIN, "frame_idx", "onset", "n_frames", "period", "entry", "__rn").mapInArrow(walk, f"{key_schema}, frame_idx long")


def beat_intervals(beats: DataFrame, keys: Sequence[str], framing: Framing, chunk: int = CHUNK) -> DataFrame:
    """Mean interval, its population coefficient of variation and the stability score, per track."""
    second = F.col("frame_idx") * framing.hop / framing.sample_rate
    timed = beats.select(*keys, "frame_idx", second.alias("at"))
    nearby = ordered_scan(timed, list(keys), [F.col("frame_idx")], F.floor(F.col("frame_idx") / chunk), lead={"next_at": F.col("at")})
    gaps = nearby.withColumn("gap", F.col("next_at") - F.col("at"))
    stats = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("beats"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("__sd"))
    usable = (F.col("beats") >= 4) & (F.col("mean_gap") > 1e-9)
    cv = F.col("__sd") / F.col("mean_gap")
    return stats.select(*keys, "beats", "mean_gap", F.when(usable, cv).alias("cv"),
                        F.when(usable, F.round(scoring.clamp(1.0 - cv), 4)).otherwise(0.0).alias("stability"))


def downsample(rows: DataFrame, keys: Sequence[str], column: str, points: int = 64, idx: str = "frame_idx") -> DataFrame:
    """Bucket means with integer bucket edges; tracks no longer than ``points`` stay as they are."""
    keys = list(keys)
    sized = rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys)
    i = F.col(idx)
    bucket = F.when(F.col("__n") <= points, i).otherwise(F.floor(((i + 1) * points + F.col("__n") - 1) / F.col("__n")) - 1)
    return sized.groupBy(*keys, bucket.alias("point")).agg(F.round(F.avg(column), 3).alias(column))


def audio_features(samples: DataFrame, keys: Sequence[str], framing: Framing, *, minimum_seconds: float = 15.0, max_amp: float = 1.0) -> DataFrame:
    """All scalar features of a track: tempo, energy, beat quality, stability, voice risk and score.

    Samples are read once: their hop sums are written and give both the frames and the duration.
    """
    keys = list(keys)
    blocks = cut_lineage(hop_sums(samples, keys, framing, max_amp))
    length = blocks.groupBy(*keys).agg((F.sum("__n") / framing.sample_rate).alias("duration"))
    return features_of_frames(frames_of_hops(blocks, keys, framing), length, keys, framing, minimum_seconds=minimum_seconds)


def features_of_frames(rms: DataFrame, length: DataFrame, keys: Sequence[str], framing: Framing, *, minimum_seconds: float = 15.0) -> DataFrame:
    """``audio_features`` from the frames of ``frame_rms`` and (keys, duration in seconds)."""
    keys = list(keys)
    # Stage tables: frames are hundreds of times smaller than samples and every feature reads them.
    frames = cut_lineage(onset(rms, keys))
    tempo = cut_lineage(estimate_bpm(frames, keys, framing))
    beats = cut_lineage(track_beats(frames, tempo, keys, framing))
    levels = exact_percentiles(frames, keys, "rms", {"rms95": 0.95}).join(exact_percentiles(frames, keys, "onset", {"onset95": 0.95}), keys)
    means = frames.groupBy(*keys).agg(F.avg("rms").alias("mean_rms"))
    at = F.floor(F.col("frame_idx") * framing.hop / framing.sample_rate * framing.sample_rate / framing.hop)
    hit = beats.select(*keys, F.greatest(F.lit(0), at).alias("frame_idx"))
    quality = hit.join(frames.select(*keys, "frame_idx", "onset"), [*keys, "frame_idx"]).groupBy(*keys).agg(F.avg("onset").alias("beat_onset"))
    rhythm = beat_intervals(beats, keys, framing)

    def scaled(value: str, scale: str) -> Column:
        return F.when(F.col(scale) <= 1e-9, 0.0).otherwise(F.round(scoring.clamp(F.coalesce(value, F.lit(0.0)) / F.col(scale)), 4))

    joined = length.join(tempo, keys, "left").join(levels, keys, "left").join(means, keys, "left").join(quality, keys, "left").join(
        rhythm.select(*keys, "beats", "stability"), keys, "left")
    base = joined.select(
        *keys, "duration", F.coalesce("bpm", F.lit(0.0)).alias("bpm"), F.coalesce("beats", F.lit(0)).alias("beats"), "mean_rms",
        scaled("mean_rms", "rms95").alias("energy"), scaled("beat_onset", "onset95").alias("beat_quality"),
        F.coalesce("stability", F.lit(0.0)).alias("stability"))
    fit = scoring.tempo_fit(F.col("bpm"))
    weights = scoring.FEATURE_WEIGHTS
    raw = F.round(F.col("beat_quality") * weights["beat_quality"] + F.col("energy") * weights["energy"]
                  + F.col("stability") * weights["stability"] + fit * weights["bpm_fit"], 4)
    voice = scoring.voiceover_risk(F.col("duration"), F.col("bpm"), F.col("energy"), F.col("beat_quality"), F.col("stability"))
    long_enough = F.col("duration") >= minimum_seconds
    return base.withColumns({"raw_score": raw, "voice": voice}).withColumn(
        "score", scoring.final_audio_score(F.col("raw_score"), long_enough, F.col("voice.detected"))
    ).select(*base.columns, "raw_score", F.col("voice.risk_score").alias("voice_risk"), "score")


def best_window(
    samples: DataFrame, key: str, framing: Framing, *, target: int, step: int, slack: int, final_gap: int | None = None
) -> DataFrame:
    """Best-scoring stretch of ``target`` samples per track, earliest on ties.

    Starts lie ``step`` samples apart; the last possible start is added when it is more than
    ``final_gap`` (one second) behind them. Tracks within ``slack`` of the target stay whole. The
    frames of a window are a range of its track's frames, so tracks are framed once for each residue
    of starts modulo the hop (one if ``step`` is a multiple of it), and once more from the added
    start where that has another residue; windows share frames, not samples. The target must hold
    a frame. Tracks without samples have no row.
    """
    if target < framing.frame:
        raise ValueError(f"a window of {target} samples holds no frame of {framing.frame}")
    final_gap = framing.sample_rate if final_gap is None else final_gap
    lengths = samples.groupBy(key).agg(F.count(F.lit(1)).alias("length"))
    whole, span = F.col("length") <= target + slack, F.col("length") - target
    cut = cut_lineage(lengths.select(
        key, F.when(whole, F.col("length")).otherwise(target).alias("size"),
        F.when(whole, 0).otherwise(F.floor(span / step)).alias("top"),
        F.when(~whole & (span - F.floor(span / step) * step > final_gap), span).alias("final")))
    starts = F.concat(F.transform(F.sequence(F.lit(0).cast("long"), F.col("top")), lambda k: k * step), F.when(F.col("final").isNotNull(), F.array("final")).otherwise(F.array().cast("array<bigint>")))
    length = cut.select(key, (F.col("size") / framing.sample_rate).alias("duration"), F.explode(starts).alias("start"))
    frames = _window_frames(samples, cut, key, framing, step)
    scored = features_of_frames(frames, length, [key, "start"], framing, minimum_seconds=0.0)
    top = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("start")).alias("back"))).alias("t"))
    start = -F.col("t.back")
    return top.join(cut, key).select(key, start.alias("start"), (start + F.col("size")).alias("end"), F.col("t.score").alias("score"))


def _window_frames(samples: DataFrame, cut: DataFrame, key: str, framing: Framing, step: int) -> DataFrame:
    """(key, start, frame_idx, rms) of all windows of ``cut`` (key, size, top, final)."""
    hop, frame = framing.hop, framing.frame
    residues = list(range(0, hop, math.gcd(step, hop)))
    known = (F.col("final") % hop).isin(residues)
    # ``base``: the sample at which the first frame of a framing starts
    shifted = samples.select(key, "idx", "sample", F.explode(F.array(*[F.lit(r).cast("long") for r in residues])).alias("base"))
    tails = cut.where(F.col("final").isNotNull() & ~known).select(key, F.col("final").alias("base"))
    shifted = shifted.unionByName(samples.join(tails, key).select(key, "idx", "sample", "base"))
    based = shifted.where(F.col("idx") >= F.col("base")).withColumn("idx", F.col("idx") - F.col("base"))
    at, size, base = F.col("base") + F.col("frame_idx") * hop, F.col("size"), F.col("base")
    need = F.least(F.lit(frame), size)  # a track shorter than a frame has one frame, as long as it is
    low = F.greatest(F.lit(0).cast("long"), F.ceil((at + need - size) / step))
    high = F.least(F.floor(at / step), F.col("top"))
    none = F.array().cast("array<bigint>")
    grid = F.when(low <= high, F.filter(F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * step), lambda s: s % hop == base)).otherwise(none)
    added = F.col("final").isNotNull() & ((F.col("final") % hop == base) | (F.col("final") == base)) & (at >= F.col("final")) & (at + need <= F.col("final") + size)
    placed = frame_rms(based, [key, "base"], framing).join(cut, key)
    placed = placed.select(key, at.alias("at"), "rms", F.explode(F.concat(grid, F.when(added, F.array("final")).otherwise(none))).alias("start"))
    return placed.select(key, "start", ((F.col("at") - F.col("start")) / hop).cast("long").alias("frame_idx"), "rms")


def tag_group_scores(tags: DataFrame, key: str = "clip_id") -> DataFrame:
    """Highest score per tag group; a label counts when it contains any needle, odd substrings included."""
    label = F.lower(F.coalesce("label", F.lit("")))

    def best(needles: Sequence[str]) -> Column:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(label, F.lit(needle))
        return F.max(F.when(hit, F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0)))).otherwise(0.0))

    return tags.groupBy(key).agg(*[best(needles).alias(name) for name, needles in TAG_GROUPS.items()])


def classify_audio(groups: DataFrame, texts: DataFrame, key: str = "clip_id") -> DataFrame:
    """Audio type by an ordered decision list; lyrics discount the speech risk of songs.

    ``texts`` has one row per clip with ``density``, non-blank characters per second.
    """
    joined = groups.join(texts.select(key, "density"), key, "left").fillna({"density": 0.0})
    music, rap, speech, density = F.col("music"), F.col("rap"), F.col("speech"), F.col("density")
    sung = F.greatest("singing", "rap")
    kind = (
        F.when((music < FAINT_MUSIC) & (speech >= SPEECH_ALONE), "speech_only").when(rap >= RAPPED, "rap_song").when(sung >= SUNG, "song_with_lyrics")
        .when((music >= CLEAR_MUSIC) & (speech >= SPEECH_OVER_MUSIC) & (density >= DENSE_TEXT), "music_with_spoken_overlay")
        .when((music >= CLEAR_MUSIC) & (speech < SPEECH_OVER_MUSIC), "instrumental").when(music < FAINT_MUSIC, "ambient_only").otherwise("uncertain")
    )
    risk = F.when(F.col("audio_type").isin("song_with_lyrics", "rap_song"), F.greatest(F.lit(0.0), speech - sung * LYRIC_DISCOUNT)).otherwise(speech)
    return joined.withColumn("audio_type", kind).select(
        key, "audio_type", F.round(music, 4).alias("music_probability"), F.round(speech, 4).alias("speech_probability"),
        F.round(sung, 4).alias("singing_probability"), F.round(density, 4).alias("text_density"), F.round(risk, 4).alias("speech_risk"))


def ordered_text(rows: DataFrame, keys: Sequence[str], order: str, text: str, separator: str = " ", page: int = 256) -> DataFrame:
    """Texts of each key joined in order: pages of ``page`` first, so one key never gathers all its rows."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)
    pages = rows.where(F.col(text) != "").groupBy(*keys, F.floor(F.col(order) / page).alias("__page")).agg(piece.alias(text))
    final = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__page", text))), lambda x: x[text]), separator)
    return pages.groupBy(*keys).agg(final.alias(text))


def transcript_text(heads: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Text of a transcript, else its transcript field, else its segments joined in order."""
    from mediaquery.functions.text import strip

    parts = segments.select(key, "ord", strip(F.coalesce("text", F.lit(""))).alias("text"))
    joined = ordered_text(parts, [key], "ord", "text").withColumnRenamed("text", "__joined")
    given = strip(F.coalesce(F.nullif("text", F.lit("")), "transcript", F.lit("")))
    both = heads.select(key, given.alias("__given")).join(joined, key, "full")
    return both.select(key, F.coalesce(F.nullif("__given", F.lit("")), "__joined", F.lit("")).alias("text"))


def sampled_fingerprint(samples: DataFrame, features: DataFrame, key: str, limit: int = 262_144, curve_points: int = 32) -> DataFrame:
    """Digest of at most ``limit`` evenly strided samples, the tempo and the head of the energy curve.

    ``features`` has bpm and an array ``curve`` per track. The stride bounds what a group gathers.
    """
    steps = samples.groupBy(key).agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count(F.lit(1)) / limit)).alias("__step"))
    kept = samples.join(steps, key).where((F.col("idx") % F.col("__step") == 0) & (F.floor(F.col("idx") / F.col("__step")) < limit))
    sample = F.round(F.col("sample") * 32768).cast("int")
    strided = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", sample.alias("s")))).alias("p"))
    text = F.concat_ws(
        "|", F.array_join(F.transform("p", lambda x: x["s"].cast("string")), ","), F.format_string("%.1f", F.round("bpm", 1)),
        F.array_join(F.transform(F.slice("curve", 1, curve_points), lambda c: F.format_string("%.3f", c)), ","))
    return strided.join(features, key).select(key, F.sha2(text, 256).alias("fingerprint"))
