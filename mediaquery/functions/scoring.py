"""Scores, routes, music traits and voice decisions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaquery.functions.text import solid_length

# Weights, thresholds, category names and reason codes of the scoring rules.
SCORE_WEIGHTS = {
    "aesthetic": 0.22,
    "category_event_value": 0.20,
    "payoff": 0.15,
    "action_intensity": 0.13,
    "subject_visibility": 0.10,
    "sharpness": 0.08,
    "composition": 0.07,
    "context_independence": 0.05,
}
SUBTITLE_RISK_MARKERS = ("chinese subtitle", "chinese caption", "中文字幕", "简体字幕", "繁体字幕")
SLOW_BPM, SEED_BPM, FAST_BPM, FASTEST_BPM, IMPACT_BPM = 60, 90, 120, 150, 180
SLOW_TEMPO, SEED_TEMPO, FAST_TEMPO = ("slow_lifestyle_emotion", 0.55), ("general_seed", 0.82), ("fast_mix_ads", 1.0)
IMPACT_TEMPO, OTHER_TEMPO, NO_TEMPO = ("impact_sport_transition", 0.72), ("out_of_range", 0.35), ("unknown", 0.0)
HIGH_LEVEL, MEDIUM_LEVEL = 0.72, 0.38
FAST_CUT_QUALITY, SEED_CUT_QUALITY, PEAK_CUT_ENERGY = 0.7, 0.55, 0.72
FAST_CUT_BEATS, SEED_CUT_BEATS, SOFT_CUT_BEATS = 1, 2, 4
LONG_AUDIO_S, LONG_AUDIO_RISK, SPEECH_BPM, SPEECH_BPM_RISK = 60, 0.25, 90, 0.25
STRONG_ONSETS, STRONG_ONSETS_RISK, VOICE_ENERGY, VOICE_ENERGY_RISK = 0.85, 0.20, (0.35, 0.82), 0.15
STEADY_MUSIC, UNSTEADY_RISK, VOICEOVER_RISK = 0.9, 0.15, 0.7
LYRIC_RISK, SPOKEN_RISK, SPOKEN_SIGNALS, SAMPLE_CHARS = 0.35, 0.55, 2, 120
ALLOWED_AUDIO_TYPES = ("instrumental", "song_with_lyrics", "rap_song", "music_with_spoken_overlay")
STRONG_VOICE_SIGNALS = ("slow_speech_like_bpm", "strong_speech_like_onsets", "less_music_like_stability")
FEATURE_WEIGHTS = {"beat_quality": 0.4, "energy": 0.25, "stability": 0.2, "bpm_fit": 0.15}


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def literal_map(values: dict) -> Column:
    """A small driver-side dictionary as an inline map; its size is known before the plan is built."""
    if len(values) > 10_000:
        raise ValueError("pass a DataFrame for lookups of this size")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def candidate_score(penalties: Column | None = None, event_value: Column | None = None) -> Column:
    parts = []
    for name, weight in SCORE_WEIGHTS.items():
        value = event_value if name == "category_event_value" and event_value is not None else F.col(name)
        parts.append(value * weight)
    total = reduce(lambda a, b: a + b, parts)
    if penalties is not None:
        total = total - F.aggregate(
            F.map_values(penalties), F.lit(0.0), lambda acc, p: acc + F.greatest(F.lit(0.0), p.cast("double"))
        )
    return F.round(clamp(total), 4)


def stable_candidate_id(category: Column, video_id: Column, start_ms: Column, end_ms: Column) -> Column:
    """Id that survives small time drift: both ends are snapped to quarter seconds, half to even."""
    category, video = category.cast("string"), video_id.cast("string")
    snapped = [(F.bround(t / 250.0) * 250).cast("long") for t in (start_ms, end_ms)]

    def seconds(ms: Column) -> Column:
        return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."),
                        F.lpad(F.floor(ms % 1000 / 10).cast("string"), 2, "0"))

    identity = F.concat_ws("|", category, video, seconds(snapped[0]), seconds(snapped[1]))
    return F.concat_ws(
        "_", category, F.right(video, F.lit(12)), F.format_string("%07d", snapped[0]), F.format_string("%07d", snapped[1]),
        F.substring(F.sha2(identity, 256), 1, 12),
    )


def has_subtitle_risk(flag: Column, risks: Column) -> Column:
    text = F.lower(F.array_join(F.coalesce(risks, F.array().cast("array<string>")), " "))
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in SUBTITLE_RISK_MARKERS])
    return F.coalesce(flag, F.lit(False)) | marked


def analysis_route(
    duration_ms: Column, recall_error: Column, cached_route: Column, cached: Column, *,
    enabled: bool = True, minimum_ms: int = 30_000, maximum_ms: int = 120_000,
) -> Column:
    """Route label of a video; null where the recall step failed and the video must be reported as failed."""
    recall = F.lit(enabled) & (duration_ms >= minimum_ms)
    return (
        F.when(cached, F.concat(F.lit("cache_hit:"), F.coalesce(cached_route, F.lit("unknown"))))
        .when(~recall, "gemma_only")
        .when(recall_error, None)
        .when(duration_ms > maximum_ms, "marlin_segmented_then_gemma_candidate_windows")
        .otherwise("marlin_then_gemma_candidate_windows")
    )


def gain_to_volume(gain_db: Column) -> Column:
    return F.pow(F.lit(10.0), gain_db / 20.0)


def tempo(bpm: Column) -> Column:
    """Band and fit of a tempo."""
    pair = lambda x: F.struct(F.lit(x[0]).alias("band"), F.lit(x[1]).alias("fit"))
    return (
        F.when(bpm <= 0, pair(NO_TEMPO))
        .when((bpm >= SLOW_BPM) & (bpm < SEED_BPM), pair(SLOW_TEMPO))
        .when((bpm >= SEED_BPM) & (bpm < FAST_BPM), pair(SEED_TEMPO))
        .when((bpm >= FAST_BPM) & (bpm <= FASTEST_BPM), pair(FAST_TEMPO))
        .when((bpm > FASTEST_BPM) & (bpm <= IMPACT_BPM), pair(IMPACT_TEMPO))
        .otherwise(pair(OTHER_TEMPO))
    )


def tempo_band(bpm: Column) -> Column:
    return tempo(bpm)["band"]


def tempo_fit(bpm: Column) -> Column:
    return tempo(bpm)["fit"]


def level(score: Column) -> Column:
    return F.when(score >= HIGH_LEVEL, "high").when(score >= MEDIUM_LEVEL, "medium").otherwise("low")


def cut_strategy(bpm: Column, beat_quality: Column, energy: Column) -> Column:
    fast = (beat_quality >= FAST_CUT_QUALITY) & bpm.between(FAST_BPM, FASTEST_BPM)
    seed = (beat_quality >= SEED_CUT_QUALITY) & (bpm >= SEED_BPM) & (bpm < FAST_BPM)
    peak = energy >= PEAK_CUT_ENERGY
    return F.struct(
        F.when(fast | seed, "beat_driven").when(peak, "energy_peak").otherwise("soft_bgm").alias("mode"),
        F.when(fast, FAST_CUT_BEATS).when(seed, SEED_CUT_BEATS).when(peak, F.lit(None).cast("int")).otherwise(SOFT_CUT_BEATS).alias("cut_every_beats"),
        F.when(fast, FAST_TEMPO[0]).when(seed, SEED_TEMPO[0]).otherwise(tempo_band(bpm)).alias("clip_type"),
    )


def octave_bpm_distance(bpm: Column, target: float) -> Column:
    return F.least(F.abs(bpm - target), F.abs(bpm * 2 - target), F.abs(bpm / 2 - target))


def voiceover_risk(duration: Column, bpm: Column, energy: Column, beat_quality: Column, stability: Column) -> Column:
    rules = [
        (duration >= LONG_AUDIO_S, LONG_AUDIO_RISK, "long_audio"),
        ((bpm != 0) & (bpm < SPEECH_BPM), SPEECH_BPM_RISK, "slow_speech_like_bpm"),
        (beat_quality >= STRONG_ONSETS, STRONG_ONSETS_RISK, "strong_speech_like_onsets"),
        (energy.between(*VOICE_ENERGY), VOICE_ENERGY_RISK, "voice_level_energy"),
        ((duration >= LONG_AUDIO_S) & (stability < STEADY_MUSIC), UNSTEADY_RISK, "less_music_like_stability"),
    ]
    total = reduce(lambda a, b: a + b, [F.when(test, points).otherwise(0.0) for test, points, _ in rules])
    risk = F.round(F.least(F.lit(1.0), total), 4)
    reasons = F.array_compact(F.array(*[F.when(test, reason) for test, _, reason in rules]))
    return F.struct(risk.alias("risk_score"), (risk >= VOICEOVER_RISK).alias("detected"), reasons.alias("reasons"))


def final_audio_score(raw: Column, long_enough: Column, voice_detected: Column) -> Column:
    return F.when(~long_enough | voice_detected, 0.0).otherwise(raw)


def asr_voice_decision(
    text: Column, segment_count: Column, local_risk: Column, local_reasons: Column, *, min_chars: int, min_segments: int
) -> Column:
    length = solid_length(text)
    vocal = (length >= min_chars) | (F.lit(min_segments > 0) & (segment_count >= min_segments) & (length > 0))
    reasons = F.array_sort(F.array_distinct(F.transform(local_reasons, F.lower)))
    slow = F.array_contains(reasons, "slow_speech_like_bpm")
    strong = F.size(F.array_intersect(reasons, F.array(*[F.lit(s) for s in STRONG_VOICE_SIGNALS])))
    lyric = vocal & (local_risk <= LYRIC_RISK) & ~slow
    detected = vocal & ~lyric & ((local_risk >= SPOKEN_RISK) | (strong >= SPOKEN_SIGNALS) | slow)
    return F.struct(
        detected.alias("detected"), vocal.alias("vocal_text_detected"),
        F.when(detected, "voiceover").when(lyric, "lyrics_or_vocal_bgm").otherwise("no_voiceover").alias("classification"),
        length.alias("text_length"), F.substring(text, 1, SAMPLE_CHARS).alias("sample_text"), reasons.alias("reasons"),
    )


def bgm_eligibility(
    audio_type: Column, duration_s: Column, score: Column, speech_risk: Column, separation: Column,
    accompaniment: Column, remote_error: Column, *, min_duration: float = 5.0, min_score: float = 0.68,
    max_risk: float = 0.18, min_separation: float = 0.75,
) -> Column:
    eligible = (
        audio_type.isin(*ALLOWED_AUDIO_TYPES) & (duration_s >= min_duration) & (score >= min_score)
        & (speech_risk <= max_risk) & (~accompaniment | (separation >= min_separation))
        & ~(remote_error & (audio_type == "uncertain"))
    )
    status = (
        F.when(audio_type == "unavailable", "audio_unavailable").when(eligible, "eligible")
        .when(duration_s < min_duration, "rejected_too_short").otherwise("rejected")
    )
    return F.struct(eligible.alias("eligible"), status.alias("status"))


def run_status(has_result: Column, ok: Column, failed: Column, partial: Column, has_pool: Column) -> Column:
    return (
        F.when(has_result & ok, "completed").when(has_result & (failed > 0), "failed")
        .when(has_result & (partial > 0), "partial").when(has_pool, "analyzed").otherwise("starting")
    )
