"""Row-wise selection, validation and labelling operators; only `overlay_clips` and `select_materials` shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquery.functions import scoring, text

SCORE_COLUMNS = tuple(scoring.SCORE_WEIGHTS)


def select_materials(materials: DataFrame, category, limit: int) -> DataFrame:
    """First ``limit`` enabled rows of a category in manifest order (a top-k, never a full sort)."""
    kept = materials.where(F.col("enabled") & (F.col("category") == category))
    return kept.orderBy("position").limit(limit)


def parse_material_names(materials: DataFrame, path: str = "path") -> DataFrame:
    """File-name parts of every row; rows that do not parse carry ``error`` and null parts."""
    return materials.withColumn("__p", text.material_name_parts(F.col(path))).select(*materials.columns, "__p.*")


def split_quarantine(checked: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    return checked.where(F.col(error).isNull()).drop(error), checked.where(F.col(error).isNotNull())


def validate_candidates(candidates: DataFrame, scores: Sequence[str] = SCORE_COLUMNS) -> DataFrame:
    """Adds ``errors``: interval order, negative times and scores outside [0, 1]."""
    checks = [
        F.when(F.col("start_ms") < 0, "start must not be negative"),
        F.when(F.col("end_ms") <= 0, "end must be positive"),
        F.when(F.col("end_ms") <= F.col("start_ms"), "end must be greater than start"),
    ]
    checks += [F.when(~F.col(s).between(0, 1), f"{s} outside 0..1") for s in scores]
    return candidates.withColumn("errors", F.array_compact(F.array(*checks)))


def reject_by_risk_terms(raw: DataFrame) -> DataFrame:
    return raw.where(~scoring.has_subtitle_risk(F.col("subtitle_flag"), F.col("risks")))


def normalize_reviews(
    raw: DataFrame, *, events: Sequence[str], default_event: str, minimum_ms: int = 400, model: str = "gemma"
) -> DataFrame:
    """Reviewed intervals clamped to their video; ``raw_index`` keeps its gaps after drops.

    ``raw`` has one row per model answer with ``dur_ms`` of the video already attached.
    """
    start = F.greatest(F.lit(0), F.col("start_ms"))
    end = F.least(F.col("dur_ms"), F.col("end_ms"))
    kept = raw.withColumn("start_ms", start).withColumn("end_ms", end).where(
        (F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") >= minimum_ms)
    )
    middle = F.bround((F.col("start_ms") + F.col("end_ms")) / 2).cast("long")
    peak = F.coalesce(F.nullif(F.col("peak_ms"), F.lit(0)), middle)
    number = F.col("raw_index").cast("string")
    measured = {s: scoring.clamp(F.coalesce(F.col(s), F.lit(0.0))) for s in
                ("aesthetic", "payoff", "action_intensity", "subject_visibility", "confidence")}
    # Fixed values the review step assigns to every candidate.
    constant = {"category_event_value": 1.0, "sharpness": 0.7, "composition": 0.7, "context_independence": 0.85}
    return kept.withColumns({
        "candidate_id": F.concat_ws("_", F.col("video_id").cast("string"), F.lit(model),
                                    F.when(F.col("raw_index") < 100, F.lpad(number, 2, "0")).otherwise(number)),
        "event": F.when(F.col("event").isin(*events), F.col("event")).otherwise(default_event),
        "peak_ms": F.greatest(F.col("start_ms"), F.least(F.col("end_ms"), peak)),
        **measured, **{k: F.lit(v) for k, v in constant.items()},
    })


def overlay_clips(
    clips: DataFrame, *, hidden_types: Sequence[str], guard_ms: int = 0, intro: bool = False, cover_logo: bool = False,
    cover_ms: int = 0, endcard_type: str = "fixed_tail_sticker",
) -> DataFrame:
    """Logo intervals of each creative: visible clips, cut at the end card, first clip special-cased.

    The end card start and the first visible clip come from one partially aggregated pass.
    """
    shown = ~F.coalesce(F.col("clip_type"), F.lit("")).isin(*hidden_types) & (F.col("dur_ms") > 0)
    facts = clips.groupBy("creative_id").agg(
        F.min(F.when(F.col("clip_type") == endcard_type, F.col("start_ms"))).alias("__endcard"),
        F.min(F.when(shown, F.col("pos"))).alias("__first"),
    )
    room = F.greatest(F.lit(0), F.col("__endcard") - guard_ms - F.col("start_ms"))
    cut = F.when(F.col("__endcard").isNull(), F.col("dur_ms")).otherwise(F.least(F.col("dur_ms"), room))
    first = F.col("pos") == F.col("__first")
    if not (intro or cover_logo):
        length = cut
    elif cover_logo or cover_ms <= 0:
        length = F.when(~first, cut)
    else:
        length = F.when(first, F.least(cut, F.lit(cover_ms))).otherwise(cut)
    joined = clips.where(shown).join(facts, "creative_id").withColumn("overlay_ms", length)
    return joined.where(F.col("overlay_ms") > 0).drop("__endcard", "__first")

