"""Rankings, quotas and top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaquery.functions.ordered import ordered_scan
from mediaquery.functions.scoring import literal_map, octave_bpm_distance


def rank_candidates(candidates: DataFrame, keys: Sequence[str] = (), position: str = "position") -> DataFrame:
    """Full ranking by score, stable on input position; a hot pool, even one with a single score, is ranked in many tasks."""
    keyed = candidates if keys else candidates.withColumn("__all", F.lit(0))
    ranked = ordered_scan(keyed, list(keys) or ["__all"], [F.col("final_score").desc(), F.col(position)], rank="rank")
    return ranked if keys else ranked.drop("__all")


def top_per_key(rows: DataFrame, key: str, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """``row_number <= k``: Spark keeps only k rows per key and task before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)


def rank_cover_candidates(selected: DataFrame, preferred: Sequence[str], k: int = 5) -> DataFrame:
    """Best cover sources per creative: event preference, then five scores, then input position."""
    table = {e: 1.0 - i * 0.08 for i, e in enumerate(preferred)}
    event_score = F.coalesce(literal_map(table)[F.col("event")], F.lit(0.55)) if table else F.lit(0.55)
    order = [event_score.desc(), *[F.coalesce(c, F.lit(0.0)).desc() for c in
             ("aesthetic", "subject_visibility", "sharpness", "composition", "payoff")], F.col("pos")]
    return top_per_key(selected, "creative_id", order, max(1, k))


def bgm_rank_order(target_bpm: float) -> list[Column]:
    adjusted = F.col("music_score") - F.col("exported_count") * 0.15
    fit = adjusted - F.least(F.lit(0.3), octave_bpm_distance(F.col("bpm"), target_bpm) / 100)
    return [F.round(fit, 9).desc(), F.col("music_score").desc(), F.round(adjusted, 9).desc(), F.col("updated_at").desc(), F.col("bgm_id").desc()]


def rank_bgms(assets: DataFrame, target_bpm: float) -> DataFrame:
    """Every track's rank in its category; a category is cut into bins of the rounded fit, so a hot one is not one task."""
    fit = F.col("music_score") - F.col("exported_count") * 0.15 - F.least(F.lit(0.3), octave_bpm_distance(F.col("bpm"), target_bpm) / 100)
    return ordered_scan(assets, ["category"], bgm_rank_order(target_bpm), -F.floor(F.round(fit, 9) * 100), rank="rank")


def eligible_bgms(assets: DataFrame, *, minimum_score: float, maximum_risk: float, minimum_ms: int = 5_000) -> DataFrame:
    """Assets marked ``eligible`` that pass the thresholds; a null mark is not eligible."""
    return assets.where(F.coalesce(F.col("eligible").cast("boolean"), F.lit(False))).where((F.col("music_score") >= minimum_score) & (F.col("speech_risk") <= maximum_risk) & (F.col("duration_ms") >= minimum_ms))


def dedupe_by_fingerprint(assets: DataFrame, target_bpm: float) -> DataFrame:
    """Best-ranked track per (category, fingerprint): a partially aggregated minimum, no window."""
    adjusted = F.col("music_score") - F.col("exported_count") * 0.15
    fit = adjusted - F.least(F.lit(0.3), octave_bpm_distance(F.col("bpm"), target_bpm) / 100)
    worth = F.struct(F.round(fit, 9), "music_score", F.round(adjusted, 9), "updated_at", "bgm_id")
    columns = [c for c in assets.columns if c not in ("category", "fingerprint")]
    best = assets.groupBy("category", "fingerprint").agg(F.max_by(F.struct(*columns), worth).alias("b"))
    return best.select("category", "fingerprint", "b.*")


def take_with_repeat(unique: DataFrame, count: int, cap: int, target_bpm: float) -> DataFrame:
    """Round-robin over each category's ranked tracks, none more than ``cap`` times, ``count`` in total.

    Only the ``count`` best tracks of a category can appear, so they are cut before the copies are made.
    """
    top = top_per_key(unique, "category", bgm_rank_order(target_bpm), count, "__r")
    copies = top.select("*", F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("copy"))
    return top_per_key(copies, "category", [F.col("copy"), F.col("__r")], count, "slot").drop("__r")


def select_bgms(assets: DataFrame, count: int, *, minimum_score: float = 0.68, maximum_risk: float = 0.18, cap: int = 2,
                target_bpm: float = 122, minimum_ms: int = 5_000) -> DataFrame:
    kept = eligible_bgms(assets, minimum_score=minimum_score, maximum_risk=maximum_risk, minimum_ms=minimum_ms)
    return take_with_repeat(dedupe_by_fingerprint(kept, target_bpm), count, cap, target_bpm)


def source_capped_topn(candidates: DataFrame, per_source: int, total: int, source: str = "video_id") -> DataFrame:
    order = [F.col("final_score").desc(), F.col("position")]
    return top_per_key(candidates, source, order, per_source, "source_rank").orderBy(*order).limit(total)


def cover_option_fallback(options: DataFrame, keys: Sequence[str] = ("creative_id",)) -> DataFrame:
    """First acceptable new frame, else first new frame, else first frame, per creative, in one aggregate."""
    tier = F.when(F.col("acceptable") & ~F.col("duplicate"), 0).when(~F.col("duplicate"), 1).otherwise(2)
    payload = F.struct(*[c for c in options.columns if c not in keys], tier.alias("tier"))
    return options.groupBy(*keys).agg(F.min_by(payload, F.struct(tier, "ordinal")).alias("o")).select(*keys, "o.*")


def latest_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("modified_at").desc())


def shared_candidates(a: DataFrame, b: DataFrame, key: str = "candidate_id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def overlap_sizes(a: DataFrame, b: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Sizes of two id sets and of their intersection, from one tagged aggregate."""
    tagged = a.select(key, F.lit(1).alias("t")).unionByName(b.select(key, F.lit(2).alias("t")))
    sides = tagged.groupBy(key).agg(F.bit_or("t").alias("t"))
    return sides.agg(F.count_if(F.col("t").bitwiseAND(1) > 0).alias("left_size"), F.count_if(F.col("t").bitwiseAND(2) > 0).alias("right_size"),
                     F.count_if(F.col("t") == 3).alias("shared"))


def fresh_candidates(selected: DataFrame, exported: DataFrame, key: str = "candidate_id") -> DataFrame:
    return selected.join(exported.select(key).distinct(), key, "left_anti")


def ordered_distinct(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))
