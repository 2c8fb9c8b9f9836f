"""End-to-end plans: the steps of the operators package in the order a run needs them.

Plans take and return tables. Where a later step reads a table more than once it is staged in the
shared folder, which also keeps long runs restartable from that point.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquery.functions import scoring
from mediaquery.operators import allocate, dedupe, filters, intervals, joins, ledger, ranking, reports
from mediaquery.sources.tables import stage


def score_candidates(candidates: DataFrame, weights: DataFrame | Mapping[str, float]) -> DataFrame:
    weighted = joins.attach_event_weight(candidates, weights)
    penalties = F.col("penalties") if "penalties" in weighted.columns else None
    return weighted.withColumn("final_score", scoring.candidate_score(penalties))


def top_highlights(candidates: DataFrame, weights: DataFrame | Mapping[str, float], k: int = 3) -> DataFrame:
    """Best ``k`` non-overlapping candidates of every video: validate, score, suppress, rank."""
    valid = filters.validate_candidates(candidates).where(F.size("errors") == 0).drop("errors")
    kept = dedupe.suppress_overlaps(score_candidates(valid, weights))
    return ranking.top_per_key(kept, "video_id", [F.col("final_score").desc(), F.col("position")], k)


def analyze_reviews(
    reviews: DataFrame, materials: DataFrame, *, events: Sequence[str], default_event: str, minimum: int, reject_subtitles: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Normalised, suppressed candidates of reviewed videos and the shortfall of each video."""
    raw = filters.reject_by_risk_terms(reviews) if reject_subtitles else reviews
    attached = raw.join(materials.select("video_id", "dur_ms", F.col("path").alias("video_path")), "video_id")
    normal = filters.normalize_reviews(attached, events=events, default_event=default_event)
    kept = stage(dedupe.suppress_overlaps(normal.withColumn("position", F.col("raw_index"))))
    return kept, reports.candidate_shortfall(materials, kept, minimum)


@dataclass
class Composition:
    timeline: DataFrame
    errors: DataFrame
    assignments: DataFrame
    registry: DataFrame
    ledger: DataFrame
    diversity: DataFrame
    pairs: DataFrame
    verdicts: DataFrame


def montage_slots(beats: DataFrame, pools: DataFrame, target_ms: int = 1_400) -> DataFrame:
    """Slots of both montage sections for every pool; ``beats`` and ``pools`` share pool_id."""
    looped = intervals.loop_beats(beats, 17_500, key="pool_id")
    first = intervals.build_slots(looped, 0, 7_200, target_ms, key="pool_id", keys=pools)
    offset = first.groupBy("pool_id").agg(F.max("slot_index").alias("__o"))
    second = intervals.build_slots(looped, 12_800, 17_500, target_ms, key="pool_id", keys=pools).join(offset, "pool_id")
    return first.unionByName(second.withColumn("slot_index", F.col("slot_index") + F.col("__o")).drop("__o"))


def compose_batch(
    candidates: DataFrame, beats: DataFrame, campaigns: DataFrame, registry: DataFrame, usage: DataFrame, *,
    weights: DataFrame | Mapping[str, float], quotas: allocate.Quotas, run_id: str, duration_ms: int = 20_000,
) -> Composition:
    """Fills every pool's creatives, judges each of them, picks or none, and reserves what was used.

    ``candidates`` carries pool_id, stable candidate ids and author; ``campaigns`` has pool_id and the
    packaged asset ids.
    """
    pools = candidates.select("pool_id").distinct()
    slots = stage(montage_slots(beats, pools))
    scored = score_candidates(candidates, weights).withColumn("trim_ms", F.col("end_ms") - F.col("start_ms"))
    history = joins.candidate_history(registry, usage).select("candidate_id", "exported_count", "reserved")
    picked = stage(allocate.assign_batch(slots, scored.join(history, "candidate_id", "left"), quotas, key="pool_id"))
    creative = F.concat_ws("-", F.col("pool_id").cast("string"), F.lpad(F.col("creative_index").cast("string"), 3, "0"))
    named = picked.withColumns({"creative_id": creative, "run_id": F.lit(run_id), "pos": F.col("slot_index")})
    visual = named.join(slots, ["pool_id", "slot_index"]).withColumns({
        "clip_id": F.concat(F.lit("tl_"), F.lpad(F.col("slot_index").cast("string"), 3, "0")), "source_type": F.lit("ugc")})
    package = intervals.fixed_package_rows(campaigns.withColumn("campaign_id", F.col("pool_id")))
    # every planned creative, also those that nothing was picked for
    counts = pools.join(slots.groupBy("pool_id").agg(F.count(F.lit(1)).alias("slot_count")), "pool_id", "left").fillna(0, ["slot_count"])
    planned = counts.withColumn("creative_index", F.explode(F.sequence(F.lit(1), F.lit(quotas.creatives)))).select("pool_id", creative.alias("creative_id"), "slot_count")
    wrapped = planned.select(F.col("pool_id").alias("campaign_id"), "creative_id").join(package, "campaign_id").drop("campaign_id")
    columns = ["creative_id", "clip_id", "source_type", "start_ms", "end_ms"]
    timeline = stage(visual.select(*columns, "candidate_id", "pos").unionByName(wrapped.select(*columns, "asset_id"), allowMissingColumns=True).fillna({"pos": 0}))
    wanted = named.select("candidate_id", "run_id", "creative_id", F.struct("creative_id", "pos").alias("seq"))
    new_registry, new_usage = ledger.reserve(registry, usage, wanted)
    bad_package = intervals.package_errors(wrapped.withColumn("campaign_id", F.col("creative_id"))).withColumnRenamed("campaign_id", "creative_id")
    errors = stage(reports.composition_errors(planned, named, intervals.timeline_errors(timeline, duration_ms), bad_package, quotas.target_sources))
    return Composition(
        timeline, errors, named, new_registry, new_usage, reports.diversity_summary(named, registry), reports.pairwise_overlap(named),
        reports.composition_verdicts(planned, named, errors))


def run_report(usage: DataFrame, results: DataFrame, failures: DataFrame, history: DataFrame, creatives: DataFrame) -> dict[str, DataFrame]:
    """The tables behind a run page: summary, sources, pairs, diversity and alerts."""
    summary = reports.run_summary(usage, results, failures)
    totals = usage.groupBy("run_id").agg(F.count(F.lit(1)).alias("__c"))
    sources = usage.groupBy("run_id", "author").agg(F.count(F.lit(1)).alias("candidate_count")).join(totals, "run_id").withColumn(
        "candidate_ratio", F.round(F.col("candidate_count") / F.col("__c"), 4)).drop("__c")
    pairs, diversity = reports.pairwise_overlap(usage), reports.diversity_summary(usage, history)
    return {"summary": summary, "sources": sources, "pairs": pairs, "diversity": diversity,
            "alerts": reports.run_alerts(summary, sources, reports.maximum_overlap(usage), diversity, creatives)}
