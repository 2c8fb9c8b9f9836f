"""Keyed registries and usage ledgers as set operations between snapshots.

Each operator takes the current tables and a batch and returns the next tables. A batch is reduced to
one row per key before it meets the registry, so repeated keys cost a partial aggregate, not a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaquery.functions.ordered import ordered_scan

# Per-column conflict rules: what a repeated analysis refreshes; every other column keeps its first value.
CANDIDATE_REFRESH = ("source_candidate_id", "video_path", "peak_ms", "event", "payload", "updated_at")
BGM_REFRESH = ("selected_audio_path", "audio_type", "music_score", "speech_risk", "singing_probability",
               "separation_quality", "eligible", "status", "payload", "updated_at")
CACHE_REFRESH = ("video_path", "candidate_count", "payload", "analyzed_at", "last_accessed_at")

#: Columns of a table that takes batches in any order: the sequence numbers its rows come from.
SEEN = ("first_seq", "last_seq")


def upsert(
    table: DataFrame, batch: DataFrame, key: str, refresh: Sequence[str], *, seq: str = "seq",
    counter: str | None = None, increment: int = 1, defaults: dict | None = None,
) -> DataFrame:
    """Insert-or-refresh: first-seen values stay, ``refresh`` columns take the latest batch row.

    ``counter`` starts at 1 on insert and grows by ``increment`` per conflicting row.
    """
    columns = [c for c in table.columns if c not in (key, *SEEN)]
    incoming = [c for c in batch.columns if c in columns]
    latest = [c for c in incoming if c in refresh]
    grouped = batch.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.min_by(F.struct(*incoming), seq).alias("__first"),
        F.max_by(F.struct(*(latest or incoming)), seq).alias("__last"), F.min(seq).alias("__from"), F.max(seq).alias("__to"))
    merged = table.withColumn("__old", F.lit(True)).join(grouped, key, "full")
    old, touched = F.col("__old").isNotNull(), F.col("__n").isNotNull()
    # a table that keeps the first and last sequence number takes batches in any order
    ordered = set(SEEN) <= set(table.columns)
    newer = ~old | (F.col("__to") > F.col("last_seq")) if ordered else F.lit(True)
    older = ~old | (F.col("__from") < F.col("first_seq")) if ordered else ~old
    out: list[Column] = [F.col(key)]
    for c in columns:
        if c == counter:
            value = F.when(~touched, F.col(c)).when(old, F.col(c) + F.col("__n") * increment).otherwise(1 + (F.col("__n") - 1) * increment)
        elif c in latest:
            value = F.when(touched & newer, F.col(f"__last.{c}")).otherwise(F.col(c))
        elif c in incoming:
            value = F.when(touched & older, F.col(f"__first.{c}")).otherwise(F.col(c))
        else:
            value = F.when(old, F.col(c)).otherwise(F.lit((defaults or {}).get(c)))
        out.append(value.cast(table.schema[c].dataType).alias(c))
    if ordered:
        out += [F.least("first_seq", "__from").alias("first_seq"), F.greatest("last_seq", "__to").alias("last_seq")]
    return merged.select(*out)


def register_candidates(registry: DataFrame, batch: DataFrame, *, increment_analysis: bool = True) -> DataFrame:
    return upsert(registry, batch, "candidate_id", CANDIDATE_REFRESH, counter="analysis_count", increment=int(increment_analysis),
                  defaults={"status": "eligible", "selected_count": 0, "exported_count": 0})


def upsert_bgm(assets: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(assets, batch, "bgm_id", BGM_REFRESH, defaults={"selected_count": 0, "exported_count": 0})


def put_cache(cache: DataFrame, batch: DataFrame, candidates: str = "candidates") -> DataFrame:
    """Cache rows with the candidate count taken from the payload array."""
    sized = batch.withColumn("candidate_count", F.greatest(F.lit(0), F.size(F.coalesce(F.col(candidates), F.array()))))
    return upsert(cache, sized, "cache_key", CACHE_REFRESH)


def reserve(registry: DataFrame, ledger: DataFrame, assignments: DataFrame, *, key: str = "candidate_id") -> tuple[DataFrame, DataFrame]:
    """Insert-or-ignore of (key, run, creative); counts grow only by rows that were really inserted."""
    triple = [key, "run_id", "creative_id"]
    fresh = assignments.groupBy(*triple).agg(F.min("seq").alias("seq")).join(ledger.select(*triple), triple, "left_anti")
    new_ledger = ledger.unionByName(fresh.withColumn("state", F.lit("reserved")).select(*ledger.columns))
    added = fresh.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct("run_id", "creative_id"), "seq").alias("__last"))
    joined = registry.join(added, key, "left")
    new_registry = joined.withColumns({
        "selected_count": F.col("selected_count") + F.coalesce("__n", F.lit(0)),
        "last_run_id": F.coalesce("__last.run_id", "last_run_id"),
        "last_creative_id": F.when(F.col("__n").isNotNull(), F.col("__last.creative_id")).otherwise(F.col("last_creative_id")),
    }).select(*registry.columns)
    return new_registry, new_ledger


def finalize(
    registry: DataFrame, ledger: DataFrame, decisions: DataFrame, *, key: str = "candidate_id", mark_used: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Reserved rows of the decided creatives become committed or released; commits raise exported_count.

    ``decisions`` has run_id, creative_id and decision; a null creative_id decides the whole run.
    Repeated decisions count once; of contradicting ones ``committed`` holds.
    """
    whole = decisions.where(F.col("creative_id").isNull()).groupBy("run_id").agg(F.min("decision").alias("__run"))
    single = decisions.where(F.col("creative_id").isNotNull()).groupBy("run_id", "creative_id").agg(F.min("decision").alias("__one"))
    joined = ledger.join(single, ["run_id", "creative_id"], "left").join(whole, "run_id", "left")
    decision = F.coalesce("__one", "__run")
    changed = (F.col("state") == "reserved") & decision.isin("committed", "released")
    decided = joined.withColumn("__changed", F.coalesce(changed, F.lit(False))).withColumn(
        "state", F.when(F.col("__changed"), decision).otherwise(F.col("state")))
    exports = decided.where(F.col("__changed") & (F.col("state") == "committed")).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    counted = registry.join(exports, key, "left")
    updates = {"exported_count": F.col("exported_count") + F.coalesce("__n", F.lit(0))}
    if mark_used:
        updates["status"] = F.when(F.col("__n").isNotNull(), "used").otherwise(F.col("status"))
    return counted.withColumns(updates).select(*registry.columns), decided.select(*ledger.columns)


def usage_by_creative(ledger: DataFrame) -> DataFrame:
    """Held or exported candidates of every creative, numbered in id order (rows instead of one long array)."""
    held = ledger.where(F.col("state").isin("reserved", "committed")).select("run_id", "creative_id", "candidate_id")
    return ordered_scan(held, ["run_id", "creative_id"], [F.col("candidate_id")], rank="position")
