"""Lookups, anti joins and report joins.

No side is broadcast by hint: Spark's own size check and AQE decide, AQE splits hot keys, and every
build side is reduced to one row per key first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaquery.functions.scoring import literal_map

# Fixed value: clip kind on the main track for each packaged source type.
CLIP_TYPES = {
    "product_openpage": "fixed_openpage",
    "product_recording": "fixed_screenshot",
    "endcard": "fixed_tail_sticker",
}


def attach_event_weight(
    candidates: DataFrame, weights: DataFrame | Mapping[str, float], fallback: str = "category_event_value"
) -> DataFrame:
    """Event value from the weights, else the candidate's own; a dictionary needs no join at all."""
    if isinstance(weights, Mapping):
        found = literal_map(dict(weights))[F.col("event")]
        return candidates.withColumn(fallback, F.coalesce(found, F.col(fallback)))
    joined = candidates.join(weights.select("event", F.col("weight").alias("__w")), "event", "left")
    return joined.withColumn(fallback, F.coalesce("__w", fallback)).drop("__w")


def map_category(rows: DataFrame, mapping: DataFrame | Mapping[str, str], source: str = "source_category") -> DataFrame:
    if isinstance(mapping, Mapping):
        return rows.withColumn("category", F.coalesce(literal_map(dict(mapping))[F.col(source)], F.col(source)))
    lookup = mapping.select(F.col(source), F.nullif("category", F.lit("")).alias("__c"))
    return rows.join(lookup, source, "left").withColumn("category", F.coalesce("__c", source)).drop("__c")


def reserved_ids(ledger: DataFrame, key: str = "candidate_id") -> DataFrame:
    return ledger.where(F.col("state") == "reserved").select(key).distinct()


def candidate_history(registry: DataFrame, ledger: DataFrame, category=None) -> DataFrame:
    """Usable registry rows with a flag for candidates some run still holds."""
    usable = registry.where(F.col("status").isin("eligible", "used"))
    if category is not None:
        usable = usable.where(F.col("category") == category)
    held = reserved_ids(ledger).withColumn("reserved", F.lit(True))
    return usable.join(held, "candidate_id", "left").fillna({"reserved": False})


def exclude_reserved(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    return candidates.join(reserved_ids(ledger), "candidate_id", "left_anti")


def missing_media(materials: DataFrame, listing: DataFrame) -> DataFrame:
    return materials.where("enabled").join(listing.select("path").distinct(), "path", "left_anti")


def resolve_timeline(timeline: DataFrame, candidates: DataFrame) -> DataFrame:
    """Source in/out of every highlight clip; a short trim is shifted back so that its end still fits."""
    joined = timeline.join(candidates, "candidate_id", "left")
    short = F.col("trim_end_ms") - F.col("trim_start_ms") < F.col("dur_ms")
    source_in = F.when(short, F.greatest(F.lit(0), F.col("trim_end_ms") - F.col("dur_ms"))).otherwise(F.col("trim_start_ms"))
    return joined.withColumn("source_in_ms", source_in).withColumn(
        "source_out_ms", F.col("source_in_ms") + F.col("dur_ms")
    )


def resolve_assets(timeline: DataFrame, assets: DataFrame) -> DataFrame:
    """Packaged clips with clip type and asset path; unknown ids become error rows."""
    known = assets.select("asset_id", F.col("path").alias("asset_path"))
    joined = timeline.where(F.col("source_type") != "ugc").join(known, "asset_id", "left")
    return joined.withColumns({
        "clip_type": literal_map(CLIP_TYPES)[F.col("source_type")],
        "error": F.when(F.col("asset_path").isNull(), F.concat(F.lit("asset is not registered: "), F.col("asset_id"))),
    })


def unregistered_assets(campaigns: DataFrame, references: Sequence[str], assets: DataFrame) -> DataFrame:
    refs = campaigns.select("campaign_id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("reference"), F.col(name).alias("asset_id")) for name in references
    ])).alias("r")).select("campaign_id", "r.*")
    return refs.where(F.col("asset_id") != "").join(assets.select("asset_id").distinct(), "asset_id", "left_anti")


def cycle_assign(creatives: DataFrame, elements: DataFrame, index: str = "creative_index", ordinal: str = "ordinal") -> DataFrame:
    """Creative i receives element (i - 1) mod n; ``ordinal`` numbers the elements from 1."""
    n = elements.agg(F.count(F.lit(1))).scalar()
    keyed = creatives.withColumn(ordinal, F.pmod(F.col(index) - 1, n) + 1)
    return keyed.join(elements, ordinal)


def cache_lookup(requests: DataFrame, cache: DataFrame, *, force: bool = False, cache_only: bool = False) -> DataFrame:
    """Each request with its cached payload, ``hit`` and, under ``cache_only``, a failure message on misses."""
    if force and cache_only:
        raise ValueError("force and cache_only cannot be used together")
    stored = cache.select("cache_key", F.struct(*[c for c in cache.columns if c != "cache_key"]).alias("cached"))
    looked = requests.join(stored, "cache_key", "left")
    if force:
        looked = looked.withColumn("cached", F.when(F.lit(False), F.col("cached")))
    hit = F.col("cached").isNotNull()
    message = F.lit("analysis cache miss while --cache-only is enabled") if cache_only else F.lit(None).cast("string")
    return looked.withColumn("hit", hit).withColumn("error", F.when(~hit, message))


def touch_cache(cache: DataFrame, lookups: DataFrame, now: Column) -> DataFrame:
    used = lookups.where("hit").select("cache_key").distinct().withColumn("__hit", F.lit(True))
    touched = F.when(F.col("__hit"), now).otherwise(F.col("last_accessed_at"))
    return cache.join(used, "cache_key", "left").withColumn("last_accessed_at", touched).drop("__hit")


def bgm_source_lookup(requests: DataFrame, assets: DataFrame) -> DataFrame:
    key = ["source_video_id", "source_fingerprint", "configuration_fingerprint"]
    return requests.join(assets, key, "left")


def paired_logo(requests: DataFrame, brand_assets: DataFrame) -> DataFrame:
    """Static logo by id or else file name (first in library order), then the first animation of its colour."""
    static = brand_assets.where(F.col("type") == "logo_overlay").select(
        "asset_id", "color_variant", "ordinal", F.substring_index("path", "/", -1).alias("name"))
    by_id = static.groupBy("asset_id").agg(F.min(F.struct("ordinal", "asset_id", "color_variant")).alias("__by_id"))
    by_name = static.groupBy("name").agg(F.min(F.struct("ordinal", "asset_id", "color_variant")).alias("__by_name"))
    motion = brand_assets.where(F.col("type") == "logo_overlay_video").groupBy("color_variant").agg(
        F.min_by("asset_id", "ordinal").alias("animated_id"))
    found = (
        requests.withColumn("name", F.substring_index("logo_path", "/", -1))
        .join(by_id.withColumnRenamed("asset_id", "logo_id"), "logo_id", "left").join(by_name, "name", "left")
        .withColumn("__s", F.least("__by_id", "__by_name"))
    )
    return found.withColumns({"static_id": F.col("__s.asset_id"), "color_variant": F.col("__s.color_variant")}).join(
        motion, "color_variant", "left").drop("name", "__by_id", "__by_name", "__s")
