"""Perceptual hashes and content keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Settings that never change an analysis, and those of long videos with their defaults in seconds.
RETRY_SETTINGS = ("api_max_attempts", "api_retry_delays_seconds", "api_max_concurrency")
WINDOW_SETTINGS = {"maximum_video_duration_seconds": 120.0, "segment_duration_seconds": 115.0, "segment_overlap_seconds": 5.0}


def difference_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """64-bit gradient hash of a row-major grey image; the first comparison is the highest bit."""
    cells = F.sequence(F.lit(0), F.lit((width - 1) * height - 1))

    def step(acc: Column, i: Column) -> Column:
        at = (F.floor(i / (width - 1)) * width + i % (width - 1)).cast("int")
        brighter = F.get(pixels, at) > F.get(pixels, at + 1)
        return F.shiftleft(acc, 1).bitwiseOR(F.when(brighter, F.lit(1)).otherwise(F.lit(0)).cast("long"))

    return F.aggregate(cells, F.lit(0).cast("long"), step)


def hash_to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hash_from_hex(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def hash_distance(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def config_fingerprint(**fields: Column) -> Column:
    """sha256 of compact JSON over the given fields in sorted order."""
    ordered = [value.alias(name) for name, value in sorted(fields.items())]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def canonical_json(text: Column) -> Column:
    """JSON without blanks, with the keys of every object in order and numbers without trailing zeros; null where the text is no JSON.

    A VARIANT keeps the fields of its objects sorted, so reading and writing it is all that is needed.
    """
    return F.to_json(F.try_parse_json(text))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(fields: Column) -> Column:
    """A JSON object of an array of (k, v), keys and JSON values, in key order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(fields), lambda x: F.concat(_quoted(x["k"]), F.lit(":"), x["v"])), ","), F.lit("}"))


def canonical_object(text: Column, path: str, without: Sequence[str]) -> Column:
    """The object at a path of a JSON text, canonical, without some of its keys; ``{}`` where there is no object."""
    fields = F.try_variant_get(F.try_parse_json(text), path, "map<string,variant>")
    kept = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*without))
    return F.coalesce(_object(F.transform(kept, lambda e: F.struct(e["key"].alias("k"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("v")))), F.lit("{}"))


def analysis_fingerprint(profile: Column, duration_s: Column, *, category: Column, prompt: Column, queries: Column, model_id: Column, proxy: Column, version: Column) -> Column:
    """sha256 of what decides an analysis: key order and settings of retries and concurrency play no part.

    The windows of long videos count for videos that are longer than one window only. ``profile``, ``queries`` and
    ``proxy`` are JSON texts, canonical from here on.
    """
    parsed = F.try_parse_json(profile)
    seconds = {name: F.coalesce(F.try_variant_get(parsed, f"$.marlin_recall.{name}", "double"), F.lit(value)) for name, value in WINDOW_SETTINGS.items()}
    long = duration_s > seconds["maximum_video_duration_seconds"]
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    windows = F.when(long, pair("marlin_long_video_segmentation", _object(F.array(*[pair(k, v.cast("string")) for k, v in seconds.items()]))))
    review, recall = canonical_object(profile, "$.gemma_review", RETRY_SETTINGS), canonical_object(profile, "$.marlin_recall", tuple(WINDOW_SETTINGS))
    analysis = _object(F.array_compact(F.array(pair("gemma_review", review), pair("marlin_recall", recall), windows)))
    texts = {"analysis_cache_version": version, "category": category, "prompt_template": prompt, "model_id": model_id}
    fields = [pair(k, F.coalesce(_quoted(v), F.lit("null"))) for k, v in texts.items()]
    fields += [pair(k, F.coalesce(canonical_json(v), F.lit("{}"))) for k, v in {"marlin_queries": queries, "proxy": proxy}.items()]
    return F.sha2(_object(F.array(pair("analysis_profile", analysis), *fields)), 256)


def cache_key(video_id: Column, source: Column, configuration: Column) -> Column:
    return F.sha2(F.concat_ws("|", video_id.cast("string"), source, configuration), 256)


def frame_quality(luma: Column, width: int) -> Column:
    """Exposure and edge figures of a row-major grey image, with the acceptance verdict."""
    size = F.size(luma)
    share = lambda test: F.size(F.filter(luma, test)) / size
    total = F.aggregate(luma, F.lit(0).cast("long"), lambda a, x: a + x)

    def edge(i: Column) -> Column:
        centre = F.get(luma, i)
        inner = (i >= width) & (i < size - width) & (i % width > 0) & (i % width < width - 1)
        around = sum((F.get(luma, i + d) for d in (-width, width - 1, width, width + 1, 1, 1 - width, -width - 1)), F.get(luma, i - 1))
        return F.when(inner, F.least(F.lit(255), F.greatest(F.lit(0), centre * 8 - around))).otherwise(centre).cast("long")

    edges = F.transform(F.sequence(F.lit(0), size - 1), edge)
    e1 = F.aggregate(edges, F.lit(0).cast("long"), lambda a, x: a + x)
    e2 = F.aggregate(edges, F.lit(0).cast("long"), lambda a, x: a + x * x)
    high, low, mean = share(lambda x: x >= 245), share(lambda x: x <= 10), total / size
    variance = (e2 - e1 * e1 / size) / size
    accept = (high < 0.38) & (low < 0.72) & (mean > 18.0) & (mean < 238.0) & (variance >= 28.0)
    return F.struct(
        F.round(high, 4).alias("highlight_ratio"), F.round(low, 4).alias("shadow_ratio"),
        F.round(mean, 2).alias("mean_luma"), F.round(variance, 2).alias("edge_variance"), accept.alias("acceptable"),
    )
