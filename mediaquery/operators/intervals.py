"""Interval operators on integer milliseconds.

Ordered steps are scans (``ordered_scan``) that split hot keys, point-in-range tests are sweep lines, and interval
joins add a time bin to the key, so that one hot video or creative is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaquery.functions.ordered import heavy_keys, ordered_scan


def _seconds(ms: Column) -> Column:
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def overlap_pairs(intervals: DataFrame, ratio: float = 0.75, bin_ms: int = 4_000, key: str = "video_id", id: str = "candidate_id") -> DataFrame:
    """Pairs inside a video whose intersection covers ``ratio`` of the shorter interval.

    Both sides are spread over the time bins they touch; a pair is kept only in its first common bin.
    """
    first = F.floor(F.col("start_ms") / bin_ms)
    spread = intervals.select(
        key, F.col(id).alias("id"), "start_ms", "end_ms", first.alias("b0"),
        F.explode(F.sequence(first, F.floor(F.greatest(F.col("end_ms") - 1, F.col("start_ms")) / bin_ms))).alias("bin"))
    a, b = spread.alias("a"), spread.alias("b")
    inter = F.least(F.col("a.end_ms"), F.col("b.end_ms")) - F.greatest(F.col("a.start_ms"), F.col("b.start_ms"))
    shorter = F.greatest(F.lit(1), F.least(F.col("a.end_ms") - F.col("a.start_ms"), F.col("b.end_ms") - F.col("b.start_ms")))
    return a.join(b, [key, "bin"]).where(
        (F.col("a.id") < F.col("b.id")) & (F.col("bin") == F.greatest("a.b0", "b.b0")) & (inter >= shorter * ratio)
    ).select(key, F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), inter.alias("shared_ms"), shorter.alias("shorter_ms"))


def segment_windows(materials: DataFrame, *, maximum_ms: int = 120_000, segment_ms: int = 115_000, overlap_ms: int = 5_000) -> DataFrame:
    segment = min(maximum_ms, segment_ms)
    if segment <= 0 or overlap_ms < 0 or overlap_ms >= segment:
        raise ValueError("invalid segment duration/overlap configuration")
    step = segment - overlap_ms
    last = F.when(F.col("dur_ms") <= maximum_ms, 0).otherwise(F.ceil((F.col("dur_ms") - segment) / step)).cast("int")
    whole = F.col("dur_ms") <= maximum_ms
    return materials.select("*", F.explode(F.sequence(F.lit(0), last)).alias("segment_index")).withColumns({
        "start_ms": F.col("segment_index").cast("long") * step,
        "end_ms": F.when(whole, F.col("dur_ms")).otherwise(F.least(F.col("dur_ms"), F.col("segment_index").cast("long") * step + segment)),
    }).withColumn("segment_index", F.col("segment_index") + 1)


def rebase_times(rows: DataFrame, offset: str, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: F.col(c) + F.col(offset) for c in columns})


def rebase_reviews(rows: DataFrame) -> DataFrame:
    """Window-relative review answers as source times, clamped to their window."""
    clip = F.greatest(F.lit(0), F.col("window_end_ms") - F.col("window_start_ms"))
    start = F.greatest(F.lit(0), F.least(clip, F.col("start_ms")))
    end = F.greatest(start, F.least(clip, F.col("end_ms")))
    peak = F.greatest(start, F.least(end, F.coalesce(F.col("peak_ms"), F.bround((start + end) / 2).cast("long"))))
    valid = rows.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    shifted = {"start_ms": start, "end_ms": end, "peak_ms": peak}
    return valid.withColumns({c: F.col("window_start_ms") + v for c, v in shifted.items()})


def loop_beats(beats: DataFrame, end_ms: int, key: str = "track_id") -> DataFrame:
    """Source beats repeated with the track period up to ``end_ms``; one row per distinct time."""
    cycles = F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(end_ms) / F.col("dur_ms")) - 1)
    looped = beats.where((F.col("dur_ms") > 0) & (F.col("beat_ms") >= 0) & (F.col("beat_ms") < F.col("dur_ms"))).select(
        key, "beat_ms", "dur_ms", F.explode(cycles).alias("__n")).select(
        key, (F.col("beat_ms") + F.col("__n") * F.col("dur_ms")).alias("beat_ms"))
    once = beats.where((F.col("dur_ms") <= 0) & (F.col("beat_ms") >= 0)).select(key, "beat_ms")
    return looped.unionByName(once).where(F.col("beat_ms") <= end_ms).distinct()


def build_slots(beats: DataFrame, start_ms: int, end_ms: int, target_ms: int = 1_400, key: str = "track_id", keys: DataFrame | None = None) -> DataFrame:
    """Clip slots of one section, cut at the first beat past three quarters of the target length.

    Only distinct beats inside the section are gathered, so a group never exceeds ``end_ms - start_ms``
    values. ``keys`` adds tracks that have no beat inside the section.
    """
    inside = beats.where((F.col("beat_ms") > start_ms) & (F.col("beat_ms") < end_ms)).select(key, "beat_ms").distinct()
    grouped = inside.groupBy(key).agg(F.sort_array(F.collect_set("beat_ms")).alias("__b"))
    if keys is not None:
        grouped = keys.select(key).distinct().join(grouped, key, "left")
    points = F.concat(F.coalesce("__b", F.array().cast("array<bigint>")), F.array(F.lit(end_ms).cast("long")))
    empty = F.struct(F.lit(start_ms).cast("long").alias("cursor"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("slots"))
    need = target_ms * 0.75

    def step(acc: Column, point: Column) -> Column:
        cut = point - acc["cursor"] >= need
        slot = F.array(F.struct(acc["cursor"].alias("s"), point.alias("e")))
        return F.struct(F.when(cut, point).otherwise(acc["cursor"]).alias("cursor"),
                        F.when(cut, F.concat(acc["slots"], slot)).otherwise(acc["slots"]).alias("slots"))

    def finish(acc: Column) -> Column:
        end = F.lit(end_ms).cast("long")
        tail = F.array(F.struct(acc["cursor"].alias("s"), end.alias("e")))
        final = F.get(acc["slots"], F.size(acc["slots"]) - 1)
        stretched = F.concat(F.slice(acc["slots"], F.lit(1), F.size(acc["slots"]) - 1), F.array(F.struct(final["s"].alias("s"), end.alias("e"))))
        return (
            F.when(end - acc["cursor"] >= 600, F.concat(acc["slots"], tail))
            .when((F.size(acc["slots"]) > 0) & (final["e"] < end), stretched)
            .when((F.size(acc["slots"]) == 0) & (F.lit(end_ms) > start_ms), F.array(F.struct(F.lit(start_ms).cast("long").alias("s"), end.alias("e"))))
            .otherwise(acc["slots"])
        )

    slots = F.posexplode(F.aggregate(points, empty, step, finish)).alias("slot_index", "slot")
    return grouped.select(key, slots).select(
        key, (F.col("slot_index") + 1).alias("slot_index"), F.col("slot.s").alias("start_ms"), F.col("slot.e").alias("end_ms"))


def timeline_errors(timeline: DataFrame, duration_ms: int, tolerance_ms: int = 100) -> DataFrame:
    """One row per violation of a gap-free, overlap-free timeline."""
    nearby = ordered_scan(
        timeline, ["creative_id"], [F.col("start_ms"), F.col("pos")], rank="__rk",
        lead={"__ns": F.col("start_ms"), "__nid": F.col("clip_id")})
    last = F.col("__nid").isNull()
    pair = F.concat(F.col("clip_id"), F.lit("/"), F.col("__nid"))
    found = F.array_compact(F.array(
        F.when((F.col("__rk") == 1) & (F.col("start_ms") > 1), F.concat(F.lit("timeline starts with gap: 0/"), _seconds(F.col("start_ms")))),
        F.when(F.col("__ns") < F.col("end_ms") - 1, F.concat(F.lit("overlap: "), pair)),
        F.when(F.col("__ns") > F.col("end_ms") + 1,
               F.concat(F.lit("gap: "), pair, F.lit(" "), _seconds(F.col("end_ms")), F.lit("-"), _seconds(F.col("__ns")))),
        F.when(last & (F.col("end_ms") > duration_ms + tolerance_ms), "timeline exceeds campaign duration"),
        F.when(last & (F.col("end_ms") < duration_ms - 1),
               F.concat(F.lit("timeline ends with gap: "), _seconds(F.col("end_ms")), F.lit("/"), _seconds(F.lit(duration_ms)))),
    ))
    return nearby.select("creative_id", "clip_id", F.explode(found).alias("error"))


def repair_gaps(timeline: DataFrame, media: DataFrame, maximum_ms: int = 750) -> DataFrame:
    """Highlights stretched over the small gap behind them; gaps that cannot be closed carry ``error``."""
    nearby = ordered_scan(
        timeline, ["creative_id"], [F.col("start_ms"), F.col("pos")],
        lead={"next_ms": F.col("start_ms"), "next_clip": F.col("clip_id")})
    gaps = nearby.withColumn("gap_ms", F.col("next_ms") - F.col("end_ms")).where(F.col("gap_ms") > 1)
    joined = gaps.join(media.select("video_id", "media_ms"), "video_id", "left").fillna({"media_ms": 0})
    fixed = joined.withColumn("new_dur_ms", F.col("dur_ms") + F.col("gap_ms"))
    fits = F.col("source_in_ms") + F.col("new_dur_ms") <= F.col("media_ms") + 1
    moved = F.when(fits, F.col("source_in_ms")).otherwise(F.greatest(F.lit(0), F.col("media_ms") - F.col("new_dur_ms")))
    error = (
        F.when((F.col("clip_type") != "highlight") | (F.col("gap_ms") > maximum_ms), F.concat(
            F.lit("unrepairable main-track gap "), _seconds(F.col("gap_ms")), F.lit("s between "), F.col("clip_id"), F.lit(" and "), F.col("next_clip")))
        .when(F.col("source_in_ms") + F.col("new_dur_ms") > F.col("media_ms") + 1, F.concat(
            F.lit("source too short to repair "), F.col("clip_id"), F.lit(": need "), _seconds(F.col("new_dur_ms")), F.lit("s, media has "),
            _seconds(F.col("media_ms")), F.lit("s")))
    )
    return fixed.withColumn("source_in_ms", moved).withColumn("error", error)


def coalesce_intervals(ranges: DataFrame, key: str = "creative_id", touch_ms: int = 1) -> DataFrame:
    """Union of each key's ranges, merging those that touch; ``limit_ms``, if present, clamps them first."""
    if "limit_ms" in ranges.columns:
        start = F.greatest(F.lit(0), F.least(F.col("start_ms"), F.col("limit_ms")))
        ranges = ranges.withColumn("__s", start).withColumn("end_ms", F.greatest(F.col("__s"), F.least(F.col("end_ms"), F.col("limit_ms"))))
        ranges = ranges.withColumn("start_ms", F.col("__s"))
    kept = ranges.where(F.col("end_ms") > F.col("start_ms")).groupBy(key, "start_ms").agg(F.max("end_ms").alias("end_ms"))
    heavy = heavy_keys(ranges, [key])
    seen = ordered_scan(kept, [key], [F.col("start_ms")], heavy=heavy, prior_max={"__reach": F.col("end_ms")})
    fresh = F.when(F.col("__reach").isNull() | (F.col("start_ms") > F.col("__reach") + touch_ms), 1).otherwise(0)
    islands = ordered_scan(seen.withColumn("__new", fresh), [key], [F.col("start_ms")], heavy=heavy, running_sum={"island": F.col("__new")})
    return islands.groupBy(key, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def intervals_at_point(points: DataFrame, ranges: DataFrame, flag: str, key: str = "creative_id", at: str = "at") -> DataFrame:
    """Marks points lying in ``[start, end)`` of any range: a sweep over range edges, not a join."""
    payload = F.struct(*[c for c in points.columns if c != key])
    edges = ranges.where(F.col("end") > F.col("start")).select(key, F.explode(F.array(
        F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    edges = edges.groupBy(key, F.col("e.t").alias("__t")).agg(F.sum("e.d").alias("__d")).where(F.col("__d") != 0)
    events = points.select(key, F.col(at).alias("__t"), F.lit(0).cast("long").alias("__d"), F.lit(1).alias("__k"), payload.alias("__p")).unionByName(
        edges.select(key, "__t", "__d", F.lit(0).alias("__k"), F.lit(None).alias("__p")))
    swept = ordered_scan(events, [key], [F.col("__t"), F.col("__k")], running_sum={"__depth": F.col("__d")})
    return swept.where(F.col("__k") == 1).select(key, "__p.*", (F.col("__depth") > 0).alias(flag))


def slice_at_boundaries(beds: DataFrame, muted: DataFrame, ducked: DataFrame, minimum_ms: int = 10) -> DataFrame:
    """Music slices between loop points and range edges, without muted parts and with a ducking flag.

    ``beds`` has creative_id, limit_ms (music length on the timeline) and loop_ms (source length).
    """
    loops = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil((F.col("limit_ms") - 1) / F.col("loop_ms")) - 1)),
                        lambda k: k * F.col("loop_ms"))
    fixed = beds.select("creative_id", F.explode(F.array_union(loops, F.array("limit_ms"))).alias("t"), F.lit(0).alias("m"), F.lit(0).alias("d"))

    def tagged(ranges: DataFrame, mute: int, duck: int) -> DataFrame:
        return ranges.where(F.col("end_ms") > F.col("start_ms")).select("creative_id", "start_ms", "end_ms", F.lit(mute).alias("m"), F.lit(duck).alias("d"))

    # Touching muted ranges need no merging: the slices between them are shorter than any kept slice.
    inside = tagged(muted, 1, 0).unionByName(tagged(ducked, 0, 1)).join(beds.select("creative_id", "limit_ms"), "creative_id")
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("limit_ms")))
    edges = inside.select("creative_id", F.explode(F.array(
        F.struct(clamp("start_ms").alias("t"), F.col("m"), F.col("d")), F.struct(clamp("end_ms").alias("t"), (-F.col("m")).alias("m"), (-F.col("d")).alias("d")))).alias("p"))
    points = fixed.unionByName(edges.select("creative_id", "p.*"))
    points = points.groupBy("creative_id", "t").agg(F.sum("m").alias("m"), F.sum("d").alias("d"))
    swept = ordered_scan(points, ["creative_id"], [F.col("t")],
                         running_sum={"muted": F.col("m"), "ducked": F.col("d")}, lead={"end_ms": F.col("t")})
    kept = swept.where((F.col("end_ms") - F.col("t") > minimum_ms) & (F.col("muted") <= 0))
    return kept.join(beds.select("creative_id", "loop_ms"), "creative_id").select(
        "creative_id", F.col("t").alias("start_ms"), "end_ms", (F.col("ducked") > 0).alias("ducked"), (F.col("t") % F.col("loop_ms")).alias("source_ms"))


def voiceover_ranges(lines: DataFrame, timeline: DataFrame, output_ms: int, gap_ms: int = 100) -> DataFrame:
    """Spoken ranges of each creative, laid out from the product page or back from the end card."""
    def first(kind: str) -> Column:
        return F.min_by("start_ms", F.when(F.col("clip_type") == kind, F.col("pos")))

    anchors = timeline.groupBy("creative_id").agg(
        F.coalesce(first("fixed_openpage"), first("fixed_screenshot")).alias("__product"),
        F.coalesce(first("fixed_tail_sticker"), F.lit(output_ms).cast("long")).alias("__tail"))
    spoken = lines.where(F.col("audio_ms") > 0)
    totals = spoken.groupBy("creative_id").agg((F.sum("audio_ms") + gap_ms * (F.count(F.lit(1)) - 1)).alias("__total"))
    laid = ordered_scan(spoken, ["creative_id"], [F.col("line")], F.floor(F.col("line") / 1024), running_sum={"__run": F.col("audio_ms") + gap_ms})
    origin = F.coalesce("__product", F.greatest(F.lit(0).cast("long"), F.col("__tail") - F.col("__total")))
    placed = laid.join(totals, "creative_id").join(anchors, "creative_id", "left").fillna({"__tail": output_ms})
    placed = placed.withColumn("start_ms", origin + F.col("__run") - F.col("audio_ms") - gap_ms)
    placed = placed.withColumn("end_ms", F.least(F.col("__tail"), F.col("start_ms") + F.col("audio_ms")))
    return placed.where(F.col("end_ms") > F.col("start_ms")).select(*lines.columns, "start_ms", "end_ms")


def sample_timestamps(candidates: DataFrame, count: int) -> DataFrame:
    start, end = F.col("start_ms"), F.col("end_ms")
    inner = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: start + (end - start) * i / (count + 1))
    alone = F.array(F.coalesce(F.nullif(F.col("peak_ms"), F.lit(0)), start).cast("double"))
    return candidates.select("*", F.posexplode(F.when(end <= start, alone).otherwise(inner)).alias("sample", "at_ms"))


# The packaged intervals of a twenty-second creative.
PACKAGE = (
    ("pkg_openpage", "product_openpage", 7_200, 8_700),
    ("pkg_recording", "product_recording", 8_700, 12_800),
    ("pkg_endcard", "endcard", 17_500, 20_000),
)


def fixed_package_rows(campaigns: DataFrame) -> DataFrame:
    """Three packaged rows per campaign, produced row by row (no join)."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("clip_id"), F.lit(t).alias("source_type"), F.lit(s).cast("long").alias("start_ms"),
                 F.lit(e).cast("long").alias("end_ms"), F.col(f"{t}_asset_id").alias("asset_id"))
        for i, t, s, e in PACKAGE
    ])
    return campaigns.select("campaign_id", F.explode(rows).alias("r")).select("campaign_id", "r.*")


def package_errors(rows: DataFrame) -> DataFrame:
    """Missing packaged roles and a product page that does not lead straight into the recording."""
    seen = [F.max(F.when(F.col("source_type") == t, True)).alias(f"__{t}") for _, t, _, _ in PACKAGE]
    facts = rows.groupBy("campaign_id").agg(
        *seen, F.max(F.when(F.col("source_type") == "product_openpage", F.col("end_ms"))).alias("__open"),
        F.max(F.when(F.col("source_type") == "product_recording", F.col("start_ms"))).alias("__rec"))
    errors = [F.when(F.col(f"__{t}").isNull(), f"missing {t}") for _, t, _, _ in PACKAGE]
    errors.append(F.when(F.abs(F.col("__open") - F.col("__rec")) > 1, "product openpage must immediately precede product recording"))
    return facts.select("campaign_id", F.array_compact(F.array(*errors)).alias("errors"))


def compose_timeline(visual: DataFrame, package: DataFrame) -> DataFrame:
    """Visual and packaged items of each creative, ordered by start."""
    return visual.unionByName(package, allowMissingColumns=True).orderBy("creative_id", "start_ms")
