"""Run, source and creative reports: every report is one or two aggregates with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaquery.functions.ordered import ordered_scan
from mediaquery.functions.text import author_display, file_name, localized_message
from mediaquery.operators.audio import ordered_text
from mediaquery.session import cut_lineage

#: Items of a member, and members of an item, that one task may order.
WIDE, HOLDERS = 1 << 16, 1 << 12


def category_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("category").agg(F.count(F.lit(1)).alias("videos"))


def source_rollup(candidates: DataFrame) -> DataFrame:
    """Per video: candidates, share of the pool and event histogram, most frequent first."""
    total = candidates.agg(F.count(F.lit(1))).scalar()
    counted = candidates.groupBy("video_id", "event").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("seen"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "seen", "event", "n")))
    rolled = counted.groupBy("video_id").agg(F.sum("n").alias("candidate_count"), listed.alias("l"))
    events = F.transform("l", lambda x: F.struct(x["event"].alias("event"), x["n"].alias("n")))
    return rolled.select("video_id", "candidate_count", F.round(F.col("candidate_count") / F.greatest(F.lit(1), total), 4).alias("candidate_ratio"),
                         events.alias("events")).orderBy(F.col("candidate_count").desc(), "video_id")


def source_summary(rollup: DataFrame, failures: DataFrame) -> DataFrame:
    """Source rows plus failed videos without candidates, the latter with zeros and their error."""
    lost = failures.join(rollup.select("video_id"), "video_id", "left_anti").select(
        "video_id", F.lit(0).cast("long").alias("candidate_count"), F.lit(0.0).alias("candidate_ratio"),
        author_display(F.coalesce("path", F.lit(""))).alias("author"), file_name(F.coalesce("path", F.lit(""))).alias("filename"),
        F.coalesce("error", F.lit("analysis failed")).alias("error"))
    return rollup.unionByName(lost, allowMissingColumns=True)


def run_summary(candidates: DataFrame, creatives: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts of each run from three tables, each reduced to one row per run before they meet."""
    pool = candidates.groupBy("run_id").agg(F.count_distinct("video_id").alias("videos"), F.count(F.lit(1)).alias("candidates"))
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    results = creatives.groupBy("run_id").agg(F.count(F.lit(1)).alias("requested"), status("committed"), status("partial"), status("failed"))
    lost = failures.groupBy("run_id").agg(F.count(F.lit(1)).alias("analysis_failures"))
    return pool.join(results, "run_id", "full").join(lost, "run_id", "full").fillna(0)


def diversity_summary(assignments: DataFrame, history: DataFrame) -> DataFrame:
    used = assignments.groupBy("run_id", "candidate_id").agg(F.count(F.lit(1)).alias("n"))
    joined = used.join(history.select("candidate_id", "exported_count"), "candidate_id", "left")
    new = F.coalesce("exported_count", F.lit(0)) == 0
    per_run = joined.groupBy("run_id").agg(
        F.sum("n").alias("selected_candidate_count"), F.count(F.lit(1)).alias("unique_candidate_count"),
        F.max("n").alias("maximum_candidate_use_count"), F.round(F.sum(F.when(new, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("never_used_candidate_ratio"))
    creatives = assignments.groupBy("run_id").agg(F.count_distinct("creative_id").alias("creative_count"))
    return creatives.join(per_run, "run_id")


def pairwise_overlap(assignments: DataFrame) -> DataFrame:
    """Overlap of creatives of one run that share a candidate or a source.

    Pairs come from an inverted index on (run, item), never from all pairs of a run; pairs that share
    nothing have ratio 0 by definition and no row. Hot items are split by AQE's skew join.
    """
    run = ["run_id"]

    def shared(item: str, name: str) -> tuple[DataFrame, DataFrame]:
        owned = assignments.select("run_id", "creative_id", item).distinct()
        a = owned.withColumnRenamed("creative_id", "a")
        b = owned.withColumnRenamed("creative_id", "b")
        hits = a.join(b, ["run_id", item]).where(F.col("a") < F.col("b")).groupBy("run_id", "a", "b").agg(F.count(F.lit(1)).alias(name))
        return hits, owned.groupBy("run_id", "creative_id").agg(F.count(F.lit(1)).alias(f"{name}_size"))

    candidates, candidate_sizes = shared("candidate_id", "c")
    sources, source_sizes = shared("video_id", "s")
    opener = assignments.groupBy("run_id", "creative_id").agg(F.min_by("video_id", "pos").alias("opener"))
    facts = candidate_sizes.join(source_sizes, ["run_id", "creative_id"]).join(opener, ["run_id", "creative_id"])
    side = lambda x: facts.select(*run, F.col("creative_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("c_size", "s_size", "opener")])
    pairs = candidates.join(sources, ["run_id", "a", "b"], "full").fillna(0).join(side("a"), ["run_id", "a"]).join(side("b"), ["run_id", "b"])
    ratio = lambda n: F.round(F.col(n) / F.greatest(F.lit(1), F.least(f"a_{n}_size", f"b_{n}_size")), 4)
    return pairs.select("run_id", "a", "b", ratio("c").alias("candidate_overlap_ratio"), ratio("s").alias("source_overlap_ratio"),
                        (F.col("a_opener") == F.col("b_opener")).alias("opening_source_same"))


def composition_errors(creatives: DataFrame, picks: DataFrame, timeline_errors: DataFrame, package_errors: DataFrame, target_sources: int = 0) -> DataFrame:
    """(creative_id, error) of every planned creative, also of those that nothing was picked for.

    ``creatives`` has creative_id and slot_count, ``picks`` creative_id and video_id, ``timeline_errors`` one error a
    row, ``package_errors`` a list for each creative. Errors are rows, so that no creative's are gathered.
    """
    picked = picks.groupBy("creative_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video_id").alias("sources"))
    facts = creatives.join(picked, "creative_id", "left").fillna(0, ["n", "sources"])
    counted = lambda text, have, want: F.concat(F.lit(text), F.col(have).cast("string"), F.lit("/"), want.cast("string"))
    short = F.when(F.col("n") < F.col("slot_count"), counted("insufficient unique candidates: ", "n", F.col("slot_count")))
    few = F.when(F.lit(target_sources > 0) & (F.col("sources") != target_sources), counted("insufficient distinct source videos: ", "sources", F.lit(target_sources)))
    own = facts.select("creative_id", F.explode(F.array_compact(F.array(short, few))).alias("error"))
    return timeline_errors.select("creative_id", "error").unionByName(package_errors.select("creative_id", F.explode("errors").alias("error"))).unionByName(own)


def composition_verdicts(creatives: DataFrame, picks: DataFrame, errors: DataFrame) -> DataFrame:
    """(creative_id, slot_count, picked, source_count, error_count, passed, partial) of every planned creative."""
    picked = picks.groupBy("creative_id").agg(F.count(F.lit(1)).alias("picked"), F.count_distinct("video_id").alias("source_count"))
    broken = errors.groupBy("creative_id").agg(F.count(F.lit(1)).alias("error_count"))
    facts = creatives.select("creative_id", "slot_count").join(picked, "creative_id", "left").join(broken, "creative_id", "left").fillna(0, ["picked", "source_count", "error_count"])
    return facts.withColumns({"passed": F.col("error_count") == 0, "partial": F.col("picked") < F.col("slot_count")})


def shared_items(assignments: DataFrame, item: str = "candidate_id", key: str = "run_id", member: str = "creative_id") -> DataFrame:
    """(key, member, item, n, f, back) of items that two or more members of a key hold, written once.

    ``n`` is the member's number of items, ``f`` the item's number of members, ``back`` its place in the member from
    the most frequent item on. A member above ``WIDE`` items is not ordered in one task: ``back`` is then ``n``, the
    largest place, with which filters by place keep more than they must.
    """
    owned = assignments.select(key, member, item).where(F.col(item).isNotNull()).distinct()
    sizes = owned.groupBy(key, member).agg(F.count(F.lit(1)).alias("n"))
    held = owned.groupBy(key, item).agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rows = owned.join(held, [key, item]).join(sizes, [key, member])
    place = F.row_number().over(W.partitionBy(key, member).orderBy(F.desc("f"), F.desc(item))).cast("long")
    ordered = rows.where(F.col("n") <= WIDE).withColumn("back", place)
    return cut_lineage(ordered.unionByName(rows.where(F.col("n") > WIDE).withColumn("back", F.col("n"))))


def meetings(shared: DataFrame, need: Column, item: str = "candidate_id", key: str = "run_id", member: str = "creative_id") -> DataFrame:
    """(key, a, b, size): pairs that may share ``need`` items, an expression over a row of ``shared`` as the smaller member.

    Members are ordered by item frequency, rarest first. Two members with ``need`` shared items have their rarest one
    at least ``need`` places before the end of both, so the most frequent items, which nearly all members hold, are
    not looked up at all. The smaller member (by size, then id) asks.
    """
    asking = shared.withColumn("need", need).where("back >= need").select(key, item, F.col(member).alias("a"), F.col("n").alias("size"), "need")
    asked = shared.select(key, item, F.col(member).alias("b"), F.col("n").alias("nb"), F.col("back").alias("kb"))
    met = asking.join(asked, [key, item]).where("kb >= need").where("nb > size or (nb = size and b > a)")
    return met.select(key, "a", "b", "size").distinct()


def _overlaps(shared: DataFrame, met: DataFrame, item: str, key: str, member: str) -> DataFrame:
    """(key, a, b, hits, size) of pairs with their exact number of shared items."""
    of = lambda x: shared.select(key, F.col(member).alias(x), item)
    both = met.join(of("a"), [key, "a"]).join(of("b"), [key, "b", item])
    return both.groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("hits"), F.min("size").alias("size"))


def pairs_over(assignments: DataFrame, over: float = 0.2, item: str = "candidate_id", key: str = "run_id", member: str = "creative_id") -> DataFrame:
    """(key, a, b, overlap): pairs whose shared items exceed ``over`` of the smaller member's."""
    shared = shared_items(assignments, item, key, member)
    met = meetings(shared, F.floor(F.col("n") * over) + 1, item, key, member)
    found = _overlaps(shared, met, item, key, member).where(F.col("hits") / F.col("size") > over)
    return found.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(F.col("hits") / F.col("size"), 4).alias("overlap"))


def maximum_overlap(assignments: DataFrame, over: float = 0.2, item: str = "candidate_id", key: str = "run_id", member: str = "creative_id") -> DataFrame:
    """(key, overlap): the largest overlap of two members of each key, where it exceeds ``over``; no pair report is built.

    Members next to each other among an item's holders give a lower bound in one linear pass. Only pairs that beat
    it need to meet, so an item that all members hold, or a group of equal members, gives no quadratic output.
    """
    shared = shared_items(assignments, item, key, member)
    bucket = F.pmod(F.xxhash64(member), F.ceil(F.col("f") / HOLDERS)).alias("bucket")
    near = W.partitionBy(key, item, "bucket").orderBy("n", member)
    next_to = shared.select("*", bucket).select(key, F.col(member).alias("a"), F.lead(member).over(near).alias("b"), F.col("n").alias("size")).where("b is not null")
    hits = next_to.groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("hits"), F.min("size").alias("size"))
    lower = cut_lineage(hits.groupBy(key).agg(F.max_by(F.struct("hits", "size"), F.col("hits") / F.col("size")).alias("x")).select(key, "x.hits", "x.size"))
    bounded = shared.join(lower.select(key, F.col("hits").alias("lh"), F.col("size").alias("ls")), key)
    met = meetings(bounded, F.greatest(F.floor(F.col("n") * F.col("lh") / F.col("ls")), F.floor(F.col("n") * over)) + 1, item, key, member)
    better = _overlaps(shared, met, item, key, member).select(key, "hits", "size")
    best = lower.unionByName(better).groupBy(key).agg(F.max(F.col("hits") / F.col("size")).alias("ratio"))
    return best.where(F.col("ratio") > over).select(key, F.round("ratio", 4).alias("overlap"))


def _percent(ratio: Column) -> Column:
    return F.concat(F.round(ratio * 100, 0).cast("long").cast("string"), F.lit("%"))


def run_alerts(summary: DataFrame, sources: DataFrame, overlaps: DataFrame, diversity: DataFrame, creatives: DataFrame) -> DataFrame:
    """Threshold alerts of every run with level and message; ``overlaps`` has a run's largest overlap (``maximum_overlap``)."""
    s = F.col
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    unfinished = s("partial") + s("failed")
    overall = summary.select("run_id", F.explode(F.array_compact(F.array(
        F.when(s("analysis_failures") > 0, F.struct(F.lit("red").alias("level"), text(s("analysis_failures"), " 条源视频分析失败").alias("message"))),
        F.when((s("candidates") > 0) & (s("candidates") < 55), F.struct(
            F.lit("yellow").alias("level"), text("候选池低于 55 个候选的生产目标（", s("candidates"), "/55）").alias("message"))),
        F.when(unfinished > 0, F.struct(F.lit("red").alias("level"), text(unfinished, " 条成片处于部分完成或失败状态").alias("message"))),
    ))).alias("x")).select("run_id", "x.*")
    share = sources.where(s("candidate_ratio") > 0.25).select("run_id", F.lit("red").alias("level"), text(
        s("author"), " 贡献了候选池的 ", _percent(s("candidate_ratio")), "，单一来源占比过高").alias("message"))
    overlap = overlaps.select("run_id", F.col("overlap").alias("r")).where("r > 0.2").select("run_id", F.lit("red").alias("level"), text(
        "两条成片之间的最大候选重合率为 ", _percent(s("r")), "，超过 20% 阈值").alias("message"))
    unused = diversity.where(s("never_used_candidate_ratio") < 0.8).select("run_id", F.lit("yellow").alias("level"), text(
        "历史未使用候选占比为 ", _percent(s("never_used_candidate_ratio")), "，低于 80% 目标").alias("message"))
    invalid = creatives.where(F.size("errors") > 0).select("run_id", F.lit("red").alias("level"), text(
        s("creative_id"), "：", F.array_join(F.transform("errors", localized_message), "；")).alias("message"))
    cover = creatives.where(s("cover_ok") == F.lit(False)).select("run_id", F.lit("yellow").alias("level"), text(
        s("creative_id"), "：Image2 生成失败，当前使用备用封面").alias("message"))
    out = overall
    for part in (share, overlap, unused, invalid, cover):
        out = out.unionByName(part)
    return out


def routing_summary(routes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counters of the five routes; a cache hit counts only as a hit."""
    route = F.coalesce("route", F.lit(""))
    hit = route.startswith("cache_hit:")
    return routes.groupBy(*keys).agg(
        F.count_if(~hit & route.startswith("marlin_") & ~route.startswith("marlin_failed")).alias("marlin"), F.count_if(route == "gemma_only").alias("gemma_only"),
        F.count_if(route.startswith("marlin_failed")).alias("marlin_fallback"), F.count_if(hit).alias("cache_hit"), F.count_if(~hit).alias("cache_miss"))


def bgm_pool_summary(analyses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return analyses.groupBy(*keys).agg(F.count(F.lit(1)).alias("analyzed_count"), F.count_if("eligible").alias("eligible_count"))


def batch_result(creatives: DataFrame, failures: DataFrame) -> DataFrame:
    """Outcome of each run: ok needs no failed creative and at least one committed."""
    status = lambda s: F.count_if(F.col("status") == s)
    counts = creatives.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requested_count"), status("committed").alias("committed_count"), status("partial").alias("partial_count"),
        status("failed").alias("failed_count"))
    lost = failures.groupBy("run_id").agg(F.count(F.lit(1)).alias("__f"))
    warning = F.concat(F.col("__f").cast("string"), F.lit(" source video(s) failed analysis; the batch continued with successful candidates"))
    return counts.join(lost, "run_id", "left").withColumns({
        "ok": (F.col("failed_count") == 0) & (F.col("committed_count") > 0), "warning": F.when(F.col("__f") > 0, warning)}).drop("__f")


def merged_review_rows(reviews: DataFrame) -> DataFrame:
    """Candidates of all review windows of a video, numbered in window order (``raw_index`` from 1)."""
    rows = reviews.select("video_id", "window_index", F.posexplode("candidates").alias("item", "candidate"))
    return ordered_scan(rows, ["video_id"], [F.col("window_index"), F.col("item")], F.floor(F.col("window_index") / 64), rank="raw_index")


def merge_reviews(reviews: DataFrame) -> DataFrame:
    """Joined summary and number of candidates and rejects per video."""
    counts = reviews.groupBy("video_id").agg(F.sum(F.size("candidates")).alias("candidates"), F.sum(F.size("rejected")).alias("rejected"))
    return counts.join(ordered_text(reviews, ["video_id"], "window_index", "summary"), "video_id", "left")


def candidate_shortfall(materials: DataFrame, candidates: DataFrame, minimum: int) -> DataFrame:
    """Missing candidates per video and, for short videos, the intervals a top-up must avoid.

    Intervals are gathered only for videos below the minimum, so a gathered list has fewer than
    ``minimum`` entries.
    """
    minimum = max(1, minimum)
    counts = candidates.groupBy("video_id").agg(F.count(F.lit(1)).alias("usable"))
    base = materials.select("video_id").join(counts, "video_id", "left").fillna({"usable": 0})
    short = counts.where(F.col("usable") < minimum).select("video_id")
    entry = F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.col("event").alias("event"))
    listed = candidates.join(short, "video_id", "left_semi").groupBy("video_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("existing"))
    return base.join(listed, "video_id", "left").select(
        "video_id", "usable", F.greatest(F.lit(0), minimum - F.col("usable")).alias("shortfall"), (F.col("usable") >= minimum).alias("satisfied"),
        F.when(F.col("usable") < minimum, F.coalesce("existing", F.lit("[]"))).alias("existing"))


def creative_report(plans: DataFrame, results: DataFrame, selected: DataFrame) -> DataFrame:
    """Planned creatives with their status, sizes and sorted authors."""
    facts = selected.groupBy("creative_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.count_distinct("video_id").alias("source_count"))
    authors = selected.select("creative_id", author_display(F.col("video_path")).alias("a")).distinct().groupBy("creative_id").agg(
        F.array_sort(F.collect_set("a")).alias("authors"))
    status = F.coalesce("status", F.when(F.col("has_plan"), "planned").otherwise("starting"))
    return plans.join(results.select("creative_id", "status"), "creative_id", "left").join(facts, "creative_id", "left").join(
        authors, "creative_id", "left").select(
        "creative_id", status.alias("status"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.coalesce("source_count", F.lit(0)).alias("source_count"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"))


def subtitle_validation(subtitles: DataFrame, durations: DataFrame, key: str = "script_id") -> DataFrame:
    """Duration error, overlaps and verdict of each subtitle track."""
    nearby = ordered_scan(subtitles, [key], [F.col("line")], F.floor(F.col("line") / 4_096), lead={"__next": F.col("start_ms")})
    facts = nearby.groupBy(key).agg(
        F.count(F.lit(1)).alias("segment_count"), F.max_by("end_ms", "line").alias("__end"), F.count_if(F.col("end_ms") > F.col("__next") + 1).alias("overlap_count"))
    joined = durations.join(facts, key, "left")
    error = F.coalesce(F.abs(F.col("__end") - F.col("dur_ms")), F.col("dur_ms"))
    return joined.select(key, F.coalesce("segment_count", F.lit(0)).alias("segment_count"), F.coalesce("overlap_count", F.lit(0)).alias("overlap_count"),
                         error.alias("duration_error_ms"), (F.col("segment_count").isNotNull() & (error <= 50)).alias("passed"))
