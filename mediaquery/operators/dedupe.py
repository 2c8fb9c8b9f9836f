"""Greedy suppression, review windows and near-duplicate frames.

Greedy steps are sequential inside a video. Videos of ordinary size are folded with higher-order
functions; videos above ``bound`` rows go through rounds that touch a bounded head per video and
settle the rest with joins, so no task ever gathers an unbounded group and the result is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaquery.functions.hashing import hash_distance
from mediaquery.operators.ranking import top_per_key
from mediaquery.session import cut_lineage


def _oversized(rows: DataFrame, key: str, bound: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bound).select(key)


def _strength() -> Column:
    """A missing confidence is the weakest, whichever path ranks it."""
    return F.coalesce(F.col("confidence"), F.lit(0.0))


def _greedy(rows: DataFrame, key: str, ratio: float) -> DataFrame:
    """Greedy keep per key, strongest first; groups must be small enough to gather."""
    columns = [c for c in rows.columns if c != key]
    entry = F.struct((-_strength()).alias("__c"), F.col("position").alias("__p"), F.struct(*columns).alias("row"))
    ranked = rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("__r"))
    none = F.slice("__r", F.lit(1), F.lit(0))

    def hits(a: Column, b: Column) -> Column:
        inter = F.least(a["row"]["end_ms"], b["row"]["end_ms"]) - F.greatest(a["row"]["start_ms"], b["row"]["start_ms"])
        shorter = F.greatest(F.lit(1), F.least(a["row"]["end_ms"] - a["row"]["start_ms"], b["row"]["end_ms"] - b["row"]["start_ms"]))
        return inter >= shorter * ratio

    kept = F.aggregate("__r", none, lambda acc, x: F.when(F.exists(acc, lambda k: hits(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return ranked.select(key, F.explode(kept).alias("k")).select(key, "k.row.*").select(*rows.columns)


def _spread(rows: DataFrame, bin_ms: int) -> DataFrame:
    low, high = F.floor(F.col("start_ms") / bin_ms), F.floor(F.greatest(F.col("end_ms") - 1, F.col("start_ms")) / bin_ms)
    return rows.withColumn("__bin", F.explode(F.sequence(low, high)))


def suppress_overlaps(
    candidates: DataFrame, ratio: float = 0.75, key: str = "video_id", id: str = "candidate_id", bound: int = 4_096, bin_ms: int = 4_000
) -> DataFrame:
    """Keep a candidate unless a stronger kept one covers ``ratio`` of the shorter interval.

    Needs candidate id, start_ms, end_ms, confidence and position (input order, breaks ties).
    A null confidence counts as 0. Oversized videos: the ``bound`` strongest are settled, everything they suppress is removed by a
    time-binned semi join, and the remainder goes to the next round; kept intervals of one video are
    few because they may not cover each other.
    """
    hot = cut_lineage(_oversized(candidates, key, bound))
    if hot.isEmpty():
        return _greedy(candidates, key, ratio)
    result = _greedy(candidates.join(hot, key, "left_anti"), key, ratio)
    rest = cut_lineage(candidates.join(hot, key, "left_semi"))
    while not rest.isEmpty():
        head = cut_lineage(top_per_key(rest, key, [_strength().desc(), F.col("position")], bound, "__rank").drop("__rank"))
        kept = cut_lineage(_greedy(head, key, ratio))
        result = result.unionByName(kept)
        later = rest.join(head.select(key, id), [key, id], "left_anti")
        a, b = _spread(later.select(key, id, "start_ms", "end_ms"), bin_ms).alias("a"), _spread(kept.select(key, "start_ms", "end_ms"), bin_ms).alias("b")
        inter = F.least(F.col("a.end_ms"), F.col("b.end_ms")) - F.greatest(F.col("a.start_ms"), F.col("b.start_ms"))
        shorter = F.greatest(F.lit(1), F.least(F.col("a.end_ms") - F.col("a.start_ms"), F.col("b.end_ms") - F.col("b.start_ms")))
        same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__bin") == F.col("b.__bin"))
        covered = a.join(b, same & (inter >= shorter * ratio), "left_semi").select(key, id).distinct()
        rest = cut_lineage(later.join(covered, [key, id], "left_anti"))
    return result


def review_spans(
    recalls: DataFrame, *, context_ms: int = 1_500, max_window_ms: int = 12_000, max_recall_ms: int = 30_000, key: str = "video_id"
) -> DataFrame:
    """Padded or recentred window of every usable recall; precise recalls of a video displace broad ones."""
    limit = max(max_window_ms, max_recall_ms)
    start = F.greatest(F.lit(0), F.least(F.col("dur_ms"), F.col("start_ms")))
    end = F.greatest(start, F.least(F.col("dur_ms"), F.col("end_ms")))
    usable = recalls.where("ok").withColumns({"__s": start, "__e": end}).where(F.col("__e") > F.col("__s"))
    usable = usable.withColumn("__precise", F.col("__e") - F.col("__s") <= limit)
    precise = usable.where("__precise").select(key).distinct()
    chosen = usable.where("__precise").unionByName(usable.where(~F.col("__precise")).join(precise, key, "left_anti"))
    s, e = F.greatest(F.lit(0), F.col("__s") - context_ms), F.least(F.col("dur_ms"), F.col("__e") + context_ms)
    wide = e - s > max_window_ms
    left = F.greatest(F.lit(0).cast("long"), F.floor((F.col("__s") + F.col("__e") - max_window_ms) / 2))
    right = F.least(F.col("dur_ms"), left + max_window_ms)
    return chosen.select(
        key, "recall_id", "query_group", "description", F.when(wide, F.greatest(F.lit(0).cast("long"), right - max_window_ms)).otherwise(s).alias("s"),
        F.when(wide, right).otherwise(e).alias("e"))


def _fold_windows(spans: DataFrame, key: str, max_ms: int, limit: int) -> DataFrame:
    """Merged windows of each key, folded in (start, end) order over distinct spans."""
    grouped = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("__w"))
    kind = "array<struct<s:bigint,e:bigint,fs:bigint,fe:bigint>>"

    def entry(x: Column, cur: Column | None = None) -> Column:
        if cur is None:
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["s"].alias("fs"), x["e"].alias("fe"))
        return F.struct(cur["s"].alias("s"), F.greatest(cur["e"], x["e"]).alias("e"), cur["fs"].alias("fs"), cur["fe"].alias("fe"))

    def step(acc: Column, x: Column) -> Column:
        cur = F.get(acc, F.size(acc) - 1)
        joins = (x["s"] <= cur["e"]) & (F.greatest(cur["e"], x["e"]) - cur["s"] <= max_ms)
        differs = (F.abs(x["s"] - cur["s"]) > 10) | (F.abs(x["e"] - cur["e"]) > 10)
        return (
            F.when((F.size(acc) > 0) & joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(entry(x, cur))))
            .when((F.size(acc) == 0) | differs, F.concat(acc, F.array(entry(x)))).otherwise(acc)
        )

    folded = F.slice(F.aggregate("__w", F.array().cast(kind), step), 1, limit)
    return grouped.select(key, F.posexplode(folded).alias("n", "w")).select(
        key, (F.col("n") + 1).alias("window"), F.col("w.s").alias("start_ms"), F.col("w.e").alias("end_ms"), F.struct(F.col("w.fs").alias("s"), F.col("w.fe").alias("e")).alias("lo"))


def _round_windows(spans: DataFrame, key: str, max_ms: int, limit: int) -> DataFrame:
    """The same fold for oversized keys: one distributed round per output window.

    A round knows the window's first span and finds the first later span that breaks it. Spans are
    reduced to at most one row per start millisecond of the window, at most ``max_ms + 2`` per key.
    """
    seed = spans.groupBy(key).agg(F.min(F.struct("s", "e")).alias("seed"))
    out = None
    for n in range(1, limit + 1):
        seed = cut_lineage(seed)
        if seed.isEmpty():
            break
        top = F.col("seed.s") + max_ms
        near = F.col("s") - F.col("seed.s") <= 10
        later = spans.join(seed, key).where(F.struct("s", "e") >= F.col("seed"))
        slots = later.groupBy(key, "seed", F.least(F.col("s"), top + 1).alias("slot")).agg(
            F.max(F.when((F.col("s") <= top) & (F.col("e") <= top), F.col("e"))).alias("reach"),
            F.min(F.when((F.col("s") <= top) & (F.col("e") > top) & ~near, F.col("e"))).alias("over"),
            F.sort_array(F.collect_set(F.when((F.col("e") > top) & near, F.col("e")))).alias("overs"),
            F.min(F.struct("s", "e")).alias("first"))
        order = W.partitionBy(key).orderBy("slot")
        before = F.max("reach").over(order.rowsBetween(W.unboundedPreceding, -1))
        upto = F.max("reach").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        seen = slots.withColumns({"before": before, "upto": upto})
        gap = (F.col("slot") > top) | (F.col("before").isNotNull() & (F.col("slot") > F.col("before")))
        over = F.coalesce("over", F.get(F.filter("overs", lambda x: x > F.col("upto") + 10), F.lit(0)))
        broken = F.when(gap, F.col("first")).when(over.isNotNull(), F.struct(F.col("slot").alias("s"), over.alias("e")))
        marked = seen.withColumns({"brk": broken, "gap": gap})
        ends = marked.groupBy(key, "seed").agg(F.min("brk").alias("brk"), F.min_by("gap", "brk").alias("by_gap"))
        inside = marked.drop("brk", "gap").join(ends, [key, "seed"]).where(
            F.col("brk").isNull() | (F.col("slot") < F.col("brk.s")) | ((F.col("slot") == F.col("brk.s")) & ~F.col("by_gap")))
        done = inside.groupBy(key, "seed", "brk").agg(F.max("reach").alias("end_ms"))
        done = cut_lineage(done.select(key, F.lit(n).alias("window"), F.col("seed.s").alias("start_ms"), "end_ms", F.col("seed").alias("lo"), "brk"))
        seed = done.where(F.col("brk").isNotNull()).select(key, F.col("brk").alias("seed"))
        out = done if out is None else out.unionByName(done)
    return out


def review_windows(
    recalls: DataFrame, *, max_windows: int = 8, max_window_ms: int = 12_000, key: str = "video_id", bound: int = 4_096, **spans_args
) -> DataFrame:
    """First ``max_windows`` bounded review windows per video with their distinct groups and descriptions."""
    spans = cut_lineage(review_spans(recalls, max_window_ms=max_window_ms, key=key, **spans_args))
    unique = spans.select(key, "s", "e").distinct()
    hot = cut_lineage(_oversized(unique, key, bound))
    # One window more than wanted, so that the last kept one knows the span that ended it.
    small = _fold_windows(unique.join(hot, key, "left_anti"), key, max_window_ms, max_windows + 1)
    following = F.lead("lo").over(W.partitionBy(key).orderBy("window"))
    windows = small.withColumn("brk", following).where(F.col("window") <= max_windows)
    if not hot.isEmpty():
        large = _round_windows(cut_lineage(unique.join(hot, key, "left_semi")), key, max_window_ms, max_windows)
        windows = windows.unionByName(large.select(*windows.columns))
    windows = cut_lineage(windows)
    span = F.struct("s", "e")
    # Members lie between a window's first span and the span that opened the next one; a span dropped as
    # a repeat or behind the last kept window fails the size test.
    members = spans.join(windows, key).where(
        (span >= F.col("lo")) & (F.col("brk").isNull() | (span < F.col("brk"))) & (F.col("s") <= F.col("end_ms")) & (F.col("e") <= F.col("end_ms")))

    def distinct_in_order(column: str) -> DataFrame:
        seen = members.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(key, "window", column).agg(F.min(F.struct("s", "e", "recall_id")).alias("o"))
        return seen.groupBy(key, "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", column))), lambda x: x[column]).alias(f"{column}s"))

    return windows.select(key, "window", "start_ms", "end_ms").join(distinct_in_order("query_group"), [key, "window"], "left").join(
        distinct_in_order("description"), [key, "window"], "left")


def near_hashes(left: DataFrame, right: DataFrame, distance: int, keys: Sequence[str] = (), words: int = 4) -> DataFrame:
    """(keys, hash, prior_hash, gap) of the distinct hashes of both sides within ``distance``; a pair may come repeatedly.

    The 64 bits are cut into words; two hashes within ``distance`` agree in some word up to ``distance // words``
    flipped bits, so the prior side is spread over those flips and both meet in an equi-join on (word, value) - exact.
    At distance 10, four words make 548 copies of a hash and one candidate per 120 pairs, for many hashes; eleven words
    make 11 copies and one candidate per 6, for few.
    """
    left, right = left.select(*keys, "hash"), right.select(*keys, F.col("hash").alias("prior_hash"))
    cuts = [i * 64 // words for i in range(words + 1)]
    flips = _flip_masks(max(hi - lo for lo, hi in zip(cuts, cuts[1:])), distance // words)

    def parts(h: Column) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("word"), F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << hi - lo) - 1)).alias("value")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])

    a = left.select("*", F.explode(parts(F.col("hash"))).alias("w")).select(*left.columns, "w.*")
    b = right.select("*", F.explode(parts(F.col("prior_hash"))).alias("w")).select(*right.columns, "w.*")
    b = b.select(*right.columns, "word", "value", F.explode(F.array(*[F.lit(m) for m in flips])).alias("m")).select(
        *right.columns, "word", F.col("value").bitwiseXOR(F.col("m")).alias("value"))
    gap = hash_distance(F.col("hash"), F.col("prior_hash")).cast("int")
    return a.join(b, [*keys, "word", "value"]).withColumn("gap", gap).where(F.col("gap") <= distance).select(*keys, "hash", "prior_hash", "gap")


def hash_near_duplicates(frames: DataFrame, prior: DataFrame, distance: int = 10, scope: str | None = None) -> DataFrame:
    """Distance from each frame hash to the nearest prior hash within ``distance`` (null when none); copies meet once."""
    keys = [scope] if scope else []
    near = near_hashes(frames.select(*keys, "hash").distinct(), prior.select(*keys, "hash").distinct(), distance, keys)
    near = near.groupBy(*keys, "hash").agg(F.min("gap").alias("nearest"))
    return frames.join(near, [*keys, "hash"], "left").withColumn("duplicate", F.col("nearest").isNotNull())


def _flip_masks(bits: int, most: int) -> list[int]:
    masks, layer = {0}, {0}
    for _ in range(most):
        layer = {m ^ (1 << i) for m in layer for i in range(bits)}
        masks |= layer
    return sorted(masks)
