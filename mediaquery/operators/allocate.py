"""Filling creative slots from candidate pools.

Filling is sequential inside a pool: every pick changes the counts the next one sees. A pool, though,
may be a third of all rows, so Spark first cuts it to the candidates that can possibly be picked. With
T picks in total, at most T - 1 candidates, sources and authors are in use when a pick is made;
among T better unused ones of the same kind at least one is free, so only the T best candidates of
the T best sources of the T best authors can win, per slot and event. That keeps results exact and
bounds what one task receives by T, slots and events, whatever the pool size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaquery.session import cut_lineage

TRIM_SHARE = 0.8
SECOND_SECTION_MS = 7_200


@dataclass(frozen=True)
class Quotas:
    creatives: int = 5
    per_source: int = 2
    candidate_uses: int = 1
    source_uses: int = 3
    previous_penalty: float = 1.0
    history_penalty: float = 0.3
    target_sources: int = 0
    group_authors: bool = False
    avoid_author_reuse: bool = False


def _best(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= k).drop("__k")


def _leaders(rows: DataFrame, keys: list[str], member: str, worth: Column, k: int) -> DataFrame:
    """Keep rows of the k best members per key, a member being worth its best row."""
    best = rows.groupBy(*keys, member).agg(F.min(worth).alias("__w"))
    return rows.join(_best(best, keys, [F.col("__w"), F.col(member)], k).drop("__w"), [*keys, member], "left_semi")


def _fresh(rows: DataFrame) -> DataFrame:
    """The few slot rows as a stage table: read three times, and free of any shared lineage with the pool."""
    return cut_lineage(rows)


def _most_slots(slots: DataFrame, key: str) -> int:
    """Slots of the pool that has most: the pruning of candidates must allow a pick for each."""
    counted = slots.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def eligible_pool(pool: DataFrame, slots: DataFrame, picks: int, *, key: str, by_fit: bool, authors: bool, trim: bool = True) -> DataFrame:
    """The candidates of each pool that can be picked within ``picks`` picks; see the module text."""
    lengths = slots.select(key, (F.col("end_ms") - F.col("start_ms")).alias("slot_ms")).distinct()
    fit = F.abs(F.col("trim_ms") - F.col("slot_ms")) if by_fit else F.lit(0).cast("long")
    pool = pool.repartition(key, "candidate_id")
    # the few slots of a pool are broadcast: joined by pool, all its candidates would be ranked in one task
    ranked = pool.join(F.broadcast(lengths), key) if trim else pool.withColumn("slot_ms", F.lit(0).cast("long"))
    if trim:
        ranked = ranked.where(F.col("trim_ms") >= F.col("slot_ms") * TRIM_SHARE)
    ranked = ranked.withColumns({"__fit": fit, "__neg": -F.col("worth")})
    order = [F.col("__fit"), F.col("__neg"), F.col("position")]
    worth = F.struct("__fit", "__neg", "position")
    kept = _best(ranked, [key, "slot_ms", "event", "video_id"], order, picks)
    kept = _leaders(kept, [key, "slot_ms", "event", "author"] if authors else [key, "slot_ms", "event"], "video_id", worth, picks + 1)
    if authors:
        kept = _leaders(kept, [key, "slot_ms", "event"], "author", worth, picks + 1)
    return kept.select(*pool.columns).distinct()


def assign_single(slots: DataFrame, candidates: DataFrame, *, key: str = "pool_id", per_source: int = 2) -> DataFrame:
    """One creative per pool: no source twice in a row, a new event first, then the best score.

    When nothing is long enough or the only source left was just used, those two rules are dropped for
    the slot.
    """
    slots = _fresh(slots)
    most_slots = _most_slots(slots, key)
    ready = candidates.withColumns({"worth": F.col("final_score"), "author": F.lit("")})
    strict = eligible_pool(ready, slots, most_slots, key=key, by_fit=False, authors=False)
    loose = eligible_pool(ready, slots, most_slots, key=key, by_fit=False, authors=False, trim=False)
    pool = strict.unionByName(loose).distinct().drop("worth", "author")

    def fill(gaps: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position", kind="stable").reset_index(drop=True)
        video, event = group["video_id"].to_numpy(), group["event"].to_numpy()
        trim, score = group["trim_ms"].to_numpy(), group["final_score"].to_numpy()
        free, used, last, rows = np.ones(len(group), dtype=bool), {}, None, []
        for gap in gaps.sort_values("slot_index").itertuples():
            open_ = free & np.array([used.get(v, 0) < per_source for v in video], dtype=bool)
            good = open_ & (trim >= (gap.end_ms - gap.start_ms) * TRIM_SHARE)
            if last is not None:
                good &= video != video[last]
            choice = np.flatnonzero(good if good.any() else open_)
            if not len(choice):
                break
            repeat = event[choice] == event[last] if last is not None else np.zeros(len(choice), dtype=bool)
            last = choice[np.lexsort((choice, -score[choice], repeat))[0]]
            free[last] = False
            used[video[last]] = used.get(video[last], 0) + 1
            rows.append((getattr(gap, key), gap.slot_index, group["candidate_id"][last], video[last]))
        return pd.DataFrame(rows, columns=[key, "slot_index", "candidate_id", "video_id"])

    kinds = {f.name: f.dataType.simpleString() for f in [*slots.schema, *candidates.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, "slot_index", "candidate_id", "video_id"))
    return slots.groupBy(key).cogroup(pool.groupBy(key)).applyInPandas(fill, schema)


class _NeedsMoreSources(Exception):
    """The sources at hand cannot prove which group comes first."""


class _Filler:
    """State of one pool while its creatives are filled; candidates are arrays in rank order."""

    def __init__(self, slots: pd.DataFrame, pool: pd.DataFrame, q: Quotas):
        pool = pool.sort_values("position", kind="stable").reset_index(drop=True)
        slots = slots.sort_values("slot_index")
        self.q, self.ids = q, pool["candidate_id"].to_numpy()
        self.length = (slots["end_ms"] - slots["start_ms"]).to_numpy()
        self.section = (slots["start_ms"] >= SECOND_SECTION_MS).to_numpy()
        self.names, self.video = np.unique(pool["video_id"].to_numpy(), return_inverse=True)
        self.event, self.author = pool["event"].to_numpy(), pool["author"].to_numpy()
        self.trim, self.worth = pool["trim_ms"].to_numpy(), pool["worth"].to_numpy()
        self.stock = pool.groupby(self.video)["source_candidates"].first().to_numpy() if len(pool) else np.array([])
        outside = pool["outside_stock"].iloc[0] if len(pool) else None
        self.outside = None if pd.isna(outside) else int(outside)
        self.uses, self.source_uses = np.zeros(len(pool), dtype=int), np.zeros(len(self.names), dtype=int)
        self.spent = np.zeros(len(self.names), dtype=int)
        self.openers: set[int] = set()

    @staticmethod
    def _prefer(choice: np.ndarray, wish: np.ndarray) -> np.ndarray:
        return choice[wish] if wish.any() else choice

    def attempt(self, allowed: np.ndarray | None) -> list[int]:
        q, uses, source_uses = self.q, self.uses.copy(), self.source_uses.copy()
        local, taken, picks = np.zeros(len(self.names), dtype=int), np.zeros(len(uses), dtype=bool), []
        author, earlier, here = None, set(), set()
        for i, length in enumerate(self.length):
            ok = (uses < q.candidate_uses) & ~taken & (local[self.video] < q.per_source)
            ok &= (source_uses[self.video] < q.source_uses) & (self.trim >= length * TRIM_SHARE)
            if allowed is not None:
                ok &= allowed[self.video]
            choice = np.flatnonzero(ok)
            if q.target_sources:
                known = local[self.video[choice]] > 0
                missing = q.target_sources - int((local > 0).sum())
                if missing <= 0:
                    choice = choice[known]
                elif not q.group_authors or len(self.length) - i <= missing:
                    choice = self._prefer(choice, ~known)
            if i == 0:
                choice = self._prefer(choice, np.array([v not in self.openers for v in self.video[choice]], dtype=bool))
            if not len(choice):
                break
            if q.group_authors:
                if i and self.section[i] != self.section[i - 1]:
                    earlier |= here
                    author, here = None, set()
                if q.avoid_author_reuse and earlier:
                    choice = self._prefer(choice, np.array([a not in earlier for a in self.author[choice]], dtype=bool))
                if author is not None:
                    choice = self._prefer(choice, self.author[choice] == author)
            v, none = self.video[choice], np.zeros(len(choice), dtype=bool)
            same_source = v == self.video[picks[-1]] if picks and not q.group_authors else none
            same_event = self.event[choice] == self.event[picks[-1]] if picks else none
            order = np.lexsort((choice, -self.worth[choice], same_event, same_source, np.abs(self.trim[choice] - length), local[v], source_uses[v], uses[choice]))
            best = int(choice[order[0]])
            picks.append(best)
            taken[best] = True
            uses[best] += 1
            source_uses[self.video[best]] += 1
            local[self.video[best]] += 1
            author = self.author[best]
            here.add(author)
        return picks

    def groups(self):
        """Source groups of the target size, least used first, then richest, then by name."""
        open_ = np.flatnonzero((self.source_uses < self.q.source_uses) & (self.stock - self.spent > 0))
        size = self.q.target_sources
        if len(open_) < size:
            if self.outside is not None:
                raise _NeedsMoreSources
            return
        facts = sorted((int(self.source_uses[v]), -int(self.stock[v] - self.spent[v]), int(v)) for v in open_)

        def key(members: tuple[int, ...]):
            rows = [facts[m] for m in members]
            return sum(r[0] for r in rows), max(r[0] for r in rows), sum(r[1] for r in rows), tuple(sorted(r[2] for r in rows))

        first = tuple(range(size))
        heap, seen = [(key(first), first)], {first}
        while heap:
            ordered, members = heapq.heappop(heap)
            if self.outside is not None:
                # A group with a source that was left out sorts no earlier than this.
                used = sorted(f[0] for f in facts)[:size - 1]
                rich = sorted(f[1] for f in facts)[:size - 1]
                if ordered[:3] >= (sum(used), max(used, default=0), sum(rich) - self.outside):
                    raise _NeedsMoreSources
            yield np.array(ordered[3])
            for j in range(size):
                step = members[j] + 1
                if step < len(facts) and (j == size - 1 or step < members[j + 1]):
                    nxt = (*members[:j], step, *members[j + 1:])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (key(nxt), nxt))

    def creative(self) -> list[int]:
        if not self.q.target_sources:
            picks = self.attempt(None)
        else:
            picks, rank = [], (-1, -1)
            for group in self.groups():
                allowed = np.zeros(len(self.names), dtype=bool)
                allowed[group] = True
                tried = self.attempt(allowed)
                score = (len(tried), len(set(self.video[tried])))
                if score > rank:
                    picks, rank = tried, score
                if score == (len(self.length), self.q.target_sources):
                    picks = tried
                    break
        for p in picks:
            self.uses[p] += 1
            self.source_uses[self.video[p]] += 1
            if self.uses[p] == self.q.candidate_uses:
                self.spent[self.video[p]] += 1
        if picks:
            self.openers.add(int(self.video[picks[0]]))
        return picks


def assign_batch(slots: DataFrame, candidates: DataFrame, quotas: Quotas, *, key: str = "pool_id") -> DataFrame:
    """All creatives of each pool under candidate, source and author quotas.

    ``candidates`` needs candidate_id, video_id, author, event, trim_ms, final_score, position,
    exported_count and reserved.
    """
    slots = _fresh(slots)
    most_slots = _most_slots(slots, key)
    used = F.coalesce("exported_count", F.lit(0))
    worth = F.col("final_score") - F.when(used > 0, quotas.previous_penalty).otherwise(0.0) - used * quotas.history_penalty
    ready = candidates.where(~F.coalesce("reserved", F.lit(False))).withColumn("worth", worth).select(
        key, "candidate_id", "video_id", "author", "event", "trim_ms", "position", "worth")
    if quotas.target_sources:
        return _assign_groups(slots, ready, quotas, key, quotas.creatives * most_slots)
    pool = eligible_pool(ready, slots, quotas.creatives * most_slots, key=key, by_fit=True, authors=quotas.group_authors)
    unused = {"source_candidates": F.lit(0).cast("long"), "outside_stock": F.lit(None).cast("long")}
    return _fill_pools(slots, pool.withColumns(unused), quotas, key)


def _assign_groups(slots: DataFrame, ready: DataFrame, quotas: Quotas, key: str, picks: int, most_sources: int = 64) -> DataFrame:
    """Fills with an exact number of sources per creative.

    Groups are tried from the least used and richest sources on, so a pool is first filled from its
    ``most_sources`` richest sources. A pool whose order of groups cannot be proved from those is
    filled again from sixteen times as many, until its sources are complete.
    """
    ready = cut_lineage(ready.repartition(key, "candidate_id"))
    lengths = slots.select(key, (F.col("end_ms") - F.col("start_ms")).alias("slot_ms")).distinct()
    stock = cut_lineage(ready.groupBy(key, "video_id").agg(F.count(F.lit(1)).alias("source_candidates")))
    fits = ready.join(F.broadcast(lengths), key).where(F.col("trim_ms") >= F.col("slot_ms") * TRIM_SHARE).withColumn("__fit", F.abs(F.col("trim_ms") - F.col("slot_ms")))
    best = _best(fits, [key, "slot_ms", "event", "video_id"], [F.col("__fit"), F.col("worth").desc(), F.col("position")], picks)
    # One row of every source stays even if nothing of it is long enough: it may still be in a group.
    named = _best(ready, [key, "video_id"], [F.col("position")], 1)
    best = cut_lineage(best.select(*ready.columns).unionByName(named).distinct())
    open_slots, result = slots, None
    while True:
        ranked = stock.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(F.col("source_candidates").desc(), "video_id"))).where(F.col("__k") <= most_sources + 1)
        outside = ranked.where(F.col("__k") == most_sources + 1).select(key, F.col("source_candidates").alias("outside_stock"))
        near = ranked.where(F.col("__k") <= most_sources).drop("__k")
        pool = best.join(near, [key, "video_id"]).join(outside, key, "left")
        filled = cut_lineage(_fill_pools(open_slots, pool, quotas, key))
        done = filled.where(F.col("creative_index") > 0)
        result = done if result is None else result.unionByName(done)
        undecided = filled.where(F.col("creative_index") < 0).select(key)
        if undecided.isEmpty():
            return result
        open_slots = cut_lineage(open_slots.join(undecided, key, "left_semi"))
        most_sources *= 16


def _fill_pools(slots: DataFrame, pool: DataFrame, quotas: Quotas, key: str) -> DataFrame:
    """One row per pick; a pool that needs more sources gives a single row with creative -1."""
    kinds = {f.name: f.dataType.simpleString() for f in [*slots.schema, *pool.schema]}

    def fill(gaps: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        columns = [key, "creative_index", "slot_index", "candidate_id", "video_id"]
        if gaps.empty or group.empty:
            return pd.DataFrame(columns=columns)
        filler, numbers, rows = _Filler(gaps, group, quotas), gaps["slot_index"].sort_values().to_numpy(), []
        try:
            for creative in range(1, quotas.creatives + 1):
                for number, p in zip(numbers, filler.creative()):
                    rows.append((gaps[key].iloc[0], creative, number, filler.ids[p], filler.names[filler.video[p]]))
        except _NeedsMoreSources:
            rows = [(gaps[key].iloc[0], -1, None, None, None)]
        return pd.DataFrame(rows, columns=columns)

    schema = f"{key} {kinds[key]}, creative_index int, slot_index {kinds['slot_index']}, candidate_id {kinds['candidate_id']}, video_id {kinds['video_id']}"
    return slots.groupBy(key).cogroup(pool.groupBy(key)).applyInPandas(fill, schema)
