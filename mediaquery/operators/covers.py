"""Cover frames of whole runs: a creative avoids frames like those that earlier creatives of its run took."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaquery.operators.dedupe import near_hashes
from mediaquery.operators.intervals import sample_timestamps
from mediaquery.operators.ranking import cover_option_fallback, rank_cover_candidates
from mediaquery.session import cut_lineage, forget, forget_path, write_out

_CREATIVE = ("run_id", "creative_id")
#: Distinct hashes up to which a run's hashes are compared by many short words; beyond, fewer candidates outweigh more copies.
FEW_HASHES = 3_000
#: Options of a run that one task may walk through.
WHOLE_RUN = 1 << 16
#: Options that a task walks through at once, and pairs of hashes that it compares at once.
BLOCK, PAIRS = 1 << 17, 1 << 22


def choose_covers(options: DataFrame, distance: int = 10) -> DataFrame:
    """One option per creative, as if the creatives of a run chose one after the other in the order of their ids.

    ``options`` has run_id, creative_id, ordinal, hash and acceptable. An option is a duplicate where an earlier creative
    of the run took a hash within ``distance`` bits. A null hash is like no other, and without a run or creative id there
    is no earlier creative. Runs of up to ``WHOLE_RUN`` options are walked through in tasks, many at once; larger ones go
    through rounds. Options are written once, by column and compressed, and removed at the end.
    """
    spark = options.sparkSession
    path, rows = write_out(options, "cover-options")
    keyed, alone = rows.where("run_id is not null and creative_id is not null"), rows.where("run_id is null or creative_id is null")
    large = cut_lineage(keyed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE_RUN).select("run_id"))
    parts = [cover_option_fallback(alone.withColumn("duplicate", F.lit(False)), _CREATIVE)]
    if large.isEmpty():
        parts.append(_choose_in_tasks(keyed, distance))
    else:
        parts += [_choose_in_tasks(keyed.join(large, "run_id", "left_anti"), distance), _choose_in_rounds(keyed.join(large, "run_id", "left_semi"), distance)]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    _, chosen = write_out(chosen, "cover-choices")
    forget_path(spark, path)
    return chosen


def _choose_in_tasks(options: DataFrame, distance: int) -> DataFrame:
    """Choices of whole runs: one shuffle by run, then every task takes the first creatives of many runs, the second ones, and so on."""
    run = W.partitionBy("run_id")
    placed = options.withColumn("__place", F.row_number().over(run.orderBy("creative_id", "ordinal")))
    numbered = placed.withColumn("__number", F.dense_rank().over(run.orderBy("creative_id")))
    others = [c for c in options.columns if c not in _CREATIVE]
    schema = options.limit(0).select(*_CREATIVE, *others, F.lit(False).alias("duplicate"), F.lit(0).alias("tier")).schema
    names = schema.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                table = pa.Table.from_batches(held)
                end = int(np.flatnonzero(table["__place"].to_numpy() == 1)[-1])  # the last run may go on in the next batch
                yield from _walk_runs(table.slice(0, end), distance, names)
                held = table.slice(end).to_batches()
                size = table.num_rows - end
        if size:
            yield from _walk_runs(pa.Table.from_batches(held), distance, names)

    return numbered.mapInArrow(walk, schema)


def _walk_runs(table: pa.Table, distance: int, columns: Sequence[str]) -> list[pa.RecordBatch]:
    """The choices of a block of whole runs, sorted by run, creative and ordinal."""
    if not table.num_rows:
        return []
    place, number = table["__place"].to_numpy(), table["__number"].to_numpy() - 1
    hashes = table["hash"].fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    known, fine = table["hash"].is_valid().to_numpy(), table["acceptable"].fill_null(False).to_numpy()
    run = np.cumsum(place == 1) - 1
    first = np.flatnonzero((place == 1) | (np.diff(number, prepend=-1) != 0))  # the rows where a creative begins
    length = np.diff(np.append(first, len(place)))
    at = number[first]  # a creative's place in its run
    base = np.flatnonzero(at == 0)[run[first]]  # and the block's number of the run's first creative
    taken, holds, chosen, tiers = np.zeros(len(first), np.uint64), np.zeros(len(first), bool), np.zeros(len(first), np.int64), np.zeros(len(first), np.int32)
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(at.max() + 2))
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        some = order[lo:hi]
        starts = np.append(0, np.cumsum(length[some]))
        rows = np.arange(starts[-1]) + np.repeat(first[some] - starts[:-1], length[some])
        before, twice = np.repeat(base[some], length[some]), np.zeros(len(rows), bool)
        step = max(1, PAIRS // max(1, k))
        for i in range(0, len(rows) if k else 0, step):
            earlier = before[i:i + step, None] + np.arange(k)
            near = np.bitwise_count(taken[earlier] ^ hashes[rows[i:i + step], None]) <= distance
            twice[i:i + step] = (near & holds[earlier]).any(axis=1) & known[rows[i:i + step]]
        tier = np.where(twice, 2, np.where(fine[rows], 0, 1))
        best = np.minimum.reduceat(tier * len(rows) + np.arange(len(rows)), starts[:-1]) % len(rows)
        chosen[some], tiers[some] = rows[best], tier[best]
        taken[some], holds[some] = hashes[rows[best]], known[rows[best]]
    out = table.take(pa.array(chosen)).append_column("duplicate", pa.array(tiers == 2)).append_column("tier", pa.array(tiers))
    return out.select(list(columns)).combine_chunks().to_batches()


def _choose_in_rounds(options: DataFrame, distance: int) -> DataFrame:
    """The same choices by rounds for runs of any size.

    Every round lets all creatives choose at once against the earliest takers of the round before, until no choice
    changes. Creatives with only final ones before them are final after a round, so a run ends after as many rounds as
    its longest chain of changed choices; a creative whose hashes no earlier one offers is final at once and leaves the
    rounds.
    """
    rows = cut_lineage(options)
    hashes = rows.where("hash is not null").select("run_id", "hash").distinct()
    hashes = cut_lineage(hashes)
    near = cut_lineage(_near_in_run(hashes, distance))

    def reached(offers: DataFrame, name: str) -> DataFrame:
        """Per hash the earliest creative among those of ``offers`` with a hash near it."""
        first = offers.where("hash is not null").groupBy("run_id", F.col("hash").alias("prior_hash")).agg(F.min("creative_id").alias(name))
        return near.join(first, ["run_id", "prior_hash"]).groupBy("run_id", "hash").agg(F.min(name).alias(name))

    def pick(some: DataFrame, taken: DataFrame) -> DataFrame:
        known = some.join(taken, ["run_id", "hash"], "left").withColumn("duplicate", F.coalesce(F.col("taker") < F.col("creative_id"), F.lit(False)))
        return cover_option_fallback(known.drop("taker").select(*rows.columns, "duplicate"), _CREATIVE)

    offered = rows.join(reached(rows, "offerer"), ["run_id", "hash"], "left")
    late = cut_lineage(offered.where("offerer < creative_id").select(*_CREATIVE).distinct())
    nobody = near.limit(0).select("run_id", "hash", F.lit(None).cast(rows.schema["creative_id"].dataType).alias("taker"))
    free = cut_lineage(pick(rows.join(late, [*_CREATIVE], "left_anti"), nobody))
    contested = cut_lineage(rows.join(late, [*_CREATIVE], "left_semi"))
    chosen = None
    while True:
        before, made = chosen, free if chosen is None else free.unionByName(chosen)
        chosen = cut_lineage(pick(contested, reached(made, "taker")))
        if before is not None:
            was = before.select(*_CREATIVE, F.col("ordinal").alias("was"))
            same = chosen.join(was, [*_CREATIVE]).where("ordinal <> was").isEmpty()
            forget(before)
            if same:
                break
    for table in (near, hashes, late, contested, rows):
        forget(table)
    return free.unionByName(chosen)


def _near_in_run(hashes: DataFrame, distance: int) -> DataFrame:
    """(run_id, hash, prior_hash): the pairs of a run's hashes within ``distance``, each hash with itself included."""
    large = hashes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW_HASHES).select("run_id")
    few, many = hashes.join(large, "run_id", "left_anti"), hashes.join(large, "run_id", "left_semi")
    both = near_hashes(few, few, distance, ["run_id"], distance + 1).unionByName(near_hashes(many, many, distance, ["run_id"]))
    return both.select("run_id", "hash", "prior_hash").distinct()


def cover_plan(selected: DataFrame, frames: DataFrame, preferred: Sequence[str], k: int = 5, samples: int = 3, distance: int = 10) -> DataFrame:
    """The cover of every creative: candidate, time, hash, tier (0 acceptable and new, 1 new, 2 any) and mode.

    ``selected`` has run_id, creative_id and what ``rank_cover_candidates`` needs; ``frames`` has candidate_id, sample
    (from 0), hash and acceptable of the frames that could be decoded. A creative without any frame shows its best
    candidate at the peak, else at the start, and keeps no hash from others.
    """
    best = rank_cover_candidates(selected, preferred, k).select(*_CREATIVE, "candidate_id", "rank", "start_ms", "end_ms", "peak_ms")
    _, ranked = write_out(best, "cover-candidates")
    shown = frames.select("candidate_id", "sample", "hash", "acceptable")
    timed = sample_timestamps(ranked, samples).select(*_CREATIVE, "candidate_id", "rank", "sample").join(shown, ["candidate_id", "sample"])
    chosen = choose_covers(timed.select(*_CREATIVE, ((F.col("rank") - 1) * samples + F.col("sample")).alias("ordinal"), "hash", "acceptable"), distance)
    # the candidate and time of a choice follow from its ordinal, so options do without them
    picked = chosen.withColumns({"rank": (F.floor(F.col("ordinal") / samples) + 1).cast("int"), "__sample": F.col("ordinal") % samples})
    times = sample_timestamps(ranked.join(picked, [*_CREATIVE, "rank"]), samples).where(F.col("sample") == F.col("__sample"))
    chosen = times.select(*_CREATIVE, F.col("candidate_id").alias("shown"), "ordinal", "at_ms", "hash", "tier")
    heads = ranked.where("rank = 1").select(*_CREATIVE, "candidate_id", F.coalesce(F.nullif("peak_ms", F.lit(0)), "start_ms").cast("double").alias("fallback_ms"))
    mode = F.when(F.col("shown").isNull(), "no_review_frames_fallback").otherwise("quality_filtered_fallback")
    return heads.join(chosen, [*_CREATIVE], "left").select(
        *_CREATIVE, F.coalesce("shown", "candidate_id").alias("candidate_id"), "ordinal", F.coalesce("at_ms", "fallback_ms").alias("at_ms"), "hash", "tier", mode.alias("mode"))
