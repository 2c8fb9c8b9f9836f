"""Incremental registry, ledger state and run monitor as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediaquery.operators.ledger import SEEN, register_candidates
from mediaquery.session import find_paths, forget_path, path_exists

#: Folders of a bucketed table; a micro-batch rewrites those that its keys fall into.
BUCKETS = 64
#: What names a ledger entry, what closes it (of two decisions with one number the first counts), and what a fold keeps of either.
ENTRY, CLOSES, ENDS = ("candidate_id", "run_id", "creative_id"), ("committed", "released"), ("first", "last")
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, root: str, empty: DataFrame) -> DataFrame:
    """The rows of a bucketed table in the columns of ``empty``, with ``applied_batch`` and ``bucket``; none before the first batch."""
    if path_exists(spark, f"{root}/table"):
        return spark.read.schema(empty.select("*", F.lit(0).cast("long").alias("applied_batch"), F.lit(0).alias("bucket")).schema).parquet(f"{root}/table")
    return empty.limit(0).withColumns({"applied_batch": F.lit(0).cast("long"), "bucket": F.lit(0)})


def merge_buckets(batch: DataFrame, batch_id: int, root: str, empty: DataFrame, merge: Merge, key: str, buckets: int = BUCKETS) -> None:
    """Merge a micro-batch into a Parquet table that is partitioned by the hash of its key.

    Only the buckets of the batch's keys are read and replaced (dynamic partition overwrite). Merged buckets are
    written beside the table first, so a job that is lost while folders are replaced is repeated from there, and a
    batch that arrives again, complete or not, changes nothing. Writers of one table must not overlap.
    """
    spark, pending = batch.sparkSession, f"{root}/pending/{batch_id}"
    if not path_exists(spark, f"{pending}/_SUCCESS"):
        placed = batch.withColumn("bucket", _bucket(key, buckets))
        touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        current = read_buckets(spark, root, empty).where(F.col("bucket").isin(touched))
        done = [r["bucket"] for r in current.where(F.col("applied_batch") >= batch_id).select("bucket").distinct().collect()]
        if set(done) == set(touched):
            return
        merged = merge(current.where(~F.col("bucket").isin(done)).drop("bucket", "applied_batch"), placed.where(~F.col("bucket").isin(done)).drop("bucket"))
        out = merged.withColumns({"applied_batch": F.lit(batch_id).cast("long"), "bucket": _bucket(key, buckets)})
        out.repartition("bucket").write.mode("overwrite").parquet(pending)
    spark.read.parquet(pending).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/table")
    forget_path(spark, pending)


def stream_register(batches: DataFrame, root: str, empty: DataFrame, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Upserts every arriving micro-batch into the bucketed registry below ``root``; a replayed batch changes nothing.

    Rows are merged by ``seq``, not by arrival: the table keeps the first and last number per candidate, so files
    that arrive in any order give the same table.
    """
    columns = empty.withColumns({name: F.lit(None).cast(batches.schema["seq"].dataType) for name in SEEN})

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_buckets(batch, batch_id, root, columns, register_candidates, "candidate_id", buckets)

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _folds(events: DataFrame) -> DataFrame:
    """Every event as the fold of itself alone; ``_merged`` folds are again folds."""
    seq = {action: F.when(F.col("action") == action, F.col("seq")) for action in ("reserved", *CLOSES)}
    return events.where(F.col("action").isin(*seq)).select(*ENTRY, seq["reserved"].alias("reserved"), *(seq[a].alias(f"{a}_{end}") for a in CLOSES for end in ENDS))


def _merged(folds: DataFrame) -> DataFrame:
    """One row per entry: its first reservation, the first and last of each decision, and whether decisions may lie between them.

    Numbers only, so the aggregate is hashed and spills; folding an event twice changes nothing.
    """
    ends = [F.min(f"{a}_first").alias(f"{a}_first") for a in CLOSES] + [F.max(f"{a}_last").alias(f"{a}_last") for a in CLOSES]
    several = reduce(or_, (F.coalesce(F.col(f"{a}_first") < F.col(f"{a}_last"), F.lit(False)) for a in CLOSES))
    return folds.groupBy(*ENTRY).agg(F.min("reserved").alias("reserved"), *ends).withColumn("several", several)


def _closes(events: DataFrame) -> DataFrame:
    return events.where(F.col("action").isin(*CLOSES) & F.col("seq").isNotNull()).select(*ENTRY, "action", "seq")


def _same_entry(folds: DataFrame) -> tuple[DataFrame, Column]:
    """The folds with other names for the keys, and the condition that joins them to rows of their entries; null keys are keys."""
    return folds.withColumnsRenamed({k: f"__{k}" for k in ENTRY}), reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in ENTRY))


def _states(folds: DataFrame, closes: DataFrame) -> DataFrame:
    """State of every reserved entry. ``closes`` has at least those decisions that lie between an entry's first and last of their kind."""
    reserved, after = folds.where(F.col("reserved").isNotNull()), lambda c: F.when(F.col(c) > F.col("reserved"), F.col(c))
    one = reserved.where(~F.col("several")).select(*ENTRY, *(after(f"{a}_first").alias(a) for a in CLOSES))
    many, same = _same_entry(reserved.where("several"))
    between = many.join(closes, same, "left").groupBy(*many.columns).agg(*(F.min(F.when(F.col("action") == a, after("seq"))).alias(a) for a in CLOSES))
    many = between.select(*(F.col(f"__{k}").alias(k) for k in ENTRY), *(F.least(a, *(after(f"{a}_{end}") for end in ENDS)).alias(a) for a in CLOSES))
    committed, released = map(F.col, CLOSES)
    state = F.when(committed.isNotNull() & (released.isNull() | (committed <= released)), "committed").when(released.isNotNull(), "released").otherwise("reserved")
    return one.unionByName(many).select(*ENTRY, state.alias("state"))


def _number(path: str) -> int:
    return int(path.rsplit("=", 1)[1])


def _newest_folds(spark: SparkSession, root: str) -> tuple[int, dict[int, str], list[str]]:
    """The last batch that is merged in full, every bucket's newest folder up to it, and the folders that these replace."""
    last = max((_number(p.removesuffix("/_SUCCESS")) for p in find_paths(spark, f"{root}/done/batch=*/_SUCCESS")), default=-1)
    found = sorted((_number(p.rsplit("/", 1)[0]), _number(p), p) for p in find_paths(spark, f"{root}/folds/batch=*/bucket=*"))
    newest = {bucket: path for batch, bucket, path in found if batch <= last}
    return last, newest, [path for batch, bucket, path in found if batch <= last and newest[bucket] != path]


def _read_folds(spark: SparkSession, paths: list[str], closes: DataFrame) -> DataFrame:
    """Folds in the given folders; their types follow from those of the decisions."""
    none = _merged(_folds(closes.limit(0)))
    return spark.read.schema(none.schema).parquet(*paths) if paths else none


def _merge_usage(batch: DataFrame, batch_id: int, root: str, buckets: int) -> None:
    """Merge a micro-batch into the folds below ``root``, which lie in folders by batch and hash of the entry.

    The buckets of the batch's entries are read and written anew beside the old ones, and decisions that come to lie
    between an entry's others beside those of earlier batches; a mark in ``done`` ends the batch. So a lost job is
    repeated from the old folders, a batch that arrives again changes nothing, and no row is copied. What the marked
    batch replaces is removed. Batches arrive by number, and writers must not overlap.
    """
    spark, closes = batch.sparkSession, _closes(batch)
    last, newest, _ = _newest_folds(spark, root)
    if batch_id > last:
        # the hash of Spark's own shuffle, so a task that folds a partition writes one bucket, if there are as many of both
        bucket = F.pmod(F.hash(*ENTRY), F.lit(buckets)).alias("bucket")
        touched = [r["bucket"] for r in batch.select(bucket).distinct().collect()] if newest else []  # at most ``buckets`` numbers
        old = _read_folds(spark, [newest[b] for b in touched if b in newest], closes)
        merged = _merged(_folds(batch).unionByName(old.drop("several")))
        if int(spark.conf.get("spark.sql.shuffle.partitions")) != buckets:
            merged = merged.repartition(buckets, *ENTRY)
        merged.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/folds/batch={batch_id}")
        written = _read_folds(spark, find_paths(spark, f"{root}/folds/batch={batch_id}/bucket=*"), closes)
        several, same = _same_entry(written.where("several").drop("reserved", "several"))
        if not several.isEmpty():
            ends = old.select(*ENTRY, F.inline(F.array(*(F.struct(F.lit(a).alias("action"), F.col(f"{a}_{end}").alias("seq")) for a in CLOSES for end in ENDS))))
            inside = reduce(or_, ((F.col("action") == a) & (F.col("seq") > F.col(f"{a}_first")) & (F.col("seq") < F.col(f"{a}_last")) for a in CLOSES))
            between = closes.unionByName(ends).join(several, same).where(inside).select(*closes.columns).distinct()
            between.write.mode("overwrite").parquet(f"{root}/between/batch={batch_id}")
        closes.limit(0).write.mode("overwrite").parquet(f"{root}/done/batch={batch_id}")
    last, newest, replaced = _newest_folds(spark, root)
    live = {path.rsplit("/", 1)[0] for path in newest.values()}
    gone = [p for p in find_paths(spark, f"{root}/folds/batch=*") if _number(p) <= last and p not in live]
    for path in [*gone, *(p for p in replaced if p.rsplit("/", 1)[0] in live), *(p for p in find_paths(spark, f"{root}/done/batch=*") if _number(p) < last)]:
        forget_path(spark, path)


def read_usage_state(spark: SparkSession, root: str) -> DataFrame:
    """State of every entry after the last micro-batch that ``stream_usage_state`` merged below ``root``."""
    last, newest, _ = _newest_folds(spark, root)
    none = spark.read.parquet(f"{root}/done/batch={last}")
    between = [p for p in find_paths(spark, f"{root}/between/batch=*") if _number(p) <= last]
    closes = spark.read.schema(none.schema).parquet(*between) if between else none
    return _states(_read_folds(spark, [*newest.values()], none), closes)


def stream_usage_state(events: DataFrame, root: str | None = None, batch_id: int = 0, buckets: int = BUCKETS) -> DataFrame | None:
    """Current state of every ledger entry: reserved once, then closed by the first later decision.

    Without ``root``, of the given events alone. With it, the events are a micro-batch (``foreachBatch``) that is merged
    into the state kept there, which ``read_usage_state`` returns; a state keeps its number of buckets.
    Kept as Parquet and folded per (candidate, run, creative): entries take no memory between batches, a hot
    candidate spreads over all tasks, nothing leaves the JVM, and replayed events fall into the same fold.
    Decisions before the reservation and second reservations have no effect.
    """
    if root is None:
        return _states(_merged(_folds(events)), _closes(events))
    return _merge_usage(events, batch_id, root, buckets)


def usage_counts(entries: DataFrame) -> DataFrame:
    """Selected and exported counts per candidate from the latest row of every entry."""
    return entries.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("selected_count"), F.count_if(F.col("state") == "committed").alias("exported_count"))


def stream_run_monitor(events: DataFrame, window: str = "15 seconds", lateness: str = "1 minute") -> DataFrame:
    """Counts per run and event-time window with the alert flags of a run report."""
    counted = events.withWatermark("at", lateness).groupBy(F.window("at", window), "run_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "committed").alias("committed"))
    return counted.select("run_id", F.col("window.start").alias("window_start"), "events", "failed", "committed", (F.col("failed") > 0).alias("alert"))
