"""Ordered windows that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. That is the best plan while no key has more rows
than a task should sort, which a count per key tells; keys above are scanned in ranges: their rows are dealt along the
order into partitions whose bounds Spark samples from the data, ranks, running sums and neighbours are computed
inside (key, partition) and corrected by one small row per key and partition. A caller that knows a good cut of its
order may name it as ``bin_by``, which must not decrease along ``order``; all keys are then cut by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaquery.session import cut_lineage

BIN = "__bin"
#: Rows of a key that one task may sort.
HEAVY = 1 << 18


def heavy_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with more than ``HEAVY`` rows, at most one in HEAVY rows; None if there are none."""
    found = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HEAVY).select(*keys))
    return None if found.isEmpty() else found


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bin_by: Column | None = None,
    *,
    heavy: DataFrame | None | str = "find",
    rank: str | None = None,
    size: str | None = None,
    running_sum: Mapping[str, Column] | None = None,
    prior_max: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add rank / group size / inclusive running sums / max of earlier rows / next and previous values.

    ``heavy`` names the keys that are split (see ``heavy_keys``), found by a count if not given.
    """
    running_sum, prior_max = dict(running_sum or {}), dict(prior_max or {})
    lead, lag = dict(lead or {}), dict(lag or {})
    added = {"rank": rank, "size": size, "running_sum": running_sum, "prior_max": prior_max, "lead": lead, "lag": lag}
    if bin_by is None:
        heavy = heavy_keys(df, keys) if isinstance(heavy, str) else heavy
        if heavy is None:
            return _whole_keys(df, keys, order, **added)
        light = _whole_keys(df.join(heavy, list(keys), "left_anti"), keys, order, **added)
        return light.unionByName(ordered_scan(_ranged(df.join(heavy, list(keys), "left_semi"), keys, order), keys, order, F.col(BIN), **added))
    columns = [c for c in df.columns if c != BIN]
    binned = df.withColumn(BIN, bin_by)
    inside = W.partitionBy(*keys, BIN).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)

    local = [F.row_number().over(inside).alias("__rn"), F.lead(F.lit(1)).over(inside).isNull().alias("__last")]
    local += [F.sum(c).over(upto).alias(f"__sum_{n}") for n, c in running_sum.items()]
    local += [c.alias(f"__sumv_{n}") for n, c in running_sum.items()]
    local += [F.max(c).over(before).alias(f"__max_{n}") for n, c in prior_max.items()]
    local += [c.alias(f"__maxv_{n}") for n, c in prior_max.items()]
    local += [F.lead(F.struct(c.alias("v"))).over(inside).alias(f"__lead_{n}") for n, c in lead.items()]
    local += [F.struct(c.alias("v")).alias(f"__leadv_{n}") for n, c in lead.items()]
    local += [F.lag(F.struct(c.alias("v"))).over(inside).alias(f"__lag_{n}") for n, c in lag.items()]
    local += [F.struct(c.alias("v")).alias(f"__lagv_{n}") for n, c in lag.items()]
    rows = binned.select("*", *local)

    per_bin = [F.count(F.lit(1)).alias("__n")]
    per_bin += [F.sum(f"__sumv_{n}").alias(f"__bs_{n}") for n in running_sum]
    per_bin += [F.max(f"__maxv_{n}").alias(f"__bm_{n}") for n in prior_max]
    per_bin += [F.max(F.when(F.col("__rn") == 1, F.col(f"__leadv_{n}"))).alias(f"__first_{n}") for n in lead]
    per_bin += [F.max(F.when(F.col("__last"), F.col(f"__lagv_{n}"))).alias(f"__end_{n}") for n in lag]
    # Reading every column here keeps both uses of ``rows`` on one shuffle: were the columns of this
    # side pruned, the exchanges would differ and everything upstream would run twice.
    per_bin.append(F.max(F.xxhash64(*columns)).alias("__all"))
    bins = rows.groupBy(*keys, BIN).agg(*per_bin).where(F.col("__all").isNotNull())

    across = W.partitionBy(*keys).orderBy(BIN)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__o_rank")]
    if size:
        offsets.append(F.sum("__n").over(W.partitionBy(*keys)).alias("__o_size"))
    offsets += [F.sum(f"__bs_{n}").over(earlier).alias(f"__os_{n}") for n in running_sum]
    offsets += [F.max(f"__bm_{n}").over(earlier).alias(f"__om_{n}") for n in prior_max]
    offsets += [F.lead(f"__first_{n}").over(across).alias(f"__nf_{n}") for n in lead]
    offsets += [F.lag(f"__end_{n}").over(across).alias(f"__pe_{n}") for n in lag]
    bins = bins.select(*keys, BIN, *offsets)

    joined = rows.join(bins, [*keys, BIN])
    out = [F.col(c) for c in columns]
    if rank:
        out.append((F.col("__rn") + F.col("__o_rank")).alias(rank))
    if size:
        out.append(F.col("__o_size").alias(size))
    for n in running_sum:
        out.append((F.col(f"__sum_{n}") + F.coalesce(F.col(f"__os_{n}"), F.lit(0))).alias(n))
    for n in prior_max:
        out.append(F.greatest(F.col(f"__max_{n}"), F.col(f"__om_{n}")).alias(n))
    for n in lead:
        out.append(F.coalesce(F.col(f"__lead_{n}"), F.col(f"__nf_{n}")).getField("v").alias(n))
    for n in lag:
        out.append(F.coalesce(F.col(f"__lag_{n}"), F.col(f"__pe_{n}")).getField("v").alias(n))
    return joined.select(*out)


def _whole_keys(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, rank, size, running_sum, prior_max, lead, lag) -> DataFrame:
    """The same columns by plain windows: one shuffle, a key in one task."""
    own = W.partitionBy(*keys).orderBy(*order)
    upto, before = own.rowsBetween(W.unboundedPreceding, W.currentRow), own.rowsBetween(W.unboundedPreceding, -1)
    out = [F.row_number().over(own).cast("long").alias(rank)] if rank else []
    out += [F.count(F.lit(1)).over(W.partitionBy(*keys)).alias(size)] if size else []
    out += [F.sum(c).over(upto).alias(n) for n, c in running_sum.items()]
    out += [F.max(c).over(before).alias(n) for n, c in prior_max.items()]
    out += [F.lead(c).over(own).alias(n) for n, c in lead.items()]
    out += [F.lag(c).over(own).alias(n) for n, c in lag.items()]
    return df.select("*", *out)


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with the partition of a range shuffle along (keys, order), written so that a rerun can't deal them anew."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut_lineage(dealt.withColumn(BIN, F.spark_partition_id()))


def with_halo(df: DataFrame, idx: str, chunk: int, before: int = 0, after: int = 0) -> DataFrame:
    """Copy each row into its chunk of ``idx`` and into the neighbours whose window reaches it.

    Adds ``__bin`` and ``__own``; windows over (key, __bin) are then exact for rows with ``__own``.
    ``before`` / ``after`` are the rows a window looks back / ahead, both at most ``chunk``.
    """
    home = F.floor(F.col(idx) / chunk).cast("long")
    offset = F.col(idx) - home * chunk
    homes = [home]
    if after:
        homes.append(F.when((offset < after) & (home > 0), home - 1))
    if before:
        homes.append(F.when(offset >= chunk - before, home + 1))
    return (
        df.withColumn("__home", home)
        .withColumn(BIN, F.explode(F.array_compact(F.array(*homes))))
        .withColumn("__own", F.col(BIN) == F.col("__home"))
        .drop("__home")
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], buckets: int = 4096
) -> DataFrame:
    """Exact linear-interpolation percentiles per key without holding a key in one task.

    Equal values are counted first, a histogram finds the buckets that hold the wanted ranks, and
    only those buckets are ordered.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    span = counts.groupBy(*keys).agg(
        F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("__c").alias("__total")
    )
    placed = counts.join(span, keys).withColumn(
        "__b",
        F.when(F.col("__hi") <= F.col("__lo"), F.lit(0)).otherwise(
            F.least(F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets), F.lit(buckets))
        ),
    )
    running = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    histogram = (
        placed.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"))
        .withColumn("__upto", F.sum("__bc").over(running))
        .withColumn("__before", F.col("__upto") - F.col("__bc"))
    )
    ranks = F.array(*[
        F.struct(F.lit(name).alias("q"), ((F.col("__total") - 1) * F.lit(float(q))).alias("pos"))
        for name, q in quantiles.items()
    ])
    wanted = (
        span.select(*keys, F.explode(ranks).alias("__w")).select(*keys, "__w.q", "__w.pos")
        .select(*keys, "q", "pos", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("__rank"))
    )
    targets = histogram.join(wanted, keys).where(
        (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__upto"))
    ).select(*keys, "__b", "__before", "q", "pos", "__rank")
    hit = targets.select(*keys, "__b", "__before").distinct()
    inside = W.partitionBy(*keys, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        placed.join(hit, [*keys, "__b"])
        .withColumn("__last", F.col("__before") + F.sum("__c").over(inside))
        .withColumn("__first", F.col("__last") - F.col("__c"))
        .select(*keys, "__b", F.col(value).alias("__v"), "__first", "__last")
    )
    picked = targets.join(ranked, [*keys, "__b"]).where(
        (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__last"))
    )
    low, high = F.floor("pos"), F.ceil("pos")
    out = []
    for name in quantiles:
        is_q = F.col("q") == name
        lo = F.max(F.when(is_q & (F.col("__rank") == low), F.col("__v")))
        hi = F.max(F.when(is_q & (F.col("__rank") == high), F.col("__v")))
        frac = F.max(F.when(is_q, F.col("pos") - low))
        out.append(F.when(frac == 0, lo).otherwise(lo * (1 - frac) + hi * frac).alias(name))
    return picked.groupBy(*keys).agg(*out)
