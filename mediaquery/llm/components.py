"""Connected components of an edge table: spanning forests inside tasks, then large-star and small-star steps.

Every partition first reduces its edges to a spanning forest, a bounded number at a time, so groups of many links
cost their nodes only. While more than ``LOCAL`` edges are left, alternating star steps shrink the table, each step's
table replacing the one before; the rest, whose size is counted, is solved in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquery.llm.common import cut_lineage
from mediaquery.session import forget

#: Edges that one task may hold: 16 bytes each, some copies of them while it works.
LOCAL = 1 << 19


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every node of the edges but the smallest ones themselves."""
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = places[: len(a)], places[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        for side in (p, q):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            moved = label != np.arange(len(ids))
            return ids[moved], ids[label[moved]]
        label = new


def _forests(batches: Iterator[pa.RecordBatch], limit: int, heads: bool) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
        if heads:
            first = np.unique(v)
            u, v = np.concatenate([u, first]), np.concatenate([v, first])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += len(batch)
        if n >= limit:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _forest(edges: DataFrame, limit: int, heads: bool = False) -> DataFrame:
    """(u, v) with v < u: the same components in fewer edges, partition by partition; ``heads`` adds (v, v)."""
    return edges.mapInArrow(lambda batches: _forests(batches, limit, heads), "u long, v long")


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = down.join(_minima(down), "u")
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(met.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge touches.

    Star steps keep connectivity and never add edges, so the table only shrinks towards stars around the smallest
    nodes; a star's hub is reduced to one minimum before its edges meet it. Self loops drop out.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = cut_lineage(_forest(pairs, LOCAL))
    seen = _digest(now)
    if seen[0] > local:
        now, seen = _replaced(now, now.distinct())
    while seen[0] > local:
        now, after = _replaced(now, _small_star(_large_star(now)))
        if after == seen:
            break
        seen = after
    names = [F.col("u").alias("node"), F.col("v").alias("component")]
    if seen[0] <= local:  # solved in one task, whatever steps were made before
        return _forest(now.coalesce(1), local + 1, heads=True).select(*names)
    solved = now.select(*names)
    return solved.unionByName(solved.select(F.col("component").alias("node"), "component").distinct())


def _replaced(old: DataFrame, new: DataFrame) -> tuple[DataFrame, tuple]:
    """The new table written, the old one's files removed."""
    new = cut_lineage(new)
    forget(old)
    return new, _digest(new)


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free sum of hashes: equal for equal edge sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
