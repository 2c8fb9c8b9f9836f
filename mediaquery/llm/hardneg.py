"""Hard-negative mining by integer products of anchor and candidate tiles.

Components become integers, floor(scale * x), so every score is exact. Anchors are dealt into blocks and candidates
into slices; each block meets each slice once, in one task that holds the block and streams the slice in tiles. A
tile of scores is a Strassen product on int64: operands split in halves, odd sides padded with zeros, seven products
instead of eight, sums and differences exact. Two passes fill heaps of bounded length for every anchor and slice:
the best rows of the anchor's label, then, for the window of every positive, the best rows of other labels. Heaps of
slices merge by keeping the best again, so nothing but heap entries leaves a task.

Higher scores come first, ties by smaller id. Rows with a null id, a null label, a null vector, or null or non-finite
components take no part. Rows of one id are one item: they are never each other's positive or negative; repeated rows
each take a place, and a repeated anchor gives its rows repeatedly. Vectors of unequal length are padded with zeros.
Scores that ``high`` times could leave 64 bits raise an error. Empty tables give no rows. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaquery.llm.common import cut_lineage, matrix

#: Components of all anchors of a block, about; rows of a slice at most and at least, about; rows of a tile.
BLOCK_VALUES, SLICE, LEAST_SLICE, TILE = 1 << 22, 1 << 20, 4_096, 1_024
#: Anchors in a product; sides up to LEAF are multiplied directly.
ANCHORS, LEAF = 512, 16
#: An empty place of a heap; can be negated.
EMPTY = -(1 << 62)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices; exact wherever the product fits, as sums wrap and unwrap modulo 2**64."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
        return strassen(a, b, leaf)[:n, :m]
    top, left, cols = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:top, :left], a[:top, left:], a[top:, :left], a[top:, left:]
    b11, b12, b21, b22 = b[:left, :cols], b[:left, cols:], b[left:, :cols], b[left:, cols:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    lower = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    down = strassen(a22, b21 - b11, leaf)
    upper = strassen(a11 + a12, b22, leaf)
    out = np.empty((n, m), np.int64)
    out[:top, :cols] = both + down - upper + strassen(a12 - a22, b21 + b22, leaf)
    out[:top, cols:] = right + upper
    out[top:, :cols] = lower + down
    out[top:, cols:] = both - lower + right + strassen(a21 - a11, b11 + b12, leaf)
    return out


class Heaps:
    """For each of n rows its k best (score, id), best first; heaps of the same rows merge by ``push``."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), EMPTY, np.int64)
        self.ident = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def push(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(row):
            return
        k, touched = self.score.shape[1], np.unique(row)
        rows = np.concatenate([np.repeat(touched, k), row])
        scores = np.concatenate([self.score[touched].ravel(), score])
        idents = np.concatenate([self.ident[touched].ravel(), ident])
        order = np.lexsort((idents, -scores, rows))
        rows, scores, idents = rows[order], scores[order], idents[order]
        first = np.searchsorted(rows, touched)
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        best = place < k
        self.score[rows[best], place[best]] = scores[best]
        self.ident[rows[best], place[best]] = idents[best]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.score != EMPTY)
        return row, self.score[row, place], self.ident[row, place]


def quantized(df: DataFrame, scale: int, id_col: str, vec: str, label: Column) -> DataFrame:
    """(id, label, q): the rows that take part, components floor(scale * x)."""
    v = F.col(vec).cast("array<double>")
    able = df.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), v.alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return able.where(~bad).select("id", "label", F.transform("v", lambda x: F.floor(x * float(scale))).alias("q"))


def _grid(anchors: DataFrame, rows: DataFrame, extra: list[str]) -> DataFrame:
    """Every anchor once for every slice and every candidate once for every block, dealt by (block, slice).

    Blocks are cut by the components they hold, slices by rows; with few rows there are as many slices as cores
    can use. Copies grow with blocks and slices, so both are as large as a task's memory allows.
    """
    spark = rows.sparkSession
    held = anchors.agg(F.sum(F.size("q")).alias("values"), F.count(F.lit(1)).alias("n")).first()
    n = rows.count()
    blocks = max(1, -(-int(held["values"] or 0) // BLOCK_VALUES), -(-held["n"] // (BLOCK_VALUES // 16)))
    slices = max(1, -(-n // SLICE), min(-(-n // LEAST_SLICE), -(-4 * spark.sparkContext.defaultParallelism // blocks)))
    fill = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    own = anchors.select(F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("side"), "id", "label", "q", *extra)
    met = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", "label"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("side"), "id", "label", "q", *fill)
    by = ["block", "slice", "side", "id"]
    return own.unionByName(met).repartition(blocks * slices, "block", "slice").sortWithinPartitions(*by)


class _Block:
    """A block's anchors, then its slice tile by tile."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.ready = False

    def codes(self, labels: pa.Array) -> np.ndarray:
        return np.array([self.names.setdefault(x, len(self.names)) for x in labels.to_pylist()], dtype=np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append((batch.column(3).to_numpy(), self.codes(batch.column(4)), batch.column(5), batch))

    def close(self) -> None:
        self.ready = True
        self.ident = np.concatenate([p[0] for p in self.parts])
        self.label = np.concatenate([p[1] for p in self.parts])
        width = max(int(p[2].value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for p in self.parts)
        self.q = np.concatenate([matrix(p[2], width) for p in self.parts])
        self.most = int(np.abs(self.q.astype(float)).max(initial=0))

    def tiles(self, batch: pa.RecordBatch, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, labels, components) of tiles of a batch of candidates; sizes are checked for exact scores."""
        for at in range(0, len(batch), TILE):
            part = batch.slice(at, TILE)
            q = matrix(part.column(5), self.q.shape[1])
            if high * q.shape[1] * max(self.most, 1) * float(np.abs(q.astype(float)).max(initial=0)) >= 2.0**62:
                raise ValueError("components are too large for exact 64-bit scores; use a smaller scale")
            yield part.column(3).to_numpy(), self.codes(part.column(4)), q


def _stream(batches: Iterator[pa.RecordBatch], begin, visit, end) -> Iterator[pa.RecordBatch]:
    """Walk sorted (block, slice, side) runs: anchors first, then candidates; a block without candidates gives nothing."""
    block, key, heaps = None, None, None
    for batch in batches:
        head = np.stack([batch.column(k).to_numpy() for k in range(3)])
        starts = np.flatnonzero(np.r_[True, (head[:, 1:] != head[:, :-1]).any(axis=0)]) if len(batch) else []
        for at, to in zip(starts, [*starts[1:], len(batch)], strict=True):
            part, now = batch.slice(at, to - at), tuple(head[:2, at])
            if now != key:
                if heaps is not None:
                    yield from end(block, heaps)
                block, key, heaps = _Block(), now, None
            if head[2, at] == 0:
                block.add(part)
            elif block.parts:
                if not block.ready:
                    block.close()
                    heaps = begin(block)
                visit(block, heaps, part)
    if heaps is not None:
        yield from end(block, heaps)


def positives(anchors: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(a, place, positive_id, positive_score): the k best other rows of each anchor's label, places from 1."""
    out = pa.schema([("a", pa.int64()), ("ident", pa.int64()), ("score", pa.int64())])

    def begin(block):
        block.key = np.concatenate([p[3].column(6).to_numpy() for p in block.parts])
        return Heaps(len(block.ident), k)

    def visit(block, heaps, batch):
        for ident, label, q in block.tiles(batch, 1):
            for name in np.unique(label):
                mine, theirs = np.flatnonzero(block.label == name), np.flatnonzero(label == name)
                other = np.ascontiguousarray(q[theirs].T)
                for at in range(0, len(mine), ANCHORS):
                    own = mine[at : at + ANCHORS]
                    score = strassen(block.q[own], other)
                    # candidates come by id, so later ones lose ties with what a heap holds
                    i, j = np.nonzero((score > heaps.score[own, -1][:, None]) & (block.ident[own][:, None] != ident[theirs][None, :]))
                    heaps.push(own[i], score[i, j], ident[theirs[j]])

    def end(block, heaps):
        row, score, ident = heaps.entries()
        yield pa.RecordBatch.from_arrays([pa.array(block.key[row]), pa.array(ident), pa.array(score)], schema=out)

    found = _grid(anchors, rows, ["a"]).mapInArrow(lambda batches: _stream(batches, begin, visit, end), "a long, ident long, score long")
    best = Window.partitionBy("a").orderBy(F.desc("score"), "ident")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("a", "place", F.col("ident").alias("positive_id"), F.col("score").alias("positive_score"))


def negatives(anchors: DataFrame, rows: DataFrame, k: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(a, place, negative_id, negative_score, rank): for each score of ``goals`` the k best rows of other labels with low * goal <= 100 * score <= high * goal."""
    out = pa.schema([("a", pa.int64()), ("place", pa.int32()), ("ident", pa.int64()), ("score", pa.int64())])
    bound = max(100, abs(low), abs(high))

    def begin(block):
        block.key = np.concatenate([p[3].column(6).to_numpy() for p in block.parts])
        goals = [p[3].column(7) for p in block.parts]
        width = max(int(g.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for g in goals)
        block.has = np.concatenate([g.value_lengths().to_numpy(zero_copy_only=False) for g in goals])
        block.goals = np.concatenate([matrix(g, width) for g in goals])
        return Heaps(block.goals.size, k)

    def visit(block, heaps, batch):
        width = block.goals.shape[1]
        for ident, label, q in block.tiles(batch, bound):
            other = np.ascontiguousarray(q.T)
            for at in range(0, len(block.ident), ANCHORS):
                own = np.arange(at, min(at + ANCHORS, len(block.ident)))
                score = strassen(block.q[own], other)
                apart = (block.label[own][:, None] != label[None, :]) & (block.ident[own][:, None] != ident[None, :])
                for w in range(width):
                    goal = block.goals[own, w]
                    inside = apart & (100 * score >= (low * goal)[:, None]) & (100 * score <= (high * goal)[:, None])
                    i, j = np.nonzero(inside & (score > heaps.score[own * width + w, -1][:, None]) & (block.has[own] > w)[:, None])
                    heaps.push(own[i] * width + w, score[i, j], ident[j])

    def end(block, heaps):
        row, score, ident = heaps.entries()
        width = block.goals.shape[1]
        if width:
            yield pa.RecordBatch.from_arrays([pa.array(block.key[row // width]), pa.array((row % width + 1).astype(np.int32)), pa.array(ident), pa.array(score)], schema=out)

    found = _grid(anchors, rows, ["a", "goals"]).mapInArrow(lambda batches: _stream(batches, begin, visit, end), "a long, place int, ident long, score long")
    best = Window.partitionBy("a", "place").orderBy(F.desc("score"), "ident")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("a", "place", F.col("ident").alias("negative_id"), F.col("score").alias("negative_score"), "rank")


def mine(df: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the columns id and label of ``quantized``. Anchors are numbered and written
    once, so that a lost executor never numbers them anew.
    """
    rows = quantized(df, scale, id_col, vec, F.col("label") if label is None else label)
    anchors = cut_lineage(rows.where(is_anchor).withColumn("a", F.monotonically_increasing_id()))
    best = cut_lineage(positives(anchors, rows, k_positive))
    goals = best.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("x")).select("a", F.col("x.positive_score").alias("goals"))  # at most k_positive an anchor
    asked = cut_lineage(anchors.join(goals, "a"))
    found = negatives(asked, rows, k_negative, low, high)
    pairs = best.join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    return pairs.join(found, ["a", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
