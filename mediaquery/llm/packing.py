"""Packing of tokenised documents into sequences by length patterns.

Pieces collapse to a histogram of lengths, at most ``limit`` numbers, and the plan is made on it: patterns of
up to ``parts`` lengths on a coarse grid that fill a sequence are enumerated, non-negative least squares fits
their repeat counts to the histogram, counts are rounded down, and what remains goes, longest first, into the
fullest sequence that still has room. The plan says for the r-th piece of every length its sequence and offset;
its size depends on the limit alone, never on the number of documents.

Ranks are dealt without gathering a length in one task: each partition counts its pieces per length, the counts
become first ranks, and partitions number their own rows from there.

Null and empty texts are documents of the end id alone. Longer documents than the limit are cut into full
pieces, the first may be shorter. Repeated rows are packed each. Empty tables give no pieces.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaquery.llm.common import cut_lineage

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    """The vocabulary of a byte-level tokenizer file as ranks, and its added tokens.

    The file's merges are in id order, so ranks give the same ids. Added tokens are found in a text before anything
    else, as the tokenizers library does; what stands between them is encoded piece by piece.
    """
    import json

    import tiktoken

    added: dict[str, int] = {}
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    else:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or any(x[flag] for x in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} changes texts before it splits them")
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    marks = re.compile("(" + "|".join(sorted(map(re.escape, added), key=len, reverse=True)) + ")") if added else None
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), added, marks


def token_ids(encoder, text: str | None) -> list[int]:
    """The ids that the tokenizers library gives with add_special_tokens=False."""
    from mediaquery.llm.bpe import encode

    enc, added, marks = encoder
    if marks is None or not text or not marks.search(text):
        return encode(enc, text)
    return [i for part in marks.split(text) if part for i in ([added[part]] if part in added else encode(enc, part))]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: full ones, the first may be shorter."""
    pieces = max(1, -(-n // limit))
    first = n - limit * (pieces - 1)
    return [(0, first)] + [(first + limit * k, limit) for k in range(pieces - 1)]


def pieces(docs: DataFrame, path: str, pattern: str, limit: int = 1024, end: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.asarray([*token_ids(encoder, value.as_py()), end], dtype="<u4")
                raw = memoryview(ids.tobytes())
                key = key.as_py()
                rows += [(key, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids), limit))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE_DDL)


def patterns(cells: int, parts: int) -> np.ndarray:
    """All multisets of up to ``parts`` grid lengths with sum ``cells``, as a count matrix (patterns, cells + 1)."""
    found: list[tuple[int, ...]] = []

    def grow(left: int, most: int, chosen: tuple[int, ...]) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < parts:
            for x in range(min(most, left), 0, -1):
                if x * (parts - len(chosen)) < left:
                    break
                grow(left - x, x, (*chosen, x))

    grow(cells, cells, ())
    out = np.zeros((len(found), cells + 1), dtype=np.float32)
    for row, chosen in zip(out, found, strict=True):
        for x in chosen:
            row[x] += 1
    return out


def fit(matrix: np.ndarray, target: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that bring x @ matrix close to target: accelerated projected gradient on least squares."""
    if not target.any():
        return np.zeros(len(matrix))
    scale = float(target.sum())
    a, b = matrix.astype(np.float64), target / scale
    step, v = 1.0, np.ones(a.shape[1])
    for _ in range(30):  # the largest eigenvalue of a.T @ a
        v = a.T @ (a @ v)
        step = float(np.linalg.norm(v))
        v /= step
    x = np.zeros(len(a))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        gap = y @ a - b
        new = np.maximum(0, y - a @ gap / step)
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / following * (new - x), new, following
    return x * scale


def plan(histogram: dict[int, int], limit: int = 1024, grid: int = 4, parts: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) for a histogram of piece lengths."""
    have = np.zeros(limit + 1, dtype=np.int64)
    for n, c in histogram.items():
        have[n] = c
    groups: list[tuple[tuple[int, ...], int]] = []
    if have[limit]:
        groups.append(((limit,), int(have[limit])))
        have[limit] = 0
    cells = limit // grid
    coarse = np.zeros(cells + 1)
    for n in np.nonzero(have)[0]:
        coarse[-(-int(n) // grid)] += have[n]
    shapes = patterns(cells, parts)
    counts = np.floor(fit(shapes, coarse) + 1e-6).astype(np.int64)
    open_: dict[tuple[int, ...], int] = defaultdict(int)
    for k in np.argsort(-counts, kind="stable"):
        want = int(counts[k])
        if want <= 0:
            break
        need = [(int(c), int(shapes[k, c])) for c in np.nonzero(shapes[k])[0][::-1]]
        while want > 0:  # each turn takes as many sequences as the longest pieces of the cells allow alike
            chosen: list[int] = []
            left = have.copy()
            slots = [cell for cell, times in need for _ in range(times)]
            for k, cell in enumerate(slots):
                # the shortest slot takes the longest piece that the others leave room for
                top = limit - sum(chosen) if k == len(slots) - 1 else min(cell * grid, limit)
                n = next((n for n in range(top, (cell - 1) * grid, -1) if left[n]), 0)
                if not n:
                    break
                left[n] -= 1
                chosen.append(n)
            if len(chosen) < len(slots):
                break
            used = {n: chosen.count(n) for n in chosen}
            times = min(want, *(int(have[n]) // c for n, c in used.items()))
            for n, c in used.items():
                have[n] -= c * times
            open_[tuple(chosen)] += times
            want -= times
    # what remains: longest first into the sequence with the least room that still fits
    room: dict[int, list[list]] = defaultdict(list)
    for chosen, times in open_.items():
        room[limit - sum(chosen)].append([chosen, times])
    spaces = sorted(room)
    for n in range(limit, 0, -1):
        left = int(have[n])
        while left:
            at = bisect.bisect_left(spaces, n)
            if at < len(spaces):
                space = spaces[at]
                chosen, times = room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop(at)
                use = min(times, left)
                if use < times:
                    _open(room, spaces, space, chosen, times - use)
                _open(room, spaces, space - n, (*chosen, n), use)
                left -= use
            else:
                fits = limit // n
                if left >= fits:
                    _open(room, spaces, limit - fits * n, (n,) * fits, left // fits)
                    left %= fits
                if left:
                    _open(room, spaces, limit - left * n, (n,) * left, 1)
                    left = 0
    groups += [(chosen, times) for items in room.values() for chosen, times in items]
    return groups


def _open(room: dict, spaces: list[int], space: int, chosen: tuple[int, ...], times: int) -> None:
    if space not in room or not room[space]:
        bisect.insort(spaces, space)
    room[space].append([chosen, times])


def places(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks of runs, their first sequence, their offset. Ranks in a run go to following sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for chosen, times in groups:
        offset = 0
        for n in chosen:
            runs[n].append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def pack(docs: DataFrame, path: str, pattern: str, limit: int = 1024, end: int = 2, id_col: str = "doc_id", text: str = "text", grid: int = 4, parts: int = 3) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut_pieces = cut_lineage(pieces(docs, path, pattern, limit, end, id_col, text).withColumn("part", F.spark_partition_id()))
    counts = cut_lineage(cut_pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    shared = spark.sparkContext.broadcast(places(plan(histogram, limit, grid, parts)))
    return _dealt(cut_pieces, first, shared)


def _dealt(rows: DataFrame, first: DataFrame, shared) -> DataFrame:
    """Number the rows of each partition from its first ranks and look their places up in the plan."""
    order = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(order) - 1).join(first, ["part", "length"])
    ranked = ranked.select(*[f.name for f in _PIECES], (F.col("own") + F.col("first")).alias("rank"))
    schema = _PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                first, start, off = table[int(n)]
                mine = np.nonzero(length == n)[0]
                at = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = start[at] + rank[mine] - first[at], off[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(run, PIECE_DDL + ", sequence_id long, offset long")
