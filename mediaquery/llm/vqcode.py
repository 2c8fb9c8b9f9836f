"""Product codes of vectors by Ball k-means on integers.

Components become integers, floor(scale * x), and every vector is cut into equal consecutive parts, each position with
a codebook of its own. A part that has an entry from the round before lies in that entry's ball, whose radius is the
largest distance of the parts at hand. By the triangle inequality another entry can be as near only if its squared
distance from the part's own entry is at most four times the part's: entries beyond twice the radius are no
neighbours of the ball, parts nearer than half the way to the nearest neighbour are its stable core and need no work,
and the rest lie in rings between the half ways, sorted by distance, of which each opens one more candidate. All of
it is exact in integers, ties included.

Each round is one pass over a written table of vectors and codes; tasks send the sums of their entries, at most
parts * entries rows each, and the driver keeps the codebook alone, whose size is fixed by its parameters.

Rows whose vector is null or holds null or non-finite components go. Vectors are padded with zeros to the longest
length, rounded up to a multiple of ``parts``; empty ones count as zeros. Rows with equal ids are coded each; seeds of
equal ids come by vector, null ids last. With fewer rows than entries the codebook is shorter. Distances that 64 bits
can't hold raise an error. Empty tables give no rows. Extra columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquery.llm.common import cut_lineage, matrix

#: Rows worked on at a time; copies of a label's total in the join that adds it.
ROWS, SALTS = 4_096, 32
#: Components up to this size keep squared distances of 2**20 components in 64 bits.
LARGEST = 1 << 20


def assign(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and its squared distance, from any earlier ``code``; ties to the lower index."""
    gaps = entries[:, None, :] - entries[None, :, :]
    between = (gaps * gaps).sum(axis=2)
    np.fill_diagonal(between, np.iinfo(np.int64).max)  # an entry is no neighbour of its own
    order = np.argsort(between, axis=1, kind="stable")
    ringed = np.take_along_axis(between, order, axis=1)[:, :-1]  # per entry: squared distances of the others, nearest first
    away = x - entries[code]
    far = (away * away).sum(axis=1)
    radius = np.zeros(len(entries), np.int64)
    np.maximum.at(radius, code, far)
    neighbours = (ringed <= 4 * radius[:, None]).sum(axis=1)
    best, near = code.copy(), far.copy()
    if not ringed.shape[1]:
        return best, near
    moving = np.flatnonzero(4 * far >= ringed[code, 0])  # the others are in stable cores
    place = 0
    while len(moving):
        at = order[code[moving], place]
        away = x[moving] - entries[at]
        found = (away * away).sum(axis=1)
        better = (found < near[moving]) | ((found == near[moving]) & (at < best[moving]))
        near[moving[better]], best[moving[better]] = found[better], at[better]
        place += 1
        moving = moving[place < neighbours[code[moving]]]
        moving = moving[ringed[code[moving], place] <= 4 * far[moving]] if place < ringed.shape[1] else moving[:0]
    return best, near


def floored(df: DataFrame, scale: int, id_col: str, vec: str, label: str) -> DataFrame:
    """(id, label, q) of the rows that are kept."""
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return kept.where(~bad).select("id", "label", F.transform("v", lambda x: F.floor(x * float(scale))).alias("q"))


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows with new codes and errors, by the entries (parts, entries, width)."""
    parts, _, width = books.shape
    label = rows.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                q = matrix(batch.column(2), parts * width)
                if q.max(initial=0) > LARGEST or q.min(initial=0) < -LARGEST:
                    raise ValueError(f"components beyond {LARGEST} after scaling; use a smaller scale")
                code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                error = np.zeros(len(batch), np.int64)
                for p in range(parts):
                    code[:, p], near = assign(q[:, p * width : (p + 1) * width], books[p], code[:, p])
                    error += near
                packed = pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed, pa.array(error)], names=["id", "label", "q", "code", "error"])

    return rows.select("id", "label", "q", "code").mapInArrow(run, f"id long, label {label.simpleString()}, q array<long>, code binary, error long")


def _sums(coded: DataFrame, books: np.ndarray) -> list:
    """(part, entry, count, sums) over all rows, added up in each task first; at most parts * entries rows."""
    parts, entries, width = books.shape
    out = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            q = matrix(batch.column(0), parts * width).reshape(-1, parts, width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], q[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], schema=out)

    partial = coded.select("q", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    sums = F.array(*[F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(width)])
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect()


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept row; ``entries`` up to 256."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have one byte a part")
    rows = floored(df, scale, id_col, vec, label)
    longest = rows.agg(F.max(F.size("q"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = rows.orderBy(F.asc_nulls_last("id"), "q").limit(entries).select("q").collect()
    books = np.zeros((parts, max(1, len(first)), width), np.int64)
    for k, r in enumerate(first):
        books[:, k] = np.r_[np.array(r["q"], np.int64), np.zeros(parts * width - len(r["q"]), np.int64)].reshape(parts, width)
    coded = rows.withColumn("code", F.lit(bytes(parts)))
    for _ in range(rounds):
        coded = cut_lineage(_coded(coded, books))
        books = books.copy()
        for r in _sums(coded, books):
            books[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    done = cut_lineage(_coded(coded, books)).select("id", "label", F.lower(F.hex("code")).alias("code"), "error")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # a label may hold a third of all rows: its rows are spread by a salt, its total is copied to every salt
    totals = done.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    copies = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    salted = done.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
