"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquery.session import cut_lineage

#: Words are maximal runs of anything but ASCII space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column, mod: int) -> Column:
    """crc32 of a value as text, modulo ``mod``."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever reads them.

    A generator over one struct is a barrier: later projections and filters refer to its output instead
    of inlining the expressions, which would run them once per reference (per element inside a lambda).
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def batched_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, make, size: int = 512) -> Iterator[pa.RecordBatch]:
    """``make(dict of columns) -> iterable of tuples``; output goes out in batches of ``size`` rows."""
    rows: list[tuple] = []
    for batch in batches:
        for row in make(batch):
            rows.append(row)
            if len(rows) >= size:
                yield to_batch(rows, schema)
                rows = []
    if rows:
        yield to_batch(rows, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of int64, cut to ``width`` or padded with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all() and lengths[0] >= width:
        return np.ascontiguousarray(values.reshape(len(lengths), -1)[:, :width].astype(np.int64))
    out = np.zeros((len(lengths), width), np.int64)
    ends = np.cumsum(lengths)
    for row, (n, end) in enumerate(zip(lengths, ends, strict=True)):
        out[row, : min(n, width)] = values[end - n : end - n + min(n, width)]
    return out


__all__ = ["GAP", "WORD", "batched_rows", "cut_lineage", "fold", "matrix", "once", "table", "to_batch"]
