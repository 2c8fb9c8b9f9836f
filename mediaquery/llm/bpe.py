"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are pre-split by the split pattern itself: a part ends where a match does, so no match crosses, and is
encoded alone, so the encoder never holds a whole long text's matches. Decoding joins raw token bytes;
text is only made from them by the caller, so ids that end inside a character are safe.

Null and empty texts give no ids. Repeated rows and ties need no rule: rows are independent. Extra columns are
not carried besides ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaquery.llm.common import batched_rows

#: Texts over this many characters are cut at safe boundaries.
PART = 65_536


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoder of a rank file; loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def safe_parts(text: str, size: int, pattern: str) -> Iterator[str]:
    """Consecutive parts of a text, each at least ``size`` long but the last; encoding them one by one is exact.

    A part ends with a match of the split pattern that doesn't end in white space: only runs of white space look at
    what follows them. A single match longer than ``size`` stays whole, as its merges may reach from end to end.
    """
    start, n = 0, len(text)
    while n - start > size:
        end = next((m.end() for m in _splitter(pattern).finditer(text, start) if m.end() - start >= size and not text[m.end() - 1].isspace()), n)
        yield text[start:end]
        start = end
    if start < n:
        yield text[start:]


def encode(enc, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= PART:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, PART, enc._pat_str) for i in enc.encode_ordinary(part)]


def encode_table(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus ``ids``, the token ids of each whole text."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(enc, x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return source.mapInArrow(run, schema)


def decode_bytes(enc, ids) -> bytes:
    """Raw bytes of a list of ids."""
    return enc.decode_bytes(ids)


def digest_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Round trip per document: n_tokens, SHA-256 of the ids (little-endian 32 bits) and of the decoded bytes.

    Encoding and decoding share a task, so ids never leave it.
    """
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)

        def rows(batch: pa.RecordBatch):
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(enc, value.as_py())
                raw = decode_bytes(enc, ids)
                yield key.as_py(), len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw)

        yield from batched_rows(batches, out, rows)

    done = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
    return done.withColumnRenamed("id", id_col)


def decode_table(tokens: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``raw``, the bytes of ``ids``; null ids give null."""
    schema = T.StructType([*tokens.select(*keep).schema.fields, T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            raw = [None if x is None else decode_bytes(enc, x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(raw, pa.binary())], names=[*keep, "raw"])

    return tokens.select(*keep, "ids").mapInArrow(run, schema)
