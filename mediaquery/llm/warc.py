"""WARC archives written and read as chunked records.

A payload becomes rows (record id, chunk number): the first chunk is the record's own segment, later ones are
``continuation`` records in the format's standard segmentation. Each row carries the SHA-1 state's digest after
its chunk, so the last one has the digest of the whole payload and a reader can check every chunk as it streams.
Python never holds more of a payload than one chunk besides the input value itself.

Records of equal payloads of at least ``min_bytes`` bytes: the one with the largest id is the response, others
are revisits that refer to it. Files are plain WARC 1.1, gzipped as a whole by Spark's text writer; its
line separator is the record terminator, and lengths in the headers, not separators, delimit records on reading.

Null payloads are empty; a null id is written as None and read back as null, and is never referred to. Ids are unique by contract; rows that repeat an id are separate records. Empty tables
give an archive without records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquery.llm.common import to_batch

END = "\r\n\r\n"
#: Payload bytes in one chunk.
CHUNK = 262_144

_CHUNKS = pa.schema([("record_id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("url", pa.string()), ("body", pa.binary()), ("total", pa.int64()), ("digest", pa.string())])
CHUNK_DDL = "record_id long, chunk int, last boolean, url string, body binary, total long, digest string"


def base32_sha1(state) -> str:
    return base64.b32encode(state.digest()).decode()


def chunk_table(pages: DataFrame, id_col: str = "page_id", payload: str = "html", url: str = "url", size: int = CHUNK, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (record_id, chunk): body, bytes so far and digest so far; ``extra`` string columns ride along."""
    schema = _CHUNKS
    for name in extra:
        schema = schema.append(pa.field(name, pa.string()))
    source = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("p"), *[F.col(c).cast("string") for c in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                view, state = memoryview(batch.column(2)[k].as_buffer()), hashlib.sha1()
                more = [batch.column(3 + x)[k].as_py() for x in range(len(extra))]
                for number in range(max(1, -(-len(view) // size))):
                    body = view[number * size : (number + 1) * size]
                    state.update(body)
                    end = min(len(view), (number + 1) * size)
                    rows.append((batch.column(0)[k].as_py(), number, end == len(view), batch.column(1)[k].as_py(), bytes(body), end, base32_sha1(state), *more))
                    held += len(body)
                    if held > 4 * size:
                        yield to_batch(rows, schema)
                        rows, held = [], 0
            if rows:
                yield to_batch(rows, schema)

    return source.mapInArrow(run, CHUNK_DDL + "".join(f", `{c}` string" for c in extra))


def record_types(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload: str = "html") -> DataFrame:
    """The input plus ``_first``: the id of the response with the same payload (its own id for responses).

    Payload digests are reduced to one row each before the payloads move, and they move once. A payload that
    many pages share is a hot key of that join, which Spark splits by its skew rule.
    """
    keyed = pages.withColumn("_payload", F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).withColumn("_sha", F.sha1("_payload"))
    largest = keyed.where(F.octet_length("_payload") >= min_bytes).groupBy("_sha").agg(F.max(F.col(id_col)).alias("_big"))
    return keyed.join(largest, "_sha", "left").withColumn("_first", F.coalesce("_big", F.col(id_col))).drop("_sha", "_big", "_payload")


def _record(kind, page, chunk, last, url, body: bytes, total, digest, first) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind if not chunk else 'continuation'}", f"WARC-Record-ID: <urn:page:{page}:{chunk}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {clean}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{first}:0>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if chunk or not last:
        lines.append(f"WARC-Segment-Number: {chunk + 1}")
    if chunk:
        lines.append(f"WARC-Segment-Origin-ID: <urn:page:{page}:0>")
        if last:
            lines.append(f"WARC-Segment-Total-Length: {total}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {total}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + END).encode() + body


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, size: int = CHUNK, id_col: str = "page_id", payload: str = "html", url: str = "url") -> None:
    """Write one logical record per row below ``path``, a folder that driver and executors share."""
    kinds = record_types(pages.select(id_col, url, payload), min_bytes, id_col, payload)
    chunks = chunk_table(kinds, id_col, payload, url, size, extra=("_first",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, chunk, last, link, body, total, digest, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                revisit = first is not None and int(first) != page
                if revisit and not last:
                    continue  # a revisit is one record without a body; its last chunk has the whole digest
                out.append(_record("revisit", page, 0, True, link, b"", total, digest, first) if revisit else _record("response", page, chunk, last, link, body, total, digest, first))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = chunks.mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").mode("errorifexists").text(path)


class _Stream:
    """Bytes of one file, pushed in pieces; pulls whole headers and bodies."""

    def __init__(self) -> None:
        self.buffer = bytearray()

    def pull(self, n: int) -> bytes | None:
        if len(self.buffer) < n:
            return None
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def header(self) -> dict[str, str] | None:
        at = self.buffer.find(END.encode())
        if at < 0:
            return None
        text = self.pull(at + len(END)).decode()
        first, *lines = text[: -len(END)].split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:60]!r}")
        return dict(line.split(": ", 1) for line in lines)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Segments in file order: (record_id, chunk, kind, url, refers_to, body, total, digest).

    Whole-file gzip keeps a file in one task; it is read as a stream of pieces, and a body never exceeds a chunk.
    The digest so far is computed again over a record's segments and must equal the header's.
    """
    out = pa.schema([("record_id", pa.int64()), ("chunk", pa.int32()), ("kind", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("body", pa.binary()), ("total", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, head, state, total, page = _Stream(), None, hashlib.sha1(), 0, None
        for batch in batches:
            rows = []
            for piece in batch.column(0):
                stream.buffer += piece.as_buffer().to_pybytes() + END.encode()
                while True:
                    head = head or stream.header()
                    if head is None:
                        break
                    body = stream.pull(int(head["Content-Length"]) + len(END))
                    if body is None:
                        break
                    body, kind = body[: -len(END)], head["WARC-Type"]
                    _, _, number, chunk = head["WARC-Record-ID"].strip("<>").split(":")
                    digest, bytes_so_far = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Bytes"])
                    if kind != "continuation":
                        state, total, page = hashlib.sha1(), 0, number
                    elif page != number:
                        raise ValueError(f"segment {chunk} of record {number} stands apart from its record")
                    if kind != "revisit":
                        state.update(body)
                        total += len(body)
                        if base32_sha1(state) != digest or total != bytes_so_far:
                            raise ValueError(f"record {number}, segment {chunk}: payload and digest differ")
                    refers = head.get("WARC-Refers-To")
                    single = kind != "continuation" and "WARC-Segment-Number" not in head
                    rows.append((None if number == "None" else int(number), int(chunk), kind, head.get("WARC-Target-URI"), int(refers.strip("<>").split(":")[2]) if refers else None, body, total if kind != "revisit" else bytes_so_far, base32_sha1(state) if kind != "revisit" else digest, single or "WARC-Segment-Total-Length" in head))
                    head = None
            if rows:
                yield to_batch(rows, out)
        if head or stream.buffer.strip(b"\r\n"):
            raise ValueError("the archive ends inside a record")

    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"))
    return pieces.mapInArrow(run, "record_id long, chunk int, kind string, url string, refers_to long, body binary, total long, digest string, last boolean")


def records(segments: DataFrame) -> DataFrame:
    """One row per record from its last segment, which has the whole payload's length and digest."""
    kind = F.when(F.col("kind") == "revisit", "revisit").otherwise("response")
    return segments.where("last").select("record_id", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), kind.alias("record_type"), "refers_to", "url", (F.col("chunk") + 1).alias("segments"))
