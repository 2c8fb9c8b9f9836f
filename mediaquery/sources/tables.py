"""Readers and writers of manifests, media listings, documents and registry snapshots."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaquery.session import cut_lineage

# Media suffixes, manifest columns and library sections (a later section wins).
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "mkv")
MANIFEST_FIELDS = ("video_id", "path", "category", "note_id", "author", "enabled", "parent_category", "source_category", "market", "language")
FLAGS = {True: ("1", "on", "t", "true", "y", "yes"), False: ("0", "off", "f", "false", "n", "no")}
ASSET_SECTIONS = ("product_openpages", "product_recordings", "brand_assets", "overlay_assets", "fonts")

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("candidate_id", T.StringType()), T.StructField("video_id", T.StringType()), T.StructField("video_path", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("source_window", T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])),
    T.StructField("preferred_trim", T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])),
    T.StructField("peak_time", T.DoubleType()),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())), T.StructField("penalties", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()),
])
POOL_SCHEMA = T.StructType([T.StructField("category", T.StringType()), T.StructField("candidates", T.ArrayType(CANDIDATE_SCHEMA))])


def scan_manifest(spark: SparkSession, path: str, mode: str = "quarantine") -> DataFrame:
    """Typed material rows of CSV manifests with ``source_file`` and ``error``.

    Byte-order marks are tolerated, undeclared columns dropped, columns found by name, quoted line breaks kept.
    A row without an id, path or category, or with a flag that is none of ``FLAGS``, keeps its readable values and
    says in ``error`` what is wrong with it; ``enabled`` is then null unless the flag is fine. With mode ``strict``
    such a row fails the job instead. A manifest without the column ``enabled`` enables all rows. Only header lines
    are looked at before the plan is built.
    """
    if mode not in ("quarantine", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    raw = raw.select("*", F.col("_metadata.file_name").alias("source_file"))
    raw = raw.toDF(*[c.replace("\ufeff", "") for c in raw.columns])
    value = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    flag = F.lower(F.trim(value("enabled")))
    enabled = F.when(flag.isin(*FLAGS[True]), True).when(flag.isin(*FLAGS[False]), False) if "enabled" in raw.columns else F.lit(True)
    problems = [F.when(value(c).isNull(), F.lit(f"{c}: missing")) for c in ("video_id", "path", "category")]
    if "enabled" in raw.columns:
        problems.append(F.when(enabled.isNull(), F.concat(F.lit("enabled: not a flag: "), F.coalesce(value("enabled"), F.lit("")))))
    listed = F.array_join(F.array_compact(F.array(*problems)), "; ")
    error = F.when(listed != "", listed)
    if mode == "strict":
        enabled = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("bad manifest row in "), F.col("source_file"), F.lit(": "), error)).cast("boolean")).otherwise(enabled)
    return raw.select(
        *[value(c).alias(c) for c in ("video_id", "path", "category")], *[F.coalesce(value(c), F.lit("")).alias(c) for c in ("note_id", "author")],
        enabled.alias("enabled"), "source_file", error.alias("error"))


def scan_media_listing(spark: SparkSession, directory: str, extensions: Sequence[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """Path, size and time of media files below a folder; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "length", "modificationTime").where(suffix.isin(*[e.lower() for e in extensions]))


def content_fingerprints(listing: DataFrame, window: int = 1 << 20, whole: bool = False) -> DataFrame:
    """sha256 per file over size, time and its first and last MiB, or over its full content.

    Tasks read just those ranges through the cluster file system; a listing row is the unit of work.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for path, length, time in zip(batch["path"], batch["length"], batch["modificationTime"]):
                system, name = fs.FileSystem.from_uri(path)
                sha = hashlib.sha256()
                with system.open_input_file(name) as handle:
                    if whole:
                        while block := handle.read(window):
                            sha.update(block)
                    else:
                        sha.update(f"{length}{time.value}".encode())
                        sha.update(handle.read(window))
                        if length > window:
                            handle.seek(max(0, length - window))
                            sha.update(handle.read(window))
                out.append(sha.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "length": batch["length"], "fingerprint": out})

    spread = listing.select("path", "length", "modificationTime").repartition(F.col("path"))
    return spread.mapInPandas(digest, "path string, length long, fingerprint string")


def scan_documents(spark: SparkSession, path: str, layout: str = "file") -> DataFrame:
    """(source_file, value, valid) of JSON documents: one per file, indented or not, or one per line.

    ``valid`` says that the value is one JSON object. A file is one value, so it must fit in a task; logs of many
    documents are read with layout ``lines``.
    """
    if layout not in ("file", "lines"):
        raise ValueError(f"unknown layout {layout!r}")
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=layout == "file").select(F.col("_metadata.file_name").alias("source_file"), "value")
    text = F.regexp_replace("value", "^\ufeff", "")
    valid = F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{"))
    return raw.select("source_file", text.alias("value"), F.coalesce(valid, F.lit(False)).alias("valid"))


def _parsed(documents: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Documents with ``d``, their fields, and ``error`` for those that are no JSON object; a field of another type is null."""
    fields = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return documents.select("source_file", "value", "valid", F.when(F.col("valid"), fields).alias("d"), F.when(~F.col("valid"), F.lit("not a JSON object")).alias("error"))


def scan_candidate_pool(spark: SparkSession, path: str, default_category: str | None = None, layout: str = "file") -> DataFrame:
    """Candidate rows of pool documents with ``source_file`` and ``error``.

    A document that is no JSON object, or whose candidates are no list of objects, gives one row without a candidate
    and with an ``error``; a document without candidates gives none.
    """
    documents = _parsed(scan_documents(spark, path, layout), POOL_SCHEMA)
    unreadable = F.col("d.candidates").isNull() & F.get_json_object("value", "$.candidates").isNotNull()
    documents = documents.withColumn("error", F.coalesce("error", F.when(unreadable, F.lit("candidates: not a list of objects"))))
    none = F.array(F.lit(None).cast(CANDIDATE_SCHEMA))
    found = F.when(F.col("error").isNull(), F.coalesce(F.col("d.candidates"), F.array().cast(T.ArrayType(CANDIDATE_SCHEMA)))).otherwise(none)
    rows = documents.select("source_file", "error", F.coalesce("d.category", F.lit(default_category)).alias("category"), F.explode(found).alias("c"))
    return rows.select("category", "c.*", "source_file", "error")


def scan_analysis_documents(spark: SparkSession, path: str, fields: str, id_field: str = "video_id", layout: str = "file") -> DataFrame:
    """Per-video JSON documents with ``source_file``; one that is no object gives an empty row, ``valid`` false, and an ``error``.

    The id falls back to the file name without its suffix.
    """
    parsed = _parsed(scan_documents(spark, path, layout), fields)
    stem = F.regexp_replace("source_file", r"\.[^.]+$", "")
    names = [f.name for f in parsed.schema["d"].dataType.fields]
    columns = [F.col(f"d.`{n}`").alias(n) for n in names if n != id_field]
    return parsed.select(F.coalesce(F.col(f"d.`{id_field}`"), stem).alias(id_field), "valid", *columns, "source_file", "error")


def asset_index(sections: dict[str, DataFrame]) -> DataFrame:
    """One row per asset id from the library sections; the last section and position wins.

    Resolved by a partial aggregate, so copies of a hot id are reduced before the shuffle.
    """
    union = None
    for number, name in enumerate(ASSET_SECTIONS):
        if name in sections:
            part = sections[name].withColumns({"section": F.lit(name), "__o": F.lit(number)})
            union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    payload = [c for c in union.columns if c not in ("asset_id", "__o")]
    last = union.groupBy("asset_id").agg(F.max_by(F.struct(*payload), F.struct("__o", "ordinal")).alias("a"))
    return last.select("asset_id", "a.*")


def write_manifest(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    absent = lambda c: F.lit("true" if c == "enabled" else "").alias(c)
    present = [F.col(c).cast("string").alias(c) if c in rows.columns else absent(c) for c in MANIFEST_FIELDS]
    rows.select(*present).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_document_files(rows: DataFrame, path: str, name: str, mode: str = "errorifexists") -> None:
    """One indented JSON document per row in a folder of its own, named by the column ``name``, which is unique."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c != name]), {"pretty": "true", "ignoreNullFields": "false"})
    rows.select(name, body.alias("value")).write.mode(mode).partitionBy(name).text(path)


def write_documents(rows: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Nested rows as JSON documents, one per line, unescaped UTF-8, partitioned by run or category."""
    rows.write.mode(mode).partitionBy(*partition_by).option("ignoreNullFields", False).json(path)


def pool_documents(candidates: DataFrame, page: Column, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Candidates as pool documents. ``page`` cuts a category into documents of bounded size."""
    fields = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys, page.alias("page")).agg(F.collect_list(F.struct(*fields)).alias("candidates"))


class SnapshotTable:
    """A durable keyed table as immutable Parquet snapshots and an append-only log of versions.

    A writer stores the next snapshot in a new folder and then one tiny log row; readers take the
    highest logged version, so a lost job leaves at most an unreferenced folder. Writers of one table
    must not overlap.
    """

    def __init__(self, spark: SparkSession, root: str, partition_by: Sequence[str] = ()):
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), list(partition_by)

    def version(self) -> tuple[int, str] | None:
        try:
            log = self.spark.read.schema("version long, folder string").json(f"{self.root}/_versions")
            row = log.orderBy(F.col("version").desc()).limit(1).collect()
        except Exception as error:  # a table that was never written has no log folder
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return (row[0]["version"], row[0]["folder"]) if row else None

    def read(self) -> DataFrame | None:
        latest = self.version()
        return None if latest is None else self.spark.read.parquet(f"{self.root}/{latest[1]}")

    def write(self, rows: DataFrame) -> int:
        latest = self.version()
        number = latest[0] + 1 if latest else 1
        folder = f"v{number}-{uuid.uuid4().hex[:8]}"
        rows.write.partitionBy(*self.partition_by).parquet(f"{self.root}/{folder}")
        entry = self.spark.range(1).select(F.lit(number).cast("long").alias("version"), F.lit(folder).alias("folder"))
        entry.write.mode("append").json(f"{self.root}/_versions")
        return number


def stage(rows: DataFrame) -> DataFrame:
    """Stage boundary between steps of a plan."""
    return cut_lineage(rows)
