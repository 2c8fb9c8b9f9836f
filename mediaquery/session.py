"""Session defaults and the shared folder that lineage cuts and stage tables use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this library assumes; a cluster overrides sizes, not semantics.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # with the default of 64 MB partitions are merged until there is one for each core, so a task's rows grow with the input
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "false",
}


def build_session(app: str = "mediaquery", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only an unset one (tests) gets a local default."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="mediaquery-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so tasks import it from any working folder."""
    context = spark.sparkContext
    if getattr(context, "_mediaquery_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="mediaquery-"), "mediaquery.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._mediaquery_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor never restarts a long loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_out(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Folder and rows of a large stage table as Parquet in the shared folder; checkpoints hold rows uncompressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table that ``cut_lineage`` returned, once nothing reads it any more.

    Without this, a loop's old tables stay until the driver's garbage collection meets them, or for good.
    """
    plan = df._jdf.queryExecution().logical()
    name = plan.rdd().getCheckpointFile()
    if name.isDefined():
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(name.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def forget_path(spark: SparkSession, path: str) -> None:
    """Remove a folder below ``scratch_path``, once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def find_paths(spark: SparkSession, pattern: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return [x.getPath().toString() for x in found or []]


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before CPU-heavy row work.

    Cluster-size inputs have far more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df
