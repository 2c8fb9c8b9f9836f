"""The corpus pipeline: quality rules, toxicity, line dedup, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of the input.
Stages are written as Parquet in the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquery.llm import linededup, packing, quality, queries, simhash, toxicity
from mediaquery.session import cut_lineage, forget_path, scratch_path

#: Toxic words come with scores that SQL cannot express; a brute-force version in the tests covers the pipeline.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.filter_documents(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the model is that of the toxicity query."""
    return toxicity.filter_documents(docs, queries.toxicity_model(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line runs of 50 words or more that stand earlier; documents that lose all their words go."""
    return linededup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8).

    Groups are of texts, so ids may be null or repeat: the smallest id stays, a null one only where no other is in the
    group, and of ids that repeat the smallest hash of the text; of rows equal in id and text one stays. Null texts
    are empty ones, and texts without a word are equal. Columns keep their names and order, whatever they are called.
    """
    key = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    texts = docs.select("doc_id", key.alias("key"), "text")
    groups = simhash.near_duplicates(texts, id_col="key").distinct()
    rows = texts.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("x"))
    least = F.min(F.struct("x.none", "x.doc_id", "key", "x.n")).alias("x")
    heads = cut_lineage(first.join(groups, "key").groupBy("component_id").agg(least).select(F.col("x.doc_id").alias("id"), F.col("x.key").alias("key"), "x.n"))

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs["doc_id"].eqNullSafe(some["id"]) & (key == some["key"]), "left_semi")

    kept, repeated = of(heads.where("n = 1")), heads.where("n > 1")
    return kept if repeated.isEmpty() else kept.unionByName(of(repeated).withColumn("__text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "__text"]).drop("__text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(docs, queries.rank_file("byte_bpe_50k.json"), queries.split_pattern())


STAGES = [("quality_rules", quality_rules), ("toxicity", without_toxic), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the stage that read it is written
            forget_path(spark, before)
        before = path
    return docs
