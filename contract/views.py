"""Logical media tables derived from the driver's tables, once in Spark and once as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquery.functions.ordered import ordered_scan
from mediaquery.session import cut_lineage, widen


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for CPU-heavy text work: the small test file is one split, so it is spread first."""
    return widen(table(spark, sf, "documents"))


def staged(df: DataFrame) -> DataFrame:
    """A derived view as the stage table an operator that reads it several times would be given."""
    return cut_lineage(df)


def cand(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id candidate_id", "user_id video_id", "user_id % 5 category", "event_type event",
        "20000 + (user_id * 7919) % 180000 dur_ms",
        "unix_micros(cast(ts as timestamp)) div 1000 % (20000 + (user_id * 7919) % 180000) start_ms",
        "unix_micros(cast(ts as timestamp)) div 1000 % (20000 + (user_id * 7919) % 180000)"
        " + 300 + (event_id * 137) % 3500 end_ms",
        "(event_id * 7) % 101 / 100 confidence", "(event_id * 13) % 101 / 100 aesthetic",
        "(event_id * 29) % 101 / 100 payoff", "(event_id * 37) % 101 / 100 action_intensity",
        "(event_id * 53) % 101 / 100 subject_visibility",
        "cast(0.7 as double) sharpness", "cast(0.7 as double) composition",
        "cast(0.85 as double) context_independence", "value",
    )


def material(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().selectExpr(
        "user_id video_id", "user_id % 5 category", "user_id % 10 <> 0 enabled", "user_id position",
        "20000 + (user_id * 7919) % 180000 dur_ms",
        """case when user_id % 13 = 0 then concat('/m/plain', user_id, '.mp4')
           when user_id % 11 = 0 then concat('/m/cat', user_id % 3, '-sub', user_id % 7, '_x*@a', user_id % 30,
             '*mk', user_id % 4, '_', lpad(user_id, 24, '0'), '.mp4')
           else concat('/m/cat', user_id % 3, '-sub', user_id % 7, '_@a_', user_id % 30, '_mk', user_id % 4,
             '_lang', user_id % 2, '_', lpad(user_id, 24, '0'), '.mp4') end path""",
    )


def clip(spark, sf):
    """Order lines as creative clips, numbered inside the creative."""
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey creative_id", "l_linenumber", "l_partkey candidate_id", "l_suppkey video_id",
        "cast(l_quantity * 100 as bigint) dur_ms", "l_returnflag flag",
    )
    order = [F.col("l_linenumber"), F.col("candidate_id"), F.col("video_id")]
    return ordered_scan(
        lines, ["creative_id"], order, rank="pos", running_sum={"until_ms": F.col("dur_ms")}
    )


def timeline(spark, sf):
    return clip(spark, sf).selectExpr(
        "creative_id", "pos", "concat('c', creative_id, '-', pos) clip_id", "candidate_id", "video_id", "flag", "dur_ms",
        "greatest(0, until_ms - dur_ms + (candidate_id % 7 - 3) * 50) start_ms",
        "greatest(0, until_ms - dur_ms + (candidate_id % 7 - 3) * 50) + dur_ms end_ms",
    )


def usage(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey creative_id", "o_custkey run_id", "unix_millis(cast(o_orderdate as timestamp)) at_ms",
        "case o_orderstatus when 'O' then 'reserved' when 'F' then 'committed' else 'released' end state",
    )
    pairs = clip(spark, sf).groupBy("creative_id", "candidate_id").agg(
        F.min("pos").alias("pos"), F.min_by("video_id", "pos").alias("video_id")
    )
    return pairs.join(orders, "creative_id")


def registry(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey candidate_id", "p_brand category", "p_type event",
        "case p_partkey % 4 when 0 then 'used' when 3 then 'retired' else 'eligible' end status",
        "p_partkey % 3 selected_count", "p_partkey % 2 exported_count",
        "(p_partkey * 37) % 100000 trim_start_ms",
        "(p_partkey * 37) % 100000 + 300 + (p_partkey * 137) % 3500 trim_end_ms",
    )


def bgm(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey bgm_id", "p_brand category", "concat(p_type, '/', p_size % 10) fingerprint",
        "60 + (p_partkey * 17) % 121 bpm", "(p_partkey * 31) % 101 / 100 music_score",
        "(p_partkey * 11) % 41 / 100 speech_risk", "(p_partkey * 3) % 30 * 1000 duration_ms",
        "p_partkey % 4 exported_count", "p_partkey updated_at", "p_type audio_kind",
    )


def pcm(spark, sf):
    vectors = ordered_scan(
        table(spark, sf, "embeddings"), ["label"], [F.col("vec_id")], F.floor(F.col("vec_id") / 4096), rank="__rk"
    )
    return vectors.select(F.col("label").cast("long").alias("audio_id"), "__rk", F.posexplode("embedding").alias("i", "x")).selectExpr(
        "audio_id", "(__rk - 1) * 64 + i idx", "cast(x as double) sample"
    )


def tags(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "concat(user_id, '/', unix_micros(cast(ts as timestamp)) div 86400000000) clip_id",
        """case event_type when 'view' then 'Music' when 'click' then 'Speech' when 'purchase' then 'Singing'
           when 'signup' then 'Rap' else 'Scrape, ambient' end label""",
        "(event_id * 19) % 101 / 100 score", "event_id",
    )


def transcript(spark, sf):
    turns = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "role speaker", "text", "char_length(text) * 50L dur_ms"
    )
    return ordered_scan(
        turns, ["conv_id"], [F.col("turn")], F.floor(F.col("turn") / 64), running_sum={"end_ms": F.col("dur_ms")}
    ).withColumn("start_ms", F.col("end_ms") - F.col("dur_ms"))


def frame(spark, sf):
    base = table(spark, sf, "embeddings").selectExpr(
        "vec_id", "label",
        "aggregate(sequence(0, 63), 0L, (acc, i) -> acc | "
        "if(embedding[i] > embedding[(i + 1) % 64], shiftleft(1L, i), 0L)) hash",
        "transform(embedding, x -> cast(least(255, greatest(0, floor((cast(x as double) + 1) * 127.5))) as int)) luma",
    )
    near = base.selectExpr(
        "vec_id + 1000000 frame_id", "label",
        "hash ^ shiftleft(1L, cast(vec_id % 63 as int)) ^ shiftleft(1L, cast((vec_id * 7 + 1) % 63 as int)) hash", "luma",
    )
    return base.withColumnRenamed("vec_id", "frame_id").unionByName(near)


def recall(spark, sf):
    return cand(spark, sf).selectExpr(
        "candidate_id recall_id", "video_id", "dur_ms", "event query_group", "candidate_id % 17 <> 0 ok", "start_ms",
        "end_ms + if(candidate_id % 9 = 0, 40000, 0) end_ms", "concat('d', candidate_id % 23) description",
    )


SQL = {
    "cand": ([], """SELECT event_id AS candidate_id, user_id AS video_id, user_id % 5 AS category, event_type AS event,
  20000 + (user_id * 7919) % 180000 AS dur_ms,
  (epoch_us(ts) // 1000) % (20000 + (user_id * 7919) % 180000) AS start_ms,
  (epoch_us(ts) // 1000) % (20000 + (user_id * 7919) % 180000) + 300 + (event_id * 137) % 3500 AS end_ms,
  ((event_id * 7) % 101) / 100 AS confidence, ((event_id * 13) % 101) / 100 AS aesthetic,
  ((event_id * 29) % 101) / 100 AS payoff, ((event_id * 37) % 101) / 100 AS action_intensity,
  ((event_id * 53) % 101) / 100 AS subject_visibility, 0.7::DOUBLE AS sharpness, 0.7::DOUBLE AS composition,
  0.85::DOUBLE AS context_independence, value FROM events"""),
    "material": ([], """SELECT video_id, video_id % 5 AS category, video_id % 10 <> 0 AS enabled, video_id AS position,
  20000 + (video_id * 7919) % 180000 AS dur_ms,
  CASE WHEN video_id % 13 = 0 THEN '/m/plain' || video_id || '.mp4'
   WHEN video_id % 11 = 0 THEN '/m/cat' || video_id % 3 || '-sub' || video_id % 7 || '_x*@a' || video_id % 30 || '*mk'
     || video_id % 4 || '_' || lpad(video_id::VARCHAR, 24, '0') || '.mp4'
   ELSE '/m/cat' || video_id % 3 || '-sub' || video_id % 7 || '_@a_' || video_id % 30 || '_mk' || video_id % 4 || '_lang'
     || video_id % 2 || '_' || lpad(video_id::VARCHAR, 24, '0') || '.mp4' END AS path
  FROM (SELECT DISTINCT user_id AS video_id FROM events)"""),
    "clip": ([], """SELECT l_orderkey AS creative_id, l_partkey AS candidate_id, l_suppkey AS video_id,
  (l_quantity * 100)::BIGINT AS dur_ms, l_returnflag AS flag,
  row_number() OVER o AS pos, sum((l_quantity * 100)::BIGINT) OVER o AS until_ms
  FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "timeline": (["clip"], """SELECT creative_id, pos, 'c' || creative_id || '-' || pos AS clip_id, candidate_id, video_id, flag, dur_ms,
  greatest(0, until_ms - dur_ms + (candidate_id % 7 - 3) * 50)::BIGINT AS start_ms,
  greatest(0, until_ms - dur_ms + (candidate_id % 7 - 3) * 50)::BIGINT + dur_ms AS end_ms FROM clip"""),
    "usage": (["clip"], """SELECT c.creative_id, c.candidate_id, c.pos, c.video_id, o_custkey AS run_id, epoch_ms(o_orderdate) AS at_ms,
  CASE o_orderstatus WHEN 'O' THEN 'reserved' WHEN 'F' THEN 'committed' ELSE 'released' END AS state
  FROM (SELECT creative_id, candidate_id, min(pos) AS pos, arg_min(video_id, pos) AS video_id FROM clip GROUP BY ALL) c
  JOIN orders ON o_orderkey = c.creative_id"""),
    "registry": ([], """SELECT p_partkey AS candidate_id, p_brand AS category, p_type AS event,
  CASE p_partkey % 4 WHEN 0 THEN 'used' WHEN 3 THEN 'retired' ELSE 'eligible' END AS status,
  p_partkey % 3 AS selected_count, p_partkey % 2 AS exported_count,
  (p_partkey * 37) % 100000 AS trim_start_ms, (p_partkey * 37) % 100000 + 300 + (p_partkey * 137) % 3500 AS trim_end_ms
  FROM part"""),
    "bgm": ([], """SELECT p_partkey AS bgm_id, p_brand AS category, p_type || '/' || p_size % 10 AS fingerprint,
  60 + (p_partkey * 17) % 121 AS bpm, ((p_partkey * 31) % 101) / 100 AS music_score,
  ((p_partkey * 11) % 41) / 100 AS speech_risk, (p_partkey * 3) % 30 * 1000 AS duration_ms,
  p_partkey % 4 AS exported_count, p_partkey AS updated_at, p_type AS audio_kind FROM part"""),
    "pcm": ([], """SELECT label::BIGINT AS audio_id, (rk - 1) * 64 + i AS idx, embedding[i + 1]::DOUBLE AS sample
  FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rk,
        unnest(range(0, len(embedding))) AS i FROM embeddings)"""),
    "tags": ([], """SELECT user_id || '/' || epoch_us(ts) // 86400000000 AS clip_id,
  CASE event_type WHEN 'view' THEN 'Music' WHEN 'click' THEN 'Speech' WHEN 'purchase' THEN 'Singing'
   WHEN 'signup' THEN 'Rap' ELSE 'Scrape, ambient' END AS label,
  ((event_id * 19) % 101) / 100 AS score, event_id FROM events"""),
    "transcript": ([], """SELECT conv_id, turn, role AS speaker, text, length(text) * 50 AS dur_ms,
  sum(length(text) * 50) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS end_ms,
  (sum(length(text) * 50) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) * 50)::BIGINT AS start_ms
  FROM conversations"""),
    "frame0": ([], """SELECT vec_id, label,
  list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > embedding[i + 2] THEN 1::BIGINT << i ELSE 0 END))::BIGINT
   + CASE WHEN embedding[64] > embedding[1] THEN -9223372036854775808 ELSE 0 END::BIGINT AS hash,
  list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 1) * 127.5)))::INTEGER) AS luma
  FROM embeddings"""),
    "frame": (["frame0"], """SELECT vec_id AS frame_id, label, hash, luma FROM frame0 UNION ALL
  SELECT vec_id + 1000000, label, xor(xor(hash, 1::BIGINT << (vec_id % 63)), 1::BIGINT << ((vec_id * 7 + 1) % 63)), luma FROM frame0"""),
    "recall": (["cand"], """SELECT candidate_id AS recall_id, video_id, dur_ms, event AS query_group, candidate_id % 17 <> 0 AS ok, start_ms,
  end_ms + CASE WHEN candidate_id % 9 = 0 THEN 40000 ELSE 0 END AS end_ms, 'd' || candidate_id % 23 AS description FROM cand"""),
}


def with_views(*names: str, body: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``body`` with the named views, their dependencies and any extra CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in SQL[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({SQL[n][1]})" for n in ordered]
    parts += [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()
