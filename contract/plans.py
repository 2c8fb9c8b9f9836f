"""Whole plans over the driver's tables."""

from pyspark.sql import functions as F

from contract import views
from contract.allocation import pool
from contract.base import query
from contract.filters import WEIGHT_SQL, WEIGHTS
from contract.intervals import beats
from contract.sequences import SUPPRESS
from contract.views import with_views
from mediaquery.operators import allocate, covers
from mediaquery.plans import plans

C = F.col


@query("top_highlights", "H01 F01 E21", with_views("cand", recursive=True, more={**SUPPRESS, "sc": f"""SELECT c.*, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, aesthetic * 0.22::DOUBLE
  + ({WEIGHT_SQL}) * 0.2::DOUBLE + payoff * 0.15::DOUBLE + action_intensity * 0.13::DOUBLE + subject_visibility * 0.1::DOUBLE + sharpness * 0.08::DOUBLE + composition * 0.07::DOUBLE + context_independence * 0.05::DOUBLE)), 4) AS final_score
  FROM cand c JOIN keep USING (candidate_id)"""}, body="""
SELECT video_id, candidate_id, final_score, row_number() OVER (PARTITION BY video_id ORDER BY final_score DESC, candidate_id)::INTEGER AS rank FROM sc QUALIFY rank <= 3"""))
def top_highlights(s, sf):
    c = views.cand(s, sf).withColumns({"position": C("candidate_id"), "category_event_value": C("payoff")})
    return plans.top_highlights(c, WEIGHTS, 3).select("video_id", "candidate_id", "final_score", "rank")


@query("compose_batch", "F06 G01 E14 D15 D04")
def _(s, sf):
    p = pool(s, sf).drop("exported_count", "reserved", "final_score", "trim_ms")
    c = p.join(views.cand(s, sf).drop("category", "video_id", "event"), "candidate_id").withColumn("category_event_value", C("payoff"))
    registry = views.registry(s, sf).selectExpr("candidate_id", "category", "status", "selected_count", "exported_count", "cast(null as string) last_run_id", "cast(null as string) last_creative_id")
    usage = views.usage(s, sf).selectExpr("candidate_id", "cast(run_id as string) run_id", "cast(creative_id as string) creative_id", "state").where("state <> 'reserved'")
    pools = c.select("pool_id").distinct()
    campaigns = pools.selectExpr("pool_id", "concat('open', pool_id) product_openpage_asset_id", "concat('rec', pool_id) product_recording_asset_id", "concat('end', pool_id) endcard_asset_id")
    music = beats(s, sf).withColumnRenamed("track_id", "pool_id").join(pools, "pool_id", "left_semi")
    done = plans.compose_batch(c, music, campaigns, registry, usage, weights=WEIGHTS, run_id="run-v1",
                               quotas=allocate.Quotas(creatives=4, candidate_uses=4, source_uses=12, group_authors=True, avoid_author_reuse=True))
    clips = done.timeline.groupBy("creative_id").agg(F.count("*").alias("clips"), F.max("end_ms").alias("end_ms"))
    return clips.join(done.verdicts.select("creative_id", C("error_count").alias("errors"), "passed", "partial"), "creative_id")


COVERS = {
    "sel": """SELECT u.run_id, u.creative_id, u.pos, c.* FROM (SELECT o_custkey AS run_id, l_orderkey AS creative_id, l_partkey AS candidate_id, min(l_linenumber * 10000000 + l_partkey) AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) u
 JOIN cand c USING (candidate_id)""",
    "top": """SELECT *, row_number() OVER (PARTITION BY creative_id ORDER BY CASE event WHEN 'purchase' THEN 1.0 WHEN 'view' THEN 0.92 WHEN 'click' THEN 0.84 ELSE 0.55 END DESC,
  aesthetic DESC, subject_visibility DESC, sharpness DESC, composition DESC, payoff DESC, pos)::INTEGER AS rank FROM sel QUALIFY rank <= 5""",
    "opt": """SELECT run_id, creative_id, candidate_id, ((rank - 1) * 3 + i)::INTEGER AS ordinal, start_ms + (end_ms - start_ms) * (i + 1) / 4 AS at_ms, hash, (candidate_id + i) % 3 <> 0 AS ok
 FROM top CROSS JOIN (VALUES (0), (1), (2)) t(i) JOIN frame ON frame_id = (candidate_id * 3 + i) % 60 + 1 + CASE WHEN candidate_id % 2 = 1 THEN 1000000 ELSE 0 END WHERE candidate_id % 11 <> 0""",
    "lists": "SELECT run_id, creative_id, row_number() OVER (PARTITION BY run_id ORDER BY creative_id) AS n, list({'ordinal': ordinal, 'hash': hash, 'ok': ok} ORDER BY ordinal) AS o FROM opt GROUP BY 1, 2",
    "walk": """SELECT DISTINCT run_id, 0::BIGINT AS n, NULL::BIGINT AS creative_id, NULL::INTEGER AS ordinal, NULL::INTEGER AS tier, []::BIGINT[] AS used FROM lists UNION ALL
 SELECT run_id, n, creative_id, p.ordinal, p.tier, list_append(used, p.hash) FROM (SELECT w.run_id, l.n, l.creative_id, w.used, list_sort(list_transform(l.o, lambda x:
  {'tier': CASE WHEN len(list_filter(w.used, lambda u: bit_count(xor(u, x.hash)) <= 10)) > 0 THEN 2 WHEN x.ok THEN 0 ELSE 1 END::INTEGER, 'ordinal': x.ordinal, 'hash': x.hash}))[1] AS p
  FROM walk w JOIN lists l ON l.run_id = w.run_id AND l.n = w.n + 1)""",
}


@query("cover_plan", "E22 E23 B18 C12 F10", with_views("cand", "frame", recursive=True, more=COVERS, body="""SELECT t.run_id, t.creative_id, coalesce(o.candidate_id, t.candidate_id) AS candidate_id, w.ordinal, coalesce(o.at_ms, t.start_ms)::DOUBLE AS at_ms, o.hash, w.tier,
 CASE WHEN w.ordinal IS NULL THEN 'no_review_frames_fallback' ELSE 'quality_filtered_fallback' END AS mode
 FROM top t LEFT JOIN walk w ON w.run_id = t.run_id AND w.creative_id = t.creative_id LEFT JOIN opt o ON o.creative_id = w.creative_id AND o.ordinal = w.ordinal WHERE t.rank = 1"""))
def _(s, sf):
    orders, lines = views.table(s, sf, "orders"), views.table(s, sf, "lineitem")
    used = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("run_id"), F.col("l_orderkey").alias("creative_id"), F.col("l_partkey").alias("candidate_id")).agg(F.min(F.expr("l_linenumber * 10000000 + l_partkey")).alias("pos"))  # line numbers repeat within an order
    selected = used.join(views.cand(s, sf), "candidate_id").withColumn("peak_ms", F.lit(None).cast("long"))
    # three frames per candidate; one candidate in eleven has none that could be decoded
    shots = views.cand(s, sf).where("candidate_id % 11 <> 0").select("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample"))
    shots = shots.withColumn("frame_id", F.expr("(candidate_id * 3 + sample) % 60 + 1 + if(candidate_id % 2 = 1, 1000000, 0)"))
    frames = shots.join(views.frame(s, sf).select("frame_id", "hash"), "frame_id").withColumn("acceptable", F.expr("(candidate_id + sample) % 3 <> 0"))
    return covers.cover_plan(selected, frames, ["purchase", "view", "click"])
