"""Slot filling (survey 2.6): sequential under global quotas, so these have no SQL oracle except the single fill."""

from pyspark.sql import functions as F

from contract import views
from contract.base import query
from contract.intervals import beats
from contract.views import with_views
from mediaquery.operators import allocate, intervals

C = F.col


def slots(s, sf):
    """Two montage sections per category, cut on the beats of the track with that number."""
    looped = intervals.loop_beats(beats(s, sf), 17_500)
    pools = views.cand(s, sf).select(C("category").alias("track_id")).distinct()
    tracks = looped.join(pools, "track_id", "left_semi")
    first = intervals.build_slots(tracks, 0, 7_200, keys=pools)
    offset = first.groupBy("track_id").agg(F.max("slot_index").alias("o"))
    second = intervals.build_slots(tracks, 12_800, 17_500, keys=pools).join(offset, "track_id").withColumn("slot_index", C("slot_index") + C("o")).drop("o")
    return first.unionByName(second).withColumnRenamed("track_id", "pool_id")


def pool(s, sf):
    scored = views.cand(s, sf).select(
        C("category").alias("pool_id"), "candidate_id", "video_id", "event", (C("end_ms") - C("start_ms")).alias("trim_ms"),
        F.round((C("aesthetic") + C("payoff")) / 2, 4).alias("final_score"), C("candidate_id").alias("position"))
    history = views.registry(s, sf).select("candidate_id", "exported_count", (C("status") == "retired").alias("reserved"))
    return scored.join(history, "candidate_id", "left").withColumn("author", (C("video_id") % 30).cast("string"))


@query("assign_single", "F05", with_views("cand", "timeline", recursive=True, more={
    "k": "SELECT category AS pool_id, candidate_id, video_id, event, end_ms - start_ms AS trim_ms, round((aesthetic + payoff) / 2, 4) AS score FROM cand",
    "sl": "SELECT pool_id, i AS slot_index, 900 + (pool_id * 331 + i * 577) % 2600 AS len FROM (SELECT DISTINCT pool_id FROM k), (SELECT unnest(range(1, 9)) AS i)",
    "walk": """SELECT pool_id, 0::BIGINT AS i, []::BIGINT[] AS ids, []::BIGINT[] AS vids, NULL::BIGINT AS lv, NULL::VARCHAR AS le FROM (SELECT DISTINCT pool_id FROM k) UNION ALL
  SELECT pool_id, i + 1, list_append(ids, b.c), list_append(vids, b.v), b.v, b.e FROM (SELECT w.pool_id, w.i, w.ids, w.vids,
   (SELECT struct_pack(c := k.candidate_id, v := k.video_id, e := k.event) FROM k JOIN sl ON sl.pool_id = k.pool_id AND sl.slot_index = w.i + 1 WHERE k.pool_id = w.pool_id AND NOT list_contains(w.ids, k.candidate_id)
     AND len(list_filter(w.vids, lambda x: x = k.video_id)) < 2
     ORDER BY (w.lv IS NULL OR k.video_id <> w.lv) AND k.trim_ms >= sl.len * 0.8 DESC, coalesce(k.event = w.le, FALSE), k.score DESC, k.candidate_id LIMIT 1) AS b FROM walk w WHERE w.i < 8) WHERE b IS NOT NULL"""}, body="""
SELECT pool_id, i AS slot_index, ids[i] AS candidate_id, vids[i] AS video_id FROM walk WHERE i > 0"""))
def _(s, sf):
    p = pool(s, sf)
    gaps = p.select("pool_id").distinct().select("pool_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("slot_index")).select(
        "pool_id", "slot_index", F.lit(0).cast("long").alias("start_ms"), (900 + (C("pool_id") * 331 + C("slot_index") * 577) % 2600).alias("end_ms"))
    return allocate.assign_single(gaps, p)


@query("assign_batch", "F06")
def _(s, sf):
    return allocate.assign_batch(slots(s, sf), pool(s, sf), allocate.Quotas(creatives=5, candidate_uses=4, source_uses=12, previous_penalty=0.6, history_penalty=0.15))


@query("assign_exact_sources", "F07")
def _(s, sf):
    return allocate.assign_batch(slots(s, sf), pool(s, sf), allocate.Quotas(creatives=3, per_source=4, candidate_uses=2, source_uses=8, target_sources=3))


@query("assign_author_runs", "F08")
def _(s, sf):
    return allocate.assign_batch(slots(s, sf), pool(s, sf), allocate.Quotas(
        creatives=5, candidate_uses=4, source_uses=12, group_authors=True, avoid_author_reuse=True))
