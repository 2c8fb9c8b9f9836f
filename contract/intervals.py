"""Lookup joins, interval and set operators (survey 2.3, 2.5, 2.7)."""

from pyspark.sql import functions as F

from contract import views
from contract.base import query
from contract.views import table, with_views
from mediaquery.operators import intervals as iv
from mediaquery.operators import joins, reports

C = F.col
SEC = lambda e: f"(({e}) // 1000 || '.' || lpad((({e}) % 1000)::VARCHAR, 3, '0'))"


@query("attach_event_weight", "C01", with_views("cand", more={
    "w": "SELECT event_type AS event, round(avg(value) / 100, 4) AS weight FROM events WHERE event_type <> 'error' GROUP BY 1"}, body="""
SELECT candidate_id, coalesce(weight, payoff) AS category_event_value FROM cand LEFT JOIN w USING (event)"""))
def _(s, sf):
    w = table(s, sf, "events").where("event_type <> 'error'").groupBy(C("event_type").alias("event")).agg(F.round(F.avg("value") / 100, 4).alias("weight"))
    c = views.cand(s, sf).select("candidate_id", "event", C("payoff").alias("category_event_value"))
    return joins.attach_event_weight(c, w).select("candidate_id", "category_event_value")


@query("map_category", "C02", """SELECT c_custkey, coalesce(m.category, 'NATION_' || c_nationkey) AS category FROM customer LEFT JOIN (
  SELECT n_name, r_name AS category FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA') m ON m.n_name = 'NATION_' || c_nationkey""")
def _(s, sf):
    mapping = table(s, sf, "nation").join(table(s, sf, "region").where("r_name <> 'ASIA'"), C("r_regionkey") == C("n_regionkey"))
    mapping = mapping.select(C("n_name").alias("source_category"), C("r_name").alias("category"))
    rows = table(s, sf, "customer").selectExpr("c_custkey", "concat('NATION_', c_nationkey) source_category")
    return joins.map_category(rows, mapping).select("c_custkey", "category")


@query("candidate_history", "C03", with_views("registry", "usage", body="""
SELECT candidate_id, category, selected_count, exported_count, EXISTS (SELECT 1 FROM usage u WHERE u.candidate_id = r.candidate_id AND u.state = 'reserved') AS reserved
FROM registry r WHERE status IN ('eligible', 'used')"""))
def _(s, sf):
    return joins.candidate_history(views.registry(s, sf), views.usage(s, sf)).select(
        "candidate_id", "category", "selected_count", "exported_count", "reserved")


@query("exclude_reserved", "C04", with_views("usage", body="""SELECT p_partkey AS candidate_id FROM part
WHERE p_partkey NOT IN (SELECT 2 * candidate_id FROM usage WHERE state = 'reserved')"""))
def _(s, sf):
    ledger = views.usage(s, sf).withColumn("candidate_id", 2 * C("candidate_id"))
    return joins.exclude_reserved(views.registry(s, sf), ledger).select("candidate_id")


@query("missing_media", "C05", with_views("material", body="""SELECT path FROM material WHERE enabled AND video_id NOT IN
 (SELECT 2 * user_id FROM events WHERE event_type = 'purchase')"""))
def _(s, sf):
    m = views.material(s, sf)
    found = table(s, sf, "events").where("event_type = 'purchase'").select((2 * C("user_id")).alias("video_id"))
    listing = m.join(found, "video_id", "left_semi").select("path")
    return joins.missing_media(m, listing).select("path")


@query("resolve_timeline", "C06", with_views("timeline", "registry", body="""
SELECT clip_id, CASE WHEN trim_end_ms - trim_start_ms < dur_ms THEN greatest(0, trim_end_ms - dur_ms) ELSE trim_start_ms END AS source_in_ms,
  CASE WHEN trim_end_ms - trim_start_ms < dur_ms THEN greatest(0, trim_end_ms - dur_ms) ELSE trim_start_ms END + dur_ms AS source_out_ms
FROM timeline LEFT JOIN registry USING (candidate_id)"""))
def _(s, sf):
    trims = views.registry(s, sf).select("candidate_id", "trim_start_ms", "trim_end_ms")
    return joins.resolve_timeline(views.timeline(s, sf), trims).select("clip_id", "source_in_ms", "source_out_ms")


SOURCE = "CASE flag WHEN 'A' THEN CASE WHEN video_id % 2 = 0 THEN 'product_openpage' ELSE 'endcard' END WHEN 'R' THEN 'product_recording' ELSE 'ugc' END"


@query("resolve_assets", "C07", with_views("timeline", more={"t": f"SELECT clip_id, {SOURCE} AS st, 'as' || video_id AS asset_id FROM timeline"}, body="""
SELECT clip_id, CASE st WHEN 'product_openpage' THEN 'fixed_openpage' WHEN 'product_recording' THEN 'fixed_screenshot' ELSE 'fixed_tail_sticker' END AS clip_type,
 s_name AS asset_path, CASE WHEN s_name IS NULL THEN 'asset is not registered: ' || asset_id END AS error
FROM t LEFT JOIN supplier ON asset_id = 'as' || s_suppkey AND s_acctbal > 0 WHERE st <> 'ugc'"""))
def _(s, sf):
    t = views.timeline(s, sf).select("clip_id", F.expr(SOURCE).alias("source_type"), F.concat(F.lit("as"), C("video_id").cast("string")).alias("asset_id"))
    assets = table(s, sf, "supplier").where("s_acctbal > 0").selectExpr("concat('as', s_suppkey) asset_id", "s_name path")
    return joins.resolve_assets(t, assets).select("clip_id", "clip_type", "asset_path", "error")


@query("unregistered_assets", "C08", """WITH r AS (SELECT o_orderkey AS campaign_id, unnest(['open', 'rec', 'logo']) AS reference,
  unnest(['as' || o_custkey % 130, 'as' || o_custkey % 97, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'as' || (o_custkey + 60) % 140 END]) AS asset_id FROM orders)
SELECT * FROM r WHERE asset_id <> '' AND asset_id NOT IN (SELECT 'as' || s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def _(s, sf):
    campaigns = table(s, sf, "orders").selectExpr("o_orderkey campaign_id", "concat('as', o_custkey % 130) open", "concat('as', o_custkey % 97) rec",
                                                  "if(o_custkey % 5 = 0, '', concat('as', (o_custkey + 60) % 140)) logo")
    assets = table(s, sf, "supplier").where("s_acctbal > 0").selectExpr("concat('as', s_suppkey) asset_id")
    return joins.unregistered_assets(campaigns, ["open", "rec", "logo"], assets)


@query("overlap_pairs", "C09", with_views("cand", body="""
SELECT a.video_id, a.candidate_id AS left_id, b.candidate_id AS right_id, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS shared_ms,
  greatest(1, least(a.end_ms - a.start_ms, b.end_ms - b.start_ms)) AS shorter_ms FROM cand a JOIN cand b ON a.video_id = b.video_id AND a.candidate_id < b.candidate_id
WHERE least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 0.75 * greatest(1, least(a.end_ms - a.start_ms, b.end_ms - b.start_ms))"""))
def _(s, sf):
    return iv.overlap_pairs(views.cand(s, sf))


RANGES = {"mute": "SELECT creative_id, start_ms + 100 AS start_ms, end_ms - 100 AS end_ms FROM timeline WHERE flag = 'R'",
          "duck": "SELECT creative_id, start_ms, end_ms - 250 AS end_ms FROM timeline WHERE flag = 'A'"}


def ranges(clips, flag, head, tail):
    t = clips.where(C("flag") == flag)
    return t.select("creative_id", (C("start_ms") + head).alias("start_ms"), (C("end_ms") - tail).alias("end_ms"))


@query("intervals_at_point", "C10", with_views("timeline", more=RANGES, body="""
SELECT clip_id, EXISTS (SELECT 1 FROM mute m WHERE m.creative_id = t.creative_id AND 2 * m.start_ms <= t.start_ms + t.end_ms AND t.start_ms + t.end_ms < 2 * m.end_ms) AS muted
FROM timeline t"""))
def _(s, sf):
    clips = views.staged(views.timeline(s, sf))
    points = clips.select("creative_id", "clip_id", (C("start_ms") + C("end_ms")).alias("at"))
    mute = ranges(clips, "R", 100, 100).select("creative_id", (C("start_ms") * 2).alias("start"), (C("end_ms") * 2).alias("end"))
    return iv.intervals_at_point(points, mute, "muted").select("clip_id", "muted")


@query("cycle_assign", "C15", """SELECT o_orderkey AS creative_id, n_name AS title FROM orders JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS o, count(*) OVER () AS n FROM nation)
 ON o = o_orderkey % n + 1""")
def _(s, sf):
    titles = table(s, sf, "nation").select("n_name", (C("n_nationkey") + 1).alias("ordinal"))
    creatives = table(s, sf, "orders").select(C("o_orderkey").alias("creative_id"), (C("o_orderkey") + 1).alias("creative_index"))
    return joins.cycle_assign(creatives, titles).select("creative_id", C("n_name").alias("title"))


@query("cache_lookup", "C16", """SELECT o_orderkey AS request_id, c_custkey IS NOT NULL AS hit, c_mktsegment AS payload,
 CASE WHEN c_custkey IS NULL THEN 'analysis cache miss while --cache-only is enabled' END AS error FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 2000""")
def _(s, sf):
    cache = table(s, sf, "customer").where("c_acctbal > 2000").selectExpr("concat('k', c_custkey) cache_key", "c_mktsegment payload", "cast(null as timestamp) last_accessed_at")
    requests = table(s, sf, "orders").selectExpr("o_orderkey request_id", "concat('k', o_custkey) cache_key")
    return joins.cache_lookup(requests, cache, cache_only=True).select("request_id", "hit", C("cached.payload").alias("payload"), "error")


@query("cache_touch", "C16", """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 99 ELSE 1 END::BIGINT AS last_accessed_at FROM customer""")
def _(s, sf):
    cache = table(s, sf, "customer").selectExpr("c_custkey", "concat('k', c_custkey) cache_key", "1L last_accessed_at")
    requests = table(s, sf, "orders").where("o_orderstatus = 'F'").selectExpr("concat('k', o_custkey) cache_key")
    hits = joins.cache_lookup(requests, cache)
    return joins.touch_cache(cache, hits, F.lit(99).cast("long")).select("c_custkey", "last_accessed_at")


@query("bgm_source_lookup", "C17", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) p
 ON p_partkey = l_partkey AND p_size = l_quantity""")
def _(s, sf):
    req = table(s, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_partkey source_video_id",
                                              "cast(l_quantity as bigint) source_fingerprint", "'v1' configuration_fingerprint")
    assets = table(s, sf, "part").where("p_size > 20").selectExpr("p_partkey source_video_id", "cast(p_size as bigint) source_fingerprint", "'v1' configuration_fingerprint", "p_name")
    return joins.bgm_source_lookup(req, assets).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name")


BRAND = """SELECT 'as' || s_suppkey AS asset_id, CASE WHEN s_suppkey % 3 = 0 THEN 'logo_overlay' WHEN s_suppkey % 3 = 1 THEN 'logo_overlay_video' ELSE 'font' END AS type,
 '/brand/' || s_suppkey % 20 || '.png' AS path, 'c' || s_nationkey AS color_variant, s_suppkey AS ordinal FROM supplier"""


@query("paired_logo", "C18", f"""WITH b AS ({BRAND}),
r AS (SELECT o_orderkey AS creative_id, 'as' || o_custkey % 110 AS logo_id, '/x/y/' || o_custkey % 25 || '.png' AS logo_path FROM orders),
st AS (SELECT creative_id, arg_min(b.asset_id, ordinal) AS static_id, arg_min(b.color_variant, ordinal) AS color_variant FROM r
  JOIN b ON b.type = 'logo_overlay' AND (b.asset_id = r.logo_id OR regexp_extract(b.path, '[^/]*$') = regexp_extract(r.logo_path, '[^/]*$')) GROUP BY 1),
mv AS (SELECT color_variant, arg_min(asset_id, ordinal) AS animated_id FROM b WHERE type = 'logo_overlay_video' GROUP BY 1)
SELECT creative_id, static_id, animated_id FROM r LEFT JOIN st USING (creative_id) LEFT JOIN mv USING (color_variant)""")
def _(s, sf):
    brand = table(s, sf, "supplier").selectExpr(
        "concat('as', s_suppkey) asset_id", "case s_suppkey % 3 when 0 then 'logo_overlay' when 1 then 'logo_overlay_video' else 'font' end type",
        "concat('/brand/', s_suppkey % 20, '.png') path", "concat('c', s_nationkey) color_variant", "s_suppkey ordinal")
    req = table(s, sf, "orders").selectExpr("o_orderkey creative_id", "concat('as', o_custkey % 110) logo_id", "concat('/x/y/', o_custkey % 25, '.png') logo_path")
    return joins.paired_logo(req, brand).select("creative_id", "static_id", "animated_id")


@query("segment_windows", "E09", with_views("material", more={"m": "SELECT video_id, dur_ms * 3 AS d FROM material"}, body="""
SELECT video_id, i + 1 AS segment_index, i * 110000 AS start_ms, CASE WHEN d <= 120000 THEN d ELSE least(d, i * 110000 + 115000) END AS end_ms
FROM (SELECT video_id, d, unnest(range(0, CASE WHEN d <= 120000 THEN 1 ELSE ceil((d - 115000) / 110000)::BIGINT + 1 END)) AS i FROM m)"""))
def _(s, sf):
    m = views.material(s, sf).select("video_id", (C("dur_ms") * 3).alias("dur_ms"))
    return iv.segment_windows(m).select("video_id", C("segment_index").cast("long").alias("segment_index"), "start_ms", "end_ms")


@query("rebase_times", "E10", with_views("recall", body="""SELECT recall_id, start_ms + recall_id % 5 * 110000 AS start_ms, end_ms + recall_id % 5 * 110000 AS end_ms FROM recall"""))
def _(s, sf):
    r = views.recall(s, sf).withColumn("segment_start_ms", C("recall_id") % 5 * 110000)
    return iv.rebase_times(r, "segment_start_ms", ["start_ms", "end_ms"]).select("recall_id", "start_ms", "end_ms")


@query("rebase_reviews", "E10", with_views("cand", more={"r": """SELECT candidate_id, start_ms AS ws, 8000 AS clip, candidate_id % 9000 - 500 AS a, candidate_id % 9000 + 1500 AS b,
  CASE WHEN candidate_id % 3 > 0 THEN candidate_id % 10000 END AS p FROM cand""",
    "x": "SELECT *, greatest(0, least(clip, a)) AS s1 FROM r", "y": "SELECT *, greatest(s1, least(clip, b)) AS e1 FROM x"}, body="""
SELECT candidate_id, ws + s1 AS start_ms, ws + e1 AS end_ms, ws + greatest(s1, least(e1, coalesce(p, round_even((s1 + e1) / 2, 0)::BIGINT))) AS peak_ms FROM y"""))
def _(s, sf):
    c = views.cand(s, sf).selectExpr("candidate_id", "start_ms window_start_ms", "start_ms + 8000 window_end_ms", "candidate_id % 9000 - 500 start_ms",
                                     "candidate_id % 9000 + 1500 end_ms", "if(candidate_id % 3 > 0, candidate_id % 10000, null) peak_ms")
    return iv.rebase_reviews(c).select("candidate_id", "start_ms", "end_ms", "peak_ms")


BEATS = {"beats": "SELECT candidate_id AS track_id, start_ms AS beat_ms, 3000 + candidate_id * 7 % 9000 AS dur_ms FROM timeline",
         "looped": """SELECT DISTINCT track_id, beat_ms + unnest(range(0, ceil(17500 / dur_ms)::BIGINT)) * dur_ms AS beat_ms FROM beats WHERE beat_ms < dur_ms""",
         "lb": "SELECT * FROM looped WHERE beat_ms <= 17500"}


def beats(s, sf):
    return views.timeline(s, sf).selectExpr("candidate_id track_id", "start_ms beat_ms", "3000 + candidate_id * 7 % 9000 dur_ms")


@query("loop_beats", "E12", with_views("timeline", more=BEATS, body="SELECT * FROM lb"))
def _(s, sf):
    return iv.loop_beats(beats(s, sf), 17_500)


@query("build_slots", "E13", with_views("timeline", recursive=True, more={**BEATS,
    "pt": "SELECT track_id, beat_ms AS p FROM lb WHERE beat_ms > 0 AND beat_ms < 7200 UNION SELECT track_id, 7200 FROM lb",
    "walk": """SELECT track_id, 0::BIGINT AS i, 0::BIGINT AS s, 0::BIGINT AS e FROM (SELECT DISTINCT track_id FROM pt) UNION ALL
   SELECT w.track_id, any_value(w.i) + 1, any_value(w.e), min(p)::BIGINT FROM walk w JOIN pt ON pt.track_id = w.track_id AND p >= w.e + 1050 GROUP BY w.track_id""",
    "last": "SELECT track_id, max(i) AS n, max(e) AS cur FROM walk GROUP BY 1"}, body="""
SELECT track_id, i AS slot_index, s AS start_ms, CASE WHEN i = n AND cur < 7200 AND 7200 - cur < 600 THEN 7200 ELSE e END AS end_ms FROM walk JOIN last USING (track_id) WHERE i > 0
UNION ALL SELECT track_id, n + 1, cur, 7200 FROM last WHERE 7200 - cur >= 600"""))
def _(s, sf):
    looped = iv.loop_beats(beats(s, sf), 17_500)
    return iv.build_slots(looped, 0, 7_200, keys=looped).select("track_id", C("slot_index").cast("long").alias("slot_index"), "start_ms", "end_ms")


@query("timeline_errors", "E14", with_views("timeline", more={"n": """SELECT *, row_number() OVER o AS rk, lead(start_ms) OVER o AS ns, lead(clip_id) OVER o AS nid FROM timeline
  WINDOW o AS (PARTITION BY creative_id ORDER BY start_ms, pos)"""}, body=f"""
SELECT creative_id, clip_id, 'timeline starts with gap: 0/' || {SEC('start_ms')} AS error FROM n WHERE rk = 1 AND start_ms > 1
UNION ALL SELECT creative_id, clip_id, 'overlap: ' || clip_id || '/' || nid FROM n WHERE ns < end_ms - 1
UNION ALL SELECT creative_id, clip_id, 'gap: ' || clip_id || '/' || nid || ' ' || {SEC('end_ms')} || '-' || {SEC('ns')} FROM n WHERE ns > end_ms + 1
UNION ALL SELECT creative_id, clip_id, 'timeline exceeds campaign duration' FROM n WHERE nid IS NULL AND end_ms > 20100
UNION ALL SELECT creative_id, clip_id, 'timeline ends with gap: ' || {SEC('end_ms')} || '/20.000' FROM n WHERE nid IS NULL AND end_ms < 19999"""))
def _(s, sf):
    return iv.timeline_errors(views.timeline(s, sf), 20_000)


VERDICT_VIEWS = {"n": """SELECT *, row_number() OVER o AS rk, lead(start_ms) OVER o AS ns, lead(clip_id) OVER o AS nid FROM picks WINDOW o AS (PARTITION BY creative_id ORDER BY start_ms, pos)""",
    "picks": "SELECT t.* FROM timeline t JOIN orders ON o_orderkey = creative_id WHERE o_orderkey % 10 <> 3 AND pos <= 1 + o_orderkey % 6",
    "planned": "SELECT o_orderkey AS creative_id, (1 + o_orderkey % 4)::INTEGER AS slot_count, o_orderstatus = 'P' AS bare, o_orderpriority = '5-LOW' AND o_orderstatus <> 'P' AS late FROM orders",
    "facts": "SELECT p.*, coalesce(k, 0) AS picked, coalesce(s, 0) AS source_count FROM planned p LEFT JOIN (SELECT creative_id, count(*) AS k, count(DISTINCT video_id) AS s FROM picks GROUP BY 1) USING (creative_id)"}
VERDICT_VIEWS = {k: VERDICT_VIEWS[k] for k in ("picks", "n", "planned", "facts")}
VERDICT_ERRORS = f"""SELECT creative_id, 'timeline starts with gap: 0/' || {SEC('start_ms')} AS error FROM n WHERE rk = 1 AND start_ms > 1
UNION ALL SELECT creative_id, 'overlap: ' || clip_id || '/' || nid FROM n WHERE ns < end_ms - 1
UNION ALL SELECT creative_id, 'gap: ' || clip_id || '/' || nid || ' ' || {SEC('end_ms')} || '-' || {SEC('ns')} FROM n WHERE ns > end_ms + 1
UNION ALL SELECT creative_id, 'timeline exceeds campaign duration' FROM n WHERE nid IS NULL AND end_ms > 4100
UNION ALL SELECT creative_id, 'timeline ends with gap: ' || {SEC('end_ms')} || '/4.000' FROM n WHERE nid IS NULL AND end_ms < 3999
UNION ALL SELECT creative_id, 'missing product_recording' FROM planned WHERE bare
UNION ALL SELECT creative_id, 'product openpage must immediately precede product recording' FROM planned WHERE late
UNION ALL SELECT creative_id, 'insufficient unique candidates: ' || picked || '/' || slot_count FROM facts WHERE picked < slot_count
UNION ALL SELECT creative_id, 'insufficient distinct source videos: ' || source_count || '/2' FROM facts WHERE source_count <> 2"""


def composition(s, sf):
    """Planned creatives with slots, their picks (none for some), and all errors."""
    orders = table(s, sf, "orders")
    planned = orders.selectExpr("o_orderkey creative_id", "cast(1 + o_orderkey % 4 as int) slot_count")
    picks = views.staged(views.timeline(s, sf).where("creative_id % 10 <> 3 and pos <= 1 + creative_id % 6"))
    rows = iv.fixed_package_rows(campaigns(s, sf)).join(orders.select(C("o_orderkey").alias("campaign_id"), "o_orderstatus", "o_orderpriority"), "campaign_id")
    rows = rows.where("not (o_orderstatus = 'P' and source_type = 'product_recording')").withColumn(
        "start_ms", F.expr("start_ms + if(o_orderpriority = '5-LOW' and source_type = 'product_recording', 40, 0)"))
    package = iv.package_errors(rows).withColumnRenamed("campaign_id", "creative_id")
    return planned, picks, reports.composition_errors(planned, picks, iv.timeline_errors(picks, 4_000), package, 2)


@query("composition_errors", "E14 E25 G01", with_views("timeline", more=VERDICT_VIEWS, body=VERDICT_ERRORS))
def _(s, sf):
    return composition(s, sf)[2]


@query("composition_verdicts", "E14 E25 G01", with_views("timeline", more={**VERDICT_VIEWS, "e": f"SELECT creative_id, count(*) AS c FROM ({VERDICT_ERRORS}) GROUP BY 1"}, body="""
SELECT creative_id, slot_count, picked, source_count, coalesce(c, 0) AS error_count, coalesce(c, 0) = 0 AS passed, picked < slot_count AS partial FROM facts LEFT JOIN e USING (creative_id)"""))
def _(s, sf):
    return reports.composition_verdicts(*composition(s, sf))


@query("repair_gaps", "E15", with_views("timeline", more={
    "n": """SELECT *, CASE flag WHEN 'N' THEN 'fixed_screenshot' ELSE 'highlight' END AS clip_type, candidate_id * 7 % 3000 AS si, lead(start_ms) OVER o AS next_ms, lead(clip_id) OVER o AS next_clip
  FROM timeline WINDOW o AS (PARTITION BY creative_id ORDER BY start_ms, pos)""",
    "g": "SELECT n.*, next_ms - end_ms AS gap_ms, dur_ms + next_ms - end_ms AS nd, coalesce((floor(s_acctbal)::BIGINT + 1000), 0) AS media FROM n LEFT JOIN supplier ON s_suppkey = video_id WHERE next_ms - end_ms > 1",
    "f": "SELECT *, CASE WHEN si + nd > media + 1 THEN greatest(0, media - nd) ELSE si END AS s2 FROM g"}, body=f"""
SELECT clip_id, next_clip, gap_ms, nd AS new_dur_ms, s2 AS source_in_ms, CASE WHEN clip_type <> 'highlight' OR gap_ms > 75 THEN
  'unrepairable main-track gap ' || {SEC('gap_ms')} || 's between ' || clip_id || ' and ' || next_clip
  WHEN s2 + nd > media + 1 THEN 'source too short to repair ' || clip_id || ': need ' || {SEC('nd')} || 's, media has ' || {SEC('media')} || 's' END AS error FROM f"""))
def _(s, sf):
    t = views.timeline(s, sf).selectExpr("*", "if(flag = 'N', 'fixed_screenshot', 'highlight') clip_type", "candidate_id * 7 % 3000 source_in_ms")
    media = table(s, sf, "supplier").selectExpr("s_suppkey video_id", "cast(floor(s_acctbal) as bigint) + 1000 media_ms")
    return iv.repair_gaps(t, media, 75).select("clip_id", "next_clip", "gap_ms", "new_dur_ms", "source_in_ms", "error")


ISLANDS = """SELECT creative_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY creative_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN start_ms <= 1 + max(end_ms) OVER (PARTITION BY creative_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r)) GROUP BY creative_id, g"""


@query("coalesce_intervals", "E16", with_views("timeline", more={
    "r": "SELECT creative_id, least(start_ms, 19960) AS start_ms, greatest(least(start_ms, 19960), least(end_ms, 19960)) AS end_ms FROM timeline WHERE flag <> 'N' AND greatest(least(start_ms, 19960), least(end_ms, 19960)) > least(start_ms, 19960)",
}, body=ISLANDS))
def _(s, sf):
    r = views.timeline(s, sf).where("flag <> 'N'").select("creative_id", "start_ms", "end_ms", F.lit(19_960).alias("limit_ms"))
    return iv.coalesce_intervals(r).select("creative_id", "start_ms", "end_ms")


@query("slice_at_boundaries", "E17", with_views("timeline", more={**RANGES,
    "bed": "SELECT creative_id, least(20000, max(end_ms)) - 40 AS lim, 3000 + creative_id % 17 * 500 AS lp FROM timeline GROUP BY creative_id",
    "r": "SELECT creative_id, least(start_ms, lim) AS start_ms, least(end_ms, lim) AS end_ms FROM mute JOIN bed USING (creative_id) WHERE least(end_ms, lim) > least(start_ms, lim)",
    "mm": ISLANDS,
    "p": """SELECT creative_id, unnest(range(0, greatest(1, ceil((lim - 1) / lp)::BIGINT))) * lp AS t FROM bed UNION SELECT creative_id, lim FROM bed
      UNION SELECT creative_id, unnest([start_ms, end_ms]) FROM mm UNION SELECT creative_id, unnest([least(start_ms, lim), greatest(0, least(end_ms, lim))]) FROM duck JOIN bed USING (creative_id) WHERE end_ms > start_ms""",
    "q": "SELECT creative_id, t AS a, lead(t) OVER (PARTITION BY creative_id ORDER BY t) AS b FROM p"}, body="""
SELECT creative_id, a AS start_ms, b AS end_ms, EXISTS (SELECT 1 FROM duck d WHERE d.creative_id = q.creative_id AND 2 * d.start_ms <= a + b AND a + b < 2 * d.end_ms) AS ducked, a % lp AS source_ms
FROM q JOIN bed USING (creative_id) WHERE b - a > 10 AND NOT EXISTS (SELECT 1 FROM mm m WHERE m.creative_id = q.creative_id AND 2 * m.start_ms <= a + b AND a + b < 2 * m.end_ms)"""))
def _(s, sf):
    clips = views.staged(views.timeline(s, sf))
    beds = clips.groupBy("creative_id").agg((F.least(F.lit(20_000), F.max("end_ms")) - 40).alias("limit_ms")).withColumn(
        "loop_ms", 3000 + C("creative_id") % 17 * 500)
    return iv.slice_at_boundaries(beds, ranges(clips, "R", 100, 100), ranges(clips, "A", 0, 250))


KIND = "CASE flag WHEN 'A' THEN 'fixed_openpage' WHEN 'N' THEN 'fixed_screenshot' ELSE 'fixed_tail_sticker' END"


@query("voiceover_ranges", "E18", with_views("timeline", more={
    "t": f"SELECT creative_id, pos, start_ms, CASE WHEN pos % 2 = 0 THEN 'highlight' ELSE {KIND} END AS k FROM timeline",
    "l": "SELECT creative_id, pos AS line, dur_ms - 400 AS audio_ms FROM timeline WHERE dur_ms > 400",
    "an": """SELECT creative_id, coalesce(arg_min(start_ms, pos) FILTER (k = 'fixed_openpage'), arg_min(start_ms, pos) FILTER (k = 'fixed_screenshot')) AS pr,
      coalesce(arg_min(start_ms, pos) FILTER (k = 'fixed_tail_sticker'), 20000) AS tail FROM t GROUP BY 1""",
    "x": """SELECT creative_id, line, audio_ms, coalesce(sum(audio_ms + 100) OVER (PARTITION BY creative_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
      (sum(audio_ms) OVER (PARTITION BY creative_id) + 100 * (count(*) OVER (PARTITION BY creative_id) - 1))::BIGINT AS total FROM l""",
    "y": "SELECT creative_id, line, coalesce(pr, greatest(0, tail - total)) + off AS start_ms, tail, audio_ms FROM x JOIN an USING (creative_id)"}, body="""
SELECT creative_id, line, start_ms, least(tail, start_ms + audio_ms) AS end_ms FROM y WHERE least(tail, start_ms + audio_ms) > start_ms"""))
def _(s, sf):
    t = views.staged(views.timeline(s, sf))
    clips = t.select("creative_id", "pos", "start_ms", F.expr(f"case when pos % 2 = 0 then 'highlight' else {KIND} end").alias("clip_type"))
    lines = t.select("creative_id", C("pos").alias("line"), (C("dur_ms") - 400).alias("audio_ms"))
    return iv.voiceover_ranges(lines, clips, 20_000).select("creative_id", "line", "start_ms", "end_ms")


@query("sample_timestamps", "E23", with_views("cand", more={"c": "SELECT candidate_id, start_ms, CASE WHEN candidate_id % 50 = 0 THEN start_ms ELSE end_ms END AS e FROM cand"}, body="""
SELECT candidate_id, i AS sample, round(start_ms + (e - start_ms) * (i + 1) / 4, 3) AS at_ms FROM (SELECT *, unnest([0, 1, 2]) AS i FROM c WHERE e > start_ms)
UNION ALL SELECT candidate_id, 0, CASE WHEN candidate_id % 3 = 0 THEN start_ms + 7 ELSE start_ms END::DOUBLE FROM c WHERE e <= start_ms"""))
def _(s, sf):
    c = views.cand(s, sf).selectExpr("candidate_id", "start_ms", "if(candidate_id % 50 = 0, start_ms, end_ms) end_ms", "if(candidate_id % 3 = 0, start_ms + 7, 0L) peak_ms")
    return iv.sample_timestamps(c, 3).select("candidate_id", "sample", F.round("at_ms", 3).alias("at_ms"))


@query("fixed_package_rows", "E25", """SELECT o_orderkey AS campaign_id, u.clip_id, u.source_type, u.start_ms, u.end_ms, 'as' || (o_custkey + u.k) AS asset_id FROM (SELECT o_orderkey, o_custkey, unnest([
 {'clip_id': 'pkg_openpage', 'source_type': 'product_openpage', 'start_ms': 7200::BIGINT, 'end_ms': 8700::BIGINT, 'k': 0},
 {'clip_id': 'pkg_recording', 'source_type': 'product_recording', 'start_ms': 8700::BIGINT, 'end_ms': 12800::BIGINT, 'k': 1},
 {'clip_id': 'pkg_endcard', 'source_type': 'endcard', 'start_ms': 17500::BIGINT, 'end_ms': 20000::BIGINT, 'k': 2}]) AS u FROM orders)""")
def _(s, sf):
    return iv.fixed_package_rows(campaigns(s, sf))


def campaigns(s, sf):
    return table(s, sf, "orders").selectExpr("o_orderkey campaign_id", "concat('as', o_custkey) product_openpage_asset_id",
                                             "concat('as', o_custkey + 1) product_recording_asset_id", "concat('as', o_custkey + 2) endcard_asset_id")


@query("package_errors", "E25", """SELECT o_orderkey AS campaign_id, concat_ws('; ', CASE WHEN o_orderstatus = 'P' THEN 'missing product_recording' END,
 CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'P' THEN 'product openpage must immediately precede product recording' END) AS errors FROM orders""")
def _(s, sf):
    rows = iv.fixed_package_rows(campaigns(s, sf)).join(table(s, sf, "orders").select(C("o_orderkey").alias("campaign_id"), "o_orderstatus", "o_orderpriority"), "campaign_id")
    rows = rows.where("not (o_orderstatus = 'P' and source_type = 'product_recording')").withColumn(
        "start_ms", F.expr("start_ms + if(o_orderpriority = '5-LOW' and source_type = 'product_recording', 40, 0)"))
    return iv.package_errors(rows).select("campaign_id", F.array_join("errors", "; ").alias("errors"))


@query("compose_timeline", "G01", with_views("timeline", body="""SELECT creative_id, clip_id, start_ms, end_ms FROM timeline UNION ALL
SELECT o_orderkey, u.c, u.s, u.e FROM (SELECT o_orderkey, unnest([{'c': 'pkg_openpage', 's': 7200, 'e': 8700}, {'c': 'pkg_recording', 's': 8700, 'e': 12800}, {'c': 'pkg_endcard', 's': 17500, 'e': 20000}]) AS u FROM orders)"""))
def _(s, sf):
    package = iv.fixed_package_rows(campaigns(s, sf)).withColumnRenamed("campaign_id", "creative_id")
    return iv.compose_timeline(views.timeline(s, sf), package).select("creative_id", "clip_id", "start_ms", "end_ms")
