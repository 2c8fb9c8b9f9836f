"""Registry, ranking, report and set operators (survey 2.3, 2.4, 2.5, 2.6, 2.7)."""

from pyspark.sql import functions as F

from contract import views
from contract.base import query
from contract.views import table, with_views
from mediaquery.functions import text
from mediaquery.operators import ledger, ranking, reports

C = F.col


# ---- registry upserts -------------------------------------------------------------------------------

def registry_table(s, sf):
    return table(s, sf, "part").selectExpr(
        "p_partkey candidate_id", "p_brand category", "p_type event", "p_size * 10L start_ms", "1L analysis_count", "'eligible' status",
        "p_partkey % 3 selected_count", "p_partkey % 2 exported_count", "cast(null as bigint) peak_ms", "cast(null as bigint) last_run_id",
        "cast(null as bigint) last_creative_id")


def candidate_batch(s, sf):
    return table(s, sf, "events").selectExpr(
        "user_id * 17 candidate_id", "concat('u', user_id) category", "event_type event", "event_id start_ms", "event_id * 3 peak_ms", "event_id seq")


@query("registry_upsert", "D14", """WITH b AS (SELECT user_id * 17 AS id, count(*) AS n, arg_min(event_id, event_id) AS s0, arg_max(event_type, event_id) AS ev, max(event_id) * 3 AS pk,
  'u' || any_value(user_id) AS cat FROM events GROUP BY 1)
SELECT coalesce(p_partkey, id) AS candidate_id, coalesce(p_brand, cat) AS category, coalesce(ev, p_type) AS event, coalesce(p_size * 10, s0) AS start_ms, pk AS peak_ms,
 (CASE WHEN p_partkey IS NULL THEN n ELSE 1 + coalesce(n, 0) END)::BIGINT AS analysis_count, 'eligible' AS status, coalesce(p_partkey % 3, 0) AS selected_count FROM part FULL JOIN b ON id = p_partkey""")
def _(s, sf):
    return ledger.register_candidates(registry_table(s, sf), candidate_batch(s, sf)).select(
        "candidate_id", "category", "event", "start_ms", "peak_ms", "analysis_count", "status", "selected_count")


SEQ = "SELECT l_partkey AS candidate_id, l_orderkey AS creative_id, o_custkey AS run_id, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS seq, o_orderstatus AS st, o_totalprice AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def assignments(s, sf):
    return table(s, sf, "lineitem").join(table(s, sf, "orders"), C("o_orderkey") == C("l_orderkey")).selectExpr(
        "l_partkey candidate_id", "l_orderkey creative_id", "o_custkey run_id", "l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 seq", "o_orderstatus st", "o_totalprice price")


def held(s, sf):
    return assignments(s, sf).where("st = 'F'").select("candidate_id", "run_id", "creative_id").distinct().withColumn("state", F.lit("committed"))


@query("reserve_registry", "D15", f"""WITH a AS ({SEQ}), fresh AS (SELECT candidate_id, run_id, creative_id, min(seq) AS seq FROM a GROUP BY ALL HAVING bool_and(st <> 'F')),
n AS (SELECT candidate_id, count(*) AS n, arg_max(run_id, seq * 100000 + creative_id) AS r FROM fresh GROUP BY 1)
SELECT p_partkey AS candidate_id, p_partkey % 3 + coalesce(n, 0) AS selected_count, r IS NOT NULL AS touched FROM part LEFT JOIN n ON candidate_id = p_partkey""")
def _(s, sf):
    reg, _ = ledger.reserve(registry_table(s, sf), held(s, sf), assignments(s, sf))
    return reg.select("candidate_id", "selected_count", C("last_run_id").isNotNull().alias("touched"))


@query("reserve_ledger", "D15", f"""WITH a AS ({SEQ}) SELECT DISTINCT candidate_id, run_id, creative_id, CASE st WHEN 'F' THEN 'committed' ELSE 'reserved' END AS state FROM a""")
def _(s, sf):
    return ledger.reserve(registry_table(s, sf), held(s, sf), assignments(s, sf))[1].select("candidate_id", "run_id", "creative_id", "state")


DECIDED = """SELECT u.*, CASE WHEN u.state <> 'reserved' THEN NULL WHEN o_totalprice > 200000 THEN 'committed' WHEN o_orderpriority = '5-LOW' THEN 'released'
  WHEN c_mktsegment = 'BUILDING' THEN 'committed' END AS d FROM usage u JOIN orders ON o_orderkey = creative_id LEFT JOIN customer ON c_custkey = u.run_id"""


def decisions(s, sf):
    single = table(s, sf, "orders").where("o_totalprice > 200000 or o_orderpriority = '5-LOW'").selectExpr(
        "o_custkey run_id", "o_orderkey creative_id", "if(o_totalprice > 200000, 'committed', 'released') decision")
    whole = table(s, sf, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey run_id", "cast(null as bigint) creative_id", "'committed' decision")
    return single.unionByName(whole)


@query("finalize_registry", "D16", with_views("usage", more={"d": DECIDED, "n": "SELECT candidate_id, count(*) AS n FROM d WHERE d = 'committed' GROUP BY 1"}, body="""
SELECT p_partkey AS candidate_id, p_partkey % 2 + coalesce(n, 0) AS exported_count, CASE WHEN n IS NULL THEN 'eligible' ELSE 'used' END AS status FROM part LEFT JOIN n ON candidate_id = p_partkey"""))
def _(s, sf):
    return ledger.finalize(registry_table(s, sf), views.usage(s, sf), decisions(s, sf))[0].select("candidate_id", "exported_count", "status")


@query("finalize_ledger", "D16", with_views("usage", more={"d": DECIDED}, body="SELECT candidate_id, run_id, creative_id, coalesce(d, state) AS state FROM d"))
def _(s, sf):
    return ledger.finalize(registry_table(s, sf), views.usage(s, sf), decisions(s, sf))[1].select("candidate_id", "run_id", "creative_id", "state")


@query("usage_by_creative", "D13", with_views("usage", body="""SELECT run_id, creative_id, candidate_id, row_number() OVER (PARTITION BY run_id, creative_id ORDER BY candidate_id) AS position
FROM usage WHERE state IN ('reserved', 'committed')"""))
def _(s, sf):
    return ledger.usage_by_creative(views.usage(s, sf))


@query("bgm_upsert", "D17", with_views("bgm", more={"b": "SELECT l_partkey + 500 AS id, arg_max(l_discount, q) AS score, arg_max(l_tax, q) AS risk, arg_min(l_quantity, q) AS bpm FROM (SELECT *, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS q FROM lineitem) GROUP BY 1"}, body="""
SELECT coalesce(bgm_id, id) AS bgm_id, coalesce(score, music_score) AS music_score, coalesce(risk, speech_risk) AS speech_risk, coalesce(b2.bpm, b.bpm) AS bpm, coalesce(exported_count, 0) AS exported_count
FROM (SELECT bgm_id, bpm::DOUBLE AS bpm, music_score, speech_risk, exported_count FROM bgm) b2 FULL JOIN b ON id = bgm_id"""))
def _(s, sf):
    stored = views.bgm(s, sf).selectExpr("bgm_id", "cast(bpm as double) bpm", "music_score", "speech_risk", "exported_count")
    batch = table(s, sf, "lineitem").selectExpr("l_partkey + 500 bgm_id", "l_quantity bpm", "l_discount music_score", "l_tax speech_risk", "l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 seq")
    return ledger.upsert_bgm(stored, batch)


@query("bgm_reserve_finalize", "D18", f"""WITH a AS ({SEQ}), t AS (SELECT DISTINCT candidate_id, run_id, creative_id, price > 200000 AS c FROM a)
SELECT p_partkey AS bgm_id, count(candidate_id) AS selected_count, coalesce(count(candidate_id) FILTER (c), 0) AS exported_count FROM part LEFT JOIN t ON candidate_id = p_partkey GROUP BY 1""")
def _(s, sf):
    assets = table(s, sf, "part").selectExpr("p_partkey bgm_id", "0L selected_count", "0L exported_count", "cast(null as bigint) last_run_id", "cast(null as bigint) last_creative_id")
    wanted = assignments(s, sf).withColumnRenamed("candidate_id", "bgm_id")
    empty = wanted.select("bgm_id", "run_id", "creative_id", F.lit("reserved").alias("state")).limit(0)
    assets, book = ledger.reserve(assets, empty, wanted, key="bgm_id")
    commits = table(s, sf, "orders").where("o_totalprice > 200000").selectExpr("o_custkey run_id", "o_orderkey creative_id", "'committed' decision")
    return ledger.finalize(assets, book, commits, key="bgm_id", mark_used=False)[0].select("bgm_id", "selected_count", "exported_count")


@query("cache_put", "D19", """WITH b AS (SELECT o_custkey AS k, arg_max(o_orderkey % 5, o_orderkey) AS n, max(o_orderkey) AS last_at, arg_min(o_orderstatus, o_orderkey) AS m FROM orders GROUP BY 1)
SELECT coalesce('k' || c_custkey, 'k' || k) AS cache_key, coalesce(c_mktsegment, m) AS model_id, coalesce(n, 7)::BIGINT AS candidate_count, coalesce(last_at, -1) AS analyzed_at FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN b ON k = c_custkey""")
def _(s, sf):
    cache = table(s, sf, "customer").where("c_acctbal > 0").selectExpr("concat('k', c_custkey) cache_key", "c_mktsegment model_id", "7L candidate_count", "-1L analyzed_at")
    batch = table(s, sf, "orders").selectExpr("concat('k', o_custkey) cache_key", "o_orderstatus model_id", "o_orderkey analyzed_at", "o_orderkey seq",
                                              "slice(array(1, 2, 3, 4, 5), 1, cast(o_orderkey % 5 as int)) candidates")
    return ledger.put_cache(cache, batch)


# ---- rankings ---------------------------------------------------------------------------------------

BGM_KEY = "round(music_score - exported_count * 0.15::DOUBLE - least(0.3::DOUBLE, least(abs(bpm - 122), abs(bpm * 2 - 122), abs(bpm / 2 - 122)) / 100), 9) DESC, music_score DESC, round(music_score - exported_count * 0.15::DOUBLE, 9) DESC, updated_at DESC, bgm_id DESC"
FIT = "bgm_id % 7 <> 0 AND music_score >= 0.3 AND speech_risk <= 0.3 AND duration_ms >= 5000"


def marked_bgm(s, sf):
    return views.bgm(s, sf).withColumn("eligible", C("bgm_id") % 7 != 0)


@query("rank_bgms", "F02", with_views("bgm", body=f"""SELECT category, bgm_id, row_number() OVER (PARTITION BY category ORDER BY {BGM_KEY}) AS rank FROM bgm WHERE {FIT}"""))
def _(s, sf):
    kept = ranking.eligible_bgms(marked_bgm(s, sf), minimum_score=0.3, maximum_risk=0.3)
    return ranking.rank_bgms(kept, 122).select("category", "bgm_id", "rank")


@query("dedupe_by_fingerprint", "F03", with_views("bgm", body=f"""SELECT category, fingerprint, bgm_id FROM bgm WHERE {FIT} QUALIFY row_number() OVER (PARTITION BY category, fingerprint ORDER BY {BGM_KEY}) = 1"""))
def _(s, sf):
    kept = ranking.eligible_bgms(marked_bgm(s, sf), minimum_score=0.3, maximum_risk=0.3)
    return ranking.dedupe_by_fingerprint(kept, 122).select("category", "fingerprint", "bgm_id")


@query("take_with_repeat", "F04", with_views("bgm", more={
    "u": f"SELECT * FROM bgm WHERE {FIT} QUALIFY row_number() OVER (PARTITION BY category, fingerprint ORDER BY {BGM_KEY}) = 1",
    "r": f"SELECT *, row_number() OVER (PARTITION BY category ORDER BY {BGM_KEY}) AS rk FROM u",
    "x": "SELECT category, bgm_id, c::INTEGER AS copy, row_number() OVER (PARTITION BY category ORDER BY c, rk)::INTEGER AS slot FROM (SELECT *, unnest([1, 2]) AS c FROM r)"}, body="SELECT * FROM x WHERE slot <= 25"))
def _(s, sf):
    return ranking.select_bgms(marked_bgm(s, sf), 25, minimum_score=0.3, maximum_risk=0.3).select("category", "bgm_id", "copy", "slot")


SCORED = "SELECT *, round((aesthetic + payoff) / 2, 4) AS final_score, candidate_id AS position FROM cand"


def scored(s, sf):
    return views.cand(s, sf).withColumns({"final_score": F.round((C("aesthetic") + C("payoff")) / 2, 4), "position": C("candidate_id")})


@query("source_capped_topn", "F09", with_views("cand", more={"k": SCORED, "r": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY final_score DESC, position) AS sr FROM k"}, body="""
SELECT candidate_id, video_id, final_score FROM r WHERE sr <= 2 ORDER BY final_score DESC, position LIMIT 100"""))
def _(s, sf):
    return ranking.source_capped_topn(scored(s, sf), 2, 100).select("candidate_id", "video_id", "final_score")


@query("rank_candidates", "E21", with_views("cand", more={"k": SCORED}, body="""SELECT category, candidate_id, final_score, row_number() OVER (PARTITION BY category ORDER BY final_score DESC, position) AS rank FROM k"""))
def _(s, sf):
    return ranking.rank_candidates(scored(s, sf), ["category"]).select("category", "candidate_id", "final_score", "rank")


@query("rank_cover_candidates", "E22", with_views("cand", body="""SELECT video_id AS creative_id, candidate_id, row_number() OVER (PARTITION BY video_id ORDER BY
  CASE event WHEN 'purchase' THEN 1.0 WHEN 'view' THEN 0.92 WHEN 'click' THEN 0.84 ELSE 0.55 END DESC, aesthetic DESC, subject_visibility DESC, sharpness DESC, composition DESC, payoff DESC, candidate_id)::INTEGER AS rank
FROM cand QUALIFY rank <= 5"""))
def _(s, sf):
    c = views.cand(s, sf).withColumns({"creative_id": C("video_id"), "pos": C("candidate_id")})
    return ranking.rank_cover_candidates(c, ["purchase", "view", "click"], 5).select("creative_id", "candidate_id", "rank")


@query("cover_option_fallback", "F10", """WITH o AS (SELECT l_orderkey AS creative_id, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS ordinal, l_quantity > 30 AS a, l_discount > 0.02 AS d FROM lineitem),
t AS (SELECT *, CASE WHEN a AND NOT d THEN 0 WHEN NOT d THEN 1 ELSE 2 END AS tier FROM o)
SELECT creative_id, ordinal, tier FROM t QUALIFY row_number() OVER (PARTITION BY creative_id ORDER BY tier, ordinal) = 1""")
def _(s, sf):
    o = table(s, sf, "lineitem").selectExpr("l_orderkey creative_id", "l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey ordinal", "l_quantity > 30 acceptable", "l_discount > 0.02 duplicate")
    return ranking.cover_option_fallback(o).select("creative_id", "ordinal", "tier")


@query("latest_runs", "F11", "SELECT o_orderkey AS run_id, epoch_ms(o_orderdate) AS modified_at FROM orders ORDER BY 2 DESC")
def _(s, sf):
    return ranking.latest_runs(table(s, sf, "orders").selectExpr("o_orderkey run_id", "unix_millis(cast(o_orderdate as timestamp)) modified_at"))


@query("shared_candidates", "G02", with_views("usage", more={"a": "SELECT DISTINCT candidate_id FROM usage WHERE state = 'reserved'", "b": "SELECT DISTINCT candidate_id FROM usage WHERE state = 'released'"}, body="""
SELECT candidate_id, (SELECT count(*) FROM a) AS left_size, (SELECT count(*) FROM b) AS right_size, (SELECT count(*) FROM a JOIN b USING (candidate_id)) AS shared FROM a JOIN b USING (candidate_id)"""))
def _(s, sf):
    u = views.staged(views.usage(s, sf))
    a, b = u.where("state = 'reserved'"), u.where("state = 'released'")
    sizes = ranking.overlap_sizes(a, b)
    return ranking.shared_candidates(a, b).select("candidate_id", *[sizes.select(c).scalar().alias(c) for c in ("left_size", "right_size", "shared")])


@query("fresh_candidates", "G03", with_views("usage", body="""SELECT creative_id, candidate_id FROM usage WHERE state = 'reserved' AND candidate_id NOT IN (SELECT 2 * candidate_id FROM usage WHERE state = 'committed')"""))
def _(s, sf):
    u = views.usage(s, sf)
    return ranking.fresh_candidates(u.where("state = 'reserved'"), u.where("state = 'committed'").withColumn("candidate_id", 2 * C("candidate_id"))).select("creative_id", "candidate_id")


@query("ordered_distinct", "G04", f"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[{text.SPACE}]+', ' ', 'g')), ' ') AS l FROM documents)
SELECT doc_id, len(list_distinct(list_append(l, lang)))::BIGINT AS n, (list_append(l, lang))[1] AS first FROM w JOIN documents USING (doc_id)""")
def _(s, sf):
    d = views.texts(s, sf).select("doc_id", ranking.ordered_distinct(F.split(text.squeeze(C("text")), " "), F.array("lang")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("first"))


# ---- reports ----------------------------------------------------------------------------------------

@query("category_counts", "D01", with_views("material", body="SELECT category, count(*) AS videos FROM material GROUP BY 1"))
def _(s, sf):
    return reports.category_counts(views.material(s, sf))


ROLL = {"e": "SELECT video_id, event, count(*) AS n, min(candidate_id) AS seen FROM cand GROUP BY 1, 2",
        "roll": """SELECT video_id, sum(n)::BIGINT AS candidate_count, round(sum(n) / (SELECT count(*) FROM cand), 4) AS candidate_ratio,
   string_agg(event || ':' || n, ',' ORDER BY n DESC, seen) AS events FROM e GROUP BY 1"""}


def rollup(s, sf):
    return reports.source_rollup(views.cand(s, sf).withColumn("position", C("candidate_id")))


def flat(df):
    return df.withColumn("events", F.array_join(F.transform("events", lambda x: F.concat_ws(":", x["event"], x["n"].cast("string"))), ","))


@query("source_rollup", "D02", with_views("cand", more=ROLL, body="SELECT * FROM roll"))
def _(s, sf):
    return flat(rollup(s, sf))


FAIL = "SELECT video_id, path, CASE WHEN video_id % 4 = 0 THEN NULL ELSE 'boom ' || video_id END AS error FROM material WHERE dur_ms < 60000"


@query("source_summary", "C13", with_views("cand", "material", more={"e": "SELECT video_id, event, count(*) AS n FROM cand GROUP BY 1, 2",
    "roll": "SELECT video_id, sum(n)::BIGINT AS candidate_count, round(sum(n) / (SELECT count(*) FROM cand), 4) AS candidate_ratio FROM e GROUP BY 1", "f0": FAIL,
    "f": "SELECT CASE WHEN video_id % 3 = 0 THEN video_id ELSE video_id + 1000000 END AS video_id, path, error FROM f0"}, body="""
SELECT video_id, candidate_count, candidate_ratio, NULL::VARCHAR AS error, NULL::VARCHAR AS filename FROM roll UNION ALL
SELECT video_id, 0, 0, coalesce(error, 'analysis failed'), regexp_extract(path, '[^/]*$') FROM f WHERE video_id NOT IN (SELECT video_id FROM roll)"""))
def _(s, sf):
    # failed videos with candidates (from an earlier run) and without any
    good = views.cand(s, sf).withColumn("position", C("candidate_id"))
    lost = views.material(s, sf).where("dur_ms < 60000").selectExpr("if(video_id % 3 = 0, video_id, video_id + 1000000) video_id", "path", "if(video_id % 4 = 0, null, concat('boom ', video_id)) error")
    return reports.source_summary(reports.source_rollup(good), lost).select("video_id", "candidate_count", "candidate_ratio", "error", "filename")


RESULTS = "SELECT o_custkey AS run_id, o_orderkey AS creative_id, CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status FROM orders"
FAILS = "SELECT o_custkey AS run_id, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'"


def results(s, sf):
    return table(s, sf, "orders").selectExpr("o_custkey run_id", "o_orderkey creative_id", "case o_orderstatus when 'F' then 'committed' when 'P' then 'partial' else 'failed' end status")


def fails(s, sf):
    return table(s, sf, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey run_id", "o_orderkey")


@query("run_summary", "D03", with_views("usage", more={"r": RESULTS, "f": FAILS,
    "p": "SELECT run_id, count(DISTINCT video_id) AS videos, count(*) AS candidates FROM usage GROUP BY 1",
    "q": "SELECT run_id, count(*) AS requested, count(*) FILTER (status = 'committed') AS committed, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed FROM r GROUP BY 1",
    "g": "SELECT run_id, count(*) AS n FROM f GROUP BY 1"}, body="""SELECT coalesce(p.run_id, q.run_id) AS run_id, coalesce(videos, 0) AS videos, coalesce(candidates, 0) AS candidates, coalesce(requested, 0) AS requested,
 coalesce(committed, 0) AS committed, coalesce(partial, 0) AS partial, coalesce(failed, 0) AS failed, coalesce(n, 0) AS analysis_failures FROM p FULL JOIN q USING (run_id) LEFT JOIN g ON g.run_id = q.run_id"""))
def _(s, sf):
    return reports.run_summary(views.usage(s, sf), results(s, sf), fails(s, sf))


@query("diversity_summary", "D04", with_views("usage", "registry", more={"n": "SELECT run_id, candidate_id, count(*) AS n FROM usage GROUP BY 1, 2"}, body="""
SELECT run_id, creative_count, selected_candidate_count, unique_candidate_count, maximum_candidate_use_count, never_used_candidate_ratio FROM
 (SELECT run_id, count(DISTINCT creative_id) AS creative_count FROM usage GROUP BY 1) JOIN (SELECT run_id, sum(n)::BIGINT AS selected_candidate_count, count(*) AS unique_candidate_count,
 max(n) AS maximum_candidate_use_count, round(sum(CASE WHEN coalesce(exported_count, 0) = 0 THEN n ELSE 0 END) / sum(n), 4) AS never_used_candidate_ratio FROM n LEFT JOIN registry USING (candidate_id) GROUP BY 1) USING (run_id)"""))
def _(s, sf):
    return reports.diversity_summary(views.staged(views.usage(s, sf)), views.registry(s, sf))


PAIRS = {
    "cs": "SELECT run_id, creative_id, list(DISTINCT candidate_id) AS c, list(DISTINCT video_id) AS v, arg_min(video_id, pos) AS o FROM usage GROUP BY 1, 2",
    "pairs": """SELECT run_id, a.creative_id AS a, b.creative_id AS b, round(len(list_intersect(a.c, b.c)) / least(len(a.c), len(b.c)), 4) AS candidate_overlap_ratio,
   round(len(list_intersect(a.v, b.v)) / least(len(a.v), len(b.v)), 4) AS source_overlap_ratio, a.o = b.o AS opening_source_same FROM cs a JOIN cs b USING (run_id)
   WHERE a.creative_id < b.creative_id AND (list_has_any(a.c, b.c) OR list_has_any(a.v, b.v))"""}


@query("pairwise_overlap", "D05", with_views("usage", more=PAIRS, body="SELECT * FROM pairs"))
def _(s, sf):
    return reports.pairwise_overlap(views.staged(views.usage(s, sf)))


@query("pairs_over_threshold", "D05 D06", with_views("usage", more=PAIRS, body="""SELECT a.run_id, a.creative_id AS a, b.creative_id AS b, round(len(list_intersect(a.c, b.c)) / least(len(a.c), len(b.c)), 4) AS overlap FROM cs a JOIN cs b ON b.run_id = a.run_id AND a.creative_id < b.creative_id
 WHERE len(list_intersect(a.c, b.c)) / least(len(a.c), len(b.c)) > 0.2"""))
def _(s, sf):
    return reports.pairs_over(views.staged(views.usage(s, sf)))


@query("maximum_overlap", "D06", with_views("usage", more=PAIRS, body="SELECT run_id, max(candidate_overlap_ratio) AS overlap FROM pairs WHERE candidate_overlap_ratio > 0.2 GROUP BY 1"))
def _(s, sf):
    return reports.maximum_overlap(views.staged(views.usage(s, sf)))


ERRS = "CASE WHEN creative_id % 9 = 0 THEN ['gap: a/b 1.000-2.000', 'voiceover must contain at least two sentences'] ELSE [] END"


@query("run_alerts", "D06", with_views("usage", "registry", more={"r": RESULTS, "f": FAILS, **PAIRS,
    "s1": "SELECT run_id, count(*) AS c FROM usage GROUP BY 1", "s2": "SELECT run_id, count(*) FILTER (status <> 'committed') AS u FROM r GROUP BY 1", "s3": "SELECT run_id, count(*) AS n FROM f GROUP BY 1",
    "sh": "SELECT run_id, 's' || video_id AS author, round(count(*) / any_value(c), 4) AS ratio FROM usage JOIN s1 USING (run_id) GROUP BY run_id, video_id",
    "un": "SELECT run_id, round(avg(CASE WHEN coalesce(exported_count, 0) = 0 THEN 1 ELSE 0 END), 4) AS ratio FROM usage LEFT JOIN registry USING (candidate_id) GROUP BY 1"}, body="""
SELECT run_id, 'red' AS level, n || ' 条源视频分析失败' AS message FROM s3 UNION ALL SELECT run_id, 'yellow', '候选池低于 55 个候选的生产目标（' || c || '/55）' FROM s1 WHERE c < 55
UNION ALL SELECT run_id, 'red', u || ' 条成片处于部分完成或失败状态' FROM s2 WHERE u > 0
UNION ALL SELECT run_id, 'red', author || ' 贡献了候选池的 ' || round(ratio * 100, 0)::BIGINT || '%，单一来源占比过高' FROM sh WHERE ratio > 0.25
UNION ALL SELECT run_id, 'red', '两条成片之间的最大候选重合率为 ' || round(max(candidate_overlap_ratio) * 100, 0)::BIGINT || '%，超过 20% 阈值' FROM pairs GROUP BY run_id HAVING max(candidate_overlap_ratio) > 0.2
UNION ALL SELECT run_id, 'yellow', '历史未使用候选占比为 ' || round(ratio * 100, 0)::BIGINT || '%，低于 80% 目标' FROM un WHERE ratio < 0.8
UNION ALL SELECT run_id, 'red', creative_id || '：时间线存在空隙：a/b 1.000-2.000；口播文案必须至少包含两句话' FROM r WHERE creative_id % 9 = 0
UNION ALL SELECT run_id, 'yellow', creative_id || '：Image2 生成失败，当前使用备用封面' FROM r WHERE creative_id % 11 = 0"""))
def _(s, sf):
    u = views.staged(views.usage(s, sf))
    summary = reports.run_summary(u, results(s, sf), fails(s, sf))
    totals = u.groupBy("run_id").agg(F.count("*").alias("c"))
    sources = u.groupBy("run_id", "video_id").agg(F.count("*").alias("n")).join(totals, "run_id").select(
        "run_id", F.concat(F.lit("s"), C("video_id").cast("string")).alias("author"), F.round(C("n") / C("c"), 4).alias("candidate_ratio"))
    creatives = results(s, sf).select("run_id", "creative_id", F.expr(
        "if(creative_id % 9 = 0, array('gap: a/b 1.000-2.000', 'voiceover must contain at least two sentences'), array())").cast("array<string>").alias("errors"), F.expr("creative_id % 11 <> 0").alias("cover_ok"))
    return reports.run_alerts(summary, sources, reports.maximum_overlap(u), reports.diversity_summary(u, views.registry(s, sf)), creatives)


ROUTE = "CASE event_type WHEN 'view' THEN 'gemma_only' WHEN 'click' THEN 'marlin_then_gemma_candidate_windows' WHEN 'purchase' THEN 'cache_hit:gemma_only' WHEN 'signup' THEN 'marlin_failed_gemma_fallback' ELSE 'marlin_segmented_then_gemma_candidate_windows' END"


@query("routing_summary", "D07", f"""WITH r AS (SELECT user_id % 5 AS category, event_type AS t FROM events)
SELECT category, count(*) FILTER (t IN ('click', 'error')) AS marlin, count(*) FILTER (t = 'view') AS gemma_only, count(*) FILTER (t = 'signup') AS marlin_fallback,
 count(*) FILTER (t = 'purchase') AS cache_hit, count(*) FILTER (t <> 'purchase') AS cache_miss FROM r GROUP BY 1""")
def _(s, sf):
    r = table(s, sf, "events").select((C("user_id") % 5).alias("category"), F.expr(ROUTE).alias("route"))
    return reports.routing_summary(r, ["category"])


@query("bgm_pool_summary", "D08", with_views("bgm", body="SELECT category, count(*) AS analyzed_count, count(*) FILTER (music_score >= 0.68 AND speech_risk <= 0.18) AS eligible_count FROM bgm GROUP BY 1"))
def _(s, sf):
    b = views.bgm(s, sf).withColumn("eligible", (C("music_score") >= 0.68) & (C("speech_risk") <= 0.18))
    return reports.bgm_pool_summary(b, ["category"])


@query("batch_result", "D09", f"""WITH r AS ({RESULTS}), f AS (SELECT run_id, count(*) AS n FROM ({FAILS}) GROUP BY 1)
SELECT run_id, count(*) AS requested_count, count(*) FILTER (status = 'committed') AS committed_count, count(*) FILTER (status = 'partial') AS partial_count, count(*) FILTER (status = 'failed') AS failed_count,
 bool_and(status <> 'failed') AND bool_or(status = 'committed') AS ok, any_value(n || ' source video(s) failed analysis; the batch continued with successful candidates') AS warning FROM r LEFT JOIN f USING (run_id) GROUP BY 1""")
def _(s, sf):
    return reports.batch_result(results(s, sf), fails(s, sf))


def reviews(s, sf):
    return table(s, sf, "conversations").selectExpr("conv_id video_id", "turn window_index", "role summary", "split(role, '') candidates", "array(role) rejected")


@query("merge_reviews", "D21", """SELECT conv_id AS video_id, string_agg(role, ' ' ORDER BY turn) AS summary, sum(length(role))::BIGINT AS candidates, count(*) AS rejected FROM conversations GROUP BY 1""")
def _(s, sf):
    return reports.merge_reviews(reviews(s, sf))


@query("merged_review_rows", "D21", """SELECT conv_id AS video_id, turn AS window_index, role[i + 1] AS candidate, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS raw_index
FROM (SELECT *, unnest(range(0, length(role))) AS i FROM conversations)""")
def _(s, sf):
    return reports.merged_review_rows(reviews(s, sf)).select("video_id", "window_index", "candidate", "raw_index")


@query("candidate_shortfall", "D22", with_views("cand", "material", more={"g": "SELECT * FROM cand",
    "n": """SELECT video_id, count(*) AS n, '[' || string_agg('{"start":' || start_ms || ',"end":' || end_ms || ',"event":"' || event || '"}', ',' ORDER BY start_ms, end_ms, event) || ']' AS x FROM g GROUP BY 1"""}, body="""
SELECT video_id, coalesce(n, 0) AS usable, greatest(0, 12 - coalesce(n, 0)) AS shortfall, coalesce(n, 0) >= 12 AS satisfied, CASE WHEN coalesce(n, 0) < 12 THEN coalesce(x, '[]') END AS existing FROM material LEFT JOIN n USING (video_id)"""))
def _(s, sf):
    return reports.candidate_shortfall(views.material(s, sf), views.cand(s, sf), 12)


@query("creative_report", "C14", with_views("usage", more={
    "a": "SELECT creative_id, count(*) AS c, count(DISTINCT video_id) AS v, string_agg(DISTINCT CASE WHEN video_id % 3 = 0 THEN 'unknown' ELSE '@n' || video_id % 7 END, ',' ORDER BY CASE WHEN video_id % 3 = 0 THEN 'unknown' ELSE '@n' || video_id % 7 END) AS au FROM usage GROUP BY 1"}, body="""
SELECT o_orderkey AS creative_id, CASE WHEN o_orderstatus = 'F' THEN 'committed' WHEN o_totalprice > 100000 THEN 'planned' ELSE 'starting' END AS status, coalesce(c, 0) AS candidate_count, coalesce(v, 0) AS source_count, coalesce(au, '') AS authors
FROM orders LEFT JOIN a ON creative_id = o_orderkey"""))
def _(s, sf):
    plans = table(s, sf, "orders").selectExpr("o_orderkey creative_id", "o_totalprice > 100000 has_plan")
    picked = views.staged(views.usage(s, sf)).withColumn("video_path", F.expr("if(video_id % 3 = 0, concat('/v/', video_id, '.mp4'), concat('/v/x_@n', video_id % 7, '_', video_id, '.mp4'))"))
    out = reports.creative_report(plans, results(s, sf).where("status = 'committed'"), picked)
    return out.withColumn("authors", F.array_join("authors", ","))


@query("subtitle_validation", "E20", with_views("transcript", more={"t": "SELECT conv_id, turn, start_ms - turn % 3 * 40 AS s, end_ms AS e FROM transcript",
    "n": "SELECT *, lead(s) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM t",
    "x": "SELECT conv_id, count(*) AS segment_count, count(*) FILTER (e > nx + 1) AS overlap_count, abs(arg_max(e, turn) - (max(e) + conv_id % 90)) AS duration_error_ms FROM n GROUP BY 1"}, body="""
SELECT conv_id AS script_id, segment_count, overlap_count, duration_error_ms, duration_error_ms <= 50 AS passed FROM x"""))
def _(s, sf):
    t = views.transcript(s, sf).select(C("conv_id").alias("script_id"), C("turn").alias("line"), (C("start_ms") - C("turn") % 3 * 40).alias("start_ms"), "end_ms")
    d = t.groupBy("script_id").agg((F.max("end_ms") + C("script_id") % 90).alias("dur_ms"))
    return reports.subtitle_validation(t, d)
