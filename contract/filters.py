"""Row-wise operators and text expressions (survey 2.2, 2.8)."""

from pyspark.sql import functions as F

from contract import views
from contract.base import query
from contract.views import table, with_views
from mediaquery.functions import hashing, scoring, text
from mediaquery.functions.ordered import ordered_scan
from mediaquery.operators import filters as op

C = F.col
WS = text.SPACE
CJK = text.CJK
STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '(?s)^(.+)\\.[^.]+$', '\\1')"
STRIP = lambda e: f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"
SQUEEZE = lambda e: f"trim(regexp_replace({e}, '[{WS}]+', ' ', 'g'))"
COUNT = lambda e, p: f"length(regexp_extract_all({e}, '{p}'))"


@query("select_materials", "B01", with_views("material", body="""
SELECT video_id, path FROM material WHERE enabled AND category = 3 ORDER BY position LIMIT 12"""))
def _(s, sf):
    return op.select_materials(views.material(s, sf), 3, 12).select("video_id", "path")


@query("parse_material_name", "B02", with_views("material", more={
    "st": f"SELECT video_id, {STEM} AS stem FROM material",
    "a": """SELECT *, regexp_matches(stem, '(?s)^(.*)_([^_]*)_([^_]*)_([^_]*)$') AS ok,
  regexp_extract(stem, '(?s)^(.*)_([^_]*)_([^_]*)_([^_]*)$', ['head', 'market', 'language', 'note']) AS r FROM st""",
    "b": """SELECT *, strpos(r.head, '_@') AS pos_at, left(r.head, greatest(0, strpos(r.head, '_@') - 1)) AS block FROM a""",
    "c": "SELECT *, ok AND pos_at > 0 AND strpos(block, '-') > 0 AS good FROM b",
}, body=f"""SELECT video_id, CASE WHEN NOT good THEN '{text.NAME_ERROR}' WHEN r.note = '' THEN '{text.NOTE_ERROR}' END AS error,
  CASE WHEN good THEN trim(left(block, strpos(block, '-') - 1)) END AS parent_category,
  CASE WHEN good THEN trim(substr(block, strpos(block, '-') + 1)) END AS source_category,
  CASE WHEN good THEN '@' || trim(substr(r.head, pos_at + 2)) END AS author,
  CASE WHEN good THEN trim(r.market) END AS market, CASE WHEN good THEN trim(r.language) END AS language,
  CASE WHEN good THEN trim(r.note) END AS note_id FROM c"""))
def _(s, sf):
    return op.parse_material_names(views.material(s, sf).select("video_id", "path")).drop("path")


@query("author_names", "B03 B04 B05", with_views("material", more={"st": f"SELECT video_id, {STEM} AS stem FROM material"}, body="""
SELECT video_id,
  CASE WHEN regexp_matches(stem, '@[^*]+\\*') THEN trim(regexp_extract(stem, '(@[^*]+)\\*', 1))
       WHEN regexp_matches(stem, '_@[^_]+_') THEN trim(regexp_extract(stem, '_(@[^_]+)_', 1)) ELSE video_id::VARCHAR END AS author_key,
  CASE WHEN regexp_matches(stem, '@[^*_]+[^*]*?\\*') THEN trim(regexp_extract(stem, '(@[^*_]+[^*]*?)\\*', 1))
       WHEN regexp_matches(stem, '_@[^_]+_') THEN trim(regexp_extract(stem, '_(@[^_]+)_', 1)) ELSE 'unknown' END AS author_display,
  CASE WHEN regexp_matches(stem, '@[^*]+\\*') THEN trim(regexp_extract(stem, '(@[^*]+)\\*', 1))
       WHEN strpos(stem, '@') = 0 THEN '' ELSE trim(array_to_string(list_slice(string_split(
         regexp_replace(substr(stem, strpos(stem, '@')), '_[0-9a-fA-F]{24}$', ''), '_'), 1,
         greatest(1, len(string_split(regexp_replace(substr(stem, strpos(stem, '@')), '_[0-9a-fA-F]{24}$', ''), '_')) - 2)), '_')) END AS overlay_name
FROM st"""))
def _(s, sf):
    return views.material(s, sf).select(
        "video_id", text.author_key(C("path"), C("video_id")).alias("author_key"),
        text.author_display(C("path")).alias("author_display"), text.author_overlay_name(C("path")).alias("overlay_name"))


RAW = """SELECT candidate_id, video_id, start_ms - CASE WHEN candidate_id % 41 = 0 THEN 200000 ELSE 0 END AS start_ms,
 CASE WHEN candidate_id % 37 = 0 THEN start_ms - 5 ELSE end_ms END AS end_ms,
 aesthetic * 1.1::DOUBLE AS aesthetic, payoff, action_intensity - 0.01::DOUBLE AS action_intensity, subject_visibility FROM cand"""


@query("validate_candidates", "B06", with_views("cand", more={"raw": RAW}, body="""
SELECT candidate_id, concat_ws('; ', CASE WHEN start_ms < 0 THEN 'start must not be negative' END,
  CASE WHEN end_ms <= 0 THEN 'end must be positive' END, CASE WHEN end_ms <= start_ms THEN 'end must be greater than start' END,
  CASE WHEN aesthetic NOT BETWEEN 0 AND 1 THEN 'aesthetic outside 0..1' END,
  CASE WHEN payoff NOT BETWEEN 0 AND 1 THEN 'payoff outside 0..1' END,
  CASE WHEN action_intensity NOT BETWEEN 0 AND 1 THEN 'action_intensity outside 0..1' END,
  CASE WHEN subject_visibility NOT BETWEEN 0 AND 1 THEN 'subject_visibility outside 0..1' END) AS errors FROM raw"""))
def _(s, sf):
    raw = views.cand(s, sf).selectExpr(
        "candidate_id", "video_id", "start_ms - if(candidate_id % 41 = 0, 200000, 0) start_ms",
        "if(candidate_id % 37 = 0, start_ms - 5, end_ms) end_ms", "aesthetic * cast(1.1 as double) aesthetic", "payoff",
        "action_intensity - cast(0.01 as double) action_intensity", "subject_visibility")
    checked = op.validate_candidates(raw, ["aesthetic", "payoff", "action_intensity", "subject_visibility"])
    return checked.select("candidate_id", F.array_join("errors", "; ").alias("errors"))


RISK = """CASE candidate_id % 7 WHEN 0 THEN 'Chinese Subtitles on frame' WHEN 1 THEN 'blurred' WHEN 2 THEN '底部有中文字幕'
 WHEN 3 THEN 'chinese captions' ELSE 'none' END"""


@query("reject_by_risk_terms", "B08", with_views("cand", more={
    "r": f"SELECT candidate_id, candidate_id % 10 = 4 AS flag, lower('seen ' || {RISK} || ' ' || event) AS risks FROM cand"}, body="""
SELECT candidate_id FROM r WHERE NOT flag AND NOT (contains(risks, 'chinese subtitle') OR contains(risks, 'chinese caption')
  OR contains(risks, '中文字幕') OR contains(risks, '简体字幕') OR contains(risks, '繁体字幕'))"""))
def _(s, sf):
    raw = views.cand(s, sf).selectExpr(
        "candidate_id", "candidate_id % 10 = 4 subtitle_flag", f"array('seen', {RISK}, event) risks")
    return op.reject_by_risk_terms(raw).select("candidate_id")


@query("normalize_reviews", "B07", with_views("cand", more={
    "raw": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY candidate_id) AS raw_index,
  greatest(0, start_ms - candidate_id % 2 * 900) AS s, least(dur_ms, end_ms) AS e,
  CASE candidate_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE start_ms + (candidate_id * 11) % 4000 END AS peak FROM cand""",
}, body="""SELECT video_id || '_gemma_' || CASE WHEN raw_index < 100 THEN lpad(raw_index::VARCHAR, 2, '0') ELSE raw_index::VARCHAR END AS candidate_id,
  video_id, CASE WHEN event IN ('view', 'click', 'purchase') THEN event ELSE 'view' END AS event, s AS start_ms, e AS end_ms,
  greatest(s, least(e, coalesce(nullif(peak, 0), round_even((s + e) / 2, 0)::BIGINT))) AS peak_ms,
  least(1, greatest(0, aesthetic * 1.5::DOUBLE - 0.2::DOUBLE)) AS aesthetic, payoff, least(1.0::DOUBLE, greatest(0.0::DOUBLE, confidence * 2)) AS confidence,
  1.0::DOUBLE AS category_event_value FROM raw WHERE e > s AND e - s >= 400"""))
def _(s, sf):
    raw = views.cand(s, sf).withColumns({
        "aesthetic": C("aesthetic") * 1.5 - 0.2, "confidence": C("confidence") * 2, "start_ms": C("start_ms") - C("candidate_id") % 2 * 900,
        "peak_ms": F.expr("case candidate_id % 4 when 0 then null when 1 then 0 else start_ms + (candidate_id * 11) % 4000 end"),
    })
    raw = ordered_scan(raw, ["video_id"], [C("candidate_id")], F.floor(C("candidate_id") / 65536), rank="raw_index")
    out = op.normalize_reviews(raw, events=["view", "click", "purchase"], default_event="view")
    return out.select("candidate_id", "video_id", "event", "start_ms", "end_ms", "peak_ms", "aesthetic", "payoff",
                      "confidence", "category_event_value")


@query("analysis_route", "B09", with_views("material", body="""
SELECT video_id, CASE WHEN video_id % 6 = 0 THEN 'cache_hit:' || CASE WHEN video_id % 4 = 0 THEN 'unknown' ELSE 'gemma_only' END
  WHEN dur_ms < 30000 THEN 'gemma_only' WHEN video_id % 9 = 0 THEN NULL
  WHEN dur_ms > 120000 THEN 'marlin_segmented_then_gemma_candidate_windows' ELSE 'marlin_then_gemma_candidate_windows' END AS route
FROM material"""))
def _(s, sf):
    m = views.material(s, sf)
    return m.select("video_id", scoring.analysis_route(
        C("dur_ms"), C("video_id") % 9 == 0, F.when(C("video_id") % 4 != 0, "gemma_only"), C("video_id") % 6 == 0).alias("route"))


KINDS = """CASE bgm_id % 6 WHEN 0 THEN 'speech_only' WHEN 1 THEN 'instrumental' WHEN 2 THEN 'song_with_lyrics'
 WHEN 3 THEN 'music_with_spoken_overlay' WHEN 4 THEN 'uncertain' ELSE 'rap_song' END"""


@query("bgm_eligibility", "B10", with_views("bgm", more={"k": f"SELECT *, {KINDS} AS kind, bgm_id % 5 / 4 AS sep FROM bgm"}, body="""
SELECT bgm_id, ok AS eligible, CASE WHEN ok THEN 'eligible' WHEN duration_ms < 5000 THEN 'rejected_too_short' ELSE 'rejected' END AS status
FROM (SELECT *, kind IN ('instrumental', 'song_with_lyrics', 'rap_song', 'music_with_spoken_overlay') AND duration_ms >= 5000
  AND music_score >= 0.68 AND speech_risk <= 0.18 AND (kind <> 'music_with_spoken_overlay' OR sep >= 0.75) AS ok FROM k)"""))
def _(s, sf):
    b = views.bgm(s, sf).withColumn("kind", F.expr(KINDS))
    verdict = scoring.bgm_eligibility(
        C("kind"), C("duration_ms") / 1000, C("music_score"), C("speech_risk"), C("bgm_id") % 5 / 4,
        C("kind") == "music_with_spoken_overlay", C("bgm_id") % 7 == 0)
    return b.withColumn("v", verdict).select("bgm_id", "v.eligible", "v.status")


@query("run_status", "B11", """
SELECT o_orderkey AS run_id, CASE WHEN o_orderpriority <> '5-LOW' AND o_orderstatus = 'F' THEN 'completed'
 WHEN o_orderpriority <> '5-LOW' AND o_custkey % 3 > 0 THEN 'failed' WHEN o_orderpriority <> '5-LOW' AND o_custkey % 2 > 0 THEN 'partial'
 WHEN o_totalprice > 100000 THEN 'analyzed' ELSE 'starting' END AS status FROM orders""")
def _(s, sf):
    return table(s, sf, "orders").select(C("o_orderkey").alias("run_id"), scoring.run_status(
        C("o_orderpriority") != "5-LOW", C("o_orderstatus") == "F", C("o_custkey") % 3, C("o_custkey") % 2,
        C("o_totalprice") > 100000).alias("status"))


TITLES = "SELECT 'p' || p_partkey AS id, p_name AS title FROM part UNION ALL SELECT 'd' || doc_id, text FROM documents"


def titles(s, sf):
    part = table(s, sf, "part").selectExpr("concat('p', p_partkey) id", "p_name title")
    return part.unionByName(views.texts(s, sf).selectExpr("concat('d', doc_id) id", "text title"))


@query("validate_cover_titles", "B12", f"""WITH t AS ({TITLES}),
m AS (SELECT id, title, length(regexp_replace(title, '[{WS}，。！？,.!?]', '', 'g')) AS n FROM t)
SELECT id, concat_ws('; ', CASE WHEN n NOT BETWEEN 6 AND 16 THEN 'cover title must contain 6-16 characters' END,
 CASE WHEN length(title) - length(replace(title, chr(10), '')) > 1 THEN 'cover title must use at most two lines' END,
 CASE WHEN regexp_matches(title, '全网最强|不看后悔|精彩内容|此生必去') THEN 'cover title contains prohibited generic or exaggerated copy' END) AS errors FROM m""")
def _(s, sf):
    return titles(s, sf).select("id", F.array_join(text.cover_title_errors(C("title")), "; ").alias("errors"))


@query("split_cover_titles", "B13", f"""WITH t AS ({TITLES}),
m AS (SELECT id, replace({STRIP('title')}, chr(10), '') AS x FROM t)
SELECT id, CASE WHEN length(x) <= 9 THEN x ELSE left(x, length(x) // 2) END AS line1,
 CASE WHEN length(x) > 9 THEN substr(x, length(x) // 2 + 1) END AS line2 FROM m""")
def _(s, sf):
    lines = titles(s, sf).select("id", text.split_cover_title(C("title")).alias("l"))
    return lines.select("id", F.get("l", F.lit(0)).alias("line1"), F.get("l", F.lit(1)).alias("line2"))


@query("draft_names", "B14", with_views("material", more={
    "st": f"""SELECT video_id, category, position, {STEM} AS stem,
  CASE video_id % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'zh_TW' WHEN 2 THEN 'zh-CN' ELSE ' fr/x ' END AS lang,
  'run-' || video_id || CASE WHEN video_id % 3 = 0 THEN '' ELSE '-V' || video_id % 5 END AS run_id FROM material""",
    "p": "SELECT *, regexp_replace(stem, '(?s)(_@|\\*@).*$', '') AS prefix FROM st"}, body="""
SELECT video_id, concat_ws('-',
  CASE WHEN split_part(prefix, '-', 1) = '' THEN category::VARCHAR ELSE split_part(prefix, '-', 1) END,
  CASE WHEN strpos(prefix, '-') = 0 THEN category::VARCHAR WHEN substr(prefix, strpos(prefix, '-') + 1) = '' THEN 'unknown' ELSE substr(prefix, strpos(prefix, '-') + 1) END,
  CASE WHEN regexp_matches(stem, '_[0-9a-fA-F]{24}$') THEN right(stem, 24) ELSE video_id::VARCHAR END,
  CASE video_id % 4 WHEN 0 THEN '英语' WHEN 1 THEN '中文（繁体）' WHEN 2 THEN '中文（简体）' ELSE 'fr_x' END,
  'v' || CASE WHEN video_id % 3 = 0 THEN 1 ELSE video_id % 5 END,
  CASE WHEN position < 1000 THEN lpad(position::VARCHAR, 3, '0') ELSE position::VARCHAR END) AS draft_name FROM p"""))
def _(s, sf):
    m = views.material(s, sf)
    lang = F.expr("case video_id % 4 when 0 then 'en-US' when 1 then 'zh_TW' when 2 then 'zh-CN' else ' fr/x ' end")
    run = F.expr("concat('run-', video_id, if(video_id % 3 = 0, '', concat('-V', video_id % 5)))")
    return m.select("video_id", text.draft_name(C("path"), C("video_id"), C("category"), lang, run, C("position")).alias("draft_name"))


@query("voiceover_sentences", "B15", f"""WITH m AS (SELECT doc_id, text, len(list_filter(
  string_split_regex(text, '[。！？.!?]+'), lambda x: {STRIP('x')} <> '')) AS n FROM documents)
SELECT doc_id, n::BIGINT AS sentences, concat_ws('; ', CASE WHEN {STRIP('text')} = '' THEN 'continuous two-sentence product voiceover is required' END,
  CASE WHEN n < 2 THEN 'voiceover must contain at least two sentences' END) AS errors FROM m""")
def _(s, sf):
    return views.texts(s, sf).select(
        "doc_id", text.sentence_count(C("text")).cast("long").alias("sentences"),
        F.array_join(text.voiceover_errors(C("text")), "; ").alias("errors"))


MESSAGES = """CASE event_id % 8 WHEN 0 THEN 'Timeline starts with gap: 0/' || event_id WHEN 1 THEN 'gap:  a/b ' || event_id
 WHEN 2 THEN 'insufficient unique candidates: 3/' || event_id WHEN 3 THEN 'insufficient distinct source videos: 1/' || event_id
 WHEN 4 THEN 'voiceover must contain at least two sentences' WHEN 5 THEN 'asset is not registered: as' || event_id
 WHEN 6 THEN 'overlap: gap: ' || event_id ELSE event_type END"""


@query("validation_messages", "B16", f"""WITH m AS (SELECT event_id, {MESSAGES} AS e FROM events)
SELECT event_id, CASE WHEN e ILIKE 'timeline starts with gap:%' THEN '时间线开头存在空隙：' || ltrim(substr(e, 26))
 WHEN e LIKE 'gap:%' THEN '时间线存在空隙：' || ltrim(substr(e, 5)) WHEN e LIKE 'insufficient unique candidates:%' THEN '唯一候选不足：' || ltrim(substr(e, 32))
 WHEN e LIKE 'insufficient distinct source videos:%' THEN '不同源视频数量不足：' || ltrim(substr(e, 37))
 WHEN e = 'voiceover must contain at least two sentences' THEN '口播文案必须至少包含两句话'
 WHEN e LIKE 'asset is not registered:%' THEN '素材未注册：' || ltrim(substr(e, 25)) ELSE e END AS message FROM m""")
def _(s, sf):
    raw = table(s, sf, "events").select("event_id", F.expr(MESSAGES).alias("e"))
    return raw.select("event_id", text.localized_message(C("e")).alias("message"))


TYPES = "CASE flag WHEN 'A' THEN 'highlight' WHEN 'N' THEN 'fixed_screenshot' ELSE 'fixed_tail_sticker' END"


@query("overlay_clips", "B17", with_views("timeline", more={
    "t": f"SELECT *, {TYPES} AS clip_type FROM timeline",
    "x": """SELECT *, min(CASE WHEN clip_type = 'fixed_tail_sticker' THEN start_ms END) OVER (PARTITION BY creative_id) AS tail,
  min(CASE WHEN clip_type = 'highlight' AND dur_ms > 0 THEN pos END) OVER (PARTITION BY creative_id) AS first_pos FROM t""",
    "y": """SELECT clip_id, start_ms, CASE WHEN pos = first_pos THEN least(d, 100) ELSE d END AS overlay_ms FROM (SELECT *,
  CASE WHEN tail IS NULL THEN dur_ms ELSE least(dur_ms, greatest(0, tail - 40 - start_ms)) END AS d FROM x
  WHERE clip_type = 'highlight' AND dur_ms > 0)"""}, body="SELECT * FROM y WHERE overlay_ms > 0"))
def _(s, sf):
    clips = views.timeline(s, sf).withColumn("clip_type", F.expr(TYPES))
    out = op.overlay_clips(clips, hidden_types=["fixed_openpage", "fixed_screenshot", "fixed_tail_sticker"],
                           guard_ms=40, intro=True, cover_ms=100)
    return out.select("clip_id", "start_ms", "overlay_ms")


@query("frame_quality", "B18", with_views("frame", more={
    "e": """SELECT frame_id, luma, list_transform(range(0, 64), lambda i: CASE WHEN i < 8 OR i >= 56 OR i % 8 = 0 OR i % 8 = 7 THEN luma[i + 1]
   ELSE least(255, greatest(0, 9 * luma[i + 1] - list_sum(list_transform([-9, -8, -7, -1, 0, 1, 7, 8, 9], lambda d: luma[i + 1 + d])))) END::BIGINT) AS edges FROM frame""",
    "m": """SELECT frame_id, len(list_filter(luma, lambda x: x >= 245)) / 64 AS hi, len(list_filter(luma, lambda x: x <= 10)) / 64 AS lo,
   list_sum(luma)::BIGINT / 64 AS mean, (list_sum(list_transform(edges, lambda x: x * x))::BIGINT
   - list_sum(edges)::BIGINT * list_sum(edges)::BIGINT / 64) / 64 AS v FROM e"""}, body="""
SELECT frame_id, round(hi, 4) AS highlight_ratio, round(lo, 4) AS shadow_ratio, round(mean, 2) AS mean_luma, round(v, 2) AS edge_variance,
  hi < 0.38 AND lo < 0.72 AND mean > 18 AND mean < 238 AND v >= 28 AS acceptable FROM m"""))
def _(s, sf):
    return views.frame(s, sf).withColumn("q", hashing.frame_quality(C("luma"), 8)).select("frame_id", "q.*")


SCRIPT = """SELECT doc_id, CASE WHEN lang = 'de' THEN translate(lower(text), 'abcdefghijklmnopqrstuvwxyz,.',
 '春夏秋冬山水火木金土日月星云风雨雪花鸟鱼虫草石田心手，。') ELSE text END AS text FROM documents"""


def script(s, sf, *more):
    """Documents as voice scripts; one language is moved to CJK letters so both paths get work."""
    d = views.texts(s, sf)
    cjk = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz,.", "春夏秋冬山水火木金土日月星云风雨雪花鸟鱼虫草石田心手，。")
    return d.select("doc_id", F.when(C("lang") == "de", cjk).otherwise(C("text")).alias("text"), *more)


@query("display_units", "H08", f"""WITH d AS ({SCRIPT})
SELECT doc_id, (length(text) + {COUNT('text', f'[{CJK}{chr(92)}x{{10000}}-{chr(92)}x{{10ffff}}]')})::BIGINT AS units FROM d""")
def _(s, sf):
    return script(s, sf).select("doc_id", text.display_units(C("text")).cast("long").alias("units"))


@query("wrap_text", "H09", f"""WITH d AS ({SCRIPT}), n AS (SELECT doc_id, {SQUEEZE('text')} AS t FROM d),
w AS (SELECT doc_id, t, contains(t, ' ') AS spaced, CASE WHEN contains(t, ' ') THEN string_split(t, ' ') ELSE string_split(t, '') END AS toks FROM n),
u AS (SELECT doc_id, t, spaced, list_transform(toks, lambda k: {{'done': '', 'line': k,
  'units': length(k) + {COUNT('k', f'[{CJK}{chr(92)}x{{10000}}-{chr(92)}x{{10ffff}}]')}}}) AS toks FROM w)
SELECT doc_id, CASE WHEN t = '' THEN t ELSE r.done || r.line END AS wrapped FROM (SELECT doc_id, t, list_reduce(toks, lambda a, x:
  CASE WHEN a.units + x.units + spaced::INTEGER > 28 THEN {{'done': a.done || a.line || chr(10), 'line': x.line, 'units': x.units}}
  ELSE {{'done': a.done, 'line': a.line || CASE WHEN spaced THEN ' ' ELSE '' END || x.line, 'units': a.units + x.units + spaced::INTEGER}} END) AS r FROM u)""")
def _(s, sf):
    return script(s, sf).select("doc_id", text.wrap_text(C("text"), 28).alias("wrapped"))


CHUNKS = {
    "d": SCRIPT,
    "b": f"""SELECT doc_id, b, {COUNT('b', '[A-Za-z]')} > {COUNT('b', f'[{CJK}]')} AS latin,
  regexp_replace(b, '[{WS}]+', '', 'g') AS solid FROM (SELECT doc_id, {STRIP('text')} AS b FROM d)""",
    "lat": f"""SELECT doc_id, flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(b, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)),
   lambda x: {SQUEEZE('x')}), lambda x: x <> ''), lambda sent: list_transform(range(0, (len(string_split(sent, ' ')) - 1) // 8 + 1),
   lambda i: array_to_string(string_split(sent, ' ')[i * 8 + 1:i * 8 + 8], ' ')))) AS p FROM b WHERE latin""",
    "cl": """SELECT doc_id, list_filter(string_split_regex(solid, '[。！？!?；;，,、]+'), lambda x: x <> '') AS c FROM b WHERE NOT latin""",
    "hv": """SELECT doc_id, flatten(list_transform(c, lambda x: CASE WHEN length(x) <= 14 THEN [x]
   ELSE [left(x, length(x) // 2), substr(x, length(x) // 2 + 1)] END)) AS p FROM cl""",
    "chunks": """SELECT doc_id, p FROM lat UNION ALL SELECT doc_id, CASE WHEN len(p) >= 2 AND length(p[-1]) <= 2
   THEN list_concat(p[1:len(p) - 2], [p[-2] || p[-1]]) ELSE p END FROM hv""",
}


@query("semantic_chunks", "H10", with_views(more=CHUNKS, body="SELECT doc_id, coalesce(array_to_string(p, '|'), '') AS chunks, len(p)::BIGINT AS n FROM chunks"))
def _(s, sf):
    p = text.semantic_chunks(C("text"))
    return script(s, sf).select("doc_id", p.alias("p")).select("doc_id", F.array_join("p", "|").alias("chunks"), F.size("p").cast("long").alias("n"))


@query("speech_weight", "H11", f"""WITH d AS ({SCRIPT}) SELECT doc_id, round(greatest(1.0::DOUBLE, {COUNT('text', f'[{CJK}]')}
 + {COUNT('text', '[A-Za-z]+')} * 1.4::DOUBLE + {COUNT('text', f'[{text.DIGIT}]')} * 1.2::DOUBLE), 4) AS weight FROM d""")
def _(s, sf):
    return script(s, sf).select("doc_id", F.round(text.speech_weight(C("text")), 4).alias("weight"))


@query("text_density", "H21", f"""SELECT conv_id, turn, round(length(regexp_replace(text, '[{WS}]+', '', 'g')) / greatest(1, turn * 3.7::DOUBLE), 4) AS density FROM conversations""")
def _(s, sf):
    return table(s, sf, "conversations").select("conv_id", "turn", F.round(text.text_density(C("text"), C("turn") * 3.7), 4).alias("density"))


@query("language_label", "H18", """SELECT doc_id, CASE WHEN lang = 'en' THEN '英语' WHEN lang = 'es' THEN '中文（简体）' WHEN lang = 'de' THEN '中文（繁体）'
  WHEN source IS NULL THEN '未知语言' ELSE trim(source) END AS label FROM documents""")
def _(s, sf):
    code = F.expr("case lang when 'en' then 'EN_gb' when 'es' then 'zh-Hans' when 'de' then 'ZH_Hant' else source end")
    return table(s, sf, "documents").select("doc_id", text.language_label(code).alias("label"))


@query("parse_timestamped_transcript", "H12", with_views("transcript", body=f"""
SELECT conv_id, turn, start_ms / 1000 AS start, end_ms / 1000 AS "end", CASE speaker WHEN 'user' THEN 'S01' ELSE 'S02' END AS speaker,
 {STRIP("replace(text, '[', '(')")} AS text FROM transcript"""))
def _(s, sf):
    t = views.transcript(s, sf).withColumn("text", F.translate("text", "[", "("))
    sec = lambda c: F.format_string("%d.%03d", (C(c) / 1000).cast("long"), C(c) % 1000)
    marked = F.concat(F.lit("["), sec("start_ms"), F.lit("]["), F.when(C("speaker") == "user", "S01").otherwise("S02"), F.lit("] "),
                      C("text"), F.lit(" ["), sec("end_ms"), F.lit("]"))
    raw = F.when(C("turn") % 2 == 0, F.to_json(F.struct(marked.alias("text")))).otherwise(marked)
    return t.select("conv_id", "turn", F.inline(text.transcript_segments(raw)))


@query("unfence_json", "H13", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE props END AS json,
 CASE WHEN event_id % 5 < 4 THEN (props->>'$.k')::BIGINT END AS k FROM events""")
def _(s, sf):
    raw = F.expr("""case event_id % 5 when 0 then props when 1 then concat('```json\n', props, '\n```') when 2 then concat(' ```\n', props, '\n```  ')
      when 3 then concat('  ', props) else left(props, char_length(props) - 1) end""")
    e = table(s, sf, "events").select("event_id", text.unfence_json(raw).alias("json"))
    return e.withColumn("k", F.get_json_object("json", "$.k").cast("long"))


@query("config_fingerprint", "H14", """SELECT doc_id, sha256('{"category":"' || lang || '","model_id":"' || coalesce(source, '') || '","n":' || n_chars || ',"version":"4"}') AS fingerprint,
 sha256(doc_id || '|' || lang || '|' || sha256('{"category":"' || lang || '","model_id":"' || coalesce(source, '') || '","n":' || n_chars || ',"version":"4"}')) AS cache_key FROM documents""")
def _(s, sf):
    d = table(s, sf, "documents").select("doc_id", "lang", hashing.config_fingerprint(
        version=F.lit("4"), category=C("lang"), model_id=F.coalesce("source", F.lit("")), n=C("n_chars")).alias("fingerprint"))
    return d.select("doc_id", "fingerprint", hashing.cache_key(C("doc_id"), C("lang"), C("fingerprint")).alias("cache_key"))


PROFILES = """CASE WHEN doc_id % 2 = 0 THEN
 '{"marlin_recall": {"segment_overlap_seconds": ' || doc_id % 3 || ', "fps": 2, "query": {"b": [1, {"z": "' || coalesce(lang, '') || '", "a": null}], "a": true}}, "gemma_review": {"api_max_attempts": ' || doc_id % 5 || ', "mode": "deep"}}'
 ELSE '{ "gemma_review" : {"mode":"deep","api_retry_delays_seconds":[1,2]},
  "marlin_recall" : {"query":{"a":true,"b":[1,{"a":null,"z":"' || coalesce(lang, '') || '"}]},"fps":2,"segment_overlap_seconds":' || doc_id % 3 || '} }' END"""


@query("analysis_fingerprint", "H14", """WITH c AS (SELECT doc_id, '{"gemma_review":{"mode":"deep"},' || CASE WHEN n_chars > 1200 THEN '"marlin_long_video_segmentation":{"maximum_video_duration_seconds":120.0,"segment_duration_seconds":115.0,"segment_overlap_seconds":' || doc_id % 3 || '.0},' ELSE '' END
  || '"marlin_recall":{"fps":2,"query":{"a":true,"b":[1,{"a":null,"z":"' || coalesce(lang, '') || '"}]}}}' AS p, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)
SELECT doc_id, sha256('{"analysis_cache_version":"4","analysis_profile":' || p || ',"category":"' || coalesce(lang, '') || '","marlin_queries":{"k":[3,2,1],"q":"x"},"model_id":"' || source || '","prompt_template":"find \\"peaks\\"","proxy":{}}') AS fingerprint FROM c""")
def _(s, sf):
    d = table(s, sf, "documents").withColumn("profile", F.expr(PROFILES))
    swapped = F.when(C("doc_id") % 3 == 0, '{"q":"x","k":[3, 2, 1]}').otherwise('{"k":[3,2,1] , "q":"x"}')
    return d.select("doc_id", hashing.analysis_fingerprint(
        C("profile"), C("n_chars") / 10, category=F.coalesce("lang", F.lit("")), prompt=F.lit('find "peaks"'), queries=swapped, model_id=F.coalesce("source", F.lit("")), proxy=F.lit(None).cast("string"), version=F.lit("4")).alias("fingerprint"))


@query("difference_hash", "H16", with_views("frame", body="""SELECT frame_id, list_sum(list_transform(range(1, 64), lambda i:
  CASE WHEN luma[((i // 8) * 9 + i % 8) % 64 + 1] > luma[((i // 8) * 9 + i % 8 + 1) % 64 + 1] THEN 1::BIGINT << (63 - i) ELSE 0 END))::BIGINT
  + CASE WHEN luma[1] > luma[2] THEN -9223372036854775808 ELSE 0 END::BIGINT AS dhash FROM frame"""))
def _(s, sf):
    pixels = F.concat("luma", F.slice("luma", 1, 8))
    return views.frame(s, sf).select("frame_id", hashing.difference_hash(pixels).alias("dhash"))


@query("hash_distance", "H17", with_views("frame", body="""SELECT frame_id, bit_count(xor(hash, frame_id * 2654435761))::BIGINT AS distance,
 lpad(lower(to_hex(hash)), 16, '0') AS hex FROM frame"""))
def _(s, sf):
    f = views.frame(s, sf).select("frame_id", hashing.hash_to_hex(C("hash")).alias("hex"))
    return f.select("frame_id", "hex", hashing.hash_distance(hashing.hash_from_hex(C("hex")), C("frame_id") * F.lit(2654435761)).cast("long").alias("distance"))


WEIGHTS = {"view": 1.0, "click": 0.92, "purchase": 0.86, "signup": 0.55}
WEIGHT_SQL = "CASE event WHEN 'view' THEN 1.0::DOUBLE WHEN 'click' THEN 0.92::DOUBLE WHEN 'purchase' THEN 0.86::DOUBLE WHEN 'signup' THEN 0.55::DOUBLE ELSE payoff END"


@query("candidate_score", "H01", with_views("cand", body=f"""SELECT candidate_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  aesthetic * 0.22::DOUBLE + ({WEIGHT_SQL}) * 0.2::DOUBLE + payoff * 0.15::DOUBLE + action_intensity * 0.13::DOUBLE + subject_visibility * 0.1::DOUBLE
  + sharpness * 0.08::DOUBLE + composition * 0.07::DOUBLE + context_independence * 0.05::DOUBLE
  - (greatest(0.0::DOUBLE, (candidate_id % 11 - 5) / 100) + greatest(0.0::DOUBLE, (candidate_id % 7) / 200)))), 4) AS final_score FROM cand"""))
def _(s, sf):
    event_value = F.coalesce(scoring.literal_map(WEIGHTS)[C("event")], C("payoff"))
    penalties = F.create_map(F.lit("blur"), (C("candidate_id") % 11 - 5) / 100, F.lit("repeat"), C("candidate_id") % 7 / 200)
    return views.cand(s, sf).select("candidate_id", scoring.candidate_score(penalties, event_value).alias("final_score"))


@query("stable_candidate_id", "H02", with_views("cand", more={"b": """SELECT candidate_id, category, video_id,
  (round_even(start_ms / 250, 0) * 250)::BIGINT AS s, (round_even(end_ms / 250, 0) * 250)::BIGINT AS e FROM cand"""}, body="""
SELECT candidate_id, category || '_' || right(video_id::VARCHAR, 12) || '_' || lpad(s::VARCHAR, 7, '0') || '_' || lpad(e::VARCHAR, 7, '0') || '_'
 || left(sha256(category || '|' || video_id || '|' || s // 1000 || '.' || lpad((s % 1000 // 10)::VARCHAR, 2, '0') || '|' || e // 1000 || '.' || lpad((e % 1000 // 10)::VARCHAR, 2, '0')), 12) AS stable_id FROM b"""))
def _(s, sf):
    return views.cand(s, sf).select("candidate_id", scoring.stable_candidate_id(
        C("category"), C("video_id"), C("start_ms"), C("end_ms")).alias("stable_id"))


@query("tempo_traits", "H04 H07", with_views("bgm", body="""SELECT bgm_id, CASE WHEN x <= 0 THEN 'unknown' WHEN x >= 60 AND x < 90 THEN 'slow_lifestyle_emotion'
  WHEN x >= 90 AND x < 120 THEN 'general_seed' WHEN x BETWEEN 120 AND 150 THEN 'fast_mix_ads' WHEN x > 150 AND x <= 180 THEN 'impact_sport_transition' ELSE 'out_of_range' END AS band,
  CASE WHEN x <= 0 THEN 0 WHEN x >= 60 AND x < 90 THEN 0.55 WHEN x >= 90 AND x < 120 THEN 0.82 WHEN x BETWEEN 120 AND 150 THEN 1 WHEN x > 150 AND x <= 180 THEN 0.72 ELSE 0.35 END::DOUBLE AS fit,
  CASE WHEN music_score >= 0.72 THEN 'high' WHEN music_score >= 0.38 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN (music_score >= 0.7 AND x BETWEEN 120 AND 150) OR (music_score >= 0.55 AND x >= 90 AND x < 120) THEN 'beat_driven' WHEN speech_risk * 3 >= 0.72 THEN 'energy_peak' ELSE 'soft_bgm' END AS mode,
  CASE WHEN music_score >= 0.7 AND x BETWEEN 120 AND 150 THEN 1 WHEN music_score >= 0.55 AND x >= 90 AND x < 120 THEN 2 WHEN speech_risk * 3 >= 0.72 THEN NULL ELSE 4 END::INTEGER AS every,
  least(abs(x - 122), abs(x * 2 - 122), abs(x / 2 - 122))::DOUBLE AS distance FROM (SELECT *, bpm - 45 + bgm_id % 60 AS x FROM bgm)"""))
def _(s, sf):
    b = views.bgm(s, sf).withColumn("x", C("bpm") - 45 + C("bgm_id") % 60)
    cut = scoring.cut_strategy(C("x"), C("music_score"), C("speech_risk") * 3)
    return b.select("bgm_id", scoring.tempo_band(C("x")).alias("band"), scoring.tempo_fit(C("x")).alias("fit"),
                    scoring.level(C("music_score")).alias("level"), cut["mode"].alias("mode"), cut["cut_every_beats"].alias("every"),
                    scoring.octave_bpm_distance(C("x"), 122).cast("double").alias("distance"))


RISKS = """[CASE WHEN d >= 60 THEN 'long_audio' END, CASE WHEN bpm < 90 THEN 'slow_speech_like_bpm' END,
  CASE WHEN q >= 0.85 THEN 'strong_speech_like_onsets' END, CASE WHEN en BETWEEN 0.35 AND 0.82 THEN 'voice_level_energy' END,
  CASE WHEN d >= 60 AND st < 0.9 THEN 'less_music_like_stability' END]"""
RISK_CTE = {"i": "SELECT bgm_id, bpm, duration_ms / 250 AS d, music_score AS q, speech_risk * 2.5::DOUBLE AS en, (bgm_id * 3) % 101 / 100 AS st FROM bgm",
            "r": f"""SELECT bgm_id, list_filter({RISKS}, lambda x: x IS NOT NULL) AS reasons, round(least(1.0::DOUBLE, CASE WHEN d >= 60 THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN bpm < 90 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN q >= 0.85 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN en BETWEEN 0.35 AND 0.82 THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN d >= 60 AND st < 0.9 THEN 0.15::DOUBLE ELSE 0 END), 4) AS risk FROM i"""}


def risk_rows(s, sf):
    b = views.bgm(s, sf)
    return b.withColumn("r", scoring.voiceover_risk(
        C("duration_ms") / 250, C("bpm"), C("speech_risk") * 2.5, C("music_score"), C("bgm_id") * 3 % 101 / 100))


@query("voiceover_risk", "H05", with_views("bgm", more=RISK_CTE, body="""
SELECT bgm_id, risk AS risk_score, risk >= 0.7 AS detected, coalesce(array_to_string(reasons, ','), '') AS reasons, CASE WHEN risk >= 0.7 THEN 0 ELSE music_score END AS score FROM r JOIN bgm USING (bgm_id)"""))
def _(s, sf):
    return risk_rows(s, sf).select("bgm_id", "r.risk_score", "r.detected", F.array_join("r.reasons", ",").alias("reasons"),
                                   scoring.final_audio_score(C("music_score"), F.lit(True), C("r.detected")).alias("score"))


@query("asr_voiceover_decision", "H06", with_views("bgm", more={**RISK_CTE,
    "t": f"""SELECT doc_id, text, length(regexp_replace(text, '[{WS}]+', '', 'g')) AS n, risk, reasons, doc_id % 5 AS segs FROM documents JOIN r ON bgm_id = doc_id""",
    "v": "SELECT *, n >= 40 OR (segs >= 2 AND n > 0) AS vocal, list_contains(reasons, 'slow_speech_like_bpm') AS slow FROM t",
    "l": "SELECT *, vocal AND risk <= 0.35 AND NOT slow AS lyric FROM v",
    "z": """SELECT *, vocal AND NOT lyric AND (risk >= 0.55 OR slow OR len(list_intersect(reasons,
      ['slow_speech_like_bpm', 'strong_speech_like_onsets', 'less_music_like_stability'])) >= 2) AS det FROM l"""}, body="""
SELECT doc_id, det AS detected, CASE WHEN det THEN 'voiceover' WHEN lyric THEN 'lyrics_or_vocal_bgm' ELSE 'no_voiceover' END AS classification,
  n::BIGINT AS text_length, left(text, 120) AS sample_text, coalesce(array_to_string(list_sort(reasons), ','), '') AS reasons FROM z"""))
def _(s, sf):
    d = views.texts(s, sf).join(risk_rows(s, sf).select(C("bgm_id").alias("doc_id"), "r"), "doc_id")
    v = scoring.asr_voice_decision(C("text"), C("doc_id") % 5, C("r.risk_score"), C("r.reasons"), min_chars=40, min_segments=2)
    return d.select("doc_id", v.alias("v")).select("doc_id", "v.detected", "v.classification", C("v.text_length").cast("long").alias("text_length"),
                                                   "v.sample_text", F.array_join("v.reasons", ",").alias("reasons"))


PROMPT = "Review {{video_id}} ({{duration}} s).\n{{event_catalog}}\nRecalls: {{recall}}\nReturn {{count_min}}-{{count_max}}."
CATALOG = "- view: seen; keywords: eye, face\n- click: touch; keywords: hand"


@query("render_prompts", "H19", with_views("material", body=f"""SELECT video_id, 'Review ' || video_id || ' (' || (dur_ms // 1000) || '.' || lpad((dur_ms % 1000)::VARCHAR, 3, '0') || ' s).'
 || chr(10) || '{CATALOG}' || chr(10) || 'Recalls: ' || CASE WHEN dur_ms < 30000 THEN 'none' ELSE '[' || dur_ms || ']' END || chr(10) || 'Return 2-6.' AS prompt FROM material"""))
def _(s, sf):
    catalog = {"view": ("seen", ["eye", "face"]), "click": ("touch", ["hand"])}
    listed = "\n".join(f"- {k}: {label}; keywords: {', '.join(words)}" for k, (label, words) in catalog.items())
    m = views.material(s, sf)
    recall = F.when(C("dur_ms") < 30000, "none").otherwise(F.concat(F.lit("["), C("dur_ms").cast("string"), F.lit("]")))
    return m.select("video_id", text.render_template(PROMPT, {
        "event_catalog": F.lit(listed), "video_id": C("video_id"), "recall": recall, "count_min": F.lit(2), "count_max": F.lit(6),
        "duration": F.format_string("%d.%03d", (C("dur_ms") / 1000).cast("long"), C("dur_ms") % 1000)}).alias("prompt"))
