"""Greedy, folded and aligned sequences (survey 2.3, 2.5, 2.6)."""

from pyspark.sql import functions as F

from contract import views
from contract.base import query
from contract.filters import CHUNKS, CJK, COUNT, script
from contract.views import table, with_views
from mediaquery.functions import text
from mediaquery.operators import dedupe, subtitles

C = F.col

SUPPRESS = {
    "rk": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, candidate_id) AS r FROM cand",
    "walk": """SELECT video_id, 1::BIGINT AS r, [struct_pack(i := candidate_id, s := start_ms, e := end_ms)] AS kept FROM rk WHERE r = 1 UNION ALL
  SELECT w.video_id, w.r + 1, CASE WHEN len(list_filter(w.kept, lambda k: least(k.e, c.end_ms) - greatest(k.s, c.start_ms) >= 0.75 * greatest(1, least(k.e - k.s, c.end_ms - c.start_ms)))) > 0 THEN w.kept
    ELSE list_append(w.kept, struct_pack(i := c.candidate_id, s := c.start_ms, e := c.end_ms)) END FROM walk w JOIN rk c ON c.video_id = w.video_id AND c.r = w.r + 1""",
    "keep": "SELECT unnest(list_transform(kept, lambda k: k.i)) AS candidate_id FROM (SELECT video_id, arg_max(kept, r) AS kept FROM walk GROUP BY 1)",
}


@query("suppress_overlaps", "F01", with_views("cand", recursive=True, more=SUPPRESS, body="SELECT c.video_id, c.candidate_id, c.start_ms, c.end_ms FROM cand c JOIN keep USING (candidate_id)"))
def _(s, sf):
    c = views.cand(s, sf).select("video_id", "candidate_id", "start_ms", "end_ms", "confidence", C("candidate_id").alias("position"))
    return dedupe.suppress_overlaps(c).select("video_id", "candidate_id", "start_ms", "end_ms")


@query("review_windows", "E11", with_views("recall", recursive=True, more={
    "u": "SELECT *, greatest(0, least(dur_ms, start_ms)) AS s0, greatest(greatest(0, least(dur_ms, start_ms)), least(dur_ms, end_ms)) AS e0 FROM recall WHERE ok",
    "v": "SELECT *, max(e0 - s0 <= 30000) OVER (PARTITION BY video_id) AS anyp FROM u WHERE e0 > s0",
    "w": """SELECT video_id, recall_id, query_group, description, CASE WHEN wide THEN greatest(0, least(dur_ms, c + 12000) - 12000) ELSE s END AS s, CASE WHEN wide THEN least(dur_ms, c + 12000) ELSE e END AS e
  FROM (SELECT *, greatest(0, s0 - 1500) AS s, least(dur_ms, e0 + 1500) AS e, least(dur_ms, e0 + 1500) - greatest(0, s0 - 1500) > 12000 AS wide, greatest(0, floor((s0 + e0 - 12000) / 2)::BIGINT) AS c
    FROM v WHERE e0 - s0 <= 30000 OR NOT anyp)""",
    "o": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, e, recall_id) AS r FROM w",
    "walk": """SELECT video_id, r, s AS cs, e AS ce, 1::BIGINT AS win, TRUE AS member FROM o WHERE r = 1 UNION ALL
  SELECT k.video_id, o.r, CASE WHEN fits OR same THEN cs ELSE o.s END, CASE WHEN fits THEN greatest(ce, o.e) WHEN same THEN ce ELSE o.e END, CASE WHEN fits OR same THEN win ELSE win + 1 END, fits OR NOT same
  FROM (SELECT walk.*, o.s, o.e, o.s <= ce AND greatest(ce, o.e) - cs <= 12000 AS fits, abs(o.s - cs) <= 10 AND abs(o.e - ce) <= 10 AS same FROM walk JOIN o ON o.video_id = walk.video_id AND o.r = walk.r + 1) k
  JOIN o ON o.video_id = k.video_id AND o.r = k.r + 1""",
    "m": "SELECT walk.video_id, win, cs, max(ce) OVER (PARTITION BY walk.video_id, win) AS ce, walk.r, o.query_group, o.description, member FROM walk JOIN o ON o.video_id = walk.video_id AND o.r = walk.r WHERE win <= 8",
    "g": "SELECT video_id, win, string_agg(query_group, ',' ORDER BY r) AS q FROM (SELECT video_id, win, query_group, min(r) AS r FROM m WHERE member GROUP BY ALL) GROUP BY 1, 2",
    "d": "SELECT video_id, win, string_agg(description, ',' ORDER BY r) AS d FROM (SELECT video_id, win, description, min(r) AS r FROM m WHERE member GROUP BY ALL) GROUP BY 1, 2"}, body="""
SELECT video_id, win::INTEGER AS "window", any_value(cs) AS start_ms, any_value(ce) AS end_ms, any_value(q) AS query_groups, any_value(d) AS descriptions FROM m JOIN g USING (video_id, win) JOIN d USING (video_id, win) GROUP BY 1, 2"""))
def _(s, sf):
    out = dedupe.review_windows(views.recall(s, sf))
    return out.select("video_id", "window", "start_ms", "end_ms", F.array_join("query_groups", ",").alias("query_groups"), F.array_join("descriptions", ",").alias("descriptions"))


@query("hash_near_duplicates", "C12", with_views("frame", more={"p": "SELECT hash FROM frame WHERE frame_id < 1000000"}, body="""
SELECT f.frame_id, n.d AS nearest, n.d IS NOT NULL AS duplicate FROM frame f LEFT JOIN (SELECT f.frame_id, min(bit_count(xor(f.hash, p.hash)))::INTEGER AS d FROM frame f JOIN p ON bit_count(xor(f.hash, p.hash)) <= 10 GROUP BY 1) n USING (frame_id)
WHERE f.frame_id >= 1000000"""))
def _(s, sf):
    f = views.frame(s, sf).select("frame_id", "hash")
    return dedupe.hash_near_duplicates(f.where("frame_id >= 1000000"), f.where("frame_id < 1000000")).select("frame_id", "nearest", "duplicate")


WEIGHT = f"greatest(1.0::DOUBLE, {COUNT('t', f'[{CJK}]')} + {COUNT('t', '[A-Za-z]+')} * 1.4::DOUBLE + {COUNT('t', f'[{text.DIGIT}]')} * 1.2::DOUBLE)"
ALIGN = {
    **CHUNKS,
    "pc": f"SELECT doc_id, i, t, {WEIGHT} AS w FROM (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM chunks)",
    "cw": "SELECT doc_id, i, t, sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY doc_id) AS tot, count(*) OVER (PARTITION BY doc_id) AS n FROM pc",
    "dd": "SELECT doc_id, length(text) * 0.07::DOUBLE AS total, list_transform(range(1, (length(text) * 70 // 1310 + 1)), lambda k: k * 1310 / 1000) AS sil FROM documents",
    "us": "SELECT doc_id, total, list_filter(sil, lambda x: x >= 0.45 AND x <= total - 0.45) AS usable FROM dd",
    "walk": """SELECT doc_id, 0::BIGINT AS i, 0.0::DOUBLE AS b FROM dd UNION ALL
  SELECT k.doc_id, k.i, coalesce(CASE WHEN len(k.c) > 0 THEN list_reduce(k.c, lambda p, q: CASE WHEN abs(q - k.ideal) < abs(p - k.ideal) THEN q ELSE p END) END, greatest(k.b + 0.45::DOUBLE, least(k.ideal, k.latest))) FROM (
   SELECT w.doc_id, c.i, w.b, us.total * c.run / c.tot AS ideal, us.total - 0.45::DOUBLE * (c.n - c.i) AS latest, list_filter(us.usable, lambda x: x >= w.b + 0.45::DOUBLE AND x <= us.total - 0.45::DOUBLE * (c.n - c.i)) AS c
   FROM walk w JOIN cw c ON c.doc_id = w.doc_id AND c.i = w.i + 1 AND c.i < c.n JOIN us ON us.doc_id = w.doc_id) k""",
}


@query("nearest_boundary", "C11", with_views("transcript", recursive=True, more={
    "k": "SELECT conv_id, list(end_ms / 1000 - 0.25::DOUBLE ORDER BY turn) AS sil, max(end_ms) / 1000 AS total, count(*) + 3 AS n FROM transcript GROUP BY 1",
    "us": "SELECT *, list_filter(sil, lambda x: x >= 0.45 AND x <= total - 0.45) AS usable FROM k",
    "walk": """SELECT conv_id, 0::BIGINT AS i, 0.0::DOUBLE AS b FROM us UNION ALL
  SELECT z.conv_id, z.i, coalesce(CASE WHEN len(z.c) > 0 THEN list_reduce(z.c, lambda p, q: CASE WHEN abs(q - z.ideal) < abs(p - z.ideal) THEN q ELSE p END) END, greatest(z.b + 0.45::DOUBLE, least(z.ideal, z.latest))) FROM (
   SELECT w.conv_id, w.i + 1 AS i, w.b, total * (w.i + 1) / n AS ideal, total - 0.45::DOUBLE * (n - w.i - 1) AS latest, list_filter(usable, lambda x: x >= w.b + 0.45::DOUBLE AND x <= total - 0.45::DOUBLE * (n - w.i - 1)) AS c
   FROM walk w JOIN us USING (conv_id) WHERE w.i + 1 < n) z"""}, body="SELECT conv_id, i::INTEGER AS cut, round(b, 3) AS at_s FROM walk WHERE i > 0"))
def _(s, sf):
    t = views.transcript(s, sf).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(C("end_ms") / 1000 - 0.25)).alias("silences"), (F.max("end_ms") / 1000).alias("total"), (F.count("*") + 3).alias("n"))
    ideal = F.transform(F.sequence(F.lit(1).cast("long"), C("n") - 1), lambda i: C("total") * i / C("n"))
    cut = t.withColumn("cuts", subtitles.nearest_boundaries(ideal, C("silences"), C("total")))
    return cut.select("conv_id", F.posexplode("cuts").alias("cut", "at_s")).select("conv_id", (C("cut") + 1).alias("cut"), F.round("at_s", 3).alias("at_s"))


@query("align_subtitles", "E19", with_views(recursive=True, more=ALIGN, body="""
SELECT c.doc_id AS script_id, c.i::INTEGER AS line, c.t AS text, round(a.b, 3) AS start, round(CASE WHEN c.i = c.n THEN us.total ELSE z.b END, 3) AS "end" FROM cw c JOIN us ON us.doc_id = c.doc_id
JOIN walk a ON a.doc_id = c.doc_id AND a.i = c.i - 1 LEFT JOIN walk z ON z.doc_id = c.doc_id AND z.i = c.i"""))
def _(s, sf):
    size = C("chars")
    quiet = F.when(F.floor(size * 70 / 1310) >= 1, F.transform(F.sequence(F.lit(1).cast("long"), F.floor(size * 70 / 1310)), lambda k: k * 1310 / 1000))
    scripts = script(s, sf, F.char_length("text").alias("chars")).select(
        C("doc_id").alias("script_id"), "text", (size * 0.07).alias("audio_seconds"), F.coalesce(quiet, F.array().cast("array<double>")).alias("silences"), F.lit("S01").alias("speaker"))
    return subtitles.align_subtitles(scripts).select("script_id", "line", "text", "start", "end")
