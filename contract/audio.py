"""Audio operators (survey 2.4, 2.5, 2.8)."""

from pyspark.sql import functions as F

from contract import views
from contract.base import query
from contract.views import table, with_views
from mediaquery.functions import text
from mediaquery.operators import audio
from mediaquery.session import cut_lineage

C = F.col
KEY = ["audio_id"]
FR = audio.Framing(sample_rate=2_205)  # frame 205, hop 50
WS = text.SPACE

CHAIN = {
    "tot": "SELECT audio_id, count(*) AS n FROM pcm GROUP BY 1",
    "fr": """SELECT f.audio_id, f.frame_idx, sqrt(avg(sample * sample)) AS rms FROM (SELECT audio_id, unnest(range(0, CASE WHEN n < 205 THEN 1 ELSE (n - 205) // 50 + 1 END)) AS frame_idx FROM tot) f
  JOIN pcm p ON p.audio_id = f.audio_id AND p.idx >= f.frame_idx * 50 AND p.idx < f.frame_idx * 50 + 205 GROUP BY 1, 2""",
    "rise": """SELECT audio_id, frame_idx, rms, coalesce(greatest(0, ln(1 + rms * 100) - lag(ln(1 + rms * 100)) OVER (PARTITION BY audio_id ORDER BY frame_idx)), 0) AS r FROM fr""",
    "ons": "SELECT audio_id, frame_idx, rms, avg(r) OVER (PARTITION BY audio_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS onset FROM rise",
    "ctr": "SELECT audio_id, frame_idx, onset - avg(onset) OVER (PARTITION BY audio_id) AS x, count(*) OVER (PARTITION BY audio_id) AS n FROM ons",
    "ac": """SELECT a.audio_id, l.lag, sum(a.x * b.x) AS score FROM ctr a JOIN (SELECT unnest(range(14, 45)) AS lag) l ON l.lag <= a.n - 1 JOIN ctr b ON b.audio_id = a.audio_id AND b.frame_idx = a.frame_idx + l.lag GROUP BY 1, 2""",
    "tempo": """SELECT t.audio_id, t.n AS n_frames, CASE WHEN s.lag IS NULL THEN 0 ELSE 60 * (2205 / 50) / s.lag END AS bpm, s.lag FROM (SELECT audio_id, count(*) AS n FROM ons GROUP BY 1) t LEFT JOIN
   (SELECT audio_id, lag FROM ac WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY audio_id ORDER BY score DESC, lag) = 1) s USING (audio_id)""",
    "pk": """SELECT audio_id, frame_idx, onset FROM (SELECT *, lag(onset) OVER o AS p, lead(onset) OVER o AS q, quantile_cont(onset, 0.75) OVER (PARTITION BY audio_id) AS th FROM ons
   WINDOW o AS (PARTITION BY audio_id ORDER BY frame_idx)) WHERE onset >= p AND onset >= q AND onset >= th""",
    "per": "SELECT audio_id, n_frames, greatest(1, round_even(44.1::DOUBLE * 60 / bpm, 0)::BIGINT) AS p FROM tempo WHERE bpm > 0",
    "walk": """SELECT audio_id, min(frame_idx) AS fr_at FROM pk JOIN per USING (audio_id) GROUP BY 1 UNION ALL
   SELECT w.audio_id, coalesce((SELECT k.frame_idx FROM pk k WHERE k.audio_id = w.audio_id AND k.frame_idx BETWEEN w.fr_at + p - greatest(2, p // 3) AND w.fr_at + p + greatest(2, p // 3)
     ORDER BY k.onset DESC, k.frame_idx LIMIT 1), w.fr_at + p) FROM walk w JOIN per USING (audio_id) WHERE w.fr_at + p < n_frames""",
}


def chain(upto, body):
    names = list(CHAIN)
    return with_views("pcm", recursive=True, more={n: CHAIN[n] for n in names[:names.index(upto) + 1]}, body=body)


def frames(s, sf):
    return audio.onset(audio.frame_rms(views.pcm(s, sf), KEY, FR), KEY)


def staged(s, sf):
    """The frame table as later steps read it: written once, since each of them scans it several times."""
    return cut_lineage(frames(s, sf))


@query("loudness", "D20", with_views("pcm", body="""SELECT audio_id, round(20 * log10(sqrt(avg(sample * sample))), 6) AS mean_db, round(20 * log10(max(abs(sample))), 6) AS peak_db FROM pcm GROUP BY 1"""))
def _(s, sf):
    return audio.loudness(views.pcm(s, sf), KEY).select("audio_id", F.round("mean_db", 6).alias("mean_db"), F.round("peak_db", 6).alias("peak_db"))


@query("adaptive_mix", "H03", with_views("pcm", more={
    "v": "SELECT audio_id, 20 * log10(sqrt(avg(sample * sample))) AS vm, 20 * log10(max(abs(sample))) AS vp, 20 * log10(sqrt(avg(sample * sample * 9))) AS mm FROM pcm GROUP BY 1",
    "g": "SELECT *, least(-16 - vm, -1 - vp) AS vg, least(0, -20 - mm) AS mg FROM v", "d": "SELECT *, least(0, vm + vg - 12 - (mm + mg)) AS dk FROM g"}, body="""
SELECT audio_id, round(vg, 3) AS voice_gain_db, round(pow(10, vg / 20), 6) AS voice_volume, round(mg, 3) AS music_gain_db, round(pow(10, mg / 20), 6) AS music_volume,
 round(dk, 3) AS ducking_db, round(pow(10, (mg + dk) / 20), 6) AS ducked_volume FROM d"""))
def _(s, sf):
    p = views.pcm(s, sf)
    return audio.adaptive_mix(audio.loudness(p, KEY), audio.loudness(p.withColumn("sample", C("sample") * 3), KEY), KEY)


@query("frame_rms", "E01", chain("fr", "SELECT audio_id, frame_idx, round(rms, 9) AS rms FROM fr"))
def _(s, sf):
    return audio.frame_rms(views.pcm(s, sf), KEY, FR).select("audio_id", "frame_idx", F.round("rms", 9).alias("rms"))


@query("smooth", "E02", with_views("pcm", body="""SELECT audio_id, idx, round(avg(sample) OVER (PARTITION BY audio_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS sample FROM pcm"""))
def _(s, sf):
    return audio.smooth(views.pcm(s, sf), KEY, "sample", 2, idx="idx", chunk=1024).withColumn("sample", F.round("sample", 9))


@query("onset", "E03", chain("ons", "SELECT audio_id, frame_idx, round(onset, 9) AS onset FROM ons"))
def _(s, sf):
    return frames(s, sf).select("audio_id", "frame_idx", F.round("onset", 9).alias("onset"))


@query("estimate_bpm", "E04", chain("tempo", "SELECT audio_id, coalesce(lag, 0)::INTEGER AS lag, round(bpm, 3) AS bpm FROM tempo"))
def _(s, sf):
    return audio.estimate_bpm(staged(s, sf), KEY, FR).select("audio_id", "lag", F.round("bpm", 3).alias("bpm"))


@query("local_peaks", "E05", chain("pk", "SELECT audio_id, frame_idx, round(onset, 9) AS onset FROM pk"))
def _(s, sf):
    return audio.local_peaks(staged(s, sf), KEY).select("audio_id", "frame_idx", F.round("onset", 9).alias("onset"))


@query("track_beats", "E06", chain("walk", "SELECT audio_id, fr_at::BIGINT AS frame_idx, round(fr_at * 50 / 2205, 3) AS beat FROM walk"))
def _(s, sf):
    f = staged(s, sf)
    beats = audio.track_beats(f, audio.estimate_bpm(f, KEY, FR), KEY, FR)
    return beats.withColumn("beat", F.round(C("frame_idx") * FR.hop / FR.sample_rate, 3))


@query("downsample", "E07", with_views("pcm", more={"n": "SELECT audio_id, idx, sample, count(*) OVER (PARTITION BY audio_id) AS n FROM pcm"}, body="""
SELECT audio_id, b AS point, round(avg(sample), 3) AS sample FROM n JOIN (SELECT unnest(range(0, 64)) AS b) ON idx >= b * n // 64 AND idx < (b + 1) * n // 64 GROUP BY 1, 2"""))
def _(s, sf):
    return audio.downsample(views.pcm(s, sf), KEY, "sample", 64, idx="idx")


@query("beat_intervals", "E08", chain("walk", """SELECT audio_id, count(*) AS beats, round(avg(g), 6) AS mean_gap, CASE WHEN count(*) >= 4 THEN round(greatest(0, least(1, 1 - stddev_pop(g) / avg(g))), 4) ELSE 0 END AS stability
FROM (SELECT audio_id, lead(fr_at) OVER (PARTITION BY audio_id ORDER BY fr_at) * 50 / 2205 - fr_at * 50 / 2205 AS g FROM walk) GROUP BY 1"""))
def _(s, sf):
    f = staged(s, sf)
    beats = audio.track_beats(f, audio.estimate_bpm(f, KEY, FR), KEY, FR)
    return audio.beat_intervals(beats, KEY, FR).select("audio_id", "beats", F.round("mean_gap", 6).alias("mean_gap"), "stability")


FEATURES = {**CHAIN,
    "st": """SELECT audio_id, count(*) AS beats, CASE WHEN count(*) >= 4 THEN round(greatest(0, least(1, 1 - stddev_pop(g) / avg(g))), 4) ELSE 0 END AS stability
  FROM (SELECT audio_id, lead(fr_at) OVER (PARTITION BY audio_id ORDER BY fr_at) * 50 / 2205 - fr_at * 50 / 2205 AS g FROM walk) GROUP BY 1""",
    "bq": "SELECT w.audio_id, avg(onset) AS b FROM walk w JOIN ons o ON o.audio_id = w.audio_id AND o.frame_idx = floor(w.fr_at * 50 / 2205 * 2205 / 50) GROUP BY 1",
    "ag": "SELECT audio_id, avg(rms) AS mean_rms, quantile_cont(rms, 0.95) AS r95, quantile_cont(onset, 0.95) AS o95 FROM ons GROUP BY 1",
    "z": """SELECT audio_id, round(bpm, 3) AS bpm, coalesce(beats, 0) AS beats, round(mean_rms, 6) AS mean_rms, round(least(1, mean_rms / r95), 4) AS energy, round(least(1, coalesce(b, 0) / o95), 4) AS beat_quality,
  coalesce(stability, 0) AS stability, CASE WHEN bpm <= 0 THEN 0 WHEN bpm < 90 THEN 0.55 WHEN bpm < 120 THEN 0.82 WHEN bpm <= 150 THEN 1 WHEN bpm <= 180 THEN 0.72 ELSE 0.35 END::DOUBLE AS fit
  FROM ag JOIN tempo USING (audio_id) LEFT JOIN st USING (audio_id) LEFT JOIN bq USING (audio_id)"""}
RAW_SCORE = "round(beat_quality * 0.4::DOUBLE + energy * 0.25::DOUBLE + stability * 0.2::DOUBLE + fit * 0.15::DOUBLE, 4)"


@query("audio_features", "D23", with_views("pcm", recursive=True, more=FEATURES, body=f"SELECT audio_id, bpm, beats, mean_rms, energy, beat_quality, stability, {RAW_SCORE} AS raw_score FROM z"))
def _(s, sf):
    out = audio.audio_features(views.pcm(s, sf), KEY, FR, minimum_seconds=1.0)
    return out.select("audio_id", F.round("bpm", 3).alias("bpm"), "beats", F.round("mean_rms", 6).alias("mean_rms"), "energy", "beat_quality", "stability", "raw_score")


# Every window is a track of its own, numbered track * 2^32 + start; windows of a second score their raw score, as the
# rules of long audio can't apply and the others stay under the bar.
WINDOWS = {
    "len": "SELECT audio_id AS track, count(*) AS n FROM pcm0 GROUP BY 1",
    "win": """SELECT track, least(n, 1500) AS size, unnest(range(0, n - 1500 + 1, 500)) AS start FROM len WHERE n > 1600 UNION ALL SELECT track, n, 0 FROM len WHERE n <= 1600
  UNION ALL SELECT track, 1500, n - 1500 FROM len WHERE n > 1600 AND (n - 1500) % 500 > 150""",
    "pcm": "SELECT track * 4294967296 + start AS audio_id, idx - start AS idx, sample FROM win JOIN pcm0 ON pcm0.audio_id = track AND idx >= start AND idx < start + size"}


def renamed_pcm(more, body):
    """The views with the driver's samples as ``pcm0``."""
    return with_views("pcm", recursive=True, more=more, body=body).replace("pcm AS (", "pcm0 AS (", 1)


@query("best_window", "E24", renamed_pcm({**WINDOWS, **FEATURES}, f"""
SELECT track AS audio_id, start, start + size AS "end", score FROM (SELECT track, start, size, {RAW_SCORE} AS score FROM win JOIN z ON audio_id = track * 4294967296 + start)
QUALIFY row_number() OVER (PARTITION BY track ORDER BY score DESC, start) = 1"""))
def _(s, sf):
    return audio.best_window(views.pcm(s, sf), "audio_id", FR, target=1_500, step=500, slack=100, final_gap=150)


@query("tag_group_scores", "D10", with_views("tags", more={"t": "SELECT clip_id, lower(label) AS l, score FROM tags"}, body="""
SELECT clip_id, coalesce(max(score) FILTER (contains(l, 'music') OR contains(l, 'musical instrument')), 0) AS music,
 coalesce(max(score) FILTER (contains(l, 'singing') OR contains(l, 'choir') OR contains(l, 'vocal music')), 0) AS singing,
 coalesce(max(score) FILTER (contains(l, 'rap') OR contains(l, 'hip hop')), 0) AS rap,
 coalesce(max(score) FILTER (contains(l, 'speech') OR contains(l, 'narration') OR contains(l, 'conversation')), 0) AS speech FROM t GROUP BY 1"""))
def _(s, sf):
    return audio.tag_group_scores(views.tags(s, sf))


TAGS = "SELECT clip_id, label, CASE WHEN label IN ('Scrape, ambient', 'Rap', 'Singing') THEN score * 0.2::DOUBLE ELSE score END AS score FROM tags"


@query("classify_audio", "D11", with_views("tags", more={
    "g": f"""SELECT clip_id, coalesce(max(score) FILTER (contains(lower(label), 'music')), 0) AS music, coalesce(max(score) FILTER (contains(lower(label), 'singing')), 0) AS singing,
  coalesce(max(score) FILTER (contains(lower(label), 'rap')), 0) AS rap, coalesce(max(score) FILTER (contains(lower(label), 'speech')), 0) AS speech FROM ({TAGS}) GROUP BY 1""",
    "d": f"SELECT g.*, greatest(singing, rap) AS sung, coalesce(length(regexp_replace(text, '[{WS}]+', '', 'g')) / 300, 0) AS density FROM g LEFT JOIN documents ON doc_id::VARCHAR = split_part(clip_id, '/', 1)",
    "k": """SELECT *, CASE WHEN music < 0.12 AND speech >= 0.25 THEN 'speech_only' WHEN rap >= 0.15 THEN 'rap_song' WHEN sung >= 0.15 THEN 'song_with_lyrics'
  WHEN music >= 0.2 AND speech >= 0.3 AND density >= 0.8 THEN 'music_with_spoken_overlay' WHEN music >= 0.2 AND speech < 0.3 THEN 'instrumental' WHEN music < 0.12 THEN 'ambient_only' ELSE 'uncertain' END AS audio_type FROM d"""}, body="""
SELECT clip_id, audio_type, round(music, 4) AS music_probability, round(speech, 4) AS speech_probability, round(sung, 4) AS singing_probability, round(density, 4) AS text_density,
 round(CASE WHEN audio_type IN ('song_with_lyrics', 'rap_song') THEN greatest(0, speech - sung * 0.8::DOUBLE) ELSE speech END, 4) AS speech_risk FROM k"""))
def _(s, sf):
    tags = views.tags(s, sf).withColumn("score", F.expr("if(label in ('Scrape, ambient', 'Rap', 'Singing'), score * cast(0.2 as double), score)"))
    groups = audio.tag_group_scores(tags)
    docs = views.texts(s, sf).select(C("doc_id").cast("string").alias("__d"), text.text_density(C("text"), F.lit(300.0)).alias("density"))
    texts = groups.select("clip_id", F.split_part("clip_id", F.lit("/"), F.lit(1)).alias("__d")).join(docs, "__d")
    return audio.classify_audio(groups, texts)


@query("transcript_text", "D12", with_views("transcript", more={
    "h": f"SELECT conv_id, text, lang FROM (SELECT DISTINCT conv_id FROM transcript) LEFT JOIN documents ON doc_id = conv_id",
    "j": f"SELECT conv_id, string_agg(x, ' ' ORDER BY turn) AS t FROM (SELECT conv_id, turn, regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') AS x FROM conversations) WHERE x <> '' GROUP BY 1"}, body=f"""
SELECT conv_id, coalesce(nullif(regexp_replace(coalesce(nullif(text, ''), lang, ''), '^[{WS}]+|[{WS}]+$', '', 'g'), ''), t, '') AS text FROM h LEFT JOIN j USING (conv_id)"""))
def _(s, sf):
    docs = table(s, sf, "documents").selectExpr("doc_id conv_id", "text", "lang transcript")
    heads = table(s, sf, "conversations").select("conv_id").distinct().join(docs, "conv_id", "left")
    segments = table(s, sf, "conversations").select("conv_id", C("turn").alias("ord"), "text")
    return audio.transcript_text(heads, segments, "conv_id")


@query("sampled_fingerprint", "H20", with_views("pcm", more={"n": "SELECT audio_id, greatest(1, count(*) // 512) AS step FROM pcm GROUP BY 1"}, body="""
SELECT audio_id, sha256(string_agg(round(sample * 32768)::INTEGER::VARCHAR, ',' ORDER BY idx) || '|' || (100 + audio_id) || '.5|0.500,0.250') AS fingerprint FROM pcm JOIN n USING (audio_id)
WHERE idx % step = 0 AND idx // step < 512 GROUP BY audio_id"""))
def _(s, sf):
    p = views.pcm(s, sf)
    feats = p.groupBy("audio_id").agg((F.first("audio_id") + 100.5).alias("bpm")).withColumn("curve", F.array(F.lit(0.5), F.lit(0.25)))
    return audio.sampled_fingerprint(p, feats, "audio_id", limit=512)
