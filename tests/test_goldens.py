"""Known inputs and results of single operators."""

from pyspark.sql import functions as F

from mediaquery.functions import scoring, text
from mediaquery.operators import audio, dedupe, filters, intervals, ledger, ranking, subtitles

C = F.col


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_segment_windows(spark):
    m = spark.createDataFrame([(1, 188_600), (2, 29_000), (3, 120_000)], "video_id int, dur_ms long")
    out = rows(intervals.segment_windows(m).select("video_id", "start_ms", "end_ms"), "video_id", "start_ms")
    assert out == [(1, 0, 115_000), (1, 110_000, 188_600), (2, 0, 29_000), (3, 0, 120_000)]


def test_rebase(spark):
    df = spark.createDataFrame([(110_000, 3_000, 5_500)], "o long, a long, b long")
    assert rows(intervals.rebase_times(df, "o", ["a", "b"]), "o") == [(110_000, 113_000, 115_500)]


def test_precise_recall_displaces_broad(spark):
    schema = "video_id int, recall_id int, dur_ms long, ok boolean, query_group string, description string, start_ms long, end_ms long"
    both = spark.createDataFrame([(1, 1, 114_000, True, "a", "x", 0, 114_000), (1, 2, 114_000, True, "b", "y", 54_000, 56_000)], schema)
    assert rows(dedupe.review_windows(both).select("start_ms", "end_ms"), "start_ms") == [(52_500, 57_500)]
    broad = both.where("recall_id = 1")
    assert rows(dedupe.review_windows(broad).select("start_ms", "end_ms"), "start_ms") == [(51_000, 63_000)]


def test_suppression(spark):
    c = spark.createDataFrame([(1, "weak", 0.5, 1000, 3000, 0), (1, "strong", 0.9, 1200, 2900, 1), (1, "distinct", 0.7, 5000, 7000, 2)],
                              "video_id int, candidate_id string, confidence double, start_ms long, end_ms long, position int")
    assert [r[0] for r in rows(dedupe.suppress_overlaps(c).select("candidate_id"), "start_ms")] == ["strong", "distinct"]


def test_loop_beats(spark):
    beats = spark.createDataFrame([(1, b, 9_684) for b in (69, 1058, 2000, 3000, 4000, 5000, 6000, 7000, 8000, 8900, 9500)], "track_id int, beat_ms long, dur_ms long")
    found = {r[0] for r in intervals.loop_beats(beats, 17_500).select("beat_ms").collect()}
    assert {9_753, 10_742, 11_684} <= found and max(found) <= 17_500


def test_slots_tile_their_section(spark):
    beats = spark.createDataFrame([(1, b) for b in range(300, 17_500, 690)], "track_id int, beat_ms long")
    for start, end in ((0, 7_200), (12_800, 17_500)):
        out = rows(intervals.build_slots(beats, start, end).select("start_ms", "end_ms"), "start_ms")
        assert out[0][0] == start and out[-1][1] == end and all(a[1] == b[0] for a, b in zip(out, out[1:]))
    lone = intervals.build_slots(beats.where("beat_ms < 0"), 0, 7_200, keys=beats)
    assert rows(lone.select("start_ms", "end_ms"), "start_ms") == [(0, 7_200)]


def test_gap_is_reported(spark):
    t = spark.createDataFrame([("c", 1, "a", 0, 6_691), ("c", 2, "b", 7_200, 20_000)], "creative_id string, pos int, clip_id string, start_ms long, end_ms long")
    assert [r[0] for r in intervals.timeline_errors(t, 20_000).select("error").collect()] == ["gap: a/b 6.691-7.200"]


def test_audio_classes(spark):
    tags = spark.createDataFrame([("song", "Music", 0.6), ("song", "Singing", 0.5), ("song", "Speech", 0.4), ("talk", "Music", 0.5), ("talk", "Speech", 0.7)],
                                 "clip_id string, label string, score double")
    texts = spark.createDataFrame([("song", 1.0), ("talk", 2.0)], "clip_id string, density double")
    out = {r["clip_id"]: r for r in audio.classify_audio(audio.tag_group_scores(tags), texts).collect()}
    assert out["song"]["audio_type"] == "song_with_lyrics" and out["song"]["speech_risk"] < 0.18
    assert out["talk"]["audio_type"] == "music_with_spoken_overlay" and out["talk"]["speech_risk"] > 0.18


def test_short_track_is_not_chosen(spark):
    b = spark.createDataFrame([("short", "c", "f1", 122.0, 0.99, 0.0, 4_900, 0, 1, 1), ("long", "c", "f2", 122.0, 0.70, 0.0, 5_000, 0, 2, 1)],
                              "bgm_id string, category string, fingerprint string, bpm double, music_score double, speech_risk double, duration_ms long, exported_count int, updated_at int, eligible int")
    assert [r[0] for r in rows(ranking.select_bgms(b, 3).select("bgm_id"), "bgm_id")] == ["long", "long"]


def test_ledger_round_trip(spark):
    reg = spark.createDataFrame([("a", "eligible", 0, 0, None, None)], "candidate_id string, status string, selected_count long, exported_count long, last_run_id string, last_creative_id string")
    book = spark.createDataFrame([], "candidate_id string, run_id string, creative_id string, state string")
    want = spark.createDataFrame([("a", "r1", "c1", 1), ("a", "r1", "c1", 2)], "candidate_id string, run_id string, creative_id string, seq int")
    reg1, book1 = ledger.reserve(reg, book, want)
    assert rows(reg1.select("selected_count", "last_run_id"), "selected_count") == [(1, "r1")]
    reg2, book2 = ledger.reserve(reg1, book1, want)
    assert reg2.first()["selected_count"] == 1 and book2.count() == 1
    done = spark.createDataFrame([("r1", None, "committed")], "run_id string, creative_id string, decision string")
    reg3, book3 = ledger.finalize(reg2, book2, done)
    assert (reg3.first()["exported_count"], reg3.first()["status"], book3.first()["state"]) == (1, "used", "committed")
    again, _ = ledger.finalize(reg3, book3, done)
    assert again.first()["exported_count"] == 1


def test_wrap_text(spark):
    df = spark.createDataFrame([("one two three four five six seven eight",), ("春夏秋冬山水火木金土日月星云风雨雪花",), ("",)], "t string")
    out = [r[0] for r in df.select(text.wrap_text(C("t"), 14)).collect()]
    assert out[0].replace("\n", " ") == "one two three four five six seven eight" and all(len(x) <= 14 for x in out[0].split("\n"))
    assert [len(x) for x in out[1].split("\n")] == [7, 7, 4] and out[2] == ""


def test_transcript_markup(spark):
    df = spark.createDataFrame([('{"text":"[0.15][S01]Hallo Welt.[6.13]"}',), ("[1][S02] a [2.5] x [3][S01]b[4]",), ("none",)], "raw string")
    out = [r[0] for r in df.select(text.transcript_segments(C("raw"))).collect()]
    assert [(s["start"], s["end"], s["speaker"], s["text"]) for s in out[0]] == [(0.15, 6.13, "S01", "Hallo Welt.")]
    assert [s["text"] for s in out[1]] == ["a", "b"] and out[2] == []


def test_subtitles_snap_to_silence(spark):
    df = spark.createDataFrame([("s", "一键换出不同风格，清新甜美气质妆，马上打开应用，今天就来试试", 6.32, [1.062, 3.077, 4.739], None)],
                               "script_id string, text string, audio_seconds double, silences array<double>, speaker string")
    out = rows(subtitles.align_subtitles(df).select("start", "end", "speaker"), "start")
    assert [e for _, e, _ in out] == [1.062, 3.077, 4.739, 6.32] and out[0][0] == 0.0 and out[0][2] == "S01"


def test_file_names(spark):
    paths = ["/x/彩妆-眼妆_@foo_bar_西班牙_西班牙语_69f3dfc9000000003503b0a4.mp4", "/x/plain.mp4", "/x/a-b_@n_m_l_.mp4", "/x/好物-口红_x*@作者 名*_z.mp4"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    out = filters.parse_material_names(df).orderBy("i").collect()
    assert (out[0]["author"], out[0]["market"], out[0]["note_id"], out[0]["source_category"]) == ("@foo_bar", "西班牙", "69f3dfc9000000003503b0a4", "眼妆")
    assert out[1]["error"] == text.NAME_ERROR and out[2]["error"] == text.NOTE_ERROR
    names = df.select(text.author_overlay_name(C("path")).alias("o"), text.author_key(C("path"), C("i")).alias("k")).collect()
    assert [r["o"] for r in names] == ["@foo_bar", "", "@n_m", "@作者 名"] and names[3]["k"] == "@作者 名" and names[1]["k"] == "1"


def test_stable_id_absorbs_drift(spark):
    df = spark.createDataFrame([(1_240, 3_010), (1_260, 2_990), (1_125, 3_000)], "s long, e long")
    ids = [r[0] for r in df.select(scoring.stable_candidate_id(F.lit("beauty"), F.lit("video-123456789012"), C("s"), C("e"))).collect()]
    assert ids[0] == ids[1] and ids[0].startswith("beauty_123456789012_0001250_0003000_") and "_0001000_" in ids[2]


def test_wrapped_lines_of_a_long_text_take_linear_time():
    words = ["ab", "中文", "x", "😀y"] * 50_000
    lines = text._wrapped_lines(" ".join(words), 28)
    assert " ".join(lines) == " ".join(words)
    width = lambda line: sum(1 + text._is_wide(c) for c in line)
    assert max(map(width, lines)) <= 28
    assert all(width(a) + 1 + width(b.split(" ")[0]) > 28 for a, b in zip(lines, lines[1:]))


def test_chunks_strip_a_text_once(spark):
    """A text is stripped, and a clause list built, once per row, not for every use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" 你好，世界。再见 ",), (" One two. Three! ",), (None,), ("",)], "t string")
    chunks = text.semantic_chunks(F.col("t"))
    shown = df.select(chunks.alias("c"))
    assert [r["c"] for r in shown.collect()] == [["你好", "世界再见"], ["One two.", "Three!"], None, []]
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(t#") == 1
