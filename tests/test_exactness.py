"""Parallel forms against plain sequential definitions on small random data, with tiny bounds and chunks."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaquery.functions.ordered import exact_percentiles, ordered_scan
from mediaquery.operators import allocate, audio, dedupe, intervals

C = F.col


def test_ordered_scan_equals_plain_windows(spark):
    rng = random.Random(1)
    data = [(rng.randrange(3), rng.randrange(500), i, rng.randrange(100)) for i in range(800)]
    df = spark.createDataFrame(data, "k int, t int, id int, v int")
    order = [C("t"), C("id")]
    got = ordered_scan(df, ["k"], order, F.floor(C("t") / 37), rank="r", size="n", running_sum={"s": C("v")}, prior_max={"m": C("v")}, lead={"nx": C("id")}, lag={"pv": C("v")})
    w = W.partitionBy("k").orderBy(*order)
    want = df.select("*", F.row_number().over(w).alias("r"), F.count("*").over(W.partitionBy("k")).alias("n"), F.sum("v").over(w).alias("s"),
                     F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("m"), F.lead("id").over(w).alias("nx"), F.lag("v").over(w).alias("pv"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_percentiles(spark, buckets):
    rng = np.random.default_rng(2)
    data = [(k, float(v)) for k in range(3) for v in np.round(rng.random(50 + k), 2)] + [(9, 0.25)] * 5
    out = exact_percentiles(spark.createDataFrame(data, "k int, v double"), ["k"], "v", {"a": 0.75, "b": 0.95, "c": 0.0}, buckets).collect()
    for r in out:
        values = [v for k, v in data if k == r["k"]]
        assert np.allclose([r["a"], r["b"], r["c"]], np.percentile(values, [75, 95, 0]))
    assert len(out) == 4


@pytest.mark.parametrize("bound", [8, 10_000])
def test_suppression_rounds(spark, bound):
    rng = random.Random(3)
    data = []
    for i in range(600):
        video, start = (0 if rng.random() < 0.5 else rng.randrange(1, 30)), rng.randrange(0, 20_000)
        data.append((video, i, rng.randrange(50) / 50, start, start + rng.randrange(400, 4_000), i))
    df = spark.createDataFrame(data, "video_id int, candidate_id int, confidence double, start_ms long, end_ms long, position int")
    got = {r[0] for r in dedupe.suppress_overlaps(df, bound=bound, bin_ms=1_500).select("candidate_id").collect()}

    def covers(x, y):
        return x[0] == y[0] and min(x[4], y[4]) - max(x[3], y[3]) >= 0.75 * min(x[4] - x[3], y[4] - y[3])

    # these two say which set it is: kept ones leave each other alone, and each removed one has a stronger kept one over it
    kept = [d for d in data if d[1] in got]
    assert not any(covers(x, y) for x in kept for y in kept if x[1] < y[1])
    assert all(any(covers(k, d) and (-k[2], k[5]) < (-d[2], d[5]) for k in kept) for d in data if d[1] not in got)


def test_review_window_rounds(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        video = i % 4
        start = rng.choice([rng.randrange(0, 200_000), rng.randrange(0, 30) * 500])
        data.append((video, i, 200_000, rng.random() > 0.05, rng.choice("abc"), rng.choice(["", "x", "y"]), start, start + rng.randrange(1, 14_000)))
    # Spans that begin with a window and stick out of it by a few milliseconds.
    data += [(5, 1000 + j, 200_000, True, "a", f"d{j}", 50_000 + a, 59_000 + b) for j, (a, b) in enumerate([(0, 0), (3, 5), (4, 9), (5, 2_000), (9, 30)])]
    schema = "video_id int, recall_id int, dur_ms long, ok boolean, query_group string, description string, start_ms long, end_ms long"
    df = spark.createDataFrame(data, schema)
    folded = sorted(map(str, dedupe.review_windows(df, max_windows=6).collect()))
    rounds = sorted(map(str, dedupe.review_windows(df, max_windows=6, bound=1).collect()))
    assert folded == rounds and len(folded) > 12


def test_beats_across_chunks(spark):
    framing = audio.Framing(sample_rate=2_205)
    rng = np.random.default_rng(5)
    tracks = {1: rng.random(1_500), 2: np.concatenate([rng.random(300), np.zeros(700), rng.random(90)]), 3: rng.random(100)}
    df = spark.createDataFrame([(k, i, float(v)) for k, t in tracks.items() for i, v in enumerate(t)], "audio_id int, frame_idx long, onset double")
    tempo = spark.createDataFrame([(1, 1_500, 117.0), (2, 1_090, 95.0), (3, 100, 150.0)], "audio_id int, n_frames long, bpm double")
    got = {}
    for chunk in (256, 65_536):
        got[chunk] = sorted((r["audio_id"], r["frame_idx"]) for r in audio.track_beats(df, tempo, ["audio_id"], framing, chunk=chunk).collect())
    assert got[256] == got[65_536]
    for k, bpm in ((1, 117.0), (2, 95.0), (3, 150.0)):
        beats = [f for x, f in got[256] if x == k]
        period = round(framing.frame_rate * 60 / bpm)
        slack = max(2, period // 3)
        assert beats and beats[-1] + period + slack >= len(tracks[k])
        assert all(period - slack <= y - x <= period + slack for x, y in zip(beats, beats[1:], strict=False))


def _plain_beats(peaks: dict[int, float], length: int, period: int) -> list[int]:
    slack, found = max(2, period // 3), [min(peaks)]
    while (target := found[-1] + period) < length:
        near = [f for f in peaks if target - slack <= f <= target + slack]
        found.append(min(near, key=lambda f: (-peaks[f], f)) if near else target)
    return found


def test_beats_of_many_short_tracks_are_walked_in_blocks(spark, monkeypatch):
    framing = audio.Framing(sample_rate=2_205)
    rng = np.random.default_rng(11)
    lengths = {k: int(rng.integers(3, 90)) for k in range(300)} | {300: 1_500}
    # steps of a quarter give ties, the cut silence
    tracks = {k: np.where(np.arange(n) < rng.integers(1, n + 1), np.floor(rng.random(n) * 4) / 4, 0.0) for k, n in lengths.items()}
    bpms = {k: float(rng.choice([60.0, 75.6, 120.3, 189.0])) for k in tracks}
    df = spark.createDataFrame([(k, i, float(v)) for k, t in tracks.items() for i, v in enumerate(t)], "audio_id int, frame_idx long, onset double")
    tempo = spark.createDataFrame([(k, lengths[k], bpms[k]) for k in tracks], "audio_id int, n_frames long, bpm double")
    peaks: dict[int, dict[int, float]] = {}
    for r in audio.local_peaks(df, ["audio_id"]).collect():
        peaks.setdefault(r["audio_id"], {})[r["frame_idx"]] = r["onset"]
    want = sorted((k, f) for k, p in peaks.items() for f in _plain_beats(p, lengths[k], round(framing.frame_rate * 60 / bpms[k])))
    monkeypatch.setattr(audio, "BLOCK", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        beats = audio.track_beats(df, tempo, ["audio_id"], framing, chunk=256)
        assert sorted(tuple(r) for r in beats.collect()) == want and len(peaks) > 250
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    top = beats._jdf.queryExecution().analyzed().nodeName()
    assert top == "MapInArrow", "a Python call for each track took nine milliseconds a track, all in one task"


def test_blocks_of_beats_are_cut_by_frames(monkeypatch):
    rng = np.random.default_rng(12)
    rows, want = [], []
    for k in range(400):
        length, period = int(rng.integers(20, 300)), int(rng.integers(3, 45))
        peaks = {int(f): float(rng.integers(0, 3)) for f in rng.choice(length, size=int(rng.integers(1, 12)))}
        marked = [(-1, -1.0), *sorted(peaks.items())]
        rows += [{"audio_id": k, audio.BIN: 0, "frame_idx": f, "onset": v, "n_frames": length, "period": period, "entry": min(peaks), "__rn": i + 1} for i, (f, v) in enumerate(marked)]
        want += [(k, f) for f in _plain_beats(peaks, length, period)]
    for cells, most in ((audio.CELLS, 1), (5_000, 40)):
        monkeypatch.setattr(audio, "CELLS", cells)
        batches = list(audio._walk_chunks(pa.Table.from_pylist(rows), ["audio_id"], audio.CHUNK))
        assert sorted((r["audio_id"], r["frame_idx"]) for b in batches for r in b.to_pylist()) == sorted(want)
        assert len(batches) <= most


def test_frames_across_chunks(spark):
    framing = audio.Framing(sample_rate=2_205)
    rng = np.random.default_rng(6)
    tracks = {1: rng.random(5_003) - 0.5, 2: rng.random(120) - 0.5}
    df = spark.createDataFrame([(k, i, float(v)) for k, t in tracks.items() for i, v in enumerate(t)], "audio_id int, idx long, sample double")
    frames = audio.frame_rms(df, ["audio_id"], framing, chunk=7)
    for k, t in tracks.items():
        want = [np.sqrt(np.mean(t[s:s + 205] ** 2)) for s in range(0, max(1, len(t) - 205 + 1), 50)]
        got = [r["rms"] for r in frames.where(C("audio_id") == k).orderBy("frame_idx").collect()]
        assert np.allclose(got, want)
        energy = np.log1p(np.array(want) * 100)
        rise = np.concatenate([[0], np.maximum(0, np.diff(energy))])
        smooth = [rise[max(0, i - 1):i + 2].mean() for i in range(len(rise))]
        onset = [r["onset"] for r in audio.onset(frames, ["audio_id"], chunk=5).where(C("audio_id") == k).orderBy("frame_idx").collect()]
        assert np.allclose(onset, smooth)


@pytest.mark.parametrize("step, length", [(700, 4_300), (320, 4_323)])
def test_best_window_is_the_best_slice(spark, step, length):
    framing = audio.Framing(sample_rate=2_205)
    rng = np.random.default_rng(10)
    tracks = {1: rng.random(length) - 0.5, 2: (rng.random(2_600) - 0.5) * np.linspace(0.1, 1, 2_600), 3: rng.random(900) - 0.5}
    df = spark.createDataFrame([(k, i, float(v)) for k, t in tracks.items() for i, v in enumerate(t)], "audio_id int, idx long, sample double")
    target, slack, gap = 1_500, 100, 150 if step == 700 else 100
    slices = []
    for k, t in tracks.items():
        span = len(t) - target
        starts = [0] if len(t) <= target + slack else list(range(0, span + 1, step))
        if len(t) > target + slack and span - starts[-1] > gap:
            starts.append(span)
        slices += [(k, s, i, float(v)) for s in starts for i, v in enumerate(t[s:s + (target if len(t) > target + slack else len(t))])]
    one_by_one = audio.audio_features(spark.createDataFrame(slices, "audio_id int, start long, idx long, sample double"), ["audio_id", "start"], framing, minimum_seconds=0.0).collect()
    got = {r["audio_id"]: (r["start"], r["end"], r["score"]) for r in audio.best_window(df, "audio_id", framing, target=target, step=step, slack=slack, final_gap=gap).collect()}
    for k, t in tracks.items():
        score, start = max((r["score"], -r["start"]) for r in one_by_one if r["audio_id"] == k)
        assert got[k] == (-start, -start + min(len(t), target), score)
    assert {r["start"] for r in one_by_one if r["audio_id"] == 1} == {*range(0, length - target + 1, step), length - target}, "the last start is added, with its own framing where it needs one"


def test_hash_neighbours(spark):
    rng = random.Random(7)
    prior = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    frames = []
    for i in range(200):
        h = rng.choice(prior)
        for bit in rng.sample(range(64), rng.randrange(0, 16)):
            h ^= (1 << bit) if bit < 63 else -(1 << 63)
        frames.append((i, h))
    out = dedupe.hash_near_duplicates(spark.createDataFrame(frames, "frame_id int, hash long"), spark.createDataFrame([(p,) for p in prior], "hash long"))
    for r in out.collect():
        best = min(bin((r["hash"] ^ p) & (2**64 - 1)).count("1") for p in prior)
        assert r["duplicate"] == (best <= 10) and (best > 10 or r["nearest"] == best)


def test_muted_slices(spark):
    beds = spark.createDataFrame([("c", 10_000, 4_000)], "creative_id string, limit_ms long, loop_ms long")
    muted = spark.createDataFrame([("c", 1_000, 2_000), ("c", 2_001, 2_500)], "creative_id string, start_ms long, end_ms long")
    ducked = spark.createDataFrame([("c", 3_000, 5_000)], "creative_id string, start_ms long, end_ms long")
    out = [tuple(r) for r in intervals.slice_at_boundaries(beds, muted, ducked).orderBy("start_ms").collect()]
    assert out == [("c", 0, 1_000, False, 0), ("c", 2_500, 3_000, False, 2_500), ("c", 3_000, 4_000, True, 3_000), ("c", 4_000, 5_000, True, 0),
                   ("c", 5_000, 8_000, False, 1_000), ("c", 8_000, 10_000, False, 0)]


QUOTAS = {
    "plain": allocate.Quotas(creatives=3, candidate_uses=2, source_uses=5, previous_penalty=0.6, history_penalty=0.15),
    "scarce": allocate.Quotas(creatives=4, per_source=1, candidate_uses=1, source_uses=2),
    "authors": allocate.Quotas(creatives=3, candidate_uses=2, source_uses=4, group_authors=True, avoid_author_reuse=True),
    "sources": allocate.Quotas(creatives=3, per_source=4, candidate_uses=2, source_uses=6, target_sources=3),
    "both": allocate.Quotas(creatives=2, per_source=3, candidate_uses=2, source_uses=6, target_sources=3, group_authors=True),
}


@pytest.mark.parametrize("name", sorted(QUOTAS))
def test_fill_keeps_every_possible_pick(spark, name, monkeypatch):
    rng = random.Random(8)
    slots = [(0, 1_200), (1_200, 2_900), (2_900, 4_100), (4_100, 7_200), (12_800, 14_100), (14_100, 15_300)]
    pools = {}
    for p in (1, 2):
        pools[p] = [dict(pool_id=p, candidate_id=p * 1_000 + i, video_id=f"v{rng.randrange(9)}", event=rng.choice("xyz"), trim_ms=rng.randrange(600, 4_000, 100),
                         final_score=rng.randrange(20) / 20, position=i, exported_count=rng.choice([0, 0, 1, 3]), reserved=rng.random() < 0.1) for i in range(160)]
        for c in pools[p]:
            c["author"] = "a" + str(int(c["video_id"][1:]) % 4)
    kinds = "pool_id int, candidate_id int, video_id string, event string, trim_ms long, final_score double, position int, exported_count int, reserved boolean, author string"
    names = [k.split()[0] for k in kinds.split(", ")]
    df = spark.createDataFrame([tuple(c[n] for n in names) for p in pools.values() for c in p], kinds)
    gaps = spark.createDataFrame([(p, i + 1, a, b) for p in pools for i, (a, b) in enumerate(slots)], "pool_id int, slot_index int, start_ms long, end_ms long")
    got = sorted((r["pool_id"], r["creative_index"], r["slot_index"], r["candidate_id"]) for r in allocate.assign_batch(gaps, df, QUOTAS[name]).collect())
    q, by_id = QUOTAS[name], {c["candidate_id"]: c for p in pools.values() for c in p}
    assert got and not any(by_id[c]["reserved"] for *_, c in got)
    for p in pools:
        mine = [(n, i, by_id[c]) for x, n, i, c in got if x == p]
        assert max(Counter(c["candidate_id"] for *_, c in mine).values()) <= q.candidate_uses
        assert max(Counter(c["video_id"] for *_, c in mine).values()) <= q.source_uses
        assert max(Counter((n, c["video_id"]) for n, _, c in mine).values()) <= q.per_source
        assert all(c["trim_ms"] >= 0.8 * (slots[i - 1][1] - slots[i - 1][0]) for _, i, c in mine)
    # pruning loses no pick: the whole pool fills alike
    monkeypatch.setattr(allocate, "eligible_pool", lambda pool, *a, **k: pool)
    whole = allocate.assign_batch(gaps, df, q).collect()
    assert got == sorted((r["pool_id"], r["creative_index"], r["slot_index"], r["candidate_id"]) for r in whole)


def test_source_groups_widen_until_proved(spark, monkeypatch):
    """With two sources at first, every pool must come back for more and end as if it had them all."""
    from functools import partial

    rng = random.Random(9)
    data = [(1, i, f"v{rng.randrange(8)}", "a", rng.choice("xy"), rng.randrange(900, 3_000, 50), rng.randrange(9) / 9, i, 0, False) for i in range(90)]
    df = spark.createDataFrame(data, "pool_id int, candidate_id int, video_id string, author string, event string, trim_ms long, final_score double, position int, exported_count int, reserved boolean")
    gaps = spark.createDataFrame([(1, i + 1, i * 1_400, i * 1_400 + 1_400) for i in range(5)], "pool_id int, slot_index int, start_ms long, end_ms long")
    quotas = allocate.Quotas(creatives=3, per_source=2, candidate_uses=1, source_uses=4, target_sources=3)
    full = sorted(map(tuple, allocate.assign_batch(gaps, df, quotas).collect()))
    monkeypatch.setattr(allocate, "_assign_groups", partial(allocate._assign_groups, most_sources=2))
    assert sorted(map(tuple, allocate.assign_batch(gaps, df, quotas).collect())) == full


def test_stream_state_ignores_bad_order(spark):
    from mediaquery.streaming.streams import stream_usage_state, usage_counts

    events = [("a", 1, 1, "committed", 1), ("a", 1, 1, "reserved", 2), ("a", 1, 1, "released", 3), ("a", 1, 1, "committed", 4), ("b", 1, 1, "reserved", 1),
              ("b", 1, 1, "reserved", 5), ("b", 1, 1, "committed", 6), ("c", 1, 2, "released", 1)]
    state = stream_usage_state(spark.createDataFrame(events, "candidate_id string, run_id int, creative_id int, action string, seq int"))
    assert {r["candidate_id"]: r["state"] for r in state.collect()} == {"a": "released", "b": "committed"}
    assert {tuple(r) for r in usage_counts(state).collect()} == {("a", 1, 0), ("b", 1, 1)}
