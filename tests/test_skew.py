"""Hot keys: scans and pair reports give the same rows when one key holds nearly everything, in bounded pieces."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mediaquery.functions import ordered
from mediaquery.operators import allocate, intervals, reports


@pytest.fixture
def hot(spark):
    """90 % of 4,000 rows in one key within one second, repeated places included; further keys and a null one."""
    rng = random.Random(2)
    rows = [(1 if i % 10 else rng.choice([2, 3, None]), rng.randrange(1000), i, rng.randrange(50)) for i in range(4_000)]
    return spark.createDataFrame(rows, "k int, t long, i long, v long").repartition(6)


@pytest.mark.parametrize("down", [False, True])
def test_hot_scan_equals_plain_window(spark, hot, monkeypatch, down):
    order = [F.col("t").desc() if down else F.col("t"), F.col("i")]
    ask = lambda **x: ordered.ordered_scan(hot, ["k"], order, rank="r", size="n", running_sum={"s": F.col("v")}, prior_max={"m": F.col("v")}, lead={"a": F.col("i")}, lag={"b": F.col("i")}, **x)
    rows = lambda df: sorted(map(tuple, df.select("k", "t", "i", "v", "r", "n", "s", "m", "a", "b").collect()), key=str)
    want = rows(ask())
    assert ordered.heavy_keys(hot, ["k"]) is None
    monkeypatch.setattr(ordered, "HEAVY", 500)
    heavy = ordered.heavy_keys(hot, ["k"])
    assert [r["k"] for r in heavy.collect()] == [1]
    assert rows(ask()) == want and rows(ask(heavy=heavy)) == want and len(want) == 4_000
    dealt = ordered._ranged(hot.join(heavy, "k", "left_semi"), ["k"], order)
    sizes = [r["count"] for r in dealt.groupBy(ordered.BIN).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3_600 / 4, "one summary row a partition, no partition holds the key"


def test_hot_timelines(spark, monkeypatch):
    """Timeline operators over a creative with nearly all clips, split and unsplit."""
    rng = random.Random(4)
    at, rows = 0, []
    for i in range(1_500):
        rows.append((1 if i % 12 else 2, f"c{i}", i, at, at + rng.randrange(1, 900), i % 7, 500, 100))
        at += rng.randrange(1, 900)
    clips = spark.createDataFrame(rows, "creative_id int, clip_id string, pos long, start_ms long, end_ms long, video_id long, dur_ms long, source_in_ms long").withColumn("clip_type", F.lit("highlight"))
    media = spark.createDataFrame([(i, 900 + i) for i in range(7)], "video_id long, media_ms long")
    beds = spark.createDataFrame([(1, at, 7_000), (2, at, 9_000)], "creative_id int, limit_ms long, loop_ms long")
    points = clips.select("creative_id", F.col("start_ms").alias("at"), "pos")

    def results():
        frames = [
            intervals.timeline_errors(clips, at), intervals.repair_gaps(clips, media).drop("new_dur_ms"), intervals.coalesce_intervals(clips.select("creative_id", "start_ms", "end_ms")),
            intervals.intervals_at_point(points, clips.select("creative_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end")), "inside"),
            intervals.slice_at_boundaries(beds, clips.where("pos % 3 = 0"), clips.where("pos % 3 = 1"))]
        return [sorted(map(tuple, f.select(*sorted(f.columns)).collect()), key=str) for f in frames]

    want = results()
    monkeypatch.setattr(ordered, "HEAVY", 200)
    assert results() == want and all(len(x) > 10 for x in want)


def overlaps(sets):
    found = {}
    for run, members in sets.items():
        for a, b in itertools.combinations(sorted(members), 2):
            found[run, a, b] = len(members[a] & members[b]) / min(len(members[a]), len(members[b]))
    return found


def test_threshold_pairs_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    sets = {run: {m: set(rng.sample(range(40 if run else 12), rng.randrange(1, 11))) for m in range(60)} for run in range(3)}
    sets[7] = {m: {0, 1, 100 + m} for m in range(80)} | {900: {100, 101, 102, 1}}  # two items that all hold, one real overlap
    sets[8] = {m: {5, 6, 7} for m in range(80)}  # equal members
    sets[9] = {m: {m} for m in range(5)}  # nothing shared
    rows = [(run, m, c) for run, members in sets.items() for m, held in members.items() for c in held] + [(0, 0, None)]
    df = spark.createDataFrame(rows * 2, "run_id int, creative_id int, candidate_id int").repartition(5)
    want = overlaps(sets)
    for wide in (reports.WIDE, 3):
        monkeypatch.setattr(reports, "WIDE", wide)
        for over in (0.2, 0.5, 0.9):
            got = {(r[0], r[1], r[2]): r[3] for r in reports.pairs_over(df.where("run_id < 7"), over).collect()}
            assert got == {k: round(v, 4) for k, v in want.items() if v > over and k[0] < 7}
            best = {}
            for (run, *_), v in want.items():
                if v > over:
                    best[run] = max(best.get(run, 0), round(v, 4))
            assert {r[0]: r[1] for r in reports.maximum_overlap(df, over).collect()} == best
    assert reports.pairs_over(df.limit(0)).count() == 0 and reports.maximum_overlap(df.limit(0)).count() == 0


def test_item_of_all_members_gives_no_quadratic_output(spark):
    """2,000 creatives share two candidates and nothing else: two million pairs, of which next to none meet."""
    n = 2_000
    rows = [(1, m, c) for m in range(n) for c in (-1, -2, 3 * m, 3 * m + 1, 3 * m + 2)] + [(1, n, c) for c in (0, 1, 2, -1)]
    df = spark.createDataFrame(rows, "run_id int, creative_id int, candidate_id int")
    shared = reports.shared_items(df)
    assert reports.meetings(shared, F.floor(F.col("n") * 0.4) + 1).count() <= 2 * n
    assert [tuple(r) for r in reports.maximum_overlap(df).collect()] == [(1, 1.0)]


def test_merged_partitions_are_bounded_by_size():
    """A task's rows must not grow with the input: with Spark's 64 MB, partitions are merged until there is one for each core."""
    from mediaquery.session import DEFAULTS

    assert DEFAULTS["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "8m"


def test_slot_lengths_are_no_reason_to_gather_a_pool(spark):
    """Candidates meet their pool's slot lengths without a shuffle by pool."""
    slots = spark.createDataFrame([(1, 1, 0, 900)], "pool_id long, slot_index long, start_ms long, end_ms long").localCheckpoint()
    pool = spark.range(1_000).selectExpr("1L pool_id", "id candidate_id", "id % 9 video_id", "'e' event", "900L + id trim_ms", "id position", "0.5D worth", "'' author").localCheckpoint()
    kept = allocate.eligible_pool(pool, slots, 3, key="pool_id", by_fit=True, authors=False)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pool_id#" not in plan or not any(line.split("hashpartitioning(")[1].split(",")[1].strip().isdigit() for line in plan.splitlines() if "hashpartitioning(" in line)
    assert kept.count() == 12
