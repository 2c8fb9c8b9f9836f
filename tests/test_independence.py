"""Results that must not depend on arrival order, bounds or repetition."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from mediaquery.operators import dedupe, ledger, ranking


def test_registry_takes_batches_in_any_order(spark):
    rows = [(1, "a", 5, 1), (1, "b", 6, 4), (1, "c", 7, 2), (2, "x", 1, 3)]
    schema = "candidate_id long, category string, peak_ms long, seq long"
    empty = spark.createDataFrame([], "candidate_id long, category string, peak_ms long, analysis_count long, status string, selected_count long, exported_count long, first_seq long, last_seq long")
    results = set()
    for order in list(permutations(rows, 4))[::5]:
        table = empty
        for row in order:
            table = ledger.register_candidates(table, spark.createDataFrame([row], schema))
        results.add(tuple(sorted(map(tuple, table.select("candidate_id", "category", "peak_ms", "analysis_count").collect()))))
    assert results == {((1, "a", 6, 3), (2, "x", 1, 1))}


@pytest.mark.parametrize("bound", [1, 2, 4096])
def test_missing_confidence_is_weakest_at_every_bound(spark, bound):
    rows = spark.createDataFrame([(1, 1, 0, 10_000, None, 0), (1, 2, 0, 10_000, 0.5, 1), (1, 3, 0, 10_000, 0.9, 2), (2, 4, 0, 100, None, 0)], "video_id long, candidate_id long, start_ms long, end_ms long, confidence double, position long")
    assert sorted(r["candidate_id"] for r in dedupe.suppress_overlaps(rows, bound=bound).collect()) == [3, 4]


def test_repeated_decisions_count_once(spark):
    registry = spark.createDataFrame([(1, 0, "eligible")], "candidate_id long, exported_count long, status string")
    book = spark.createDataFrame([(1, 7, 8, "reserved")], "candidate_id long, run_id long, creative_id long, state string")
    twice = spark.createDataFrame([(7, 8, "committed"), (7, 8, "committed"), (7, None, "released"), (7, None, "released")], "run_id long, creative_id long, decision string")
    table, rows = ledger.finalize(registry, book, twice)
    assert [tuple(r) for r in table.collect()] == [(1, 1, "used")]
    assert [r["state"] for r in rows.collect()] == ["committed"]


def test_unmarked_music_is_not_selected(spark):
    rows = spark.createDataFrame([(k, "c", f"f{k}", 122, 0.9, 0.1, 60_000, 0, k, e) for k, e in enumerate((1, 0, None, 1))], "bgm_id long, category string, fingerprint string, bpm long, music_score double, speech_risk double, duration_ms long, exported_count long, updated_at long, eligible int")
    kept = ranking.eligible_bgms(rows, minimum_score=0.3, maximum_risk=0.3)
    assert sorted(r["bgm_id"] for r in kept.collect()) == [0, 3]
    assert sorted((r["bgm_id"], r["rank"]) for r in ranking.rank_bgms(kept, 122).select("bgm_id", F.col("rank")).collect()) == [(0, 2), (3, 1)]
