"""Covers of whole runs against the plain rule: one creative after the other."""

import random

from mediaquery.operators import covers


def one_after_the_other(rows, distance):
    used, out = {}, {}
    for run, creative in sorted({r[:2] for r in rows}):
        taken = used.setdefault(run, [])

        def tier(option):
            if option[3] is not None and any((option[3] ^ t).bit_count() <= distance for t in taken):
                return 2
            return 0 if option[4] else 1

        best = min((r for r in rows if r[:2] == (run, creative)), key=lambda r: (tier(r), r[2]))
        out[run, creative] = (best[2], tier(best))
        if best[3] is not None:
            taken.append(best[3])
    return out


def test_covers_equal_the_sequential_choice(spark, monkeypatch):
    rng = random.Random(7)
    pool = [rng.getrandbits(63) for _ in range(12)]
    rows = []
    for run, creatives in ((1, 40), (2, 15), (3, 1)):
        for creative in range(creatives):
            for ordinal in range(rng.randrange(1, 6)):
                value = rng.choice(pool)
                for bit in rng.sample(range(63), rng.choice([0, 0, 3, 6])):
                    value ^= 1 << bit
                rows.append((run, creative, ordinal, None if rng.random() < 0.03 else value, rng.choice([True, True, False, None])))
    # a chain: each creative of run 4 offers its own frame after that of the one before
    rows += [(4, k, o, (1 << 62) | (k - 1 + o) * 0x0041041041041041 & ((1 << 62) - 1), True) for k in range(12) for o in (0, 1)]
    df = spark.createDataFrame(rows, "run_id int, creative_id long, ordinal int, hash long, acceptable boolean")
    got = {(r["run_id"], r["creative_id"]): (r["ordinal"], r["tier"]) for r in covers.choose_covers(df).collect()}
    assert got == one_after_the_other(rows, 10)
    assert covers.choose_covers(df.limit(0)).count() == 0
    for bounds in ({"WHOLE_RUN": 1 << 16, "BLOCK": 7, "PAIRS": 3}, {"WHOLE_RUN": 30}, {"WHOLE_RUN": 0}):  # tiny blocks, some runs in rounds, all runs in rounds
        for name, value in bounds.items():
            monkeypatch.setattr(covers, name, value)
        again = {(r["run_id"], r["creative_id"]): (r["ordinal"], r["tier"]) for r in covers.choose_covers(df).collect()}
        assert again == got, bounds
    few = covers._near_in_run(df.where("hash is not null").select("run_id", "hash").distinct(), 10)
    monkeypatch.setattr(covers, "FEW_HASHES", 20)
    many = covers._near_in_run(df.where("hash is not null").select("run_id", "hash").distinct(), 10)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_options_without_ids_are_never_duplicates(spark):
    rows = [(None, 1, 0, 5, True), (None, 2, 0, 5, True), (1, None, 0, 5, True), (1, 1, 0, 5, True), (1, 2, 0, 5, True), (1, 2, 1, None, False), (1, 3, 0, 5, None)]
    df = spark.createDataFrame(rows, "run_id int, creative_id long, ordinal int, hash long, acceptable boolean")
    got = sorted(((r["run_id"], r["creative_id"], r["ordinal"], r["tier"]) for r in covers.choose_covers(df).collect()), key=str)
    assert got == sorted([(None, 1, 0, 0), (None, 2, 0, 0), (1, None, 0, 0), (1, 1, 0, 0), (1, 2, 1, 1), (1, 3, 0, 2)], key=str)


def test_runs_of_ordinary_size_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(covers, "_choose_in_rounds", None)
    df = spark.range(600).selectExpr("id % 3 run_id", "id div 6 creative_id", "cast(id % 6 as int) ordinal", "id % 17 * 4294967296 hash", "true acceptable")
    assert covers.choose_covers(df).count() == 300
