"""The bucketed registry: untouched buckets stay, replays and lost jobs change nothing, any order gives the same table."""

import os
import random

import pytest
from pyspark.sql import functions as F

from mediaquery.operators.ledger import SEEN, register_candidates
from mediaquery.streaming import streams

TABLE = "candidate_id long, category string, event string, start_ms long, analysis_count long, status string, selected_count int, exported_count int, peak_ms long"
BATCH = "candidate_id long, category string, event string, start_ms long, peak_ms long, seq long"


def rows(keys, seqs):
    return [(k, f"c{k % 3}", f"e{n % 4}", n, n * 3, n) for k, n in zip(keys, seqs)]


def stamps(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], TABLE)


def whole(spark, empty, every):
    """The registry that one merge of all rows gives."""
    start = empty.withColumns({n: F.lit(None).cast("long") for n in SEEN})
    return sorted(map(tuple, register_candidates(start, spark.createDataFrame(every, BATCH)).select(*empty.columns, *SEEN).collect()))


def test_untouched_buckets_stay_and_replays_change_nothing(spark, empty, tmp_path):
    rng = random.Random(1)
    root, columns = f"file://{tmp_path}/registry", empty.withColumns({n: F.lit(None).cast("long") for n in SEEN})
    first = rows([rng.randrange(2_000) for _ in range(3_000)], range(3_000))
    second = rows([7] * 5 + [2_500], range(2_990, 2_996))
    put = lambda data, n: streams.merge_buckets(spark.createDataFrame(data, BATCH), n, root, columns, register_candidates, "candidate_id", 16)
    read = lambda: sorted(map(tuple, streams.read_buckets(spark, root, columns).select(*empty.columns, *SEEN).collect()))
    assert read() == []
    put(first, 0)
    assert read() == whole(spark, empty, first)
    before = stamps(f"{tmp_path}/registry/table")
    put(second, 1)
    after = stamps(f"{tmp_path}/registry/table")
    same = {f for f in before if after.get(f) == before[f]}
    touched = {os.path.dirname(f) for f in after if f not in same}
    assert len(touched) <= 2 and len(same) >= 14, "1 % of the keys rewrites their buckets alone"
    assert read() == whole(spark, empty, first + second)
    put(second, 1)
    put(first, 0)
    assert read() == whole(spark, empty, first + second) and stamps(f"{tmp_path}/registry/table") == after
    put([], 2)
    assert read() == whole(spark, empty, first + second) and not os.listdir(f"{tmp_path}/registry/pending")


def test_a_job_lost_while_buckets_are_replaced_is_repeated(spark, empty, tmp_path, monkeypatch):
    root, columns = f"file://{tmp_path}/registry", empty.withColumns({n: F.lit(None).cast("long") for n in SEEN})
    first, second = rows(range(200), range(200)), rows(range(150, 300), range(200, 350))
    put = lambda data, n: streams.merge_buckets(spark.createDataFrame(data, BATCH), n, root, columns, register_candidates, "candidate_id", 4)
    put(first, 0)
    monkeypatch.setattr(streams, "forget_path", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        put(second, 1)
    gone = next(os.path.join(d, f) for d, _, names in os.walk(f"{tmp_path}/registry/table") for f in names if f.startswith("part-"))
    os.replace(gone, f"{tmp_path}/elsewhere")  # a bucket that was removed and not yet put in place
    monkeypatch.undo()
    put(second, 1)
    assert sorted(map(tuple, streams.read_buckets(spark, root, columns).select(*empty.columns, *SEEN).collect())) == whole(spark, empty, first + second)


def test_stream_in_any_order(spark, empty, tmp_path):
    rng = random.Random(3)
    every = rows([rng.randrange(50) for _ in range(400)], range(400))
    rng.shuffle(every)
    for n in range(4):
        spark.createDataFrame(every[n::4], BATCH).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = lambda: spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    columns = empty.withColumns({n: F.lit(None).cast("long") for n in SEEN})
    read = lambda: sorted(map(tuple, streams.read_buckets(spark, f"file://{tmp_path}/r", columns).select(*empty.columns, *SEEN).collect()))
    for _ in range(2):  # a restart finds nothing new
        streams.stream_register(source(), f"file://{tmp_path}/r", empty, f"file://{tmp_path}/checkpoint", buckets=4).awaitTermination()
        assert read() == whole(spark, empty, every)
    spark.createDataFrame(rows([3, 99], [500, 501]), BATCH).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    streams.stream_register(source(), f"file://{tmp_path}/r", empty, f"file://{tmp_path}/checkpoint", buckets=4).awaitTermination()
    assert read() == whole(spark, empty, every + rows([3, 99], [500, 501]))


EVENT = "candidate_id string, run_id int, creative_id long, action string, seq long"


def states(events):
    """Every entry's state by the rules, read one after the other."""
    found = {}
    for entry in {e[:3] for e in events}:
        reserved = [e[4] for e in events if e[:3] == entry and e[3] == "reserved" and e[4] is not None]
        if reserved:
            later = sorted((e[4], e[3]) for e in events if e[:3] == entry and e[3] in ("committed", "released") and e[4] is not None and e[4] > min(reserved))
            found[entry] = later[0][1] if later else "reserved"
    return found


def ledger_events(rng, n):
    action = lambda: rng.choice(["reserved", "committed", "committed", "released", "released", "opened", None])
    return [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.randrange(4), action(), rng.choice([*range(40), None])) for _ in range(n)]


def merged(spark, root, buckets):
    def put(events, n):
        streams.stream_usage_state(spark.createDataFrame(events, EVENT), root, n, buckets)
        return found(streams.read_usage_state(spark, root))

    return put


def found(df):
    rows = df.collect()
    assert len(rows) == len({tuple(r)[:3] for r in rows})
    return {tuple(r)[:3]: r["state"] for r in rows}


def test_usage_state_after_every_batch_is_that_of_all_events(spark, tmp_path):
    rng = random.Random(5)
    root, every = f"file://{tmp_path}/usage", []
    put = merged(spark, root, 4)
    assert put([], 0) == {}
    for n, size in enumerate((60, 0, 120, 240), 1):
        batch = ledger_events(rng, size)
        every += batch
        assert put(batch, n) == states(every) == found(streams.stream_usage_state(spark.createDataFrame(every, EVENT)))
    assert spark.read.parquet(f"{root}/between").count() > 30, "decisions between the first and the last of an entry"
    assert len(os.listdir(f"{tmp_path}/usage/done")) == 1 and len(os.listdir(f"{tmp_path}/usage/folds")) <= 4, "folders don't pile up with the batches"
    before = stamps(f"{tmp_path}/usage")
    assert put(batch, n) == states(every) and stamps(f"{tmp_path}/usage") == before, "a batch that arrives again"
    assert put(every, n + 1) == states(every), "events that arrive again in another batch"


def test_usage_state_keeps_the_first_decision_after_a_late_reservation(spark, tmp_path):
    put, every = merged(spark, f"file://{tmp_path}/usage", 2), []
    for n, event in enumerate([("committed", 1), ("released", 9), ("committed", 5), ("released", 3), ("committed", 7), ("reserved", 6), ("released", 6), ("reserved", 4), ("reserved", 2)]):
        every.append(("a", 1, 1, *event))
        assert put(every[-1:], n) == states(every)
    assert states(every) == {("a", 1, 1): "released"}


def test_a_batch_rewrites_its_own_buckets_in_one_file_each(spark, tmp_path):
    put, many = merged(spark, f"file://{tmp_path}/usage", 8), [(f"c{n}", n % 7, n, "reserved", n) for n in range(2_000)]
    assert put(many, 0) == states(many)
    first = stamps(f"{tmp_path}/usage/folds")
    assert len(first) == 8
    late = [(*many[3][:3], "released", 9_999), ("new", 1, 1, "reserved", 1)]
    assert put(late, 1) == states(many + late)
    second = stamps(f"{tmp_path}/usage/folds")
    assert len(second) in (8, 9) and len({f for f in second if second[f] != first.get(f)}) in (1, 2), "other buckets stay, replaced ones go"


@pytest.mark.parametrize("lost", ["after its folds", "before its mark", "while removing"])
def test_a_lost_batch_is_merged_again(spark, tmp_path, monkeypatch, lost):
    rng = random.Random(8)
    root, first, second = f"file://{tmp_path}/usage", ledger_events(rng, 150), ledger_events(rng, 150)
    put = merged(spark, root, 4)
    assert put(first, 0) == states(first)
    monkeypatch.setattr(streams, "_same_entry" if lost == "after its folds" else "forget_path", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        put(second, 1)
    monkeypatch.undo()
    if lost == "before its mark":
        os.replace(f"{tmp_path}/usage/done/batch=1", f"{tmp_path}/elsewhere")
        assert os.path.exists(f"{tmp_path}/usage/between/batch=1")
    assert found(streams.read_usage_state(spark, root)) == states(first + second if lost == "while removing" else first)
    assert put(second, 1) == states(first + second)
    folders = {os.path.dirname(f) for f in stamps(f"{tmp_path}/usage/folds")}
    assert len({f.rpartition("=")[2] for f in folders}) == len(folders), "one folder is left of every bucket"


def test_usage_query_keeps_no_entry_in_memory(spark, tmp_path, monkeypatch):
    from contract import sources  # noqa: F401
    from contract.base import QUERIES

    rng = random.Random(4)
    orders = [(n, rng.choice([1, 2, None]), rng.choice(["F", "P", "O", None])) for n in range(40)]
    lines = [(rng.choice([*range(50), None]), rng.choice([7, 8, None]), rng.choice([1, 2, None])) for _ in range(300)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr("contract.sources.scratch_path", lambda _, name: f"file://{tmp_path}/{name}")
    got = {r["candidate_id"]: (r["selected_count"], r["exported_count"]) for r in QUERIES["stream_usage_state"](spark, str(tmp_path)).collect()}
    entries = {(part, cust, key): status for key, part, _ in lines for k, cust, status in orders if k == key}
    assert got == {p: (sum(e[0] == p for e in entries), sum(e[0] == p and s == "F" for e, s in entries.items())) for p in {e[0] for e in entries}}
    assert len(os.listdir(f"{tmp_path}/usage/checkpoint/commits")) >= 2 and not os.path.exists(f"{tmp_path}/usage/checkpoint/state"), "a state store holds every entry in memory"
