import random
import time
from collections import deque

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gradelake.streaming import live, replay


def simulate(ops, cap):
    q, fate = deque(), {}
    for seq, put in ops:
        if put:
            if len(q) >= cap:
                fate[q.popleft()] = "dropped"
            q.append(seq)
        elif q:
            fate[q.popleft()] = "consumed"
    return fate, len(q)


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_queue_replay_matches_a_simulation(spark, block):
    ops = [(i, (i * 7919) % 10 < 6) for i in range(500)]
    df = spark.createDataFrame(ops, "seq long, is_put boolean").repartition(4)
    rows = replay.replay_queue(df, 9, block)
    fate, left = simulate(ops, 9)
    got = {r.seq: r.fate for r in rows.collect() if r.is_put}
    assert got == {s: fate.get(s, "queued") for s, p in ops if p}
    stats = replay.queue_statistics(rows).first()
    assert stats.queue_size == left and stats.total_produced == sum(p for _, p in ops)


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_gate(spark, block):
    rows = [(i, i % 23 == 22, i % 4) for i in range(200)]
    out = {r.seq: (r.stale, r.paused) for r in replay.staleness_gate(spark.createDataFrame(rows, "seq long, is_update boolean, carried int"), 4, 0.5, 2, block).collect()}
    stale = 0
    for seq, update, carried in rows:
        stale = carried if update else stale + 1
        assert out[seq] == (stale, stale >= 12)


def test_live_buffer_and_stale_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("p", "k1", "status", "running", 1, 1, 1, 3), ("p", "k1", "status", "success", 2, 1, 3, 3), ("p", "k2", "status", "success", 3, 2, 1, 3)]
    ddl = "partition string, key string, tag string, value string, seq long, step int, version int, current int"
    spark.createDataFrame(rows, ddl).write.parquet(src)
    stream = spark.readStream.schema(ddl).parquet(src)
    for name, df in (("tags", live.stream_latest_tags(stream)), ("stale", live.stream_stale_counts(stream, "step", "version", "current"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r.key, r.value) for r in spark.table("tags").collect()} == {("k1", "success"), ("k2", "success")}
    assert {(r.step, r.stale) for r in spark.table("stale").collect()} == {(1, 1), (2, 1)}


def test_ready_keys_wait_for_running_ones(spark):
    rows = [("p", k, t, v, i) for i, (k, t, v) in enumerate([("a", "step", "1"), ("b", "step", "1"), ("c", "step", "2"), ("a", "status", "success"), ("b", "status", "running"), ("c", "status", "running"), ("c", "status", "success")])]
    df = spark.createDataFrame(rows, "partition string, key string, tag string, value string, seq int")
    assert [r.key for r in replay.ready_keys(df, ["seq"]).collect()] == ["c"]


READY = "partition string, step string, key string, status string, seq long"


def started(stream, out, state, **options):
    partitions = stream.sparkSession.conf.get("spark.sql.shuffle.partitions")
    stream.sparkSession.conf.set("spark.sql.shuffle.partitions", "1")
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    df = live.stream_ready_keys(stream, **options)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    stream.sparkSession.conf.set("spark.sql.shuffle.partitions", partitions)
    return q


def put(spark, folder, rows):
    spark.createDataFrame(rows, READY).coalesce(1).write.mode("append").parquet(folder)


def test_ready_keys_as_a_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rng = random.Random(5)
    log = []
    for step in range(6):
        keys = [f"k{step}-{i}" for i in range(5)]
        ends = [(k, rng.choice(["success", "success", "failed"])) for k in keys]
        rng.shuffle(ends)
        # everybody starts before the first one ends; the last two steps are left running
        log += [("p", str(step), k, "running") for k in keys] + [("p", str(step), *e) for e in (ends if step < 4 else ends[:-1])]
    log = [(*r, i) for i, r in enumerate(log)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(READY).option("maxFilesPerTrigger", 1).parquet(src)
    for at in range(0, len(log), 20):
        put(spark, src, log[at : at + 20])
        started(stream, out, state)
    tags = [(p, k, t, v, seq) for p, step, k, status, seq in log for t, v in (("step", step), ("status", status))]
    want = replay.ready_keys(spark.createDataFrame(tags, "partition string, key string, tag string, value string, seq long"), ["seq"])
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == sorted(tuple(r) for r in want.collect()) and got
    # a restart from the checkpoint repeats nothing
    put(spark, src, [("p", "new", "z", "success", 1000)])
    started(stream, out, state)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == sorted([*got, ("p", "new", "z")])


def test_state_of_ready_keys_does_not_grow(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for batch in range(50):
        rows = [("p", "now", f"k{batch}-{i}", status, batch * 100 + 10 * j + i) for j, status in enumerate(("running", "success")) for i in range(4)]
        table = pa.table(dict(zip(("partition", "step", "key", "status", "seq"), map(list, zip(*rows)))))
        pq.write_table(table, f"{src}/{batch:02}.parquet")
    stream = spark.readStream.schema(READY).option("maxFilesPerTrigger", 1).parquet(src)
    q = started(stream, out, state)
    sizes = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert len(sizes) >= 50 and max(sizes[3:]) <= max(sizes[:3]), sizes
    assert spark.read.parquet(out).count() == 200


def test_steps_without_updates_are_closed(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    put(spark, src, [("p", "1", "a", "success", 1), ("p", "1", "b", "running", 2), ("p", None, "c", "running", 1), (None, None, None, None, None)])
    stream = spark.readStream.schema(READY).parquet(src)
    started(stream, out, state, expire_ms=200)
    time.sleep(1)
    put(spark, src, [("p", "2", "d", "success", 3)])
    started(stream, out, state, expire_ms=200)
    assert {r.key for r in spark.read.parquet(out).collect()} == {"a", "d"}


def test_round_cap(spark):
    df = spark.createDataFrame([("s", i, "length", i == 3) for i in range(1, 60)], "sample string, round int, finish string, closes boolean")
    counts = {r.case: r.n for r in replay.round_cases(df).groupBy("case").agg(F.count("*").alias("n")).collect()}
    assert counts == {"3": 2, "2": 1, "2c": 47}
