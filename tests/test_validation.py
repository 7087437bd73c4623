import re

import numpy as np
import pytest

from gradelake.functions import twister
from gradelake.operators import validation as V


def brute(vals, votes, n, boots=1000, seed=42):
    np.random.seed(seed)
    idx = np.random.choice(len(vals), size=(boots, n), replace=True)
    best = [max(vals[i] for i in row) for row in idx]
    worst = [min(vals[i] for i in row) for row in idx]
    maj = []
    for row in idx:
        seen = {}
        for i in row:
            seen.setdefault(votes[i], []).append(vals[i])
        top = max(seen, key=lambda k: len(seen[k]))
        maj.append(seen[top][0])
    return {f"{k}@{n}/{s}": float(f(x)) for k, x in (("best", best), ("worst", worst), ("maj", maj)) for s, f in (("mean", np.mean), ("std", np.std))}


@pytest.mark.parametrize("limit", [2048, 3])
def test_bootstrap_matches_numpy_on_both_paths(spark, limit):
    rng = np.random.default_rng(3)
    rows, groups = [], {}
    for uid, n in (("a", 1), ("b", 2), ("c", 5), ("d", 9)):
        for i in range(n):
            v, p = float(rng.integers(0, 6)), f"p{rng.integers(0, 3)}"
            rows.append((uid, i, v, p))
            groups.setdefault(uid, []).append((v, p))
    df = spark.createDataFrame(rows, "uid string, i int, v double, pred string").repartition(5)
    got = {(r.uid, r.metric): r.value for r in V.bootstrap(df, ["uid"], ["i"], "v", "pred", array_limit=limit).collect()}
    want = {}
    for uid, g in groups.items():
        for n in V.ladder(len(g)):
            for m, x in brute([v for v, _ in g], [p for _, p in g], n).items():
                want[uid, m] = x
    assert got == pytest.approx(want)


@pytest.mark.parametrize("votes", [True, False])
@pytest.mark.parametrize("generator", ["numpy", "counter"])
def test_shares_of_resamples_agree_with_the_row_join(spark, monkeypatch, generator, votes):
    # small steps, so that groups take several tasks, streams several blocks and resamples several steps
    monkeypatch.setattr(V, "STEP", 64)
    monkeypatch.setattr(V, "RAW_BLOCK", 100)
    monkeypatch.setattr(V, "SHARE", {"numpy": 90, "counter": 70})
    rows = [(u, i, None if i % 11 == 3 else float("nan") if u == "c" and i == 7 else float(i * 7 % 5), None if i % 4 == 1 else f"p{i * 5 % kinds}") for u, n, kinds in (("a", 2, 1), ("b", 13, 3), ("c", 40, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "uid string, i int, v double, pred string").repartition(3)
    vote = "pred" if votes else None
    got, want = ({(r.uid, r.metric): r.value for r in V.bootstrap(df, ["uid"], ["i"], "v", vote, boots=30, seed=3, array_limit=1, block_limit=limit, generator=generator).collect()} for limit in (1 << 20, 1))
    assert got == pytest.approx(want, nan_ok=True) and len(got) == (6 if votes else 4) * sum(len(V.ladder(n)) for n in (2, 13, 40))


def test_draws_are_not_broadcast(spark):
    df = spark.createDataFrame([("a", i, float(i % 3), "p") for i in range(50)], "uid string, i int, v double, pred string")
    for generator in ("numpy", "counter"):
        out = V.bootstrap(df, ["uid"], ["i"], "v", "pred", boots=40, array_limit=1, block_limit=1, generator=generator)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin \[[^\]]*\bidx#", plan)


def test_index_stream_can_be_drawn_in_chunks(spark):
    df = spark.createDataFrame([(7, 3)], "total long, n long")
    rows = V.draw_indices(df, 50, 42, chunk=11).orderBy("boot", "k").collect()
    want = np.random.RandomState(42).choice(7, size=(50, 3), replace=True)
    assert [r.idx for r in rows] == want.ravel().tolist()


@pytest.mark.parametrize("place", [0, 1, 623, 625, 20_000, 1_000_003, 3_000_000])
def test_the_generator_can_begin_anywhere(place):
    far = np.random.RandomState(9)
    far.randint(0, 1 << 32, size=place, dtype=np.uint32)
    got = twister.generator(9, place).randint(0, 1 << 32, size=1500, dtype=np.uint32)
    assert np.array_equal(got, far.randint(0, 1 << 32, size=1500, dtype=np.uint32))


@pytest.mark.parametrize("total", [2, 3, 64, 65, 1000, 70_001])
def test_blocks_of_the_stream_follow_one_another(total):
    got = np.concatenate([twister.accepted(5, b, 3000, total) for b in range(5)])
    assert np.array_equal(got, np.random.RandomState(5).choice(total, size=len(got)))


def test_streams_of_several_sizes_are_numpys(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 64)
    df = spark.createDataFrame([(t, n) for t in (2, 5, 33) for n in V.ladder(t)], "total long, n long")
    rows = V.draw_indices(df, 40, 42, chunk=100).collect()
    for t in (2, 5, 33):
        for n in V.ladder(t):
            mine = sorted((r.boot, r.k, r.idx, r.part) for r in rows if (r.total, r.n) == (t, n))
            want = np.random.RandomState(42).choice(t, size=(40, n), replace=True)
            assert [m[2] for m in mine] == want.ravel().tolist()
            assert [m[3] for m in mine] == [i // 64 for i in range(40 * n)]


def test_counter_draws_are_spread_evenly(spark):
    groups = spark.createDataFrame([("g", 10, 8)], "uid string, total long, n long")
    rows = V.counter_draws(groups, 5000, 3).groupBy("idx").count().collect()
    counts = np.array([r["count"] for r in rows])
    assert len(counts) == 10 and counts.sum() == 40_000
    assert ((counts - 4000) ** 2 / 4000).sum() < 27.9  # chi-square, 9 degrees of freedom, 0.001


def test_majority_ties_go_to_the_first_seen():
    vals, votes = np.array([0.9, 0.8, 0.7]), np.array([0, 1, 0])
    idx = np.array([[1, 0], [0, 1], [2, 0], [0, 1]])
    assert V._majority(votes, vals, idx).tolist() == [0.8, 0.9, 0.7, 0.9]


def test_ladder():
    assert [V.ladder(n) for n in (0, 1, 2, 3, 8, 9)] == [[], [], [2], [2, 3], [2, 4, 8], [2, 4, 8, 9]]
