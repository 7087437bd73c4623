import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.operators import advantage as adv
from gradelake.operators.groups import (
    cumulative,
    exact_quantiles,
    join_group_stats,
    last_wins,
    position_in_group,
    with_row_index,
)


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows; another key is NULL."""
    rows = [(None if i % 7 == 3 else (0 if i % 3 == 0 else i % 50), i, float((i * 37) % 11)) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, id long, v double").repartition(6)


def _brute(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r)
    return groups


@pytest.mark.parametrize("hot_rows", [1_000_000, 40])
def test_group_stats_survive_a_hot_key(hot, hot_rows):
    out = join_group_stats(hot, ["k"], [F.avg("v").alias("m")], hot_rows).collect()
    groups = _brute(hot)
    assert len(out) == 3000
    for r in out:
        vs = [x.v for x in groups[r.k]]
        assert r.group_n == len(vs)
        assert r.m == pytest.approx(np.mean(vs))


def test_hot_key_is_spread_over_tasks(hot):
    out = join_group_stats(hot, ["k"], [], 40)
    plan = out._jdf.queryExecution().toString()
    assert "_salt" in plan and "_stat_salt" in plan


def test_advantages_do_not_depend_on_salting(hot):
    keyed = hot.where("k is not null")
    for name in ("grpo", "grpo_vectorized", "rloo", "rloo_vectorized", "gpg", "flow_grpo"):
        one, many = (
            {r.id: r.advantage for r in adv.get_estimator(name)(keyed, group="k", score="v", hot_rows=h).collect()}
            for h in (10**6, 25)
        )
        assert one == pytest.approx(many)


def test_pass_at_k_picks_one_winner(hot):
    keyed = hot.where("k is not null")
    for h in (10**6, 25):
        out = adv.grpo_pass_at_k(keyed, group="k", score="v", row_key=["id"], hot_rows=h, norm_by_std=False)
        rows = out.collect()
        assert len(rows) == keyed.count()
        for k, members in _brute(keyed).items():
            top = sorted(members, key=lambda r: (-r.v, r.id))
            won = {r.id: r.advantage for r in rows if r.k == k and r.advantage}
            gap = top[0].v - top[1].v
            assert won == ({top[0].id: gap} if gap else {})


def test_pass_at_k_refuses_singletons(spark):
    df = spark.createDataFrame([(1, 1, 2.0)], "uid int, row_idx int, score double")
    with pytest.raises(Exception, match="at least 2"):
        adv.grpo_pass_at_k(df).collect()


def test_row_index_is_dense_and_ordered(hot):
    rows = with_row_index(hot, ["v", "id"]).collect()
    by_idx = sorted(rows, key=lambda r: r.row_idx)
    assert [r.row_idx for r in by_idx] == list(range(3000))
    assert [(r.v, r.id) for r in by_idx] == sorted((r.v, r.id) for r in rows)


def test_position_in_hot_group(hot):
    rows = position_in_group(hot, ["k"], ["v", "id"], hot_rows=40).collect()
    groups = _brute(hot)
    for r in rows:
        order = sorted((x.v, x.id) for x in groups[r.k])
        assert order[r.pos] == (r.v, r.id)


def test_last_wins(hot):
    got = {r.k: r.id for r in last_wins(hot, ["k"], ["v", "id"]).collect()}
    want = {k: max((x.v, x.id) for x in g)[1] for k, g in _brute(hot).items()}
    assert got == want


def test_exact_quantiles_match_linear_interpolation(hot):
    vs = [r.v + r.id / 7 for r in hot.collect()]
    out = exact_quantiles(hot.withColumn("x", F.col("v") + F.col("id") / 7), "x", [0.0, 0.5, 0.95, 0.99, 1.0])
    for r in out.collect():
        assert r.value == pytest.approx(np.quantile(vs, r.q))


def test_cumulative_over_blocks(hot):
    rows = cumulative(hot, "id", "v", "c", block=64).collect()
    want = np.cumsum([(i * 37) % 11 for i in range(3000)])
    assert all(r.c == pytest.approx(want[r.id]) for r in rows)


def test_registry_refuses_duplicates_and_unknown_names():
    with pytest.raises(ValueError):
        adv.register_estimator("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        adv.get_estimator("nope")


def test_centred_advantages_sum_to_zero(hot):
    keyed = hot.where("k is not null")
    sums = adv.grpo(keyed, group="k", score="v").groupBy("k").agg(F.sum("advantage").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s) < 1e-6 for r in sums if r.n > 1)
