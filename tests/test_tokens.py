import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.functions import arrays as A
from gradelake.operators import losses as L
from gradelake.operators import offpolicy as off
from gradelake.operators import tokens as tk

rng = np.random.default_rng(7)


@pytest.fixture(scope="module")
def trajs(spark):
    rows = []
    for i in range(40):
        n = int(rng.integers(1, 200)) if i else 1
        m = (rng.random(n) > 0.3).astype(int)
        if i == 1:
            m[:] = 0
        rows.append(
            (i, i // 4, rng.normal(size=n).tolist(), rng.normal(size=n).tolist(), m.tolist(), (-rng.random(n)).tolist(), (-rng.random(n)).tolist(), rng.random(n).tolist())
        )
    ddl = "traj int, uid int, reward array<double>, value array<double>, mask array<int>, old_lp array<double>, roll_lp array<double>, pi2 array<double>"
    return spark.createDataFrame(rows, ddl)


def test_gae_matches_the_plain_recursion(trajs):
    for r in trajs.select("*", A.gae(F.col("reward"), F.col("value"), F.col("mask"), 0.97, 0.9).alias("g")).collect():
        nxt = last = 0.0
        want = []
        for t in range(len(r.reward) - 1, -1, -1):
            cand = r.reward[t] + 0.97 * nxt - r.value[t] + 0.97 * 0.9 * last
            nxt = r.value[t] if r.mask[t] else nxt
            last = cand if r.mask[t] else last
            want.append(last)
        want = want[::-1]
        assert r.g.advantages == pytest.approx(want, abs=1e-9)
        assert r.g["returns"] == pytest.approx(np.add(want, r.value), abs=1e-9)


def test_discounted_returns_restart(trajs):
    for r in trajs.select("*", A.discounted_returns(F.col("reward"), F.col("mask"), 0.9).alias("g")).collect():
        run, want = 0.0, []
        for t in range(len(r.reward) - 1, -1, -1):
            run = r.reward[t] + 0.9 * run
            want.append(run)
            run *= r.mask[t]
        assert r.g == pytest.approx(want[::-1])


@pytest.mark.parametrize("compact", [False, True])
@pytest.mark.parametrize("hot_rows", [10**6, 2])
def test_token_baseline_matches_loops(trajs, compact, hot_rows):
    t = trajs.withColumn("returns", A.reward_to_go(F.col("reward"), F.col("mask")))
    t = t.withColumn("energy", A.running_sum(F.zip_with(F.zip_with("old_lp", "pi2", lambda a, p: 1 - 2 * F.exp(a) + p), "mask", lambda w, m: w * m)))
    got = {(r.traj, r.t): r.advantage for r in tk.token_baseline(t, compact=compact, hot_rows=hot_rows).collect()}
    groups = {}
    for r in t.collect():
        if not compact or sum(r.mask):
            groups.setdefault(r.uid, []).append(r)
    for members in groups.values():
        pos = {r.traj: [i for i, m in enumerate(r.mask) if m] if compact else list(range(len(r.mask))) for r in members}
        lens = sorted(sum(r.mask) for r in members)
        for r in members:
            for step, i in enumerate(pos[r.traj]):
                num = den = 0.0
                for o in members:
                    if step < len(pos[o.traj]):
                        j = pos[o.traj][step]
                        num += o["returns"][j] * o.energy[j] * o.mask[j]
                        den += o.energy[j] * o.mask[j]
                base = num / (den + 1e-8) if len(members) > 1 else 0.0
                if len(members) > 1 and sum(r.mask) == lens[-1] > lens[-2] and step >= lens[-2]:
                    base = 0.0
                assert got[r.traj, i] == pytest.approx((r["returns"][i] - base) * r.mask[i], abs=1e-6)


def test_masked_stats_and_whitening(trajs):
    tok = tk.explode_tokens(trajs, ["traj"], ["value", "mask"])
    v, m = (np.concatenate([r[c] for r in trajs.collect()]) for c in ("value", "mask"))
    mean = (v * m).sum() / (m.sum() + 1e-8)
    var = (((v - mean) ** 2) * m).sum() / (m.sum() + 1e-8) * m.sum() / (m.sum() - 1)
    s = tk.masked_stats(tok, "value").first()
    assert (s["mean"], s["var"]) == pytest.approx((mean, var))
    w = tk.whiten(tok, "value").agg(F.sum(F.col("whitened") * F.col("mask")).alias("s"), F.sum(F.col("whitened") ** 2 * F.col("mask")).alias("q")).first()
    assert w.s == pytest.approx(0, abs=1e-5)
    assert w.q == pytest.approx(m.sum() - 1, rel=1e-6)


def test_masked_variance_needs_two_tokens(spark):
    with pytest.raises(Exception, match="at least two"):
        tk.masked_stats(spark.createDataFrame([(1.0, 1), (2.0, 0)], "v double, mask int"), "v").collect()


def test_response_mask_examples(spark):
    df = spark.createDataFrame([([20, 10, 34, 1, 0, 0, 0],), ([78, 0, 76, 2, 1, 0, 0],), ([23, 98, 1, 0, 0, 0, 0],), ([33, 3, 98, 45, 1, 0, 0],)], "ids array<int>")
    one = [r[0] for r in df.select(A.response_mask(F.col("ids"), [1])).collect()]
    assert one == [[1, 1, 1, 1, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0], [1, 1, 1, 0, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0]]
    both = [r[0] for r in df.select(A.response_mask(F.col("ids"), [1, 2])).collect()]
    assert both[1] == [1, 1, 1, 1, 0, 0, 0]


def test_reward_lands_on_last_slot_without_valid_tokens(spark):
    df = spark.createDataFrame([([1, 1, 0],), ([0, 0, 0],)], "mask array<int>")
    assert [r[0] for r in df.select(A.reward_at_last(F.lit(2.0), F.col("mask"))).collect()] == [[0, 2, 0], [0, 0, 2]]


def test_two_phase_injection_and_padding(spark):
    df = spark.createDataFrame([([1, 2, 9], [7, 7], [3])], "a array<int>, b array<int>, c array<int>")
    ids, mask = A.two_phase(F.col("a"), F.col("b"), F.col("c"), 5)
    r = df.select(ids.alias("i"), mask.alias("m"), A.injects(F.col("a"), 9, 2, 8).alias("y"), A.injects(F.col("a"), 9, 2, 5).alias("n")).first()
    assert (r.i, r.m, r.y, r.n) == ([1, 2, 9, 7, 7], [1, 1, 1, 0, 0], True, False)
    with pytest.raises(Exception, match="longer than"):
        df.select(A.pad_to(F.col("a"), 2, 0)).collect()


def test_threshold_parsers():
    assert off.parse_weight_threshold(2.0) == (2.0, None)
    assert off.parse_weight_threshold("0.5_2") == (2.0, 0.5)
    for bad in ("", "x", "-1", "2_1", "0_1"):
        with pytest.raises(ValueError):
            off.parse_weight_threshold(bad)
    with pytest.raises(TypeError):
        off.parse_weight_threshold(True)
    b = off.parse_rejection("token_k1,seq_sum_k3,token_k1", "2,0.5")
    assert b["token_k1"] == pytest.approx((np.log(0.5), np.log(2))) and b["seq_sum_k3"] == (0.0, 0.5)
    for args in (("nope", 1), ("", 1), ("token_k2", None), ("token_k2", "0.1_0.2"), ("token_k1,token_k2", "1,2,3")):
        with pytest.raises(ValueError):
            off.parse_rejection(*args)


def test_sequence_chi_squared(trajs):
    got = {r.metric: r.value for r in off.mismatch_metrics(trajs).collect()}
    sums = [np.clip(sum((a - b) * m for a, b, m in zip(r.old_lp, r.roll_lp, r.mask)), -20, 20) for r in trajs.collect()]
    assert got["chi2_seq"] == pytest.approx(np.mean(np.exp(2 * np.array(sums))) - 1, rel=1e-9)


def test_kl_controller_and_loss_names(spark):
    assert L.adapt_kl_coefficient(0.1, 9.0, 1.0, 100, 10) == pytest.approx(0.1 * 1.02)
    assert L.adapt_kl_coefficient(0.1, 1.1, 1.0, 100, 10) == pytest.approx(0.1 * 1.01)
    with pytest.raises(ValueError):
        L.adapt_kl_coefficient(0.1, 1, 1, 0, 1)
    with pytest.raises(NotImplementedError):
        L.kl_estimate(F.lit(0.0), F.lit(0.0), "full")
    with pytest.raises(ValueError):
        L.policy_loss(spark.range(1), "nope")
    with pytest.raises(ValueError):
        L.register_loss("vanilla")(lambda *a: {})


def test_resample_counts_add_up(spark):
    df = spark.createDataFrame([(i, 50.0 if i == 3 else 1.0) for i in range(60)], "id int, weight double")
    rows = {r.id: r.copies for r in L.resample(df, ["id"]).collect()}
    assert sum(rows.values()) == 60 and rows[3] in (27, 28) and min(rows.values()) >= 0


def test_clip_covariance_drops_the_stated_number(spark):
    toks = [(i % 9, i, 1, float(np.cos(i)), -float((i * 7) % 13) / 3, -float((i * 5) % 11) / 3) for i in range(400)]
    df = spark.createDataFrame(toks, "traj int, t int, mask int, adv double, old_lp double, new_lp double")
    out = L.clip_cov_loss(df, ratio=0.01, lower=0.0, upper=10.0).first()
    assert out.pg_clipfrac == pytest.approx(4 / 400, rel=1e-6)


def test_running_sums_keep_nulls_and_odd_lengths(spark):
    rows = [(0, [1.0, 2.0, 4.0], [1, 0, 1]), (1, None, [1]), (2, [], []), (3, [5.0], None), (4, [3.0, None], [1, 1]), (5, [2.0], [1])]
    df = spark.createDataFrame(rows, "traj int, r array<double>, m array<int>").coalesce(1)
    got = df.select("traj", A.reward_to_go(F.col("r"), F.col("m")).alias("g"), A.running_sum(F.col("r")).alias("s"), A.discounted_returns(F.col("r"), F.col("m"), 0.5).alias("d"))
    # Arrow arrays, without a pandas object per row
    assert A._reward_to_go.evalType == A._running_sum.evalType == F.arrow_udf(lambda x: x, "int").evalType
    out = {r.traj: r for r in got.collect()}
    assert [out[0][c] for c in "gsd"] == [[5.0, 4.0, 4.0], [1.0, 3.0, 7.0], [1.0, 4.0, 4.0]]
    assert [out[1][c] for c in "gsd"] == [None, None, None] and [out[2][c] for c in "gsd"] == [[], [], []]
    assert [out[3][c] for c in "gsd"] == [None, [5.0], None] and [out[5][c] for c in "gsd"] == [[2.0], [2.0], [2.0]]
    assert out[4].s[0] == 3.0
