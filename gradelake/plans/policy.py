"""Off-policy correction, KL and loss queries over document tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions.arrays import total
from gradelake.operators import losses as L
from gradelake.operators import offpolicy as off
from gradelake.plans.derived import SCORES_SQL, TOKENS_SQL, group_scores, tokens, trajectories, with_
from gradelake.plans.registry import query, table

TOK = with_(TOKENS_SQL)
SEQ_SQL = """, lr AS (SELECT *, old_lp - roll_lp AS r, greatest(least(old_lp - roll_lp, 20), -20) AS rs FROM tok),
 seq AS (SELECT traj, sum(mask) AS n, sum(r*mask) AS s, sum(rs*mask) AS ss, sum(old_lp*mask)/(sum(mask)+1e-8) AS lo, sum(roll_lp*mask)/(sum(mask)+1e-8) AS lb FROM lr GROUP BY traj)
"""


def _long(rows):
    return rows.select("metric", F.round("value", 6).alias("value"))


def _metric_sql(pairs: dict[str, str], source: str, prefix: str = "") -> str:
    items = ", ".join(f"{{'metric': '{prefix}{k}', 'value': round(({v})::DOUBLE, 6)}}" for k, v in pairs.items())
    return f"SELECT u.metric, u.value FROM (SELECT unnest([{items}]) AS u FROM {source})"


def _mm(x: str) -> str:
    return f"sum(({x})*mask)/(sum(mask)+1e-8)"


WEIGHT_SQL = {
    "token": "exp(rs)*mask",
    "sequence": "exp(greatest(least(s, 20), -20))*mask",
}


def _weights_cte(level: str, upper: float, lower: float | None) -> str:
    raw = WEIGHT_SQL[level]
    w = f"least({raw}, {upper})" if lower is None else f"CASE WHEN {raw} BETWEEN {lower} AND {upper} THEN {raw} ELSE 0 END"
    return f", w AS (SELECT lr.traj, t, mask, {raw} AS raw, {w} AS w, s FROM lr JOIN seq USING (traj)),\n sw AS (SELECT traj, {_mm('w')} AS q, max(s) AS s FROM w GROUP BY traj)\n"


def _weight_query(name: str, level: str, threshold, upper: float, lower: float | None, normalize: bool = False):
    scale = ""
    if normalize:
        mean = f"SELECT {_mm('w')} FROM w" if level == "token" else "SELECT avg(q) FROM sw JOIN seq USING (traj) WHERE n > 0"
        scale = f" / (SELECT CASE WHEN m > 1e-8 THEN m ELSE 1 END FROM ({mean}) x(m))"

    @query(
        name,
        TOK + SEQ_SQL + _weights_cte(level, upper, lower)
        + f"SELECT traj, round(sum(w){scale}, 6) AS weight_sum, round(max(w){scale}, 6) AS weight_max, round(ln(sum(raw) + 1), 6) AS raw_log_sum FROM w GROUP BY traj",
    )
    def run(spark, sf):
        df = off.importance_weights(trajectories(spark, sf), level, threshold, normalize)
        return df.select(
            "traj",
            F.round(total(F.col("weight")), 6).alias("weight_sum"),
            F.round(F.array_max("weight"), 6).alias("weight_max"),
            F.round(F.log(total(F.col("raw_weight")) + 1), 6).alias("raw_log_sum"),
        )


_weight_query("offp1_offp2_token_weights", "token", 1.4, 1.4, None)
_weight_query("offp1_offp2_sequence_weights", "sequence", 2.0, 2.0, None)
_weight_query("offp2_banded_token_weights", "token", "0.8_1.5", 1.5, 0.8)
_weight_query("offp3_normalised_token_weights", "token", 1.4, 1.4, None, True)
_weight_query("offp3_normalised_sequence_weights", "sequence", 2.0, 2.0, None, True)


def _weight_metrics_sql(level: str, upper: float, lower: float | None) -> dict[str, str]:
    lo = 1.0 / upper if lower is None else lower
    c = f"greatest(least(w, {upper}), 0)"
    out = {"rollout_is_mean": f"SELECT {_mm('w')} FROM w"}
    if level == "token":
        out |= {
            "rollout_is_max": "SELECT max(w) FROM w WHERE mask = 1",
            "rollout_is_min": "SELECT min(w) FROM w WHERE mask = 1",
            "rollout_is_ratio_fraction_high": f"SELECT {_mm(f'(raw > {upper})::INT')} FROM w",
            "rollout_is_ratio_fraction_low": f"SELECT {_mm(f'(raw < {lo})::INT')} FROM w",
        }
    else:
        out |= {
            "rollout_is_max": "SELECT exp(least(max(s), 20)) FROM sw",
            "rollout_is_min": "SELECT exp(min(s)) FROM sw",
            "rollout_is_ratio_fraction_high": f"SELECT avg((s > ln({upper}))::INT) FROM sw",
            "rollout_is_ratio_fraction_low": f"SELECT avg((s < ln({lo}))::INT) FROM sw",
        }
    out |= {
        "rollout_is_std": f"SELECT sqrt(greatest({_mm(f'{c}*{c}')} - pow({_mm(c)}, 2), 0)) FROM w",
        "rollout_is_eff_sample_size": f"SELECT 1 / ({_mm(f'{c}*{c}')} / pow({_mm(c)} + 1e-8, 2)) FROM w",
        "rollout_is_seq_mean": "SELECT avg(q) FROM sw",
        "rollout_is_seq_std": "SELECT stddev_samp(q) FROM sw",
        "rollout_is_seq_max": "SELECT max(q) FROM sw",
        "rollout_is_seq_min": "SELECT min(q) FROM sw",
        "rollout_is_seq_max_deviation": "SELECT max(abs(q - 1)) FROM sw",
        "rollout_is_seq_fraction_high": f"SELECT avg((q > {upper})::INT) FROM sw",
        "rollout_is_seq_fraction_low": f"SELECT avg((q < {lo})::INT) FROM sw",
    }
    if lower is not None:
        out["rollout_is_oob_ratio"] = f"SELECT {_mm(f'(raw < {lower} OR raw > {upper})::INT')} FROM w"
    return {k: f"({v})" for k, v in out.items()}


def _weight_metrics_query(name: str, level: str, threshold, upper: float, lower: float | None):
    @query(name, TOK + SEQ_SQL + _weights_cte(level, upper, lower) + _metric_sql(_weight_metrics_sql(level, upper, lower), "(SELECT 1)"))
    def run(spark, sf):
        return _long(off.weight_metrics(off.importance_weights(trajectories(spark, sf), level, threshold), level, threshold))


_weight_metrics_query("offp4_token_weight_metrics", "token", "0.8_1.5", 1.5, 0.8)
_weight_metrics_query("offp4_sequence_weight_metrics", "sequence", 2.0, 2.0, None)

RS_OPTIONS, RS_SPEC = "token_k1,token_k3,seq_sum_k1,seq_mean_k2,seq_max_k3", "0.6_1.5,0.08,0.05_20,0.1,0.2"
RS_CTE = (
    SEQ_SQL
    + """, k AS (SELECT traj, t, mask, -rs AS k1, 0.5*rs*rs AS k2, exp(rs)-1-rs AS k3 FROM lr),
 q AS (SELECT traj, sum(mask) AS n, sum(k1*mask) AS sk1, sum(k2*mask)/(sum(mask)+1e-8) AS mk2, coalesce(max(k3) FILTER (WHERE mask=1), 0) AS xk3,
         sum(k1*mask)/(sum(mask)+1e-8) AS mk1, sum(k3*mask)/(sum(mask)+1e-8) AS mk3 FROM k GROUP BY traj),
 v AS (SELECT k.*, n, sk1, mk2, xk3, mk1, mk3, (k1 BETWEEN ln(0.6) AND ln(1.5))::INT AS a1, (k3 <= 0.08)::INT AS a2,
         (sk1 BETWEEN ln(0.05) AND ln(20))::INT AS a3, (mk2 <= 0.1)::INT AS a4, (xk3 <= 0.2)::INT AS a5 FROM k JOIN q USING (traj)),
 f AS (SELECT *, mask*a1*a2*a3*a4*a5 AS nm FROM v)
"""
)


@query(
    "offp5_rejection_mask",
    TOK + RS_CTE + "SELECT traj, sum(mask)::BIGINT AS valid, sum(nm)::BIGINT AS kept FROM f GROUP BY traj",
)
def _(spark, sf):
    df = off.rejection_mask(trajectories(spark, sf), RS_OPTIONS, RS_SPEC)
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.select("traj", add(F.col("mask")).alias("valid"), add(F.col("new_mask")).alias("kept"))


def _rs_sql() -> dict[str, str]:
    import math

    out = {}
    spec = {
        "token_k1": ("k1", "a1", "mk1", math.log(0.6), math.log(1.5)),
        "token_k3": ("k3", "a2", "mk3", 0.0, 0.08),
        "seq_sum_k1": ("sk1", "a3", "sk1", math.log(0.05), math.log(20)),
        "seq_mean_k2": ("mk2", "a4", "mk2", 0.0, 0.1),
        "seq_max_k3": ("xk3", "a5", "xk3", 0.0, 0.2),
    }
    for name, (s, a, q, lo, hi) in spec.items():
        p, tok, k1 = f"rollout_rs_{name}", name.startswith("token"), name.endswith("k1")
        seqs = f"(SELECT traj, max({q}) AS q, min(CASE WHEN mask=1 THEN {a} ELSE 1 END) AS a FROM v WHERE n > 0 GROUP BY traj)"
        c = f"greatest(least({s}, {hi}), {lo})"
        out[f"{p}_mean"] = f"SELECT {_mm(s)} FROM v"
        out[f"{p}_max"] = f"SELECT max({s}) FROM v WHERE mask = 1" if tok else f"SELECT max(q) FROM {seqs}"
        out[f"{p}_min"] = f"SELECT min({s}) FROM v WHERE mask = 1" if tok else f"SELECT min(q) FROM {seqs}"
        out[f"{p}_fraction_high"] = f"SELECT {_mm(f'({s} > {hi})::INT')} FROM v" if tok else f"SELECT avg((q > {hi})::INT) FROM {seqs}"
        low = f"SELECT {_mm(f'({s} < {lo})::INT')} FROM v" if tok else f"SELECT avg((q < {lo})::INT) FROM {seqs}"
        out[f"{p}_fraction_low"] = low if k1 else "SELECT 0"
        out[f"{p}_std"] = f"SELECT sqrt(greatest({_mm(f'{c}*{c}')} - pow({_mm(c)}, 2), 0)) FROM v"
        out[f"{p}_seq_mean"] = f"SELECT avg(q) FROM {seqs}"
        out[f"{p}_seq_std"] = f"SELECT stddev_samp(q) FROM {seqs}"
        out[f"{p}_seq_max"] = f"SELECT max(q) FROM {seqs}"
        out[f"{p}_seq_min"] = f"SELECT min(q) FROM {seqs}"
        out[f"{p}_seq_max_deviation"] = f"SELECT max(abs(q)) FROM {seqs}"
        out[f"{p}_seq_fraction_high"] = f"SELECT avg((q > {hi})::INT) FROM {seqs}"
        if k1:
            out[f"{p}_seq_fraction_low"] = f"SELECT avg((q < {lo})::INT) FROM {seqs}"
        out[f"{p}_masked_fraction"] = f"SELECT {_mm(f'1-{a}')} FROM v"
        out[f"{p}_seq_masked_fraction"] = f"SELECT avg(1-a) FROM {seqs}"
    out["rollout_rs_masked_fraction"] = f"SELECT {_mm('1-a1*a2*a3*a4*a5')} FROM v"
    out["rollout_rs_seq_masked_fraction"] = "SELECT avg(b) FROM (SELECT max(mask - nm) AS b FROM f GROUP BY traj)"
    return {k: f"({v})" for k, v in out.items()}


@query("offp6_rejection_metrics", TOK + RS_CTE + _metric_sql(_rs_sql(), "(SELECT 1)"))
def _(spark, sf):
    df = off.rejection_mask(trajectories(spark, sf), RS_OPTIONS, RS_SPEC)
    return _long(off.rejection_metrics(df, RS_OPTIONS, RS_SPEC))


MISMATCH = {
    "training_ppl": "(SELECT avg(exp(-lo)) FROM seq)",
    "training_log_ppl": "(SELECT avg(-lo) FROM seq)",
    "kl": f"(SELECT {_mm('-r')} FROM lr)",
    "k3_kl": f"(SELECT {_mm('exp(r)-r-1')} FROM lr)",
    "rollout_ppl": "(SELECT avg(exp(-lb)) FROM seq)",
    "rollout_log_ppl": "(SELECT avg(-lb) FROM seq)",
    "log_ppl_diff": "(SELECT avg(lb-lo) FROM seq)",
    "log_ppl_abs_diff": "(SELECT avg(abs(lb-lo)) FROM seq)",
    "log_ppl_diff_max": "(SELECT max(lb-lo) FROM seq)",
    "log_ppl_diff_min": "(SELECT min(lb-lo) FROM seq)",
    "ppl_ratio": "(SELECT avg(exp(lb-lo)) FROM seq)",
    "chi2_token": f"(SELECT {_mm('exp(rs)*exp(rs)')} - 1 FROM lr)",
}
# chi2_seq is led by exp(2 * 20) terms; as ln(1 + x) it has as many stable decimals as the others
MISMATCH["chi2_seq"] = "(SELECT ln(avg(exp(2*greatest(least(s,20),-20)))) FROM seq)"


def _logged(metrics):
    value = F.when(F.col("metric").endswith("chi2_seq"), F.log1p("value")).otherwise(F.col("value"))
    return metrics.withColumn("value", value)


@query("offp7_mismatch_metrics", TOK + SEQ_SQL + _metric_sql(MISMATCH, "(SELECT 1)"))
def _(spark, sf):
    return _long(_logged(off.mismatch_metrics(trajectories(spark, sf))))


@query(
    "offp8_corrected_rollouts",
    TOK + RS_CTE + _weights_cte("token", 1.4, None)
    + "SELECT traj, round(sum(w.w), 6) AS weight_sum, sum(f.nm)::BIGINT AS kept FROM w JOIN f USING (traj, t) GROUP BY traj",
)
def _(spark, sf):
    df, _ = off.correct_rollouts(trajectories(spark, sf), "token", 1.4, options=RS_OPTIONS, spec=RS_SPEC)
    kept = F.aggregate("new_mask", F.lit(0).cast("long"), lambda s, x: s + x)
    return df.select("traj", F.round(total(F.col("weight")), 6).alias("weight_sum"), kept.alias("kept"))


@query(
    "offp8_correction_metrics",
    TOK + SEQ_SQL + _weights_cte("token", 1.4, None)
    + _metric_sql({**MISMATCH, **_weight_metrics_sql("token", 1.4, None)}, "(SELECT 1)", "rollout_corr/"),
)
def _(spark, sf):
    _, metrics = off.correct_rollouts(trajectories(spark, sf), "token", 1.4)
    return _long(_logged(metrics))


@query(
    "offp9_kl_estimators",
    TOK
    + """, d AS (SELECT traj, mask, new_lp - ref_lp AS k, greatest(least(ref_lp - new_lp, 20), -20) AS x FROM tok)
  SELECT traj, round(sum(k*mask), 6) + 0.0::DOUBLE AS k1, round(sum(abs(k)*mask), 6) AS abs_kl, round(sum(0.5*k*k*mask), 6) AS k2,
    round(sum(greatest(least(exp(x)-x-1, 10), -10)*mask), 6) AS k3 FROM d GROUP BY traj""",
)
def _(spark, sf):
    tok = tokens(spark, sf)
    lp, ref, m = F.col("new_lp"), F.col("ref_lp"), F.col("mask")
    kinds = {"k1": "k1", "abs_kl": "abs", "k2": "k2", "k3": "k3+"}
    return tok.groupBy("traj").agg(*[F.round(F.sum(L.kl_estimate(lp, ref, k) * m), 6).alias(n) for n, k in kinds.items()])


@query(
    "offp10_kl_in_reward",
    TOK
    + """, s AS (SELECT traj, sum(reward - 0.05*(old_lp-ref_lp)*mask) AS r, sum((old_lp-ref_lp)*mask)/(sum(mask)+1e-8) AS k FROM tok GROUP BY traj)
  SELECT traj, round(r, 6) AS token_reward, round(k, 6) + 0.0::DOUBLE AS seq_kl FROM s""",
)
def _(spark, sf):
    out = L.kl_in_reward(tokens(spark, sf), 0.05)
    return out.groupBy("traj").agg(
        F.round(F.sum("token_reward"), 6).alias("token_reward"),
        F.round(F.sum("kl") / (F.sum("mask") + F.lit(1e-8)), 6).alias("seq_kl"),
    )


FRAME = ["old_lp", "new_lp", "roll_lp", "ref_lp", "adv", "value", "mask"]
PL = """, p AS (SELECT tok.*, greatest(least(new_lp-old_lp, 20), -20) AS kl, exp(greatest(least(new_lp-old_lp, 20), -20)) AS ra,
    new_lp-old_lp AS d, n.sn, n.sk FROM tok JOIN (SELECT traj, sum(mask) AS sn, sum((new_lp-old_lp)*mask) AS sk FROM tok GROUP BY traj) n USING (traj)),
 vs AS (SELECT count(*) FILTER (WHERE sn > 0) AS c FROM (SELECT DISTINCT traj, sn FROM p))
"""


def _frame(spark, sf):
    return L.token_frame(trajectories(spark, sf), FRAME)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


CUT = "greatest(least({r}, 1.2), 0.8)"
LOSS_SQL = {
    "vanilla": dict(
        loss=f"CASE WHEN adv < 0 THEN least(-adv*3.0, greatest(-adv*ra, -adv*{CUT.format(r='ra')})) ELSE greatest(-adv*ra, -adv*{CUT.format(r='ra')}) END",
        pg_clipfrac=f"(-adv*{CUT.format(r='ra')} > -adv*ra)::INT",
        ppo_kl="-kl",
        pg_clipfrac_lower=f"(greatest(-adv*ra, -adv*{CUT.format(r='ra')}) > -adv*3.0 AND adv < 0)::INT",
    ),
    "dppo_tv": dict(
        loss="-adv*least(ra, 20)*new_lp*CASE WHEN adv > 0 THEN (exp(new_lp)-exp(old_lp) <= 0.2)::INT ELSE (exp(new_lp)-exp(old_lp) >= -0.2)::INT END",
        pg_clipfrac="1 - CASE WHEN adv > 0 THEN (exp(new_lp)-exp(old_lp) <= 0.2)::INT ELSE (exp(new_lp)-exp(old_lp) >= -0.2)::INT END",
        ppo_kl="-kl",
        pg_clipfrac_lower="(ra > 20)::INT",
    ),
    "cispo": dict(loss=f"-{CUT.format(r='ra')}*adv*new_lp", pg_clipfrac="(ra < 0.8 OR ra > 1.2)::INT", ppo_kl="-kl"),
    "gpg": dict(loss="-new_lp*adv"),
    "reinforce": dict(loss="-adv*new_lp", ppo_kl="-(new_lp-old_lp)"),
    "sapo": dict(
        loss="-adv * (4.0 / CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END) / (1 + exp(-(CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END) * (ra - 1)))",
        ppo_kl="-kl",
    ),
    "gspo": dict(
        loss=f"greatest(-adv*exp(least(sk/greatest(sn,1),10)), -adv*{CUT.format(r='exp(least(sk/greatest(sn,1),10))')})",
        pg_clipfrac=f"(-adv*{CUT.format(r='exp(least(sk/greatest(sn,1),10))')} > -adv*exp(least(sk/greatest(sn,1),10)))::INT",
        ppo_kl="-d",
    ),
    "dppo_kl": dict(
        loss="-adv*least(ra, 20)*new_lp*keep",
        pg_clipfrac="1-keep",
        ppo_kl="-kl",
        pg_clipfrac_lower="(ra > 20)::INT*keep",
    ),
}
KEEP = """, b AS (SELECT *, exp(old_lp)*(old_lp-new_lp) + (1-exp(old_lp))*ln((1-exp(old_lp)+1e-8)/(1-exp(new_lp)+1e-8)) AS bk FROM p),
 p2 AS (SELECT *, CASE WHEN adv > 0 THEN (bk <= 0.2 OR new_lp <= old_lp)::INT ELSE (bk <= 0.2 OR new_lp >= old_lp)::INT END AS keep FROM b)
"""


def _agg_sql(loss: str, mode: str) -> str:
    total_ = f"sum(({loss})*mask)"
    return {
        "token-mean": f"{total_}/sum(mask)",
        "seq-mean-token-sum": f"{total_}/(SELECT c FROM vs)",
        "seq-mean-token-sum-norm": f"{total_}/(SELECT c FROM vs)/1000",
        "seq-mean-token-mean": f"sum(({loss})*mask/(sn+1e-8))/(SELECT c FROM vs)",
    }[mode]


def _loss_query(name: str, loss: str, mode: str = "token-mean"):
    parts = dict(LOSS_SQL[loss])
    main = parts.pop("loss")
    cols = [f"round({_agg_sql(main, mode)}, 6) AS loss", *[f"round({_mm(v)}, 6) AS {k}" for k, v in parts.items()]]
    src = (KEEP, "p2") if loss == "dppo_kl" else ("", "p")

    @query(name, TOK + PL + src[0] + f"SELECT {', '.join(cols)} FROM {src[1]}")
    def run(spark, sf):
        per_token = mode == "token-mean"
        return _rounded(L.policy_loss((tokens if per_token else _frame)(spark, sf), loss, mode, scale=1000.0))


for _m in L.AGG_MODES:
    _loss_query("offp11_offp12_clip_loss_" + _m.replace("-", "_"), "vanilla", _m)
for _l in ("dppo_tv", "dppo_kl", "cispo", "gpg", "reinforce"):
    _loss_query(f"offp13_{_l}_loss", _l)
for _l in ("gspo", "sapo"):
    _loss_query(f"offp13_{_l}_loss", _l, "seq-mean-token-mean")


@query(
    "offp13_bypass_loss",
    TOK + PL.replace("new_lp-old_lp", "new_lp-roll_lp") + f"""SELECT round({_agg_sql(LOSS_SQL['vanilla']['loss'], 'token-mean')}, 6) AS loss,
      {', '.join(f"round({_mm(LOSS_SQL['vanilla'][k])}, 6) AS {k}" for k in ('pg_clipfrac', 'ppo_kl', 'pg_clipfrac_lower'))} FROM p""",
)
def _(spark, sf):
    return _rounded(L.bypass_loss(tokens(spark, sf)))


@query(
    "offp13_geo_mean_loss",
    TOK + PL
    + f""", g AS (SELECT traj, sum(sign(adv)*least(sign(adv)*d, sign(adv)*greatest(least(d, 0.2), -0.2))*mask) AS k, sum(adv*mask) AS a, sum(mask) AS n FROM p GROUP BY traj)
  SELECT (SELECT round(avg(-(a/(n+1e-8))*exp(k/(n+1e-8))), 6) FROM g) AS loss, round({_mm("(d < -0.2 OR d > 0.2)::INT*(adv > 0)::INT")}, 6) AS pg_clipfrac,
    round({_mm("-d")}, 6) AS ppo_kl, round({_mm("(d < -0.2 OR d > 0.2)::INT*(adv < 0)::INT")}, 6) AS pg_clipfrac_lower FROM p""",
)
def _(spark, sf):
    return _rounded(L.geo_mean_loss(tokens(spark, sf)))


@query(
    "offp13_so7_kl_covariance_loss",
    TOK + PL
    + f""", mu AS (SELECT avg(adv) AS ma, avg(new_lp) AS ml, count(*) AS nn FROM p WHERE mask = 1),
  c AS (SELECT p.*, row_number() OVER (ORDER BY CASE WHEN mask = 1 THEN (adv-ma)*(new_lp-ml) END DESC NULLS LAST, traj, t) AS r, nn FROM p, mu)
  SELECT round(sum((-adv*exp(d) + CASE WHEN mask = 1 AND r <= greatest(1, floor(nn*0.002)) THEN abs(d) ELSE 0 END)*mask)/sum(mask), 6) AS loss, round({_mm("abs(d)")}, 6) AS ppo_kl FROM c""",
)
def _(spark, sf):
    return _rounded(L.kl_cov_loss(tokens(spark, sf), ratio=0.002))


@query("offp13_clip_covariance_loss")
def _(spark, sf):
    return _rounded(L.clip_cov_loss(tokens(spark, sf), ratio=0.0002, lower=0.05, upper=5.0))


@query(
    "offp14_value_loss",
    TOK + PL
    + f"""SELECT round(0.5*sum(greatest(pow(adv-value,2), pow(greatest(least(adv,ref_lp+0.2),ref_lp-0.2)-value,2))*mask)/sum(mask), 6) AS vf_loss,
     round({_mm("(pow(greatest(least(adv,ref_lp+0.2),ref_lp-0.2)-value,2) > pow(adv-value,2))::INT")}, 6) AS vf_clipfrac FROM p""",
)
def _(spark, sf):
    return _rounded(L.value_loss(tokens(spark, sf), "adv", "value", "ref_lp", 0.2))


@query(
    "offp15_reweight_power",
    with_(SCORES_SQL) + "SELECT uid, part, supp, line, round(pow(abs(score), 2) + 1e-8, 6) AS weight FROM scores",
)
def _(spark, sf):
    out = L.reweight(group_scores(spark, sf))
    return out.select("uid", "part", "supp", "line", F.round("weight", 6).alias("weight"))


@query(
    "offp15_reweight_extremes",
    with_(SCORES_SQL)
    + """SELECT uid, part, supp, line, round(CASE WHEN score IN ((SELECT max(score) FROM scores), (SELECT min(score) FROM scores)) THEN 1 ELSE 0 END + 1e-8, 6) AS weight FROM scores""",
)
def _(spark, sf):
    out = L.reweight(group_scores(spark, sf), method="max_min")
    return out.select("uid", "part", "supp", "line", F.round("weight", 6).alias("weight"))


@query(
    "offp15_resample_counts",
    """WITH w AS (SELECT o_orderkey, ((o_orderkey * 7919) % 11)::DOUBLE AS weight, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
     c AS (SELECT *, sum(weight) OVER (ORDER BY i) AS cum, (SELECT sum(weight) / count(*) FROM w) AS unit, (SELECT count(*) FROM w) AS n FROM w)
     SELECT o_orderkey, CAST(CASE WHEN i = n THEN n ELSE ceil(cum / unit - 0.5) END - ceil((cum - weight) / unit - 0.5) AS BIGINT) AS copies FROM c""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % 11).cast("double").alias("weight"))
    return L.resample(rows, ["o_orderkey"]).select("o_orderkey", F.col("copies").cast("long").alias("copies"))


@query(
    "offp16_distillation_loss",
    TOK
    + """, d AS (SELECT greatest(least(ref_lp-new_lp, 20), -20) AS x FROM tok WHERE mask = 1), e AS (SELECT greatest(least(exp(x)-x-1, 10), -10) AS k FROM d)
  SELECT round(avg(abs(k)), 6) AS abs_loss, round(avg(k), 6) AS loss, round(min(k), 6) AS loss_min, round(max(k), 6) AS loss_max FROM e""",
)
def _(spark, sf):
    return _rounded(L.distillation_loss(tokens(spark, sf)))


@query(
    "offp17_flow_policy_loss",
    TOK
    + """, d AS (SELECT greatest(least(adv, 0.9), -0.9) AS a, new_lp-old_lp AS d, exp(new_lp-old_lp) AS r FROM tok)
  SELECT round(avg(greatest(-a*r, -a*greatest(least(r, 1.2), 0.8))), 6) AS loss, round(avg(-d), 6) AS ppo_kl, round(avg((abs(r-1) > 0.2)::INT), 6) AS pg_clipfrac,
    round(avg((r-1 > 0.2)::INT), 6) AS pg_clipfrac_higher, round(avg((1-r > 0.2)::INT), 6) AS pg_clipfrac_lower FROM d""",
)
def _(spark, sf):
    return _rounded(L.flow_policy_loss(tokens(spark, sf), 0.2, 0.9))


@query(
    "offp17_latent_kl",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
     d AS (SELECT vec_id, label, avg(pow(x - i / 100.0::DOUBLE, 2)) AS m FROM e GROUP BY ALL)
     SELECT round(avg(m / (2 * pow(label + 1, 2))), 6) AS kl_loss FROM d""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("m", F.col("embedding").cast("array<double>"))
    e = e.withColumn("ref", F.transform("m", lambda x, i: (i + 1) / F.lit(100.0)))
    return _rounded(L.latent_kl(e, "m", "ref", F.col("label") + 1.0))
