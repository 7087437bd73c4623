"""Group-relative advantage queries over lineitem-derived rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import advantage as adv
from gradelake.operators.groups import with_row_index
from gradelake.plans.derived import SCORES_SQL, group_scores, with_
from gradelake.plans.registry import query

G = """, g AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s, var_samp(score) AS v, sum(score) AS t,
  sum(length*score) AS ws, sum(length) AS wl FROM scores GROUP BY uid)
"""
ROW = "s.uid, s.part, s.supp, s.line, s.score"
OUT = ["uid", "part", "supp", "line", "score", "advantage"]


def _sql(expr: str, extra: str = "") -> str:
    return with_(SCORES_SQL) + G + extra + f"SELECT {ROW}, round({expr}, 6) AS advantage FROM scores s JOIN g USING (uid)"


def _out(df):
    return df.withColumn("advantage", F.round("advantage", 6)).select(*OUT)


def _simple(name: str, estimator: str, expr: str, extra: str = "", **kw):
    @query(name, _sql(expr, extra))
    def run(spark, sf):
        return _out(adv.get_estimator(estimator)(group_scores(spark, sf), **kw))

    return run


M0 = "CASE WHEN n > 1 THEN m ELSE 0 END"
S1 = "CASE WHEN n > 1 THEN s ELSE 1 END"
_simple("wn1_grpo", "grpo", f"(score - {M0}) / ({S1} + 1e-6)")
_simple("wn1_grpo_without_std", "grpo", f"score - {M0}", norm_by_std=False)
_simple("wn2_grpo_floored_variance", "grpo_vectorized", f"(score - {M0}) / (CASE WHEN n > 1 THEN sqrt(greatest(v, 1e-6)) ELSE 1 END + 1e-6)")
_simple("wn6_rloo", "rloo", "CASE WHEN n > 1 THEN score - (t - score) / (n - 1) ELSE score END")
_simple("wn7_rloo_sum_form", "rloo_vectorized", "CASE WHEN n > 1 THEN score - (t - score) / (n - 1) ELSE 0 END")
_simple("wn8_opo", "opo", "score - CASE WHEN n > 1 THEN ws / nullif(wl, 0) ELSE 0 END")
_simple(
    "wn9_gpg",
    "gpg",
    f"(SELECT count(*) / greatest(count(*) FILTER (WHERE score <> 0), 1) FROM scores) * (score - {M0})",
)
_simple(
    "wn15_flow_grpo_global_std",
    "flow_grpo",
    "CASE WHEN n > 1 THEN score - m ELSE 0 END / ((SELECT stddev_samp(score) FROM scores) + 1e-6)",
)
_simple("wn15_flow_grpo_group_std", "flow_grpo", f"CASE WHEN n > 1 THEN score - m ELSE 0 END / ({S1} + 1e-6)", global_std=False)
WHITEN = """, c AS (SELECT s.*, {expr} AS x FROM scores s JOIN g USING (uid)),
 q AS (SELECT sum(length) AS k, sum(length*x)/(sum(length)+1e-8) AS mu FROM c),
 r AS (SELECT max(k) AS k, max(mu) AS mu, sum(length*(x-mu)*(x-mu))/(max(k)+1e-8)*max(k)/(max(k)-1) AS var FROM c, q)
"""


@query(
    "wn5_reinforce_baseline_whitened",
    with_(SCORES_SQL) + G + WHITEN.format(expr=f"score - {M0}")
    + "SELECT uid, part, supp, line, score, round((x - mu) / sqrt(var + 1e-8), 6) AS advantage FROM c, r",
)
def _(spark, sf):
    return _out(adv.reinforce_pp_baseline(group_scores(spark, sf)))


@query(
    "wn3_gdpo",
    with_(SCORES_SQL)
    + """, g AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s, avg(line) AS m2, stddev_samp(line) AS s2 FROM scores GROUP BY uid)"""
    + WHITEN.format(
        expr=f"(score - {M0}) / ({S1} + 1e-6) * 1.0 + 0.5 * (line - CASE WHEN n > 1 THEN m2 ELSE 0 END) / (CASE WHEN n > 1 THEN s2 ELSE 1 END + 1e-6)"
    )
    + "SELECT uid, part, supp, line, score, round((x - mu) / sqrt(var + 1e-8), 6) AS advantage FROM c, r",
)
def _(spark, sf):
    return _out(adv.gdpo(group_scores(spark, sf), ["score", "line"], [1.0, 0.5]))


@query(
    "wn4_so7_grpo_pass_at_k",
    with_(SCORES_SQL)
    + """, b AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY uid ORDER BY score DESC, part, supp, line) AS r,
        stddev_samp(score) OVER w AS s FROM scores WINDOW w AS (PARTITION BY uid)),
      k AS (SELECT *, lead(score) OVER (PARTITION BY uid ORDER BY r) AS nxt FROM b)
   SELECT uid, part, supp, line, score, CASE WHEN n = 1 THEN NULL WHEN r = 1 THEN round((score - nxt) / (s + 1e-6), 6) ELSE 0 END AS advantage FROM k""",
)
def _(spark, sf):
    # the row key has to tell every row of a group apart; a group of one has no advantage
    rows = group_scores(spark, sf).withColumn("row_idx", F.monotonically_increasing_id())
    return _out(adv.grpo_pass_at_k(rows, row_key=["part", "supp", "line", "row_idx"], lone="null"))


SESSIONS_SQL = """, ses AS (SELECT uid, part % 3 AS session_id, part AS traj_index, supp, line, score FROM scores),
 f AS (SELECT uid, session_id, max(traj_index) AS traj_index, arg_max(score, {i: traj_index, s: supp, l: line, q: score}) AS score FROM ses GROUP BY ALL),
 fg AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s FROM f GROUP BY uid)
"""


@query(
    "wn16_jn10_multi_trajectory_grpo",
    with_(SCORES_SQL) + SESSIONS_SQL
    + f"""SELECT ses.uid, ses.session_id, ses.traj_index, ses.supp, ses.line, round((f.score - {M0}) / ({S1} + 1e-6), 6) AS advantage
   FROM ses JOIN f USING (uid, session_id) JOIN fg ON fg.uid = ses.uid""",
)
def _(spark, sf):
    s = group_scores(spark, sf)
    rows = s.select(
        "uid", (F.col("part") % 3).alias("session_id"), F.struct("part", "supp", "line", "score").alias("ord"), "score", "part", "supp", "line"
    )
    out = adv.multi_trajectory(rows, index="ord")
    return out.select(
        "uid", "session_id", F.col("part").alias("traj_index"), "supp", "line", F.round("advantage", 6).alias("advantage")
    )


@query(
    "ag26_group_mean_std",
    with_(SCORES_SQL)
    + """SELECT uid, round(CASE WHEN count(*) > 1 THEN avg(score) ELSE 0 END, 6) AS mean,
       round(CASE WHEN count(*) > 1 THEN sqrt(greatest(var_samp(score), 1e-6)) ELSE 1 END, 6) AS std, count(*) AS "count" FROM scores GROUP BY uid""",
)
def _(spark, sf):
    out = adv.group_mean_std(group_scores(spark, sf))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "ag31_group_spread",
    with_(SCORES_SQL)
    + """, d AS (SELECT uid, count(*) AS n, stddev_pop(score) AS s FROM scores GROUP BY uid)
   SELECT round(avg(CASE WHEN s = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_std_ratio, round(avg(s), 6) AS mean_std, round(avg(n), 6) AS mean_group_size FROM d""",
)
def _(spark, sf):
    from gradelake.operators.metrics import group_spread

    out = group_spread(group_scores(spark, sf), "uid", "score")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "wn20_dense_group_index",
    with_(SCORES_SQL) + "SELECT uid, dense_rank() OVER (ORDER BY uid) - 1 AS group_index FROM (SELECT DISTINCT uid FROM scores)",
)
def _(spark, sf):
    return with_row_index(group_scores(spark, sf).select("uid").distinct(), ["uid"], "group_index")
