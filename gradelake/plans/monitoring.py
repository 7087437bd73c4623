"""Validation, bootstrap and training-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import metrics as M
from gradelake.operators import validation as V
from gradelake.plans.derived import SCORES_SQL, TOKENS_SQL, group_scores, tokens, with_
from gradelake.plans.registry import query, table

TOK = with_(TOKENS_SQL)
VAL_SQL = """WITH s AS (SELECT d.doc_id, source, lang AS uid, coalesce(quality, doc_id % 2)::DOUBLE AS acc, (n_chars % 7)::DOUBLE AS reward, 'p' || (n_chars % 3) AS pred
  FROM documents d LEFT JOIN labels USING (doc_id)),
 l AS (SELECT doc_id, source, uid, 'acc' AS var, acc AS v FROM s UNION ALL SELECT doc_id, source, uid, 'reward', reward FROM s),
 p AS (SELECT source, uid, var, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM l GROUP BY ALL),
 ps AS (SELECT source, uid, var, 'mean@' || n AS metric, m AS value FROM p UNION ALL SELECT source, uid, var, 'std@' || n, sd FROM p WHERE n > 1)
"""


def _samples(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(
        "doc_id",
        "source",
        F.col("lang").alias("uid"),
        F.coalesce("quality", F.col("doc_id") % 2).cast("double").alias("acc"),
        (F.col("n_chars") % 7).cast("double").alias("reward"),
        F.concat(F.lit("p"), (F.col("n_chars") % 3).cast("string")).alias("pred"),
    )


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _all(df):
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


@query("ag14_ag19_prompt_statistics", VAL_SQL + "SELECT source, uid, var, metric, round(value, 6) AS value FROM ps")
def _(spark, sf):
    return _r(V.prompt_statistics(_samples(spark, sf), ["source", "uid"], ["acc", "reward"]), "value")


@query(
    "ag19_text_and_empty_variables",
    VAL_SQL + """, h AS (SELECT source, uid, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM (SELECT *, CASE WHEN uid IN ('en', 'de') THEN reward / 2 END AS v FROM s) GROUP BY ALL)
  SELECT source, uid, var, metric, round(value, 6) AS value FROM ps WHERE var = 'acc'
  UNION ALL SELECT source, uid, 'half', 'mean@' || n, round(m, 6) FROM h WHERE m IS NOT NULL UNION ALL SELECT source, uid, 'half', 'std@' || n, round(sd, 6) FROM h WHERE n > 1 AND sd IS NOT NULL""",
)
def _(spark, sf):
    # pred is text and none has no value at all: both are skipped; half has none in some groups
    s = _samples(spark, sf).withColumns({"none": F.lit(None).cast("double"), "half": F.when(F.col("uid").isin("en", "de"), F.col("reward") / 2)})
    return _r(V.prompt_statistics(s, ["source", "uid"], ["acc", "pred", "none", "half"]), "value")


@query("ag14_validation_means", VAL_SQL + "SELECT source, var, metric, round(avg(value), 6) AS value FROM ps GROUP BY ALL")
def _(spark, sf):
    per = V.prompt_statistics(_samples(spark, sf), ["source", "uid"], ["acc", "reward"])
    return _r(per.groupBy("source", "var", "metric").agg(F.avg("value").alias("value")), "value")


@query("ag15_ag17_bootstrap_validation")
def _(spark, sf):
    return V.validation_metrics(_samples(spark, sf), "source", "uid", ["doc_id"], ["acc", "reward"], "pred")


@query(
    "ag15_ag17_counter_bootstrap",
    VAL_SQL
    + """, r AS (SELECT source, uid, acc, pred, row_number() OVER (PARTITION BY source, uid ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source, uid) AS total FROM s),
    g AS (SELECT DISTINCT source, uid, total FROM r WHERE total > 1),
    k AS (SELECT g.*, j.n FROM g, LATERAL (SELECT pow(2, i)::BIGINT AS n FROM generate_series(1, 40) q(i) WHERE pow(2, i) < g.total UNION SELECT g.total) j),
    d AS (SELECT source, uid, total, n, unnest(range(100 * n)) AS i FROM k),
    e AS (SELECT *, ('0x' || left(md5('7|' || total || '|' || n || '|' || i), 12))::BIGINT % total AS idx FROM d),
    pk AS (SELECT source, uid, n, i // n AS boot, i % n AS k, acc, pred FROM e JOIN r USING (source, uid, idx)),
    v AS (SELECT source, uid, n, boot, pred, count(*) AS c, min(k) AS k0, arg_min(acc, k) AS v FROM pk GROUP BY ALL),
    m AS (SELECT source, uid, n, boot, arg_max(v, (c, -k0)) AS maj FROM v GROUP BY ALL),
    b AS (SELECT source, uid, n, boot, max(acc) AS best, min(acc) AS worst FROM pk GROUP BY ALL),
    x AS (SELECT source, uid, n, unnest(['best', 'worst', 'maj']) AS name, unnest([best, worst, maj]) AS v FROM b JOIN m USING (source, uid, n, boot)),
    y AS (SELECT source, uid, n, name, avg(v) AS a, stddev_pop(v) AS sd FROM x GROUP BY ALL)
  SELECT source, uid, n, name || '@' || n || '/mean' AS metric, round(a, 6) AS value FROM y UNION ALL SELECT source, uid, n, name || '@' || n || '/std', round(sd, 6) FROM y""",
)
def _(spark, sf):
    return _r(V.bootstrap(_samples(spark, sf), ["source", "uid"], ["doc_id"], "acc", "pred", boots=100, seed=7, generator="counter"), "value")


@query(
    "ag16_resample_ladder",
    """WITH p AS (SELECT source, lang AS uid, count(*) AS n FROM documents GROUP BY ALL)
     SELECT source, uid, k.n AS size FROM p, LATERAL (SELECT pow(2, i)::BIGINT AS n FROM generate_series(1, 40) g(i) WHERE pow(2, i) < p.n AND p.n > 1 UNION SELECT p.n WHERE p.n > 1) k""",
)
def _(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", F.col("lang").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "uid", F.explode(V.ladder_column(F.col("n"))).alias("size"))


@query(
    "ag18_validation_names",
    VAL_SQL
    + """, a AS (SELECT source, var, metric, avg(value) AS value FROM ps GROUP BY ALL),
    x AS (SELECT source, var, max(string_split(metric, '@')[2]::BIGINT) AS mx FROM a GROUP BY ALL)
  SELECT CASE WHEN var = 'acc' AND regexp_matches(metric, '^(mean|maj|best)') AND contains(metric, '@' || mx) THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || var || '/' || metric AS name, round(value, 6) AS value
  FROM a JOIN x USING (source, var)""",
)
def _(spark, sf):
    per = V.prompt_statistics(_samples(spark, sf), ["source", "uid"], ["acc", "reward"])
    means = per.groupBy("source", "var", "metric").agg(F.avg("value").alias("value"))
    return _r(V.name_metrics(means, "source").select("name", "value"), "value")


@query(
    "ag13_offline_scores",
    """WITH w AS (SELECT doc_id, source, unnest(list_transform(string_split(text, ' '), lambda x: (length(x) % 2)::DOUBLE)) AS s FROM documents), r AS (SELECT doc_id, source, avg(s) AS m FROM w GROUP BY ALL)
     SELECT source, round(avg(m), 6) AS test_score FROM r GROUP BY source""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", F.transform(F.split("text", " "), lambda x: (F.length(x) % 2).cast("double")).alias("scores"))
    return _r(V.offline_scores(d, "source", "scores"), "test_score")


@query(
    "st5_merge_results",
    "SELECT doc_id, quality::INT AS acc, NULL::INT AS reward FROM labels UNION ALL SELECT doc_id, NULL, toxic::INT FROM labels",
)
def _(spark, sf):
    lab = table(spark, sf, "labels")
    return V.merge_results(lab.select("doc_id", F.col("quality").alias("acc")), lab.select("doc_id", F.col("toxic").alias("reward")))


NAMES_SQL = """
m AS (SELECT event_id, user_id % 8 AS rank, event_id // 8 AS step, value,
   CASE event_id % 12 WHEN 0 THEN 'loss/max' WHEN 1 THEN 'loss/min' WHEN 2 THEN 'loss/mean' WHEN 3 THEN 'timing_s/gen' WHEN 4 THEN 'timing_s/step' WHEN 5 THEN 'perf/total_num_tokens'
     WHEN 6 THEN 'perf/time_per_step' WHEN 7 THEN 'perf/throughput' WHEN 8 THEN 'training/global_step' WHEN 9 THEN 'global_seqlen/max' WHEN 10 THEN 'global_seqlen/min' ELSE 'global_seqlen/minmax_diff' END AS name FROM events)
"""
NAMES = [
    "loss/max", "loss/min", "loss/mean", "timing_s/gen", "timing_s/step", "perf/total_num_tokens", "perf/time_per_step", "perf/throughput",
    "training/global_step", "global_seqlen/max", "global_seqlen/min", "global_seqlen/minmax_diff",
]


def _metric_rows(spark, sf):
    e = table(spark, sf, "events")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("event_id") % 12 + 1).cast("int"))
    return e.select("event_id", (F.col("user_id") % 8).alias("rank"), F.floor(F.col("event_id") / 8).alias("step"), "value", name.alias("name"))


@query(
    "ag20_reduce_by_name",
    with_(NAMES_SQL)
    + "SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY name",
)
def _(spark, sf):
    return _r(M.reduce_by_name(_metric_rows(spark, sf)), "value")


@query(
    "ag21_reduce_across_ranks",
    """WITH g AS (SELECT event_type AS name, event_id // 8 AS step, avg(value) AS v FROM events GROUP BY ALL)
     SELECT 'mean' AS kind, round(avg(v), 6) AS value FROM (SELECT event_id // 8 AS step, avg(value) AS v FROM events WHERE event_id // 8 < (SELECT count(*) // 8 FROM events) GROUP BY 1)
     UNION ALL SELECT 'sum', round(sum(v), 4) FROM (SELECT event_id // 8 AS step, avg(value) AS v FROM events WHERE event_id // 8 < (SELECT count(*) // 8 FROM events) GROUP BY 1)
     UNION ALL SELECT 'max', round(max(value), 6) FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.lit("x").alias("name"), (F.col("event_id") % 8).alias("rank"), F.floor(F.col("event_id") / 8).alias("step"), "value"
    )
    parts = [
        M.reduce_across_ranks(e, k).select(F.lit(k).alias("kind"), F.round("value", 4 if k == "sum" else 6).alias("value")) for k in ("mean", "sum", "max")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "ag22_aggregate_steps",
    with_(NAMES_SQL)
    + """, a AS (SELECT name, CASE name WHEN 'loss/max' THEN max(value) WHEN 'loss/min' THEN min(value) WHEN 'loss/mean' THEN avg(value) WHEN 'timing_s/gen' THEN sum(value) WHEN 'timing_s/step' THEN sum(value)
      WHEN 'perf/total_num_tokens' THEN sum(value) WHEN 'perf/time_per_step' THEN sum(value) WHEN 'training/global_step' THEN arg_max(value, event_id) WHEN 'global_seqlen/max' THEN max(value) WHEN 'global_seqlen/min' THEN min(value) ELSE avg(value) END AS v FROM m GROUP BY name)
   SELECT name, round(CASE name WHEN 'perf/throughput' THEN (SELECT v FROM a WHERE name = 'perf/total_num_tokens') / ((SELECT v FROM a WHERE name = 'perf/time_per_step') * 16)
      WHEN 'global_seqlen/minmax_diff' THEN (SELECT v FROM a WHERE name = 'global_seqlen/max') - (SELECT v FROM a WHERE name = 'global_seqlen/min') ELSE v END, 4) AS value FROM a
   UNION ALL SELECT 'fully_async/trainer/idle_ratio', round((SELECT v FROM a WHERE name = 'timing_s/gen') / (SELECT v FROM a WHERE name = 'timing_s/step'), 4)""",
)
def _(spark, sf):
    out = M.aggregate_steps(_metric_rows(spark, sf), 16, ["step", "event_id"])
    return out.select("name", F.round("value", 4).alias("value"))


@query(
    "ag23_processing_times",
    """SELECT unnest(['avg','max','min','tp50','tp95','tp99']) AS metric, unnest([round(avg(value), 6), round(max(value), 6), round(min(value), 6), round(quantile_cont(value, 0.5), 6), round(quantile_cont(value, 0.95), 6), round(quantile_cont(value, 0.99), 6)]) AS value FROM events""",
)
def _(spark, sf):
    return _r(M.processing_times(table(spark, sf, "events"), "value"), "value")


@query(
    "ag24_partial_rollouts",
    """SELECT count(*) FILTER (WHERE event_id % 4 <> 0) AS total_partial_num, round(avg((event_id % 4 <> 0)::INT), 6) AS partial_ratio, max(event_id % 4)::BIGINT AS max_partial_span,
       count(DISTINCT event_id // 100) AS param_version_diversity FROM events""",
)
def _(spark, sf):
    v = F.floor(F.col("event_id") / 100)
    e = table(spark, sf, "events").select((v - F.col("event_id") % 4).alias("s"), v.alias("e"))
    return _all(M.partial_rollouts(e, "s", "e"))


@query(
    "ag25_slowest_sample",
    """WITH t AS (SELECT event_id, value AS gen, (user_id % 50)::DOUBLE AS tool, (event_id % 7)::DOUBLE AS score FROM events), s AS (SELECT * FROM t ORDER BY gen + tool + score DESC, event_id LIMIT 1)
     SELECT min(t.gen) AS "gen/min", max(t.gen) AS "gen/max", round(avg(t.gen), 6) AS "gen/mean", min(t.tool) AS "tool/min", max(t.tool) AS "tool/max", round(avg(t.tool), 6) AS "tool/mean",
       min(t.score) AS "score/min", max(t.score) AS "score/max", round(avg(t.score), 6) AS "score/mean", max(s.event_id) AS "slowest/event_id", max(s.gen) AS "slowest/gen", max(s.tool) AS "slowest/tool", max(s.score) AS "slowest/score" FROM t, s""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("gen"), (F.col("user_id") % 50).cast("double").alias("tool"), (F.col("event_id") % 7).cast("double").alias("score")
    )
    return _all(M.slowest_sample(e, ["gen", "tool", "score"], "event_id"))


THREE = "round(avg({x}), 6) AS \"{n}/mean\", max({x}) AS \"{n}/max\", min({x}) AS \"{n}/min\""


@query(
    "ag27_sequence_metrics",
    with_(SCORES_SQL)
    + "SELECT "
    + ", ".join(
        [
            THREE.format(x="CASE WHEN length > 0 THEN score END", n="score"),
            THREE.format(x="CASE WHEN length > 0 THEN score - 1 END", n="rewards"),
            THREE.format(x="length", n="response_length"),
            'round(avg((length = 49)::INT), 6) AS "response_length/clip_ratio"',
            THREE.format(x="CASE WHEN length > 0 THEN length END", n="response_length_non_aborted"),
            'round(avg(CASE WHEN length > 0 THEN (length = 49)::INT END), 6) AS "response_length_non_aborted/clip_ratio"',
            "round(avg((length = 0)::INT), 6) AS aborted_ratio",
            THREE.format(x="supp", n="prompt_length"),
            'round(avg((supp = 99)::INT), 6) AS "prompt_length/clip_ratio"',
            THREE.format(x="line", n="num_turns"),
        ]
    )
    + " FROM scores",
)
def _(spark, sf):
    s = group_scores(spark, sf).withColumn("reward", F.col("score") - 1)
    return _all(M.sequence_metrics(s, max_length=49, prompt_length="supp", max_prompt=99, turns="line"))


@query(
    "ag27_token_metrics",
    TOK
    + "SELECT " + ", ".join(THREE.format(x=f"CASE WHEN mask = 1 THEN {c} END", n=n) for c, n in (("adv", "advantages"), ("reward", "returns"), ("value", "values"))).replace("max(", "round(max(").replace("min(", "round(min(").replace(" END) AS", " END), 6) AS").replace("END), 6), 6)", "END), 6)")
    + ", round(1 - var_samp(CASE WHEN mask = 1 THEN reward - value END) / (var_samp(CASE WHEN mask = 1 THEN reward END) + 1e-5), 6) AS vf_explained_var FROM tok",
)
def _(spark, sf):
    return _all(M.token_metrics(tokens(spark, sf), returns="reward"))


@query(
    "ag28_ag29_timing_and_throughput",
    """WITH t AS (SELECT CASE event_type WHEN 'view' THEN 'gen' WHEN 'click' THEN 'ref' WHEN 'error' THEN 'values' WHEN 'purchase' THEN 'adv' ELSE 'update_actor' END AS name, sum(value) AS seconds FROM events GROUP BY 1),
      n AS (SELECT sum(l_partkey % 50) AS r, sum(l_suppkey + l_partkey % 50) AS a FROM lineitem)
     SELECT name, round(seconds, 4) AS seconds, round(seconds * 1000 / CASE WHEN name = 'gen' THEN r ELSE a END, 6) AS ms_per_token, round(a / (seconds * 8), 6) AS tokens_per_gpu_second FROM t, n""",
)
def _(spark, sf):
    stage = F.create_map(*[F.lit(x) for kv in {"view": "gen", "click": "ref", "error": "values", "purchase": "adv", "signup": "update_actor"}.items() for x in kv])
    t = table(spark, sf, "events").groupBy(stage[F.col("event_type")].alias("name")).agg(F.sum("value").alias("seconds"))
    s = group_scores(spark, sf).select(F.col("supp").alias("prompt_length"), F.col("length").alias("response_length"))
    total = s.agg(F.sum(F.col("prompt_length") + F.col("response_length")).alias("n"))
    out = M.timing_per_token(t, s).join(F.broadcast(total))
    return out.select(
        "name",
        F.round("seconds", 4).alias("seconds"),
        F.round("ms_per_token", 6).alias("ms_per_token"),
        F.round(M.throughput(F.col("n"), F.col("seconds"), 8), 6).alias("tokens_per_gpu_second"),
    )


@query(
    "ag30_variance_proxies",
    TOK
    + """, q AS (SELECT traj, sum(adv*mask)/(sum(mask)+1e-8) AS a, sum((1-2*exp(old_lp)+pi2)*mask) AS w FROM tok GROUP BY traj),
   z AS (SELECT avg(a*a*greatest(w, 0)) AS p, avg(a*a) AS ea, avg(w) AS ew, count(*) AS n FROM q)
   SELECT round(0.04::DOUBLE, 6) AS proxy1_signal_strength, round(p, 6) AS proxy2_total_power, round(greatest((p - 0.2*0.2)/(n-1), 0), 6) AS proxy3_pure_noise, round(ea, 6) AS expected_a_squared, round(ew, 6) AS expected_w FROM z""",
)
def _(spark, sf):
    return _all(M.variance_proxies(tokens(spark, sf), gradient_norm=0.2))


@query(
    "ag32_component_metrics",
    with_(SCORES_SQL)
    + 'SELECT round(avg(score), 6) AS "score/mean", round(stddev_pop(score), 6) AS "score/std", max(score) AS "score/max", min(score) AS "score/min", round(avg(line), 6) AS "line/mean", round(stddev_pop(line), 6) AS "line/std", max(line) AS "line/max", min(line) AS "line/min" FROM scores',
)
def _(spark, sf):
    return _all(M.component_metrics(group_scores(spark, sf), ["score", "line"]))


@query(
    "ag35_probability_gap",
    TOK
    + """, p AS (SELECT exp(old_lp) AS a, exp(roll_lp) AS b FROM tok WHERE mask = 1)
   SELECT 1 AS valid, round(max(abs(a-b)), 6) AS diff_max, round(avg(abs(a-b)), 6) AS diff_mean, round(stddev_samp(abs(a-b)), 6) AS diff_std, round(corr(a, b), 6) AS pearson_corr FROM p""",
)
def _(spark, sf):
    return _all(M.probability_gap(tokens(spark, sf)))


@query(
    "ag35_token_differences",
    TOK + "SELECT traj, sum((n % 7 <> (n + t) % 7 AND mask = 1)::INT)::INT AS differing FROM tok GROUP BY traj",
)
def _(spark, sf):
    from gradelake.plans.derived import trajectories

    a, b = F.transform("n", lambda x: x % 7), F.transform("n", lambda x, i: (x + i) % 7)
    return trajectories(spark, sf).select("traj", M.token_differences(a, b, F.col("mask")).alias("differing"))


@query("tx40_prefixed_names", with_(NAMES_SQL) + "SELECT 'actor/' || name AS name, count(*) AS n FROM m GROUP BY 1")
def _(spark, sf):
    return M.prefix_names(_metric_rows(spark, sf), "actor/").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
