"""Token-array queries: every word of every document is one response token."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import arrays as A
from gradelake.functions import logits as L
from gradelake.operators import tokens as tk
from gradelake.plans.derived import TOKENS_SQL, tokens, trajectories, with_
from gradelake.plans.registry import query, table

TOK = with_(TOKENS_SQL)
# mean and 1/sqrt(var) of a masked column, as an oracle CTE
STATS_SQL = """, mu AS (SELECT sum(mask) AS n, sum({x}*mask)/(sum(mask)+1e-8) AS mean FROM {t}),
 st AS (SELECT max(mu.n) AS n, max(mean) AS mean, sum(({x}-mean)*({x}-mean)*mask)/(max(mu.n)+1e-8)*max(mu.n)/(max(mu.n)-1) AS var FROM {t}, mu)
"""


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _digest(df, adv, traj="traj", mask=None):
    """Per trajectory: token count, sum and position-weighted mean of a token column."""
    v = F.col(adv) if mask is None else F.col(adv) * F.col(mask)
    out = df.groupBy(traj).agg(
        F.count(F.lit(1)).alias("tokens"),
        F.sum(v).alias("total"),
        (F.sum(v * (F.col("t") + 1)) / F.count(F.lit(1))).alias("weighted"),
    )
    return out.withColumns({c: F.round(c, 4) for c in ("total", "weighted")})


def _array_digest(df, adv, traj="traj"):
    """The digest of advantage arrays whose places are in ``t``, without a row per token."""
    zero = F.lit(0.0)
    spread = F.zip_with(adv, "t", lambda a, t: a * (t + 1))
    add = lambda a, x: a + x
    n = F.size("t").cast("long")
    out = df.select(traj, n.alias("tokens"), F.aggregate(adv, zero, add).alias("total"), (F.aggregate(spread, zero, add) / n).alias("weighted"))
    return out.where("tokens > 0").withColumns({c: F.round(c, 4) for c in ("total", "weighted")})


DIGEST = "traj, count(*) AS tokens, round(sum({x}), 4) AS total, round(sum(({x}) * (t + 1)) / count(*), 4) AS weighted"


@query(
    "ag34_masked_stats",
    TOK + STATS_SQL.format(x="value", t="tok")
    + "SELECT n::BIGINT AS n, round((SELECT sum(value*mask) FROM tok), 4) AS total, round(mean, 6) AS mean, round(var, 6) AS var FROM st",
)
def _(spark, sf):
    return _r(tk.masked_stats(tokens(spark, sf), "value"), "mean", "var").withColumn("total", F.round("total", 4))


@query(
    "ag34_masked_whiten",
    TOK + STATS_SQL.format(x="value", t="tok") + "SELECT " + DIGEST.format(x="(value-mean)/sqrt(var+1e-8)*mask") + " FROM tok, st GROUP BY traj",
)
def _(spark, sf):
    return _digest(tk.whiten(tokens(spark, sf), "value"), "whitened", mask="mask")


@query(
    "wn12_remax",
    TOK
    + """, r AS (SELECT *, sum(reward*mask) OVER (PARTITION BY traj ORDER BY t DESC) AS ret FROM tok)
   SELECT """
    + DIGEST.format(x="ret - (traj % 4) / 2.0::DOUBLE * mask")
    + " FROM r GROUP BY traj",
)
def _(spark, sf):
    t = trajectories(spark, sf).withColumn("ret", A.reward_to_go(F.col("reward"), F.col("mask")))
    rows = tk.explode_tokens(t, ["traj"], ["ret", "mask"])
    rows = rows.withColumn("a", F.col("ret") - (F.col("traj") % 4) / F.lit(2.0) * F.col("mask"))
    return _digest(rows, "a")


GAE_SQL = """, l AS (SELECT traj, list({r: reward, v: value, m: mask, nv: 0.0::DOUBLE, ga: 0.0::DOUBLE, o: []::DOUBLE[]} ORDER BY t DESC) AS a FROM tok GROUP BY traj),
 f AS (SELECT traj, list_reduce(list_prepend({r: 0.0::DOUBLE, v: 0.0::DOUBLE, m: 0, nv: 0.0::DOUBLE, ga: 0.0::DOUBLE, o: []::DOUBLE[]}, a),
   lambda s, x: {r: x.r, v: x.v, m: x.m, nv: CASE WHEN x.m = 1 THEN x.v ELSE s.nv END,
      ga: CASE WHEN x.m = 1 THEN x.r + 0.99 * s.nv - x.v + 0.99 * 0.95 * s.ga ELSE s.ga END,
      o: list_append(s.o, CASE WHEN x.m = 1 THEN x.r + 0.99 * s.nv - x.v + 0.99 * 0.95 * s.ga ELSE s.ga END)}).o AS o FROM l),
 g AS (SELECT traj, unnest(list_reverse(o)) AS adv, generate_subscripts(o, 1) - 1 AS t FROM f),
 j AS (SELECT tok.traj, tok.t, tok.mask, tok.value, g.adv FROM tok JOIN g USING (traj, t))
"""


@query(
    "wn10_gae",
    TOK + GAE_SQL + STATS_SQL.format(x="adv", t="j")
    + """SELECT traj, count(*) AS tokens, round(sum((adv-mean)/sqrt(var+1e-8)*mask), 6) AS total,
      round(sum((adv-mean)/sqrt(var+1e-8)*mask*(t+1))/count(*), 6) AS weighted, round(sum(adv + value), 6) AS returns FROM j, st GROUP BY traj""",
)
def _(spark, sf):
    t = trajectories(spark, sf).withColumn("g", A.gae(F.col("reward"), F.col("value"), F.col("mask"), 0.99, 0.95))
    t = t.select("traj", "mask", F.col("g.advantages").alias("adv"), F.col("g.returns").alias("ret"))
    rows = tk.whiten(tk.explode_tokens(t, ["traj"], ["adv", "ret", "mask"]), "adv")
    v = F.col("whitened") * F.col("mask")
    out = rows.groupBy("traj").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.sum(v).alias("total"),
        (F.sum(v * (F.col("t") + 1)) / F.count(F.lit(1))).alias("weighted"),
        F.sum("ret").alias("returns"),
    )
    return _r(out, "total", "weighted", "returns")


RPP_SQL = """, l AS (SELECT traj, list({r: reward, m: mask, run: 0.0::DOUBLE, o: []::DOUBLE[]} ORDER BY t DESC) AS a FROM tok GROUP BY traj),
 f AS (SELECT traj, list_reduce(list_prepend({r: 0.0::DOUBLE, m: 0, run: 0.0::DOUBLE, o: []::DOUBLE[]}, a),
   lambda s, x: {r: x.r, m: x.m, run: (x.r + 0.9 * s.run) * x.m, o: list_append(s.o, x.r + 0.9 * s.run)}).o AS o FROM l),
 g AS (SELECT traj, unnest(list_reverse(o)) AS ret, generate_subscripts(o, 1) - 1 AS t FROM f),
 j AS (SELECT tok.traj, tok.t, tok.mask, g.ret FROM tok JOIN g USING (traj, t))
"""


@query(
    "wn11_reinforce_plus_plus",
    TOK + RPP_SQL + STATS_SQL.format(x="ret", t="j") + "SELECT " + DIGEST.format(x="(ret-mean)/sqrt(var+1e-8)*mask") + " FROM j, st GROUP BY traj",
)
def _(spark, sf):
    t = trajectories(spark, sf).withColumn("ret", A.discounted_returns(F.col("reward"), F.col("mask"), 0.9))
    rows = tk.whiten(tk.explode_tokens(t, ["traj"], ["ret", "mask"]), "ret")
    return _digest(rows, "whitened", mask="mask")


OTB_SQL = """, b0 AS (SELECT *, sum(reward*mask) OVER (PARTITION BY traj ORDER BY t DESC) AS g,
     sum((1 - 2*exp(old_lp) + pi2)*mask) OVER (PARTITION BY traj ORDER BY t) AS w, sum(mask) OVER (PARTITION BY traj) AS len,
     {step} AS step FROM tok),
 b1 AS (SELECT * FROM b0 WHERE {keep}),
 lens AS (SELECT DISTINCT uid, traj, len FROM b1),
 grp AS (SELECT uid, count(*) AS gn, max(len) AS mx, list(len ORDER BY len DESC)[2] AS sec FROM lens GROUP BY uid),
 st AS (SELECT uid, step, sum(g*w*mask)/(sum(w*mask)+1e-8) AS base FROM b1 GROUP BY uid, step),
 res AS (SELECT traj, t, mask, g, CASE WHEN gn = 1 THEN 0 WHEN len = mx AND mx > sec AND step >= sec THEN 0 ELSE base END AS base
         FROM b1 JOIN st USING (uid, step) JOIN grp USING (uid))
"""


def _with_energy(spark, sf):
    t = trajectories(spark, sf)
    energy = F.zip_with(
        F.zip_with("old_lp", "pi2", lambda lp, p: 1 - 2 * F.exp(lp) + p), "mask", lambda w, m: w * m
    )
    return t.select(
        "traj", "uid", "mask", A.reward_to_go(F.col("reward"), F.col("mask")).alias("returns"), A.running_sum(energy).alias("energy")
    )


@query(
    "wn13_optimal_token_baseline",
    TOK + OTB_SQL.format(step="t", keep="true") + "SELECT " + DIGEST.format(x="(g - base)*mask") + " FROM res GROUP BY traj",
)
def _(spark, sf):
    return _array_digest(tk.baseline_arrays(_with_energy(spark, sf)), "advantage")


@query(
    "wn14_multi_turn_token_baseline",
    TOK
    + OTB_SQL.format(step="sum(mask) OVER (PARTITION BY traj ORDER BY t) - 1", keep="mask = 1")
    + "SELECT " + DIGEST.format(x="(g - base)*mask") + " FROM res GROUP BY traj",
)
def _(spark, sf):
    return _array_digest(tk.baseline_arrays(_with_energy(spark, sf), compact=True), "advantage")


@query(
    "wn19_response_mask",
    TOK
    + """, e AS (SELECT traj, size, min(t) FILTER (WHERE n % 31 IN (17, 19)) AS f FROM tok GROUP BY traj, size)
   SELECT traj, size::BIGINT AS tokens, coalesce(f + 1, size)::BIGINT AS valid FROM e""",
)
def _(spark, sf):
    t = trajectories(spark, sf)
    mask = A.response_mask(F.transform("n", lambda x: x % 31), [17, 19])
    return t.select("traj", F.size("n").cast("long").alias("tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m).alias("valid"))


@query(
    "ar1_reward_at_last_token",
    TOK
    + """, v AS (SELECT traj, size, sum(mask) AS k FROM tok GROUP BY ALL)
   SELECT traj, CASE WHEN k > 0 THEN k - 1 ELSE size - 1 END::BIGINT AS at, (traj % 7 + 1)::DOUBLE AS total FROM v""",
)
def _(spark, sf):
    t = trajectories(spark, sf).withColumn("r", A.reward_at_last((F.col("traj") % 7 + 1).cast("double"), F.col("mask")))
    return t.select("traj", (F.array_position("r", (F.col("traj") % 7 + 1).cast("double")) - 1).alias("at"), A.total(F.col("r")).alias("total"))


@query(
    "ar2_overlong_penalty",
    "SELECT doc_id, round(least(-((n_chars - 1500) / 500.0::DOUBLE) * 0.5, 0), 6) AS penalty FROM documents",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.round(A.overlong_penalty(F.col("n_chars"), 2000, 500, 0.5), 6).alias("penalty"))


@query(
    "ar3_two_phase_mask",
    """WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS k, len(string_split(lang, ' ')) + 2 AS inj, length(source) AS k2 FROM documents)
     SELECT doc_id, least(k + inj + k2, 400)::BIGINT AS size, (least(k, 400) + greatest(least(k2, 400 - k - inj), 0))::BIGINT AS model_tokens FROM d""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("a"), F.split("source", "").alias("b"))
    ids, mask = A.two_phase(F.col("a"), F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("b"), 400)
    return d.select(
        "doc_id", F.size(ids).cast("long").alias("size"), F.aggregate(mask, F.lit(0).cast("long"), lambda s, m: s + m).alias("model_tokens")
    )


@query(
    "ar4_ar6_lengths_from_mask",
    TOK + "SELECT traj, sum(mask)::BIGINT AS valid, count(*) AS tokens, sum(n * mask)::BIGINT AS kept FROM tok GROUP BY traj",
)
def _(spark, sf):
    t = trajectories(spark, sf)
    kept = A.remove_pad(F.col("n"), F.col("mask"))
    return t.select(
        "traj",
        F.size(kept).cast("long").alias("valid"),
        F.size("n").cast("long").alias("tokens"),
        F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"),
    )


@query(
    "ar5_pad_and_truncate",
    """WITH d AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS n FROM documents)
     SELECT doc_id, list_sum(n[1:200])::BIGINT AS right_cut, list_sum(n[greatest(len(n) - 199, 1):])::BIGINT AS left_cut,
        200::BIGINT AS size, greatest(200 - len(n), 0)::BIGINT AS pads FROM d""",
)
def _(spark, sf):
    t = trajectories(spark, sf)
    n = F.col("n").cast("array<bigint>")
    add = lambda a: F.aggregate(F.filter(a, lambda x: x >= 0), F.lit(0).cast("long"), lambda s, x: s + x)
    right, left = A.pad_to(n, 200, -1, "right"), A.pad_to(n, 200, -1, "left", left=True)
    return t.select(
        F.col("traj").alias("doc_id"),
        add(right).alias("right_cut"),
        add(left).alias("left_cut"),
        F.size(right).cast("long").alias("size"),
        F.size(F.filter(right, lambda x: x < 0)).cast("long").alias("pads"),
    )


@query(
    "ar7_ar8_sft_loss_tokens",
    """SELECT conv_id, turn, len(string_split(text, ' '))::BIGINT AS tokens,
        CASE WHEN role = 'assistant' THEN greatest(len(string_split(text, ' ')) - 2, 0) ELSE 0 END::BIGINT AS loss_tokens,
        (len(string_split(text, ' ')) - 1)::BIGINT AS last_position FROM conversations""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("ids", F.split("text", " "))
    mask = A.sft_message_mask(F.col("role"), F.col("ids"), F.lit(2))
    return c.select(
        "conv_id",
        "turn",
        F.size("ids").cast("long").alias("tokens"),
        F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m).alias("loss_tokens"),
        F.array_max(A.position_ids(F.col("ids"))).cast("long").alias("last_position"),
    )


@query(
    "ar9_preference_pairs",
    """SELECT doc_id, lang AS prompt, text || '</s>' AS chosen, source || '</s>' AS rejected FROM documents""",
)
def _(spark, sf):
    pair = A.preference_pair(F.col("lang"), F.col("text"), F.col("source"), "</s>")
    d = table(spark, sf, "documents").select("doc_id", pair.alias("p"))
    return d.select(
        "doc_id",
        F.element_at("p", 1)["prompt"].alias("prompt"),
        F.element_at("p", 1)["response"].alias("chosen"),
        F.element_at("p", 2)["response"].alias("rejected"),
    )


# an embedding is one position's logits, the label the id that was drawn
LOGITS_SQL = """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE * {by}) AS x FROM embeddings),
  m AS (SELECT *, list_max(x) AS top FROM x),
  s AS (SELECT *, list_sum(list_transform(x, lambda v: exp(v - top))) AS total, list_sum(list_transform(x, lambda v: exp(v - top) * v)) AS weighted,
     list_sum(list_transform(x, lambda v: exp(2 * (v - top)))) AS squares FROM m)
  SELECT vec_id, round(top + ln(total), 6) AS log_sum_exp, round(top + ln(total) - weighted / total, 6) AS entropy,
    round(x[label + 1] - top - ln(total), 6) AS log_prob, round(squares / (total * total), 6) AS sum_pi_squared FROM s"""


def _figures(df, m, twice):
    return _r(
        df.select(
            "vec_id", L.log_sum_exp(m).alias("log_sum_exp"), L.entropy(m).alias("entropy"),
            L.log_prob(F.col("logit"), m).alias("log_prob"), L.sum_of_squares(m, twice).alias("sum_pi_squared"),
        ),
        "log_sum_exp", "entropy", "log_prob", "sum_pi_squared",
    )


def _logits(spark, sf, by):
    x = F.transform("embedding", lambda v: v.cast("double") * by)
    return table(spark, sf, "embeddings").select("vec_id", x.alias("x"), F.get(x, F.col("label")).alias("logit"))


@query("ar10_logit_figures", LOGITS_SQL.format(by=10))
def _(spark, sf):
    rows = _logits(spark, sf, 10).withColumns({"m": L.mass(F.col("x")), "twice": L.mass(F.col("x"), 2.0)})
    return _figures(rows, F.col("m"), F.col("twice"))


@query("ar10_chunked_logits", LOGITS_SQL.format(by=1000))
def _(spark, sf):
    rows = _logits(spark, sf, 1000)
    parts = L.chunked(rows, ["vec_id"], "x", 16).select("vec_id", F.struct(L.mass(F.col("x")).alias("m"), L.mass(F.col("x"), 2.0).alias("twice")).alias("both"))
    whole = L.merged(parts.select("vec_id", F.col("both.m").alias("m")), ["vec_id"], "m").join(
        L.merged(parts.select("vec_id", F.col("both.twice").alias("twice")), ["vec_id"], "twice"), "vec_id"
    )
    return _figures(rows.select("vec_id", "logit").join(whole, "vec_id"), F.col("m"), F.col("twice"))
