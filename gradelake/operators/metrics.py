"""Training-side metrics over long metric tables and trajectory rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.operators.groups import exact_quantiles


def group_spread(df: DataFrame, group: str, score: str) -> DataFrame:
    """Share of groups with no spread, mean per-group population std, mean group size."""
    g = df.groupBy(group).agg(F.stddev_pop(score).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.avg((F.col("s") == 0).cast("double")).alias("zero_std_ratio"),
        F.avg("s").alias("mean_std"),
        F.avg("n").alias("mean_group_size"),
    )


def reduce_by_name(metrics: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Per metric: max if the name says max, min if it says min, else the mean."""
    n = F.col(name)
    agg = metrics.groupBy(name).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg(value).alias("mean"))
    pick = F.when(F.contains(n, F.lit("max")), F.col("hi")).when(F.contains(n, F.lit("min")), F.col("lo")).otherwise(F.col("mean"))
    return agg.select(name, pick.alias(value))


def reduce_across_ranks(metrics: DataFrame, kind: str, rank="rank", step="step", name="name", value="value") -> DataFrame:
    """Typed metric: sum/mean average each step over ranks first, min/max are flat. Ragged ranks are refused."""
    if kind not in ("mean", "sum", "min", "max"):
        raise ValueError(f"unknown aggregation {kind!r}")
    if kind in ("min", "max"):
        return metrics.groupBy(name).agg(getattr(F, kind)(value).alias(value))
    widths = metrics.groupBy(name, rank).agg(F.count(F.lit(1)).alias("c")).groupBy(name)
    ragged = widths.agg((F.max("c") != F.min("c")).alias("ragged"))
    steps = metrics.groupBy(name, step).agg(F.avg(value).alias("v")).groupBy(name).agg(getattr(F, kind)("v").alias(value))
    bad = F.raise_error(F.lit("ranks hold different numbers of values")).cast("double")
    return steps.join(ragged, name).select(name, F.when(F.col("ragged"), bad).otherwise(F.col(value)).alias(value))


# Metrics with an explicit rule; all others go by the words in their name.
STEP_RULES = {
    "time_sum": ["perf/time_per_step"],
    "min": ["timing_s/agent_loop/tool_calls/min"],
    "avg": ["timing_s/agent_loop/tool_calls/mean"],
    "max": ["timing_s/agent_loop/tool_calls/max"],
    "last": [
        "fully_async/count/total_generated_samples",
        "fully_async/count/stale_samples_processed",
        "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version",
        "fully_async/count/dropped_stale_samples",
        "training/global_step",
    ],
}


def step_rule(name: Column) -> Column:
    low = F.lower(name)
    has = lambda *words: F.rlike(low, F.lit("|".join(words)))
    out = None
    for rule, names in STEP_RULES.items():
        out = F.when(name.isin(names), rule) if out is None else out.when(name.isin(names), rule)
    return (
        out.when(has("timing_s/"), "time_sum")
        .when(has("mean", "avg", "average"), "avg")
        .when(has("max", "maximum"), "max")
        .when(has("min", "minimum"), "min")
        .when(has("sum", "total"), "sum")
        .otherwise("avg")
    )


def aggregate_steps(metrics: DataFrame, total_gpus: int, order: Sequence[str], name="name", value="value") -> DataFrame:
    """Combine per-step metrics by rule, then recompute throughput, idle ratio and the length gap."""
    agg = metrics.groupBy(name).agg(
        F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.max_by(value, F.struct(*order)).alias("last"),
    )
    rule = step_rule(F.col(name))
    v = (
        F.when(rule.isin("sum", "time_sum"), F.col("sum"))
        .when(rule == "max", F.col("max"))
        .when(rule == "min", F.col("min"))
        .when(rule == "last", F.col("last"))
        .otherwise(F.col("avg"))
    )
    base = agg.select(name, v.alias(value))
    # one row per metric name: the derived figures read at most a handful of them
    pick = lambda key: F.max(F.when(F.col(name) == key, F.col(value)))
    wide = base.agg(
        pick("global_seqlen/max").alias("smax"), pick("global_seqlen/min").alias("smin"), pick("global_seqlen/minmax_diff").alias("sdiff"),
        pick("perf/total_num_tokens").alias("tok"), pick("perf/time_per_step").alias("time"), pick("perf/throughput").alias("thr"),
        pick("timing_s/gen").alias("gen"), pick("timing_s/step").alias("step"),
    )
    derived = wide.select(
        F.explode(
            F.array(
                F.struct(F.lit("global_seqlen/minmax_diff").alias(name), F.when(F.col("sdiff").isNotNull(), F.col("smax") - F.col("smin")).alias("new")),
                F.struct(F.lit("perf/throughput").alias(name), F.when(F.col("thr").isNotNull(), F.col("tok") / (F.col("time") * total_gpus)).alias("new")),
                F.struct(F.lit("fully_async/trainer/idle_ratio").alias(name), (F.col("gen") / F.col("step")).alias("new")),
            )
        ).alias("d")
    ).select(f"d.{name}", "d.new").where("new is not null")
    return base.join(derived, name, "full").select(name, F.coalesce("new", value).alias(value))


def processing_times(df: DataFrame, value: str) -> DataFrame:
    """(metric, value): avg, max, min and exact tp50/tp95/tp99 over the whole column."""
    basics = df.agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"))
    names = {0.5: "tp50", 0.95: "tp95", 0.99: "tp99"}
    tps = exact_quantiles(df, value, list(names))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("q"))
    return basics.unpivot([], ["avg", "max", "min"], "metric", "value").unionByName(tps.select(label.alias("metric"), "value"))


def partial_rollouts(df: DataFrame, start: str, end: str) -> DataFrame:
    """How many rollouts span weight versions, the widest span, and how many versions there are."""
    span = F.abs(F.col(end) - F.col(start))
    return df.agg(
        F.count(F.when(span != 0, 1)).alias("total_partial_num"),
        F.avg((span != 0).cast("double")).alias("partial_ratio"),
        F.max(span).alias("max_partial_span"),
        F.countDistinct(end).alias("param_version_diversity"),
    )


def slowest_sample(df: DataFrame, timings: Sequence[str], index: str, extra: Sequence[str] = ()) -> DataFrame:
    """min/max/mean of each timing, and the row whose timings add up highest (first index on ties)."""
    total = sum((F.col(t) for t in timings[1:]), F.col(timings[0]))
    stats = [f(t).alias(f"{t}/{n}") for t in timings for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    row = F.max_by(F.struct(index, *timings, *extra), F.struct(total.alias("t"), -F.col(index)))
    wide = df.agg(*stats, row.alias("slowest"))
    return wide.select("*", *[F.col("slowest")[c].alias(f"slowest/{c}") for c in (index, *timings, *extra)]).drop("slowest")


def _three(value: Column, name: str) -> list[Column]:
    return [F.avg(value).alias(f"{name}/mean"), F.max(value).alias(f"{name}/max"), F.min(value).alias(f"{name}/min")]


def sequence_metrics(df: DataFrame, score="score", reward="reward", length="length", max_length: int = 0, prompt_length: str | None = None, max_prompt: int = 0, turns: str | None = None) -> DataFrame:
    """Scores, rewards, lengths, clip and abort ratios over trajectory rows; aborted ones do not score."""
    n = F.col(length)
    live = lambda c: F.when(n > 0, c)
    share = lambda c: F.avg(c.cast("double"))
    aggs = [
        *_three(live(F.col(score)), "score"),
        *_three(live(F.col(reward)), "rewards"),
        *_three(n, "response_length"),
        share(n == max_length).alias("response_length/clip_ratio"),
        *_three(live(n), "response_length_non_aborted"),
        F.avg(live((n == max_length).cast("double"))).alias("response_length_non_aborted/clip_ratio"),
        share(n == 0).alias("aborted_ratio"),
    ]
    if prompt_length:
        p = F.col(prompt_length)
        aggs += [*_three(p, "prompt_length"), share(p == max_prompt).alias("prompt_length/clip_ratio")]
    if turns:
        aggs += _three(F.col(turns), "num_turns")
    return df.agg(*aggs)


def token_metrics(tok: DataFrame, adv="adv", returns="returns", values: str | None = "value", mask="mask") -> DataFrame:
    """Advantage, return and value figures over valid tokens, and the value function's explained variance."""
    live = lambda c: F.when(F.col(mask) != 0, F.col(c))
    aggs = [*_three(live(adv), "advantages"), *_three(live(returns), "returns")]
    if values:
        gap = F.var_samp(live(returns) - live(values))
        aggs += [*_three(live(values), "values"), (1.0 - gap / (F.var_samp(live(returns)) + F.lit(1e-5))).alias("vf_explained_var")]
    return tok.agg(*aggs)


def timing_per_token(timings: DataFrame, lengths: DataFrame, name="name", seconds="seconds", prompt="prompt_length", response="response_length") -> DataFrame:
    """Milliseconds per token: generation over response tokens, the other stages over all tokens."""
    totals = lengths.agg(F.sum(response).alias("r"), F.sum(F.col(prompt) + F.col(response)).alias("all"))
    tokens = F.when(F.col(name) == "gen", F.col("r")).when(
        F.col(name).isin("ref", "values", "adv", "update_critic", "update_actor"), F.col("all")
    )
    return timings.join(F.broadcast(totals)).select(name, seconds, (F.col(seconds) * 1000 / tokens).alias("ms_per_token"))  # one row


def throughput(tokens: Column, seconds: Column, gpus: int) -> Column:
    return tokens / (seconds * gpus)


def variance_proxies(tok: DataFrame, traj="traj", adv="adv", lp="old_lp", pi2="pi2", mask="mask", weight: str | None = None, gradient_norm: float | None = None) -> DataFrame:
    """Signal strength, total power and noise proxies, with E[A^2] and E[W]."""
    m, w = F.col(mask), 1 - 2 * F.exp(F.col(lp)) + F.col(pi2)
    rho = F.lit(1.0) if weight is None else F.col(weight)
    n = F.sum(m) + F.lit(1e-8)
    seq = tok.groupBy(traj).agg(
        (F.sum(F.col(adv) * m) / n).alias("a"),
        F.sum(w * rho * rho * m).alias("w"),
        (F.sum(rho * m) / n).alias("r"),
        F.sum(w * rho * rho / F.greatest(rho * rho, F.lit(1e-10)) * m).alias("w0"),
    )
    a2 = F.col("a") * F.col("a")
    power = F.avg(F.col("r") * F.col("r") * a2 * F.greatest("w0", F.lit(0.0))) if weight else F.avg(a2 * F.greatest("w", F.lit(0.0)))
    signal = F.lit(0.0 if gradient_norm is None else float(gradient_norm) ** 2)
    noise = F.when(F.count(F.lit(1)) > 1, F.greatest((power - signal) / (F.count(F.lit(1)) - 1), F.lit(0.0))).otherwise(F.lit(0.0))
    return seq.agg(
        F.max(signal).alias("proxy1_signal_strength"),
        power.alias("proxy2_total_power"),
        (noise if gradient_norm is not None else F.max(F.lit(0.0))).alias("proxy3_pure_noise"),
        F.avg(a2).alias("expected_a_squared"),
        F.avg("w").alias("expected_w"),
    )


def component_metrics(df: DataFrame, components: Sequence[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}/{n}") for c in components for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.max, "max"), (F.min, "min"))])


def probability_gap(tok: DataFrame, actor="old_lp", rollout="roll_lp", mask="mask") -> DataFrame:
    """Actor against rollout token probabilities: largest, mean and std difference, and their correlation."""
    a, b = (F.when(F.col(mask) != 0, F.exp(F.col(c))) for c in (actor, rollout))
    gap = F.abs(a - b)
    return tok.agg(
        F.max((F.col(mask) != 0).cast("int")).alias("valid"),
        F.max(gap).alias("diff_max"),
        F.avg(gap).alias("diff_mean"),
        F.stddev_samp(gap).alias("diff_std"),
        F.corr(a, b).alias("pearson_corr"),
    )


def token_differences(a: Column, b: Column, mask: Column) -> Column:
    """Number of positions under the mask where two id arrays differ."""
    same = F.zip_with(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), mask, lambda d, m: F.when(m == 1, d).otherwise(F.lit(0)))
    return F.aggregate(same, F.lit(0), lambda s, d: s + d)


def merge_meta(parts: Sequence[dict]) -> dict:
    """Batch-level info of concatenated batches: metric lists are joined, other keys must agree."""
    merged: dict = {}
    for part in parts:
        for key, value in part.items():
            if key == "metrics":
                merged.setdefault(key, []).extend(value if isinstance(value, list) else [value])
            elif merged.setdefault(key, value) != value:
                raise ValueError(f"conflicting values for {key!r}")
    return merged


def prefix_names(metrics: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    return metrics.withColumn(name, F.concat(F.lit(prefix), name))
