"""Group-relative advantages over one row per trajectory.

Input: a group column, a ``score`` and, for some estimators, a ``length``. Every estimator returns the
input plus ``advantage``; multiply by the response mask (``tokens.spread_over_mask``) for tokens.
Group statistics come from ``join_group_stats``: partial aggregation plus a salted join back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.operators.groups import join_group_stats, join_skewed, top_per_group

EPS = 1e-6
Estimator = Callable[..., DataFrame]
ESTIMATORS: dict[str, Estimator] = {}


def register_estimator(name: str) -> Callable[[Estimator], Estimator]:
    def add(fn: Estimator) -> Estimator:
        if name in ESTIMATORS and ESTIMATORS[name] is not fn:
            raise ValueError(f"estimator {name!r} is already registered")
        ESTIMATORS[name] = fn
        return fn

    return add


def get_estimator(name: str) -> Estimator:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


def _stats(df: DataFrame, group: str, score: str, hot_rows: int | None = None) -> DataFrame:
    return join_group_stats(
        df, [group], [F.avg(score).alias("g_mean"), F.stddev_samp(score).alias("g_std")], hot_rows
    )


_STAT_COLS = ["group_n", "g_mean", "g_std"]


def _mean_or_zero() -> Column:
    return F.when(F.col("group_n") > 1, F.col("g_mean")).otherwise(F.lit(0.0))


def _std_or_one() -> Column:
    return F.when(F.col("group_n") > 1, F.col("g_std")).otherwise(F.lit(1.0))


@register_estimator("grpo")
def grpo(df, group="uid", score="score", norm_by_std=True, eps=EPS, hot_rows=None):
    """(score - mean) / (sample std + eps); a lone row keeps mean 0 and std 1."""
    centred = F.col(score) - _mean_or_zero()
    adv = centred / (_std_or_one() + eps) if norm_by_std else centred
    return _stats(df, group, score, hot_rows).withColumn("advantage", adv).drop(*_STAT_COLS)


@register_estimator("grpo_vectorized")
def grpo_floored(df, group="uid", score="score", norm_by_std=True, eps=EPS, hot_rows=None):
    """As ``grpo`` with the variance floored at eps before the root."""
    std = F.when(F.col("group_n") > 1, F.sqrt(F.greatest(F.col("g_std") * F.col("g_std"), F.lit(eps)))).otherwise(F.lit(1.0))
    centred = F.col(score) - _mean_or_zero()
    adv = centred / (std + eps) if norm_by_std else centred
    return _stats(df, group, score, hot_rows).withColumn("advantage", adv).drop(*_STAT_COLS)


@register_estimator("grpo_passk")
def grpo_pass_at_k(df, group="uid", score="score", row_key: Sequence[str] = ("row_idx",), norm_by_std=True, eps=EPS, hot_rows=None, lone: str = "error"):
    """Only the best row of a group scores: best minus runner-up. Ties go to the first ``row_key``.

    A group of one has no runner-up: an error, or with ``lone="null"`` a row without an advantage.
    """
    order = [F.col(score).desc(), *[F.col(c).asc() for c in row_key]]
    top = top_per_group(df.select(group, score, *row_key), [group], order, 2, "_rank")
    gap = top.groupBy(group).agg(
        F.max(score).alias("g_best"), F.min(score).alias("g_second"), *[F.min_by(c, "_rank").alias(f"g_{c}") for c in row_key]
    )
    spread = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_n"), F.stddev_samp(score).alias("g_std"))
    stats = spread.join(gap, group)
    joined = join_skewed(df, stats, [group], "group_n", hot_rows, sizes=spread)
    won = F.lit(True)
    for c in row_key:
        won = won & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    gain = F.col("g_best") - F.col("g_second")
    if norm_by_std:
        gain = gain / (F.col("g_std") + eps)
    too_small = F.lit(None) if lone == "null" else F.raise_error(F.lit("at least 2 rows per group are needed"))
    adv = F.when(F.col("group_n") < 2, too_small.cast("double")).when(won, gain).otherwise(F.lit(0.0))
    return joined.withColumn("advantage", adv).drop("group_n", "g_std", "g_best", "g_second", *[f"g_{c}" for c in row_key])


@register_estimator("rloo")
def rloo(df, group="uid", score="score", hot_rows=None):
    """Leave-one-out mean as baseline; a lone row keeps its score."""
    n = F.col("group_n")
    out = F.when(n > 1, F.col(score) * n / (n - 1) - F.col("g_mean") * n / (n - 1)).otherwise(F.col(score))
    return _stats(df, group, score, hot_rows).withColumn("advantage", out).drop(*_STAT_COLS)


@register_estimator("rloo_vectorized")
def rloo_sum(df, group="uid", score="score", hot_rows=None):
    """(n*score - sum) / (n-1); a lone row gets 0."""
    n = F.col("group_n")
    joined = join_group_stats(df, [group], [F.sum(score).alias("g_sum")], hot_rows)
    out = F.when(n > 1, (n * F.col(score) - F.col("g_sum")) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))
    return joined.withColumn("advantage", out).drop("group_n", "g_sum")


@register_estimator("opo")
def opo(df, group="uid", score="score", length="length", hot_rows=None):
    """Length-weighted group mean as baseline; 0 for a lone row."""
    joined = join_group_stats(
        df, [group], [F.sum(F.col(length) * F.col(score)).alias("g_ws"), F.sum(length).alias("g_len")], hot_rows
    )
    base = F.when(F.col("group_n") > 1, F.col("g_ws") / F.nullif(F.col("g_len"), F.lit(0))).otherwise(F.lit(0.0))
    return joined.withColumn("advantage", F.col(score) - base).drop("group_n", "g_ws", "g_len")


@register_estimator("gpg")
def gpg(df, group="uid", score="score", f_norm=1.0, hot_rows=None):
    """Rows / non-zero scores, times the centred score."""
    total = df.agg((F.count(F.lit(1)) / F.greatest(F.count(F.when(F.col(score) != 0, 1)), F.lit(1))).alias("alpha"))
    joined = _stats(df, group, score, hot_rows).join(F.broadcast(total))  # one row
    out = F.col("alpha") * (F.col(score) - _mean_or_zero()) / f_norm
    return joined.withColumn("advantage", out).drop("alpha", *_STAT_COLS)


@register_estimator("flow_grpo")
def flow_grpo(df, group="uid", score="score", norm_by_std=True, global_std=True, eps=EPS, hot_rows=None):
    """Centred on the group mean (a lone row gives 0), optionally scaled by the whole batch's std."""
    joined = _stats(df, group, score, hot_rows)
    centred = F.when(F.col("group_n") > 1, F.col(score) - F.col("g_mean")).otherwise(F.lit(0.0))
    if not norm_by_std:
        return joined.withColumn("advantage", centred).drop(*_STAT_COLS)
    if global_std:
        whole = df.agg(F.stddev_samp(score).alias("all_std"))  # one row
        joined = joined.join(F.broadcast(whole))
        return joined.withColumn("advantage", centred / (F.col("all_std") + eps)).drop("all_std", *_STAT_COLS)
    return joined.withColumn("advantage", centred / (_std_or_one() + eps)).drop(*_STAT_COLS)


def weighted_whiten(df: DataFrame, value: str, weight: str, out: str = "advantage") -> DataFrame:
    """Whiten ``value`` where a row stands for ``weight`` equal tokens (see ``tokens.whiten``)."""
    w, v = F.col(weight), F.col(value)
    sums = df.agg(F.sum(w).alias("w_n"), F.sum(w * v).alias("w_s"))
    mean = F.col("w_s") / (F.col("w_n") + 1e-8)
    first = df.join(F.broadcast(sums.select("w_n", mean.alias("w_mean"))))  # one row
    sq = first.agg(F.sum(w * F.pow(v - F.col("w_mean"), 2)).alias("w_ss"), F.max("w_n").alias("w_m"))
    var = F.col("w_ss") / (F.col("w_m") + 1e-8) * F.col("w_m") / (F.col("w_m") - 1)
    second = first.join(F.broadcast(sq.select(var.alias("w_var"))))
    whitened = (v - F.col("w_mean")) / F.sqrt(F.col("w_var") + 1e-8)
    return second.withColumn(out, whitened).drop("w_n", "w_mean", "w_var")


@register_estimator("reinforce_plus_plus_baseline")
def reinforce_pp_baseline(df, group="uid", score="score", length="length", hot_rows=None):
    """Centred score, then whitened over all valid tokens of the batch."""
    centred = _stats(df, group, score, hot_rows).withColumn("_c", F.col(score) - _mean_or_zero()).drop(*_STAT_COLS)
    return weighted_whiten(centred, "_c", length).drop("_c")


@register_estimator("gdpo")
def gdpo(df, components: Sequence[str], weights: Sequence[float] | None = None, group="uid", length="length", norm_by_std=True, eps=EPS, hot_rows=None):
    """Normalise every reward component in its group, add them up, whiten over tokens."""
    weights = list(weights or [1.0] * len(components))
    aggs = [a for c in components for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
    joined = join_group_stats(df, [group], aggs, hot_rows)
    total = None
    for c, w in zip(components, weights):
        many = F.col("group_n") > 1
        part = F.col(c) - F.when(many, F.col(f"m_{c}")).otherwise(F.lit(0.0))
        if norm_by_std:
            part = part / (F.when(many, F.col(f"s_{c}")).otherwise(F.lit(1.0)) + eps)
        total = part * w if total is None else total + part * w
    drop = ["group_n", *[f"{p}_{c}" for c in components for p in "ms"]]
    return weighted_whiten(joined.withColumn("_c", total).drop(*drop), "_c", length).drop("_c")


def last_trajectory(df: DataFrame, session: Sequence[str], index: str, value: Sequence[str]) -> DataFrame:
    """One row per session: the trajectory with the highest ``index`` (partial aggregation)."""
    return df.groupBy(*session).agg(
        F.count(F.lit(1)).alias("n_siblings"),
        F.max(index).alias(index),
        *[F.max_by(v, index).alias(v) for v in value],
    )


def multi_trajectory(df: DataFrame, estimator: str = "grpo", group="uid", session="session_id", index="traj_index", score="score", hot_rows=None, **kw) -> DataFrame:
    """Score only each session's last trajectory, then give the result to all its siblings."""
    finals = last_trajectory(df, [group, session], index, [score])
    scored = get_estimator(estimator)(finals, group=group, score=score, hot_rows=hot_rows, **kw)
    stats = scored.select(group, session, "n_siblings", "advantage")
    sizes = df.groupBy(group, session).agg(F.count(F.lit(1)).alias("n_siblings"))
    return join_skewed(df, stats, [group, session], "n_siblings", hot_rows, sizes=sizes).drop("n_siblings")


def group_mean_std(df: DataFrame, group="uid", score="score", eps=EPS) -> DataFrame:
    """Per group: mean, std (variance floored at eps) and count; a lone row gives 0 and 1."""
    n = F.count(F.lit(1))
    return df.groupBy(group).agg(
        F.when(n > 1, F.avg(score)).otherwise(F.lit(0.0)).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(F.var_samp(score), F.lit(eps)))).otherwise(F.lit(1.0)).alias("std"),
        n.alias("count"),
    )
