"""Token-level operators over long rows (one row per trajectory token).

``explode_tokens`` turns ragged array columns into this form. Whole-batch figures are then plain
aggregates with map-side combine, and per-trajectory figures group on the trajectory, whose tokens
sit next to each other and collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.operators.groups import join_skewed
from gradelake.session import checkpoint


def explode_tokens(df: DataFrame, keep: Sequence[str], arrays: Sequence[str], outer: bool = False) -> DataFrame:
    """One row per token: ``keep`` columns, position ``t`` and the array elements under their names.

    ``outer`` keeps one row (t = 0, NULL elements) for a trajectory without tokens.
    """
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    rows = df.select(*keep, (F.posexplode_outer if outer else F.posexplode)(zipped).alias("t", "_z"))
    t = F.coalesce("t", F.lit(0)).alias("t") if outer else F.col("t")
    return rows.select(*keep, t, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def masked_sum(value: Column, mask: Column) -> Column:
    return F.sum(F.when(mask != 0, value * mask).otherwise(F.lit(0.0)))


def masked_mean(value: Column, mask: Column) -> Column:
    return masked_sum(value, mask) / (F.sum(mask) + F.lit(1e-8))


def masked_stats(df: DataFrame, value: str, mask: str = "mask") -> DataFrame:
    """One row: count, sum, mean and unbiased variance of the values under a 0/1 mask, in one pass."""
    v, m = F.col(value), F.col(mask)
    live = F.when(m != 0, v)
    one = df.agg(
        F.sum(m).alias("n"), masked_sum(v, m).alias("total"), F.avg(live).alias("_avg"), F.var_pop(live).alias("_vp")
    )
    n, mean = F.col("n"), F.col("total") / (F.col("n") + 1e-8)
    # spread around the slightly shifted mean, then the shifted denominator and Bessel's correction
    around = F.col("_vp") + F.pow(F.col("_avg") - mean, 2)
    bad = F.raise_error(F.lit("variance needs at least two masked-in values")).cast("double")
    var = F.when(n < 2, bad).otherwise(around * n / (n + 1e-8) * n / (n - 1))
    return one.select("n", "total", mean.alias("mean"), var.alias("var"))


def whiten(df: DataFrame, value: str, mask: str = "mask", shift_mean: bool = True, out: str = "whitened") -> DataFrame:
    """(value - mean) / sqrt(var + 1e-8) with batch-wide masked statistics."""
    s = masked_stats(df, value, mask).select(F.col("mean").alias("_mu"), F.col("var").alias("_var"))
    w = (F.col(value) - F.col("_mu")) / F.sqrt(F.col("_var") + 1e-8)
    if not shift_mean:
        w = w + F.col("_mu")
    return df.join(F.broadcast(s)).withColumn(out, w).drop("_mu", "_var")


def step_sums(trajectories: DataFrame, group: str, value: str, weight: str, length: str) -> DataFrame:
    """Element-wise sums of ragged arrays: one row per group, in one pass and combined before the shuffle.

    Gives ``_n`` (rows), ``_max`` and ``_second`` (the two largest lengths), and the arrays ``_value`` and ``_weight``
    that hold per position the sums of value * weight and of weight. Lengths ride along as positions below zero. A group
    has as many rows after the first aggregation as its longest array, and different lengths, have places.
    """
    zipped = F.arrays_zip(F.col(value).alias("v"), F.col(weight).alias("w"))
    at = F.transform(zipped, lambda z, i: F.struct(i.alias("k"), (z["v"] * z["w"]).alias("v"), z["w"].alias("w")))
    size = F.struct((-1 - F.col(length)).cast("int").alias("k"), F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    cells = trajectories.select(group, F.explode(F.concat(at, F.array(size))).alias("_c")).select(group, "_c.*")
    sums = cells.groupBy(group, "k").agg(F.sum("v").alias("v"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("c"))
    listed = sums.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("k", "v", "w", "c"))).alias("_all"))
    steps, lengths = F.filter("_all", lambda s: s["k"] >= 0), F.filter("_all", lambda s: s["k"] < 0)
    listed = listed.select(group, steps.alias("_s"), lengths.alias("_l"))
    first = F.col("_l")[0]
    second = F.when(first["c"] > 1, first["k"]).otherwise(F.get("_l", F.lit(1))["k"])
    return listed.select(
        group,
        F.aggregate("_l", F.lit(0).cast("bigint"), lambda n, s: n + s["c"]).alias("_n"),
        (-1 - first["k"]).alias("_max"),
        (-1 - second).alias("_second"),
        F.transform("_s", lambda s: s["v"]).alias("_value"),
        F.transform("_s", lambda s: s["w"]).alias("_weight"),
    )


def baseline_arrays(
    trajectories: DataFrame,
    returns: str = "returns",
    energy: str = "energy",
    mask: str = "mask",
    group: str = "uid",
    traj: str = "traj",
    compact: bool = False,
    zero_tail: bool = True,
    eps: float = 1e-8,
    hot_rows: int | None = None,
) -> DataFrame:
    """Per-group, per-step baseline sum(G*W) / (sum(W) + eps) and the advantage G - B, a row per trajectory.

    ``trajectories`` has array columns: returns G, running energy W and the mask. With ``compact`` the
    step is the rank among valid tokens (multi-turn masks), else the token position. A lone trajectory
    has no baseline; the part of a strictly longest one beyond the runner-up's length has none either.
    Result: group, traj and the arrays ``t``, returns, energy, mask, ``baseline`` and ``advantage``.
    Tokens are summed per group and step before they move, and are not joined; the trajectories are read twice.
    """
    t = trajectories.withColumn("_len", F.aggregate(mask, F.lit(0), lambda a, m: a + m))
    if compact:
        t = t.where("_len > 0").withColumns(
            {
                "t": F.filter(F.transform(mask, lambda m, i: F.when(m != 0, i)), lambda p: p.isNotNull()),
                returns: _keep(returns, mask),
                energy: _keep(energy, mask),
                mask: F.filter(mask, lambda m: m != 0),
            }
        )
    else:
        t = t.withColumn("t", F.transform(mask, lambda m, i: i))
    weighed = t.withColumn("_w", F.zip_with(energy, mask, lambda w, m: w * m))
    # one row per group, kept: it tells the hot groups as well as the baselines
    stats = checkpoint(step_sums(weighed, group, returns, "_w", "_len"))
    base = F.zip_with("_value", "_weight", lambda v, w: v / (w + F.lit(eps)))
    stats = stats.select(group, "_n", "_max", "_second", F.when(F.col("_n") > 1, base).otherwise(F.transform(base, lambda b: F.lit(0.0))).alias("_base"))
    rows = t.select(group, traj, "t", returns, energy, mask, "_len")
    out = join_skewed(rows, stats, [group], "_n", hot_rows, spread_on=[traj])
    kept = F.slice("_base", F.lit(1), F.size("t"))
    if zero_tail:
        tail = (F.col("_len") == F.col("_max")) & (F.col("_max") > F.col("_second"))
        kept = F.transform(kept, lambda b, i: F.when(tail & (i >= F.col("_second")), F.lit(0.0)).otherwise(b))
    out = out.withColumn("baseline", kept)
    gain = F.zip_with(F.zip_with(returns, "baseline", lambda g, b: g - b), mask, lambda a, m: a * m)
    return out.withColumn("advantage", gain).select(group, traj, "t", returns, energy, mask, "baseline", "advantage")


def token_baseline(trajectories: DataFrame, returns="returns", energy="energy", mask="mask", group="uid", traj="traj", **options) -> DataFrame:
    """``baseline_arrays`` as one row per token."""
    rows = baseline_arrays(trajectories, returns, energy, mask, group, traj, **options)
    arrays = ["t", returns, energy, mask, "baseline", "advantage"]
    return rows.select(group, traj, F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))


def _keep(values: str, mask: str) -> Column:
    pairs = F.filter(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")), lambda p: p["m"] != 0)
    return F.transform(pairs, lambda p: p["v"])
