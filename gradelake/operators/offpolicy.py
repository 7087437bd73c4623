"""Off-policy correction: importance weights, rejection masks and mismatch metrics.

Input is one row per trajectory with array columns (old and rollout log-probabilities, mask). Sequence
figures are array folds on that row, so nothing is shuffled; tokens are then exploded and every metric
of a call comes out of one aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.arrays import masked_average, masked_total
from gradelake.operators.tokens import explode_tokens, masked_mean

SAFETY = 20.0
# The supported rejection criteria.
REJECTION_OPTIONS = [
    "token_k1", "token_k2", "token_k3",
    "seq_sum_k1", "seq_sum_k2", "seq_sum_k3",
    "seq_mean_k1", "seq_mean_k2", "seq_mean_k3",
    "seq_max_k2", "seq_max_k3",
]


def _number(text: str, what: str) -> float:
    try:
        value = float(text)
    except ValueError as e:
        raise ValueError(f"{what}: {text!r} is not a number") from e
    if value <= 0:
        raise ValueError(f"{what}: {text!r} must be positive")
    return value


def parse_weight_threshold(spec: str | float) -> tuple[float, float | None]:
    """(upper, lower): a single number truncates, ``"lower_upper"`` zeroes outside the band."""
    if isinstance(spec, bool) or not isinstance(spec, (int, float, str)):
        raise TypeError("threshold must be a number or a string")
    parts = str(spec).strip().split("_", 1)
    if parts == [""]:
        raise ValueError("threshold must not be empty")
    numbers = [_number(p, "threshold") for p in parts]
    if len(numbers) == 2 and numbers[0] > numbers[1]:
        raise ValueError("lower bound must not exceed the upper bound")
    return numbers[-1], numbers[0] if len(numbers) == 2 else None


def parse_rejection(options: str, spec: str | float | None) -> dict[str, tuple[float, float]]:
    """Option -> (lower, upper). k1 bounds are given as ratios and kept in log space."""
    names = list(dict.fromkeys(o.strip() for o in (options or "").split(",") if o.strip()))
    if not names:
        raise ValueError("at least one rejection option is needed")
    for n in names:
        if n not in REJECTION_OPTIONS:
            raise ValueError(f"unknown rejection option {n!r}")
    if spec is None:
        raise ValueError("a rejection threshold is needed")
    specs = [p.strip() for p in str(spec).split(",") if p.strip()]
    if len(specs) not in (1, len(names)):
        raise ValueError("give one threshold, or one per option")
    specs = specs * len(names) if len(specs) == 1 else specs
    out = {}
    for name, s in zip(names, specs):
        bounds = [_number(p, name) for p in s.split("_", 1)]
        if name.endswith("k1"):
            low, high = bounds if len(bounds) == 2 else (1.0 / bounds[0], bounds[0])
            out[name] = (math.log(low), math.log(high))
        elif len(bounds) == 2:
            raise ValueError(f"{name} takes a single upper bound")
        else:
            out[name] = (0.0, bounds[0])
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def with_log_ratio(df: DataFrame, old: str = "old_lp", rollout: str = "roll_lp", mask: str = "mask") -> DataFrame:
    """Add ``log_ratio`` (array), ``seq_lr`` (its masked sum) and ``seq_n`` (valid tokens)."""
    lr = F.zip_with(old, rollout, lambda a, b: a - b)
    out = df.withColumn("log_ratio", lr)
    return out.withColumns(
        {
            "seq_lr": masked_total(F.col("log_ratio"), F.col(mask)),
            "seq_n": F.aggregate(mask, F.lit(0.0), lambda a, m: a + m),
        }
    )


def importance_weights(
    df: DataFrame,
    level: str = "token",
    threshold: str | float = 2.0,
    batch_normalize: bool = False,
    mask: str = "mask",
) -> DataFrame:
    """Add arrays ``raw_weight`` and ``weight`` (truncated or banded, zero outside the mask)."""
    if level not in ("token", "sequence"):
        raise ValueError(f"unknown level {level!r}")
    upper, lower = parse_weight_threshold(threshold)
    out = with_log_ratio(df, mask=mask)
    if level == "token":
        raw = F.zip_with("log_ratio", mask, lambda x, m: F.exp(clamp(x, -SAFETY, SAFETY)) * m)
    else:
        per_seq = F.array_repeat(F.exp(clamp(F.col("seq_lr"), -SAFETY, SAFETY)), F.size(mask))
        raw = F.zip_with(per_seq, mask, lambda w, m: w * m)
    out = out.withColumn("raw_weight", raw)
    if lower is None:
        kept = F.transform("raw_weight", lambda w: F.least(w, F.lit(upper)))
    else:
        kept = F.transform("raw_weight", lambda w: F.when(w.between(lower, upper), w).otherwise(F.lit(0.0)))
    out = out.withColumn("weight", kept)
    if not batch_normalize:
        return out
    factor = batch_factor(out, level, mask)
    scaled = out.join(F.broadcast(factor))  # one row
    return scaled.withColumn("weight", F.transform("weight", lambda w: w / F.col("batch_factor"))).drop("batch_factor")


def batch_factor(df: DataFrame, level: str, mask: str = "mask") -> DataFrame:
    """One row: the mean weight that normalisation divides by (1 when it is not positive)."""
    if level == "token":
        mean = F.sum(masked_total(F.col("weight"), F.col(mask))) / (F.sum("seq_n") + F.lit(1e-8))
    else:
        valid = F.col("seq_n") > 0
        mean = F.sum(F.when(valid, masked_average(F.col("weight"), F.col(mask))).otherwise(F.lit(0.0))) / F.greatest(
            F.count(F.when(valid, 1)).cast("double"), F.lit(1e-8)
        )
    m = df.agg(mean.alias("m"))
    return m.select(F.when(F.col("m") > 1e-8, F.col("m")).otherwise(F.lit(1.0)).alias("batch_factor"))


def _as_rows(wide: DataFrame) -> DataFrame:
    return wide.unpivot([], wide.columns, "metric", "value")


def _first(value: Column) -> Column:
    """A per-trajectory value, counted once (on its first token row)."""
    return F.when(F.col("t") == 0, value)


def weight_metrics(df: DataFrame, level: str = "token", threshold: str | float = 2.0, mask: str = "mask") -> DataFrame:
    """(metric, value) rows about the weights of ``importance_weights`` before normalisation."""
    upper, given_low = parse_weight_threshold(threshold)
    lower = 1.0 / upper if given_low is None else given_low
    base = df.withColumn("seq_w", masked_average(F.col("weight"), F.col(mask)))
    tok = explode_tokens(base, ["seq_w", "seq_lr"], ["raw_weight", "weight", mask], outer=True)
    m, w, raw = F.coalesce(F.col(mask), F.lit(0)), F.col("weight"), F.col("raw_weight")
    clipped = clamp(w, 0.0, upper)
    seq = F.col("seq_w")
    aggs = {"rollout_is_mean": masked_mean(w, m)}
    if level == "sequence":
        lr = F.col("seq_lr")
        aggs |= {
            "rollout_is_max": F.exp(F.least(F.max(_first(lr)), F.lit(SAFETY))),
            "rollout_is_min": F.exp(F.min(_first(lr))),
            "rollout_is_ratio_fraction_high": F.avg(_first((lr > math.log(upper)).cast("double"))),
            "rollout_is_ratio_fraction_low": F.avg(_first((lr < math.log(lower)).cast("double"))),
        }
    else:
        aggs |= {
            "rollout_is_max": F.max(F.when(m != 0, w)),
            "rollout_is_min": F.min(F.when(m != 0, w)),
            "rollout_is_ratio_fraction_high": masked_mean((raw > upper).cast("double"), m),
            "rollout_is_ratio_fraction_low": masked_mean((raw < lower).cast("double"), m),
        }
    mean_c, mean_sq = masked_mean(clipped, m), masked_mean(clipped * clipped, m)
    scaled_sq = mean_sq / F.pow(mean_c + F.lit(1e-8), 2)
    aggs |= {
        "rollout_is_std": F.when(F.sum(m) > 1, F.sqrt(F.greatest(mean_sq - mean_c * mean_c, F.lit(0.0)))).otherwise(F.lit(0.0)),
        "rollout_is_eff_sample_size": F.lit(1.0) / scaled_sq,
        "rollout_is_seq_mean": F.avg(_first(seq)),
        "rollout_is_seq_std": F.coalesce(F.stddev_samp(_first(seq)), F.lit(0.0)),
        "rollout_is_seq_max": F.max(_first(seq)),
        "rollout_is_seq_min": F.min(_first(seq)),
        "rollout_is_seq_max_deviation": F.max(_first(F.abs(seq - 1.0))),
        "rollout_is_seq_fraction_high": F.avg(_first((seq > upper).cast("double"))),
        "rollout_is_seq_fraction_low": F.avg(_first((seq < lower).cast("double"))),
    }
    if given_low is not None:
        aggs["rollout_is_oob_ratio"] = masked_mean(((raw < lower) | (raw > upper)).cast("double"), m)
    return _as_rows(tok.agg(*[v.alias(k) for k, v in aggs.items()]))


def _divergence(kind: str):
    def one(x):
        c = clamp(x, -SAFETY, SAFETY)
        return {"k1": -c, "k2": 0.5 * c * c, "k3": F.exp(c) - 1.0 - c}[kind]

    return one


def rejection_mask(df: DataFrame, options: str, spec: str | float, mask: str = "mask") -> DataFrame:
    """Add ``new_mask`` (all criteria must pass) and, per option, its statistic and verdict columns."""
    bounds = parse_rejection(options, spec)
    out = with_log_ratio(df, mask=mask).withColumn("new_mask", F.col(mask))
    for name, (low, high) in bounds.items():
        scope, kind = name.rsplit("_", 1)
        stat = F.transform("log_ratio", _divergence(kind))
        inside = (lambda v: v.between(low, high)) if kind == "k1" else (lambda v: v <= high)  # noqa: B023
        if scope == "token":
            out = out.withColumn(f"s_{name}", stat)
            out = out.withColumn(f"k_{name}", F.transform(f"s_{name}", lambda v: inside(v).cast("int")))  # noqa: B023
            out = out.withColumn(f"q_{name}", masked_average(F.col(f"s_{name}"), F.col(mask)))
            lost = F.exists(F.zip_with(f"k_{name}", mask, lambda k, m: (k == 0) & (m != 0)), lambda x: x)
            out = out.withColumn(f"a_{name}", ~lost)
            out = out.withColumn("new_mask", F.zip_with("new_mask", f"k_{name}", lambda m, k: m * k))
        else:
            if scope == "seq_sum":
                value = masked_total(stat, F.col(mask))
            elif scope == "seq_mean":
                value = masked_average(stat, F.col(mask))
            else:
                live = F.zip_with(stat, F.col(mask), lambda v, m: F.when(m != 0, v))
                value = F.coalesce(F.array_max(live), F.lit(0.0))
            out = out.withColumn(f"q_{name}", value).withColumn(f"a_{name}", inside(F.col(f"q_{name}")))
            # decided once per row: a lambda would re-evaluate the statistic for every token
            nothing = F.array_repeat(F.lit(0), F.size("new_mask"))
            out = out.withColumn("new_mask", F.when(F.col(f"a_{name}"), F.col("new_mask")).otherwise(nothing))
    return out


def rejection_metrics(df: DataFrame, options: str, spec: str | float, mask: str = "mask") -> DataFrame:
    """(metric, value) rows for a frame produced by ``rejection_mask`` with the same arguments."""
    bounds = parse_rejection(options, spec)
    token_level = [n for n in bounds if n.startswith("token")]
    arrays = [mask, "new_mask", *[f"{p}_{n}" for n in token_level for p in "sk"]]
    lost = F.exists(F.zip_with("new_mask", mask, lambda k, m: (k == 0) & (m != 0)), lambda x: x)
    keep = ["seq_n", "any_lost", *[f"{p}_{n}" for n in bounds for p in "qa"]]
    tok = explode_tokens(df.withColumn("any_lost", lost), keep, arrays, outer=True)
    m = F.coalesce(F.col(mask), F.lit(0))
    valid = lambda v: _first(F.when(F.col("seq_n") > 0, v))
    share = lambda cond: cond.cast("double")
    aggs = {}
    for name, (low, high) in bounds.items():
        p = f"rollout_rs_{name}"
        is_token, has_low = name in token_level, name.endswith("k1")
        q, kept_all = F.col(f"q_{name}"), F.col(f"a_{name}")
        s = F.col(f"s_{name}") if is_token else q
        kept = F.col(f"k_{name}").cast("double") if is_token else share(kept_all)
        c = clamp(s, low, high)
        var = masked_mean(c * c, m) - F.pow(masked_mean(c, m), 2)
        live = F.when(m != 0, s)
        aggs |= {
            f"{p}_mean": masked_mean(s, m),
            f"{p}_max": F.max(live) if is_token else F.max(valid(q)),
            f"{p}_min": F.min(live) if is_token else F.min(valid(q)),
            f"{p}_fraction_high": masked_mean(share(s > high), m) if is_token else F.avg(valid(share(q > high))),
            f"{p}_fraction_low": F.lit(0.0)
            if not has_low
            else (masked_mean(share(s < low), m) if is_token else F.avg(valid(share(q < low)))),
            f"{p}_std": F.when(F.sum(m) > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0)),
            f"{p}_seq_mean": F.coalesce(F.avg(valid(q)), F.lit(0.0)),
            f"{p}_seq_std": F.coalesce(F.stddev_samp(valid(q)), F.lit(0.0)),
            f"{p}_seq_max": F.coalesce(F.max(valid(q)), F.lit(0.0)),
            f"{p}_seq_min": F.coalesce(F.min(valid(q)), F.lit(0.0)),
            f"{p}_seq_max_deviation": F.coalesce(F.max(valid(F.abs(q))), F.lit(0.0)),
            f"{p}_seq_fraction_high": F.coalesce(F.avg(valid(share(q > high))), F.lit(0.0)),
            f"{p}_masked_fraction": masked_mean(1.0 - kept, m),
            f"{p}_seq_masked_fraction": F.coalesce(F.avg(valid(share(~kept_all))), F.lit(0.0)),
        }
        if has_low:
            aggs[f"{p}_seq_fraction_low"] = F.coalesce(F.avg(valid(share(q < low))), F.lit(0.0))
    final = F.when(F.col("new_mask") != 0, F.lit(0.0)).otherwise(F.lit(1.0))
    aggs["rollout_rs_masked_fraction"] = masked_mean(final, m)
    aggs["rollout_rs_seq_masked_fraction"] = F.avg(_first(share(F.col("any_lost"))))
    return _as_rows(tok.agg(*[v.alias(k) for k, v in aggs.items()]))


def mismatch_metrics(df: DataFrame, old: str = "old_lp", rollout: str = "roll_lp", mask: str = "mask") -> DataFrame:
    """Perplexities, KL estimates, perplexity ratio and chi-squared, as (metric, value) rows."""
    base = with_log_ratio(df, old, rollout, mask).withColumns(
        {"lp_old": masked_average(F.col(old), F.col(mask)), "lp_roll": masked_average(F.col(rollout), F.col(mask))}
    )
    tok = explode_tokens(base, ["lp_old", "lp_roll", "seq_lr"], ["log_ratio", mask], outer=True)
    m, lr = F.coalesce(F.col(mask), F.lit(0)), F.col("log_ratio")
    a, b = F.col("lp_old"), F.col("lp_roll")
    rho = F.exp(clamp(lr, -SAFETY, SAFETY))
    aggs = {
        "training_ppl": F.avg(_first(F.exp(-a))),
        "training_log_ppl": F.avg(_first(-a)),
        "kl": masked_mean(-lr, m),
        "k3_kl": masked_mean(F.exp(lr) - lr - 1, m),
        "rollout_ppl": F.avg(_first(F.exp(-b))),
        "rollout_log_ppl": F.avg(_first(-b)),
        "log_ppl_diff": F.avg(_first(b - a)),
        "log_ppl_abs_diff": F.avg(_first(F.abs(b - a))),
        "log_ppl_diff_max": F.max(_first(b - a)),
        "log_ppl_diff_min": F.min(_first(b - a)),
        "ppl_ratio": F.avg(_first(F.exp(b - a))),
        "chi2_token": masked_mean(rho * rho, m) - 1.0,
        "chi2_seq": F.avg(_first(F.exp(2.0 * clamp(F.col("seq_lr"), -SAFETY, SAFETY)))) - 1.0,
    }
    return _as_rows(tok.agg(*[v.alias(k) for k, v in aggs.items()]))


def correct_rollouts(
    df: DataFrame,
    level: str | None = None,
    threshold: str | float = 2.0,
    batch_normalize: bool = False,
    options: str | None = None,
    spec: str | float | None = None,
    mask: str = "mask",
) -> tuple[DataFrame, DataFrame]:
    """(trajectories with ``weight``/``new_mask``, metric rows named ``rollout_corr/...``).

    Pass ``level=None`` or ``options=None`` to leave a part out.
    """
    out, parts = df, [mismatch_metrics(df, mask=mask)]
    if level is not None:
        plain = importance_weights(df, level, threshold, False, mask)
        parts.append(weight_metrics(plain, level, threshold, mask))
        out = importance_weights(out, level, threshold, batch_normalize, mask)
        if batch_normalize:
            parts.append(
                batch_factor(plain, level, mask).select(
                    F.lit("rollout_is_batch_norm_factor").alias("metric"), F.col("batch_factor").alias("value")
                )
            )
    if options is not None:
        out = rejection_mask(out, options, spec, mask)
        parts.append(rejection_metrics(out, options, spec, mask))
        out = out.drop(*[c for c in out.columns if c[:2] in ("s_", "k_", "q_", "a_")])
    else:
        out = out.withColumn("new_mask", F.col(mask))
    metrics = parts[0]
    for p in parts[1:]:
        metrics = metrics.unionByName(p)
    return out, metrics.withColumn("metric", F.concat(F.lit("rollout_corr/"), "metric"))
