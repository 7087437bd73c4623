"""Per-trajectory array functions. Arrays are ragged, so nothing is padded.

Element-wise work stays in the JVM; running sums and discounted recursions go through Arrow in whole
batches with numpy, which keeps long arrays linear (an array fold that appends would be quadratic).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLES = T.ArrayType(T.DoubleType())
_BLOCK = 64


def _discounted_suffix(x: np.ndarray, c: float) -> np.ndarray:
    """out[i] = sum over j >= i of c**(j-i) * x[j], in blocks so powers never underflow."""
    n = len(x)
    if n == 0:
        return x
    gap = np.arange(_BLOCK)[:, None] - np.arange(_BLOCK)[None, :]
    weights = np.where(gap >= 0, float(c) ** np.maximum(gap, 0), 0.0)
    out = np.concatenate([x, np.zeros(-n % _BLOCK)]).reshape(-1, _BLOCK) @ weights
    reach = float(c) ** (_BLOCK - np.arange(_BLOCK))
    for b in range(len(out) - 2, -1, -1):
        out[b] += reach * out[b + 1, 0]
    return out.reshape(-1)[:n]


def _f(a) -> np.ndarray:
    return np.asarray(a, dtype=np.float64)


def _lists(fn, *cols: pa.Array) -> pa.Array:
    """``fn`` over the arrays of each row, written into one flat buffer: no Python object is kept per row."""
    gone = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in cols])
    flat = [c.values.to_numpy(zero_copy_only=False) for c in cols]
    ends = [c.offsets.to_numpy() for c in cols]
    places = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(ends[0])))]).astype(np.int32)
    out = np.empty(places[-1])
    for i in np.flatnonzero(~gone):
        out[places[i] : places[i + 1]] = fn(*[_f(v[e[i] : e[i + 1]]) for v, e in zip(flat, ends)])
    return pa.ListArray.from_arrays(pa.array(places), pa.array(out), mask=pa.array(gone))


@F.arrow_udf(_DOUBLES)
def _reward_to_go(rewards: pa.Array, mask: pa.Array) -> pa.Array:
    return _lists(lambda r, m: np.cumsum((r * m)[::-1])[::-1], rewards, mask)


@F.arrow_udf(_DOUBLES)
def _running_sum(values: pa.Array) -> pa.Array:
    return _lists(np.cumsum, values)


def reward_to_go(rewards: Column, mask: Column) -> Column:
    """Suffix sum of reward x mask."""
    return _reward_to_go(rewards, mask)


def running_sum(values: Column) -> Column:
    return _running_sum(values)


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Struct(advantages, returns): the reverse recursion, masked tokens carrying the state through.

    Advantages are not whitened here; returns are advantage + value before whitening.
    """
    shape = T.StructType([T.StructField("advantages", _DOUBLES), T.StructField("returns", _DOUBLES)])

    def one(r, v, m):
        live = np.flatnonzero(m)
        adv = np.zeros(len(r) + 1)
        if len(live):
            following = np.append(v[live][1:], 0.0)
            adv_live = _discounted_suffix(r[live] + gamma * following - v[live], gamma * lam)
            # a masked-out token shows the state of the next live one
            nxt = np.searchsorted(live, np.arange(len(r)))
            adv[:-1] = np.append(adv_live, 0.0)[nxt]
        return adv[:-1], adv[:-1] + v

    @F.pandas_udf(shape)
    def run(r: pd.Series, v: pd.Series, m: pd.Series) -> pd.DataFrame:
        pairs = [one(_f(a), _f(b), _f(c)) for a, b, c in zip(r, v, m)]
        return pd.DataFrame({"advantages": [p[0] for p in pairs], "returns": [p[1] for p in pairs]})

    return run(rewards, values, mask)


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted return that restarts after every masked-out token."""

    def one(r, m):
        # what the next masked-out token would pass on is taken off again
        whole = np.append(_discounted_suffix(r, gamma), 0.0)
        cuts = np.append(np.flatnonzero(m == 0), len(r))
        here = np.arange(len(r))
        following = cuts[np.searchsorted(cuts, here, "right")]
        return whole[:-1] - float(gamma) ** (following - here) * whole[following]

    @F.arrow_udf(_DOUBLES)
    def run(r: pa.Array, m: pa.Array) -> pa.Array:
        return _lists(one, r, m)

    return run(rewards, mask)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def masked_total(values: Column, mask: Column) -> Column:
    """Sum of values where the mask is set (NaN outside the mask does not leak in)."""
    return total(F.zip_with(values, mask, lambda v, m: F.when(m != 0, v * m).otherwise(F.lit(0.0))))


def masked_average(values: Column, mask: Column) -> Column:
    return masked_total(values, mask) / (total(F.transform(mask, lambda m: m.cast("double"))) + 1e-8)


def spread_over_mask(scalar: Column, mask: Column) -> Column:
    return F.transform(mask, lambda m: scalar * m)


def _ones_then_zeros(ones: Column, size: Column) -> Column:
    # built from repeats: a lambda would re-evaluate the split point for every element
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), size - ones))


def response_mask(ids: Column, eos: list[int]) -> Column:
    """1 up to and including the first end token, 0 after it."""
    hits = F.filter(F.array(*[F.array_position(ids, F.lit(e)) for e in eos]), lambda p: p > 0)
    first = F.coalesce(F.array_min(hits), F.size(ids).cast("long"))
    return _ones_then_zeros(first.cast("int"), F.size(ids))


def reward_at_last(reward: Column, mask: Column) -> Column:
    """Zeros with the reward at the last valid position; with no valid token it lands on the last slot."""
    valid = F.aggregate(mask, F.lit(0), lambda acc, m: acc + m)
    at = F.when(valid > 0, valid - 1).otherwise(F.size(mask) - 1)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    placed = F.concat(zeros(at), F.array(reward), zeros(F.size(mask) - at - 1))
    return F.when(F.size(mask) > 0, placed).otherwise(F.array().cast("array<double>"))


def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float) -> Column:
    """min(-(length - (max - buffer)) / buffer * factor, 0)."""
    return F.least(-(length - (max_length - buffer)) / F.lit(buffer) * factor, F.lit(0.0))


def two_phase(first: Column, injected: Column, second: Column, cap: int) -> tuple[Column, Column]:
    """(ids, mask) of model tokens, injected tokens, model tokens, cut to ``cap``."""
    ones = lambda a: F.array_repeat(F.lit(1), F.size(a))
    ids = F.slice(F.concat(first, injected, second), 1, cap)
    mask = F.slice(F.concat(ones(first), F.array_repeat(F.lit(0), F.size(injected)), ones(second)), 1, cap)
    return ids, mask


def injects(ids: Column, eos: int, wait_len: int, cap: int) -> Column:
    return (F.try_element_at(ids, F.lit(-1)) == eos) & (F.size(ids) + wait_len < cap)


def pad_to(a: Column, length: int, fill, truncation: str = "error", left: bool = False) -> Column:
    """Exactly ``length`` elements: pad with ``fill`` or cut left / right / refuse."""
    short = F.array_repeat(F.lit(fill), F.greatest(length - F.size(a), F.lit(0)))
    padded = F.concat(short, a) if left else F.concat(a, short)
    if truncation == "left":
        cut = F.slice(a, -length, length)
    elif truncation == "right":
        cut = F.slice(a, 1, length)
    elif truncation == "error":
        cut = F.when(F.raise_error(F.lit(f"sequence longer than {length}")).isNull(), a)
    else:
        raise ValueError(f"unknown truncation {truncation!r}")
    return F.when(F.size(a) <= length, padded).otherwise(cut)


def remove_pad(ids: Column, mask: Column) -> Column:
    pairs = F.filter(F.zip_with(ids, mask, lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda p: p["m"] != 0)
    return F.transform(pairs, lambda p: p["x"])


def position_ids(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def sft_message_mask(role: Column, ids: Column, prompt_len: Column) -> Column:
    """Loss mask of one message: assistant tokens count, their generation prompt does not."""
    counted = F.when(role == "assistant", F.greatest(F.size(ids) - prompt_len, F.lit(0))).otherwise(F.lit(0))
    return F.concat(F.array_repeat(F.lit(0), F.size(ids) - counted), F.array_repeat(F.lit(1), counted))


def preference_pair(prompt: Column, chosen: Column, rejected: Column, eos: str) -> Column:
    """Array of the chosen then the rejected conversation, each closed by the end marker."""
    one = lambda text: F.struct(prompt.alias("prompt"), F.concat(text, F.lit(eos)).alias("response"))
    return F.array(one(chosen), one(rejected))
