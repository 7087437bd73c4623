"""Entropy and log-probabilities of logits.

Everything comes from one triple per array, its mass: the largest logit m, ``sum(exp(x - m))`` and
``sum(exp(x - m) * (x - m))``. Masses of parts of a long array merge into that of the whole, so an array may lie in
several rows, and no exponential can overflow.

Null elements are absent; minus infinity has no probability. A null array, or one without elements, has a null mass and
null figures. An array of minus infinities only, or one with NaN or plus infinity, gives NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = float("-inf")


def _struct(top: Column, total: Column, weighted: Column) -> Column:
    return F.struct(top.alias("top"), total.alias("total"), weighted.alias("weighted"))


def mass(logits: Column, scale: float = 1.0) -> Column:
    """The triple of an array, of its logits times ``scale``."""
    # a one-element transform names the largest logit, so that it is not looked for again at each element
    x = F.transform(F.filter(logits, lambda v: v.isNotNull()), lambda v: v.cast("double") * scale)
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("weighted"))

    def step(top):
        def add(acc, v):
            part = F.exp(v - top)
            # the product of no probability and minus infinity is none
            return F.struct((acc["total"] + part).alias("total"), (acc["weighted"] + F.when(v == _NONE, part).otherwise(part * (v - top))).alias("weighted"))

        return add

    def fold(pair):
        sums = F.aggregate(pair["x"], zero, step(pair["top"]))
        return F.struct(pair["top"].alias("top"), sums.alias("sums"))

    folded = F.transform(F.array(F.struct(F.array_max(x).alias("top"), x.alias("x"))), fold)[0]
    return F.when(F.size(x) > 0, _struct(folded["top"], folded["sums"]["total"], folded["sums"]["weighted"]))


def merge(a: Column, b: Column) -> Column:
    """The mass of two parts together."""
    top = F.greatest(a["top"], b["top"])

    def moved(m):
        shift = m["top"] - top
        keep = F.exp(shift)
        # a part of minus infinities has nothing to move; both of them so stay what they are
        nothing = (m["top"] == _NONE) & (top != _NONE)
        return F.when(nothing, F.lit(0.0)).otherwise(m["total"] * keep), F.when(nothing, F.lit(0.0)).otherwise(keep * (m["weighted"] + m["total"] * shift))

    (n, v), (o, w) = moved(a), moved(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(_struct(top, n + o, v + w))


def merged(parts: DataFrame, keys: Sequence[str], column: str = "mass") -> DataFrame:
    """One mass per key from rows of parts. A key has one triple per part: array length / part length."""
    listed = parts.groupBy(*keys).agg(F.collect_list(column).alias("_parts"))
    first = F.col("_parts")[0]
    whole = F.aggregate(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), first, merge)
    return listed.select(*keys, whole.alias(column))


def chunked(df: DataFrame, keys: Sequence[str], logits: str, size: int) -> DataFrame:
    """(keys, chunk, logits): the array of each row cut into rows of ``size``."""
    n = F.size(logits)
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(logits, i * size + 1, F.lit(size))
    )
    return df.where(n > 0).select(*keys, F.posexplode(chunks).alias("chunk", logits))


def log_sum_exp(m: Column) -> Column:
    return m["top"] + F.log(m["total"])


def entropy(m: Column) -> Column:
    """Shannon entropy in nats."""
    return F.log(m["total"]) - m["weighted"] / m["total"]


def log_prob(logit: Column, m: Column) -> Column:
    """The log-probability of one logit of the array; null for a null logit."""
    return logit.cast("double") - log_sum_exp(m)


def sum_of_squares(m: Column, twice: Column) -> Column:
    """Sum of the squared probabilities; ``twice`` is the mass of the doubled logits."""
    return F.exp(log_sum_exp(twice) - 2 * log_sum_exp(m))
