"""Ordered-log replays of queue, gate and buffer behaviour, as distributed batch jobs.

The log has a dense 0-based ``seq``. Sequential state is reduced to prefix sums over fixed-size blocks,
so a log of any length is replayed without one task seeing all of it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import whole_div
from gradelake.operators.groups import BLOCK, cumulative, join_skewed


def _apply(size: int, puts, capacity: int) -> list[int]:
    """Queue size before every operation, starting from ``size``."""
    out = []
    for put in puts:
        out.append(size)
        size = min(capacity, size + 1) if put else max(0, size - 1)
    return out


def replay_queue(ops: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """Bounded FIFO that drops its oldest sample when full.

    ``ops`` has (seq, is_put). Adds ``size_before``, ``removed`` (a put on a full queue or a get on a
    non-empty one) and, for puts, ``fate``: consumed, dropped or queued. Within a block the size is a
    clamped walk; a whole block maps any starting size x to min(max(x + a, lo), hi), and those maps are
    chained once, one row per block. Samples leave in arrival order, so removal r takes put r.
    """
    b = ops.withColumn("_b", whole_div("seq", block))

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        a, lo, hi = 0, 0, capacity
        for put in pdf.sort_values("seq")["is_put"]:
            d = 1 if put else -1
            a, lo, hi = a + d, min(max(lo + d, 0), capacity), min(max(hi + d, 0), capacity)
        return pd.DataFrame({"_b": [pdf["_b"].iloc[0]], "a": [a], "lo": [lo], "hi": [hi]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, size, starts = pdf.sort_values("_b"), 0, []
        for a, lo, hi in pdf[["a", "lo", "hi"]].itertuples(index=False):
            starts.append(size)
            size = min(max(size + a, lo), hi)
        return pd.DataFrame({"_b": pdf["_b"].to_numpy(), "start": starts})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf[["seq", "is_put"]].assign(size_before=_apply(int(pdf["start"].iloc[0]), pdf["is_put"], capacity))

    maps = b.select("_b", "seq", "is_put").groupBy("_b").applyInPandas(summarize, "_b long, a long, lo long, hi long")
    # rows / block maps in all
    starts = maps.groupBy(F.lit(1).alias("_one")).applyInPandas(chain, "_b long, start long")
    sized = b.join(starts, "_b").groupBy("_b").applyInPandas(walk, "seq long, is_put boolean, size_before long")
    removed = (F.col("is_put") & (F.col("size_before") >= capacity)) | (~F.col("is_put") & (F.col("size_before") > 0))
    marks = sized.withColumns({"removed": removed, "_p": F.col("is_put").cast("long"), "_r": removed.cast("long")})
    ranked = cumulative(cumulative(marks, "seq", "_p", "put_no", block), "seq", "_r", "removal_no", block)
    taken = ranked.where("removed").select(
        F.col("removal_no").alias("put_no"), F.when(F.col("is_put"), "dropped").otherwise("consumed").alias("fate")
    )
    puts = ranked.where("is_put").select("seq", "put_no").join(taken, "put_no", "left")
    fates = puts.select("seq", F.coalesce("fate", F.lit("queued")).alias("fate"))
    return ranked.select("seq", "is_put", "size_before", "removed").join(fates, "seq", "left")


def queue_statistics(replayed: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    return replayed.agg(
        count(F.col("is_put")).alias("total_produced"),
        count(F.col("fate") == "consumed").alias("total_consumed"),
        count(F.col("fate") == "dropped").alias("dropped_samples"),
        count(F.col("fate") == "queued").alias("queue_size"),
    )


def staleness_gate(log: DataFrame, required: int, threshold: float, sync_steps: int, block: int = BLOCK) -> DataFrame:
    """Stale samples at every row and whether generation pauses.

    ``log`` has (seq, is_update, carried): a weight update resets the count to what is in flight or queued
    (``carried``); every other row adds one. Paused when stale >= required * (threshold + 1) * sync_steps.
    """
    limit = required * (threshold + 1) * sync_steps
    marks = log.withColumns({"_u": F.col("is_update").cast("long"), "_s": (~F.col("is_update")).cast("long")})
    ranked = cumulative(cumulative(marks, "seq", "_u", "version", block), "seq", "_s", "_made", block)
    starts = ranked.groupBy("version").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("is_update"), F.col("carried"))).alias("_c"),
        F.max(F.when(F.col("is_update"), F.col("_made"))).alias("_m"),
    )
    joined = join_skewed(ranked, starts, ["version"], "_n", spread_on=["seq"])
    stale = F.coalesce("_c", F.lit(0)) + F.col("_made") - F.coalesce("_m", F.lit(0))
    return joined.withColumn("stale", stale).withColumn("paused", F.col("stale") >= limit).select(
        "seq", "is_update", "version", "stale", "paused"
    )


def assemble_batches(samples: DataFrame, per_batch: int, time: str, start: str, end: str) -> DataFrame:
    """Every ``per_batch`` consecutive samples are one batch with its time and version figures."""
    span = F.abs(F.col(end) - F.col(start))
    return samples.groupBy(whole_div("seq", per_batch).alias("batch")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(time).alias("time_avg"),
        F.max(time).alias("time_max"),
        F.min(time).alias("time_min"),
        *[F.percentile(time, F.lit(q)).alias(f"time_tp{int(q * 100)}") for q in (0.5, 0.95, 0.99)],
        F.count(F.when(span != 0, 1)).alias("partial_num"),
        F.max(span).alias("max_span"),
        F.countDistinct(end).alias("versions"),
    )


def latest_tags(updates: DataFrame, order: list[str]) -> DataFrame:
    """Last write wins per (partition, key, tag)."""
    return updates.groupBy("partition", "key", "tag").agg(F.max_by("value", F.struct(*order)).alias("value"))


def ready_keys(updates: DataFrame, order: list[str]) -> DataFrame:
    """Keys with status ``success`` of every partition and step in which nothing is still ``running``."""
    tags = latest_tags(updates, order)
    keys = tags.groupBy("partition", "key").agg(
        F.max(F.when(F.col("tag") == "step", F.col("value"))).alias("step"),
        F.max(F.when(F.col("tag") == "status", F.col("value"))).alias("status"),
    )
    steps = keys.groupBy("partition", "step").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_or(F.col("status") == "running"), F.lit(False)).alias("busy")
    )
    joined = join_skewed(keys, steps, ["partition", "step"], "_n")
    return joined.where(~F.col("busy") & (F.col("status") == "success")).select("partition", "step", "key")


def stale_trajectories(df: DataFrame, step: str, version: str, current: str) -> DataFrame:
    """Per step: trajectories at least one version behind, and the running total (one row per step)."""
    from pyspark.sql import Window

    per = df.groupBy(step).agg(F.count(F.when(F.col(current) - F.col(version) >= 1, 1)).alias("stale"))
    return per.withColumn("stale_total", F.sum("stale").over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))


def round_cases(rounds: DataFrame, sample: str = "sample", round_no: str = "round", cap: int = 50) -> DataFrame:
    """Case of every recorded round: 1 stopped, 2 closed now, 2c closed before, 3 still thinking, 0 unknown finish.

    ``rounds`` has (sample, round, finish, closes). Rounds after the one that ended a sample, or beyond the
    safety cap, are left out.
    """
    capped = rounds.where(F.col(round_no) <= cap)
    ends = F.coalesce(F.col("finish") != "length", F.lit(True))
    per = capped.groupBy(sample).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(ends, F.col(round_no))).alias("_end"),
        F.min(F.when(F.col("closes"), F.col(round_no))).alias("_closed"),
    )
    rows = join_skewed(capped, per, [sample], "_n")
    live = rows.where(F.col("_end").isNull() | (F.col(round_no) <= F.col("_end")))
    case = (
        F.when(F.col("finish") == "stop", "1")
        .when(F.coalesce(F.col("finish") != "length", F.lit(True)), "0")
        .when(F.col("_closed") == F.col(round_no), "2")
        .when(F.col("_closed") < F.col(round_no), "2c")
        .otherwise("3")
    )
    return live.withColumn("case", case).drop("_n", "_end", "_closed")


def agent_turns(turns, cap: int, max_assistant: int | None = None, max_user: int | None = None):
    """Fold recorded (model_tokens, tool_tokens, calls) turns into struct(model, tool, assistant, user, reason).

    Stops at the response cap, the turn limits, or the first turn without a tool call; a tool reply that
    would reach the cap is not added.
    """
    zero = lambda: F.lit(0).cast("long")
    start = F.struct(
        zero().alias("model"), zero().alias("tool"), zero().alias("assistant"), zero().alias("user"), F.lit("").alias("reason")
    )

    def step(s, t):
        model, assistant = s["model"] + t["model_tokens"], s["assistant"] + 1
        size = model + s["tool"]
        reason = F.when(size >= cap, "cap")
        if max_assistant:
            reason = reason.when(assistant >= max_assistant, "assistant_turns")
        if max_user:
            reason = reason.when(s["user"] >= max_user, "user_turns")
        reason = reason.when(t["calls"] == 0, "no_tool_call").when(size + t["tool_tokens"] >= cap, "cap").otherwise("")
        added = F.when(reason == "", 1).otherwise(0)
        moved = F.struct(
            model.alias("model"),
            (s["tool"] + added * t["tool_tokens"]).alias("tool"),
            assistant.alias("assistant"),
            (s["user"] + added).alias("user"),
            reason.alias("reason"),
        )
        return F.when(s["reason"] == "", moved).otherwise(s)

    return F.aggregate(turns, start, step)
