"""Scorers with a deadline per row: a child of the Python worker runs them and is replaced when it misses one."""

import multiprocessing
import os
import signal
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.operators.groups import join_group_stats

DONE, FAILED, LATE, UNREADABLE = "done", "failed", "late", "unreadable"


def _number(value: object) -> tuple[str, float | None]:
    """A number, or the first part of what can be indexed; nothing counts as a failure."""
    if value is None:
        return FAILED, None
    try:
        return DONE, float(value) if isinstance(value, (int, float)) else float(value[0])
    except Exception:
        return UNREADABLE, None


def _serve(asks, other, fn: Callable, seconds: float) -> None:
    other.close()
    signal.signal(signal.SIGALRM, signal.SIG_DFL)
    while True:
        try:
            row = asks.recv()
        except EOFError:
            os._exit(0)
        # if the worker is gone, nobody else ends this process
        signal.setitimer(signal.ITIMER_REAL, 2 * seconds + 5)
        try:
            answer = _number(fn(*row))
        except Exception:
            answer = FAILED, None
        signal.setitimer(signal.ITIMER_REAL, 0)
        asks.send(answer)


class Supervised:
    """``fn`` in a child process. ``ask`` waits at most ``seconds``; a child that is late or has died is replaced."""

    def __init__(self, fn: Callable, seconds: float):
        self.fn, self.seconds, self.child, self.started = fn, seconds, None, 0

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.line, theirs = context.Pipe()
        self.child = context.Process(target=_serve, args=(theirs, self.line, self.fn, self.seconds), daemon=True)
        self.child.start()
        theirs.close()
        self.started += 1

    def ask(self, *row: object) -> tuple[str, float | None]:
        if self.child is None:
            self._start()
        try:
            self.line.send(row)
            if self.line.poll(self.seconds):
                return self.line.recv()
        except (EOFError, OSError):
            self.close()
            return FAILED, None
        self.close()
        return LATE, None

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.line.close()
            self.child = None


def score_within(fn: Callable[..., object], seconds: float, failed: float = 0.0) -> Callable[..., Column]:
    """A column function over the arguments of ``fn``: struct (score double, outcome string).

    ``outcome`` is done, failed (an error, no value, or the process died), late (no answer within ``seconds``) or unreadable (a
    value that is no number and does not begin with one). All but done score ``failed``. Nulls are passed on as None.
    """

    @F.pandas_udf("score double, outcome string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        child = Supervised(fn, seconds)
        try:
            for columns in batches:
                found = [child.ask(*[None if pd.isna(v) else v for v in row]) for row in zip(*columns)]
                yield pd.DataFrame({"score": [failed if s is None else s for _, s in found], "outcome": [o for o, _ in found]})
        finally:
            child.close()

    return lambda *columns: run(*columns)


def score_distinct(df: DataFrame, fn: Callable[..., object], columns: Sequence[str], seconds: float, failed: float = 0.0) -> DataFrame:
    """``score`` and ``outcome`` beside every row; equal arguments are scored once, since an answer that is late is dear."""
    names = [f"_asked_{i}" for i in range(len(columns))]
    asked = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)]).distinct()
    scored = asked.withColumn("_r", score_within(fn, seconds, failed)(*names)).select(*names, "_r.score", "_r.outcome")
    same = F.lit(True)
    for c, n in zip(columns, names):
        same = same & df[c].eqNullSafe(scored[n])
    return df.join(scored, same).drop(*names)


def zero_broken_batches(scored: DataFrame, batch: Sequence[str], failed: float = 0.0) -> DataFrame:
    """Every row of a batch scores ``failed`` if one of its values could not be read; late and failed rows cost only themselves."""
    rows = join_group_stats(scored, batch, [F.bool_or(F.col("outcome") == UNREADABLE).alias("_broken")])
    return rows.withColumn("score", F.when(F.col("_broken"), F.lit(failed)).otherwise(F.col("score"))).drop("_broken", "group_n")
