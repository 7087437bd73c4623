"""Grading of LaTeX answers, each distinct pair once (see ``symbolic`` for what is read and what is equal)."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelake.functions import symbolic
from gradelake.operators.groups import join_skewed

#: Pairs and answers that one worker remembers.
REMEMBERED = 1 << 16


@lru_cache(REMEMBERED)
def _equal(gold: str | None, found: str | None, strict: bool = False) -> bool | None:
    return symbolic.equal(gold, found, strict)


@lru_cache(REMEMBERED)
def _key(answer: str | None) -> str | None:
    return symbolic.answer_key(answer)


@F.pandas_udf(T.BooleanType())
def latex_equal(gold: pd.Series, cand: pd.Series) -> pd.Series:
    return pd.Series([_equal(g, c) for g, c in zip(gold, cand)], dtype=object)


@F.pandas_udf(T.BooleanType())
def latex_equal_strict(gold: pd.Series, cand: pd.Series) -> pd.Series:
    """An integer has to be met by an integer, a quotient by the like quotient."""
    return pd.Series([_equal(g, c, True) for g, c in zip(gold, cand)], dtype=object)


@F.pandas_udf(T.StringType())
def answer_key(answer: pd.Series) -> pd.Series:
    """Equal for all spellings of one rational form or structure of such; NULL where there is no exact form."""
    return pd.Series([_key(a) for a in answer], dtype=object)


def grade_latex(df: DataFrame, predicted: str, gold: str, out: str = "correct", hot_rows: int | None = None, strict: bool = False) -> DataFrame:
    """Grade each distinct (gold, predicted) pair once and attach the verdict to its rows.

    ``<out>`` is false where the pair could not be read; ``<out>_unread`` tells those apart.
    """
    pairs = df.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("_n"))
    graded = pairs.withColumn("_same", (latex_equal_strict if strict else latex_equal)(F.col(gold), F.col(predicted)))
    joined = join_skewed(df, graded, [gold, predicted], "_n", hot_rows)
    return joined.withColumns(
        {out: F.coalesce("_same", F.lit(False)), f"{out}_unread": F.col("_same").isNull()}
    ).drop("_n", "_same")


def with_answer_key(df: DataFrame, answer: str, out: str = "answer_key", hot_rows: int | None = None) -> DataFrame:
    """Attach what groups unlike spellings of one answer: its key, or the answer itself where it has none.

    Each distinct answer is read once.
    """
    texts = df.groupBy(answer).agg(F.count(F.lit(1)).alias("_n"))
    keyed = texts.withColumn(out, F.coalesce(answer_key(F.col(answer)), F.concat(F.lit("="), F.col(answer))))
    return join_skewed(df, keyed, [answer], "_n", hot_rows).drop("_n")


def unread_pairs(graded: DataFrame, by: list[str], out: str = "correct") -> DataFrame:
    """Rows, correct ones and unread ones per ``by``, of what ``grade_latex`` gives."""
    return graded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(out)).alias("n_correct"), F.count_if(F.col(f"{out}_unread")).alias("n_unread")
    )


def grade_any(kind: Column, predicted: Column, gold: Column) -> Column:
    """Verdict per row for mixed answer kinds (a worker reads each LaTeX pair once); NULL for pairs that cannot be read."""
    from gradelake.functions.extract import grade_integer, grade_letter

    return (
        F.when(predicted.isNull(), F.lit(False))
        .when(kind == "integer", grade_integer(predicted, gold))
        .when(kind == "letter", grade_letter(predicted, gold))
        .when(kind == "latex", latex_equal(gold, predicted).cast("boolean"))
        .otherwise(F.lit(False))
    )


def score_latex(text: Column, gold: Column, unread: float = 0.0) -> Column:
    """1/0 for the response's final LaTeX answer against the gold one; ``unread`` where either cannot be read."""
    from gradelake.functions.extract import extract_boxed

    same = latex_equal(gold, extract_boxed(text))
    return F.coalesce(same.cast("double"), F.lit(float(unread)))
