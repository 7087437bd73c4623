import os
import time

import pytest
from pyspark.sql import functions as F

from gradelake.functions import timed


def make_scorer():
    """Nested, so that workers get it by value."""

    def scorer(text, gold):
        if text is None:
            return None
        if text == "sleep":
            time.sleep(60)
        if text == "spin":
            while True:
                pass
        if text == "die":
            os._exit(3)
        if text == "raise":
            raise ValueError(text)
        if text == "pair":
            return [0.5, "why"]
        if text == "odd":
            return {"score": 1}
        return text == gold

    return scorer


scorer = make_scorer()


def test_a_late_child_is_replaced_and_the_next_rows_keep_their_scores():
    child = timed.Supervised(scorer, 0.5)
    start = time.monotonic()
    got = [child.ask(t, "a") for t in ("a", "sleep", "a", "spin", "die", "b", "raise", "pair", "odd", None)]
    child.close()
    assert got == [("done", 1.0), ("late", None), ("done", 1.0), ("late", None), ("failed", None), ("done", 0.0), ("failed", None), ("done", 0.5), ("unreadable", None), ("failed", None)]
    assert child.started == 4 and time.monotonic() - start < 10


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["a", "spin", "b", "a", "odd", "a", None, "die", "a", "spin"]
    return spark.createDataFrame([(i, i // 4, t, "a") for i, t in enumerate(texts)], "id long, batch long, text string, gold string").repartition(3)


def test_rows_in_spark(rows):
    out = rows.withColumn("r", timed.score_within(scorer, 1.0, -1.0)("text", "gold")).select("id", "r.*")
    got = {r.id: (r.score, r.outcome) for r in out.collect()}
    right, late = (1.0, "done"), (-1.0, "late")
    assert got == {0: right, 1: late, 2: (0.0, "done"), 3: right, 4: (-1.0, "unreadable"), 5: right, 6: (-1.0, "failed"), 7: (-1.0, "failed"), 8: right, 9: late}


def test_equal_arguments_once_and_broken_batches(rows):
    scored = timed.score_distinct(rows, scorer, ["text", "gold"], 1.0)
    assert {r.id: r.outcome for r in scored.collect()}[9] == "late"
    got = {r.id: r.score for r in timed.zero_broken_batches(scored, ["batch"]).select("id", "score").collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0, 8: 1.0, 9: 0.0}


def test_no_rows(rows):
    empty = timed.zero_broken_batches(timed.score_distinct(rows.where(F.lit(False)), scorer, ["text", "gold"], 1.0), ["batch"])
    assert empty.count() == 0
