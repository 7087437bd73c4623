import random

import pytest

from gradelake.operators import evaluation as ev


@pytest.mark.parametrize("samples", [1, 4, 63, 64, 65, 130])
def test_what_is_left_is_the_complement(spark, samples):
    rng = random.Random(samples)
    names = [None, "a", "b", "c", "whole", "fresh"]
    done = [(rng.choice(names[1:4]), rng.choice([None, -1, 0, 1, 2, samples, samples + 1, rng.randint(1, samples)])) for _ in range(200)]
    done += [("whole", s) for s in range(1, samples + 1)] + [(None, 1), ("gone", 1)]
    problems = spark.createDataFrame([(n, f"text of {n}") for n in names], "problem_id string, question string")
    out = ev.work_list(problems, spark.createDataFrame(done, "problem_id string, sample_idx int"), samples)
    got = sorted((str(r.problem_id), r.sample_idx, r.question) for r in out.collect())
    have = {d for d in done if d[0] is not None}
    assert got == sorted((str(n), s, f"text of {n}") for n in names for s in range(1, samples + 1) if (n, s) not in have)


def test_nothing_done_and_no_problems(spark):
    problems = spark.createDataFrame([("a",), ("a",)], "problem_id string")
    none = spark.createDataFrame([], "problem_id string, sample_idx long")
    assert sorted(r.sample_idx for r in ev.work_list(problems, none, 2).collect()) == [1, 1, 2, 2]
    assert ev.work_list(problems.where("false"), none, 2).count() == 0
    with pytest.raises(ValueError):
        ev.work_list(problems, none, 0)
