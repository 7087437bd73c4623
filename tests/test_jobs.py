import json

import pytest

from gradelake import jobs


def line(pid, idx, **more):
    rec = {"problem_id": pid, "sample_idx": idx, "correct": False, "completion_tokens": 10, "predicted_answer": None, "gt_answer": "4", "response": "<answer>4</answer>", "num_steps": 1}
    return json.dumps(rec | more)


@pytest.fixture
def runs(tmp_path):
    base, method = tmp_path / "base" / "m1__aime__baseline", tmp_path / "method" / "m1__aime__replay"
    for folder in (base, method):
        folder.mkdir(parents=True)
    (base / "raw.jsonl").write_text("\n".join([line("p1", 1, predicted_answer="4", correct=True), line("p2", 1, predicted_answer="5"), line("p4", 1)]) + "\n")
    more = {"baseline_tokens": 10, "continuation_tokens": 5, "completion_tokens": 15, "findings": [], "num_findings": 0, "mode": "methodb"}
    (method / "raw.jsonl").write_text(
        "\n".join(
            [
                line("p1", 1, **more, methodb_correct=False), line("p2", 1, **more | {"completion_tokens": 16}, predicted_answer="4", correct=True, methodb_correct=False),
                "{broken", line("p3", 1, **more, methodb_correct=False), line("p3", 1, **more, methodb_correct=False), line("p4", 1, **more, methodb_correct=False),
            ]
        )
        + "\n"
    )
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("fine\nTraceback (most recent call last)\n")
    return tmp_path


def test_summaries_compare_and_commands(spark, runs, capsys):
    s = jobs.summaries(spark, str(runs / "method")).collect()
    assert [(r.model, r.dataset, r.suffix, r.n, r.n_correct) for r in s] == [("m1", "aime", "replay", 4, 1)]
    c = jobs.compare(spark, str(runs / "base"), str(runs / "method")).first()
    assert (c.n, c.cw, c.wc, c.ww) == (3, 1, 1, 1)
    assert jobs.main(["compare", str(runs / "base"), str(runs / "method")], spark) == 0
    assert jobs.main(["summaries", str(runs / "method"), "--out", str(runs / "summary")], spark) == 0
    assert "m1" in capsys.readouterr().out


def test_audit_gives_one_issue_table_and_a_status(spark, runs):
    (runs / "summary.csv").write_text("m1,aime,replay,5,1,0.250,15.2,16,1.00,x\nshort,line\n")
    rows = jobs.audit(spark, str(runs / "method"), str(runs / "base"), str(runs / "summary.csv"), str(runs / "logs"))
    assert rows.columns == jobs.ISSUES
    got = {r.check: r.n_bad for r in rows.collect()}
    assert got["parse_error"] == got["repeated_key"] == got["token_sum"] == got["methodb_correct"] == got["baseline_missing"] == 1
    assert got["summary_n"] == got["summary_line"] == got["log"] == 1
    assert jobs.main(["audit", str(runs / "method"), "--base", str(runs / "base")], spark) == 1
    clean = runs / "clean" / "m1__aime__baseline"
    clean.mkdir(parents=True)
    (clean / "raw.jsonl").write_text(line("p1", 1) + "\n")
    assert jobs.main(["audit", str(runs / "clean")], spark) == 0


def test_regrade_and_repair_write_runs_that_can_be_read(spark, runs):
    r = jobs.regrade(spark, str(runs / "method"), str(runs / "regraded")).first()
    assert (r.n, r.new_right, r.methodb_off, r.unread) == (4, 3, 0, 0)
    back = spark.read.json(str(runs / "regraded"))
    assert back.count() == 4 and back.where("correct and methodb_correct").count() == 4
    assert {x.run for x in back.select("run").distinct().collect()} == {"m1__aime__replay"}
    counters = {r.level: r for r in jobs.repair(spark, str(runs / "base"), str(runs / "method"), str(runs / "repaired")).collect()}
    assert (counters[0].repaired, counters[0].baseline_also_none, counters[0].new_correct) == (1, 1, 1)
