import json

import pytest
from pyspark.sql import functions as F

from gradelake import schemas
from gradelake.operators import audit
from gradelake.operators import evaluation as ev
from gradelake.operators import metrics as M
from gradelake.operators import rows as R
from gradelake.sources import readers as rd
from gradelake.sources import sinks as sk


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


REC = [
    json.dumps({"problem_id": "p1", "sample_idx": 1, "correct": False, "completion_tokens": 5, "response": "é"}, ensure_ascii=False),
    "",
    '{"problem_id": "p1", "sample_idx": 2, "correct": "yes", "completion_tokens": 0}',
    "{broken",
    json.dumps({"problem_id": "p1", "sample_idx": 1, "correct": True, "completion_tokens": 9}),
    json.dumps({"problem_id": "p2", "sample_idx": 1, "correct": True, "completion_tokens": 7, "predicted_answer": None}),
]


def test_strict_reader_fails_on_a_bad_line(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", REC)
    with pytest.raises(Exception):
        rd.read_jsonl_strict(spark, path, schemas.BASELINE).collect()
    pointer = write(tmp_path / "b.jsonl", ["version https://example.org/spec", "oid sha256:0", "size 1"])
    with pytest.raises(Exception):
        rd.read_jsonl_strict(spark, pointer, schemas.BASELINE).collect()


def test_marked_reader_keeps_bad_lines_and_wrong_types_are_not_parse_errors(spark, tmp_path):
    rows = rd.read_jsonl_marked(spark, write(tmp_path / "a.jsonl", REC), schemas.BASELINE).collect()
    assert len(rows) == 5 and sum(r.parse_error for r in rows) == 1
    odd = [r for r in rows if r.sample_idx == 2][0]
    assert odd.correct is None and not odd.parse_error


def test_last_line_wins_in_file_order_across_splits(spark, tmp_path):
    lines = [json.dumps({"problem_id": f"p{i % 50}", "sample_idx": 1, "completion_tokens": i}) for i in range(5000)]
    path = write(tmp_path / "big.jsonl", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        got = {r.problem_id: r.completion_tokens for r in rd.read_records(spark, path, schemas.BASELINE).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"p{i}": 4950 + i for i in range(50)}


def test_keyed_shards_and_dataset_readers(spark, tmp_path):
    ddl = "id string, question_id string, problem_id string, question string"
    path = write(tmp_path / "d.jsonl", ['{"id": "a", "question": "1"}', '{"question_id": "b"}', '{"question": "x"}', '{"id": "a", "question": "2"}'])
    got = {r.pid: r.question for r in rd.read_keyed(spark, path, ddl).collect()}
    assert got == {"a": "2", "b": None}
    for i in range(2):
        write(tmp_path / "s" / f"passk_shard_{i}.jsonl", [f'{{"id": "{i}"}}'])
    write(tmp_path / "s" / "other.jsonl", ['{"id": "z"}'])
    assert {r.id for r in rd.read_shards(spark, str(tmp_path / "s"), ddl).collect()} == {"0", "1"}
    spark.range(3).write.parquet(str(tmp_path / "x.parquet"))
    assert rd.read_dataset(spark, [str(tmp_path / "x.parquet")] * 2).count() == 6
    with pytest.raises(ValueError):
        rd.read_dataset(spark, ["x.csv"])


def test_cell_columns_and_problem_counts(spark, tmp_path):
    path = write(tmp_path / "m1__aime__unlimited" / "raw.jsonl", ["{}", "", "{}"])
    other = write(tmp_path / "m1__huh__x" / "raw.jsonl", ["{}"])
    rows = {(r.model, r.dataset, r.suffix) for r in rd.with_cell_columns(rd.read_lines(spark, [path, other])).collect()}
    assert rows == {("m1", "aime", "unlimited"), ("m1", None, "x")}
    assert rd.count_problems(spark, path) == 2
    assert rd.count_problems(spark, str(tmp_path / "missing.jsonl")) == 0
    got = [r.problem_id for r in rd.with_problem_id(spark.createDataFrame([("a", None, 0), (None, "q", 1), (None, None, 2)], "id string, question_id string, row_idx int")).collect()]
    assert got == ["a", "q", "row_2"]


def test_generation_hook(spark):
    df = spark.createDataFrame([("p1", "x"), ("p2", "y")], "problem_id string, prompt string")
    out = rd.generate(df, lambda ps: [[p + "1", p + "2"] for p in ps], 2, batch=1)
    assert sorted(map(tuple, out.collect())) == [("p1", 1, "x1"), ("p1", 2, "x2"), ("p2", 1, "y1"), ("p2", 2, "y2")]


def test_summary_formatting_and_last_line(spark, tmp_path):
    s = spark.createDataFrame([("m", "aime", "baseline", 16, 1, 0.0625, 0.25, 9, 1.125)], "model string, dataset string, method string, n long, n_correct long, acc double, avg_tok double, max_tok long, avg_steps double")
    lines = sk.summary_lines(s, F.lit("out"))
    assert tuple(lines.first()) == ("m", "aime", "baseline", 16, 1, "0.062", "0.2", 9, "1.12", "out")
    sk.write_summary(lines, str(tmp_path / "csv"))
    text = [p.read_text() for p in (tmp_path / "csv").glob("part*")]
    assert text == ["m,aime,baseline,16,1,0.062,0.2,9,1.12,out\n"]
    path = write(tmp_path / "s.csv", ["m,aime,b,1,1,1.0,1.0,1,1.0,o", "bad,line", "m,aime,b,2,1,0.5,1.0,1,1.0,o"])
    last, short = audit.last_summary_lines(rd.read_summary_lines(spark, path))
    assert [(r.n, r.acc) for r in last.collect()] == [(2, 0.5)] and short.count() == 1
    diff = sk.summary_changes(s, s.withColumn("n", F.lit(17))).collect()
    assert [d.change for d in diff] == ["changed"]


def test_rewrite_replaces_its_own_input(spark, tmp_path):
    path = str(tmp_path / "t")
    sk.append_records(spark.createDataFrame([(1, None), (2, "b")], "a int, b string"), path)
    assert any('"b":null' in p.read_text() for p in (tmp_path / "t").glob("part*"))
    df = spark.read.json(path)
    sk.rewrite(df.withColumn("a", F.col("a") + 10), path)
    assert sorted(r.a for r in spark.read.json(path).collect()) == [11, 12]
    assert not (tmp_path / "t__next").exists() and not (tmp_path / "t__before").exists()


def test_step_dumps_replace_only_their_step(spark, tmp_path):
    path = str(tmp_path / "dump")
    for step, v in ((1, "a"), (2, "b"), (1, "c")):
        sk.write_step(spark.createDataFrame([(v,)], "v string"), path, step)
    assert [r.v for r in rd.read_step(spark, path, 1).collect()] == ["c"]
    assert [r.v for r in rd.read_step(spark, path, 2).collect()] == ["b"]


def test_other_sinks(spark, tmp_path):
    base = spark.createDataFrame([("p", 1, True), ("p", 2, False)], "problem_id string, sample_idx int, correct boolean")
    pairs = ev.join_pairs(base, base)
    sk.write_buckets(ev.bucket_samples(pairs, 3), str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").glob("bucket=*")) == ["bucket=CC", "bucket=WW"]
    sk.write_responses(base.withColumn("response", F.concat(F.lit("r"), "sample_idx")), str(tmp_path / "r"), ["problem_id"])
    assert spark.read.parquet(str(tmp_path / "r")).first().responses == ["r1", "r2"]
    sk.write_metrics(spark.createDataFrame([(1, "a", 2.0)], "step int, name string, value double"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    sk.write_snapshot(base, str(tmp_path / "snap"))
    assert "problem_id" in "".join(p.read_text() for p in (tmp_path / "snap").glob("part*"))
    cell = pairs.withColumn("model", F.lit("m"))
    assert "CC=    1" in sk.report_lines(ev.transition_matrix(cell, ["model"]), ["model"]).first().line


def test_settings_tables(spark):
    assert schemas.model_table(spark).count() == 7 and schemas.dataset_table(spark).count() == 4
    for ddl in (schemas.PROBLEMS, schemas.MULTI_ROUND, schemas.REPLAY, schemas.TRAJECTORIES):
        assert schemas.schema(ddl).fields


def test_rename_zip_and_concat_refuse_bad_input(spark):
    a = spark.createDataFrame([(0, 1.0, float("nan"))], "row_idx int, x double, y double")
    with pytest.raises(ValueError):
        R.rename(a, ["x"], [])
    assert R.zip_columns(a, a.withColumn("z", F.lit(1))).first().z == 1
    with pytest.raises(Exception, match="differs"):
        R.zip_columns(a, a.withColumn("x", F.lit(2.0))).collect()
    with pytest.raises(ValueError):
        R.concat_rows([a, a.drop("x")])


def test_pad_cycles_and_unpads(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(3)], "row_idx long, v string")
    out = R.pad_to_multiple(df, 8)
    assert [r.v for r in out.orderBy("row_idx").collect()] == ["v0", "v1", "v2", "v0", "v1", "v2", "v0", "v1"]
    assert R.unpad(out).count() == 3
    sample = R.seeded_sample(df, 2, 5).collect()
    assert len({r.row_idx for r in sample}) == 2 and sample == R.seeded_sample(df, 2, 5).collect()
    epochs = R.mini_batches(df, 3, 2, seed=1).collect()
    assert sorted((r.epoch, r.row_idx) for r in epochs) == [(e, i) for e in (0, 1) for i in range(3)]


def test_metric_reducers(spark):
    rows = [("loss/max", 0, 0, 1.0), ("loss/max", 1, 0, 3.0), ("x", 0, 0, 1.0), ("x", 0, 1, 2.0), ("x", 1, 0, 5.0)]
    df = spark.createDataFrame(rows, "name string, rank int, step int, value double")
    assert {r.name: r.value for r in M.reduce_by_name(df).collect()}["loss/max"] == 3.0
    with pytest.raises(Exception, match="different numbers"):
        M.reduce_across_ranks(df, "mean").collect()
    assert M.merge_meta([{"metrics": [1], "a": 1}, {"metrics": [2], "a": 1}]) == {"metrics": [1, 2], "a": 1}
    with pytest.raises(ValueError):
        M.merge_meta([{"a": 1}, {"a": 2}])


def test_empty_comparison_gives_null_shares(spark):
    base = spark.createDataFrame([], "problem_id string, sample_idx int, correct boolean, model string")
    assert ev.transition_matrix(ev.join_pairs(base, base.drop("model")), ["model"]).count() == 0


def test_unknown_ablation_is_refused():
    with pytest.raises(ValueError):
        ev.classify_mode(*[F.lit(1)] * 7, max_model_len=10, ablation="other")


def test_take_refuses_unknown_positions_and_masks_select(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "row_idx bigint, v string")
    at = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "pos bigint, row_idx bigint")
    assert [r.v for r in R.take(df, at(4, 0, 4)).orderBy("row_idx").collect()] == ["v4", "v0", "v4"]
    for bad in (-1, 5):
        with pytest.raises(Exception, match="no row at position"):
            R.take(df, at(0, bad)).collect()
    assert [(r.row_idx, r.v) for r in R.take_mask(df, F.col("v").isin("v1", "v3")).orderBy("row_idx").collect()] == [(0, "v1"), (1, "v3")]
    with pytest.raises(Exception, match="NULL"):
        R.take_mask(df, F.when(F.col("v") == "v1", True)).collect()


def test_large_positions_are_divided_exactly(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(big, "a")], "row_idx bigint, v string")
    assert R.batches(df.where("row_idx < 0"), 3).count() == 0
    from gradelake.functions.text import whole_div

    assert df.select(whole_div("row_idx", 1)).first()[0] == big


def test_rewrite_says_when_the_old_version_cannot_be_put_aside(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "a int")
    df.write.json(path)
    real = sk._fs

    class Stuck:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda *a: False) if name == "rename" else getattr(self.fs, name)

    def stuck(spark, p):
        at, fs = real(spark, p)
        return at, Stuck(fs)

    monkeypatch.setattr(sk, "_fs", stuck)
    with pytest.raises(OSError, match="aside"):
        sk.rewrite(df.withColumn("a", F.lit(2)), path)
    assert [r.a for r in spark.read.json(path).collect()] == [1]


def test_code_verdicts_of_external_graders_are_no_issue(spark):
    ddl = "problem_id string, sample_idx int, correct boolean, methodb_correct boolean, completion_tokens int, baseline_tokens int, continuation_tokens int, mode string, num_findings int, findings array<string>, kind string, cell string"
    rows = [("p", i, True, False, 5, 5, 0, "methodb", 0, [], k, "c") for i, k in enumerate(["code", "integer", None])]
    records = spark.createDataFrame(rows, ddl)
    issues = audit.audit_records(records, records.select("problem_id", "sample_idx", "completion_tokens"), ["cell"], F.lit(False), kind=F.col("kind"))
    found = {r["check"]: r.n_bad for r in issues.collect()}
    assert found["methodb_correct"] == found["grade_mismatch"] == 2


def test_regrade_keeps_what_it_cannot_read_and_sets_both_verdicts(spark):
    rows = [("<answer>4</answer>", "4", None, False, False), ("<answer>5</answer>", "4", "4", True, True), ("\\boxed{x@y}", "\\frac{1}{2}", "q", True, None)]
    df = spark.createDataFrame(rows, "response string, gt_answer string, predicted_answer string, correct boolean, methodb_correct boolean")
    from gradelake.functions.latex import grade_any

    kind = F.when(F.col("gt_answer") == "4", "integer").otherwise("latex")
    out = ev.regrade(df, kind, grade_any)
    got = {r.response[-12:]: (r.correct, r.methodb_correct, r.unread) for r in out.collect()}
    assert sorted(got.values(), key=str) == sorted([(True, True, False), (False, False, False), (True, None, True)], key=str)


def test_missing_votes_count_alike_in_both_plans(spark):
    from gradelake.operators import validation as V

    rows = [("g", i, float(i % 3), None if i % 2 else "a") for i in range(9)]
    df = spark.createDataFrame(rows, "grp string, o int, v double, vote string")
    few, many = (sorted(map(tuple, V.bootstrap(df, ["grp"], ["o"], "v", "vote", boots=50, array_limit=n).collect())) for n in (100, 3))
    assert len(few) == len(many) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 for a, b in zip(few, many))
    assert any(r[2].startswith("maj") for r in few)
