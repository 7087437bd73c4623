"""Evaluation queries: summaries, comparison, joins, audits, repair and mode logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import audit, evaluation as ev
from gradelake.operators.groups import last_wins, top_per_group
from gradelake.plans.derived import BASE_SQL, METHOD_SQL, baseline_runs, method_runs, with_
from gradelake.plans.registry import query, table

CELL = ["model", "dataset"]
PAIRS_SQL = """
pairs AS (
  SELECT b.model, b.dataset, b.problem_id, b.sample_idx, b.correct AS b_ok, m.correct AS m_ok,
         (CASE WHEN b.correct THEN 'C' ELSE 'W' END) || (CASE WHEN m.correct THEN 'C' ELSE 'W' END) AS bucket,
         m.mode, b.completion_tokens AS b_tok, m.completion_tokens AS m_tok, m.continuation_tokens, m.num_findings
  FROM base b JOIN meth m USING (problem_id, sample_idx))
"""
PAIRED = with_(BASE_SQL, METHOD_SQL, PAIRS_SQL)


def _pairs(spark, sf):
    base = baseline_runs(spark, sf).drop("o_orderpriority")
    return ev.join_pairs(base, method_runs(spark, sf).drop("model", "dataset", "findings"))


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "ag1_cell_summary",
    with_(BASE_SQL)
    + """SELECT model, dataset, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct,
       round(avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS acc,
       round(avg(completion_tokens), 6) AS avg_tok, max(completion_tokens) AS max_tok, round(avg(num_steps), 6) AS avg_steps
  FROM base GROUP BY model, dataset""",
)
def _(spark, sf):
    return _rounded(ev.cell_summary(baseline_runs(spark, sf), CELL), "acc", "avg_tok", "avg_steps")


@query(
    "ag2_transition_matrix",
    PAIRED
    + """SELECT model, dataset, count(*) AS n, sum((bucket='CC')::INT)::BIGINT AS cc, sum((bucket='CW')::INT)::BIGINT AS cw,
       sum((bucket='WC')::INT)::BIGINT AS wc, sum((bucket='WW')::INT)::BIGINT AS ww,
       round(avg((bucket='CC')::INT), 6) AS cc_share, round(avg((bucket='CW')::INT), 6) AS cw_share,
       round(avg((bucket='WC')::INT), 6) AS wc_share, round(avg((bucket='WW')::INT), 6) AS ww_share,
       sum(b_ok::INT)::BIGINT AS base_correct, sum(m_ok::INT)::BIGINT AS method_correct,
       (sum(m_ok::INT) - sum(b_ok::INT))::BIGINT AS delta,
       round((sum(m_ok::INT) - sum(b_ok::INT))::DOUBLE / count(*), 6) AS delta_share
  FROM pairs GROUP BY model, dataset""",
)
def _(spark, sf):
    shares = ["cc_share", "cw_share", "wc_share", "ww_share", "delta_share"]
    return _rounded(ev.transition_matrix(_pairs(spark, sf), CELL), *shares)


@query(
    "ag3_mode_histogram",
    PAIRED + "SELECT mode, count(*) AS n, count(*) FILTER (WHERE mode = 'methodb') AS triggered FROM pairs GROUP BY mode",
)
def _(spark, sf):
    return (
        _pairs(spark, sf)
        .groupBy(F.coalesce("m_mode", F.lit("unknown")).alias("mode"))
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("m_mode") == "methodb", 1)).alias("triggered"))
    )


@query(
    "ag4_token_averages",
    PAIRED
    + """SELECT model, dataset, round(avg(b_tok), 6) AS avg_base_tok, round(avg(m_tok), 6) AS avg_method_tok,
       round(avg(m_tok) - avg(b_tok), 6) AS avg_diff_tok, count(*) FILTER (WHERE mode='methodb') AS triggered,
       round(sum(continuation_tokens)::DOUBLE / nullif(count(*) FILTER (WHERE mode='methodb'), 0), 6) AS avg_continuation,
       round(sum(num_findings)::DOUBLE / nullif(count(*) FILTER (WHERE mode='methodb'), 0), 6) AS avg_findings,
       round(avg(continuation_tokens) FILTER (WHERE mode='methodb'), 6) AS avg_continuation_filtered,
       round(avg(num_findings) FILTER (WHERE mode='methodb'), 6) AS avg_findings_filtered
  FROM pairs GROUP BY model, dataset""",
)
def _(spark, sf):
    out = ev.token_averages(_pairs(spark, sf), CELL)
    return _rounded(out, *[c for c in out.columns if c.startswith("avg_")])


@query(
    "ag5_turns_histogram",
    with_(BASE_SQL, METHOD_SQL) + "SELECT turns_committed, count(*) AS n FROM meth GROUP BY turns_committed",
)
def _(spark, sf):
    return method_runs(spark, sf).groupBy("turns_committed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag8_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(spark, sf):
    return ev.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


LATEST = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(
    "ag9_last_wins",
    """SELECT l_orderkey, l_linenumber, max_row.p AS l_partkey, max_row.s AS l_suppkey, max_row.e AS l_extendedprice FROM (
     SELECT l_orderkey, l_linenumber, max({d: l_shipdate, p: l_partkey, s: l_suppkey, e: l_extendedprice, q: l_quantity}) AS max_row
     FROM lineitem GROUP BY ALL)""",
)
def _(spark, sf):
    latest = last_wins(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], LATEST)
    return latest.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


RAW_LINES_SQL = """
raw AS (
  SELECT event_type AS cell,
    CASE WHEN event_id % 31 = 0 THEN '{"problem_id": ' || event_id ELSE
    '{"problem_id": ' || event_id || CASE WHEN event_id % 5 = 0 THEN '' ELSE ', "sample_idx": 1' END
    || CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ', "correct": null' WHEN 2 THEN ', "correct": "true"' ELSE ', "correct": true' END
    || ', "completion_tokens": ' || user_id || ', "predicted_answer": null'
    || CASE WHEN event_id % 11 = 0 THEN '' ELSE ', "gt_answer": "7"' END || ', "response": "r"}' END AS value,
    event_id
  FROM events)
"""


def _raw_lines(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    head = F.concat(F.lit('{"problem_id": '), i.cast("string"))
    flag = (
        F.when(i % 7 == 0, "")
        .when(i % 7 == 1, ', "correct": null')
        .when(i % 7 == 2, ', "correct": "true"')
        .otherwise(', "correct": true')
    )
    line = F.concat(
        head,
        F.when(i % 5 == 0, "").otherwise(', "sample_idx": 1'),
        flag,
        F.concat(F.lit(', "completion_tokens": '), F.col("user_id").cast("string"), F.lit(', "predicted_answer": null')),
        F.when(i % 11 == 0, "").otherwise(', "gt_answer": "7"'),
        F.lit(', "response": "r"}'),
    )
    return e.select(F.col("event_type").alias("cell"), F.when(i % 31 == 0, head).otherwise(line).alias("value"), "event_id")


_REQ = audit.BASE_REQUIRED


@query(
    "ag10_missing_fields",
    with_(RAW_LINES_SQL)
    + """, good AS (SELECT cell, CASE WHEN json_valid(value) THEN json_keys(value) END AS k,
                CASE WHEN json_valid(value) THEN json_type(value, '$.correct') END AS ct FROM raw)
  SELECT cell, 'parse_error' AS "check", count(*) FILTER (WHERE k IS NULL) AS n_bad FROM good GROUP BY cell
  UNION ALL SELECT cell, 'correct_not_bool', count(*) FILTER (WHERE k IS NOT NULL AND coalesce(ct,'') <> 'BOOLEAN') FROM good GROUP BY cell
  """
    + " ".join(
        f"UNION ALL SELECT cell, 'missing_{f}', count(*) FILTER (WHERE k IS NOT NULL AND NOT list_contains(k, '{f}')) FROM good GROUP BY cell"
        for f in _REQ
    ),
)
def _(spark, sf):
    return audit.audit_raw_lines(_raw_lines(spark, sf), ["cell"])


REPAIR_SQL = """
rep AS (
  SELECT m.*, b.predicted_answer AS bp, b.correct AS bc, b.sample_idx AS bs
  FROM meth m LEFT JOIN (SELECT * FROM base WHERE sample_idx % 10 <> 3) b USING (problem_id, sample_idx)),
fix AS (
  SELECT *, predicted_answer IS NULL AND mode IN ('methodb','verify_only') AS want,
         predicted_answer IS NULL AND mode IN ('methodb','verify_only') AND bp IS NOT NULL AS fixed FROM rep)
"""


def _repaired(spark, sf):
    base = baseline_runs(spark, sf).where("sample_idx % 10 <> 3").drop("o_orderpriority", "model", "dataset")
    return ev.repair(method_runs(spark, sf), base)


@query(
    "ag11_repair_counters",
    with_(BASE_SQL, METHOD_SQL, REPAIR_SQL)
    + """SELECT model, dataset, CASE WHEN grouping(model)=1 THEN 3 ELSE 0 END::BIGINT AS level, count(*) AS n,
    count(*) FILTER (WHERE want) AS none_to_fix, count(*) FILTER (WHERE fixed) AS repaired,
    count(*) FILTER (WHERE want AND bs IS NOT NULL AND bp IS NULL) AS baseline_also_none,
    count(*) FILTER (WHERE predicted_answer IS NULL AND NOT want) AS skipped_fallback,
    count(*) FILTER (WHERE fixed AND bc AND NOT correct) AS new_correct
  FROM fix GROUP BY GROUPING SETS ((model, dataset), ())""",
)
def _(spark, sf):
    return ev.repair_counters(_repaired(spark, sf), CELL)


@query(
    "up2_repair_no_answer",
    with_(BASE_SQL, METHOD_SQL, REPAIR_SQL)
    + """SELECT problem_id, sample_idx, CASE WHEN fixed THEN bp ELSE predicted_answer END AS predicted_answer,
      CASE WHEN fixed THEN bc ELSE correct END AS correct, CASE WHEN fixed THEN mode || '_no_answer_fallback' ELSE mode END AS mode,
      CASE WHEN fixed THEN true END AS no_answer_repair,
      CASE WHEN fixed AND methodb_correct IS NOT NULL THEN bc ELSE methodb_correct END AS methodb_correct FROM fix""",
)
def _(spark, sf):
    cols = ["problem_id", "sample_idx", "predicted_answer", "correct", "mode", "no_answer_repair", "methodb_correct"]
    return _repaired(spark, sf).select(*cols)


@query(
    "jn1_pair_join",
    PAIRED + "SELECT problem_id, sample_idx, bucket, m_tok - b_tok AS extra_tokens FROM pairs",
)
def _(spark, sf):
    return _pairs(spark, sf).select(
        "problem_id",
        "sample_idx",
        ev.bucket(F.col("correct"), F.col("m_correct")).alias("bucket"),
        (F.col("m_completion_tokens") - F.col("completion_tokens")).alias("extra_tokens"),
    )


@query(
    "jn2_missed_samples",
    with_(BASE_SQL, METHOD_SQL)
    + """SELECT b.model, b.dataset, count(m.sample_idx) AS found, count(*) - count(m.sample_idx) AS missed
  FROM base b LEFT JOIN meth m USING (problem_id, sample_idx) GROUP BY b.model, b.dataset""",
)
def _(spark, sf):
    keys = method_runs(spark, sf).select("problem_id", "sample_idx", F.lit(1).alias("hit"))
    joined = baseline_runs(spark, sf).join(keys, ["problem_id", "sample_idx"], "left")
    return joined.groupBy(*CELL).agg(
        F.count("hit").alias("found"), (F.count(F.lit(1)) - F.count("hit")).alias("missed")
    )


@query(
    "jn6_code_grading_tasks",
    """SELECT CASE WHEN l_returnflag = 'R' THEN 'no_code' WHEN p_partkey IS NULL OR p_size < 10 THEN 'no_tests' ELSE 'to_grade' END AS task,
     count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 6 <> 0) p ON CAST(l_partkey AS VARCHAR) = CAST(p_partkey AS VARCHAR)
     GROUP BY 1""",
)
def _(spark, sf):
    cases = table(spark, sf, "part").where("p_partkey % 6 <> 0").select(F.col("p_partkey").cast("string").alias("pid"), "p_size")
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("pid"), "l_returnflag")
    task = (
        F.when(F.col("l_returnflag") == "R", "no_code")
        .when(F.col("p_size").isNull() | (F.col("p_size") < 10), "no_tests")
        .otherwise("to_grade")
    )
    return rows.join(cases, "pid", "left").groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "jn7_id_then_question_lookup",
    """WITH preds AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'x' || doc_id END AS pid, text FROM documents),
     qs AS (SELECT text, min_by(quality, l.doc_id) AS quality FROM labels l JOIN documents d USING (doc_id) GROUP BY text)
     SELECT p.doc_id, coalesce(l.quality, qs.quality)::INT AS answer, CASE WHEN l.quality IS NOT NULL THEN 'id' ELSE 'question' END AS matched_by
     FROM preds p LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = p.pid LEFT JOIN qs ON qs.text = p.text
     WHERE coalesce(l.quality, qs.quality) IS NOT NULL""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("question"))
    d = F.col("doc_id").cast("string")
    preds = docs.withColumn("pid", F.when(F.col("doc_id") % 3 == 0, d).otherwise(F.concat(F.lit("x"), d)))
    cases = docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("problem_id"), "question", F.col("quality").alias("answer"), F.col("doc_id").alias("seq")
    )
    return ev.lookup_with_fallback(preds, cases).select("doc_id", "answer", "matched_by")


@query(
    "jn12_pr15_resume_work_list",
    """SELECT c_custkey AS problem_id, k AS sample_idx FROM customer, generate_series(1, 4) g(k)
       EXCEPT SELECT o_custkey, o_orderkey % 4 + 1 FROM orders""",
)
def _(spark, sf):
    problems = table(spark, sf, "customer").select(F.col("c_custkey").alias("problem_id"))
    done = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("problem_id"), (F.col("o_orderkey") % 4 + 1).alias("sample_idx")
    )
    return ev.work_list(problems, done, 4).withColumn("sample_idx", F.col("sample_idx").cast("long"))


@query(
    "st1_so1_common_keys_sorted",
    PAIRED + "SELECT problem_id, sample_idx FROM (SELECT problem_id, sample_idx FROM base INTERSECT SELECT problem_id, sample_idx FROM meth)",
)
def _(spark, sf):
    key = ["problem_id", "sample_idx"]
    return baseline_runs(spark, sf).select(key).intersect(method_runs(spark, sf).select(key)).orderBy(*key)


@query(
    "st3_key_difference",
    with_(BASE_SQL, METHOD_SQL)
    + "SELECT problem_id, sample_idx FROM base EXCEPT SELECT problem_id, sample_idx FROM meth WHERE mode <> 'other_mode'",
)
def _(spark, sf):
    key = ["problem_id", "sample_idx"]
    done = method_runs(spark, sf).where("mode <> 'other_mode'")
    return baseline_runs(spark, sf).select(key).join(done.select(key), key, "left_anti").distinct()


@query(
    "sk5_so2_bucket_samples",
    PAIRED
    + """SELECT bucket, problem_id, sample_idx FROM pairs
  QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY problem_id, sample_idx) <= 5""",
)
def _(spark, sf):
    return ev.bucket_samples(_pairs(spark, sf), 5).select("bucket", "problem_id", "sample_idx")


@query("so3_budget_order", with_(BASE_SQL) + "SELECT sample_idx, completion_tokens FROM base ORDER BY completion_tokens DESC, sample_idx")
def _(spark, sf):
    rows = baseline_runs(spark, sf).select("sample_idx", "completion_tokens")
    return rows.orderBy(F.col("completion_tokens").desc(), "sample_idx")


@query(
    "so4_first_two_per_problem",
    with_(BASE_SQL)
    + "SELECT problem_id, sample_idx FROM base QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY sample_idx) <= 2",
)
def _(spark, sf):
    top = top_per_group(baseline_runs(spark, sf), ["problem_id"], [F.col("sample_idx")], 2)
    return top.select("problem_id", "sample_idx")


@query(
    "ag12_pass_at_k",
    """SELECT l_orderkey AS problem_id, count(*) FILTER (WHERE l_quantity > 45) AS n_right, count(*) FILTER (WHERE l_quantity <= 45) AS n_wrong,
       count(*) AS total, max(l_quantity) > 45 AS any_ok FROM lineitem GROUP BY l_orderkey""",
)
def _(spark, sf):
    graded = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("problem_id"), (F.col("l_quantity") > 45).alias("ok"))
    return ev.pass_at_k(graded)


@query(
    "ag12_pass_totals",
    """SELECT count(*) AS tested, count(*) FILTER (WHERE r > 0) AS passed, sum(r)::BIGINT AS total_correct, sum(n - r)::BIGINT AS total_wrong
       FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 45) AS r FROM lineitem GROUP BY 1)""",
)
def _(spark, sf):
    graded = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("problem_id"), (F.col("l_quantity") > 45).alias("ok"))
    return ev.pass_at_k(graded).agg(
        F.count(F.lit(1)).alias("tested"),
        F.count(F.when(F.col("any_ok"), 1)).alias("passed"),
        F.sum("n_right").alias("total_correct"),
        F.sum("n_wrong").alias("total_wrong"),
    )


@query(
    "up3_merge_code_grades",
    """SELECT l_returnflag, CASE WHEN p_partkey IS NULL THEN CASE WHEN l_linestatus = 'O' THEN 'kept' ELSE 'not_graded' END
        WHEN p_size > 25 THEN 'ok' ELSE 'exit_' || p_size END AS grader_reason,
        coalesce(p_size > 25, false) AS correct, count(*) AS n
       FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) ON l_partkey = p_partkey GROUP BY ALL""",
)
def _(spark, sf):
    grades = table(spark, sf, "part").where("p_partkey % 4 <> 0").select(
        F.col("p_partkey").alias("row_id"),
        (F.col("p_size") > 25).alias("ok"),
        F.when(F.col("p_size") > 25, "ok").otherwise(F.concat(F.lit("exit_"), F.col("p_size").cast("string"))).alias("reason"),
    )
    samples = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("row_id"), "l_returnflag", F.when(F.col("l_linestatus") == "O", "kept").alias("grader_reason")
    )
    merged = ev.merge_code_grades(samples, grades, "row_id")
    return merged.groupBy("l_returnflag", "grader_reason", "correct").agg(F.count(F.lit(1)).alias("n"))


MODE_SQL = """
rec AS (SELECT o_orderkey, o_orderkey % 13 <> 0 AS closed, CAST(floor(o_totalprice) AS BIGINT) % 140000 AS ext,
          CAST(floor(o_totalprice * 3) AS BIGINT) % 130000 AS cont, o_orderkey % 6 AS nf,
          CASE WHEN o_orderkey % 3 = 0 THEN 'length' ELSE 'stop' END AS fin, o_orderkey % 5 < 3 AS cclosed, o_orderkey % 8 > 0 AS ans FROM orders)
"""


def _mode_inputs(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        (k % 13 != 0).alias("closed"),
        (F.floor(p) % 140000).alias("ext"),
        (F.floor(p * 3) % 130000).alias("cont"),
        (k % 6).alias("nf"),
        F.when(k % 3 == 0, "length").otherwise("stop").alias("fin"),
        (k % 5 < 3).alias("cclosed"),
        (k % 8 > 0).alias("ans"),
    )


def _mode(ablation):
    c = F.col
    return ev.classify_mode(c("closed"), c("ext"), c("cont"), c("nf"), c("fin"), c("cclosed"), c("ans"), 131072, ablation)


@query(
    "up4_replay_modes",
    with_(MODE_SQL)
    + """SELECT CASE WHEN NOT closed THEN 'baseline_fallback_no_close' WHEN ext > 130048 THEN 'extract_overflow_fallback'
        WHEN cont > 100972 THEN 'ctx_overflow_fallback' WHEN nf = 0 THEN 'no_findings_fallback'
        WHEN fin = 'length' AND NOT cclosed THEN 'continuation_length_fallback' WHEN NOT ans THEN 'no_answer_fallback' ELSE 'methodb' END AS mode,
        CASE WHEN NOT closed THEN 'baseline_fallback_no_close' WHEN cont > 100972 THEN 'ctx_overflow_fallback'
        WHEN fin = 'length' AND NOT cclosed THEN 'continuation_length_fallback' WHEN NOT ans THEN 'no_answer_fallback' ELSE 'verify_only' END AS verify_mode,
        count(*) AS n FROM rec GROUP BY 1, 2""",
)
def _(spark, sf):
    return (
        _mode_inputs(spark, sf)
        .groupBy(_mode("none").alias("mode"), _mode("verify_only").alias("verify_mode"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "up5_multi_turn_commit",
    """WITH t AS (SELECT o_orderkey k, (o_orderkey % 11 <> 0 AND o_orderkey % 5 > 0 AND o_orderkey % 3 < 2 AND o_orderkey % 7 > 0) AS a,
         (o_orderkey % 9 <> 0 AND o_orderkey % 4 > 0 AND o_orderkey % 3 < 2) AS b, (o_orderkey % 2 = 0 AND o_orderkey % 13 > 2) AS c FROM orders),
       f AS (SELECT k, CASE WHEN NOT a THEN 0 WHEN NOT b THEN 1 WHEN NOT c THEN 2 ELSE 3 END AS committed FROM t)
     SELECT k AS o_orderkey, committed::BIGINT AS committed,
       ((CASE WHEN committed > 0 THEN k % 100 ELSE 0 END) + (CASE WHEN committed > 1 THEN k % 200 ELSE 0 END) + (CASE WHEN committed > 2 THEN k % 300 ELSE 0 END))::BIGINT AS tokens,
       ((CASE WHEN committed > 0 THEN k % 5 ELSE 0 END) + (CASE WHEN committed > 1 THEN k % 4 ELSE 0 END) + (CASE WHEN committed > 2 THEN k % 13 - 2 ELSE 0 END))::BIGINT AS findings,
       1 + committed::BIGINT AS num_steps FROM f""",
)
def _(spark, sf):
    k = F.col("o_orderkey")

    def turn(fits, nf, closed, ans, tok):
        return F.struct(fits.alias("fits"), nf.alias("n_findings"), closed.alias("closed"), ans.alias("has_answer"), tok.alias("tokens"))

    yes = F.lit(True)
    turns = F.array(
        turn(k % 11 != 0, k % 5, k % 3 < 2, k % 7 > 0, k % 100),
        turn(k % 9 != 0, k % 4, k % 3 < 2, yes, k % 200),
        turn(k % 2 == 0, k % 13 - 2, yes, yes, k % 300),
    )
    out = table(spark, sf, "orders").select("o_orderkey", ev.commit_turns(turns).alias("f"))
    _, steps = ev.record_totals(F.lit(0), F.col("f.tokens"), F.col("f.committed"))
    return out.select("o_orderkey", "f.committed", "f.tokens", "f.findings", steps.alias("num_steps"))


@query(
    "up6_record_totals",
    with_(BASE_SQL, METHOD_SQL)
    + "SELECT sample_idx, baseline_tokens + continuation_tokens AS completion_tokens, 1 + turns_committed AS num_steps FROM meth",
)
def _(spark, sf):
    total, steps = ev.record_totals(F.col("baseline_tokens"), F.col("continuation_tokens"), F.col("turns_committed"))
    return method_runs(spark, sf).select("sample_idx", total.alias("completion_tokens"), steps.alias("num_steps"))


@query(
    "au1_7_jn3_record_audit",
    with_(BASE_SQL, METHOD_SQL)
    + """, j AS (SELECT m.*, b.completion_tokens AS bt, b.sample_idx AS bs FROM meth m
       LEFT JOIN (SELECT * FROM base WHERE sample_idx % 10 <> 3) b USING (problem_id, sample_idx))
  SELECT model, dataset, u."check", sum(u.bad::INT)::BIGINT AS n_bad FROM (
    SELECT model, dataset, unnest([
     {'check': 'tokens_not_positive', 'bad': completion_tokens <= 0 AND mode <> 'baseline_fallback_no_close'},
     {'check': 'token_sum', 'bad': baseline_tokens + continuation_tokens <> completion_tokens},
     {'check': 'unknown_mode', 'bad': mode = 'other_mode'},
     {'check': 'methodb_correct', 'bad': dataset <> 'livecodebench' AND coalesce(methodb_correct <> correct, false)},
     {'check': 'num_findings', 'bad': num_findings <> listed_findings},
     {'check': 'baseline_missing', 'bad': bs IS NULL},
     {'check': 'baseline_tokens', 'bad': coalesce(bt <> baseline_tokens, false)},
     {'check': 'grade_mismatch', 'bad': dataset <> 'livecodebench' AND (predicted_answer IS NOT NULL AND predicted_answer = CAST(problem_id % 7 AS VARCHAR)) <> correct}]) AS u FROM j)
  GROUP BY ALL""",
)
def _(spark, sf):
    from gradelake.functions.extract import grade_integer

    base = baseline_runs(spark, sf).where("sample_idx % 10 <> 3")
    verdict = grade_integer(F.col("predicted_answer"), (F.col("problem_id") % 7).cast("string"))
    kind = F.when(F.col("dataset") == "livecodebench", "code").otherwise("integer")
    return audit.audit_records(method_runs(spark, sf), base, CELL, verdict, kind=kind)


LINES_SQL = """
stats AS (SELECT model, dataset, count(*) AS n, count(*) FILTER (WHERE correct) AS nc, avg(completion_tokens) AS at,
            max(completion_tokens) AS mt FROM base GROUP BY ALL)
"""


def _summary_lines(spark, sf):
    """Two recorded lines per cell (the older one outdated, the newer one off in some cells) and short lines."""
    s = ev.cell_summary(baseline_runs(spark, sf), CELL)
    vals = s.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    off = (F.col("version") == 1) | ((F.col("model") == "m1") & (F.col("dataset") == "gpqa"))
    n = F.col("n") + off.cast("int")
    line = F.concat_ws(
        ",", "model", "dataset", F.lit("baseline"), n, "n_correct", F.round("acc", 3), F.round("avg_tok", 1),
        F.col("max_tok") + ((F.col("model") == "m2") & (F.col("dataset") == "hmmt")).cast("int"), F.lit("1.00"), F.lit("outputs/x"),
    )
    short = F.concat_ws(",", "model", "dataset", F.lit("broken"))
    return vals.select(F.col("version").alias("seq"), F.when(F.col("version") == 3, short).otherwise(line).alias("value"))


@query(
    "au8_jn11_summary_audit",
    with_(BASE_SQL, LINES_SQL)
    + """SELECT model, dataset, 'n' AS issue FROM stats WHERE model = 'm1' AND dataset = 'gpqa'
         UNION ALL SELECT model, dataset, 'max_tok' FROM stats WHERE model = 'm2' AND dataset = 'hmmt'""",
)
def _(spark, sf):
    recorded, _ = audit.last_summary_lines(_summary_lines(spark, sf))
    return audit.audit_summary(recorded, ev.cell_summary(baseline_runs(spark, sf), CELL), CELL)


@query(
    "sc9_summary_lines_last_wins",
    with_(BASE_SQL, LINES_SQL)
    + """SELECT model, dataset, n + CASE WHEN model = 'm1' AND dataset = 'gpqa' THEN 1 ELSE 0 END AS n, nc AS n_correct FROM stats""",
)
def _(spark, sf):
    recorded, _ = audit.last_summary_lines(_summary_lines(spark, sf))
    return recorded.select("model", "dataset", "n", "n_correct")


@query(
    "au9_sc10_log_hits",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
     m AS (SELECT 'log' || (doc_id % 20) AS file, doc_id * 100000 + line_no AS line_no,
        CASE WHEN line_no % 5 = 0 THEN 'ERROR ' || value WHEN line_no % 7 = 0 THEN 'Traceback (most recent call last)' WHEN line_no % 3 = 0 THEN 'job Killed' ELSE 'TERRORS ' || value END AS value FROM l),
     h AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS hit FROM m
       WHERE regexp_matches(value, 'Traceback \\(most recent call last\\)|\\bERROR\\b|(?i:CUDA out of memory)|Killed$'))
     SELECT file, line_no, hit::INT AS hit, CASE WHEN length(trim(value)) > 160 THEN left(trim(value), 160) || '…' ELSE trim(value) END AS snippet FROM h WHERE hit <= 2""",
)
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "value"))
    n = F.col("p") + 1
    value = (
        F.when(n % 5 == 0, F.concat(F.lit("ERROR "), "value"))
        .when(n % 7 == 0, "Traceback (most recent call last)")
        .when(n % 3 == 0, "job Killed")
        .otherwise(F.concat(F.lit("TERRORS "), "value"))
    )
    rows = lines.select(
        F.concat(F.lit("log"), (F.col("doc_id") % 20).cast("string")).alias("file"),
        (F.col("doc_id") * 100000 + n).alias("line_no"),
        value.alias("value"),
    )
    return audit.scan_logs(rows, "file", "line_no")


@query(
    "au10_expected_counts",
    with_(BASE_SQL)
    + """, c AS (SELECT model, dataset, count(*) AS n FROM base GROUP BY ALL), p AS (SELECT dataset, count(DISTINCT problem_id) AS problems FROM base WHERE dataset <> 'gpqa' GROUP BY 1)
  SELECT model, dataset, n, problems * 16 AS expected FROM c JOIN p USING (dataset) WHERE n <> problems * 16""",
)
def _(spark, sf):
    b = baseline_runs(spark, sf)
    counts = b.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    expected = b.where("dataset <> 'gpqa'").groupBy("dataset").agg(F.countDistinct("problem_id").alias("problems"))
    return audit.count_check(counts, expected, 16, ["dataset"]).select("model", "dataset", "n", "expected")


@query(
    "au11_missing_cells",
    with_(BASE_SQL)
    + """SELECT m AS model, d AS dataset, x AS method FROM (VALUES ('m0'),('m1'),('m2'),('m3')) a(m), (VALUES ('aime'),('gpqa'),('hmmt')) b(d), (VALUES ('baseline'),('verify_only')) c(x)
   EXCEPT SELECT model, dataset, 'baseline' FROM base WHERE NOT (model = 'm1' AND dataset = 'hmmt')""",
)
def _(spark, sf):
    have = baseline_runs(spark, sf).where("not (model = 'm1' and dataset = 'hmmt')").withColumn("method", F.lit("baseline"))
    return audit.missing_cells(have, ["m0", "m1", "m2", "m3"], ["aime", "gpqa", "hmmt"], ["baseline", "verify_only"])
