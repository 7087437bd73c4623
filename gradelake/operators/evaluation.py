"""Cell summaries, method comparison, repair, regrade and mode classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.extract import extract_answer
from gradelake.functions.think import strip_thinking
from gradelake.operators.groups import join_skewed, last_wins, top_per_group

KEY = ["problem_id", "sample_idx"]
CELL = ["model", "dataset", "method"]
# Modes of a committed attempt, and every mode an audit knows.
COMMITTED_MODES = ["methodb", "verify_only"]
KNOWN_MODES = [
    "baseline_fallback_no_close",
    "extract_overflow_fallback",
    "ctx_overflow_fallback",
    "no_findings_fallback",
    "continuation_length_fallback",
    "methodb",
    "verify_only",
    "pending",
]
# Token budgets of the recorded runs.
EXTRACT_RESERVE = 1024
CONTINUATION_TOKENS = 30000
CONTEXT_MARGIN = 100


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def cell_summary(records: DataFrame, cell: Sequence[str] = tuple(CELL)) -> DataFrame:
    """n, correct, accuracy, mean/max tokens and mean steps per cell; empty cells have no row."""
    tokens = F.coalesce(F.col("completion_tokens"), F.lit(0))
    return records.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"),
        _count_if(F.col("correct")).alias("n_correct"),
        F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("double")).alias("acc"),
        F.avg(tokens.cast("double")).alias("avg_tok"),
        F.max(tokens).alias("max_tok"),
        F.avg(F.coalesce(F.col("num_steps"), F.lit(1)).cast("double")).alias("avg_steps"),
    )


def join_pairs(base: DataFrame, method: DataFrame, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Inner join of two runs on the sample key; the method's columns get an ``m_`` prefix."""
    right = method.select(*key, *[F.col(c).alias(f"m_{c}") for c in method.columns if c not in key])
    return base.join(right, list(key), "inner")


def bucket(base_ok: Column, method_ok: Column) -> Column:
    first = F.when(F.coalesce(base_ok, F.lit(False)), "C").otherwise("W")
    second = F.when(F.coalesce(method_ok, F.lit(False)), "C").otherwise("W")
    return F.concat(first, second)


def transition_matrix(pairs: DataFrame, cell: Sequence[str]) -> DataFrame:
    """CC/CW/WC/WW counts and shares, accuracies, and their difference, per cell."""
    tagged = pairs.withColumn("b", bucket(F.col("correct"), F.col("m_correct")))
    counts = tagged.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"),
        *[_count_if(F.col("b") == k).alias(k.lower()) for k in ("CC", "CW", "WC", "WW")],
    )
    return counts.withColumns(
        {
            **{f"{k}_share": F.col(k) / F.col("n") for k in ("cc", "cw", "wc", "ww")},
            "base_correct": F.col("cc") + F.col("cw"),
            "method_correct": F.col("cc") + F.col("wc"),
            "delta": F.col("wc") - F.col("cw"),
            "delta_share": (F.col("wc") - F.col("cw")) / F.col("n"),
        }
    )


def token_averages(pairs: DataFrame, cell: Sequence[str], triggered_mode: str = "methodb") -> DataFrame:
    """Mean tokens of both runs; the *per-triggered* means divide all rows' sums by the triggered count,
    and the ``*_filtered`` columns restrict the sums to triggered rows as well."""
    hit = F.col("m_mode") == triggered_mode
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    agg = pairs.groupBy(*cell).agg(
        F.avg(zero("completion_tokens").cast("double")).alias("avg_base_tok"),
        F.avg(zero("m_completion_tokens").cast("double")).alias("avg_method_tok"),
        _count_if(hit).alias("triggered"),
        F.sum(zero("m_continuation_tokens")).alias("cont"),
        F.sum(zero("m_num_findings")).alias("found"),
        F.sum(F.when(hit, zero("m_continuation_tokens"))).alias("cont_hit"),
        F.sum(F.when(hit, zero("m_num_findings"))).alias("found_hit"),
    )
    per = lambda c: F.col(c) / F.nullif(F.col("triggered"), F.lit(0))
    return agg.select(
        *cell,
        "avg_base_tok",
        "avg_method_tok",
        (F.col("avg_method_tok") - F.col("avg_base_tok")).alias("avg_diff_tok"),
        "triggered",
        per("cont").alias("avg_continuation"),
        per("found").alias("avg_findings"),
        per("cont_hit").alias("avg_continuation_filtered"),
        per("found_hit").alias("avg_findings_filtered"),
    )


def bucket_samples(pairs: DataFrame, n: int, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """First ``n`` keys of each transition bucket in key order."""
    tagged = pairs.withColumn("bucket", bucket(F.col("correct"), F.col("m_correct")))
    return top_per_group(tagged, ["bucket"], [F.col(k) for k in key], n)


def repair(method: DataFrame, base: DataFrame, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Fall back to the baseline answer where a committed attempt gave none.

    ``base`` must hold one row per key. Adds ``no_answer_repair`` and ``repair_state``.
    """
    probe = base.select(
        *key,
        F.col("predicted_answer").alias("_b_pred"),
        F.coalesce("correct", F.lit(False)).alias("_b_correct"),
        F.lit(True).alias("_b_seen"),
    )
    joined = method.join(probe, list(key), "left")
    no_answer = F.col("predicted_answer").isNull()
    committed = F.coalesce(F.col("mode"), F.lit("")).isin(COMMITTED_MODES)
    state = (
        F.when(~no_answer, "has_answer")
        .when(~committed, "skipped_fallback")
        .when(F.col("_b_seen").isNull(), "baseline_missing")
        .when(F.col("_b_pred").isNull(), "baseline_also_none")
        .otherwise("repaired")
    )
    fixed = F.col("repair_state") == "repaired"
    out = joined.withColumns({"repair_state": state, "old_correct": F.coalesce("correct", F.lit(False))})
    changes = {
        "predicted_answer": F.when(fixed, F.col("_b_pred")).otherwise(F.col("predicted_answer")),
        "correct": F.when(fixed, F.col("_b_correct")).otherwise(F.col("correct")),
        "mode": F.when(fixed, F.concat("mode", F.lit("_no_answer_fallback"))).otherwise(F.col("mode")),
        "no_answer_repair": F.when(fixed, F.lit(True)),
    }
    if "methodb_correct" in method.columns:
        changes["methodb_correct"] = F.when(fixed & F.col("methodb_correct").isNotNull(), F.col("_b_correct")).otherwise(
            F.col("methodb_correct")
        )
    return out.withColumns(changes).drop("_b_pred", "_b_correct", "_b_seen")


def repair_counters(repaired: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Counters per cell and, with NULL cell columns, the grand total."""
    state = F.col("repair_state")
    return repaired.rollup(*cell).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        _count_if(state.isin("baseline_missing", "baseline_also_none", "repaired")).alias("none_to_fix"),
        _count_if(state == "repaired").alias("repaired"),
        _count_if(state == "baseline_also_none").alias("baseline_also_none"),
        _count_if(state == "skipped_fallback").alias("skipped_fallback"),
        _count_if((state == "repaired") & F.col("correct") & ~F.col("old_correct")).alias("new_correct"),
    ).where(F.col("level").isin(0, (1 << len(cell)) - 1))


def regrade(records: DataFrame, kind: Column, grade) -> DataFrame:
    """Re-extract and re-grade stored responses; code cells are left to the external grader.

    ``grade(kind, predicted, gold)`` is a Column function; a pair that it cannot read (NULL) keeps its verdict and is
    marked ``unread``. ``methodb_correct`` follows ``correct`` where it was set. Keeps ``old_*`` columns for counting.
    """
    fresh = extract_answer(kind, strip_thinking(F.col("response")))
    rows = records.where(kind.isin("integer", "letter", "latex")).withColumns(
        {"old_predicted": F.col("predicted_answer"), "old_correct": F.coalesce("correct", F.lit(False))}
    )
    graded = rows.withColumn("predicted_answer", fresh).withColumn("_verdict", grade(kind, F.col("predicted_answer"), F.col("gt_answer")))
    changes = {"unread": F.col("_verdict").isNull(), "correct": F.coalesce("_verdict", "old_correct")}
    if "methodb_correct" in records.columns:
        changes["methodb_correct"] = F.when(F.col("methodb_correct").isNotNull(), F.coalesce("_verdict", "old_correct"))
    return graded.withColumns(changes).drop("_verdict")


def regrade_counters(regraded: DataFrame, cell: Sequence[str]) -> DataFrame:
    moved = ~F.col("old_predicted").eqNullSafe(F.col("predicted_answer"))
    off = F.col("methodb_correct") != F.col("correct") if "methodb_correct" in regraded.columns else F.lit(False)
    return regraded.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"),
        _count_if(moved).alias("changed"),
        _count_if(F.col("old_correct") != F.col("correct")).alias("flipped"),
        _count_if(~F.col("old_correct") & F.col("correct")).alias("new_right"),
        _count_if(F.col("old_correct") & ~F.col("correct")).alias("new_wrong"),
        _count_if(F.col("unread")).alias("unread"),
        _count_if(off).alias("methodb_off"),
    )


def merge_code_grades(samples: DataFrame, grades: DataFrame, row_id: str) -> DataFrame:
    """Attach external verdicts; ungraded rows become false with reason ``not_graded`` if none was set."""
    g = grades.select(row_id, F.col("ok").alias("_ok"), F.col("reason").alias("_reason"))
    out = samples.join(g, row_id, "left")
    return out.withColumns(
        {
            "correct": F.coalesce("_ok", F.lit(False)),
            "grader_reason": F.when(F.col("_ok").isNotNull(), F.col("_reason")).otherwise(
                F.coalesce("grader_reason", F.lit("not_graded"))
            ),
        }
    ).drop("_ok", "_reason")


def classify_mode(
    closed: Column,
    extract_prompt_tokens: Column,
    continue_prompt_tokens: Column,
    n_findings: Column,
    finish: Column,
    continuation_closed: Column,
    has_answer: Column,
    max_model_len: int,
    ablation: str = "none",
) -> Column:
    """Final mode of a replayed sample from what was recorded about it."""
    if ablation not in ("none", "verify_only"):
        raise ValueError(f"unknown ablation {ablation!r}")
    verify = ablation == "verify_only"
    mode = F.when(~closed, "baseline_fallback_no_close")
    if not verify:
        mode = mode.when(extract_prompt_tokens > max_model_len - EXTRACT_RESERVE, "extract_overflow_fallback")
    mode = mode.when(
        continue_prompt_tokens + CONTINUATION_TOKENS + CONTEXT_MARGIN > max_model_len, "ctx_overflow_fallback"
    )
    if not verify:
        mode = mode.when(n_findings == 0, "no_findings_fallback")
    return (
        mode.when((finish == "length") & ~continuation_closed, "continuation_length_fallback")
        .when(~has_answer, "no_answer_fallback")
        .otherwise("verify_only" if verify else "methodb")
    )


def commit_turns(turns: Column) -> Column:
    """Fold an ordered array of turn structs into (turns_committed, tokens, findings).

    Turn fields: ``fits, n_findings, closed, has_answer, tokens``. A later turn counts only if every
    earlier one was committed.
    """
    start = F.struct(
        F.lit(0).cast("long").alias("committed"),
        F.lit(0).cast("long").alias("tokens"),
        F.lit(0).cast("long").alias("findings"),
        F.lit(True).alias("open"),
    )

    def step(acc, t):
        ok = acc["open"] & t["fits"] & (t["n_findings"] > 0) & t["closed"] & t["has_answer"]
        add = F.when(ok, F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.struct(
            (acc["committed"] + add).alias("committed"),
            (acc["tokens"] + add * t["tokens"]).alias("tokens"),
            (acc["findings"] + add * t["n_findings"]).alias("findings"),
            ok.alias("open"),
        )

    return F.aggregate(turns, start, step)


def record_totals(baseline_tokens: Column, continuation_tokens: Column, turns_committed: Column) -> tuple[Column, Column]:
    """(completion_tokens, num_steps) of a replayed record."""
    return baseline_tokens + continuation_tokens, 1 + turns_committed


def pass_at_k(graded: DataFrame, problem: str = "problem_id") -> DataFrame:
    """Per problem: right, wrong, total and whether any candidate passed."""
    return graded.groupBy(problem).agg(
        _count_if(F.col("ok")).alias("n_right"),
        _count_if(~F.col("ok")).alias("n_wrong"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.bool_or("ok"), F.lit(False)).alias("any_ok"),
    )


BITS = 64


def done_bits(done: DataFrame, samples: int, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """One row per problem: ``done``, the set of its samples 1 .. ``samples`` as bits of ceil(samples / 64) integers.

    The bits of a problem are combined before the shuffle; repeated samples change nothing, others and nulls are ignored.
    """
    at = F.col(key[1]).cast("long") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(BITS)).cast("int"))
    words = [F.bit_or(F.when((at >= w * BITS) & (at < min(samples, (w + 1) * BITS)), bit)) for w in range(-(-samples // BITS))]
    return done.groupBy(key[0]).agg(F.array(*[F.coalesce(w, F.lit(0).cast("long")) for w in words]).alias("done"))


def work_list(problems: DataFrame, done: DataFrame, samples: int, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Every (problem, sample) still to run: the complement of the problem's done bits, one row per problem until then."""
    if samples < 1:
        raise ValueError("samples must be at least 1")
    bits = done_bits(done, samples, key).withColumnsRenamed({key[0]: "_problem", "done": "_done"})
    open_ = F.filter(
        F.sequence(F.lit(1), F.lit(samples)),
        lambda s: F.coalesce(F.getbit(F.get("_done", F.floor((s - 1) / BITS).cast("int")), (s - 1) % BITS), F.lit(0)) == 0,
    )
    left = problems.join(bits, problems[key[0]] == bits["_problem"], "left")
    return left.withColumn(key[1], F.explode(open_)).drop("_problem", "_done")


def lookup_with_fallback(preds: DataFrame, dataset: DataFrame) -> DataFrame:
    """Match predictions by id, then the rest by exact question text (lowest ``seq`` wins)."""
    by_id = preds.join(dataset.select(F.col("problem_id").cast("string").alias("pid"), "answer"), "pid", "left")
    found = by_id.where(F.col("answer").isNotNull()).withColumn("matched_by", F.lit("id"))
    rest = by_id.where(F.col("answer").isNull()).drop("answer")
    questions = dataset.where(F.length("question") > 0).groupBy("question").agg(F.min_by("answer", "seq").alias("answer"))
    asked = rest.groupBy("question").agg(F.count(F.lit(1)).alias("_n"))
    by_text = join_skewed(rest, questions.join(asked, "question"), ["question"], "_n", sizes=asked).drop("_n")
    by_text = by_text.withColumn("matched_by", F.lit("question"))
    return found.unionByName(by_text)


def duplicate_keys(records: DataFrame, key: Sequence[str]) -> DataFrame:
    return records.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


