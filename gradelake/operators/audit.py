"""Consistency checks over stored records, summaries and logs, as (check, n_bad) rows."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import strip
from gradelake.operators.evaluation import KEY, KNOWN_MODES, _count_if
from gradelake.operators.groups import top_per_group

BASE_REQUIRED = ["problem_id", "sample_idx", "correct", "completion_tokens", "predicted_answer", "gt_answer", "response"]
METHOD_REQUIRED = [
    "baseline_tokens", "continuation_tokens", "thinking_tokens", "findings", "mode", "methodb_correct", "baseline_correct",
]
# Log lines worth reporting.
LOG_PATTERNS = [r"Traceback \(most recent call last\)", r"(?U)\bERROR\b", r"(?i)CUDA out of memory", r"Killed$"]


def audit_raw_lines(lines: DataFrame, cell: Sequence[str], required: Sequence[str] = tuple(BASE_REQUIRED)) -> DataFrame:
    """Parse errors, absent fields (an explicit null is present) and non-boolean ``correct``, per cell.

    ``lines`` has one JSON text per row in ``value``.
    """
    keys = F.json_object_keys("value")
    parsed = lines.withColumn("_keys", keys)
    good = F.col("_keys").isNotNull()
    ok_flag = F.coalesce(F.get_json_object("value", "$.correct"), F.lit(""))
    raw_is_string = F.rlike("value", F.lit(r'"correct"\s*:\s*"'))
    checks = {
        "parse_error": _count_if(~good),
        "correct_not_bool": _count_if(good & (~ok_flag.isin("true", "false") | raw_is_string)),
        **{f"missing_{f}": _count_if(good & ~F.array_contains("_keys", f)) for f in required},
    }
    return _unpivot(parsed.groupBy(*cell).agg(*[c.alias(n) for n, c in checks.items()]), cell, list(checks))


def audit_records(
    records: DataFrame,
    base: DataFrame,
    cell: Sequence[str],
    regraded: Column | None = None,
    known_modes: Sequence[str] = tuple(KNOWN_MODES),
    key: Sequence[str] = tuple(KEY),
    kind: Column | None = None,
) -> DataFrame:
    """Row checks of a method run, with the baseline joined once for the cross-checks.

    ``base`` holds one row per key. ``regraded`` is the recomputed verdict where one exists. ``kind`` is the answer
    kind of a row: verdicts of ``code`` rows are set later by an external grader and are not compared.
    """
    probe = base.select(*key, F.col("completion_tokens").alias("_base_tok"), F.lit(True).alias("_seen"))
    joined = records.join(probe, list(key), "left")
    nz = lambda c: F.coalesce(F.col(c), F.lit(0))
    correct = F.coalesce("correct", F.lit(False))
    ours = F.lit(True) if kind is None else ~kind.eqNullSafe(F.lit("code"))
    checks = {
        "tokens_not_positive": _count_if(
            (nz("completion_tokens") <= 0) & ~F.coalesce(F.col("mode") == "baseline_fallback_no_close", F.lit(False))
        ),
        "token_sum": _count_if(nz("baseline_tokens") + nz("continuation_tokens") != nz("completion_tokens")),
        "unknown_mode": _count_if(~F.coalesce(F.col("mode").isin(list(known_modes)), F.lit(False))),
        "methodb_correct": _count_if(ours & F.col("methodb_correct").isNotNull() & (F.col("methodb_correct") != correct)),
        "num_findings": _count_if(F.col("num_findings") != F.size("findings")),
        "baseline_missing": _count_if(F.col("_seen").isNull()),
        "baseline_tokens": _count_if(F.col("_seen").isNotNull() & (nz("_base_tok") != nz("baseline_tokens"))),
    }
    if regraded is not None:
        checks["grade_mismatch"] = _count_if(ours & (regraded != correct))
    return _unpivot(joined.groupBy(*cell).agg(*[c.alias(n) for n, c in checks.items()]), cell, list(checks))


def _unpivot(wide: DataFrame, cell: Sequence[str], names: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(cell), list(names), "check", "n_bad")


def last_summary_lines(lines: DataFrame, key: Sequence[str] = ("model", "dataset")) -> tuple[DataFrame, DataFrame]:
    """Split headerless summary lines into (last entry per cell, malformed lines).

    ``lines`` has ``seq`` (file order) and ``value``.
    """
    names = ["model", "dataset", "method", "n", "n_correct", "acc", "avg_tok", "max_tok", "avg_steps", "out_dir"]
    parts = lines.withColumn("_f", F.split("value", ","))
    short = F.size("_f") < len(names)
    typed = parts.where(~short).select("seq", *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    typed = typed.withColumns(
        {c: F.col(c).cast("long") for c in ("n", "n_correct")}
        | {c: F.col(c).cast("double") for c in ("acc", "avg_tok", "max_tok", "avg_steps")}
    )
    last = top_per_group(typed, list(key), [F.col("seq").desc()], 1, "_rank").drop("_rank", "seq")
    return last, parts.where(short).select("seq", "value")


def audit_summary(recorded: DataFrame, recomputed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Compare recorded summary rows with recomputed ones; one row per disagreeing figure."""
    now = recomputed.select(*key, *[F.col(c).alias(f"now_{c}") for c in ("n", "n_correct", "avg_tok", "max_tok", "avg_steps")])
    both = recorded.join(now, list(key), "left")
    share = F.coalesce(F.col("now_n_correct") / F.nullif(F.col("now_n"), F.lit(0)), F.lit(0.0))
    checks = {
        "jsonl_missing": F.col("now_n").isNull(),
        "n": F.col("n") != F.col("now_n"),
        "n_correct": F.col("n_correct") != F.col("now_n_correct"),
        "acc": F.abs(F.col("acc") - share) > 1e-3,
        "avg_tok": F.abs(F.col("avg_tok") - F.col("now_avg_tok")) > 1.0,
        "max_tok": F.col("max_tok") != F.col("now_max_tok"),
        "avg_steps": F.abs(F.col("avg_steps") - F.col("now_avg_steps")) > 0.01,
    }
    present = F.col("now_n").isNotNull()
    issues = F.array(
        *[F.when(c if n == "jsonl_missing" else present & c, F.lit(n)) for n, c in checks.items()]
    )
    return both.select(*key, F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))


def scan_logs(lines: DataFrame, file_col: str, line_no: str, max_hits: int = 2) -> DataFrame:
    """First ``max_hits`` matching lines per file, cut to 160 characters."""
    match = None
    for p in LOG_PATTERNS:
        hit = F.rlike("value", F.lit(p))
        match = hit if match is None else match | hit
    hits = top_per_group(lines.where(match), [file_col], [F.col(line_no)], max_hits, "hit")
    snippet = strip(F.col("value"))
    cut = F.when(F.length(snippet) > 160, F.concat(F.left(snippet, F.lit(160)), F.lit("…"))).otherwise(snippet)
    return hits.select(file_col, line_no, "hit", cut.alias("snippet"))


def count_check(counts: DataFrame, expected: DataFrame, samples: int, key: Sequence[str]) -> DataFrame:
    """Cells whose row count differs from problems x samples; unknown problem counts are skipped."""
    both = counts.join(expected, list(key), "left").withColumn("expected", F.col("problems") * samples)
    return both.where((F.coalesce("expected", F.lit(0)) > 0) & (F.col("n") != F.col("expected")))


def missing_cells(existing: DataFrame, models: list[str], datasets: list[str], methods: list[str]) -> DataFrame:
    """Cells of the configured grid (three short setting lists) that have no records."""
    cols = ["model", "dataset", "method"]
    grid = existing.sparkSession.createDataFrame(list(itertools.product(models, datasets, methods)), cols)
    return grid.join(existing.select(*cols).distinct(), cols, "left_anti")
