"""Whole jobs over folders of recorded runs, and their commands.

A run is a folder ``<model>__<dataset>__<suffix>`` of JSON-lines files below a root. Every job is one function from paths
to a DataFrame; ``python -m gradelake.jobs <job> ...`` shows that table and, for ``audit``, ends with status 1 if there
are issues.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake import schemas
from gradelake.functions.extract import ANSWER_KINDS
from gradelake.functions.latex import grade_any
from gradelake.operators import audit as checks
from gradelake.operators import evaluation as ev
from gradelake.operators.groups import last_wins
from gradelake.session import build_session
from gradelake.sources import readers, sinks

CELL = ["model", "dataset", "suffix"]
KEY = [*CELL, "problem_id", "sample_idx"]
GLOB = "*.jsonl"
ISSUES = ["check", *CELL, "place", "n_bad"]


def answer_kind(dataset: Column) -> Column:
    """Answer kind by dataset; NULL for a dataset that is not known."""
    return F.create_map(*[F.lit(x) for pair in ANSWER_KINDS.items() for x in pair])[dataset]


def _lines(spark: SparkSession, root: str, ddl: str = schemas.REPLAY) -> DataFrame:
    return readers.with_cell_columns(readers.read_jsonl_marked(spark, root, ddl, GLOB))


def records(spark: SparkSession, root: str) -> DataFrame:
    """The readable records of all runs below ``root``, the last line of a key winning."""
    good = _lines(spark, root).where(~F.col("parse_error"))
    return last_wins(good, KEY, readers.LINE_ORDER).drop("parse_error", "value", *readers.LINE_ORDER)


def summaries(spark: SparkSession, root: str) -> DataFrame:
    return ev.cell_summary(records(spark, root), CELL)


def compare(spark: SparkSession, base: str, method: str) -> DataFrame:
    """Transitions and token averages per (model, dataset) between the runs below two roots."""
    cell = ["model", "dataset"]
    pairs = ev.join_pairs(records(spark, base).drop("suffix"), records(spark, method).drop("suffix"), [*cell, "problem_id", "sample_idx"])
    return ev.transition_matrix(pairs, cell).join(ev.token_averages(pairs, cell), cell)


def regrade(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Grade stored responses anew, write all runs to ``out`` (one folder a run) and count the changes."""
    all_rows = records(spark, root)
    graded = ev.regrade(all_rows, answer_kind(F.col("dataset")), grade_any)
    kept = all_rows.where(~F.coalesce(answer_kind(F.col("dataset")).isin("integer", "letter", "latex"), F.lit(False)))
    _write_runs(graded.select(*all_rows.columns).unionByName(kept), out)
    return ev.regrade_counters(graded, CELL)


def repair(spark: SparkSession, base: str, method: str, out: str) -> DataFrame:
    """Fall back to baseline answers where a committed attempt gave none, write the runs and count."""
    runs = records(spark, method)
    cell = ["model", "dataset", "problem_id", "sample_idx"]
    probe = records(spark, base).dropDuplicates(cell)
    fixed = ev.repair(runs, probe.select(*cell, "predicted_answer", "correct"), cell)
    _write_runs(fixed.select(*runs.columns), out)
    return ev.repair_counters(fixed, CELL)


def _write_runs(rows: DataFrame, out: str) -> None:
    """One folder per run, named as it was; ``__`` joins the names, so the folders can be read back."""
    run = F.concat_ws("__", *[F.coalesce(c, F.lit("unknown")) for c in CELL])
    rows.withColumn("run", run).drop(*CELL).write.mode("errorifexists").partitionBy("run").json(out)


def audit(spark: SparkSession, root: str, base: str | None = None, summary: str | None = None, logs: str | None = None) -> DataFrame:
    """Every issue as (check, model, dataset, suffix, place, n_bad); an empty table means that all is well."""
    lines = _lines(spark, root)
    raw = checks.audit_raw_lines(lines.select("value", *CELL, "file"), [*CELL, "file"]).withColumnRenamed("file", "place")
    rows = records(spark, root)
    kind = answer_kind(F.col("dataset"))
    nowhere = F.lit(None).cast("string").alias("place")
    parts = [raw.select(*ISSUES)]
    doubled = lines.where(~F.col("parse_error")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts.append(doubled.groupBy(*CELL).agg(F.sum(F.col("n") - 1).alias("n_bad")).select(F.lit("repeated_key").alias("check"), *CELL, nowhere, "n_bad"))
    if base is not None:
        key = ["model", "dataset", "problem_id", "sample_idx"]
        probe = records(spark, base).select(*key, "completion_tokens").dropDuplicates(key)
        found = checks.audit_records(rows, probe, CELL, key=key, kind=kind)
        parts.append(found.select("check", *CELL, nowhere, "n_bad"))
    if summary is not None:
        last, short = checks.last_summary_lines(readers.read_summary_lines(spark, summary), ["model", "dataset", "method"])
        now = ev.cell_summary(rows, CELL).withColumnRenamed("suffix", "method")
        wrong = checks.audit_summary(last, now, ["model", "dataset", "method"])
        parts.append(wrong.select(F.concat(F.lit("summary_"), "issue").alias("check"), "model", "dataset", F.col("method").alias("suffix"), nowhere, F.lit(1).alias("n_bad")))
        none = [F.lit(None).cast("string").alias(c) for c in CELL]
        parts.append(short.select(F.lit("summary_line").alias("check"), *none, F.col("value").alias("place"), F.lit(1).alias("n_bad")))
    if logs is not None:
        hits = checks.scan_logs(readers.read_lines(spark, logs, "*.log"), "file", "line_id")
        none = [F.lit(None).cast("string").alias(c) for c in CELL]
        parts.append(hits.select(F.lit("log").alias("check"), *none, F.concat_ws(": ", "file", "snippet").alias("place"), F.lit(1).alias("n_bad")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n_bad > 0").withColumn("n_bad", F.col("n_bad").cast("bigint"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m gradelake.jobs", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, paths, options in (
        ("summaries", ["root"], ["out"]),
        ("compare", ["base", "method"], []),
        ("regrade", ["root", "out"], []),
        ("repair", ["base", "method", "out"], []),
        ("audit", ["root"], ["base", "summary", "logs"]),
    ):
        job = jobs.add_parser(name)
        for p in paths:
            job.add_argument(p)
        for o in options:
            job.add_argument(f"--{o}")
    asked = vars(parser.parse_args(argv))
    name = asked.pop("job")
    to = asked.pop("out") if name == "summaries" else None
    spark = spark or build_session(f"gradelake {name}")
    table = globals()[name](spark, **asked)
    if name == "summaries" and to:
        sinks.write_summary(sinks.summary_lines(table.withColumnRenamed("suffix", "method"), F.lit(asked["root"])), to)
    # one row per run or issue of a run; large tables are cut on the screen only
    table.show(200, truncate=False)
    return int(name == "audit" and not table.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
