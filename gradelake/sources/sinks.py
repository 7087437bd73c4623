"""Writers for records, snapshots, summaries, dumps and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Indented JSON, one record after another, for reading by eye."""
    pretty = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(pretty.alias("value")).write.mode("overwrite").text(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def rewrite(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Replace ``path`` with ``df``, which may be computed from it: write beside, then swap by rename."""
    spark = df.sparkSession
    beside, before = path.rstrip("/") + "__next", path.rstrip("/") + "__before"
    df.write.mode("overwrite").format(fmt).save(beside)
    target, fs = _fs(spark, path)
    kept, _ = _fs(spark, before)
    fresh, _ = _fs(spark, beside)
    if fs.exists(target):
        fs.delete(kept, True)
        if not fs.rename(target, kept):
            raise OSError(f"could not put {path} aside; the new version is in {beside}")
    if not fs.rename(fresh, target):
        fs.rename(kept, target)
        raise OSError(f"could not replace {path}")
    fs.delete(kept, True)


def fixed(value: Column, digits: int) -> Column:
    """Python's fixed-point text (rounds the binary value half to even, unlike ``format_string``)."""

    @F.pandas_udf(T.StringType())
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else f"{x:.{digits}f}")

    return run(value.cast("double"))


def summary_lines(summary: DataFrame, out_dir: Column) -> DataFrame:
    """The ten text columns of a summary row, in file order."""
    return summary.select(
        "model", "dataset", "method", "n", "n_correct", fixed(F.col("acc"), 3).alias("acc"), fixed(F.col("avg_tok"), 1).alias("avg_tok"),
        "max_tok", fixed(F.col("avg_steps"), 2).alias("avg_steps"), out_dir.alias("out_dir"),
    )


def write_summary(lines: DataFrame, path: str, append: bool = False) -> None:
    """Headerless CSV in one file: one line per cell, so its size is that of the run grid."""
    lines.coalesce(1).write.mode("append" if append else "overwrite").csv(path, header=False)


def summary_changes(old: DataFrame, new: DataFrame, key: Sequence[str] = ("model", "dataset", "method")) -> DataFrame:
    """Dry run of a rewrite: cells that would be added, removed or changed."""
    body = lambda df: F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns if c not in key])
    a, b = old.select(*key, body(old).alias("old")), new.select(*key, body(new).alias("new"))
    both = a.join(b, list(key), "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", kind)


def write_buckets(samples: DataFrame, path: str) -> None:
    """One JSON folder per transition bucket."""
    samples.write.mode("overwrite").partitionBy("bucket").json(path)


def write_step(df: DataFrame, path: str, step: int, fmt: str = "parquet") -> None:
    """Write a step's rows under ``step=<n>``, replacing only that step."""
    df.withColumn("step", F.lit(step)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").format(fmt).save(path)


def generation_rows(inputs: Column, outputs: Column, scores: Column, extra: dict[str, Column]) -> list[Column]:
    """Columns of a generation dump."""
    return [inputs.alias("input"), outputs.alias("output"), scores.alias("score"), *[c.alias(n) for n, c in extra.items()]]


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append (step, name, value) rows."""
    metrics.select("step", "name", "value").write.mode("append").partitionBy("step").parquet(path)


def write_responses(df: DataFrame, path: str, key: Sequence[str], response: str = "response", order: str = "sample_idx") -> None:
    """Dataset rows with their responses as an ordered list (as many as were sampled per prompt)."""
    listed = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, response))).alias("_r"))
    listed.select(*key, F.col(f"_r.{response}").alias("responses")).write.mode("overwrite").parquet(path)


def report_lines(matrix: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Fixed-width comparison lines from a transition matrix."""
    name = F.concat_ws(" x ", *cell)
    line = F.format_string(
        "%-40s n=%6d CC=%5d CW=%5d WC=%5d WW=%5d delta=%+5d", name, *[F.col(c) for c in ("n", "cc", "cw", "wc", "ww", "delta")]
    )
    return matrix.select(*cell, line.alias("line"))
