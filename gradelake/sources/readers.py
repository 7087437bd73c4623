"""Readers for recorded runs, datasets, summaries and logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.functions.extract import ANSWER_KINDS
from gradelake.functions.text import strip
from gradelake.operators.groups import last_wins
from gradelake.schemas import schema

# Position of a line: file, byte offset of its split, then reading order inside the split.
LINE_ORDER = ["file", "block", "line_id"]


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Non-blank text lines as (value, file, block, line_id); ``LINE_ORDER`` sorts them as in the file.

    The order comes from the split's offset and the reading order inside it, so large files stay split.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    lines = reader.text(path if isinstance(path, str) else list(path))
    lines = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    return lines.where(F.length(strip(F.col("value"))) > 0)


def read_jsonl_strict(spark: SparkSession, path, ddl: str) -> DataFrame:
    """Any malformed line fails the read."""
    return spark.read.schema(schema(ddl)).option("mode", "FAILFAST").json(path)


def read_jsonl_marked(spark: SparkSession, path, ddl: str, glob: str | None = None) -> DataFrame:
    """Every line is kept: the record's columns, ``parse_error`` and the raw ``value`` with its position.

    A line counts as broken when it is not a JSON object; a wrongly typed field is only NULL.
    """
    lines = read_lines(spark, path, glob)
    parsed = lines.withColumn("_r", F.from_json("value", schema(ddl), {"mode": "PERMISSIVE"}))
    return parsed.select("_r.*", F.json_object_keys("value").isNull().alias("parse_error"), "value", *LINE_ORDER)


def read_records(spark: SparkSession, path, ddl: str, key: Sequence[str] = ("problem_id", "sample_idx"), glob: str | None = None) -> DataFrame:
    """Readable records with the last line per key winning."""
    good = read_jsonl_marked(spark, path, ddl, glob).where(~F.col("parse_error"))
    return last_wins(good, key, LINE_ORDER).drop("parse_error", "value", *LINE_ORDER)


def read_keyed(spark: SparkSession, path, ddl: str, keys: Sequence[str] = ("problem_id", "id", "question_id")) -> DataFrame:
    """Records by the first key that is set, as text in ``pid``; records without a key are left out."""
    rows = read_jsonl_marked(spark, path, ddl).where(~F.col("parse_error"))
    have = [F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys if k in rows.columns]
    keyed = rows.withColumn("pid", F.coalesce(*have)).where(F.col("pid").isNotNull())
    return last_wins(keyed, ["pid"], LINE_ORDER).drop("parse_error", "value", *LINE_ORDER)


def read_shards(spark: SparkSession, path: str, ddl: str, glob: str = "passk_shard_*.jsonl") -> DataFrame:
    """One file, or every shard file of a directory."""
    if path.endswith((".jsonl", ".json")):
        return spark.read.schema(schema(ddl)).json(path)
    return spark.read.schema(schema(ddl)).option("pathGlobFilter", glob).json(path)


def read_dataset(spark: SparkSession, paths: Sequence[str], ddl: str | None = None) -> DataFrame:
    """Parquet and JSON files stacked by column name; other suffixes are refused."""
    parts = []
    for p in paths:
        if p.rstrip("/").endswith(".parquet"):
            parts.append(spark.read.parquet(p))
        elif p.rstrip("/").endswith((".json", ".jsonl")):
            parts.append(spark.read.schema(schema(ddl)).json(p) if ddl else spark.read.json(p))
        else:
            raise ValueError(f"unsupported file format: {p}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_summary_lines(spark: SparkSession, path) -> DataFrame:
    """Summary CSV lines with ``seq`` = file order, for ``audit.last_summary_lines``."""
    return read_lines(spark, path).select(F.struct(*LINE_ORDER).alias("seq"), "value")


def with_cell_columns(df: DataFrame, file: str = "file") -> DataFrame:
    """Add model, dataset (NULL unless known) and suffix from ``<model>__<dataset>__<suffix>/...`` paths."""
    folder = F.split(F.try_element_at(F.split(file, "/"), F.lit(-2)), "__")
    dataset = F.get(folder, F.lit(1))
    return df.withColumns(
        {
            "model": F.get(folder, F.lit(0)),
            "dataset": F.when(dataset.isin(list(ANSWER_KINDS)), dataset),
            "suffix": F.get(folder, F.lit(2)),
        }
    )


def count_problems(spark: SparkSession, path: str) -> int:
    """Non-blank lines of a dataset file; 0 when it does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return 0
    return read_lines(spark, path).count()


def with_problem_id(problems: DataFrame, index: str = "row_idx") -> DataFrame:
    """problem_id = id, else question_id, else ``row_<index>``."""
    given = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "question_id") if c in problems.columns]
    return problems.withColumn("problem_id", F.coalesce(*given, F.concat(F.lit("row_"), F.col(index).cast("string"))))


def generate(prompts: DataFrame, fn: Callable[[list[str]], list[list[str]]], samples: int, prompt: str = "prompt", key: str = "problem_id", batch: int = 128, partitions: int | None = None) -> DataFrame:
    """Hook for an external model client: ``fn`` maps a prompt batch to ``samples`` texts per prompt.

    Returns (key, sample_idx from 1, response). Nothing is served or started here.
    """
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = fn(list(part[prompt]))
                yield pd.DataFrame(
                    [(k, i + 1, t) for k, group in zip(part[key], texts) for i, t in enumerate(group[:samples])],
                    columns=[key, "sample_idx", "response"],
                )

    spread = prompts.repartition(partitions) if partitions else prompts
    return spread.select(key, prompt).mapInPandas(run, f"{key} {kind}, sample_idx int, response string")


def read_step(spark: SparkSession, path: str, step: int) -> DataFrame:
    """One recorded step of a dump written by ``sinks.write_step`` (partition pruned)."""
    return spark.read.parquet(path).where(F.col("step") == step)
