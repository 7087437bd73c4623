"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime-settable options the operators rely on; cluster sizing stays with the deployer.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "gradelake", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the options above plus any overrides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="run-gradelake-", dir="/tmp")
    sc.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later passes read the same rows in the same partitions."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
