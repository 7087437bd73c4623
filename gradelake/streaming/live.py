"""Structured Streaming forms: last-write-wins buffer, stale counter, keys that are ready."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RUNNING, SUCCESS = "running", "success"


def stream_latest_tags(updates: DataFrame) -> DataFrame:
    """Last write wins per (partition, key, tag), as an update-mode aggregate on ``seq``."""
    return updates.groupBy("partition", "key", "tag").agg(F.max_by("value", "seq").alias("value"))


def stream_stale_counts(samples: DataFrame, step: str, version: str, current: str) -> DataFrame:
    return samples.groupBy(step).agg(F.count(F.when(F.col(current) - F.col(version) >= 1, 1)).alias("stale"))


class _ReadyKeys(StatefulProcessor):
    """State of one (partition, step): the last status of every key that has not left, and how many are running.

    The count spares a look at all keys for every batch; they are read only when they leave, and nothing is remembered of them.
    """

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "key string", "status string, seq long")
        self.running = handle.getValueState("running", "n long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        running = self.running.get()[0] if self.running.exists() else 0
        for r in rows:
            name = (r.key,)
            was = self.keys.getValue(name) if self.keys.containsKey(name) else None
            if was is not None and was[1] >= r.seq:
                continue
            running += (r.status == RUNNING) - (was is not None and was[0] == RUNNING)
            self.keys.updateValue(name, (r.status, r.seq))
        self._due(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        if running:
            self.running.update((running,))
        else:
            yield from self._leave(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Nothing came for ``expire_ms``: running keys are given up, those that succeeded leave."""
        yield from self._leave(key)
        self.due.clear()

    def _due(self, at: int) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def _leave(self, key) -> Iterator[Row]:
        for name, (status, _) in self.keys.iterator():
            if status == SUCCESS:
                yield Row(partition=key[0], step=key[1], key=name[0])
        self.keys.clear()
        self.running.clear()


def stateful(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_ready_keys(updates: DataFrame, expire_ms: int = 3_600_000) -> DataFrame:
    """(partition, step, key) of every key with status ``success``, once no key of its partition and step is running.

    ``updates`` has (partition string, step string, key string, status string, seq long), in any order inside a batch;
    the highest ``seq`` of a key wins. A key of another status leaves without a row. Once a key has left, an update of it is
    that of a new key: a source has to keep the order of a key's updates over batches, and one that sends an update again gets
    its row again. Updates with a null key, status or seq are ignored. A step without any update
    for ``expire_ms`` is closed: its running keys are given up and its state is dropped. The batch form is
    ``replay.ready_keys``; rows are equal where no step stands still before its end. Timers make Spark run batches without
    data: under ``availableNow`` set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false, or it does not end.
    """
    stateful(updates.sparkSession)
    known = updates.where("key is not null and status is not null and seq is not null")
    return (
        known.select("partition", "step", "key", "status", F.col("seq").cast("long").alias("seq"))
        .groupBy("partition", "step")
        .transformWithState(_ReadyKeys(expire_ms), "partition string, step string, key string", "append", "processingTime")
    )
