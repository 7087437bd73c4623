"""What the corpus operators share: written tables, row keys, and words of a batch of texts as numpy arrays."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.session import _ensure_checkpoint_dir

BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Rows that Spark hands to Python at once: texts are long, and a batch is held whole.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


#: Where the names of new folders are noted, while somebody asks for them.
_noted: list[list[str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which every executor can reach."""
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    for names in _noted:
        names.append(path)
    return path


@contextmanager
def noted_folders(names: list[str]) -> Iterator[None]:
    """Notes the folders that are made inside in ``names``."""
    _noted.append(names)
    try:
        yield
    finally:
        _noted.remove(names)


def release(names: list[str], but: DataFrame) -> None:
    """Delete noted folders, but those whose files ``but`` reads; the others leave the list."""
    files = but.inputFiles() if names else []
    used = [n for n in names if any(f"/{n.rsplit('/', 1)[-1]}/" in f for f in files)]
    context = but.sparkSession.sparkContext
    for name in set(names) - set(used):
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    names[:] = used


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and Spark then knows its size for joins."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder whose files are buckets of ``key``: joins on it do not shuffle it."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def map_texts(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for rows of text; a smaller setting of the session stays."""
    conf = rows.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # bytes as Spark writes them, such as 64m or 256MB, or none
    size = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").strip().lower().removesuffix("b")
    at_most = int(size) if size.lstrip("-").isdigit() else BATCH_BYTES + 1
    if not 0 < at_most <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(function, schema)


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Tells rows apart that share an id: with the id it is the key of joins back to the documents."""
    return F.xxhash64(doc_id, text)


class Held:
    """Documents under names that no column of an operator can clash with; ``back`` gives them their own names again."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.docs = docs.select(*[F.col(f"`{c}`").alias(f"column_{i}") for i, c in enumerate(self.names)])

    def col(self, name: str) -> Column:
        return F.col(f"column_{self.names.index(name)}")

    def back(self, rows: DataFrame, **more: Column) -> DataFrame:
        own = [f"column_{i}" for i in range(len(self.names))]
        # named in a second step, so that no expression can mean a column that is being named
        made = rows.select(*own, *[c.alias(f"more_{i}") for i, c in enumerate(more.values())])
        return made.select(*[F.col(a).alias(b) for a, b in zip(made.columns, [*self.names, *more])])


def same_row(left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str]) -> Column:
    """Null-safe equality of the key columns."""
    cond = F.lit(True)
    for a, b in zip(keys, right_keys):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each come to at most ``limit`` bytes, or to one document."""
    for batch in batches:
        n = batch.num_rows
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty, and where each row begins (one more at the end)."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of a word in the sense of WORD_PATTERN: all but the six blanks.
IN_WORD = ~byte_table(BLANKS.encode())

#: Bytes of a term: ASCII letters and digits and every byte of a non-ASCII character.
IN_TERM = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of ``inside`` within each document: begin, end, document number."""
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    if len(data):
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = mask[cuts]
        last[cuts - 1] = mask[cuts - 1]
    begin = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; bytes at the same place of all spans are taken in one step."""
    size = end - begin
    out = size.astype(np.uint64)
    live = np.flatnonzero(size <= _LONG)
    at = 0
    while len(live):
        live = live[size[live] > at]
        out[live] = out[live] * _STEP + data[begin[live] + at] + np.uint64(1)
        at += 1
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words that lies in one document, and the number of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = hashes[at]
    for j in range(1, k):
        out = out * _STEP + hashes[at + j]
    return mix(out), at


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each [offsets[i], offsets[i + 1])."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]
