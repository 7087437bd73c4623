"""Line dedup: the first occurrence of a repeated line stays; documents get compressed keep bitmaps, not new texts.

Only hashes move. Every line long enough gives (hash, document, position); these are range-partitioned by hash with the
document and position as secondary sort, and first occurrences are streamed from the sorted rows. A very common line
must not meet in one task, so a first pass works on (hash, salt), the salt taken from the row: what is not in the
first document of its salt is dropped at once, and only the first document of each salt goes to the second pass, in
which a hash has at most ``salts`` documents. Dropped positions are gathered per document and written as the run
lengths of a bitmap: kept, dropped, kept, ... lines, in turn.

Defined cases: a null or empty text is one empty line; null ids count as one document that comes after all others;
rows with equal ids are one document for the rule and keep bitmaps of their own; lines shorter than ``least`` stay;
an empty table gives no rows; other columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm import common as C

LEAST = 10

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(C.BLANKS)), _UPPER, _UPPER.lower())


def _by_first(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Marks the rows of the first document of each key: range partitions, sorted by document and position."""
    dealt = rows.repartitionByRange(partitions, *keys)
    stream = Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last(), "row_", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("first_", F.first(F.struct("doc_id")).over(stream)["doc_id"].eqNullSafe(F.col("doc_id")))


def keep_bitmaps(docs: DataFrame, least: int = LEAST, salts: int | None = None) -> DataFrame:
    """(doc_id, row_, runs) of every document that loses a line; ``row_`` is ``common.row_key``.

    ``runs`` are the lengths of the alternating runs of kept and dropped lines, beginning with kept ones.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = salts or max(64, partitions)
    lines = docs.select("doc_id", C.row_key().alias("row_"), F.posexplode(_lines(F.col("text"))).alias("position", "line"))
    keyed = lines.select("doc_id", "row_", "position", _key(F.col("line")).alias("key")).where(F.length("key") >= least)
    # 128 bits: at 10^12 lines two different ones still do not meet
    hashed = keyed.select(F.unhex(F.md5("key")).alias("hash"), "doc_id", "row_", "position")
    hashed = C.written(hashed.withColumn("salt", F.pmod("row_", F.lit(salts)).cast("int")), "lines")
    local = C.written(_by_first(hashed, ["hash", "salt"], partitions), "lines")
    final = _by_first(local.where("first_").drop("first_"), ["hash"], partitions)
    dropped = local.where("not first_").select("doc_id", "row_", "position").union(final.where("not first_").select("doc_id", "row_", "position"))
    # rows that are equal in id and text share their bitmap
    positions = dropped.groupBy("doc_id", "row_").agg(F.array_sort(F.collect_set("position")).alias("at"))
    return positions.select("doc_id", "row_", run_lengths(F.col("at")).alias("runs"))


def run_lengths(at: Column) -> Column:
    """Run lengths (kept, dropped, kept, ... without a last kept run) of a sorted list of dropped positions."""
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("runs"), F.lit(0).alias("next"), F.lit(0).alias("open"))

    def add(state: Column, position: Column) -> Column:
        follows = (position == state["next"]) & (state["open"] > 0)
        closed = F.when(state["open"] > 0, F.concat(state["runs"], F.array(state["open"]))).otherwise(state["runs"])
        return F.struct(
            F.when(follows, state["runs"]).otherwise(F.concat(closed, F.array(position - state["next"]))).alias("runs"),
            (position + 1).alias("next"),
            F.when(follows, state["open"] + 1).otherwise(F.lit(1)).alias("open"),
        )

    return F.aggregate(at, start, add, lambda state: F.concat(state["runs"], F.array(state["open"])))


def kept_flags(runs: Column) -> Column:
    """The bitmap as booleans, up to the last dropped line."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``, which replace columns of these names."""
    flags = bitmaps.select(F.col("doc_id").alias("flags_id"), F.col("row_").alias("flags_row"), kept_flags(F.col("runs")).alias("flags"))
    held = C.Held(docs.drop("kept_text", "n_lines", "n_dropped"))
    rows = held.docs.withColumns({"own_id": held.col("doc_id"), "own_row": C.row_key(held.col("doc_id"), held.col("text"))})
    found = rows.join(flags, C.same_row(rows, flags, ["own_id", "own_row"], ["flags_id", "flags_row"]), "left")
    whole = F.coalesce(held.col("text"), F.lit(""))
    lines = _lines(whole)
    kept = F.filter(lines, lambda _, i: F.coalesce(F.get("flags", i), F.lit(True)))
    text = F.when(F.col("flags").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    n_dropped = F.coalesce(F.size(F.filter("flags", lambda x: ~x)), F.lit(0))
    return held.back(found, kept_text=text, n_lines=F.size(lines).cast("bigint"), n_dropped=n_dropped.cast("bigint"))
