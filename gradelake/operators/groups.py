"""Group and order primitives that stay distributed when one key holds most rows.

* ``join_group_stats``  aggregate per key (map-side combine) and attach the result to each row;
                        hot keys are salted, so no task ever holds a whole hot group.
* ``last_wins``/``top_per_group``  rank with a bound, which Spark prunes before the shuffle.
* ``with_row_index``    exact global 0-based position without a single-task sort.
* ``position_in_group`` exact 0-based position inside a key, hot keys included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.text import whole_div
from gradelake.session import checkpoint

# A key with more rows than this is spread over ceil(rows / HOT_ROWS) salts. At most
# total_rows / HOT_ROWS keys can be hot, which bounds the broadcast list of hot keys.
HOT_ROWS = 1_000_000

_POS_BITS = 33  # monotonically_increasing_id keeps the in-partition position in the low 33 bits


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = None
    for a, b in pairs:
        term = left[a].eqNullSafe(right[b])
        cond = term if cond is None else cond & term
    return cond


def join_group_stats(
    rows: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    hot_rows: int | None = None,
    spread_on: Sequence[str] | None = None,
) -> DataFrame:
    """Attach ``aggs`` computed per ``keys`` to every row; also adds ``group_n``."""
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_n"), *aggs)
    return join_skewed(rows, stats, keys, "group_n", hot_rows, spread_on)


def join_skewed(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    size_col: str,
    hot_rows: int | None = None,
    spread_on: Sequence[str] | None = None,
    sizes: DataFrame | None = None,
    size_keys: Sequence[str] | None = None,
    hint: str | None = None,
) -> DataFrame:
    """Inner-join one-row-per-key ``stats`` back to ``rows``; ``size_col`` is the group's row count.

    The rows of a hot key go to several salts chosen from a hash of the row, and that key's one
    statistics row is repeated once per salt. Cold keys keep salt 0 and are not repeated. When the rows
    already carry ``size_col``, it is used as it is; otherwise the hot keys are broadcast, taken from
    ``sizes`` (keys and ``size_col``) where that is cheaper to compute than ``stats``. ``size_keys`` names
    the part of the key the sizes are about; ``hint`` keeps Spark from planning on a size it cannot see.
    """
    hot_rows = hot_rows or HOT_ROWS
    salts = F.greatest(F.ceil(F.col(size_col) / F.lit(hot_rows)), F.lit(1)).cast("int")
    spread = [rows[c] for c in (spread_on or [n for n, t in rows.dtypes if not t.startswith("map")])]
    own_size = size_col in rows.columns
    if own_size:
        salted = rows.withColumn("_salts", salts)
    else:
        hot = (sizes if sizes is not None else stats).where(F.col(size_col) > hot_rows)
        of = size_keys or keys
        hot = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in of], salts.alias("_salts"))
        salted = rows.join(F.broadcast(hot), _null_safe(rows, hot, [(k, f"_hot_{k}") for k in of]), "left")
    several = F.coalesce("_salts", F.lit(1)) > 1
    salt = F.when(several, F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")).otherwise(F.lit(0))
    salted = salted.withColumn("_salt", salt)
    copies = stats.withColumn("_stat_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    renamed = [*keys, size_col] if own_size else list(keys)
    copies = copies.withColumnsRenamed({c: f"_stat_{c}" for c in renamed})
    if hint:
        copies = copies.hint(hint)
    cond = _null_safe(salted, copies, [(k, f"_stat_{k}") for k in keys])
    joined = salted.join(copies, cond & (salted["_salt"] == copies["_stat_salt"]), "inner")
    return joined.drop("_salt", "_salts", "_stat_salt", *[f"_hot_{k}" for k in keys], *[f"_stat_{k}" for k in renamed])


def top_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. The rank bound is applied map-side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def last_wins(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep, per key, the row that comes last in ``order_by`` (file order, line number ...)."""
    latest = top_per_group(df, keys, [F.col(c).desc_nulls_last() for c in order_by], 1, "_rank")
    return latest.drop("_rank")


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Add a dense 0-based index in ``order_by`` order.

    Rows are range-partitioned and sorted in place, materialised, and each partition's offset
    (one number per partition, not per row) is added to the position inside the partition.
    """
    placed = checkpoint(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by))
    marked = placed.withColumn("_mid", F.monotonically_increasing_id()).withColumns(
        {
            "_part": F.shiftright("_mid", _POS_BITS),
            "_pos": F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)),
        }
    )
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # One row per partition of the sort: bounded by the partition count, never by the data.
    return marked.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_pos")).drop(
        "_mid", "_part", "_pos", "_offset"
    )


def position_in_group(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str = "pos", hot_rows: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row inside its key; also adds ``group_n``."""
    indexed = with_row_index(df, [*keys, *order_by], "_gidx")
    with_first = join_group_stats(indexed, keys, [F.min("_gidx").alias("_first")], hot_rows, spread_on=["_gidx"])
    return with_first.withColumn(name, F.col("_gidx") - F.col("_first")).drop("_gidx", "_first")


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles of the whole column, as rows (q, value).

    Ranks come from the distributed index, so no task buffers the column's distinct values.
    """
    values = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    # the tie column lets the range partitioning split a value that most rows share
    indexed = with_row_index(values.withColumn("_tie", F.monotonically_increasing_id()), ["v", "_tie"]).drop("_tie")
    total = indexed.agg(F.count(F.lit(1)).alias("n"))
    wanted = df.sparkSession.createDataFrame([(float(q),) for q in qs], "q double").join(F.broadcast(total))  # one row
    wanted = wanted.withColumn("h", F.col("q") * (F.col("n") - 1)).withColumns(
        {"lo": F.floor("h").cast("long"), "hi": F.ceil("h").cast("long")}
    )
    # two wanted ranks per requested quantile: a list the caller wrote down
    ranks = wanted.select("q", "h", "lo", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("r"))
    hit = indexed.join(F.broadcast(ranks), indexed["row_idx"] == ranks["r"])
    return hit.groupBy("q", "h", "lo").agg(F.min("v").alias("vl"), F.max("v").alias("vh")).select(
        "q", (F.col("vl") + (F.col("h") - F.col("lo")) * (F.col("vh") - F.col("vl"))).alias("value")
    )


BLOCK = 1 << 20


def cumulative(df: DataFrame, index: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Inclusive running sum over a dense index: inside fixed-size blocks, plus the sum of the blocks before."""
    b = df.withColumn("_b", whole_div(index, block))
    sums = b.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block of the index: rows / block, the only single-task step
    offsets = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("_in", F.sum(value).over(inside)).join(offsets, "_b").withColumn(
        out, F.col("_in") + F.col("_off")
    ).drop("_b", "_in", "_off")
