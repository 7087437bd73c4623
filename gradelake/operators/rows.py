"""Batch verbs on a DataFrame that carries a dense 0-based ``row_idx``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.text import whole_div
from gradelake.operators.groups import with_row_index

IDX = "row_idx"


def _with_total(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_total"))))  # one row


def split_columns(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, everything else), both keeping ``row_idx``."""
    return df.select(IDX, *[c for c in cols if c != IDX]), df.drop(*[c for c in cols if c != IDX])


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names for {len(new)} new names")
    return df.withColumnsRenamed(dict(zip(old, new)))


def take(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows at the listed positions, in list order and with repeats; ``positions`` has (pos, row_idx).

    A position that ``df`` does not have fails the job.
    """
    found = positions.join(df.withColumn("_seen", F.lit(True)), IDX, "left")
    refused = F.raise_error(F.concat(F.lit("no row at position "), F.col(IDX).cast("string"))).cast("bigint")
    at = F.when(F.col("_seen"), F.col("pos").cast("bigint")).otherwise(refused)
    return found.withColumn("pos", at).drop(IDX, "_seen").withColumnRenamed("pos", IDX)


def take_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Rows whose boolean mask is set, numbered anew in their order; a NULL mask fails the job."""
    sure = F.coalesce(mask, F.raise_error(F.lit("the mask has a NULL")).cast("boolean"))
    return with_row_index(df.where(sure), [IDX], "_new").drop(IDX).withColumnRenamed("_new", IDX)


def slice_rows(df: DataFrame, start: int, end: int, step: int = 1) -> DataFrame:
    i = F.col(IDX)
    kept = df.where((i >= start) & (i < end) & ((i - start) % step == 0))
    return kept.withColumn(IDX, F.floor((i - start) / step))


def reorder(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping`` has one (new_idx, row_idx) pair per row."""
    return df.join(mapping, IDX).drop(IDX).withColumnRenamed("new_idx", IDX)


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """AABB (interleaved) or ABAB copies."""
    copies = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return copies.withColumn(IDX, F.col(IDX) * times + F.col("_k")).drop("_k")
    return _with_total(df).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(
        IDX, F.col("_k") * F.col("_total") + F.col(IDX)
    ).drop("_k", "_total")


def repeat_each(df: DataFrame, counts: str, copy: str = "copy") -> DataFrame:
    """Each row ``counts`` times (none for 0); order is (row_idx, copy)."""
    return df.where(F.col(counts) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(counts).cast("int") - 1)))


def unfold_array(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Split an array column into ``parts`` equal pieces, one row each; other columns repeat."""
    size = F.floor(F.size(column) / parts).cast("int")
    uneven = F.raise_error(F.lit(f"{column} does not divide into {parts} parts"))
    width = F.when(F.size(column) % parts != 0, uneven.cast("int")).otherwise(size)
    rows = df.withColumn("_w", width).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumns(
        {column: F.slice(F.col(column), F.col("_k") * F.col("_w") + 1, F.col("_w")), IDX: F.col(IDX) * parts + F.col("_k")}
    ).drop("_k", "_w")


def fold(df: DataFrame, size: int, columns: Sequence[str]) -> DataFrame:
    """``size`` consecutive rows become one, each column an ordered array (groups are bounded by ``size``)."""
    packed = df.groupBy(whole_div(IDX, size).alias("_g")).agg(
        F.array_sort(F.collect_list(F.struct(IDX, *columns))).alias("_s")
    )
    return packed.select(F.col("_g").alias(IDX), *[F.col(f"_s.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, size: int, columns: Sequence[str]) -> DataFrame:
    rows = df.select(IDX, F.posexplode(F.arrays_zip(*columns)).alias("_k", "_z"))
    return rows.select((F.col(IDX) * size + F.col("_k")).alias(IDX), *[F.col(f"_z.{c}").alias(c) for c in columns])


def chunk(df: DataFrame, parts: int, name: str = "chunk", padded: bool = False) -> DataFrame:
    """Equal contiguous parts; the row count must divide unless ``padded``."""
    size = F.ceil(F.col("_total") / parts)
    bad = F.raise_error(F.lit(f"rows do not divide into {parts} parts")).cast("long")
    part = whole_div(IDX, size)
    if not padded:
        part = F.when(F.col("_total") % parts != 0, bad).otherwise(part)
    return _with_total(df).withColumn(name, part).drop("_total")


def split_by_size(df: DataFrame, size: int, name: str = "part") -> DataFrame:
    """Contiguous parts of ``size`` rows; the last may be shorter."""
    return df.withColumn(name, whole_div(IDX, size))


def split_even(df: DataFrame, parts: int, name: str = "part") -> DataFrame:
    """Contiguous equal parts; the remainder is dropped."""
    size = whole_div("_total", parts)
    rows = _with_total(df)
    return rows.where(F.col(IDX) < size * parts).withColumn(name, whole_div(IDX, size)).drop("_total")


def batches(df: DataFrame, size: int, drop_last: bool = True, name: str = "batch") -> DataFrame:
    rows = split_by_size(df, size, name)
    if not drop_last:
        return rows
    full = whole_div("_total", size)
    return _with_total(rows).where(F.col(name) < full).drop("_total")


#: Steps that bring a place back into 0..n-1 with certainty up to n = 4096; beyond, all but one in 2^384 need fewer.
WALKS = 64
ROUNDS = 6


def permuted(index: Column, total: Column, seed: Column | str | int) -> Column:
    """The place of row ``index`` of 0..total-1 in an order that ``seed`` shuffles; computed from the row alone.

    The index is a pair (left, right) of a grid that just holds ``total`` places. Each round adds a hash of one half to
    the other, which can be undone, so all places differ; a place beyond ``total`` goes through the rounds again.
    """
    seed = F.lit(seed) if not isinstance(seed, Column) else seed
    high = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    grid = F.struct(high.alias("a"), whole_div(total + high - 1, high).alias("b"))

    def shuffled(x, g):
        def hashed(i, v, below):
            text = F.concat_ws("|", seed.cast("string"), i.cast("string"), v.cast("string"))
            return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % below

        def turn(p, i):
            left = F.when(i % 2 == 0, (p["l"] + hashed(i, p["r"], g["a"])) % g["a"]).otherwise(p["l"])
            right = F.when(i % 2 == 1, (p["r"] + hashed(i, p["l"], g["b"])) % g["b"]).otherwise(p["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        start = F.struct(whole_div(x, g["b"]).alias("l"), (x % g["b"]).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda p: p["l"] * g["b"] + p["r"])

    def walk(g):
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(WALKS)), F.lit(-1).cast("long"),
            lambda x, i: F.when(i == 1, shuffled(index.cast("long"), g)).when(x < total, x).otherwise(shuffled(x, g)),
        )

    place = F.transform(F.array(grid), walk)[0]
    lost = F.raise_error(F.lit("no place found; take another seed")).cast("long")
    return F.when(place < total, place).otherwise(lost)


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """(epoch, batch) per row; the row count must divide. A seed shuffles each epoch by ``permuted``, without a sort."""
    rows = _total_of(df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))), df)
    place = F.col(IDX)
    if seed is not None:
        place = permuted(place, F.col("_total"), F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string")))
    bad = F.raise_error(F.lit(f"rows do not divide into batches of {size}")).cast("long")
    batch = F.when(F.col("_total") % size != 0, bad).otherwise(whole_div("_pos", size))
    return rows.withColumn("_pos", place).withColumn("batch", batch).drop("_pos", "_total")


def _total_of(rows: DataFrame, df: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_total"))))  # one row


def pad_to_multiple(df: DataFrame, divisor: int) -> DataFrame:
    """Append rows cycled from the start until the count divides; ``is_pad`` marks them."""
    rows = _with_total(df)
    missing = (F.lit(divisor) - F.col("_total") % divisor) % divisor
    # at most ``divisor`` pad rows: row r fills every pad slot s with s mod total = r
    slots = F.filter(F.sequence(F.lit(0), F.lit(divisor - 1)), lambda s: (s < missing) & (s % F.col("_total") == F.col(IDX)))
    pads = rows.where(F.col(IDX) < divisor).withColumn("_slot", F.explode(slots))
    pads = pads.withColumn(IDX, F.col("_total") + F.col("_slot")).withColumn("is_pad", F.lit(True)).drop("_slot", "_total")
    return df.withColumn("is_pad", F.lit(False)).unionByName(pads)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def pad_with_edge(df: DataFrame, count: int, first: bool = False) -> DataFrame:
    """Append ``count`` copies of the first or the last row."""
    rows = _with_total(df)
    edge = rows.where(F.col(IDX) == (F.lit(0) if first else F.col("_total") - 1))
    pads = edge.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count else edge.where("false").withColumn("_k", F.lit(0))
    return df.unionByName(pads.withColumn(IDX, F.col("_total") + F.col("_k")).drop("_k", "_total"))


def pad_with_blank(df: DataFrame, divisor: int, uid: str, arrays: Sequence[str]) -> DataFrame:
    """Append no-op rows with fresh uids, zeroed arrays and ``is_padding`` set until the count divides."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    slot = F.explode(F.filter(F.sequence(F.lit(0), F.lit(divisor - 1)), lambda s: s < (divisor - F.col("_total") % divisor) % divisor))
    blank = total.withColumn("_s", slot)
    kinds = dict(df.dtypes)
    cols = []
    for c in df.columns:
        if c == IDX:
            cols.append((F.col("_total") + F.col("_s")).alias(c))
        elif c == uid:
            cols.append(F.concat(F.lit("pad-"), F.col("_s").cast("string")).cast(kinds[c] if kinds[c] == "string" else "string").alias(c))
        elif c in arrays:
            cols.append(F.array(F.lit(0)).cast(kinds[c]).alias(c))
        else:
            cols.append(F.lit(None).cast(kinds[c]).alias(c))
    pads = blank.select(*cols, F.lit(True).alias("is_padding"))
    return df.withColumn(uid, F.col(uid).cast("string")).withColumn("is_padding", F.lit(False)).unionByName(pads)


def keep_short(df: DataFrame, tokens: Column, limit: int) -> DataFrame:
    """Rows whose prompt length is known and within the limit (an unreadable one counts as too long)."""
    return df.where(F.coalesce(tokens, F.lit(limit + 1)) <= limit)


def head(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col(IDX) < n)


def seeded_sample(df: DataFrame, n: int, seed: int, key: Sequence[str] = (IDX,), where: Column | None = None) -> DataFrame:
    """``n`` rows without replacement in a seeded pseudo-random order (``order`` 0..n-1), of those that ``where`` admits.

    The order is that of the md5 of seed and key, so that any engine draws the same rows; each task keeps n rows at most.
    It is a uniform draw, but not numpy's sequence, which would need the whole permutation on the driver.
    """
    admitted = df if where is None else df.where(where)
    drawn = admitted.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])))
    first = drawn.orderBy("_h", *key).limit(n)
    # the n rows that were asked for
    return first.withColumn("order", F.row_number().over(Window.orderBy("_h", *key)).cast("bigint") - 1).drop("_h")


def concat_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Vertical concatenation; every part must have the same columns. Indices continue part by part."""
    first = parts[0]
    out, offset = first, first.agg(F.count(F.lit(1)).alias("_off"))
    for p in parts[1:]:
        if set(p.columns) != set(first.columns):
            raise ValueError("parts have different columns")
        shifted = p.join(F.broadcast(offset)).withColumn(IDX, F.col(IDX) + F.col("_off")).drop("_off")  # one row
        out = out.unionByName(shifted)
        offset = offset.join(F.broadcast(p.agg(F.count(F.lit(1)).alias("_c")))).select((F.col("_off") + F.col("_c")).alias("_off"))
    return out


def zip_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Horizontal union on ``row_idx``; a shared column that differs (NaN equals NaN) is an error."""
    shared = [c for c in left.columns if c in right.columns and c != IDX]
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    joined = left.join(other, IDX)
    for c in shared:
        bad = F.raise_error(F.lit(f"column {c} differs")).cast(dict(left.dtypes)[c])
        joined = joined.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(bad))
    return joined.drop(*[f"_r_{c}" for c in shared])


def run_positions(df: DataFrame, batch: str, key: str) -> DataFrame:
    """Inside bounded batches: number the runs of equal consecutive ``key`` and the position in each run."""
    from pyspark.sql import Window

    w = Window.partitionBy(batch).orderBy(IDX)
    start = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_new", start).withColumn("run", F.sum("_new").over(w) - 1)
    inside = Window.partitionBy(batch, "run").orderBy(IDX)
    return runs.withColumn("pos_in_run", F.row_number().over(inside) - 1).drop("_new")
