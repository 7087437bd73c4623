"""Validation metrics: mean/std per prompt, bootstrapped best/worst/majority, then the mean over prompts.

The resampling indices are those of numpy's legacy generator reseeded for every call, so equal group
sizes share one index matrix. Ordinary groups are resampled as arrays inside Arrow batches. A group larger than
``array_limit`` goes with its array to many tasks, each of which draws some of the resamples and reduces them in place.
A group larger than ``block_limit`` never becomes an array: its indices are drawn by many tasks, joined row by row and
reduced with ordinary aggregates, which gives the same numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelake.functions import twister
from gradelake.operators.groups import join_group_stats, position_in_group
from gradelake.session import checkpoint

ARRAY_LIMIT = 2048
#: Rows of the largest group that tasks hold as arrays (12 bytes a row), and draws that are reduced at a time.
BLOCK_LIMIT = 1 << 20
STEP = 1 << 20
#: Draws of one task's share of a group: numpy's are cheap beside the jump to their place.
SHARE = {"numpy": 1 << 24, "counter": 1 << 20}
#: Raw numbers of one task, and draws of one group that are joined as one part.
RAW_BLOCK = 1 << 22
PART = 1 << 20
_POINT = T.ArrayType(
    T.StructType([T.StructField("n", T.LongType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])
)


def ladder(total: int) -> list[int]:
    """2, 4, 8 ... below ``total``, then ``total``; nothing for a single sample."""
    out, n = [], 2
    while n < total:
        out.append(n)
        n *= 2
    return [*out, total] if total > 1 else []


def ladder_column(total: Column) -> Column:
    """The same ladder as an array column."""
    powers = F.array(*[F.lit(1 << i).cast("long") for i in range(1, 62)])
    steps = F.concat(F.filter(powers, lambda p: p < total), F.array(total))
    return F.when(total > 1, steps).otherwise(F.array().cast("array<bigint>"))


def _majority(codes: np.ndarray, vals: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Value of the first occurrence of the most frequent vote per resample; ties go to the earlier vote."""
    boots, n = idx.shape
    k = int(codes.max()) + 1
    flat = codes[idx] + k * np.arange(boots)[:, None]
    counts = np.bincount(flat.ravel(), minlength=boots * k).reshape(boots, k)
    first = np.full(boots * k, n)
    np.minimum.at(first, flat.ravel(), np.tile(np.arange(n), boots))
    first = first.reshape(boots, k)
    winner = np.where(counts == counts.max(axis=1, keepdims=True), first, n + 1).argmin(axis=1)
    at = first[np.arange(boots), winner]
    return vals[idx[np.arange(boots), at]]


def _resample(vals: np.ndarray, votes, boots: int, seed: int) -> list[tuple[int, str, float]]:
    out = []
    # a missing vote is a vote like any other
    codes = None if votes is None else pd.factorize(np.asarray(votes, dtype=object), use_na_sentinel=False)[0]
    for n in ladder(len(vals)):
        idx = np.random.RandomState(seed).choice(len(vals), size=(boots, n), replace=True)
        drawn = vals[idx]
        series = {"best": drawn.max(axis=1), "worst": drawn.min(axis=1)}
        if codes is not None:
            series["maj"] = _majority(codes, vals, idx)
        for name, s in series.items():
            out += [(n, f"{name}@{n}/mean", float(s.mean())), (n, f"{name}@{n}/std", float(s.std()))]
    return out


def _small_groups(groups: DataFrame, keys: Sequence[str], has_votes: bool, boots: int, seed: int) -> DataFrame:
    def rows(vals, votes):
        return [{"n": n, "metric": m, "value": v} for n, m, v in _resample(np.asarray(vals, dtype=float), votes, boots, seed)]

    if has_votes:

        @F.pandas_udf(_POINT)
        def run(vals: pd.Series, votes: pd.Series) -> pd.Series:
            return pd.Series([rows(a, b) for a, b in zip(vals, votes)], dtype=object)

        points = run(F.col("s.val"), F.col("s.vote"))
    else:

        @F.pandas_udf(_POINT)
        def run(vals: pd.Series) -> pd.Series:
            return pd.Series([rows(a, None) for a in vals], dtype=object)

        points = run(F.col("s.val"))
    return groups.select(*keys, F.explode(points).alias("p")).select(*keys, "p.n", "p.metric", "p.value")


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Few small rows with much work each: a fixed number of partitions, which adaptive execution leaves alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _placed_blocks(sizes: DataFrame, boots: int, seed: int, chunk: int) -> DataFrame:
    """(total, n_max, ns, block, kept, start): where each block of raw numbers begins in the stream of its total.

    All sizes of one total read the same stream. It is cut into blocks of raw numbers; each task jumps to its block. The
    generator drops raw numbers beyond the total, so what blocks keep is counted first, which says where each begins.
    """
    streams = sizes.groupBy("total").agg(F.max("n").alias("n_max"), F.sort_array(F.collect_set("n")).alias("ns"))  # a ladder is short
    streams = checkpoint(streams)
    raw = F.lit(boots) * F.col("n_max") * F.pow(F.lit(2.0), F.ceil(F.log2("total"))) / F.col("total")
    slack = 8.0
    while True:
        blocks = F.ceil((raw + slack * F.sqrt(raw) + 64) / chunk)
        rows = streams.select("total", "n_max", "ns", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch["kept"] = [len(twister.accepted(seed, b, chunk, t)) for b, t in zip(batch["block"], batch["total"])]
                yield batch

        counted = _spread(rows, "total", "block").mapInPandas(count, "total long, n_max long, ns array<long>, block long, kept long")
        counted = checkpoint(counted)
        short = counted.groupBy("total", "n_max").agg(F.sum("kept").alias("kept")).where(F.col("kept") < F.lit(boots) * F.col("n_max"))
        if short.isEmpty():
            break
        slack *= 8
    # one row per block of raw numbers
    before = Window.partitionBy("total").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("start", F.coalesce(F.sum("kept").over(before), F.lit(0)))


def draw_indices(sizes: DataFrame, boots: int, seed: int, chunk: int = RAW_BLOCK) -> DataFrame:
    """(total, n, boot, k, idx, part) rows of numpy's stream for every (total, n) pair, drawn by many tasks."""
    placed = _placed_blocks(sizes, boots, seed, chunk)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for total, ns, block, start in batch[["total", "ns", "block", "start"]].itertuples(index=False):
                idx = twister.accepted(seed, block, chunk, total)
                at = start + np.arange(len(idx))
                for n in ns:
                    asked = at < boots * n
                    for cut in range(0, int(asked.sum()), STEP):
                        a = at[asked][cut : cut + STEP]
                        yield pd.DataFrame({"total": total, "n": n, "boot": a // n, "k": a % n, "idx": idx[asked][cut : cut + STEP], "part": a // PART})

    return _spread(placed, "total", "block").mapInPandas(draw, "total long, n long, boot long, k long, idx long, part long")


def _numpy_draws(groups: DataFrame, boots: int, seed: int) -> DataFrame:
    draws = draw_indices(groups.select("total", "n").distinct(), boots, seed)
    return _in_parts(groups, boots).join(draws, ["total", "n", "part"])


def _in_parts(groups: DataFrame, boots: int) -> DataFrame:
    """A row per part of a group's draws, so that the draws of one size are spread over tasks."""
    return groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.lit(boots) * F.col("n") - 1) / PART))))


def counter_draws(groups: DataFrame, boots: int, seed: int) -> DataFrame:
    """Indices that follow from seed, sizes and place alone, by md5: any task, or SQL, draws any of them."""
    parts = _in_parts(groups, boots)
    parts = _spread(parts, *parts.columns)
    last = F.least((F.col("part") + 1) * PART, F.lit(boots) * F.col("n")) - 1
    rows = parts.withColumn("at", F.explode(F.sequence(F.col("part") * PART, last)))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "total", "n", "at")), 1, 12), 16, 10).cast("bigint")
    return rows.withColumns({"boot": F.floor(F.col("at") / F.col("n")), "k": F.col("at") % F.col("n"), "idx": drawn % F.col("total")}).drop("at")


def _joined_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], has_votes: bool, boots: int, seed: int, draws: Callable) -> DataFrame:
    placed = position_in_group(rows.drop("group_n"), keys, order, "idx").withColumnRenamed("group_n", "total")
    groups = placed.groupBy(*keys).agg(F.first("total").alias("total")).withColumn("n", F.explode(ladder_column(F.col("total"))))
    # Spark sizes the draws by the few rows they are exploded from, and would broadcast them through the driver
    picked = draws(groups, boots, seed).drop("total", "part").hint("merge").join(placed.drop("total").hint("merge"), [*keys, "idx"])
    per_boot = picked.groupBy(*keys, "n", "boot").agg(F.max("val").alias("best"), F.min("val").alias("worst"))
    names = ["best", "worst"]
    if has_votes:
        votes = picked.groupBy(*keys, "n", "boot", "vote").agg(
            F.count(F.lit(1)).alias("c"), F.min("k").alias("k0"), F.min_by("val", "k").alias("v")
        )
        maj = votes.groupBy(*keys, "n", "boot").agg(F.max_by("v", F.struct("c", -F.col("k0"))).alias("maj"))
        per_boot = per_boot.join(maj, [*keys, "n", "boot"])
        names.append("maj")
    return _over_boots(per_boot, keys, names)


def _over_boots(per_boot: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    stats = per_boot.groupBy(*keys, "n").agg(
        *[f(c).alias(f"{c}/{s}") for c in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    )
    long = stats.unpivot([*keys, "n"], [f"{c}/{s}" for c in names for s in ("mean", "std")], "m", "value")
    part = F.split("m", "/")
    return long.select(*keys, "n", F.concat(part[0], F.lit("@"), F.col("n").cast("string"), F.lit("/"), part[1]).alias("metric"), "value")


def _numpy_stream(seed: int, block: int, skip: int, total: int) -> Callable[[int], np.ndarray]:
    """What numpy's stream of ``total`` keeps from a raw block on, less its first ``skip`` numbers; called for the next ``m``."""
    gen, mask, left = twister.generator(seed, block * RAW_BLOCK), np.uint32((1 << (total - 1).bit_length()) - 1), np.empty(0, np.uint32)

    def take(m: int) -> np.ndarray:
        nonlocal left
        parts, have = [left], len(left)
        while have < m:
            raw = gen.randint(0, 1 << 32, size=STEP, dtype=np.uint32) & mask
            parts.append(raw[raw < total])
            have += len(parts[-1])
        found = np.concatenate(parts)
        left = found[m:]
        return found[:m]

    for at in range(0, skip, STEP):
        take(min(STEP, skip - at))
    return take


def _counter_stream(seed: int, total: int, n: int, at: int) -> Callable[[int], np.ndarray]:
    """The numbers of ``counter_draws`` from place ``at`` on: the first 48 bits of each digest."""
    head, place = hashlib.md5(f"{seed}|{total}|{n}|".encode()), at

    def one(i: int) -> bytes:
        h = head.copy()
        h.update(b"%d" % i)
        return h.digest()

    def take(m: int) -> np.ndarray:
        nonlocal place
        digests = b"".join(map(one, range(place, place + m)))
        place += m
        return ((np.frombuffer(digests, ">u8")[::2] >> 16) % total).astype(np.int64)

    return take


def _winners(codes: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Per resample, the row of the first occurrence of its most frequent vote; ties go to the earlier vote."""
    boots, n = idx.shape
    k = int(codes.max()) + 1
    flat = (codes[idx] + k * np.arange(boots)[:, None]).ravel()
    if k <= 4 * n:
        count = np.bincount(flat, minlength=boots * k)
        first = np.zeros(boots * k, np.int64)
        first[flat[::-1]] = np.arange(boots * n)[::-1]  # the last one written, the first drawn, stays
        cell = np.flatnonzero(count)
        count, first = count[cell], first[cell]
    else:  # more kinds of votes than draws
        cell, first, count = np.unique(flat, return_index=True, return_counts=True)
    boot = cell // k
    order = np.lexsort((first, -count, boot))
    at = first[order[np.unique(boot[order], return_index=True)[1]]]
    return idx.ravel()[at]


def _extremes(vals: np.ndarray, missing: np.ndarray | None, idx: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Largest and smallest value per resample, each with what is null; nulls are passed over and NaN is above all numbers."""
    drawn = vals[idx]
    none = np.zeros(len(idx), bool)
    if missing is None:
        return [(drawn.max(axis=1), none), (drawn.min(axis=1), none)]
    gone = missing[idx]
    none, number = gone.all(axis=1), ~np.isnan(drawn) & ~gone
    best, worst = np.where(gone, -np.inf, drawn).max(axis=1), np.where(number, drawn, np.inf).min(axis=1)
    return [(best, none), (np.where(number.any(axis=1), worst, np.nan), none)]


def _block_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], has_votes: bool, boots: int, seed: int, generator: str) -> DataFrame:
    """Groups whose arrays fit a task: every task holds one group and draws and reduces a share of its resamples."""
    fields = ["val", "vote"] if has_votes else ["val"]
    packed = rows.groupBy(*keys).agg(F.first("group_n").alias("total"), F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("s"))
    arrays = [F.col("s.val").alias("vals")]
    if has_votes:

        @F.pandas_udf("array<int>")
        def coded(votes: pd.Series) -> pd.Series:
            # a missing vote is a vote like any other
            return pd.Series([pd.factorize(np.asarray(v, dtype=object), use_na_sentinel=False)[0].astype("int32") for v in votes], dtype=object)

        arrays.append(coded(F.col("s.vote")).alias("codes"))
    sizes = rows.groupBy(*keys).agg(F.first("group_n").alias("total")).select("total").distinct()
    groups = packed.select(*keys, "total", *arrays)
    step = F.greatest(F.floor(F.lit(SHARE[generator]) / F.col("n")), F.lit(1)).cast("bigint")
    if generator == "numpy":
        blocks = _placed_blocks(sizes.withColumn("n", F.explode(ladder_column(F.col("total")))), boots, seed, RAW_BLOCK)
        # boots * 2 * block_limit / RAW_BLOCK places at most
        groups = groups.join(blocks.groupBy("total").agg(F.collect_list(F.struct("start", "block")).alias("_blocks")), "total")
    # the few numbers of a share are found before the arrays are repeated beside them
    shares = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(boots - 1).cast("bigint"), step), lambda b: F.struct(b.alias("b0"), F.least(b + step, F.lit(boots)).alias("b1")))
    pieces = groups.withColumn("n", F.explode(ladder_column(F.col("total")))).withColumn("_b", F.explode(shares))
    pieces = pieces.withColumns({"b0": F.col("_b.b0"), "b1": F.col("_b.b1")}).drop("_b")
    if generator == "numpy":
        pieces = pieces.withColumn("at", F.array_max(F.filter("_blocks", lambda s: s["start"] <= F.col("b0") * F.col("n")))).drop("_blocks")

    def one(row: dict, vals: np.ndarray, missing: np.ndarray | None, codes: np.ndarray | None) -> dict:
        n, total, b0, b1 = (row[c] for c in ("n", "total", "b0", "b1"))
        if generator == "numpy":
            take = _numpy_stream(seed, row["at"]["block"], b0 * n - row["at"]["start"], total)
        else:
            take = _counter_stream(seed, total, n, b0 * n)
        found: dict[str, list] = {"best": [], "worst": [], "maj": []}
        some = max(STEP // n, 1)
        for b in range(b0, b1, some):
            idx = take((min(b + some, b1) - b) * n).reshape(-1, n)
            for name, pair in zip(("best", "worst"), _extremes(vals, missing, idx)):
                found[name].append(pair)
            if codes is not None:
                at = _winners(codes, idx)
                found["maj"].append((vals[at], np.zeros(len(at), bool) if missing is None else missing[at]))
        return {name: pa.array(np.concatenate([v for v, _ in x]), mask=np.concatenate([m for _, m in x])) for name, x in found.items() if x}

    names = ["best", "worst", "maj"] if has_votes else ["best", "worst"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = [*keys, "n"]
        for batch in batches:
            facts = batch.select([c for c in batch.schema.names if c not in (*keys, "vals", "codes")]).to_pylist()
            ready, places = [], []

            def flush() -> pa.RecordBatch:
                cols = batch.select(small).take(pa.array(np.concatenate(places))).columns
                cols += [pa.concat_arrays([r[c] for r in ready]) for c in names]
                return pa.RecordBatch.from_arrays(cols, names=[*small, *names])

            for i, row in enumerate(facts):
                listed = batch.column("vals")[i].values
                vals = listed.to_numpy(zero_copy_only=False)
                gone = listed.is_null().to_numpy(zero_copy_only=False)
                missing = gone if np.isnan(vals).any() or gone.any() else None
                codes = batch.column("codes")[i].values.to_numpy(zero_copy_only=False) if has_votes else None
                ready.append(one(row, vals, missing, codes))
                places.append(np.full(len(ready[-1]["best"]), i))
                if sum(map(len, places)) >= STEP >> 3:
                    yield flush()
                    ready, places = [], []
            if ready:
                yield flush()

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long", *[f"{c} double" for c in names]])
    return _over_boots(_spread(pieces, *keys, "n", "b0").mapInArrow(run, schema), keys, names)


def bootstrap(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    vote: str | None = None,
    boots: int = 1000,
    seed: int = 42,
    array_limit: int = ARRAY_LIMIT,
    block_limit: int = BLOCK_LIMIT,
    hot_rows: int | None = None,
    generator: str = "numpy",
) -> DataFrame:
    """(keys, n, metric, value): best/worst/majority at every ladder size, mean and std over resamples.

    ``generator``: numpy's numbers, or ``counter`` (see ``counter_draws``), where no number depends on another.
    """
    cols = [*[F.col(k) for k in keys], *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).cast("double").alias("val")]
    if vote is not None:
        cols.append(F.col(vote).alias("vote"))
    names = [f"_o{i}" for i in range(len(order))]
    sized = join_group_stats(samples.select(*cols), keys, [], hot_rows).where("group_n > 1")
    options = keys, names, vote is not None, boots, seed
    block, large = sized.where(F.col("group_n") <= block_limit), sized.where(F.col("group_n") > block_limit)
    if generator == "counter":
        for k in keys:  # the SQL joins its draws on the keys
            block = block.where(F.col(k).isNotNull())
        return _block_groups(block, *options, "counter").unionByName(_joined_groups(large, *options, counter_draws))
    block = block.where(F.col("group_n") > array_limit)
    large = large.where(F.col("group_n") > array_limit)
    small = sized.where(F.col("group_n") <= array_limit)
    packed = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names, *[c for c in ("val", "vote") if c in small.columns]))).alias("s"))
    few = _small_groups(packed, keys, vote is not None, boots, seed)
    return few.unionByName(_block_groups(block, *options, "numpy")).unionByName(_joined_groups(large, *options, _numpy_draws))


def measured(samples: DataFrame, values: Sequence[str]) -> list[str]:
    """The variables that hold numbers (or truth values)."""
    kinds = dict(samples.dtypes)
    return [v for v in values if kinds[v].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean"))]


def prompt_statistics(samples: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, var, metric, value): mean@N per group and, for more than one sample, population std@N.

    Variables of text are skipped, and so is a variable that a group has no value of.
    """
    values = measured(samples, values)
    if not values:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("var", "string"), ("metric", "string"), ("value", "double"))]
        return samples.select(*keys, *none).limit(0)
    agg = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("N"),
        *[f(F.col(v).cast("double")).alias(f"{v}|{s}") for v in values for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))],
    )
    long = agg.unpivot([*keys, "N"], [f"{v}|{s}" for v in values for s in ("mean", "std")], "m", "value")
    part = F.split("m", r"\|")
    out = long.where("value IS NOT NULL").where((part[1] == "mean") | (F.col("N") > 1))
    return out.select(*keys, part[0].alias("var"), F.concat(part[1], F.lit("@"), F.col("N").cast("string")).alias("metric"), "value")


def validation_metrics(
    samples: DataFrame,
    source: str,
    uid: str,
    order: Sequence[str],
    values: Sequence[str],
    vote: str | None = None,
    **kw,
) -> DataFrame:
    """(source, var, metric, value): every per-prompt metric averaged over the source's prompts."""
    per_prompt = prompt_statistics(samples, [source, uid], values)
    for v in measured(samples, values):
        drawn = bootstrap(samples, [source, uid], order, v, vote, **kw)
        per_prompt = per_prompt.unionByName(drawn.select(source, uid, F.lit(v).alias("var"), "metric", "value"))
    return per_prompt.groupBy(source, "var", "metric").agg(F.avg("value").alias("value"))


def name_metrics(metrics: DataFrame, source: str) -> DataFrame:
    """Add ``name``: val-core for mean/maj/best at the largest n of the core variable, else val-aux.

    The core variable is ``acc`` where a source has it, else ``reward``; the size test is a substring test.
    """
    size = F.regexp_extract("metric", r"@(\d+)", 1).cast("long")
    per_var = metrics.groupBy(source, "var").agg(F.max(size).alias("n_max"))
    has_acc = metrics.groupBy(source).agg(F.bool_or(F.col("var") == "acc").alias("has_acc"))
    joined = metrics.join(per_var, [source, "var"]).join(has_acc, source)
    core = (
        (F.col("var") == F.when(F.col("has_acc"), "acc").otherwise("reward"))
        & F.rlike("metric", F.lit("^(mean|maj|best)"))
        & F.contains("metric", F.concat(F.lit("@"), F.col("n_max").cast("string")))
    )
    name = F.concat_ws("/", F.when(core, "val-core").otherwise("val-aux"), F.col(source).cast("string"), "var", "metric")
    return joined.withColumn("name", name).drop("n_max", "has_acc")


def offline_scores(df: DataFrame, source: str, scores: str) -> DataFrame:
    """Mean over rows of each row's mean response score, per source (a mean of means)."""
    row_mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    return df.groupBy(source).agg(F.avg(row_mean).alias("test_score"))


def merge_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two result sets; a variable only one of them has is NULL in the other's rows."""
    return a.unionByName(b, allowMissingColumns=True)
