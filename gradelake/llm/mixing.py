"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Every source has a target. ``blocks = targets / block words`` seats are given to the sources by the highest quotients
``target / (2 k + 1)``, and each source's seats to its shards (seeded parts of its documents, small enough for one
sort) by the same rule with the shards' sizes. In a shard the documents stand in seeded order and their words are cut
into equal blocks; a quota of q seats over n blocks takes every block q div n times and q mod n blocks once more,
spread evenly from a seeded start. A document's share follows from its first and last word in closed form, so no block
is ever a row.

Quotients are not listed one by one: two divisors that give surely too few and surely too many seats leave at most
a few open quotients per party, and only those are ranked.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; equal
rows are taken independently or alike, their words being interchangeable; a source of size 0 has target 0; an empty
table gives no rows; other columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm import common as C

WEIGHTS = (5.0, 2.0, 1.0)
#: A target stops at so many times the size of its source, and no word is taken more often.
REPEATS = 3
BLOCK_WORDS = 16
SEED = 17
#: Shards: about so many over all sources, but never more than SHARD_ROWS documents in one.
SHARDS = 512
SHARD_ROWS = 200_000
#: Up to so many sources the table of sources is broadcast; beyond it Spark joins by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    """Words of a text: the pieces between blanks that are not empty."""
    blanks = F.translate(F.coalesce(F.col(text), F.lit("")), C.BLANKS, " " * len(C.BLANKS))
    return F.size(F.array_remove(F.split(blanks, " "), "")).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size), one row per source.

    The weighted shares of all words, stopped at ``repeats`` times the source's size; what is cut off is shared again by
    weight until none is above. That has one solution: with sources in order of size / weight, the first ones stop and
    the others share the rest, so running sums over one row per source give it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    rows = rows.withColumn("stop", F.lit(float(repeats)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "stopped": F.coalesce(F.sum("stop").over(by_ratio), F.lit(0.0)),
            "light": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)),
        }
    )
    # the level at which this source and all after it share what the sources before leave
    rows = rows.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("light"))
    rows = rows.withColumn("open", F.col("level") * F.col("weight") <= F.col("stop"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level"))))
    rows = rows.withColumn("final", level.over(everything)["level"])
    share = F.least(F.col("stop"), F.coalesce(F.col("final") * F.col("weight"), F.col("stop")))
    return rows.select("source", "source_size", "source_rows", "weight", share.alias("target"))


def apportion(parties: DataFrame, house: str, votes: str, limit: str, group: Sequence[str], order: Sequence[Column], seats: str) -> DataFrame:
    """Sainte-Lague seats per party: ``house`` seats of each group by the highest quotients votes / (2 k + 1).

    No party gets more than ``limit``. A divisor that gives at most ``house`` seats in all, whatever the rounding, fixes
    the sure seats; one that gives at least as many bounds the open ones; their quotients are ranked.
    """
    whole = Window.partitionBy(*group)
    n, v = F.count(F.lit(1)).over(whole), F.sum(votes).over(whole).cast("double")
    rows = parties.withColumns({"n_": n, "v_": v})

    def rounded(divisor: Column) -> Column:
        return F.least(F.col(limit), F.coalesce(F.floor(F.col(votes) / divisor + 0.5), F.lit(0))).cast("bigint")

    few = F.col(house) - F.col("n_") / 2.0 - 1
    rows = rows.withColumns(
        {
            "sure_": F.when(few > 0, rounded(F.col("v_") / few)).otherwise(F.lit(0).cast("bigint")),
            "most_": F.when(F.col("v_") > 0, rounded(F.col("v_") / (F.col(house) + F.col("n_") + 1))).otherwise(F.lit(0).cast("bigint")),
        }
    )
    rows = rows.withColumn("open_", F.col(house) - F.sum("sure_").over(whole))
    each = rows.withColumn("k_", F.explode_outer(F.when(F.col("most_") > F.col("sure_"), F.sequence(F.col("sure_"), F.col("most_") - 1))))
    best = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("k_") + 1)).desc_nulls_last(), *order, F.col("k_"))
    won = F.col("k_").isNotNull() & (F.row_number().over(best) <= F.col("open_"))
    each = each.withColumn("won_", won.cast("bigint"))
    names = [c for c in parties.columns]
    return each.groupBy(*names, "sure_").agg(F.sum("won_").alias("won_")).select(*names, (F.col("sure_") + F.col("won_")).alias(seats))


def _shares(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(``keys``, size, source, source_size, target, taken, shard, draw) for every document."""
    sized = docs.select(*keys, "source", word_count().alias("size"), F.xxhash64(F.lit(seed), *keys, "text").alias("draw"))
    sized = C.written(sized, "sizes")
    n_rows, n_words = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows_each = max(64, min(SHARD_ROWS, n_rows // SHARDS))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sources = targets(sources, weights, repeats).withColumns(
        {
            "house": F.lit(n_words // block_words).cast("bigint"),
            "limit": (repeats * F.ceil(F.col("source_size") / block_words)).cast("bigint"),
            "n_shards": F.ceil(F.col("source_rows") / rows_each).cast("bigint"),
        }
    )
    seats = apportion(sources, "house", "target", "limit", [], [F.col("source").asc_nulls_last()], "source_blocks")
    seats = C.written(seats.drop("house", "limit"), "seats").withColumnRenamed("source", "source_")
    # one row per source, counted here
    small = F.broadcast(seats) if seats.count() <= BROADCAST_SOURCES else seats
    placed = sized.join(small, sized["source"].eqNullSafe(seats["source_"]))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("draw"), "n_shards"))
    shards = placed.groupBy("source", "shard", "source_blocks").agg(F.sum("size").alias("shard_size"))
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / block_words).cast("bigint"))
    shards = shards.withColumn("limit", repeats * F.col("n_blocks"))
    quotas = apportion(shards, "source_blocks", "shard_size", "limit", ["source"], [F.col("shard")], "quota")
    quotas = C.written(quotas.select(F.col("source").alias("of_"), F.col("shard").alias("shard_"), "n_blocks", "quota"), "quotas")
    rows = placed.join(quotas, placed["source"].eqNullSafe(quotas["of_"]) & (placed["shard"] == quotas["shard_"]))
    seeded = Window.partitionBy("source", "shard").orderBy("draw", *keys, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("to_", F.sum("size").over(seeded))
    blocks = F.greatest("n_blocks", F.lit(1))
    rows = rows.withColumns(
        {
            "all_": ((F.col("quota") - F.pmod("quota", blocks)) / blocks).cast("bigint"),
            "more_": F.pmod("quota", blocks),
            "n_": blocks,
            "turn_": F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), blocks),
        }
    )

    def whole(a: Column, b: Column) -> Column:
        return ((a - F.pmod(a, b)) / b).cast("bigint")

    def drawn(block: Column) -> Column:
        """Blocks before ``block`` that are taken once more."""
        return whole((block + F.col("turn_")) * F.col("more_"), F.col("n_")) - whole(F.col("turn_") * F.col("more_"), F.col("n_"))

    def taken(word: Column) -> Column:
        """Words taken of the first ``word`` words of the shard."""
        block = whole(word, F.lit(block_words))
        part = F.pmod(word, F.lit(block_words)) * (drawn(block + 1) - drawn(block))
        return F.col("all_") * word + block_words * drawn(block) + part

    took = (taken(F.col("to_")) - taken(F.col("to_") - F.col("size"))).cast("bigint")
    return rows.select(*keys, "size", "source", "source_size", "target", took.alias("taken"), "shard", "draw")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(``keys``, size, source, source_size, target, taken) for every document."""
    return _shares(docs, weights, repeats, block_words, seed, keys).drop("shard", "draw")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mix as documents: each row as often as its words are taken on average, rounded along each shard.

    In a shard the documents stand by size, and the running sum of what they are taken is rounded from a seeded start, so
    each is taken the whole number of times below or above its share. Rounding errors of neighbours, alike in size, cancel:
    the words of a shard are off by at most its largest document.
    """
    key = ["doc_id", "row_"]
    shares = _shares(docs.select("doc_id", "source", "text", C.row_key().alias("row_")), weights, repeats, seed=seed, keys=key)
    often = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1.0))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.lit(1 << 20)) / float(1 << 20)
    by_size = Window.partitionBy("source", "shard").orderBy("size", "draw", *key)
    shares = shares.withColumn("often", often)
    shares = shares.withColumn("sum_", start + F.sum("often").over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the difference of rounded sums; the bound only meets errors of floating point
    step = F.floor("sum_") - F.floor(F.coalesce(F.lag("sum_").over(by_size), start))
    times = shares.select(*key, F.least(step, F.lit(repeats)).cast("int").alias("times"))
    # equal rows have equal keys and get the mean of their times
    times = times.groupBy(*key).agg(F.round(F.avg("times")).cast("int").alias("times")).where("times > 0")
    times = C.written(times.select(F.col("doc_id").alias("mix_id"), F.col("row_").alias("mix_row"), "times"), "times")
    held = C.Held(docs)
    rows = held.docs.withColumns({"own_id": held.col("doc_id"), "own_row": C.row_key(held.col("doc_id"), held.col("text"))})
    found = rows.join(times, C.same_row(rows, times, ["own_id", "own_row"], ["mix_id", "mix_row"]))
    return held.back(found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))))
