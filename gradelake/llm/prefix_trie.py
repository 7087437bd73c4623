"""The prefix trie of conversations, by collapsing whole sequences.

Identical conversations are grouped first, into weighted sequences with the list of the conversations that end there.
Sequences that are proper prefixes of others are dropped by an anti-join, which leaves the leaves; then only the
prefixes of distinct sequences are aggregated, each with its sequence's weight. The texts never move: a turn is the
SHA-256 of its role and text, and a prefix is 128 bits that its turns, hashed with their places, are combined to.

No step holds a group. Turns are numbered by range partitions, so one conversation may fill many tasks; running
combinations are taken in blocks of BLOCK turns with one row per block between them; end lists are written in chunks of
CHUNK ids, and one list may run over many tasks; parents with many children are joined by broadcast, and their number
is bounded by HOT.

Saved text below a node needs no row per node and ancestor. With T(s) the code points of a sequence s of weight w, c the
code points before the node, and U(s) those of the nodes of which s has the smallest member, the saving below a node is
the sum over the sequences through it of w (T - c) - U, after the node's own sequence is corrected for what lies above.

Defined cases: a null role or text is an empty one; a null turn comes first; turns of one place are ordered by their
SHA-256, and repeated rows are turns of their own; rows without conv_id belong to no conversation; texts of any length
count whole; other columns are ignored; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm import common as C

#: Turns of one conversation that are combined in one step.
BLOCK = 4096
#: Ids of one chunk of an end list.
CHUNK = 4096
#: Nodes that are joined to their children by broadcast: at most so many.
HOT = 100_000
#: Children from which a node may be one of them.
HOT_CHILDREN = 1024
#: Conversations that share a stem, and the most turns they take from it.
GROUP = 100
STEM_TURNS = 6

_FIRST = ["a", "b", "depth"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, turn_hash, chars) of every turn with a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn_hash = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn_hash.alias("turn_hash"), F.char_length(text).cast("bigint").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_hash")]
    # equal rows are dealt alike, whatever their number, so a part of the order is known by its number alone
    rows = C.written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    within = Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_hash")
    rows = rows.withColumn("within", F.row_number().over(within))
    sizes = rows.groupBy("part", "conv_id").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a part goes on with one conversation at most: one row per part
    before = sizes.withColumn("before", F.sum("size").over(earlier)).where("before > 0").select("part", "conv_id", "before")
    rows = rows.join(F.broadcast(before), ["part", "conv_id"], "left")
    return rows.select("conv_id", (F.col("within") + F.coalesce("before", F.lit(0))).alias("place"), "turn_hash", "chars")


def _block(place: Column) -> Column:
    return F.floor((place - 1) / BLOCK)


def _blocks(turns: Column) -> Column:
    """A row per block of so many turns; one for none."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), _block(F.greatest(turns, F.lit(1).cast("bigint")))))


def stem_length(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(STEM_TURNS))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, place, turn_hash, chars), and all conversations (conv_id).

    Each begins with as many first turns of its group's first conversation as its id says, and goes on with its own
    turns after as many of them.
    """
    turns = C.written(turns, "numbered")
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("turns"))
    stems = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < STEM_TURNS)).withColumnRenamed("conv_id", "stem")
    plan = convs.withColumn("skipped", stem_length(F.col("conv_id"))).withColumn("stem", F.col("conv_id") - F.col("conv_id") % GROUP)
    # at most STEM_TURNS rows a stem
    had = stems.groupBy("stem").agg(F.count("*").alias("had"))
    taken = plan.join(stems, "stem").where("place <= skipped").select("conv_id", "place", "turn_hash", "chars")
    plan = plan.join(had, "stem", "left").select("conv_id", "turns", "skipped", F.least("skipped", F.coalesce("had", F.lit(0))).alias("put"))
    # a row per block of a conversation, so that a long one is joined by many tasks
    own = C.written(plan.select("conv_id", "skipped", "put", _blocks(F.col("turns")).alias("block")), "plan")
    own = turns.withColumn("block", _block(F.col("place"))).join(own, ["conv_id", "block"]).where("place > skipped")
    own = own.select("conv_id", (F.col("place") - F.col("skipped") + F.col("put")).alias("place"), "turn_hash", "chars")
    return taken.unionByName(own), convs.select("conv_id")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds ``ha`` and ``hb``, 128 bits of a turn at its place, and its block."""
    return rows.withColumns(
        {
            "ha": F.xxhash64(F.lit(1), "place", "turn_hash"),
            "hb": F.xxhash64(F.lit(2), "turn_hash", "place"),
            "block": _block(F.col("place")),
        }
    )


def sequences(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted sequences (a, b, depth, chars, conv_id, weight), and the end (a, b, depth, conv_id) of each conversation."""
    made = rows.groupBy("conv_id").agg(F.bit_xor("ha").alias("a"), F.bit_xor("hb").alias("b"), F.count("*").alias("depth"), F.sum("chars").alias("chars"))
    nothing = F.lit(0).cast("bigint")
    ends = convs.join(made, "conv_id", "left").select("conv_id", *[F.coalesce(c, nothing).alias(c) for c in ("a", "b", "depth", "chars")])
    ends = C.written(ends, "ends")
    return C.written(ends.groupBy(*_FIRST, "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")), "sequences"), ends


def prefixes(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """A row per prefix of each distinct sequence, the empty one included: (conv_id, block, a, b, depth, pa, pb, before, last, weight, total)."""
    kept = seqs.select("conv_id", "weight", F.col("chars").alias("total"), F.col("depth").alias("turns"), _blocks(F.col("depth")).alias("block"))
    rows = rows.join(kept, ["conv_id", "block"])
    # sums of the blocks of long sequences, one row per block
    sums = rows.where(F.col("turns") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"), F.sum("chars").alias("more"))
    all_before = Window.partitionBy("conv_id").orderBy("block")
    sums = sums.select("conv_id", (F.col("block") + 1).alias("block"), *[f(c).over(all_before).alias(c) for f, c in ((F.bit_xor, "xa"), (F.bit_xor, "xb"), (F.sum, "more"))])
    so_far = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"a": F.bit_xor("ha").over(so_far), "b": F.bit_xor("hb").over(so_far), "upto": F.sum("chars").over(so_far)})
    rows = rows.join(sums, ["conv_id", "block"], "left")
    nothing = F.lit(0).cast("bigint")
    a, b = (F.col(c).bitwiseXOR(F.coalesce(x, nothing)) for c, x in (("a", "xa"), ("b", "xb")))
    rows = rows.select(
        "conv_id", "block", a.alias("a"), b.alias("b"), F.col("place").cast("bigint").alias("depth"), a.bitwiseXOR(F.col("ha")).alias("pa"), b.bitwiseXOR(F.col("hb")).alias("pb"),
        (F.col("upto") + F.coalesce("more", nothing) - F.col("chars")).alias("before"), F.col("chars").alias("last"), "weight", "total",
    )
    none = F.lit(None).cast("bigint")
    empty = seqs.select(
        "conv_id", nothing.alias("block"), nothing.alias("a"), nothing.alias("b"), nothing.alias("depth"), none.alias("pa"), none.alias("pb"),
        nothing.alias("before"), nothing.alias("last"), "weight", F.col("chars").alias("total"),
    )
    return C.written(rows.unionByName(empty), "prefixes")


def leaves(seqs: DataFrame, steps: DataFrame) -> DataFrame:
    """The sequences that are no proper prefix of another."""
    inner = steps.where("depth > 0").select(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth")).distinct()
    return seqs.join(inner, _FIRST, "left_anti")


def nodes(steps: DataFrame, seqs: DataFrame) -> DataFrame:
    """Trie nodes (a, b, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved)."""
    # which nodes a sequence has the smallest member of: those from some depth on
    first = steps.groupBy(*_FIRST).agg(F.min("conv_id").alias("conv_id"), F.min("before").alias("before"))
    own = first.groupBy("conv_id").agg(F.min("before").alias("own_before"))
    ends = seqs.join(own, "conv_id", "left").join(leaves(seqs, steps).select("conv_id", F.lit(1).alias("leaf")), "conv_id", "left")
    per_seq = ends.select(
        "conv_id",
        F.coalesce(F.col("chars") - F.col("own_before"), F.lit(0)).alias("own"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
        _blocks(F.col("depth")).alias("block"),
    )
    below = F.col("total") - F.col("before")
    made = (
        steps.join(per_seq, ["conv_id", "block"])
        .groupBy(*_FIRST)
        .agg(
            F.min_by("own", "conv_id").alias("own"),
            F.min_by("total", "conv_id").alias("total"),
            F.min("conv_id").alias("first_id"),
            F.sum("weight").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("weight") * below - F.col("own")).alias("saved"),
            F.min("before").alias("before"),
            F.min("pa").alias("pa"),
            F.min("pb").alias("pb"),
        )
    )
    # the first sequence counts its own nodes below this one only
    saved = F.col("saved") + F.col("own") - (F.col("total") - F.col("before"))
    made = C.written(made.select(*_FIRST, F.col("first_id").alias("conv_id"), "n_convs", "n_leaves", saved.alias("saved"), "pa", "pb"), "nodes")
    above = made.where("depth > 0").select(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth"))
    made = made.join(above.groupBy(*_FIRST).agg(F.count("*").alias("n_children")), _FIRST, "left").fillna(0, ["n_children"])
    return _with_parents(C.written(made, "nodes"))


def _with_parents(made: DataFrame) -> DataFrame:
    """Adds the parent's conv_id. The few nodes with the most children are broadcast, so no join has a large group."""
    many = max(HOT_CHILDREN, made.count() // HOT)
    parents = made.where("n_children > 0").select(
        F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    keys = ["pa", "pb", "depth"]
    # children of these are at least ``many`` each, and all nodes are at most HOT times that: at most HOT rows
    hot = parents.where(F.col("n_children") > many).drop("n_children").withColumnRenamed("parent_conv_id", "hot_parent")
    rows = made.join(F.broadcast(hot), keys, "left")
    known = rows.where("hot_parent IS NOT NULL OR pa IS NULL").withColumnRenamed("hot_parent", "parent_conv_id")
    others = rows.where("hot_parent IS NULL AND pa IS NOT NULL").drop("hot_parent")
    return known.unionByName(others.join(parents.drop("n_children"), keys, "left"))


def end_lists(ends: DataFrame) -> DataFrame:
    """The conversations that end at each node, in chunks: (a, b, depth, first, conv_ids), ascending within and over chunks."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((*node, ids[0], ids.copy()))
                ids.clear()

        for batch in batches:
            for *key, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node or len(ids) == CHUNK:
                    close()
                    node = key
                ids.append(conv_id)
            if sum(len(row[-1]) for row in out) >= CHUNK:
                yield _chunk_batch(out)
                out.clear()
        close()
        if out:
            yield _chunk_batch(out)

    order = [*_FIRST, "conv_id"]
    rows = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(chunks, "a bigint, b bigint, depth bigint, first bigint, conv_ids array<bigint>")


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*_FIRST, "first", "conv_ids"])


def list_digests(lists: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256): SHA-256 of each end list in decimal, comma-joined; a list is streamed chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sum_ = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if node is not None:
                        out.append((*node, sum_.hexdigest()))
                    node, sum_ = key, hashlib.sha256()
                else:
                    sum_.update(b",")
                sum_.update(",".join(map(str, ids)).encode())
            if out:
                yield _digest_batch(out)
        if node is not None:
            yield _digest_batch([(*node, sum_.hexdigest())])

    rows = lists.repartition(*_FIRST).sortWithinPartitions(*_FIRST, "first").select(*_FIRST, "conv_ids")
    return rows.mapInArrow(run, "a bigint, b bigint, depth bigint, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*_FIRST, "ends_sha256"])


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of the rebuilt conversations, and their end lists in chunks (see ``nodes``, ``end_lists``)."""
    rows, convs = rebuilt(numbered(conversations))
    rows = C.written(_placed(rows), "rebuilt")
    seqs, ends = sequences(rows, convs)
    return nodes(prefixes(rows, seqs), seqs), end_lists(ends)


def digests(made: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per node with the SHA-256 of its end list."""
    rows = made.join(list_digests(lists), _FIRST, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
