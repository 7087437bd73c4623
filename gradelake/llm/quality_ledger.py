"""Rule bitmask ledger: every rule is evaluated once, policies are applied to the bits afterwards.

``ledger`` reads each whole text once and stores measurements and one failure bit per rule. A policy is a named,
versioned set of rules; applying another one, or asking what a rule costs, reads the narrow ledger only.

Defined cases: a null or empty text has no words (and fails ``few_words``); rows with equal ids are judged one by one;
other columns are left alone, also when they are named like a measurement (they are not carried into the ledger).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm import common as C

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marked", "n_bare", "n_stutter"]

SYMBOLS = C.byte_table(b"#*$%&|<>")
UPPER = C.byte_table(bytes(range(0x41, 0x5B)))
LETTER = C.byte_table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
MARK = C.byte_table(b"!?#*$%&|<>=~^_@{}[]")
CONTINUES = C.byte_table(bytes(range(0x80, 0xC0)))
WINDOW = 5

#: Bit i of the ledger is the i-th rule. A rule is a condition on the measurements, written so that it is never null.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines",
    "shouting": "n_letters > 0 and 2 * n_upper > n_letters",
    "marked_words": "10 * n_marked > 2 * n_words",
    "bare_words": "n_bare > 5 and 10 * n_bare > 3 * n_words",
    "stutter": "n_stutter > 2 and 10 * n_stutter > 3 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 25 * n_words",
}

#: Policies by name and version; a later version never changes what an earlier one means.
POLICIES: dict[str, tuple[str, ...]] = {
    "base@1": ("few_words", "repeats"),
    "web@1": ("few_words", "repeats", "symbols", "same_lines", "word_length"),
    "web@2": ("few_words", "repeats", "symbols", "same_lines", "word_length", "shouting", "marked_words", "bare_words", "stutter"),
}
CURRENT = "web@2"


def measure(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The measurements of a batch, in the order of ``MEASURES``."""
    text = batch.column("text")
    data, offsets = C.text_bytes(text)
    docs = len(text)
    begin, end, doc = C.spans(data, offsets, C.IN_WORD)
    n_words = np.bincount(doc, minlength=docs)
    inside = C.IN_WORD[data] & ~CONTINUES[data]
    marks, letters = MARK[data], LETTER[data] | (data >= 0x80)
    at = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    marked = at[end] - at[begin] > 0
    at = np.concatenate(([0], np.cumsum(letters, dtype=np.int64)))
    bare = at[end] == at[begin]
    word = C.span_hashes(data, begin, end)
    stutter = np.zeros(len(word), bool)
    stutter[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    hashes, first = C.grams(word, doc, WINDOW)
    twice = pd.Series(hashes ^ C.mix(doc[first].astype(np.uint64) + np.uint64(1))).duplicated(keep=False).to_numpy()
    edge = np.zeros(len(begin) + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + WINDOW, -1)
    repeated = np.cumsum(edge[:-1]) > 0
    n_lines, n_dup = np.ones(docs, np.int64), np.zeros(docs, np.int64)
    several = np.flatnonzero(C.counts_between(data == 10, offsets))
    for i in several:
        lines = text[i].as_py().split("\n")
        n_lines[i] = len(lines)
        seen = set(lines)
        if len(seen) < len(lines):
            filled = [x for x in lines if x.strip(C.BLANKS)]
            n_dup[i] = len(filled) - len(set(filled))
    return [
        n_words,
        C.counts_between(inside, offsets),
        C.counts_between(SYMBOLS[data], offsets),
        n_dup,
        np.bincount(doc[repeated], minlength=docs),
        n_lines,
        C.counts_between(UPPER[data], offsets),
        C.counts_between(LETTER[data], offsets),
        np.bincount(doc[marked], minlength=docs),
        np.bincount(doc[bare], minlength=docs),
        np.bincount(doc[stutter], minlength=docs),
    ]


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches):
        columns = [pa.array(x.astype(np.int64)) for x in measure(batch)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *MEASURES])


def ledger(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per document: ``keys`` (default the id), the measurements and ``failed``, the bits of the rules."""
    keys = ["doc_id"] if keys is None else keys
    kinds = ", ".join([*(f"`{n}` {t}" for n, t in docs.select(*keys).dtypes), *(f"{m} bigint" for m in MEASURES)])
    measured = C.map_texts(docs.select(F.col("text").alias("text"), *keys), _measures, kinds)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("bigint"))


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def passes(policy: str = CURRENT, failed: str = "failed") -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (and would stay without it), and that pass it.

    The ledger is first counted by its bits, of which there are at most two to the number of rules.
    """
    chosen = mask(policy)
    by_bits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    sums = []
    for i, name in enumerate(RULES):
        if chosen >> i & 1:
            fails = F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
            alone = F.col("bits") == 1 << i
            sums.append(
                F.struct(
                    F.lit(name).alias("rule"),
                    F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_failed"),
                    F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only_this"),
                    F.coalesce(F.sum(F.when(~fails, F.col("n"))), F.lit(0)).alias("n_passed"),
                )
            )
    return by_bits.agg(F.array(*sums).alias("rules")).select(F.inline("rules"))


def filter_documents(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass, with the columns they came with (whatever those are named)."""
    held = C.Held(docs)
    packed = held.docs.withColumn("text", held.col("text"))
    return held.back(ledger(packed, held.docs.columns).where(passes(policy)))
