"""Grouping spelling variants: words of a vocabulary that are one edit apart, by composing finite-state machines.

The vocabulary is a minimised acceptor A, E a transducer that inserts, deletes or replaces exactly one code point; the
accepted pairs of A o E o A are the near words. A state of the composition before the edit is a state of A read by both
tapes. So the composition falls into parts by the state that is reached by the first code points:

* As long as the words behind a state are too many for one task, the state is expanded: its match arcs lead to the
  states one code point further, its edit arcs to pairs whose tapes must read the same rest. The pairs of all edit arcs
  of one level are found by one grouping on prefix + rest; a group has at most one word per letter of the alphabet, and
  one without it.
* The words behind a small enough state go to one task, which builds the minimised acceptor of their rests with the
  number of words below each arc, and walks the composition from its initial state. A state's edit arcs are followed
  once, however many words lead to it; numbers on the arcs give the two words of each accepted path.

A pair is found at the first code point where its two words differ, hence once, and sums over parts are exact. Nothing is
capped: ``limit`` (code points of rests in one task, SMALL words always) only says how far states are expanded. It rises
with the vocabulary so that the table of expanded states has at most STATES rows, which bounds its broadcast.

A word's form is its near word of largest count (ties: smallest in code-point order) if that count is at least ``ratio``
times its own; its root is the last word on the way of forms, found by doubling. Counts rise along it, so it ends.

Defined cases: null and empty texts have no words; a null id counts as empty in the seeded deletions; rows that are
equal or share an id each count; words of any length are taken whole; other columns are ignored; an empty table gives no
rows. A word without near words has n_near 0, no form, and is its own root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm import common as C

#: Letters of a run, shortest word, least count, one run in so many is damaged, ratio of counts of a form.
LETTERS = "A-Za-zÀ-ÿ"
WORD_LEAST = 7
COUNT_LEAST = 2
DAMAGE = 31
RATIO = 10
#: Code points of rests that one task composes, and the words it may always have.
LIMIT = 1 << 17
SMALL = 64
#: Expanded states: at most so many rows.
STATES = 100_000
#: Code points by which the composition is always expanded, so that it spreads over the tasks.
FIRST = 2
#: Different words a task counts before it hands them on.
COUNTED = 1 << 17

_LOWER = str.maketrans({c: c + 32 for c in range(0x41, 0x5B)})


def damaged_counts(docs: DataFrame, damage: int = DAMAGE, least: int = WORD_LEAST, text: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, one in ``damage`` without one code point, of ``least`` code points.

    Which run of which document is damaged, and where, follows from the CRC-32 of ``<doc_id>:<run>``.
    """
    runs = re.compile(f"[{LETTERS}]{{{least},}}")
    crc = zlib.crc32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value:
                    continue
                found = Counter(runs.findall(value.translate(_LOWER)))
                start = crc(f"{'' if key is None else key}:".encode())
                for word in [w for w in found if crc(w.encode(), start) % damage == 0]:
                    n = found.pop(word)
                    at = crc(word.encode(), start) % len(word)
                    rest = word[:at] + word[at + 1 :]
                    if len(rest) >= least:
                        # a word of the same text may have this spelling without damage
                        seen[rest] += n
                seen.update(found)
                if len(seen) >= COUNTED:
                    yield _counts(seen)
                    seen.clear()
        if seen:
            yield _counts(seen)

    parts = C.map_texts(docs.select("doc_id", F.col(text).alias("text")), count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(seen: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


class Acceptor:
    """Minimised acceptor of sorted words. ``arcs[q]``: code point -> (state, words before it); ``final``; ``size``: words below."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        register: dict[tuple, int] = {}
        # the open path: per depth whether it ends a word, and its finished arcs
        ends, below = [False], [[]]
        last = ""

        def close(depth: int) -> None:
            while len(below) - 1 > depth:
                arcs, end = below.pop(), ends.pop()
                key = (end, tuple(arcs))
                state = register.get(key)
                if state is None:
                    state = register[key] = self._add(end, arcs)
                below[-1].append((last[len(below) - 1], state))

        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            close(same)
            for _ in word[same:]:
                ends.append(False)
                below.append([])
            ends[-1] = True
            last = word
        close(0)
        self.start = self._add(ends[0], below[0])

    def _add(self, end: bool, arcs: list[tuple[str, int]]) -> int:
        before, out = int(end), {}
        for c, state in arcs:
            out[c] = (state, before)
            before += self.size[state]
        self.arcs.append(out)
        self.final.append(end)
        self.size.append(before)
        return len(self.arcs) - 1


def compose(a: Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the two words of every accepted path of A o E o A, each pair once."""
    arcs, final = a.arcs, a.final
    met: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def same_rest(p: int, q: int, without: str | None = None) -> list[tuple[int, int]]:
        """Words that both states accept, as their numbers below either; ``without``: not those that begin so."""
        found, open_ = [], [(p, q, 0, 0, without)]
        while open_:
            p, q, i, j, skip = open_.pop()
            if final[p] and final[q]:
                found.append((i, j))
            one, two = arcs[p], arcs[q]
            if len(two) < len(one):
                for c in two:
                    if c in one and c != skip:
                        s, m = one[c]
                        t, n = two[c]
                        open_.append((s, t, i + m, j + n, None))
            else:
                for c in one:
                    if c in two and c != skip:
                        s, m = one[c]
                        t, n = two[c]
                        open_.append((s, t, i + m, j + n, None))
        return found

    def edits(q: int) -> list[tuple[int, int]]:
        """Accepted pairs whose edit is at this state."""
        found = []
        out = list(arcs[q].items())
        for k, (c, (s, m)) in enumerate(out):
            # c is deleted: the other tape stays and reads something else than c next
            found += [(m + i, j) for i, j in same_rest(s, q, c)]
            for _, (t, n) in out[k + 1 :]:
                key = (s, t) if s <= t else (t, s)
                rest = met.get(key)
                if rest is None:
                    rest = met[key] = same_rest(*key)
                found += [(m + i, n + j) if s <= t else (m + j, n + i) for i, j in rest]
        return found

    local: dict[int, list[tuple[int, int]]] = {}
    left, right = [], []
    todo = [(a.start, 0)]
    while todo:
        q, before = todo.pop()
        pairs = local.get(q)
        if pairs is None:
            pairs = local[q] = edits(q)
        for i, j in pairs:
            left.append(before + i)
            right.append(before + j)
        for s, m in arcs[q].values():
            todo.append((s, before + m))
    return np.array(left, np.int64), np.array(right, np.int64)


def _best(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of a sorted part with near words: its number, how many they are, and the number of the best one."""
    left, right = compose(Acceptor(words))
    one, two = np.concatenate((left, right)), np.concatenate((right, left))
    # largest count first, then the smallest word, which is the smallest number
    order = np.lexsort((two, -counts[two], one))
    one, two = one[order], two[order]
    begin = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1]))) if len(one) else np.empty(0, np.int64)
    return one[begin], np.diff(np.append(begin, len(one))), two[begin]


def _compose_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, skip, word, n) sorted by part and word: per word its near words within the part."""
    part, skip, words, counts = None, 0, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(words) > 1:
            n = np.array(counts, np.int64)
            one, near, best = _best([w[skip:] for w in words], n)
            if len(one):
                best_words = [words[i] for i in best.tolist()]
                arrays = [pa.array([words[i] for i in one.tolist()]), pa.array(near), pa.array(n[best]), pa.array(best_words)]
                yield pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "best_n", "best"])

    for batch in batches:
        for p, s, w, n in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                yield from done()
                part, skip, words, counts = p, s, [], []
            words.append(w)
            counts.append(n)
    yield from done()


_NEAR = "word string, n_near bigint, best_n bigint, best string"


def near_words(vocabulary: DataFrame, limit: int = LIMIT, first: int = FIRST) -> DataFrame:
    """(word, n_near, best_n, best) of each word with a near word. ``vocabulary``: distinct (word, n), no empty word."""
    vocabulary = C.written(vocabulary.select("word", "n", F.char_length("word").alias("chars")), "vocabulary")
    total = vocabulary.agg(F.sum("chars")).first()[0] or 0
    limit = max(limit, total // STATES)
    found: list[DataFrame] = []
    waiting, level = vocabulary, 0
    while True:
        if level >= first:
            prefix = F.substring("word", 1, level)
            size = waiting.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("words"), F.sum(F.col("chars") - level).alias("chars"))
            large = size.where((F.col("chars") > limit) & (F.col("words") > SMALL)).select("prefix")
            # at most total / limit rows, hence at most STATES
            large = F.broadcast(C.written(large, "states"))
            closed = waiting.join(large, prefix == large["prefix"], "left_anti")
            found.append(_small_states(closed, level))
            if large.isEmpty():
                break
            waiting = C.written(waiting.join(large, prefix == large["prefix"], "left_semi"), "expanded")
        found.append(_edits_at(waiting, level))
        level += 1
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    best = F.max_by("best", F.struct("best_n", _reversed("best")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), best.alias("best"))


def _reversed(word: str) -> F.Column:
    """A key whose largest value belongs to the smallest word in code-point order."""
    flipped = F.translate(F.hex(F.encode(word, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
    # an end mark above every digit, so that the shorter of two words with one beginning is larger
    return F.concat(flipped, F.lit("Z"))


def _small_states(words: DataFrame, level: int) -> DataFrame:
    rows = words.select(F.substring("word", 1, level).alias("part"), F.lit(level).alias("skip"), "word", "n")
    return rows.repartition("part").sortWithinPartitions("part", "word").mapInArrow(_compose_parts, _NEAR)


def _edits_at(words: DataFrame, level: int) -> DataFrame:
    """Pairs of words that first differ at code point ``level`` (from 0) and read the same after the edit there."""
    rest = F.concat(F.substring("word", 1, level), F.expr(f"substring(word, {level + 2})"))
    cut = words.where(F.col("chars") > level).select(rest.alias("key"), F.substring("word", level + 1, 1).alias("cut"), "word", "n")
    kept = words.select(F.col("word").alias("key"), F.lit(None).cast("string").alias("cut"), "word", "n")
    # one word per letter of the alphabet, and one without a letter there
    groups = cut.unionByName(kept).groupBy("key").agg(F.collect_list(F.struct("word", "n", "cut")).alias("all")).where("size(all) > 1")
    rows = groups.select(F.substring("key", level + 1, 1).alias("next"), "all", F.explode("all").alias("one"))

    def is_near(other: F.Column) -> F.Column:
        one = F.col("one")
        both = one["cut"].isNotNull() & other["cut"].isNotNull()
        return (other["word"] != one["word"]) & (both | (F.coalesce(one["cut"], other["cut"]) != F.col("next")))

    rows = rows.withColumn("near", F.filter("all", is_near)).where("size(near) > 0")
    most = F.array_max(F.transform("near", lambda x: x["n"]))
    rows = rows.select(F.col("one.word").alias("word"), F.size("near").cast("bigint").alias("n_near"), most.alias("best_n"), "near")
    best = F.array_min(F.transform(F.filter("near", lambda x: x["n"] == F.col("best_n")), lambda x: x["word"]))
    return rows.select("word", "n_near", "best_n", best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, from (word, form): the last word on its way, by doubling."""
    ways = C.written(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        next_ = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = ways.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        longer = C.written(longer, "ways")
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return ways


def group_variants(counts: DataFrame, ratio: int = RATIO, least: int = COUNT_LEAST, near: Callable[[DataFrame], DataFrame] = near_words) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of (word, n) with at least ``least`` occurrences."""
    vocabulary = C.written(counts.where(F.col("n") >= least).select("word", "n"), "words")
    met = vocabulary.join(near(vocabulary), "word", "left")
    has_form = F.col("best_n") >= ratio * F.col("n")
    rows = met.select(
        "word", F.when(has_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has_form, F.col("best_n")).alias("form_n")
    )
    rows = C.written(rows, "forms")
    ways = roots(rows.where("form IS NOT NULL"))
    return rows.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
