"""Token counts of a byte-pair tokenizer, worked out once per distinct word.

Texts are cut into words by the tokenizer's pattern on the JVM. The table of distinct words is small beside the texts;
each of its words is merged once, pair of lowest rank first, and the counts are joined back to the words of each row:
the most frequent words by broadcast (at most HOT_WORDS by construction), the others, each of which stands for no more
than one in HOT_WORDS of all words, by shuffle. No text is encoded, and no join has a large group.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.session import checkpoint

#: Fixed value: the word pattern of the byte-level tokenizers; ``(?U)`` gives ``\s`` its Unicode meaning.
PATTERN = r"(?U)('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"
HOT_WORDS = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a word. Pairs wait in a heap, so a word of any length takes n log n."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    waiting = [(rank, i, word[i : i + 2]) for i in range(len(parts) - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, pair = heapq.heappop(waiting)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != pair:
            continue  # one of the two has been merged since
        parts[i], parts[j] = pair, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(parts):
                both = parts[left] + parts[right]
                rank = ranks.get(both)
                if rank is not None:
                    heapq.heappush(waiting, (rank, left, both))
    return [p for p in parts if p is not None]


_ranks: dict[str, dict[bytes, int]] = {}


def word_counts(path: str, words: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if path not in _ranks:
        _ranks[path] = read_ranks(path)
    for frame in words:
        frame["tokens"] = [len(merge(w.encode(), _ranks[path])) for w in frame["word"]]
        yield frame


def words_of(text: Column, pattern: str = PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def token_counts(df: DataFrame, key: list[str], text: str, path: str, pattern: str = PATTERN, hot_words: int = HOT_WORDS) -> DataFrame:
    """(key, tokens) of every row; ``key`` tells the rows apart. A null text has no count, an empty one 0 tokens.

    ``path`` names a ranks file that every executor can read.
    """
    own = [f"key_{i}" for i in range(len(key))]
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(key, own)], F.col(text).alias("text"))
    words = rows.select(*own, F.explode(words_of(F.col("text"), pattern)).alias("word"))
    table = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    table = checkpoint(table.mapInPandas(lambda frames: word_counts(path, frames), "word string, n bigint, tokens bigint"))
    total = table.agg(F.sum("n")).first()[0] or 0
    # fewer than ``hot_words`` words can each be more than one in ``hot_words`` of all
    hot = F.col("n") > total / hot_words
    frequent = table.where(hot).select("word", F.col("tokens").alias("frequent"))
    met = words.join(F.broadcast(frequent), "word", "left")
    known = met.where("frequent IS NOT NULL").groupBy(*own).agg(F.sum("frequent").alias("tokens"))
    others = met.where("frequent IS NULL").join(table.where(~hot).select("word", "tokens"), "word").groupBy(*own).agg(F.sum("tokens").alias("tokens"))
    none = rows.select(*own, F.when(F.col("text").isNotNull(), 0).cast("bigint").alias("tokens"))
    summed = none.unionByName(known).unionByName(others).groupBy(*own).agg(F.sum("tokens").alias("tokens"))
    return summed.select(*[F.col(o).alias(k) for k, o in zip(key, own)], "tokens")
