"""Token-id files: Parquet with a list column, delta-coded integers, controlled row groups and page indexes.

Documents are dealt by ranges of their id (ties by text), sorted, and encoded by the task that writes them. Each file is
one range and carries, per document, the shard number and the tokens before it in the shard, so that the global start
follows from one sum per shard. The files are written by Spark's own Parquet writer (any file system, committed by
task), with version-2 pages: integers and list levels are delta- or run-length coded, strings use dictionaries, and each
column chunk has a page index. Reading metadata touches no token page; reading a few documents by id uses the page index.

Words are encoded once per worker and then looked up, which gives exactly the ids of encoding the whole text. Latin-1
texts are cut into the words of the tokenizer's pattern on arrays of all characters of a step (runs of letters or of
signs, single numbers, contractions); each different word of a step is looked up once, and new ones go to the model in
long lines. Texts with other characters or with the marks of a special token go through the whole tokenizer.

Defined cases: a null or empty text has the end id only; null ids come first; rows with equal ids are ordered by text,
and rows that are equal in both are interchangeable; other columns are not stored unless named in ``meta``.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm import common as C

END_ID = 2
#: Words that one worker remembers; when full it starts again, so its memory is bounded.
CACHE_WORDS = 1 << 18
#: Bytes of text that one step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10

#: Words that go to the tokenizer in one call.
_LINE, _LINES = 512, 16
LETTER, NUMBER, BLANK, SIGN = range(4)
#: What the tokenizer's pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Encoder:
    """ids of words, remembered. ``path``: a tokenizers file whose words end with ``</w>``."""

    def __init__(self, path: str, end_id: int = END_ID):
        # a task has one core; threads would only hold memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # the same model without the steps before it
        self.lean = Tokenizer(self.whole.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        # texts with the first two characters of a special token take the longer way
        self.marks = {a.content[:2] for a in self.whole.get_added_tokens_decoder().values()}
        self.kinds = np.array([self._kind(chr(c)) for c in range(256)], np.uint8)
        self.end_id = end_id
        self.clear()

    def _kind(self, ch: str) -> int:
        """Class of a character, as the tokenizer's own pattern tells."""
        words = self.whole.pre_tokenizer.pre_tokenize_str
        if not words(ch) or ch.isspace() and not words(self.whole.normalizer.normalize_str(ch)):
            return BLANK
        if len(words(ch + ch)) == 2:
            return NUMBER
        return LETTER if len(words("a" + ch)) == 1 else SIGN

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = array("i")
        self.start = array("i", [0])

    def learn(self, words: list[bytes]) -> None:
        """Remember words that are not known yet; each ends with exactly one word-end token."""
        for i in range(0, len(words), _LINE * _LINES):
            part = words[i : i + _LINE * _LINES]
            lines = [b" ".join(part[k : k + _LINE]).decode("latin-1") for k in range(0, len(part), _LINE)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.lean.encode_batch_fast(lines, add_special_tokens=False)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("a word does not end with one word-end token")
            at = len(self.start) - 1
            self.place.update(zip(part, range(at, at + len(part))))
            self.start.frombytes((cuts + len(self.flat)).astype(np.int32).tobytes())
            self.flat.frombytes(ids.tobytes())

    def _words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each word of lower-cased Latin-1 texts that begin at ``starts``."""
        n = len(data)
        kind = self.kinds[data]
        first = np.zeros(n + 4, bool)
        first[starts[starts < n]] = True
        first[n:] = True
        cut = first[: n + 1].copy()
        cut[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        at = np.flatnonzero((data == 0x27) & cut[:n])
        ahead = np.concatenate((data, np.zeros(3, np.uint8)))
        free = np.ones(len(at), bool)
        for tail in CONTRACTIONS:
            hit = free.copy()
            for j, c in enumerate(tail, 1):
                hit &= (ahead[at + j] == ord(c)) & ~first[at + j]
            free &= ~hit
            cut[at[hit] + 1] = False
            cut[at[hit] + 1 + len(tail)] = True
        bounds = np.flatnonzero(cut)
        inside = kind[bounds[:-1]] != BLANK
        return bounds[:-1][inside], bounds[1:][inside]

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of Latin-1 texts without special tokens, and where those of each end."""
        # lower-casing here is what the tokenizer does to these characters one by one, and they are in normal form
        raw = "".join(texts).lower().encode("latin-1")
        ends = np.cumsum([len(t) for t in texts])
        if not raw:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)
        begin, end = self._words(data, np.concatenate(([0], ends[:-1])))
        _, one, which = np.unique(C.span_hashes(data, begin, end), return_index=True, return_inverse=True)
        same = np.flatnonzero((end - begin) != (end - begin)[one][which])
        if len(same) or not _equal(data, begin, end, one[which]):
            raise ValueError("two words of one hash")
        words = [raw[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist())]
        new = [w for w in words if w not in self.place]
        if new:
            if len(self.place) + len(new) > CACHE_WORDS:
                self.clear()
                new = words
            self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[which]
        first = np.frombuffer(self.start, np.int32).astype(np.int64)
        size = first[at + 1] - first[at]
        upto = np.cumsum(size)
        each = np.repeat(first[at] - (upto - size), size)
        each += np.arange(len(each))
        ids = np.frombuffer(self.flat, np.int32)[each] if len(each) else np.empty(0, np.int32)
        upto = np.concatenate(([0], upto))
        return ids, upto[np.searchsorted(begin, ends)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each with the end id, and where each text begins."""
        plain = np.array([self._is_plain(t) for t in texts], bool)
        ids, ends = self._encode_plain([t for t, p in zip(texts, plain) if p])
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain] = np.diff(ends, prepend=0)
        others = [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)]
        sizes[~plain] = [len(o) for o in others]
        at = np.concatenate(([0], np.cumsum(sizes + 1)))
        out = np.full(at[-1], self.end_id, np.int32)
        of_plain = np.repeat(plain, sizes + 1)
        of_plain[at[1:] - 1] = False
        out[of_plain] = ids
        for k, found in zip(np.flatnonzero(~plain), others):
            out[at[k] : at[k] + len(found)] = found
        return out, at

    def _is_plain(self, text: str) -> bool:
        if any(k in text for k in self.marks):
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True


def _equal(data: np.ndarray, begin: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span has the bytes of the span it stands for; their lengths are equal."""
    size = end - begin
    upto = np.cumsum(size)
    step = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size, size)
    return bool(np.array_equal(data[np.repeat(begin, size) + step], data[np.repeat(begin[like], size) + step]))


#: The encoder of this Python worker: a worker runs many tasks, and what it has learned serves all of them.
_held: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    if (path, end_id) not in _held:
        _held.clear()
        _held[path, end_id] = Encoder(path, end_id)
    return _held[path, end_id]


def write(docs: DataFrame, folder: str, tokenizer: str, meta: list[str] | None = None, text: str = "text", end_id: int = END_ID) -> None:
    """Write the token files of ``docs`` to ``folder``, in ascending order of the id."""
    meta = meta or []
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select("doc_id", *meta).dtypes)
    schema = f"{kinds}, shard int, shard_start bigint, n_tokens bigint, input_ids array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, before = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in C.steps(batches, limit=STEP_BYTES):
            ids, at = words.encode(["" if t is None else t for t in batch.column("text").to_pylist()])
            size = np.diff(at)
            start = before + at[:-1]
            before += int(at[-1])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.full(len(size), shard, np.int32)), pa.array(start), pa.array(size), lists],
                [*batch.schema.names[1:], "shard", "shard_start", "n_tokens", "input_ids"],
            )

    asked = docs.select(F.col(text).alias("text"), "doc_id", *meta)
    dealt = asked.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.enable.dictionary#input_ids.list.element": "false",
        "parquet.enable.dictionary#shard_start": "false",
    }
    C.map_texts(ordered, encode, schema).write.options(**options).parquet(folder)


def starts(stored: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before. Only one number per shard is gathered."""
    sums = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file of the store
    offsets = sums.select(F.col("shard").alias("shard_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_"))
    return stored.join(F.broadcast(offsets), F.col("shard") == F.col("shard_")).withColumn("start", F.col("offset_") + F.col("shard_start")).drop("shard_", "offset_")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("input_ids"))
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
        names = [n for n in batch.schema.names if n != "input_ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], [*names, "n_tokens", "ids_crc32"])


def digests(stored: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens and ids_crc32, the last two from the ids that are read.

    The lists are read and summed first, so that no list is ever joined.
    """
    heads = "shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint"
    sums = C.map_texts(stored.select("doc_id", "shard", "shard_start", "input_ids"), _checksums, f"doc_id {dict(stored.dtypes)['doc_id']}, {heads}")
    sizes = starts(stored.select("shard", "n_tokens", F.lit(0).alias("shard_start")).groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.min("shard_start").alias("shard_start")))
    offsets = sizes.select(F.col("shard").alias("shard_"), F.col("start").alias("offset_"))
    rows = sums.join(F.broadcast(offsets), F.col("shard") == F.col("shard_"))
    return rows.select("doc_id", (F.col("offset_") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, tokenizer: str, meta: list[str] | None = None) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and give them back as a table."""
    folder = C.shared_folder(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer, meta)
    return docs.sparkSession.read.parquet(folder)
