"""Byte-level BPE by forced-boundary splitting: encoding and decoding of whole texts.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can be inside no token of any text, so there
is a certain cut between the two. The table of the 65,536 pairs is made from the vocabulary. Its cuts, and those of the
tokenizer's own word pattern (which depend on the context: white space before words, contractions), part a text into
fragments. No merge crosses a cut, so fragments are encoded independently and their ids strung together. Few fragments
differ, and a worker remembers the ids of those it has met.

Cuts are found on numpy arrays of all bytes of some texts at once: the pattern asks only for the class of a character
(letter, number, white space, other), which is learned per character from the tokenizer itself, and for its neighbours.
Long texts are taken in slices that end between an ASCII letter and a blank, where nothing before or after matters.

Decoding strings the bytes of the tokens together, special tokens as their text, and replaces what is no UTF-8, as the
tokenizers library does. Every encoded text is decoded and compared in the same step, which also rules out that two
fragments met under one 64-bit hash.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null id array decodes to an empty text;
the text of a special token is that token; texts of any length are encoded whole; equal rows and equal ids are rows of
their own; other columns are ignored unless named in ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm import common as C

#: Fragments that one worker remembers; when full it starts again, so its memory is bounded.
CACHE_FRAGMENTS = 1 << 18
#: Bytes of one slice of a longer text.
SLICE_BYTES = 1 << 18
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: What the tokenizer's pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of a tokenizers file: byte-level BPE with the word pattern, no normalizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.words = whole.pre_tokenizer
        # the model alone, for fragments already written in the letters of bytes
        self.model = Tokenizer(whole.model)
        self.letters = byte_letters()
        byte_of = {c: i for i, c in enumerate(self.letters)}
        special = whole.get_added_tokens_decoder()
        self.special = {a.content: i for i, a in special.items()}
        vocabulary = whole.get_vocab(with_added_tokens=False)
        size = max([*vocabulary.values(), *special]) + 1
        spelled = [b""] * size
        inside = np.zeros(1 << 16, bool)
        for token, i in vocabulary.items():
            spelled[i] = bytes(byte_of[c] for c in token)
            pairs = np.frombuffer(spelled[i], np.uint8).astype(np.int64)
            inside[pairs[:-1] * 256 + pairs[1:]] = True
        for i, a in special.items():
            spelled[i] = a.content.encode()
        #: True for a pair of bytes that is inside no token.
        self.forced = ~inside
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate(([0], np.cumsum([len(s) for s in spelled]))).astype(np.int64)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.clear()

    def clear(self) -> None:
        # a fragment's number, and its ids from start[number] to start[number + 1] of the flat array
        self.known = {text.encode(): k for k, text in enumerate(self.special)}
        self.flat = array("i", self.special.values())
        self.start = array("q", range(len(self.special) + 1))

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        """Class of each character, asking the tokenizer's pattern about those not met before."""
        kinds = self.kinds[codes]
        for c in np.unique(codes[kinds == UNKNOWN]):
            ch = chr(c)
            # a letter joins a letter, a number a number; white space after a blank keeps a following letter apart
            if len(self.words.pre_tokenize_str("a" + ch)) == 1:
                kind = LETTER
            elif len(self.words.pre_tokenize_str("1" + ch)) == 1:
                kind = NUMBER
            elif len(self.words.pre_tokenize_str("!" + ch)) == 1:
                kind = OTHER
            else:
                kind = SPACE
            self.kinds[c] = kind
        return self.kinds[codes]

    def _word_cuts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """True where the tokenizer's pattern begins a word; ``starts`` are the first characters of the texts."""
        n = len(codes)
        kind = self._kinds(codes)
        first = np.zeros(n + 4, bool)
        first[starts] = True
        first[n:] = True
        cut = first[:n].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        # the last of several white-space characters goes with, or stands before, the word that follows
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        cut[last] = True
        cut[last[codes[last] == 0x20] + 1] = False
        at = np.flatnonzero((codes == 0x27) & cut)
        ahead = np.concatenate((codes, np.zeros(3, codes.dtype)))
        free = np.ones(len(at), bool)
        for tail in CONTRACTIONS:
            hit = free.copy()
            for j, c in enumerate(tail, 1):
                hit &= (ahead[at + j] == ord(c)) & ~first[at + j]
            free &= ~hit
            found = at[hit]
            cut[found + 1] = False
            after = found + 1 + len(tail)
            cut[after[after < n]] = True
        return cut

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Slices of a text whose ids can be strung together, and whether a slice is a special token."""
        rest = [(text, False)]
        for mark in self.special:
            rest = [p for t, s in rest for p in ([(t, s)] if s or mark not in t else _around(t, mark))]
        for t, special in rest:
            if special or len(t) <= SLICE_BYTES:
                yield t, special
                continue
            at = 0
            while at < len(t):
                to = _slice_end(t, at + SLICE_BYTES)
                yield t[at:to], False
                at = to

    def _learn(self, fragments: list[bytes]) -> None:
        if len(self.known) + len(fragments) > CACHE_FRAGMENTS:
            self.clear()
        fresh = [f for f in fragments if f not in self.known]
        letters = self.letters
        spelled = ["".join([letters[b] for b in f]) for f in fresh]
        for f, e in zip(fresh, self.model.encode_batch_fast(spelled, add_special_tokens=False)):
            self.known[f] = len(self.start) - 1
            self.flat.extend(e.ids)
            self.start.append(len(self.flat))

    def _encode_pieces(self, pieces: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces and where those of each begin (one more at the end)."""
        whole = "".join(p for p, _ in pieces)
        data = np.frombuffer(whole.encode(), np.uint8)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p, _ in pieces])
        begin_char = np.concatenate(([0], ends[:-1])).astype(np.int64)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(pieces) + 1, np.int64)
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)
        byte_at = np.append(byte_at, len(data))
        filled = begin_char < np.append(begin_char[1:], len(codes))
        cut = np.zeros(len(data), bool)
        cut[byte_at[:-1][self._word_cuts(codes, begin_char[filled])]] = True
        cut[1:] |= self.forced[data[:-1].astype(np.int64) * 256 + data[1:]]
        bounds = np.append(byte_at[begin_char], len(data))
        for k, (_, special) in enumerate(pieces):
            if special:
                cut[bounds[k] + 1 : bounds[k + 1]] = False
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        _, one, which = np.unique(C.span_hashes(data, begin, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        distinct = [raw[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist())]
        if not all(map(self.known.__contains__, distinct)):
            self._learn([f for f in distinct if f not in self.known])
            if not all(map(self.known.__contains__, distinct)):  # it has started again
                self._learn(distinct)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        ids, ends = _gather(np.frombuffer(self.flat, np.int32), np.frombuffer(self.start, np.int64), number[which])
        # number of ids before each fragment, at the fragments that begin a piece
        before = np.concatenate(([0], ends))
        at = before[np.searchsorted(begin, bounds)]
        if not np.array_equal(self.spell(ids)[0], data):
            raise ValueError("two fragments of one hash")
        return ids, at

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens one after another, and where each ends."""
        return _gather(self.spelled, self.spelled_at, ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts and where those of each begin (one more at the end)."""
        out, sizes = [], np.zeros(len(texts), np.int64)
        group: list[tuple[str, bool]] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            ids, at = self._encode_pieces(group)
            out.append(ids)
            np.add.at(sizes, owner, np.diff(at))
            group.clear()
            owner.clear()

        for k, text in enumerate(texts):
            for piece in self._pieces(text or ""):
                group.append(piece)
                owner.append(k)
                held += len(piece[0])
                if held >= SLICE_BYTES:
                    flush()
                    held = 0
        if group:
            flush()
        return np.concatenate(out) if out else np.empty(0, np.int32), np.concatenate(([0], np.cumsum(sizes)))

    def decode(self, ids: np.ndarray) -> str:
        return self.spell(ids)[0].tobytes().decode("utf-8", "replace")


def _around(text: str, mark: str) -> list[tuple[str, bool]]:
    """A text parted at the places of a special token, which are kept."""
    parts = text.split(mark)
    return [q for p in parts[:-1] for q in ((p, False), (mark, True))] + [(parts[-1], False)]


def _slice_end(text: str, at: int) -> int:
    """The first place from ``at`` on that stands between an ASCII letter and a blank, or the end."""
    while (at := text.find(" ", at)) >= 0:
        if text[at - 1].isascii() and text[at - 1].isalpha():
            return at
        at += 1
    return len(text)


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[at[i]:at[i + 1]]`` for i in ``which``, strung together, and where each ends."""
    size = at[which + 1] - at[which]
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0)
    place += np.repeat(at[which] - (ends - size), size)
    return flat[place], ends


#: The codec of this Python worker: a worker runs many tasks, and what it has learned serves all of them.
_held: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _held:
        _held.clear()
        _held[path] = Codec(path)
    return _held[path]


def _encoder(path: str) -> Callable:
    """Batches (text, other columns) to batches (other columns, input_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in C.steps(batches, "text_", SLICE_BYTES):
            ids, at = known.encode(batch.column("text_").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], [*batch.schema.names[1:], "input_ids"])

    return run


def _per_list(path: str, names: list[str], made: Callable[[Codec, list[np.ndarray]], list[pa.Array]]) -> Callable:
    """Batches with input_ids to batches of the other columns and those ``made`` of the lists of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            others = [n for n in batch.schema.names if n != "input_ids"]
            rows = [row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.empty(0, np.int32) for row in batch.column("input_ids")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), *made(known, rows)], [*others, *names])

    return run


def _texts(known: Codec, rows: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(map(known.decode, rows), pa.string())]


def _sums(known: Codec, rows: list[np.ndarray]) -> list[pa.Array]:
    return [
        pa.array(map(len, rows), pa.int64()),
        pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()),
        pa.array([hashlib.sha256(known.decode(r).encode()).hexdigest() for r in rows], pa.string()),
    ]


_SUMS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _kinds(rows: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``input_ids`` of every row."""
    return C.map_texts(docs.select(F.col(text).alias("text_"), *keep), _encoder(path), f"{_kinds(docs, keep)}, input_ids array<int>")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the ``text`` of every row of ``input_ids``."""
    return C.map_texts(encoded.select("input_ids", *keep), _per_list(path, ["text"], _texts), f"{_kinds(encoded, keep)}, text string")


def digests(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``input_ids``: n_tokens, SHA-256 of the ids as 32-bit integers and of the decoded text."""
    return C.map_texts(encoded.select("input_ids", *keep), _per_list(path, _SUMS, _sums), f"{_kinds(encoded, keep)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``digests(encode(docs))`` in one Python worker a task, which the ids never leave."""
    first, second = _encoder(path), _per_list(path, _SUMS, _sums)
    return C.map_texts(docs.select(F.col(text).alias("text_"), *keep), lambda b: second(first(b)), f"{_kinds(docs, keep)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
